"""Flat tables of a parsed tree: views over file or class rows, no shuffle.

Parquet can leave out columns of a nested array only where they are taken as
`array.field`, not inside a lambda or after an explode.  Hence `classes` is
meant to be written as a table, and what is exploded from it is put together
from single fields first (`zipped`).

Order inside the tree is (path, class_ord, method_ord, call_ord); there is no
global row number, which one task would have to hand out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import layers
from sourceloom.functions.text import signature


def files(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "language", "content_hash", "package", "parse_errors")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("imports").alias("import_ord", "i")).select(
        "path", "import_ord", F.col("i.path").alias("import_path"), "i.is_static", "i.is_wildcard"
    )


def classes(parsed: DataFrame) -> DataFrame:
    """One row per class, outer before nested, with what resolving its names needs of its file."""
    plain = F.filter("imports", lambda i: ~i["is_static"] & ~i["is_wildcard"])
    return parsed.select(
        "path",
        F.coalesce("package", F.lit("")).alias("package"),
        F.transform(plain, lambda i: i["path"]).alias("import_paths"),
        F.posexplode("classes").alias("class_ord", "c"),
    ).select("path", "package", "import_paths", "class_ord", F.col("c.qualified_name").alias("fqn"), "c.*")


def zipped(array: str, *fields: str) -> Column:
    """The array of structs with some of its fields only."""
    return F.arrays_zip(*[F.col(f"{array}.{f}").alias(f) for f in fields])


def class_facts(rows: DataFrame) -> DataFrame:
    """What other operators ask about a class, computed from its own row."""
    return rows.select(
        "path", "class_ord", "fqn", "name", "package", "kind", "modifiers",
        layers.layer(F.col("fqn"), F.col("kind"), F.col("annotations"), F.col("fields"), F.col("methods")).alias("layer"),
        layers.is_route_handler(F.col("annotations"), F.col("methods")).alias("is_route"),
        F.array_contains("modifiers", "public").alias("is_public"),
        F.size("methods").alias("n_methods"),
    )


def fields(rows: DataFrame) -> DataFrame:
    each = rows.select("path", "class_ord", "fqn", F.posexplode("fields").alias("field_ord", "f"))
    return each.select("path", "class_ord", "fqn", "field_ord", "f.*")


def methods(rows: DataFrame) -> DataFrame:
    """Declared methods with their signature; bodies and comments are left aside."""
    declared = zipped(
        "methods", "name", "return_type", "parameters", "modifiers", "annotations", "annotation_args", "is_constructor"
    )
    each = rows.select(
        "path", "class_ord", "fqn", F.col("modifiers").alias("class_modifiers"), F.posexplode(declared).alias("method_ord", "m")
    )
    return each.select(
        "path", "class_ord", "fqn", "method_ord", "m.*", signature(F.col("m")).alias("signature"),
        layers.is_entry_candidate(F.col("class_modifiers"), F.col("m")).alias("is_entry_candidate"),
        layers.route_annotation(F.col("m.annotations")).alias("route"),
    )


def call_sites(rows: DataFrame) -> DataFrame:
    """Every call with the type text its receiver stands for.

    A parameter hides a field of the same name, the last of equal names counts,
    and a receiver that is neither may itself be a class name.
    """

    def type_of(named, receiver):
        hits = F.filter(named, lambda x: x["name"] == receiver)
        return F.try_element_at(hits, F.lit(-1))["type"]

    each = rows.select(
        "path", "class_ord", "fqn", "package", "import_paths", zipped("fields", "name", "type").alias("fields"),
        F.posexplode(zipped("methods", "name", "parameters", "calls")).alias("method_ord", "m"),
    )
    each = each.select("*", F.posexplode("m.calls").alias("call_ord", "call"))
    receiver = F.col("call.receiver")
    return each.select(
        "path", "class_ord", "fqn", "package", "import_paths", "method_ord", "call_ord",
        F.col("m.name").alias("caller_method"), receiver.alias("receiver"), F.col("call.method").alias("callee_method"),
        (receiver.isNull() | (receiver == "this")).alias("is_self"),
        F.coalesce(type_of(F.col("m.parameters"), receiver), type_of(F.col("fields"), receiver), receiver).alias("type_text"),
    )


def import_categories(parsed: DataFrame) -> DataFrame:
    """Imports of a known external system: path, import_ord, category, prefix."""
    rows = imports(parsed).withColumn("hit", layers.external_category(F.col("import_path")))
    return rows.filter("hit is not null").select("path", "import_ord", "import_path", "hit.category", "hit.prefix")
