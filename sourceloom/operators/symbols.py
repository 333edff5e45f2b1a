"""Symbol tables: which class a name means."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACE = ["path", "class_ord"]
_FACTS = ["name", "package", "kind", "layer", "is_route", "is_public", "n_methods", "modifiers"]


def symbols(facts: DataFrame) -> DataFrame:
    """One row per qualified name.  Of equal names the last in tree order counts,
    while `first_path`, `first_ord` keep the place the name first had.

    Both aggregates combine on the map side, so a name with very many
    declarations reaches its reducer as one row per task.  The hash is what
    they sort on: qualified names differ only after long common beginnings.
    """
    return (
        facts.groupBy(F.xxhash64("fqn").alias("name_hash"), "fqn")
        .agg(
            F.max(F.struct(*_PLACE, *_FACTS)).alias("last"),
            F.min(F.struct(*_PLACE)).alias("first"),
            F.count("*").alias("n_declared"),
        )
        .select("fqn", "last.*", F.col("first.path").alias("first_path"), F.col("first.class_ord").alias("first_ord"), "n_declared")
    )


def unique_names(syms: DataFrame) -> DataFrame:
    """Simple names that exactly one declaration bears."""
    one = syms.groupBy("name").agg(F.sum("n_declared").alias("n"), F.max(F.struct("fqn", "package", "kind", "layer")).alias("c"))
    return one.filter("n = 1").select("name", "c.*")


def package_counts(parsed: DataFrame) -> DataFrame:
    """Declarations per package, equal qualified names counted each."""
    package = F.coalesce("package", F.lit("")).alias("package")
    return parsed.groupBy(package).agg(F.sum(F.size("classes.name")).alias("class_count")).filter("class_count > 0")


def public_api(syms: DataFrame) -> DataFrame:
    return syms.filter("is_public")
