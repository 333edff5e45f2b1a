"""What the tree uses that is not its own."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.layers import external_category
from sourceloom.functions.naming import import_root
from sourceloom.functions.rules import MAX_EXTERNAL_ROOTS
from sourceloom.operators.tables import import_categories, imports


def external_roots(parsed: DataFrame, top_n: int = MAX_EXTERNAL_ROOTS) -> DataFrame:
    """Most imported roots (two leading segments) that no package of the tree lies under.

    Ties go to the root met first.  The roots are counted before they are
    compared, so both sides of the anti join have one row per root.
    """
    counted = (
        imports(parsed)
        .groupBy(import_root(F.col("import_path")).alias("root"))
        .agg(F.count("*").alias("n_imports"), F.min(F.struct("path", "import_ord")).alias("first"))
    )
    own = (
        parsed.filter(F.col("package") != "")
        .select(F.explode(F.array(F.substring_index("package", ".", 1), import_root(F.col("package")))).alias("root"))
        .distinct()
    )
    top = counted.join(own, "root", "left_anti").orderBy(F.desc("n_imports"), "first").limit(top_n)
    return top.select("root", "n_imports", "first")


def external_systems(parsed: DataFrame) -> DataFrame:
    """Category -> sorted prefixes found; at most one row per known category."""
    found = import_categories(parsed).select("category", "prefix").distinct()
    return found.groupBy("category").agg(F.array_sort(F.collect_list("prefix")).alias("prefixes"))


def file_categories(parsed: DataFrame) -> DataFrame:
    """Per file: the category of its first categorised import, and all its categories.  No shuffle."""
    hits = F.filter(F.transform("imports.path", lambda p: external_category(p)["category"]), lambda c: c.isNotNull())
    return (
        parsed.select("path", F.array_distinct(hits).alias("categories"))
        .filter(F.size("categories") > 0)
        .withColumn("first_category", F.col("categories")[0])
    )
