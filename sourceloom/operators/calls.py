"""The call graph."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.operators.skew import first_per_group

CALL_ORDER = ["path", "class_ord", "method_ord", "call_ord"]
_EDGE = [*CALL_ORDER, "caller_class", "caller_method", "callee_class", "callee_method", "callee_layer"]


def receiver_references(sites: DataFrame) -> DataFrame:
    """Call sites with a receiver, as names to resolve.  The type text is taken whole:
    `Repo<X> r; r.f()` means no project class."""
    return sites.filter(~F.col("is_self")).select(
        *CALL_ORDER, F.col("fqn").alias("caller_class"), "caller_method", "callee_method",
        F.col("type_text").alias("name"), "package", "import_paths",
    )


def call_edges(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every call whose class is known; calls on oneself need no look-up."""
    own = sites.filter("is_self").select(
        *CALL_ORDER, F.col("fqn").alias("caller_class"), "caller_method", F.col("fqn").alias("callee_class"),
        "callee_method", F.lit(None).cast("string").alias("callee_layer"),
    )
    other = resolved.select(
        *CALL_ORDER, "caller_class", "caller_method", F.col("target").alias("callee_class"), "callee_method",
        F.col("target_layer").alias("callee_layer"),
    )
    return own.select(*_EDGE).unionByName(other.select(*_EDGE))


def is_meaningful() -> Column:
    """Not a call on another class that only holds data."""
    return (F.col("caller_class") == F.col("callee_class")) | ~F.col("callee_layer").eqNullSafe("domain")


def calls_by_caller(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """The calls of every (class, method), in order, numbered from 1: all of them, or the first `limit`."""
    order = [F.col(c) for c in CALL_ORDER]
    caller = ["caller_class", "caller_method"]
    if limit is None:
        return edges.withColumn("call_rank", F.row_number().over(Window.partitionBy(*caller).orderBy(*order)))
    return first_per_group(edges, caller, order, limit, "call_rank")
