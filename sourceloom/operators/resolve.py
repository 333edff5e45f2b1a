"""Name resolution: a name as written in a file -> the project class it means.

Precedence: the name as a qualified name; an explicit import whose last
segment it is (first import first); its own package; a simple name that only
one class bears.  Instead of one join per rule, every name is turned into its
candidate keys with their rank, all keys meet one dictionary in one join, and
the lowest rank wins.

What a name means follows from the name, the package and the imports that end in it.  Most
files of a package share these (`questions`), so each is resolved once and its rows are told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.naming import last_segment
from sourceloom.operators.skew import hot_keys, lookup_join

_SAME_PACKAGE, _UNIQUE_NAME = 1_000_000, 1_000_001
_TOLD = ["target", "target_package", "target_kind", "target_layer"]
_ASKED = ("name", "package", "import_paths")


def dictionary(syms: DataFrame, unique: DataFrame) -> DataFrame:
    """key -> class; `F:` keys are qualified names, `S:` keys are unique simple names."""
    payload = [F.col(c).alias(f"target_{c}") for c in ("package", "kind", "layer")]
    qualified = syms.select(F.concat(F.lit("F:"), "fqn").alias("key"), F.col("fqn").alias("target"), *payload)
    simple = unique.select(F.concat(F.lit("S:"), "name").alias("key"), F.col("fqn").alias("target"), *payload)
    return qualified.unionByName(simple)


def candidate_keys(name: Column, package: Column, import_paths: Column) -> Column:
    """ARRAY<STRUCT<rank, key>> of everything `name` could mean."""
    simple = last_segment(name)

    def key(rank, prefix, text):
        return F.struct(F.lit(rank).cast("int").alias("rank"), F.concat(F.lit(prefix), text).alias("key"))

    imported = F.transform(
        F.filter(import_paths, lambda p: last_segment(p) == simple),
        lambda p, i: F.struct((i + 1).cast("int").alias("rank"), F.concat(F.lit("F:"), p).alias("key")),
    )
    own = F.when(
        package != "", F.array(key(_SAME_PACKAGE, "F:", F.concat(package, F.lit("."), simple)))
    ).otherwise(F.array().cast("array<struct<rank:int,key:string>>"))
    return F.concat(F.array(key(0, "F:", name)), imported, own, F.array(key(_UNIQUE_NAME, "S:", simple)))


def candidates(refs: DataFrame, name: str = "name") -> DataFrame:
    """`refs` (name, package, import_paths, ...) with one row per candidate key."""
    keys = candidate_keys(F.col(name), F.col("package"), F.col("import_paths"))
    kept = [c for c in refs.columns if c not in ("package", "import_paths")]
    return refs.select(*kept, F.inline(keys))


def hot_candidate_keys(refs: DataFrame, min_rows: int, name: str = "name") -> list:
    """Hot keys among the candidates of `refs`.

    Every key ends in the simple name it stands for, so a key is as frequent as
    its name at most, and candidates are made for frequent names only.
    """
    simple = last_segment(F.col(name))
    frequent = hot_keys(refs.select(simple.alias("simple")), "simple", min_rows)
    return hot_keys(candidates(refs.filter(simple.isin(*frequent)), name), "key", min_rows) if frequent else []


def resolve(cands: DataFrame, names: DataFrame, by: list[str], hot: list | None = None, name: str = "name") -> DataFrame:
    """The candidates' rows, once per value of `by`, with `target` and its package, kind and layer.

    Rows of which no candidate is a project class are dropped.  `by` identifies
    a row; the hash before it is what the aggregation sorts on, as paths and
    qualified names differ only after long common beginnings.
    """
    # the simple names of hot keys, told before candidates are made
    where = last_segment(F.col(name)).isin(*{k[2:].rpartition(".")[2] for k in hot}) if hot else None
    return first_of(lookup_join(cands, names, "key", hot=hot, where=where).drop("key"), by)


def first_of(found: DataFrame, by: list[str]) -> DataFrame:
    """Of the rows with the same `by`, the one of the lowest rank."""
    rest = [c for c in found.columns if c not in ("rank", *_TOLD, *by)]
    best = F.min(F.struct("rank", *_TOLD, *rest)).alias("best")
    return found.groupBy(F.xxhash64(*by).alias("row_hash"), *by).agg(best).select(*by, *[f"best.{c}" for c in (*rest, *_TOLD)])


def asking(refs: DataFrame) -> DataFrame:
    """`refs` (name, package, import_paths, ...) with only the imports that end in the name, and `question`, a hash of these three."""
    simple = last_segment(F.col("name"))
    refs = refs.withColumns({"package": F.coalesce("package", F.lit("")), "import_paths": F.filter("import_paths", lambda p: last_segment(p) == simple)})
    return refs.withColumn("question", F.xxhash64(*_ASKED))


def questions(asked: DataFrame) -> DataFrame:
    """Names, packages and imports of the rows, each once, with `question`, and the last two again as `own` and `imported`."""
    once = asked.select(*_ASKED).distinct()
    return once.select(*_ASKED, F.xxhash64(*_ASKED).alias("question"), F.col("package").alias("own"), F.col("import_paths").alias("imported"))


def answers(each: DataFrame, names: DataFrame, hot: list | None = None) -> DataFrame:
    """The `questions` that have an answer, with the rank it was found at and what it is."""
    by = ["question", "name", "own", "imported"]
    ranked = candidates(each).withColumn("found_at", F.col("rank"))
    found = resolve(ranked, names, by, hot)
    return found.withColumnsRenamed({"own": "package", "imported": "import_paths", "found_at": "rank"})


def told(asked: DataFrame, answered: DataFrame, by: list[str], is_unique: bool, hot: list | None = None) -> DataFrame:
    """The rows of `asking`, those of a name that means a class, with what `resolve` would tell of them: once per value of `by`.

    `is_unique` says that no value of `by` comes twice, which leaves nothing to be done for that.  `hot` holds hashes of hot questions.
    """
    found = lookup_join(asked, answered, "question", hot=hot, beside=_ASKED).drop("question", *(c for c in _ASKED if c != "name"))
    return found.drop("rank") if is_unique else first_of(found, by)
