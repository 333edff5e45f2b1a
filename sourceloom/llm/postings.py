"""Benchmark decontamination through a positional inverted index of the training documents.

Benchmark items are cut into windows of consecutive words.  How often their words occur in
the documents is counted first; a window with a word that never occurs can't match, and the
rarest word of each other window is its anchor.  The index stores a posting (word, document,
place) for every occurrence of an anchor, with the words around it as payload, so the
offset-adjusted lists of the other words, the next rarest first, are intersected where
the posting lies.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import fresh, row_key
from sourceloom.session import written

WINDOW = 13
NEAR_TERMS, SLOP = 6, 12  # proximity: this many of the rarest words, each within so many words of the anchor
LEAST_SHARE = 20  # contaminated: one word in so many is hit
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and all beyond ASCII, A-Z lower-cased; null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), _NO_WORD), lambda w: w != "")


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, words, item): every window of every item; win is 128 bits of its words as text, item the id as text ('' if null)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    every = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(window)).alias("words"))
    return every.select(F.md5(F.array_join("words", " ").cast("binary")).alias("win"), "words", "item").distinct()


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, win, words, at, rest): each window under its rarest word; rest: its other words' offsets, rarest first.

    `counts` has (term, n) for words that occur; windows with another word are left out.
    """
    single = windows.select("win", "words").distinct()
    each = single.select("win", "words", F.posexplode("words").alias("at", "term"))
    # Up to `window` rows per window meet here.
    known = each.join(counts, "term").groupBy("win").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by_rarity"), F.first("words").alias("words"))
    known = known.filter(F.size("by_rarity") == F.size("words"))
    return known.select(
        F.get("by_rarity", F.lit(0))["term"].alias("term"), F.get("by_rarity", F.lit(0))["at"].alias("at"), "win", "words",
        F.transform("by_rarity", lambda x: x["at"]).alias("rest"), F.transform("by_rarity", lambda x: x["term"]).alias("rarest"),
    )


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key1, key2, place, lead, around) for every occurrence of `terms` (term, before, after).

    around: the words from `before` places before to `after` behind; lead: how many of them come before.
    The terms are joined as Spark chooses: broadcast below its size limit, shuffled beyond it.
    """
    k1, k2 = row_key(doc_id, text)
    exploded = docs.select(k1.alias("key1"), k2.alias("key2"), words(F.col(text)).alias("w")).select("key1", "key2", "w", F.posexplode("w").alias("place", "term"))
    lead = F.least("place", "before")
    return exploded.join(terms, "term").select("term", "key1", "key2", "place", lead.alias("lead"), F.slice("w", F.col("place") - lead + 1, lead + 1 + F.col("after")).alias("around"))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Where windows of the benchmark occur: (spans, windows).

    spans: (key1, key2, win, begin, end, exact) in words of the document with that `row_key`.
    exact: the window stands there word by word.  Else its NEAR_TERMS rarest words (windows
    with fewer different ones have no such matches) lie in any order within `slop` words of the
    rarest, which stands at begin.  windows: (win, item).  A document and an item without words
    match nothing; rows that repeat id and text have one key.
    """
    windows = written(item_windows(benchmark, item_id, item_text, window), "windows")
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    tokens = docs.select(F.explode(words(F.col(text))).alias("term"))
    # Counted before they are joined: a join that a sum by the same key follows would take all of a frequent word into one task.
    counts = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "term")
    anchored = written(anchors(windows, counts), "anchors")
    reach = F.when(F.size(F.array_distinct("rarest")) >= NEAR_TERMS, F.lit(slop)).otherwise(F.lit(0))
    terms = anchored.groupBy("term").agg(F.max(F.greatest("at", reach)).alias("before"), F.max(F.greatest(F.size("words") - 1 - F.col("at"), reach)).alias("after"))
    index = written(postings(docs, written(terms, "terms"), doc_id, text), "postings")

    start = F.col("lead") - F.col("at")  # of the window, in `around`
    inside = (start >= 0) & (start + F.size("words") <= F.size("around"))
    # Offset-adjusted lists, rarest first: the second and third rarest words settle nearly all candidates.
    second = [(F.size("rest") <= k) | (F.get("around", start + F.get("rest", F.lit(k))) == F.get("rarest", F.lit(k))) for k in (1, 2)]
    exact = F.when(inside & second[0] & second[1], F.slice("around", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")).otherwise(False)
    rare = F.slice(F.array_distinct("rarest"), 1, NEAR_TERMS)
    low = F.greatest(F.col("lead") - slop, F.lit(0))
    nearby = F.slice("around", low + 1, F.col("lead") + slop + 1 - low)
    near = (F.size(rare) == NEAR_TERMS) & (F.size(F.array_except(rare, nearby)) == 0)
    found = index.join(anchored, "term").filter(exact | near)
    begin = F.when(exact, F.col("place") - F.col("at")).otherwise(F.col("place"))
    spans = found.select("key1", "key2", "win", begin.alias("begin"), (begin + F.size("words")).alias("end"), exact.alias("exact"))
    return written(spans, "spans"), windows.select("win", "item")


def covered(spans: Column) -> Column:
    """How many places sorted (begin, end) cover; one pass."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["begin"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end"))
    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, key1, key2, n_words, n_hit, items, n_near, contaminated) for every row of `docs`.

    n_hit: words inside an exact match; items: ids as text of items with exact matches, sorted;
    n_near: items with proximity matches only; contaminated: at least one word in LEAST_SHARE is hit.
    Null and empty texts have no words and no matches.  Rows of the benchmark with the same id are one item.
    """
    spans, windows = matches(docs, benchmark, doc_id, text, item_id, item_text, window)
    hits = spans.filter("exact").groupBy("key1", "key2").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("s")).select("key1", "key2", covered(F.col("s")).alias("n_hit"))
    of_item = spans.select("key1", "key2", "win", "exact").distinct().join(windows, "win").groupBy("key1", "key2", "item").agg(F.max("exact").alias("exact"))
    items = of_item.groupBy("key1", "key2").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near"))
    k1, k2 = row_key(doc_id, text)
    rows = docs.select(F.col(doc_id).alias("id"), k1.alias("key1"), k2.alias("key2"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = rows.join(items.join(hits, ["key1", "key2"], "left"), ["key1", "key2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "id", "key1", "key2", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), ((n_hit > 0) & (LEAST_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` less the contaminated ones."""
    a, b = fresh("_k1", docs), fresh("_k2", docs)
    bad = contamination(docs, benchmark, doc_id, text).filter("contaminated").select(F.col("key1").alias(a), F.col("key2").alias(b)).distinct()
    k1, k2 = row_key(doc_id, text)
    return docs.withColumn(a, k1).withColumn(b, k2).join(bad, [a, b], "left_anti").drop(a, b)
