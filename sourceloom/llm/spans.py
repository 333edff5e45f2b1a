"""Substring dedup by sliding runs of sentences.

From every sentence on, and up to every sentence, the shortest run of at least LEAST_SENTENCES
sentences with at least LEAST_WORDS words is hashed.  Two texts that share a passage have the same
runs inside it, wherever it lies in them, and these cover the same as all longer runs would: what
can't begin a run inside the passage lies in the one that ends with it.  Runs are joined globally as in line dedup, and the characters of
all but the first occurrence are taken out.  Sentences end at a full stop, question or
exclamation mark (of any script, quotes and brackets may follow) before white space, or with the
line.  Long ones are cut where the words say so, behind the smallest hash of the last NEARBY words of
the sentence, so that passages with few stops are cut alike wherever they begin or lie.
"""

from __future__ import annotations

import re
import struct
from itertools import accumulate, count
from operator import add

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import fresh, row_key
from sourceloom.llm.lines import stretches

LEAST_SENTENCES, LEAST_WORDS = 2, 25
NEARBY, LEAST_PART, MOST_PART = 6, 4, 24  # words: where to cut long sentences, and how long parts are at least and at most
MAX_CACHED, MAX_WORD = 200_000, 64  # hashes of words that a worker keeps, and how long these words are at most
HELD_RUNS = 100_000  # runs that a task compares among themselves before it passes them on

_WORD = re.compile(r"\S+")
_STOPS = tuple(".!?…‼⁇⁈⁉。！？．｡؟۔।॥։።፧။។")
_CLOSING = "\"'”’»›“‘)]}」』）】》〉"
_MAY_END = frozenset((*_STOPS, *_CLOSING))  # last characters of a word that may end a sentence


class _Hashes(dict):
    """Hashes of words met before; of bounded size."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = h
        return h

    def __reduce__(self):
        return _Hashes, ()  # goes to tasks empty


_hashes = _Hashes()


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(begin, end, words) of each sentence or part of a long one, in characters; white space behind it belongs to it."""
    out: list[tuple[int, int, list[str]]] = []
    words, starts, line_ends, at = [], [], set(), 0  # line_ends: numbers of the first words behind a line end
    for line in text.split("\n"):
        here = line.split()
        if here:
            line_ends.add(len(words))
            words += here
            if " ".join(here) == line:
                starts += map(add, accumulate(map(len, here[:-1]), initial=at), count())
            else:
                starts += [at + m.start() for m in _WORD.finditer(line)]
        at += len(line) + 1
    starts.append(len(text))
    hashes = list(map(_hashes.__getitem__, words))
    begin, first, since = 0, 0, 0  # in characters; words: the first one, and the first one behind the last stop or line end
    for i, word in enumerate(words):
        if word[-1] in _MAY_END and word.rstrip(_CLOSING).endswith(_STOPS) or i + 1 in line_ends:
            since = i + 1
        elif i - first + 1 != MOST_PART:
            if hashes[i] > hashes[i - 1] or i - first < LEAST_PART - 1 or i - since < NEARBY - 1 or hashes[i] > min(hashes[i - NEARBY + 1 : i]):
                continue
        out.append((begin, starts[i + 1], words[first : i + 1]))
        begin, first = starts[i + 1], i + 1
    if first < len(words):
        out.append((begin, len(text), words[first:]))
    return out


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """(begin, end, h1, h2) of the shortest runs that begin or end with a sentence, where there is one; neither begins nor ends fall."""
    units = sentences(text)
    sizes, bodies = [len(w) for _, _, w in units], [(" ".join(w)).encode("utf-8", "replace") for _, _, w in units]
    found, i, j, words = set(), 0, 0, 0  # units i..j-1 are in the run
    for i in range(len(units)):
        while j < len(units) and (j - i < LEAST_SENTENCES or words < LEAST_WORDS):
            words += sizes[j]
            j += 1
        if j - i < LEAST_SENTENCES or words < LEAST_WORDS:
            break
        found.add((i, j))
        words -= sizes[i]
    i, words = 0, 0
    for j in range(1, len(units) + 1):
        words += sizes[j - 1]
        while j - i > LEAST_SENTENCES and words - sizes[i] >= LEAST_WORDS:
            words -= sizes[i]
            i += 1
        if j - i >= LEAST_SENTENCES and words >= LEAST_WORDS:
            found.add((i, j))
    out = []
    for i, j in sorted(found):
        out.append((units[i][0], units[j - 1][1], *struct.unpack("<qq", xxhash.xxh3_128_digest(b"\n".join(bodies[i:j])))))
    return out


def span_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of all documents, in characters: (id, key1, key2, begin, end, h1, h2, later).

    later: the same run stands at an earlier place among the last HELD_RUNS that the task has
    read, so it can't be the first one.  That leaves one row for each content and stretch of a
    task which may be; a content that a third of all documents have is cut down where it is read.
    """
    k1, k2 = row_key(doc_id, text)
    rows = docs.select(F.col(doc_id).alias("id"), k1.alias("key1"), k2.alias("key2"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T.LongType()) for n in ("key1", "key2")), *(T.StructField(n, T.IntegerType()) for n in ("begin", "end")), *(T.StructField(n, T.LongType()) for n in ("h1", "h2")), T.StructField("later", T.BooleanType())])
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches):
        first: dict[tuple, tuple] = {}  # content -> (place, number of its row among those held)
        ids, keys1, keys2, found, later = [], [], [], [], []

        def out(id_type):
            columns = list(zip(*found)) if found else [[]] * 4
            arrays = [pa.array(ids, id_type), pa.array(keys1, pa.int64()), pa.array(keys2, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(later, pa.bool_())]
            for held in (first, ids, keys1, keys2, found, later):
                held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.column("id").type
            names = zip(*(batch.column(c).to_pylist() for c in ("id", "key1", "key2")))
            for i, (name, key1, key2) in enumerate(names):
                for mine in runs(batch.column("text")[i].as_py() or ""):
                    place = (name is None, name, key1, key2, mine[0])
                    before = first.get(mine[2:])
                    if before is not None and place == before[0]:
                        continue  # the row repeats: the one held stands for both
                    if before is None or place < before[0]:
                        first[mine[2:]] = (place, len(found))
                        if before is not None:
                            later[before[1]] = True
                    ids.append(name), keys1.append(key1), keys2.append(key2), found.append(mine)
                    later.append(before is not None and place > before[0])
                if len(found) > HELD_RUNS:
                    yield out(kind)
        if found:
            yield out(kind)

    return rows.mapInArrow(run, schema)


def later_spans(found: DataFrame) -> DataFrame:
    """`stretches` of all runs that are not the first of their content, by (id, key1, key2, begin), null ids last.

    Rows known to be later need no comparison and are dealt evenly; the others meet by content, at
    most one for each stretch of a task, in as few columns as can be.  Rows of the same place (documents that repeat) share a rank.
    """
    apart = F.when(F.col("later"), F.pmod(F.xxhash64("key1", "begin"), F.lit(1 << 20)) + 1).otherwise(0).cast("int").alias("apart")
    place = (F.shiftleft(F.col("begin").cast("long"), 32) + F.col("end")).alias("place")
    order = [F.col("id").asc_nulls_last(), "key1", "key2", "place"]
    number = F.rank().over(Window.partitionBy("h1", "h2", "apart").orderBy(*order))
    later = found.select("id", "key1", "key2", place, "h1", "h2", apart).withColumn("number", number).filter("apart > 0 or number > 1")
    return stretches(later.select("key1", "key2", F.shiftright("place", 32).cast("int").alias("begin"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end")))


def cut(text: str, stretches: list[dict] | None) -> tuple[str, int]:
    """`text` without the stretches, and the number of words in them."""
    if not stretches:
        return text, 0
    kept, at, gone = [], 0, 0
    for s in stretches:
        kept.append(text[at : s["begin"]])
        gone += len(text[s["begin"] : s["end"]].split())
        at = s["end"]
    return "".join([*kept, text[at:]]), gone


def dedup_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "n_removed_words") -> DataFrame:
    """`docs` with `text` less the sentences that a repeated run covers, and `removed`: the number of words taken out.

    Words of runs are compared exactly, white space between them isn't.  The first
    occurrence, by (id, place) and null ids last, stays; a passage repeated within one text goes
    as well.  Null, empty and short texts stay as they are; a text may become empty, its row
    stays.  Rows that repeat id and text are one document.  A column `removed` of `docs` is replaced.
    """
    docs = docs.drop(removed)
    a, b, name, both = fresh("_k1", docs), fresh("_k2", docs), fresh("_stretches", docs), fresh("_cut", docs)
    k1, k2 = row_key(doc_id, text)
    covered = later_spans(span_runs(docs, doc_id, text)).select(F.col("key1").alias(a), F.col("key2").alias(b), F.col("stretches").alias(name))
    joined = docs.withColumn(a, k1).withColumn(b, k2).join(covered, [a, b], "left").drop(a, b)
    # Only texts with something to cut pass through Python.
    whole = joined.filter(F.col(name).isNull()).drop(name).withColumn(removed, F.lit(0).cast("long"))
    parts = joined.filter(F.col(name).isNotNull())
    parts = parts.withColumn(both, _cut(F.col(text), F.col(name)))
    out = [F.col(both)["text"].alias(c) if c == text else F.col(c) for c in docs.columns]
    return whole.unionByName(parts.select(*out, F.col(both)["gone"].alias(removed)))


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("gone", T.LongType())])


@F.pandas_udf(_CUT)
def _cut(text, stretches):
    import pandas as pd

    done = [cut(t, list(s)) for t, s in zip(text, stretches)]
    return pd.DataFrame(done, columns=["text", "gone"])
