"""Runs of periodic words, found through string synchronising sets.

A run is a stretch of words that repeats with a smallest period q at least four times and
that neither neighbour extends.  Periods under SMALL are found apart, by comparing the text with
itself q words on.  Longer ones are sought at scales t = SMALL, 2 SMALL, 4 SMALL, ...: position i is
selected if, among the hashes of the blocks of t words that begin at i .. i + t, the first or
the last one is least.  Blocks that repeat a period of t / 4 or less would make too many or no positions; they
lie in runs already found and take no part.  What is selected depends only on the 2 t words from i on, and every 2 t
places that aren't all such blocks hold a position.  So in a run of period t <= q < 2 t some position meets the
same context q words on, and nowhere between.  Pairs of next equal contexts propose the
periods; words are then compared to both sides until the period breaks.

Where no two positions share a context there is no longer period, and the search ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourceloom.llm.common import with_columns_from

SMALL = 8  # a power of two
TIMES, LEAST = 4, 6  # a run has LEAST words and TIMES periods at least
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

_OUT = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHUNK = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of blocks of 2 t words from those of t words."""
    return _mix(h[:-t] * np.uint64(0xD6E8FEB86659FD93) + _mix(h[t:]))


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, in linear time: prefix and suffix minima of pieces of that width."""
    pad = -len(v) % width
    pieces = np.concatenate([v, np.full(pad, _OUT)]).reshape(-1, width)
    prefix = np.minimum.accumulate(pieces, axis=1).ravel()
    suffix = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: len(v) - width + 1], prefix[width - 1 : len(v)])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the beginning on; looks in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, _CHUNK
    a, b = a[:n], b[:n]
    while at < n:
        other = np.nonzero(a[at : at + step] != b[at : at + step])[0]
        if len(other):
            return at + int(other[0])
        at += step
        step *= 2
    return n


def _prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def _is_smallest(w: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether a stretch of four periods q or more has no smaller one; a smaller one would divide q."""
    part = w[start : start + length]
    return not any(np.array_equal(part[: -(q // f)], part[q // f :]) for f in _prime_factors(q))


def _small_periods(w: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, min(SMALL, len(w) // TIMES + 1)):
        least = max(LEAST, TIMES * q)
        same = w[:-q] == w[q:]
        if np.count_nonzero(same) < least - q:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins + q >= least
        out += [(b, e - b + q, q) for b, e in zip(begins[long].tolist(), ends[long].tolist()) if _is_smallest(w, b, e - b + q, q)]
    return out


def _selected(h: np.ndarray, t: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Synchronising positions at scale t; h: hashes of the blocks of t words."""
    v = np.minimum(h, _OUT - np.uint64(1))
    for start, length, q in runs:
        if 4 * q <= t <= length:
            v[start : start + length - t + 1] = _OUT
    least = _window_min(v, t + 1)
    return np.flatnonzero((least != _OUT) & ((least == v[: len(least)]) | (least == v[t:])))


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in an array of word numbers, by start, then period."""
    n = len(w)
    if n < LEAST:
        return []
    runs = _small_periods(w)
    h, t = _mix(w.astype(np.uint64)), 1
    while t < SMALL and 2 * t <= n:
        h, t = _doubled(h, t), 2 * t
    while TIMES * t <= n:
        positions = _selected(h, t, runs)
        h = _doubled(h, t)
        context = h[positions]
        order = np.argsort(context, kind="stable")
        equal = np.flatnonzero(context[order][:-1] == context[order][1:])
        if not len(equal):
            break
        first, following = positions[order[equal]], positions[order[equal + 1]]
        apart = following - first
        near = (apart >= t) & (apart < 2 * t)
        first, apart = first[near], apart[near]
        by_place = np.lexsort((first, apart))
        seen: tuple[int, int] = (0, -1)  # period and end of the stretch last looked at
        for i, q in zip(first[by_place].tolist(), apart[by_place].tolist()):
            if q == seen[0] and i < seen[1]:
                continue
            ahead = _agreeing(w[i:], w[i + q :])
            behind = _agreeing(w[:i][::-1], w[: i + q][::-1])
            start, length = i - behind, behind + ahead + q
            seen = (q, i + ahead)
            if length >= max(LEAST, TIMES * q) and _is_smallest(w, start, length, q):
                runs.append((start, length, q))
        t *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what any run repeats after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def analyse(text: str | None) -> tuple[list[tuple[int, int, int]], str, int]:
    """Runs, collapsed text and number of words of a text; words lie between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    runs = runs_of(w) if len(numbers) < len(words) else []
    return runs, collapse(words, runs).decode("utf-8", "surrogatepass"), len(words)


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """`docs` with the periodic runs of `text`, the text less what they repeat, and the number of its words.

    `runs` is an array of (start, length, period) in words from 0, by start, then period.  In `collapsed` the words
    left are joined by one space, whatever was between them.  Null, empty and blank texts have no words, no
    runs and the collapsed text ''.  Each row is judged by itself, so repeated rows get the same; whole texts are read.
    Columns of `docs` with the names of new ones are replaced.
    """

    def judge(texts):
        found = [analyse(t) for t in texts]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))
        rows = [[dict(zip(RUN.names, r)) for r in f[0]] for f in found]
        return [pa.array(rows, kind), [f[1] for f in found], [f[2] for f in found]]

    fields = [T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType()), T.StructField(n_words, T.LongType())]
    return with_columns_from(docs, text, fields, lambda: judge)
