"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's own features and those of the lines before and behind
it speak for one label, and transitions between labels are weighed as well.  The
probability that a line is good, given the whole document, comes from a forward and a backward
pass; the mean over lines, weighted by their length, is the document's quality.

It learns from documents marked as a whole: all lines of a document have its mark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import with_columns_from

SAMPLE = 6000  # marked documents it learns from at most, those with the smallest hashes of their ids
SAMPLE_LINES = 120  # consecutive lines of each of them at most; only learning is bounded, whole texts are scored
STEPS, RATE, L2 = 300, 0.1, 1e-5

_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".,;:'\"-()"
_LOUD = b"!?"
_SPACE = b" \t\r\x0b\x0c"
_KNOWN = _LOWER + _UPPER + _DIGITS + _STOPS + _LOUD + _SPACE
N_FEATURES = 15


def features(line: bytes, repeated: bool) -> list[float]:
    """Numbers from 0 to about 1 that describe one line."""
    words = line.split()
    n, k = len(line), len(words)
    if not k:
        return [0.0] * N_FEATURES
    size = n - len(line.translate(None, _KNOWN))
    symbols = n - size
    upper, digits = n - len(line.translate(None, _UPPER)), n - len(line.translate(None, _DIGITS))
    lower = n - len(line.translate(None, _LOWER))
    loud = n - len(line.translate(None, _LOUD))
    distinct = len(set(words))
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    letters = upper + lower or 1
    return [
        1.0, min(1.0, math.log1p(n) / 8), min(1.0, math.log1p(k) / 6), min(1.0, n / k / 20), upper / letters,
        min(1.0, 5 * digits / n), min(1.0, 5 * symbols / n), float(symbols > 0), min(1.0, 10 * loud / n), distinct / k,
        min(1.0, 3 * doubled / k), min(1.0, 2 * (k - distinct) / k), float(line.rstrip()[-1:] in (b".", b"!", b"?")),
        float(upper > lower), float(repeated),
    ]


def lines_of(text: str | None) -> list[bytes]:
    """Lines with something in them; one empty line where there are none."""
    return [x for x in (text or "").encode("utf-8", "replace").split(b"\n") if x.strip()] or [b""]


def matrix(lines: list[bytes]) -> np.ndarray:
    """A row per line: its features, those of the line before and of the one behind (zeros at the ends), and 1."""
    seen: set[bytes] = set()
    own = []
    for x in lines:
        own.append(features(x, x in seen))
        seen.add(x)
    own = np.array(own, np.float64)
    out = np.zeros((len(lines), 3 * N_FEATURES + 1))
    out[:, :N_FEATURES] = own
    out[1:, N_FEATURES : 2 * N_FEATURES] = own[:-1]
    out[:-1, 2 * N_FEATURES : -1] = own[1:]
    out[:, -1] = 1
    return out


@dataclass
class Model:
    """weights: of a line's features for good against bad; edges[a][b]: of label b after a (0 bad, 1 good)."""

    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, x: np.ndarray) -> list[float]:
        """The probability of each line to be good, by a forward and a backward pass over log odds."""
        odds = np.clip(x @ self.weights, -30, 30).tolist()
        (e00, e01), (e10, e11) = np.exp(self.edges).tolist()
        n = len(odds)
        forward = [0.0] * n
        f = forward[0] = odds[0]
        for t in range(1, n):
            p = math.exp(f)
            f = forward[t] = max(-60.0, min(60.0, odds[t] + math.log((p * e11 + e01) / (p * e10 + e00))))
        out, b = [0.0] * n, 0.0
        for t in range(n - 1, -1, -1):
            out[t] = 1 / (1 + math.exp(-max(-60.0, min(60.0, forward[t] + b))))
            p = math.exp(max(-60.0, min(60.0, odds[t] + b)))
            b = math.log((p * e11 + e10) / (p * e01 + e00))
        return out

    def quality(self, text: str | None) -> float:
        lines = lines_of(text)
        total = good = 0.0
        for p, x in zip(self.marginals(matrix(lines)), lines):
            total += len(x) + 1
            good += p * (len(x) + 1)
        return min(1.0, max(0.0, good / total))


def train(documents: list[np.ndarray], marks: list[int], steps: int = STEPS) -> Model:
    """Maximum likelihood of the marks with a small penalty, by Adam over all documents at once."""
    d = 3 * N_FEATURES + 1
    w, edges = np.zeros(d), np.zeros((2, 2))
    if len(set(marks)) < 2:
        w[-1] = 0.0 if not marks else (3.0 if marks[0] else -3.0)
        return Model(w, edges)
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    lengths = np.array([len(documents[i]) for i in order])
    y = np.array([marks[i] for i in order])
    active = [int((lengths > t).sum()) for t in range(lengths[0])]
    at_t = [np.stack([documents[i][t] for i in order[: active[t]]]) for t in range(lengths[0])]
    n_lines = lengths.sum()
    moments = [np.zeros(d), np.zeros(d), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        node = [np.stack([np.zeros(len(x)), x @ w], axis=1) for x in at_t]
        alpha, scale = [node[0]], None
        for t in range(1, len(node)):
            a = alpha[-1][: active[t]]
            alpha.append(node[t] + np.logaddexp(a[:, :1] + edges[0], a[:, 1:] + edges[1]))
        beta = np.zeros((active[-1], 2))
        log_z = np.empty(len(order))
        for t in range(len(node)):
            ending = slice(active[t + 1] if t + 1 < len(node) else 0, active[t])
            log_z[ending] = np.logaddexp(alpha[t][ending, 0], alpha[t][ending, 1])
        g_w, g_e = -L2 * w * n_lines, -L2 * edges * n_lines
        for t in range(len(node) - 1, -1, -1):
            m = active[t]
            if len(beta) < m:
                beta = np.vstack([beta, np.zeros((m - len(beta), 2))])
            good = np.exp(alpha[t][:, 1] + beta[:, 1] - log_z[:m])
            g_w += (y[:m] - good) @ at_t[t]
            if t:
                inner = node[t] + beta
                a = alpha[t - 1][:m]
                pair = np.exp(a[:, :, None] + edges[None] + inner[:, None, :] - log_z[:m, None, None]).sum(axis=0)
                g_e[1, 1] += y[:m].sum()
                g_e[0, 0] += m - y[:m].sum()
                g_e -= pair
                beta = np.logaddexp(edges[:, 0] + inner[:, :1], edges[:, 1] + inner[:, 1:])
        for k, (value, g) in enumerate(((w, g_w / n_lines), (edges, g_e / n_lines))):
            m1, m2 = moments[2 * k], moments[2 * k + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            value += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(w, edges)


def fit(docs: DataFrame, marks: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", mark: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model:
    """A model from documents that `marks` (id, mark 0 or 1) knows and `allowed` (on the marks' rows) admits.

    It sees at most `sample` documents and `sample_lines` lines of each, a stretch at a place that
    follows from the id; with the two as given that is at most 132 MB on the driver.  Ids that are null, marked
    differently or not with 0 or 1 teach nothing.  Of rows with the same id the one with the least text teaches.
    """
    known = marks.filter(allowed & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(mark).alias("_low"), F.max(mark).alias("_high"))
    known = known.filter("_low = _high and _low in (0, 1)").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")  # bounded by `sample`
    rows = rows.groupBy("_id", "_low").agg(F.min("_text").alias("_text"))
    schema = T.StructType([T.StructField("mark", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("x", T.BinaryType())])

    def run(batches):
        for batch in batches:
            out = []
            for t, place in zip(batch.column("_text").to_pylist(), batch.column("place").to_pylist()):
                lines = lines_of(t)
                start = place % max(1, len(lines) - sample_lines + 1)
                out.append(matrix(lines[start : start + sample_lines]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("place"), pa.array(out, pa.binary())], names=schema.names)

    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    found = rows.select("_text", F.col("_low").cast("int").alias("mark"), place.alias("place")).mapInArrow(run, schema).collect()
    found.sort(key=lambda r: (r["place"], bytes(r["x"])))  # the same sums whatever the order of tasks
    documents = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, 3 * N_FEATURES + 1).astype(np.float64) for r in found]
    return train(documents, [r["mark"] for r in found])


def with_quality(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the quality of `text` from 0 to 1.

    Null, empty and blank texts are judged as one empty line.  Whole texts are read; each
    row is judged by itself.  A column `name` of `docs` is replaced.
    """
    return with_columns_from(docs, text, [T.StructField(name, T.DoubleType())], lambda: lambda texts: [[model.quality(t) for t in texts]])
