"""Embedding whitening by spectrum slicing.

Vectors become whole numbers, so counts, sums and products over any number of tasks are exact
and the covariance doesn't depend on their order.  Tasks centre on the whole number next to
the mean and sum up products; what reaches the driver is one matrix, whose size follows from the vectors' length.

There, LDL' factorisations of the covariance less a shift count how many eigenvalues lie above
the shift.  Halving the shift's interval by these counts isolates each leading eigenvalue,
Rayleigh quotient iteration then converges to it cubically, and counts on both sides certify
that it is the k-th.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import fresh
from sourceloom.session import written

COMPONENTS = 4
SCALE = 256
EXACT = 1 << 53  # whole numbers of this size are doubles; a vector with an entry from here on counts as not finite
_ALPHA = (1 + math.sqrt(17)) / 8  # the usual bound for a pivot of one row against one of two


# -- inertia and eigenvectors of one symmetric matrix --------------------------------------------------------------


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than `shift`: positive pivots of LDL' of a - shift.

    Pivots are of one or two rows, the largest entries first, which keeps the factors bounded.
    A pivot of two rows has one positive and one negative eigenvalue.
    """
    a = a - shift * np.eye(len(a))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0.0)
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[r] == 0 and off[i, j] == 0:
            break
        if diagonal[r] >= _ALPHA * off[i, j]:
            positive += a[r, r] > 0
            rest = np.delete(np.arange(len(a)), r)
            column = a[rest, r]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[r, r]
        else:
            positive += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_([i, j], [i, j])], columns.T)
            a = (a + a.T) / 2
    return int(positive)


@dataclass
class Pair:
    value: float
    vector: np.ndarray
    certified: bool  # the counts on both sides say that it is the k-th


def _away(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _toward(a: np.ndarray, shift: float, v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """One step of inverse iteration, kept apart from the vectors found before."""
    nudge = 0.0
    while True:
        try:
            v = np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), v)
            return _away(v / np.abs(v).max(), found)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            nudge = 2 * nudge or np.finfo(float).eps * float(np.abs(a).max())


def leading(a: np.ndarray, k: int = COMPONENTS) -> list[Pair]:
    """The eigenpairs of the `k` greatest eigenvalues that are positive beyond rounding, greatest first.

    Of an eigenvalue that occurs several times (to rounding) the vectors are any orthonormal ones.
    """
    d = len(a)
    bound = float(np.abs(a).sum(axis=1).max()) if d else 0.0
    least = 64 * d * np.finfo(float).eps * bound  # what rounding may move an eigenvalue
    pairs: list[Pair] = []
    if bound == 0:
        return pairs
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(a, shift)
        return counts[shift]

    for number in range(1, min(k, d) + 1):
        if count(least) < number:
            break
        low = max((s for s, c in counts.items() if c >= number), default=least)
        high = min((s for s, c in counts.items() if c < number), default=bound * (1 + 1e-12) + least)
        found = [p.vector for p in pairs]
        rng = np.random.default_rng(number)  # a fixed start
        while True:
            while high - low > least and not (count(low) == number and (high > bound or count(high) == number - 1) and high - low < 0.1 * low):
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) >= number else (low, middle)
            v = _away(rng.standard_normal(d), found)
            for _ in range(3):
                v = _toward(a, (low + high) / 2, v, found)
            residual = math.inf
            for _ in range(12):
                rho = float(v @ (a @ v))
                now = float(np.linalg.norm(a @ v - rho * v))
                if now >= residual / 2 and now <= least:
                    break
                residual = now
                v = _toward(a, rho, v, found)
            rho = float(v @ (a @ v))
            if (low - least <= rho <= high + least and now <= least) or high - low <= least:
                break
            middle = (low + high) / 2  # it went to a neighbour: isolate more closely
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        v = v if v[np.abs(v).argmax()] > 0 else -v
        pairs.append(Pair(rho, v, count(rho - 2 * least) >= number and count(rho + 2 * least) < number))
    return pairs


# -- sums over tasks -----------------------------------------------------------------------------------------------


def whole_numbers(vector: str) -> Column:
    """floor(256 c) of every entry, as longs."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: str) -> Column:
    """Whether a vector is there and its entries are too, finite and within exact doubles; 256 times them as well."""
    fit = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float(EXACT // SCALE))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, fit), F.lit(False))


def _rows(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x' x of whole numbers: in doubles where no sum can leave them, else in Python's integers."""
    x = x.astype(np.float64)
    top = float(np.abs(x).max(initial=0.0))
    if top * top * len(x) < EXACT:
        return (x.T @ x).astype(np.int64)
    x = x.astype(np.int64).astype(object)
    return x.T @ x


_SUM = T.DecimalType(38, 0)


def _sums(vectors: DataFrame, name: str, d: int) -> list[int]:
    """Sum of each entry."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", _SUM)])

    def run(batches):
        total = [0] * d
        for batch in batches:
            x = _rows(batch, name, d)
            part = x.sum(axis=0) if float(np.abs(x).max(initial=0)) * len(x) < EXACT else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=schema.names)

    rows = vectors.select(name).mapInArrow(run, schema).groupBy("i").agg(F.sum("s").alias("s")).collect()  # d rows
    found = {r["i"]: int(r["s"]) for r in rows}
    return [found.get(i, 0) for i in range(d)]


def covariance(vectors: DataFrame, name: str, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance, divisor n, of distinct vectors of whole numbers; each entry is the exact one rounded once.

    Tasks subtract the whole number next to the mean before they multiply; what that misses of the
    mean is put right in exact arithmetic.
    """
    centre = [(2 * s + n) // (2 * n) for s in sums]
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", _SUM)])

    def run(batches):
        total = None
        for batch in batches:
            part = _products(_rows(batch, name, d) - np.array(centre, np.int64))
            total = part if total is None else total.astype(object) + part
        if total is None:
            return
        i, j = np.triu_indices(d)
        values = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=schema.names)

    rows = vectors.select(name).mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # d (d + 1) / 2 rows
    rest = [s - n * c for s, c in zip(sums, centre)]
    out = np.zeros((d, d))
    for r in rows:
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = Fraction(n * int(r["s"]) - rest[i] * rest[j], n * n)
    return out


def _projector(n: int, sums: list[int], pairs: list[Pair]):
    """Function from whole-number vectors to their whitened values."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    axes = np.stack([p.vector / math.sqrt(p.value) for p in pairs], axis=1)
    return lambda x: ((x - whole) - part) @ axes


def identity_error(vectors: DataFrame, name: str, d: int, n: int, project, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, summed up over all of them."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())])

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = project(_rows(batch, name, d))
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())], names=schema.names)

    parts = vectors.select(name).mapInArrow(run, schema).groupBy("i", "j").agg(F.array_sort(F.collect_list("s")).alias("s"))
    rows = parts.select("i", "j", F.aggregate("s", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()  # (k + 1) ** 2 rows, added in order of size
    total = np.zeros((k + 1, k + 1))
    for r in rows:
        total[r["i"], r["j"]] = r["s"] / n
    mean = total[k, :k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every usable row and leading component.

    Left out are vectors that are null, hold null or non-finite entries (or ones beyond 2 ** 45), are
    empty, or have another length than most (of lengths equally frequent the greater one counts).  Of vectors that repeat after
    flooring one enters the fit; all their rows are returned.  Components whose variance is zero to rounding
    are left out, so vectors that are all equal, and empty tables, give no row.  `deviation` is exact and null
    where it is no long.  Ids may repeat or be null; other columns are not looked at.
    """
    schema = "id " + df.schema[vec_id].dataType.simpleString() + ", component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable_rows = df.filter(usable(vector)).select(F.col(vec_id).alias("id"), whole_numbers(vector).alias("x"))
    lengths = usable_rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).filter("d > 0")
    most = lengths.agg(F.max(F.struct("rows", "d")).alias("m")).first()["m"]
    nothing = df.sparkSession.createDataFrame([], schema)
    if most is None:
        return nothing
    d = most["d"]
    usable_rows = usable_rows.filter(F.size("x") == d)
    fit = written(usable_rows.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    sums = _sums(fit, "x", d)
    v = covariance(fit, "x", d, n, sums)
    pairs = leading(v, components)
    if not pairs:
        return nothing
    k = len(pairs)
    project = _projector(n, sums, pairs)
    error = identity_error(fit, "x", d, n, project, k)
    trace = math.fsum(np.diagonal(v))
    explained = np.array([p.value / trace for p in pairs])
    total = np.array(sums, dtype=object)
    top = max(abs(s) for s in sums)

    def deviations(x: np.ndarray) -> list:
        if (float(np.abs(x).max(initial=0)) * n + top) ** 2 * d < 2.0**62:
            y = x * n - total.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * n - total
        return [s if s < 1 << 63 else None for s in (y * y).sum(axis=1).tolist()]

    def run(batches):
        for batch in batches:
            x = _rows(batch, "x", d)
            m = len(x)
            places = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("id").take(places), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(x), pa.int64()).take(places), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable_rows.mapInArrow(run, schema)
