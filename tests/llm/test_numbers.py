"""Whitening, periodic runs and mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import mixing, periodic, queries, whitening

# -- whitening -------------------------------------------------------------------------------------------------


def spectrum(d, values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    a = (q * np.asarray(values, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "a, k",
    [
        (spectrum(64, np.linspace(1, 9, 64)), 4),
        (spectrum(20, [5, 5, 5, 2] + [1] * 16), 4),  # one eigenvalue three times
        (spectrum(16, 1 + np.arange(16) * 1e-9), 4),  # close together
        (spectrum(8, [1000, 1e-3] + [0] * 6), 2),  # no more than two
        (np.array([[2.5]]), 1),
        (np.zeros((3, 3)), 0),
        (np.array([[0.0, 1], [1, 0]]), 1),  # a pivot of two rows
    ],
)
def test_leading_eigenpairs(a, k):
    pairs = whitening.leading(a)
    want = np.linalg.eigvalsh(a)[::-1]
    assert len(pairs) == k
    for i, p in enumerate(pairs):
        assert p.certified and abs(p.value - want[i]) <= 1e-12 * want[0]
        assert np.linalg.norm(a @ p.vector - p.value * p.vector) <= 1e-12 * want[0]
    if pairs:
        v = np.stack([p.vector for p in pairs])
        assert np.abs(v @ v.T - np.eye(k)).max() < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(3)
    for d in (2, 5, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for s in rng.uniform(values[0] - 1, values[-1] + 1, 20):
            assert whitening.above(a, s) == (values > s).sum()


def plain_whitening(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    out = {}
    for i, row in x.items():
        y = [n * c - s for c, s in zip(row, sums)]
        for k in range(1, min(4, len(e)) + 1):
            out[i, k] = (n, sum(c * c for c in y), float(np.array(y) / n @ v[:, -k] / math.sqrt(e[-k])), e[-k] / np.trace(cov))
    return out


def test_whitening(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + k % 5) for k in range(9)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(30)]
    bad = [(2000, None), (2001, [None] + [0.0] * 8), (2002, [math.nan] * 9), (2003, [math.inf] * 9), (2004, []), (2005, [1.0]), (2006, [1e30] * 9)]
    df = spark.createDataFrame([(i, v, "x", i) for i, v in rows + bad], "vec_id long, embedding array<float>, n string, x long").repartition(5)
    got = whitening.whiten(df).collect()
    want = plain_whitening(rows)
    assert sorted((r["id"], r["component"]) for r in got) == sorted(want)
    signs = {}
    for r in got:
        n, deviation, value, explained = want[r["id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - abs(value)) < 1e-9 and abs(r["explained"] / explained - 1) < 1e-9 and r["identity_error"] < 1e-9
        if abs(value) > 1e-3:
            signs.setdefault(r["component"], set()).add(r["whitened"] * value > 0)
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_whitening_without_spread(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_whitening_of_large_numbers(spark):
    """Deviations beyond a long are null; one direction has all the spread."""
    rows = [(None, [2.0**40, 1.0]), (None, [-(2.0**40), 1.0]), (3, [0.5, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1}
    assert sorted(repr(r["deviation"]) for r in got)[1:] == ["None", "None"] and got[0]["identity_error"] < 1e-9


# -- periodic runs ---------------------------------------------------------------------------------------------


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n < 8:
            break
        a, p = rng.randrange(n), rng.choice([1, 2, 3, 4, 7, 8, 9, 12, 15, 16, 17, 24, 31, 32, 33, 50])
        for i in range(a + p, min(n, a + rng.randrange(2, 9) * p + rng.randrange(p + 1))):
            w[i] = w[i - p]
    return w


def test_runs_of_random_words():
    rng, found = random.Random(1), 0
    for _ in range(1200):
        w = planted(rng, rng.choice([0, 1, 5, 6, 7, 20, 60, 200, 400]), rng.choice([2, 3, 5, 50]))
        want = plain_runs(w)
        found += len(want)
        assert periodic.runs_of(np.array(w, np.int64)) == want
    assert found > 300


def test_runs_inside_runs():
    """Long periods whose period holds runs of small ones, which take no part in the selection of positions."""
    for seed in range(60):
        rng = random.Random(seed)
        q = rng.choice([40, 64, 65, 100, 127, 300])
        block = ([rng.randrange(2)] * rng.randrange(8, 60) + [1, 2] * rng.randrange(20) + [rng.randrange(3) for _ in range(q)])[:q]
        w = [9] * 3 + block * rng.randrange(4, 7) + block[: rng.randrange(q)] + [8]
        assert periodic.runs_of(np.array(w, np.int64)) == plain_runs(w)


def plain_periods(doc_id, text):
    """What the query returns for a document, from the contract's words."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rest = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), rest)


def test_periods_of_documents(spark, docs, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "a", "a " * 6, "a " * 5, "x y " * 4, "\x1cq \x1cq\x0b\x0c\x1cq \x1cq \x1cq \x1cq", "ä   ä " * 9]
    texts += [" ".join(f"w{c}" for c in planted(rng, rng.choice([3, 30, 90, 300]), rng.choice([2, 9, 80]))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(3, texts[-1]), (3, texts[-1])]
    docs(rows).withColumnRenamed("key1", "runs").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periods(spark, str(tmp_path)).collect()
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(repr((r["doc_id"], *(r[c] for c in columns))) for r in got) == sorted(repr((i, *plain_periods(i, t))) for i, t in rows)


def test_runs_of_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "b " * 8), (None, "b " * 8)], "doc_id long, text string")
    got = periodic.with_runs(df).collect()
    assert [(list(map(tuple, r["runs"])), r["collapsed"], r["n_words"]) for r in got] == [([(0, 8, 1)], "b", 8)] * 2
    assert periodic.with_runs(df.limit(0)).collect() == []
    assert queries.with_periods(df).count() == 2


# -- mixing ----------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Excess over the cap is dealt again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, Fraction(0)), set(names), share * sum(sizes.values())
    while free and left > 0:
        unit = left / sum(weight[s] for s in free)
        left = Fraction(0)
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                free.discard(s)
    return target


def test_targets(spark):
    rng = random.Random(2)
    for sizes in [{}, {None: 5}, {"": 0, None: 0}, {"a": 10, "B": 1000, "é": 3, "z": 50, None: 7}, {f"s{k}": int(10 ** rng.uniform(0, 5)) for k in range(40)}]:
        df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "none boolean, source string, source_size long")
        got = {None if r["none"] else r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - float(want[s])) <= 1e-9 * max(1, float(want[s])) for s in want)


def test_mix(spark):
    """Copies near the targets, with a source that has most rows, a null one and one without words; reruns agree."""
    rng = random.Random(4)
    source = lambda i: "hot" if i % 3 else rng.choice(["a", "b", None, "none"])
    rows = [(i, source(i), rng.choice([0, 1, 3, 40, 200, 200, 900])) for i in range(9000)]
    rows = [(i, s, 0 if s == "none" else n) for i, s, n in rows] + [(None, "a", None), (7, "b", 11), (7, "b", 11)]
    df = spark.createDataFrame([(i, s, n, "w", 1) for i, s, n in rows], "doc_id long, source string, size long, whole string, draw int")
    got = mixing.mix(df, prefer=mixing.longer_first("size"))
    assert got.columns == [*df.columns, "source_size", "target", "copies"]
    got = got.collect()
    assert sorted(map(repr, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(map(repr, rows))
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + (r["size"] or 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * (r["size"] or 0)
        assert 0 <= r["copies"] <= 2 and (r["size"] or r["copies"] == 0)
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6
    assert all(taken[s] <= want[s] + Fraction(1, 10**6) and want[s] - taken[s] <= 5 for s in want)
    again = mixing.mix(df.repartition(7), prefer=mixing.longer_first("size")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    longest = [r["copies"] for r in got if r["source"] == "hot" and r["size"] == 900]
    shortest = [r["copies"] for r in got if r["source"] == "hot" and r["size"] == 1]
    assert sum(longest) / len(longest) > 2 * sum(shortest) / len(shortest)


def test_inclusion_follows_the_preference(spark):
    """One source, target half its words: equal sizes with preferences 1 and 3 come out about 1 to 3."""
    df = spark.createDataFrame([(i, "s", 10) for i in range(6000)], "doc_id long, source string, size long")
    got = mixing.mix(df, prefer=F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1), share=0.5).collect()
    even, odd = (sum(r["copies"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1))
    assert even + odd == 3000 and abs(even - 2250) < 120


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(df).collect() == []


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n",), ("a b\tc\x0bd\x0ce\rf",), ("\x1ca b",)], "text string")
    assert [r[0] for r in df.select(mixing.word_count()).collect()] == [0, 0, 0, 6, 1]
