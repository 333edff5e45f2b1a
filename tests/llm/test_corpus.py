"""Operators that look at all rows together, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from sourceloom.llm import lattice, lines, pivots, postings, simhash, spans
from sourceloom.llm.common import components, row_key


def merge_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(i, i // 2) for i in range(1, 80)] + [(1000, 1001), (5, 5)]])
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs, "a long, b long")
    want = merge_find({n for p in pairs for n in p}, pairs)
    got = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert got == {n: r for n, r in want.items() if n != r}


# -- lines -----------------------------------------------------------------------------------------------------


def plain_line_dedup(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if text is None:
            out[i] = (None, 0)
            continue
        parts, gone = text.split("\n"), set()
        for k in range(len(parts) - 2):
            window = tuple(parts[k : k + 3])
            if any(x.strip(" ") for x in window):
                gone |= {k, k + 1, k + 2} if window in seen else set()
                seen.add(window)
        out[i] = ("\n".join(p for k, p in enumerate(parts) if k not in gone), len(gone))
    return out


def test_lines_against_plain(docs):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abc ") * rng.randint(1, 2) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "a\na\na\na\na\na"), (1003, "\n\n\n\n\n"), (None, "q\nr\ns\nt"), (1005, "q\nr\ns\n\nz"), (1006, "\n".join(f"l{k % 700}" for k in range(4000)))]
    got = lines.dedup_lines(docs(rows))
    assert {"lang", "_k1", "key1"} <= set(got.columns)
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == plain_line_dedup(rows)
    assert lines.dedup_lines(docs([])).count() == 0


def test_rows_that_repeat_keep_the_same_lines(docs):
    got = lines.dedup_lines(docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


# -- spans -----------------------------------------------------------------------------------------------------


def test_spans_take_out_later_passages_only(docs):
    word = lambda k: "".join(random.Random(k).choice("abcdefghij") for _ in range(7))
    sentence = lambda k: " ".join(word(100 * k + j) for j in range(8)) + "."
    passage = " ".join(sentence(k) for k in range(7))
    long = " ".join(word(90_000 + k) for k in range(60))
    own = {i: sentence(1000 + i) for i in range(6)}
    rows = [(5, f"{own[5]} {passage} {sentence(77)}"), (2, f"{own[2]}\n{passage}\n{sentence(78)}"), (9, f"{passage}"), (3, f"{own[3]} Short. Short. Yes."), (4, f"{own[4]} Short. Short. Yes."), (7, None), (8, ""), (None, f"{own[0]} {passage}")]
    rows += [(20, f"{own[1]}\n{long}\n{own[1]}"), (21, f"{sentence(2000)}\n{long}")]
    got = {r["doc_id"]: r for r in spans.dedup_spans(docs(rows)).collect()}
    text = dict(rows)
    assert got[2]["text"] == text[2] and got[3]["text"] == text[3] and got[4]["text"] == text[4]
    assert got[5]["text"] == f"{own[5]} {sentence(77)}" and got[5]["n_removed_words"] == 56
    assert got[9]["text"] == "" and got[None]["text"] == f"{own[0]} "
    assert got[7]["text"] is None and got[8]["text"] == ""
    assert got[20]["text"] == text[20] and got[21]["text"] == f"{sentence(2000)}\n"
    assert spans.dedup_spans(docs([])).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_that_repeat_keep_the_same_passages(docs, parts):
    """In one task and in several: the first occurrence stays in all rows that repeat it, later ones go from all."""
    passage = " ".join(" ".join(f"w{k}x{j}" for j in range(8)) + "." for k in range(5))
    rows = [(7, f"Mine. {passage}"), (7, f"Mine. {passage}"), (1, passage), (1, passage), (1, passage), (None, passage), (None, passage)]
    got = spans.dedup_spans(docs(rows).repartition(parts, "_k1")).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed_words"]) for r in got) == sorted([("1", passage, 0)] * 3 + [("7", "Mine. ", 40)] * 2 + [("None", "", 40)] * 2)


def test_span_runs_are_the_shortest_and_alike_wherever_they_lie():
    passage = " ".join(f"w{k}{'.' if k % 5 == 4 else ''}" for k in range(60))
    inside = {(a, b) for _, _, a, b in spans.runs(passage)}
    around = {(a, b) for _, _, a, b in spans.runs(f"Other words here. {passage} And. More of them here.")}
    assert inside and inside <= around
    for begin, end, words in spans.sentences(passage):
        assert passage[begin:end].split() == words


def test_long_sentences_are_cut_alike_wherever_they_begin():
    """A passage without stops behind any number of words: but for its edges it is in runs of both."""
    for seed in range(20):
        rng = random.Random(seed)
        passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(90))
        known = {x[2:] for x in spans.runs(passage)}
        for before in (1, 5, 7, 17):
            text = " ".join([*(f"o{rng.randint(0, 999)}" for _ in range(before)), passage])
            covered = [x[:2] for x in spans.runs(text) if x[2:] in known]
            assert covered and len(text[min(covered)[0] : covered[-1][1]].split()) >= 45
            assert text.endswith(text[min(covered)[0] : covered[-1][1]])


def test_sentences_end_before_quotes_and_with_stops_of_other_scripts():
    for stop in ('."', ".)", "?»", "!”", "。", "？", "؟", "।", "…", ".’)"):
        text = f"one two three{stop} four five"
        assert [text[a:b] for a, b, _ in spans.sentences(text)] == [f"one two three{stop} ", "four five"]
    same = "der " * 500
    assert max(len(w) for _, _, w in spans.sentences(same)) <= spans.MOST_PART


def test_spans_hash_a_word_once(monkeypatch):
    """However often it stands in the texts; sentences are those of the plain way, word by word."""
    hashed = []
    real = spans.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(spans.xxhash, "xxh3_64_intdigest", lambda w: hashed.append(w) or real(w))
    rng = random.Random(4)
    words = [f"once{i}" for i in range(9)] + ["end.", "(end?)", '"']
    for _ in range(200):
        text = rng.choice(("", "\n ")) + "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", " \n", "\n\n", "\x1c")) for _ in range(rng.randint(0, 90)))
        want, begin, held, since = [], 0, [], []
        found = list(spans._WORD.finditer(text))
        for m, after in zip(found, [*found[1:], None]):
            end = after.start() if after else len(text)
            held.append(m[0])
            since.append(real(m[0].encode()))
            ended = m[0].rstrip(spans._CLOSING).endswith(spans._STOPS) or "\n" in text[m.end() : end]
            cut = len(held) >= spans.LEAST_PART and len(since) >= spans.NEARBY and since[-1] == min(since[-spans.NEARBY :])
            if ended or cut or len(held) == spans.MOST_PART or after is None:
                want.append((begin, end, held))
                begin, held, since = end, [], [] if ended else since
        assert spans.sentences(text) == want
    assert len(hashed) == len(set(hashed))


def plain_span_dedup(rows):
    """What stays of each text if every run of several sentences, of any length, is compared and the first one kept."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        units = spans.sentences(text)
        gone = set()
        for a in range(len(units)):
            for b in range(a + 2, len(units) + 1):
                content = tuple(tuple(w) for _, _, w in units[a:b])
                if sum(map(len, content)) >= 25:
                    gone |= set(range(a, b)) if content in seen else set()
                    seen.add(content)
        out[i] = ("".join(text[a:b] for k, (a, b, _) in enumerate(units) if k not in gone), sum(len(units[k][2]) for k in gone))
    return out


def test_spans_against_all_runs(docs):
    """Passages, whole copies and repeats within a text, with sentences of 1 to 11 words and one long one, tails of short ones among them."""
    rng = random.Random(11)
    sentence = lambda most: " ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(rng.randint(1, most))) + rng.choice(".!?")
    some = [" ".join(sentence(rng.choice((3, 11, 40))) for _ in range(rng.randint(3, 14))) + " Yours. Truly." for _ in range(6)]
    rows = [(k, rng.choice(" \n").join(sentence(11) if rng.random() < 0.6 else rng.choice(some) for _ in range(rng.randint(0, 7)))) for k in range(50)]
    rows += [(100 + k, t) for k, (_, t) in enumerate(rows[:10])] + [(None, some[0])]
    want = plain_span_dedup(rows)
    assert sum(w[1] for w in want.values()) > 1000
    assert {r["doc_id"]: (r["text"], r["n_removed_words"]) for r in spans.dedup_spans(docs(rows)).collect()} == want


# -- near copies -------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_connect_all_within_the_distance(spark):
    """Dense balls (more under one key than HOT_KEY), pairs at distances 4 and 5, and strangers."""
    rng = np.random.default_rng(7)
    every = set(rng.integers(0, 1 << 63, 300, np.uint64).tolist())
    for centre in (0, 0x0123456789ABCDEF, int(rng.integers(0, 1 << 63))):
        every |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (250, 2))}
    for x in list(every)[:200]:
        for n in (4, 5):
            every.add(x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = sorted(every)
    arr = np.array(fps, np.uint64)
    pairs = [(fps[i], fps[int(j)]) for i in range(len(fps)) for j in np.nonzero(np.bitwise_count(arr ^ arr[i]) <= 4)[0] if j > i]
    want = merge_find(fps, pairs)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    got = merge_find(fps, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found])
    assert got == want


def test_near_documents(docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(300)] for _ in range(12)]
    rows = [(10 * k, " ".join(w)) for k, w in enumerate(base)]
    rows += [(10 * k + 1, " ".join([*w[:150], "changed", *w[151:]])) for k, w in enumerate(base)] + [(10 * k + 2, " ".join(w).upper()) for k, w in enumerate(base)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1003, "one two"), (None, "one two"), (1004, "x " * 70_000)]
    found = simhash.near_duplicates(docs(rows)).collect()
    assert len(found) == len(rows)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    nodes = {f for _, f in prints}
    root = merge_find(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = Counter((i, f, least[root[f]]) for i, f in prints)
    assert Counter((r["id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in found) == want
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least.values()))
    assert simhash.keep_one(docs([])).count() == 0


def test_equal_ids_with_unrelated_texts_are_all_kept(docs):
    """A component is named by its fingerprint, since ids may repeat."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(3))
    kept = simhash.keep_one(docs([(1, a), (1, b), (2, c), (2, a), (None, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b), (2, c)])


def plain_shingles(text, size=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def test_similar_texts_against_all_pairs(docs, monkeypatch):
    """Edited copies around the threshold, a long pair, a group larger than a block, and texts short or without words."""
    monkeypatch.setattr(simhash, "SIMILAR_BLOCK", 8)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([20, 60, 200]))]
        texts.append(base)
        for edits in (1, 2, 3, 4):
            texts.append([w if rng.random() > edits / len(base) else "new" for w in base])
    group = [word() for _ in range(150)]
    texts += [[*group[:n], "x", *group[n + 1 :]] for n in range(0, 150, 3)]
    long = [word() for _ in range(9000)]
    texts += [long, [*long[:8500], *(word() for _ in range(500))], [word() for _ in range(4)], ["one", "two"], ["ONE", "two"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, " \n"), (3, " ".join(texts[3])), (None, "one two")]
    found = simhash.near_duplicates(docs(rows), similarity=0.8).collect()
    assert len(found) == len(rows)
    root = {(r["id"], r["fingerprint"]): r["root"] for r in found}
    at = [root[(i, f - (1 << 64) if f >> 63 else f)] for i, f in ((i, plain_fingerprint(t)) for i, t in rows)]
    sets = [plain_shingles(t) for _, t in rows]
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if share(a, b) >= 0.8]
    hit = sum(at[a] == at[b] for a, b in pairs)
    assert len(pairs) > 1200 and hit >= 0.98 * len(pairs)
    # Nothing but such pairs, and those within few bits, is connected.
    prints = [plain_fingerprint(t) for _, t in rows]
    allowed = merge_find(range(len(rows)), pairs + [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert all(allowed[a] == allowed[b] for a in range(len(rows)) for b in range(a) if at[a] == at[b])
    kept = simhash.keep_one(docs(rows), similarity=0.8).collect()
    assert len(kept) == len(set(at)) and simhash.keep_one(docs([]), similarity=0.8).count() == 0


def test_row_keys_tell_nulls_apart(spark):
    rows = [("x", None), (None, "x"), (None, None), ("", None), (None, ""), ("x", ""), ("", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    keys = df.select(*row_key()).collect()
    assert len({k[0] for k in keys}) == len({k[1] for k in keys}) == len(rows)
    text = "a\nb\nc"
    df = spark.createDataFrame([(None, text), (text, None), ("z", text)], "doc_id string, text string")
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in lines.dedup_lines(df).collect()}
    assert got == {(None, ""): 3, (text, None): 0, ("z", text): 0}


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, centres = [], rng.normal(size=(40, 16))
    for k, c in enumerate(centres):
        rows += [(len(rows) + j, (c + rng.normal(size=16) * s).tolist(), k % 3) for j, s in enumerate((0, 0.05, 0.1, 0.2, 0.3))]
    n = len(rows)
    hot = centres[0]
    rows += [(n + k, (hot + rng.normal(size=16) * 0.02).tolist(), 0) for k in range(150)] + [(n + 150 + k, hot.tolist(), 0) for k in range(40)]
    n = len(rows)
    odd = [(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([float("inf")] + [1.0] * 15, 1), (hot.tolist(), None), ([None] + [1.0] * 15, 1), (hot.tolist()[:8], 0), ((hot * 1e200).tolist(), 0)]
    rows += [(n + k, v, label) for k, (v, label) in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = {i: np.array(v) / np.max(np.abs(v)) for i, v, label in rows if usable(v, label)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {i: x for i, _, x in rows}
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root, links = merge_find([r[0] for r in rows], pairs), Counter(x for p in pairs for x in p)
    got = pivots.near_vectors(df).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(i, links[i], root[i], root[i] == i) for i, _, _ in rows}
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_pivot_index_recall_at_the_threshold():
    """Pairs at exactly the threshold, the hardest to find: at least 0.9 of them share enough pivots."""
    rng = np.random.default_rng(10)
    p = pivots.choose_pivots(rng.normal(size=(pivots.SAMPLE, 64)), pivots.LEAST_PIVOTS)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = pivots.COSINE * a + math.sqrt(1 - pivots.COSINE**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    near = [pivots.nearest(x, p, pivots.NEAREST) for x in (a, b)]
    shared = [len(set(x) & set(y)) >= pivots.SHARED for x, y in zip(*near)]
    assert np.mean(shared) >= 0.9


# -- likelihood ----------------------------------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_lattice_sums_over_all_cuts():
    pieces, weights = ["▁a", "a", "b", "ab", "▁ab", "ba", "▁"], np.log(np.full(7 + 256, 1 / (7 + 256)))
    tree = lattice.Lattice(pieces)

    def cuts(rest):
        if not rest:
            return [()]
        out = [(p, *c) for p in pieces if rest.startswith(p) for c in cuts(rest[len(p) :])]
        if rest[0] not in "ab▁":
            out += [(*rest[0].encode(), *c) for c in cuts(rest[1:])]
        return out

    for word in ["▁", "▁abab", "▁aébba", "▁" + "ab" * 6]:
        want = math.log(sum(math.prod(1 / 263 for _ in c) for c in cuts(word)))
        assert math.isclose(tree.log_likelihood(word, weights.tolist()), want)
        total, plain, logs = sum((1 / 263) ** len(c) for c in cuts(word)), [0.0] * 263, [0.0] * 263
        tree.expect(word, weights.tolist(), np.exp(weights).tolist(), plain)
        tree._expect_in_logarithms(word, weights.tolist(), logs)
        times = Counter()
        for c in cuts(word):
            for x in c:
                times[pieces.index(x) if isinstance(x, str) else 7 + x] += (1 / 263) ** len(c) / total
        for k in range(263):
            assert math.isclose(plain[k], times[k], abs_tol=1e-12) and math.isclose(logs[k], times[k], abs_tol=1e-9)


def test_scores_of_documents(docs):
    rng = random.Random(11)
    vocabulary = ["the", "tree", "house", "green", "walks", "Often", "über"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 5000), (503, "the tree\tTREE\nnever 😀"), (503, "the tree\tTREE\nnever 😀"), (None, "the")]
    train = lattice.training_fold("doc_id", 7, 2)
    got = lattice.score_documents(docs(rows), PIECES, train).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = Counter((i, held(i), len(tokens(t)) + 1, sum(w in counts for w in tokens(t)) + 1, n) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)) + math.log10((ends + 1) / (n + v + 1)) for i, t in rows}
    assert all(math.isclose(r["base_score"], base[r["doc_id"]], rel_tol=1e-9) and r["score"] < 0 for r in got)
    assert lattice.score_documents(docs([]), PIECES, train).count() == 0


def test_probabilities_of_words_sum_to_at_most_one(spark):
    """Over all words of a tiny alphabet, up to a length, with the whole-word arcs."""
    pieces, weights = ["▁a", "▁b", "a", "b", "ab"], np.log(np.full(5 + 256, 1 / 261))
    words = [w for n in range(1, 7) for w in (bytes(97 + (k >> j & 1) for j in range(n)) for k in range(1 << n))]
    counts = {b"ab": 5, b"ba": 2, b"a": 1}
    df = spark.createDataFrame([(w, counts.get(w, 0)) for w in words], "word binary, c long")
    tokens, discount = 8 + 2, 0.5
    got = lattice.score_words(df, pieces, weights, tokens, discount, discount * 4 / tokens).collect()
    total = sum(10 ** r["log10_p"] for r in got)
    assert 0.5 < total <= 1 - (2 - discount) / tokens + 1e-9


# -- decontamination -------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if item is None else str(item))
    sizes, out = {len(w) for w in windows}, []
    for i, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_contamination_against_plain(spark, docs):
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "a", "of", "Éa", "x1", "tree", "w" + str(rng.randint(0, 60))])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 12, 13, 14, 30])))) for k in range(25)]
    items += [(100, "Lonely"), (101, None), (102, " ..."), (103, items[0][1]), (3, items[4][1]), (None, items[5][1])]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for i in range(60, 120):
        cut = items[i % 25][1].split()
        k = rng.randint(0, max(0, len(cut) - 13))
        rows.append((i, f"{rows[i - 60][1]} {', '.join(cut[k : k + rng.randint(10, 20)]).upper() if i % 7 else ' '.join(cut)}! {rows[i - 30 if i < 90 else i - 60][1]}"))
    rows += [(900, None), (901, ""), (902, "?!"), (903, "lonely " * 5000), (904, items[3][1]), (904, items[3][1]), (None, items[6][1])]
    rows = [(i, t.replace("É", "é") if t and "É" in t and i and i % 2 else t) for i, t in rows]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = postings.contamination(docs(rows), benchmark).collect()
    assert Counter((r["id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got) == plain_contamination(rows, items)
    clean = postings.without_contaminated(docs(rows), benchmark)
    assert clean.count() == sum(not x[4] for x in plain_contamination(rows, items).elements())
    assert postings.contamination(docs([]), benchmark).count() == 0
    assert postings.contamination(docs(rows), benchmark.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_proximity(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    shuffled = " ".join(reversed(item.split()))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["id"]: (r["n_hit"], r["n_near"]) for r in postings.contamination(docs([(1, item), (2, shuffled), (3, "alpha beta gamma"), (4, " ".join(f"{w} and so on and on" for w in item.split()))]), benchmark).collect()}
    assert got == {1: (13, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
