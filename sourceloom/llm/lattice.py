"""Document likelihood under a unigram model of word pieces, summed over all segmentations.

The pieces and their weights come from an existing vocabulary; the weights are a prior that
expectation steps over the distinct training words re-estimate.  No piece goes past the start of
a word, so the lattice of a document falls apart into those of its words and each distinct
word is scored once, by a forward recursion over its characters in logarithms.  A word
that training knows has one arc more, over all of it, with its discounted frequency; the
mass that discounting frees is what the pieces share.

Words travel in blocks: documents are dealt into blocks of about BLOCK_BYTES of text, a block
asks once for each of its distinct words, and gets back its count and likelihood.  A word of
any frequency is thus one row per block, and nothing grows with the number of its tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import crc32_mod, text_or_empty
from sourceloom.session import written

MARK = "▁"
ROUNDS = 2  # expectation steps over the training words
PRIOR = 1000.0  # pieces that the vocabulary's own weights count for
BLOCK_BYTES = 4 << 20
HELD_WORDS = 200_000  # distinct words that a task counts before it passes them on
LONG = 100  # characters from which a word's expectations are computed in logarithms


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece model, then the 256 bytes, and their weights (natural logarithms).

    The scores in such a file order its pieces; the weight of the piece at rank r is taken
    in proportion to 1 / (r + 1), bytes after all others.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    plain = [i for i in plain if MARK not in model.id_to_piece(i)[1:] and model.id_to_piece(i)]
    order = sorted(plain, key=lambda i: (-model.get_score(i), i))
    weights = 1.0 / np.arange(1, len(order) + 257)
    return [model.id_to_piece(i) for i in order], np.log(weights / weights.sum())


class Lattice:
    """Arcs of words; `weights`: natural logarithms, pieces first, then 256 bytes."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.root: dict = {}
        for i, piece in enumerate(pieces):
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.single = {p for p in pieces if len(p) == 1}

    def _bytes(self, c: str) -> list[int]:
        return [self.n + b for b in c.encode("utf-8", "replace")]

    def _weight(self, i: int, c: str, weights: list[float]) -> float:
        return weights[i] if i >= 0 else sum(weights[j] for j in self._bytes(c))

    # The walk from each start along the trie is written out in all three: it is what their time goes into.

    def log_likelihood(self, word: str, weights: list[float]) -> float:
        """Natural logarithm of the probability of `word`, over all ways to cut it into pieces."""
        n, root, single = len(word), self.root, self.single
        incoming: list[list[float]] = [[] for _ in range(n + 1)]
        incoming[0].append(0.0)
        for s in range(n):
            here, incoming[s] = _log_sum(incoming[s]), []
            if word[s] not in single:
                incoming[s + 1].append(here + self._weight(-1, word[s], weights))
            node, e = root, s
            while e < n:
                node = node.get(word[e])
                if node is None:
                    break
                e += 1
                i = node.get("")
                if i is not None:
                    incoming[e].append(here + weights[i])
        return _log_sum(incoming[n])

    def expect(self, word: str, weights: list[float], probabilities: list[float], expected) -> None:
        """Adds to `expected` how often each piece occurs in `word` on average over its cuts."""
        n, root, single = len(word), self.root, self.single
        if n > LONG:
            return self._expect_in_logarithms(word, weights, expected)
        forward = [0.0] * (n + 1)
        forward[0] = 1.0
        arcs = []
        for s in range(n):
            here = forward[s]
            if word[s] not in single:
                p = math.prod(probabilities[j] for j in self._bytes(word[s]))
                forward[s + 1] += here * p
                arcs.append((s, s + 1, -1, p))
            node, e = root, s
            while e < n:
                node = node.get(word[e])
                if node is None:
                    break
                e += 1
                i = node.get("")
                if i is not None:
                    p = probabilities[i]
                    forward[e] += here * p
                    arcs.append((s, e, i, p))
        if forward[n] < 1e-280:
            return self._expect_in_logarithms(word, weights, expected)
        backward = [0.0] * (n + 1)
        backward[n] = 1.0 / forward[n]
        for s, e, i, p in reversed(arcs):
            x = p * backward[e]
            backward[s] += x
            if i >= 0:
                expected[i] += x * forward[s]
            else:
                for j in self._bytes(word[s]):
                    expected[j] += x * forward[s]

    def _expect_in_logarithms(self, word, weights, expected) -> None:
        n, root = len(word), self.root
        forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        forward[0] = backward[n] = 0.0
        arcs = []
        for s in range(n):
            ends = [] if word[s] in self.single else [(s + 1, -1)]
            node, e = root, s
            while e < n and (node := node.get(word[e])) is not None:
                e += 1
                if "" in node:
                    ends.append((e, node[""]))
            for e, i in ends:
                w = self._weight(i, word[s], weights)
                forward[e] = _log_add(forward[e], forward[s] + w)
                arcs.append((s, e, i, w))
        for s, e, i, w in reversed(arcs):
            backward[s] = _log_add(backward[s], backward[e] + w)
            x = math.exp(forward[s] + w + backward[e] - forward[n])
            for j in [i] if i >= 0 else self._bytes(word[s]):
                expected[j] += x


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _log_sum(xs: list[float]) -> float:
    if len(xs) == 1:
        return xs[0]
    top = max(xs)
    return top + math.log(sum([math.exp(x - top) for x in xs]))


@lru_cache(maxsize=2)
def _lattice(pieces: str) -> Lattice:
    return Lattice(pieces.split("\n"))


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) for every word of `text`: how often it occurs where `train` holds."""

    def run(batches):
        held: Counter = Counter()

        def out():
            words = pa.table({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())}).to_batches(10_000)
            held.clear()
            return words

        for batch in batches:
            for text, train in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("train").to_pylist()):
                words = _tokens(text)
                if train:
                    held.update(words)
                else:
                    for w in set(words):
                        held.setdefault(w, 0)
                if len(held) > HELD_WORDS:
                    yield from out()
        yield from out()

    return docs.select("text", "train").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def fit(words: DataFrame, pieces: list[str], prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after `rounds` expectation steps over all distinct training words (word, c).

    Each word counts once, since pieces are to explain words that training doesn't know.

    Each task adds up the expectations of its words, so what meets is one row per
    piece and task, and what comes to the driver is bounded by the vocabulary.
    """
    sc = words.sparkSession.sparkContext
    shared = sc.broadcast("\n".join(pieces))
    train, weights = words.filter("c > 0"), prior
    for _ in range(rounds):
        now = sc.broadcast(weights)

        def run(batches, now=now):
            lattice = _lattice(shared.value)
            ws = now.value.tolist()
            ps = np.exp(now.value).tolist()
            expected = [0.0] * len(ws)
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    lattice.expect(MARK + word.decode("utf-8", "replace"), ws, ps, expected)
            x = np.array(expected)
            some = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(x[some])], names=["piece", "expected"])

        sums = train.mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).collect()
        x = np.zeros(len(weights))
        for r in sums:
            x[r["piece"]] = r["expected"]
        weights = np.log((x + PRIOR * np.exp(prior)) / (x.sum() + PRIOR))
    return weights


def score_words(words: DataFrame, pieces: list[str], weights: np.ndarray, tokens: int, discount: float, freed: float) -> DataFrame:
    """`words` (word, c) with `log10_p`: of the whole-word arc (c less `discount`, of `tokens`) and all cuts into pieces (of the mass `freed`)."""
    sc = words.sparkSession.sparkContext
    shared, now = sc.broadcast("\n".join(pieces)), sc.broadcast(weights)
    # Words start with a marked piece and go on with others: so much do the products over their pieces sum to.
    starts = sum(math.exp(w) for p, w in zip(pieces, weights) if p.startswith(MARK))
    goes_on = sum(math.exp(w) for p, w in zip(pieces, weights) if not p.startswith(MARK)) + float(np.exp(weights[len(pieces) :]).sum())
    share = math.log(freed) - math.log(starts) + math.log(1 - goes_on) if freed > 0 and starts > 0 else -math.inf

    def run(batches):
        lattice, ws = _lattice(shared.value), now.value.tolist()
        ten = math.log(10)
        for batch in batches:
            p = []
            for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                cuts = lattice.log_likelihood(MARK + w.decode("utf-8", "replace"), ws) + share
                whole = math.log((c - discount) / tokens) if c > discount else -math.inf
                p.append(_log_add(cuts, whole) / ten)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(p, pa.float64())], names=["word", "c", "log10_p"])

    return words.mapInArrow(run, "word binary, c long, log10_p double")


def _distinct_words(table: pa.Table) -> pa.Table:
    words: set[bytes] = set()
    for text in table.column("text").cast(pa.binary()).to_pylist():
        words.update(_tokens(text))
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(words), pa.int64()), "word": pa.array(list(words), pa.binary())})


def score_documents(docs: DataFrame, path: str, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Tokens: words of the text with A-Z lower-cased, then one end.  score: log10
    probability of the text under the lattice model; base_score: under add-one smoothed
    counts of training tokens.  Rows where `train` is false or null are held out and teach
    nothing.  A null text is an empty one: its only token is the end.  Repeated rows
    count as often as they occur and get the same scores.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    # Which block a row goes to is of no consequence for its result.
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count_if("train").alias("train")).first()
    n_docs = size["train"]
    words = written(count_words(rows), "words")
    found = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    train_tokens, distinct = (found["n"] or 0) + n_docs, found["v"] + (1 if n_docs else 0)
    discount = min(0.95, max(0.05, found["once"] / (found["once"] + 2 * found["twice"]))) if found["once"] else 0.5
    pieces, prior = vocabulary(path)
    weights = fit(words, pieces, prior)
    freed = discount * (distinct / train_tokens) if train_tokens else 1.0  # without any training the pieces have it all
    scored = written(score_words(words, pieces, weights, max(1, train_tokens), discount, freed), "scored-words")

    n_blocks = max(1, math.ceil((size["bytes"] or 0) / BLOCK_BYTES))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_blocks / 8))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text"), F.xxhash64("text")), F.lit(n_blocks).cast("long")))
    dealt = dealt.repartition(partitions, "block")
    asked = dealt.groupBy("block").applyInArrow(_distinct_words, "block long, word binary")
    answers = asked.join(scored, "word").select("block", "word", "c", "log10_p")
    norm = math.log10(train_tokens + distinct + 1)
    end = math.log10(n_docs + 1) - norm
    end_known = int(n_docs > 0)
    end_p = math.log10(max(n_docs - discount, 0.5) / max(1, train_tokens))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(right.column("word").to_pylist())}
        c, p = right.column("c").to_numpy(), right.column("log10_p").to_numpy()
        base, known = np.log10(c + 1.0) - norm, c > 0
        n_tokens, n_known, base_score, score = [], [], [], []
        for t in left.column("text").cast(pa.binary()).to_pylist():
            at = np.fromiter(map(place.__getitem__, _tokens(t)), np.int64)
            n_tokens.append(len(at) + 1)
            n_known.append(int(known[at].sum()) + end_known)
            base_score.append(float(base[at].sum()) + end)
            score.append(float(p[at].sum()) + end_p)
        n = left.num_rows
        return pa.table([left.column("id"), pa.array([not x for x in left.column("train").to_pylist()]), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([train_tokens] * n, pa.int64()), pa.array(base_score), pa.array(score)], names=out)

    out = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema).withColumnRenamed("id", doc_id)


def training_fold(doc_id: str, modulus: int, held_out: int) -> Column:
    """Rows to learn from: all but those whose crc32 of the id as text leaves the remainder `held_out`."""
    return crc32_mod(doc_id, modulus) != held_out
