"""Operators that look at each text by itself."""

import json
import random
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sourceloom.llm import bpe, crf, layout, wordpiece

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a" * 20_000, "word " * 5_000, "é😀—x", "<|endoftext|>x<|endoftext|>", "x", "x"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.load(file.read())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def same(vocabulary, tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    packed = vocabulary.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert vocabulary.decode(packed) == tokenizer.decode(ids, skip_special_tokens=False)


@cache
def _tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_bpe_any_text(text):
    with open(PATH, "rb") as file:
        same(bpe.load(file.read()), _tokenizer(), text)


@pytest.mark.parametrize("one", "\u0558\u088f\ua7ce\U00010940\U00011de0\U00016ea0\U0001e6c0\U0003251a\U0003fc3f")
def test_bpe_letters_and_numbers_of_later_unicode_versions(vocabulary, tokenizer, one):
    for text in (one, f"{one}退", f"a{one}b 1{one}2", f" {one}{one}", f"x {one}!é{one}'s<|endoftext|>{one}"):
        same(vocabulary, tokenizer, text)


def test_bpe_every_token_is_its_own_encoding(vocabulary):
    special = set(vocabulary.special.values())
    assert all(vocabulary.encode_word(t) == [i] for i, t in enumerate(vocabulary.tokens) if i not in special)


def test_bpe_long_words_and_special_tokens(vocabulary, tokenizer):
    rng = random.Random(3)
    for unit in ["a", "ab", "hello", "!", "é", " ", "thatthe"]:
        same(vocabulary, tokenizer, unit * 3000)
    same(vocabulary, tokenizer, "".join(rng.choice("abcdethin") for _ in range(20_000)))
    same(vocabulary, tokenizer, "a  <|endoftext|>  b<|endoftext|>")


def test_bpe_words_have_the_fewest_possible_merges_left(vocabulary):
    """The plain way: join the pair with the lowest rank until none is left."""
    rng = random.Random(5)
    of = {t: i for i, t in enumerate(vocabulary.tokens) if len(t) == 1}
    for _ in range(300):
        word = bytes(rng.choice(b"aeinrsthdo'\xc3\xa9") for _ in range(rng.randint(1, 14)))
        ids = [of[bytes([b])] for b in word]
        while True:
            ranked = [(vocabulary.pairs[a << 32 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in vocabulary.pairs]
            if not ranked:
                break
            _, k = min(ranked)
            merged = next(i for i in range(len(vocabulary.tokens)) if vocabulary.rank[i] == min(ranked)[0])
            ids[k : k + 2] = [merged]
        assert vocabulary.encode_word(word) == ids


def test_bpe_rows(docs, vocabulary):
    df = bpe.round_trip(docs(list(enumerate(ODD))), PATH)
    rows = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == len(ODD) and {"lang", "_k1", "key1"} <= set(df.columns)
    for k, text in enumerate(ODD):
        assert bytes(rows[k]["ids"]) == vocabulary.encode(text or "")
        assert rows[k]["decoded"] == (text or "")
    assert bpe.round_trip(docs([]), PATH).count() == 0
    again = bpe.decode(bpe.encode(docs(list(enumerate(ODD))), PATH), PATH)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {k: t or "" for k, t in enumerate(ODD)}


def greedy(pieces, word):
    n, at = 0, 0
    while at < len(word):
        at += next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 1)
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.binary(max_size=40).map(lambda b: bytes(x % 4 + 97 for x in b)))
def test_pieces_are_counted_as_if_cut(pieces, word):
    assert wordpiece.Automaton(pieces).count(word) == greedy(pieces, word)


def test_piece_counts_of_rows(docs):
    pieces = set(wordpiece.pieces_of(PIECES))
    rows = {r["doc_id"]: r for r in wordpiece.piece_counts(docs(list(enumerate(ODD))), PIECES).collect()}
    for k, text in enumerate(ODD[:4] + ODD[5:]):
        k = k if k < 4 else k + 1
        words = (text or "").encode().split()
        assert rows[k]["n_words"] == len(words)
        assert rows[k]["n_pieces"] == sum(greedy(pieces, wordpiece.MARK + w) for w in words[:50]) * (100 if len(words) > 50 else 1)
    assert wordpiece.piece_counts(docs([]), PIECES).count() == 0


PAGE = """<!doctype html><title>no</title><style>p{}</style><p>One <b>two</b>
three<p>four<br>five<ul><li>a<li>b<ol start=3><li>c</ol></ul><div hidden>x</div><span style="display: none">y</span>
<table><tr><th>name<th>n<tr><td>longer name<td>1<tr><td colspan=2>both</table><pre> a
  b</pre>&lt;end&gt;<script>"</p>"</script><!-- no --><p style="visibility:hidden">h<i style="visibility:visible">v</i>"""

TEXT = """One two three

four
five

- a
- b
  3. c

name         n
longer name  1
both

 a
  b

<end>

v"""


def test_layout():
    assert layout.render(PAGE).replace("both       ", "both") == TEXT


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "</p></td></table>", "<td>x", "<table><td>a<table><tr><td>b</table>", "<div>" * 30_000 + "deep", "<a href='" + "x" * 50_000, "&amp;&bogus;&#0;", "<ul><li>" * 3000 + "x", "<td colspan=999999999 rowspan=99>x", "<!-- never closed", "<script>never closed"])
def test_layout_survives(page):
    assert isinstance(layout.render(page), str)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title=don't>Hello</p><p>It's here</p>", "Hello\n\nIt's here"),
        ("<!-->Visible text<p>more", "Visible text\n\nmore"),
        ("<!--->a<!-- b --!>c<!-- d -->e", "ace"),
        ('<a href="x"">link</a> on', "link on"),
        ("<td>a<td>b", "a b"),
        ('<p title="a>b" class = \'c>d\'>x', "x"),
        ('<p title="never closed>x</p>y', "x\n\ny"),
        (f"<table><tr><td>{'a' * 61}<td>b<tr><td>c<td>d</table>", "a" * 61 + "  b\nc  d"),
    ],
)
def test_layout_of_malformed_tags(page, text):
    assert layout.render(page) == text


def test_layout_aligns_as_wide_as_asked():
    assert layout.render(f"<table><tr><td>{'a' * 61}<td>b<tr><td>c<td>d</table>", widest=80) == "a" * 61 + "  b\n" + "c".ljust(61) + "  d"


def test_layout_ends_paragraphs_however_deep():
    for depth in (1, 63, 64, 500):
        assert layout.render("<p>a" + "<i>" * depth + "x<div>b</div>c<p>d</p></p>e") == "ax\n\nb\nc\n\nd\n\ne"


def test_layout_rows(spark):
    pages = spark.createDataFrame([(1, PAGE, "old"), (2, None, "old"), (3, "", None)], "page_id long, html string, text string")
    rows = {r["page_id"]: r["text"] for r in layout.extract(pages).collect()}
    assert rows == {1: layout.render(PAGE), 2: "", 3: ""}


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(1)
    model = crf.Model(rng.normal(size=3 * crf.N_FEATURES + 1), rng.normal(size=(2, 2)))
    x = crf.matrix([b"One line.", b"### $$$", b"ALL LOUD!!", b"a a a a"])
    score = x @ model.weights
    total, good = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> t & 1 for t in range(4)]
        p = np.exp(sum(score[t] * y[t] for t in range(4)) + sum(model.edges[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    assert np.allclose(model.marginals(x), good / total)


def test_gradient_training_separates_and_holds_out(spark):
    rng = random.Random(2)
    plain = lambda: "\n".join(" ".join(rng.choice(["the", "tree", "is", "green", "and", "tall"]) for _ in range(9)) + "." for _ in range(4))
    junk = lambda: "\n".join(" ".join(rng.choice(["###", "$$$", "BUY!!"]) for _ in range(9)) for _ in range(4))
    rows = [(i, junk() if i % 3 == 0 else plain()) for i in range(120)] + [(200, None), (201, ""), (None, "x"), (202, "word " * 20_000), (202, "word " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(60)] + [(61, None), (62, 0), (62, 1), (None, 1)], "doc_id long, quality int")
    model = crf.fit(df, marks, crf.F.lit(True))
    scored = crf.with_quality(df, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert all((r["score"] > 0.5) == (r["doc_id"] % 3 != 0) for r in scored if r["doc_id"] is not None and r["doc_id"] < 120)
    assert crf.with_quality(df.limit(0), model).count() == 0
    nothing = crf.fit(df, marks.limit(0), crf.F.lit(True))
    assert nothing.quality("anything") == 0.5


def test_vocabulary_file_has_ranks_in_order(vocabulary):
    merges = json.load(open(PATH))["model"]["merges"]
    assert len(vocabulary.pairs) == len(merges)
