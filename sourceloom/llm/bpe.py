"""Byte-pair encoding by longest matches with backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token at a place.  A
token may follow another one only if merging would never have joined across their
border; that is read off the merge table by undoing the later of the two merges at the
border again and again, and kept in a table of pairs.  Where a token doesn't fit, the next
shorter one is tried; where none fits, the token before is given up and the place is
marked, so each place is given up at most once and the whole is linear.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourceloom.llm.common import with_columns_from

# Fixed value: the pattern by which byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: letters and numbers of later Unicode versions, which the tables of that pattern's engine don't hold; to it they are signs.
UNKNOWN = (
    "\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D"
    "\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    "\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    "\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    "\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    "\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    "\U0001E6E0-\U0001E6E2\U0001E6E4\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE\U0001E6FF"
    "\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_ANY_UNKNOWN = re.compile(f"[{UNKNOWN}]")
_FROM_FIRST = re.compile(f"[{UNKNOWN[0]}-\U0010FFFF]")  # one range, which is looked for much faster
MAX_CACHED, MAX_WORD, MAX_PAIRS = 200_000, 64, 1_000_000  # entries of a worker's tables; beyond them they start anew
DECODE_STEP = 1 << 20  # ids decoded at a time


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, file: bytes):
        data = json.loads(file)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(byte_of[c] for c in token)
        # What was merged to make a token; rank: merges in order, single bytes before all of them.
        self.rank = [-1] * len(self.tokens)
        self.left, self.right, self.pairs = [-1] * len(self.tokens), [-1] * len(self.tokens), {}
        for k, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, a, b = ids[a + b], ids[a], ids[b]
            self.rank[i], self.left[i], self.right[i] = k, a, b
            self.pairs[a << 32 | b] = k
        of = {t: i for i, t in enumerate(self.tokens) if t}
        self.shorter = [next((of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in of), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, i in of.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        lengths = np.array([len(t) for t in self.tokens])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        contents = sorted(self.special, key=len, reverse=True)
        self._specials = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self._words = regex.compile(PATTERN).findall
        known = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{UNKNOWN}]]")
        for kind in "LN":
            known = known.replace(rf" ?\p{{{kind}}}+", rf" ?[\p{{{kind}}}--[{UNKNOWN}]]+")
        self._known_words = regex.compile(known, regex.V1).findall
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = _Cache(self)

    # -- encoding

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves `a` and `b` side by side."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MAX_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._never_joined(a, b)
        return known

    def _never_joined(self, a: int, b: int) -> bool:
        rank, limit = self.rank, len(self.tokens)
        while self.pairs.get(a << 32 | b, limit) >= limit:
            if rank[a] < 0 and rank[b] < 0:
                return True
            # Before the later of both was made, its inner part lay at the border; of equal ones the left is made first.
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]
        return False

    def encode_word(self, word: bytes) -> list[int]:
        text, n = word.decode("latin-1"), len(word)
        tokens, shorter, fits, longest = self.tokens, self.shorter, self.fits, self.automaton.iter_long
        out: list[int] = []
        given_up: set[int] = set()
        at, matches = 0, longest(text)
        token = next(matches)[1]
        while True:
            end = at + len(tokens[token])
            if end not in given_up and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, -1
                if matches is None:
                    matches = longest(text, at)
                token = next(matches)[1]
            else:
                matches = None
                token = shorter[token]
                while token < 0:
                    given_up.add(at)
                    at -= len(tokens[out[-1]])
                    token = shorter[out.pop()]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; special tokens' texts become their ids."""
        cached = self._cache.__getitem__
        far = None if text.isascii() else _FROM_FIRST.search(text)
        words = self._known_words if far and _ANY_UNKNOWN.search(text, far.start()) else self._words
        if self._specials is None:
            return b"".join(map(cached, words(text)))
        out, at = [], 0
        for m in self._specials.finditer(text):
            out += map(cached, words(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(cached, words(text[at:] if at else text))
        return b"".join(out)

    # -- decoding

    def decode_bytes(self, ids: bytes) -> bytes:
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), DECODE_STEP):
            part = every[k : k + DECODE_STEP]
            start, length = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            shift = start - (np.cumsum(length) - length)
            out.append(self.blob[np.arange(length.sum()) + np.repeat(shift, length)].tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Cache(dict):
    """Packed ids of words met before; of bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.vocabulary.encode_word(word.encode("utf-8", "replace")), "<u4").tobytes()
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def load(file: bytes) -> Vocabulary:
    return Vocabulary(file)


_IDS = T.StructField("ids", T.BinaryType())
_DECODED = T.StructField("decoded", T.StringType())


def _shared(df: DataFrame, path: str):
    """The vocabulary file (a few MB, whatever the data) as a broadcast, so executors need no file of their own."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """`df` with `ids`: the tokens of `column` as packed little-endian unsigned 32-bit integers.

    A null or empty text has no tokens (an empty `ids`).  Texts are encoded whole,
    each row by itself, so ties and repeated rows are of no concern; an empty table stays
    empty and a column `ids` of `df` is replaced.
    """
    file = _shared(df, path)

    def maker():
        vocabulary = load(file.value)
        return lambda texts: [[vocabulary.encode(t or "") for t in texts]]

    return with_columns_from(df, column, [_IDS], maker)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """`df` with `decoded`: the text of packed ids (null: the empty text)."""
    file = _shared(df, path)

    def maker():
        vocabulary = load(file.value)
        return lambda ids: [[vocabulary.decode(x or b"") for x in ids]]

    return with_columns_from(df, column, [_DECODED], maker)


def round_trip(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """`encode` and `decode` in one pass over the data: `df` with `ids` and `decoded`."""
    file = _shared(df, path)

    def maker():
        vocabulary = load(file.value)

        def apply(texts):
            ids = [vocabulary.encode(t or "") for t in texts]
            return [pa.array(ids, pa.binary()), [vocabulary.decode(x) for x in ids]]

        return apply

    return with_columns_from(df, column, [_IDS, _DECODED], maker)
