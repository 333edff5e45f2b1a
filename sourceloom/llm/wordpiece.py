"""Counts of greedy word pieces by one pass of a longest-match automaton.

The pieces of a vocabulary form a trie over bytes.  A node that spells a piece knows
that leaving it ends one piece; any other node knows how many pieces its text falls
into before the rest is again the start of a piece, and which node that rest is (its
failure link).  One pass over a word that adds these counts gives the number of pieces
without cutting any.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourceloom.llm.common import with_columns_from

MARK = "▁".encode()  # starts the first piece of a word
MAX_CACHED, MAX_WORD = 300_000, 64


def pieces_of(path: str) -> list[bytes]:
    """The ordinary pieces of a sentencepiece model; special and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [model.id_to_piece(i).encode() for i in usable]


class Automaton:
    """Greedy longest match over bytes; a byte that starts no piece is a piece by itself."""

    def __init__(self, pieces):
        self.step: dict[int, int] = {}  # node << 8 | byte -> node
        ends, parents = [False], [(0, 0)]
        for piece in [*(bytes([b]) for b in range(256)), *pieces]:
            node = 0
            for b in piece:
                child = self.step.get(node << 8 | b)
                if child is None:
                    child = self.step[node << 8 | b] = len(ends)
                    ends.append(False)
                    parents.append((node, b))
                node = child
            ends[node] = True
        depth = [0] * len(ends)
        for v in range(1, len(ends)):
            depth[v] = depth[parents[v][0]] + 1
        self.fail, self.popped = [0] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):  # shorter texts first
            if ends[v]:
                self.popped[v] = 1
                continue
            u, b = parents[v]
            node, popped = self.fail[u], self.popped[u]
            while (child := self.step.get(node << 8 | b)) is None:  # ends: every byte is a piece
                popped += self.popped[node]
                node = self.fail[node]
            self.fail[v], self.popped[v] = child, popped

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for b in word:
            while (child := step.get(node << 8 | b)) is None:
                total += popped[node]
                node = fail[node]
            node = child
        while node:
            total += popped[node]
            node = fail[node]
        return total


class Counter(dict):
    """Pieces of words met before; of bounded size."""

    def __init__(self, pieces):
        super().__init__()
        self.automaton = Automaton(pieces)

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(MARK + word)
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = n
        return n

    def of(self, text: str | None) -> tuple[int, int]:
        words = (text or "").encode("utf-8", "replace").split()
        return len(words), sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def _counter(pieces: bytes) -> Counter:
    return Counter(pieces.split(b"\n"))


def piece_counts(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """`df` with `n_words` and `n_pieces` of `column`.

    Words are runs without the six ASCII space characters; each is cut greedily, from
    a mark for its start, into the longest pieces of the vocabulary at `path`; a character
    of no piece counts as its UTF-8 bytes.  Null and empty texts have none of both.  Each
    row is counted by itself and whole.  Columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(b"\n".join(p for p in pieces_of(path) if b"\n" not in p))

    def maker():
        counter = _counter(shared.value)
        return lambda texts: zip(*(counter.of(t) for t in texts)) if texts else [[], []]

    return with_columns_from(df, column, [T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())], maker)
