"""Token counts by a linear longest-match automaton.

Greedy longest-match pieces of each pre-token are counted without building them.
The automaton is a trie of the vocabulary. A node without a child for the next
byte pops the longest pieces of what it stands for: its failure link leads to
the node of what is left, and the number of pieces popped on the way is stored
with the link. Each byte is read once and each link makes what is left shorter,
so that the work is linear in the bytes, whatever the pieces.

Vocabularies whose pieces within a word are marked, as by ##, have a second root,
at which all links end. Pieces are bytes. A byte that begins no piece counts as
an unknown piece of its own, or makes its whole word one unknown piece (`whole`).
Greedy counts are those of longest match first, not of merges by rank.

Defined cases: a null or empty text has no tokens; a very long text is split and
counted whole; of pieces of equal bytes there is one; null and repeated doc_ids
are counted row by row; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import bpe, common
from netquarry.llm.pretokens import splitter

#: Pre-tokens whose count a worker remembers.
MEMO = 200_000


class LongestMatch:
    """The automaton of a vocabulary of byte strings; `continuation` is what marks those that stand within a word."""

    def __init__(self, vocabulary: Iterable[bytes], continuation: bytes | None = None, whole: bool = False):
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        roots = 1 if continuation is None else 2
        self.inner = roots - 1
        ends, depth, via = [False] * roots, [0] * roots, [(0, 0)] * roots

        def add(root: int, piece: bytes) -> None:
            node = root
            for b in piece:
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(ends)
                    ends.append(False)
                    depth.append(depth[node] + 1)
                    via.append((node, b))
                node = to
            ends[node] = node >= roots

        for piece in vocabulary:
            if continuation is not None and piece.startswith(continuation) and len(piece) > len(continuation):
                add(self.inner, piece[len(continuation) :])
            else:
                add(0, piece)
        if not whole:  # each byte is a piece, if need be an unknown one
            for root in range(roots):
                for b in range(256):
                    add(root, bytes([b]))
        # A node's link: where what is left stands after popping, and how many pieces were popped; -1 if nothing can be.
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        for node in sorted(range(roots, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.link[node], self.popped[node] = self.inner, 1
                continue
            parent, b = via[node]
            at, n = self.link[parent], self.popped[parent]
            while at >= 0 and (at << 8 | b) not in self.child:
                n += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.child[at << 8 | b], n

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        child, link, popped, node, n = self.child.get, self.link, self.popped, 0, 0
        for b in word:
            to = child(node << 8 | b)
            while to is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                to = child(node << 8 | b)
            node = to
        while node != self.inner:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """That of a rank file."""
    return LongestMatch(bpe.ranks(path))


def _counts(path: str, pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, of, memo = splitter(pattern), automaton(path).count, {}
        for b in batches:
            n_words, n_tokens = [], []
            for t in b.column(1).to_pylist():
                words = split(t or "")
                total = 0
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        n = memo[w] = of(w.encode("utf-8", "replace"))
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pre_tokens and n_tokens of each row."""
    common.tune(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_counts(path, pattern), "doc_id long, n_pre_tokens long, n_tokens long")
