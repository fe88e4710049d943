"""Token counts: greedy longest-match word pieces counted by an automaton in linear time."""
from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE = 500_000
CACHED_BYTES = 64


class PieceCounter:
    """Vocabulary trie with failure links and popped-token counts.

    ``initial`` are pieces that begin a word, ``inner`` those that continue one. The trie has
    a root for each, so a word walks from the initial root and every later piece from the
    inner one. When a node has no edge for the next symbol, its failure link names the node
    of what is left after the longest match has been popped from what the node spells, piece
    by piece, and ``popped`` how many pieces that were. A walk adds these counts up and
    never builds a piece.
    """

    def __init__(self, initial, inner):
        self.edges: list[dict] = [{}, {}]
        ends = [False, False]
        roots = (0, 1)
        for root, pieces in zip(roots, (initial, inner)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for s in piece:
                    nxt = self.edges[node].get(s)
                    if nxt is None:
                        nxt = self.edges[node][s] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = nxt
                ends[node] = True
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        level = list(roots)
        while level:
            below = []
            for node in level:
                for s, child in self.edges[node].items():
                    below.append(child)
                    if ends[child]:
                        self.fail[child], self.popped[child] = 1, 1
                        continue
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and s not in self.edges[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.edges[at][s], count
            level = below

    def count(self, word) -> int:
        """Pieces of the word; 1, the unknown piece, when it cannot be cut into pieces. An empty word has none."""
        if not word:
            return 0
        edges, fail, popped = self.edges, self.fail, self.popped
        node, n = 0, 0
        for s in word:
            nxt = edges[node].get(s)
            while nxt is None:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
                nxt = edges[node].get(s)
            node = nxt
        while node != 1:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


@lru_cache(maxsize=2)
def byte_counter(path: str) -> PieceCounter:
    """A counter over bytes from a rank file: pieces with a leading blank begin words, the others continue them.

    Every single byte is made a piece of both kinds, so that no word is unknown.
    """
    initial, inner = [bytes([b]) for b in range(256)], [bytes([b]) for b in range(256)]
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece = base64.b64decode(line.split()[0])
                (initial if piece.startswith(b" ") else inner).append(piece.removeprefix(b" "))
    return PieceCounter(initial, inner)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` per document.

    Words are runs of other characters than ASCII white space; each is cut greedily into its
    longest vocabulary pieces. Null, empty and blank texts have no words and no tokens. Every
    input row gives one row; other columns are ignored. Nothing is shuffled.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def counted(batches):
        counter, known = byte_counter(path), {}
        for b in batches:
            n_words, n_tokens = [], []
            for text in b.column("text").to_pylist():
                words, total = text.encode().split(), 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = counter.count(w)
                        if len(w) <= CACHED_BYTES:
                            if len(known) >= CACHE:
                                known.clear()
                            known[w] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return raw.mapInArrow(counted, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
