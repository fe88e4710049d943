"""BPE encoding and decoding with word ends: a queue of merge ranks over a linked symbol list."""
from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

WORD_END = "</w>"
CACHE = 600_000  # words a worker remembers; beyond it starts anew
CACHED_CHARS = 64  # longer words are not remembered

# The vocabulary's own pre-token pattern, and white space as its library knows it.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^{S}{L}{N}]+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Code points that the installed regex module calls letters or numbers and the tokenizer library,
# at Unicode 16, does not.
LATER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    r"\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f")
LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
LETTER = rf"[\p{{L}}--[{LATER_LETTERS}]]"
NUMBER = rf"[\p{{N}}--[{LATER_NUMBERS}]]"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for s, i in chain(vocab.items(), self.added.items()):
            self.strings[i] = s
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        pairs = list(pairs)
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + WORD_END] for c in alphabet]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(PIECE.format(L=LETTER, N=NUMBER, S=SPACE), regex.V1)
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.space = regex.compile(f"[{SPACE}]+")
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: str) -> list[int]:
        """Ids of one pre-token.

        Symbols form a doubly linked list. The queue holds, as one number each, the rank of
        a merge and its position; an entry is stale when the symbols there no longer have it.
        """
        data = piece.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        rank_of, made, pop, push = self.ranks.get, self.made, heapq.heappop, heapq.heappush
        bits = n.bit_length()
        mask = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(map(rank_of, zip(ids, ids[1:]))) if r is not None]
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = pop(queue)
            i, rank = top & mask, top >> bits
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of((ids[i], ids[j])) != rank:
                continue
            new = ids[i] = made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_of((new, ids[k]))
                if r is not None:
                    push(queue, r << bits | i)
            h = before[i]
            if h >= 0:
                r = rank_of((ids[h], new))
                if r is not None:
                    push(queue, r << bits | h)
        return [i for i in ids if i >= 0]

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one normalised run without white space: cut into pre-tokens, each merged."""
        if text.isalpha():
            return tuple(self.merged(text))
        return tuple(chain.from_iterable(map(self.merged, self.pieces.findall(text))))

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by single characters: no final sigma
        return text.lower()

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for part in self.split_added.split(text) if any(a in text for a in self.added) else (text,):
            if part in self.added:
                out.append(self.added[part])
                continue
            part = self.normalised(part)
            for run in part.split() if not self.odd_space.search(part) else filter(None, self.space.split(part)):
                ids = known.get(run)
                if ids is None:
                    end = run[-1]
                    # A full stop or comma after letters is a pre-token of its own.
                    ids = self.remembered(run[:-1]) + self.remembered(end) if end in ".," and run[:-1].isalpha() else self.word(run)
                    self.remember(run, ids)
                out += ids
        return out

    def remembered(self, run: str) -> tuple[int, ...]:
        ids = self.known.get(run)
        if ids is None:
            ids = self.word(run)
            self.remember(run, ids)
        return ids

    def remember(self, run: str, ids: tuple[int, ...]) -> None:
        if len(run) <= CACHED_CHARS:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[run] = ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, joined by blanks as the tokenizer file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker; the file ships with the Python environment of every executor."""
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


GROUP = 64  # documents whose ids are held at once


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` per document, or their number and digests.

    Each whole text is encoded as the tokenizer file says, special strings in it becoming
    their ids, and the ids are decoded again. A null or empty text has no ids and decodes to
    an empty text. Every input row gives one row; other columns are ignored. Rows are
    handled one by one in Arrow batches, so nothing is shuffled or collected.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = raw.schema["doc_id"].dataType.simpleString()

    def digested(batches):
        v = vocabulary(path)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column("text"):
                ids = v.encode(t.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def whole(batches):
        v = vocabulary(path)
        for b in batches:
            texts = b.column("text")
            for start in range(0, len(texts), GROUP):
                ids = [v.encode(t.as_py()) for t in texts[start:start + GROUP]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(map(v.decode, ids), pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    if digests:
        return raw.mapInArrow(digested, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return raw.mapInArrow(whole, f"doc_id {id_type}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, decoded`` of rows with ``ids``; null ids decode to an empty text."""
    raw = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))

    def back(batches):
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([v.decode(x.as_py()) for x in b.column("ids")], pa.string())], names=["doc_id", "decoded"])

    return raw.mapInArrow(back, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, decoded string")
