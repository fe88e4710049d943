"""Chat formatting: segments encoded apart, reserved ids between them, masks by prefix sums."""
from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Control strings of the template, in the order of their reserved ids.
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
BEGIN, OPEN, BODY, CLOSE = range(4)
TRAINED_ROLE = "assistant"
ESCAPE = "\\"
_ESCAPED = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_BACK = re.compile(r"\\(\\)|\\")


def escape(text: str) -> str:
    """Doubles the escape character and puts one behind the first character of every control string."""
    return _ESCAPED.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1] or "", text)


# The pattern that cuts a text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 512  # turns handled at once


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level tokenizer of a worker from a rank file, and its first free id, where the reserved ids begin."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


PIECES = "conv_id {id}, piece long, start long, ids array<int>, loss array<tinyint>"


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(flat))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and each list's length."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _encoded(batches, path: str):
    """Each turn by itself: its ids with reserved ids spliced in, and its loss mask.

    The turns of a slice are laid end to end. The mask gets +1 where a trained text
    begins and -1 where it ends; the prefix sum of these is the mask.
    """
    t, reserved = encoder(path)
    for b in _slices(batches):
        ids, lengths, marks = [], [], []
        at = 0
        for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
            head, body = t.encode_ordinary(escape(role)), t.encode_ordinary(escape(text))
            if role == TRAINED_ROLE:
                marks.append((at + len(head) + 2, at + len(head) + 2 + len(body)))
            ids += [reserved + OPEN, *head, reserved + BODY, *body, reserved + CLOSE]
            lengths.append(len(head) + len(body) + 3)
            at += lengths[-1]
        delta = np.zeros(at + 1, np.int8)
        for a, z in marks:
            delta[a] += 1
            delta[z] -= 1
        loss = np.cumsum(delta[:-1], dtype=np.int8)
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("turn"), b.column("tie"), _lists(np.array(ids, np.int32), lengths), _lists(loss, lengths)],
            names=["conv_id", "turn", "tie", "ids", "loss"])


def _assembled(batches, reserved: int):
    """Turns in order of conversation and turn: numbers the pieces, keeps the token offset, opens each conversation."""
    conv, piece, start = object(), 0, 0
    for b in _slices(batches):
        (ids, lengths), (loss, _) = _flat(b.column("ids")), _flat(b.column("loss"))
        first, pieces, starts = [], [], []
        for row, (c, n) in enumerate(zip(b.column("conv_id").to_pylist(), lengths.tolist())):
            if c != conv:
                conv, piece, start = c, 0, 0
                first.append(row)
                n += 1
            pieces.append(piece)
            starts.append(start)
            piece, start = piece + 1, start + n
        opened = (np.cumsum(lengths) - lengths)[first]
        lengths[first] += 1
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), pa.array(pieces, pa.int64()), pa.array(starts, pa.int64()),
             _lists(np.insert(ids, opened, reserved + BEGIN).astype(np.int32), lengths), _lists(np.insert(loss, opened, 0).astype(np.int8), lengths)],
            names=["conv_id", "piece", "start", "ids", "loss"])


def format_chats(turns: DataFrame, path: str) -> DataFrame:
    """Rows ``conv_id, piece, start, ids, loss``: the formatted conversations, one piece per turn.

    The pieces of a conversation in order are its token ids; ``start`` is the offset of a
    piece. A turn is ``[INST]`` role ``[/INST]`` text ``</s>``, the first one after ``<s>``;
    these are reserved ids that no text can produce, and the same strings inside roles and
    texts are escaped. The loss mask covers the texts of assistant turns.

    Turns are encoded where they are read; only ids are shuffled. A conversation is
    assembled in one streaming pass over its sorted turns, never held as a whole. Null
    roles and texts are empty; rows with a null ``conv_id`` form one conversation; null
    turns come first and equal turns are ordered by role and text. An empty table gives no
    rows; other columns are ignored.
    """
    raw = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tied = raw.withColumn("tie", F.sha2(F.concat_ws("\n", "role", "text"), 256))
    id_type = raw.schema["conv_id"].dataType.simpleString()
    encoded = tied.mapInArrow(lambda it: _encoded(it, path), f"conv_id {id_type}, turn long, tie string, ids array<int>, loss array<tinyint>")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return ordered.mapInArrow(lambda it: _assembled(it, encoder(path)[1]), PIECES.format(id=id_type))


class _Digest:
    """What is read back of one conversation: hashes and counts, never its text."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self):
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


DIGESTS = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches, path: str, id_type):
    t, reserved = encoder(path)
    now = None

    def batch(rows):
        columns = list(zip(*rows))
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    text_of = lambda ids: t.decode_bytes(ids).decode()
    for b in _slices(batches):
        rows = []
        id_type = b.schema.field("conv_id").type
        (ids, lengths), (loss, _) = _flat(b.column("ids")), _flat(b.column("loss"))
        ends = np.cumsum(lengths)
        controls = np.flatnonzero(ids >= reserved)
        of_row = np.searchsorted(controls, np.concatenate(([0], ends)))
        for row, c in enumerate(b.column("conv_id").to_pylist()):
            here = controls[of_row[row]:of_row[row + 1]]
            kinds = (ids[here] - reserved).tolist()
            if kinds not in ([OPEN, BODY, CLOSE], [BEGIN, OPEN, BODY, CLOSE]):
                raise ValueError("a piece is not one turn")
            opened, body, close = here[-3:].tolist()
            role, text = text_of(ids[opened + 1:body].tolist()), text_of(ids[body + 1:close].tolist())
            span = slice(ends[row] - lengths[row], ends[row])
            masked = ids[span][loss[span] != 0]
            trained = text if np.array_equal(masked, ids[body + 1:close]) else text_of(masked.tolist())
            if now is None or now.conv != c:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(c)
            now.turns += 1
            now.chars += sum(len(CONTROL[k]) for k in kinds) + len(role) + len(text)
            now.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            trained = unescape(trained)
            now.loss_chars += len(trained)
            now.loss.update(trained.encode())
        if rows:
            yield batch(rows)
    if now is not None:
        yield batch([now.row()])


def read_back(pieces: DataFrame, path: str, clustered: bool = False) -> DataFrame:
    """Per conversation what its formatted ids say: turns, digests and lengths.

    A turn's role and text are what its reserved ids enclose; the loss text is what the mask
    selects. ``clustered`` states that the rows come straight from :func:`format_chats`, whose
    partitions hold whole conversations in order; otherwise they are shuffled and sorted. A
    SHA-256 is sequential, so the bytes of one conversation pass through one task, as a
    stream.
    """
    if not clustered:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    id_type = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(lambda it: _read(it, path, None), DIGESTS.format(id=id_type))
