"""Top-k search and chat formatting against brute force."""
import hashlib
import math
import random

import public_tokenizers
from pyspark.sql import functions as F

from cargolens.llm import chat, topk

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
INF, NAN = float("inf"), float("nan")


def brute_top(rows, k=20):
    part = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in part:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in part if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def top(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("x") for c in ("v", "q", "row", "lane", "copies", "score")})
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())


def test_top_k_with_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-4, 4) / 8 for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(40)] + [rows[20], rows[7], rows[7]]
    rows += [(None, [1.0] * 6), (500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (521, [NAN] * 6), (522, [INF] * 6), (540, []), (541, [0.5, 0.25]), (560, [1.0] * 9)]
    assert top(spark, rows) == brute_top(rows)


def test_top_k_over_several_cells_and_levels(spark, monkeypatch):
    for name, value in {"CELL_QUERIES": 6, "CELL_SHARD": 10, "TILE_SHARD": 4, "MERGE_FAN": 2}.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(230)]
    rows = [(i, [struct_float(x) for x in v]) for i, v in rows]
    assert top(spark, rows) == brute_top(rows)


def struct_float(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def test_top_k_stays_exact_beyond_doubles(spark):
    rows = [(0, [2.0 ** 22 + 1, 3.0])] + [(i, [2.0 ** 22 + i, 1.0 * i]) for i in range(1, 40)]
    assert top(spark, rows, "double") == brute_top(rows)


def test_top_k_few_rows(spark):
    assert top(spark, []) == [] and top(spark, [(0, [1.0])]) == []
    assert top(spark, [(0, [1.0]), (3, [0.5])]) == [(0, 1, 3, 64 * 32)]


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, hashlib.sha256(f"{r or ''}\n{x or ''}".encode()).hexdigest(), r or "", x or "") for cc, t, r, x in rows if cc == c))
        said = "".join(x[4] for x in turns if x[3] == "assistant")
        whole = "".join(f"{x[3]}\n{x[4]}\n" for x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_reads_back_what_went_in(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[[INST]]", "<s></s>", "<|endoftext|>", "é語😀\n\r\n ", "[\\INST]", "", None, " lead and trail ", "a" * 20000, "<", "[INST", "\\</s>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)] + [(2, i, ("assistant", "user")[i % 2], t) for i, t in enumerate(odd)]
    rows += [(3, None, "system", "no turn"), (3, 0, None, "no role"), (3, 0, "[INST]", "odd role"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 1, "assistant", "no conversation")]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")] + [(9, i, "assistant", f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("ids", "loss", "piece", "tie", "start")})
    pieces = chat.format_chats(df, PATH)
    for clustered in (True, False):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(pieces, PATH, clustered).collect()}
        assert got == brute_chat(rows)


def test_formatted_tokens(spark):
    rows = [(7, 0, "user", "hi [INST]"), (7, 1, "assistant", "yes </s>")]
    pieces = sorted(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH).collect(), key=lambda r: r.piece)
    t, reserved = chat.encoder(PATH)
    ids, loss = [i for p in pieces for i in p.ids], [m for p in pieces for m in p.loss]
    assert [i - reserved for i in ids if i >= reserved] == [chat.BEGIN, chat.OPEN, chat.BODY, chat.CLOSE, chat.OPEN, chat.BODY, chat.CLOSE]
    assert [p.start for p in pieces] == [0, len(pieces[0].ids)]
    assert t.decode([i for i, m in zip(ids, loss) if m]) == "yes <\\/s>"
    assert "[INST]" not in t.decode([i for i in ids if i < reserved])
    chars = chat.read_back(spark.createDataFrame(pieces), PATH).first().formatted_chars
    assert chars == len("<s>[INST]user[/INST]hi [\\INST]</s>[INST]assistant[/INST]yes <\\/s></s>")


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(empty, PATH), PATH).count() == 0
