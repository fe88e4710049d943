"""Small tables with the awkward cases every operator must take: nulls, blanks, long texts, repeats, clashing names."""
import random

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
CLASHING = {"n_words": "x", "kept": "y", "size": "z", "key": "k", "_row": "r", "target": "t", "found": "f", "leader": "l", "rank": "a", "score": "b", "ids": "i", "words": "w"}


def documents(spark, rows, clash=True):
    """Rows of (doc_id, text, source); columns with names that operators use inside are added."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({n: F.lit(v) for n, v in CLASHING.items()}) if clash else df


def awkward():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("the of and to in water stone river light house tree cloud".split()) + rng.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\f\r ", None), (4, "one", None), (None, "null id text", "b"), (5, LONG, "b"), (6, "é ü 語 😀\n\nx", "ä")]
    rows += [(10 + i, prose(60), "abc"[i % 3]) for i in range(12)]
    rows += [(30, rows[8][1], "c"), (30, rows[8][1], "c"), (31, "same line\nsame line\nother\n" * 5, "a"), (32, "a b c d e f g h " * 6, "z")]
    return rows
