"""Fields found by searches over the whole text are those of the line by line form."""
import random

from pyspark.sql import functions as F

from cargolens import rules
from cargolens.operators import extract as X

LABELS = ["Shipper", "consignee", "Notify Party", "notify (a:b)", "POL", "Port of Loading (POL)", "POD:", "load port", "Discharge Port", "containers:", "Total Containers",
          "No. of Containers", "ETA / ETD", "etd/eta", "ETD", "ETA", "gross weight (kgs)", "G.W.", "Shipper / Exporter", "Notify Party/Intermediate Consignee", "betas",
          "place  of\treceipt", "same as consignee", "port\u001fof loading", "notified party", "poland"]
SEPARATORS = [": ", ":", " | ", "|", "\t", " - ", "：", " ", "", "\t|", "  ", " in kgs: ", " name: "]
VALUES = ["ACME LTD", "TBA", "", "  ", "5 x 40HC", "12,000 KG", "22.5 MT", "2026-03-04", "05/03/2026", "BUSAN, KOREA (KRPUS)", "x; 5 Road", "nıl", "ABCU1234567", "　Foo　", "POD x", "Notify: X"]
ENDS = ["\n", "\n", "\n", " ", "  ", "\r\n", "\n\n", "\x0b", " ", "\n \t\n", "\x85", "\n \n", "\t"]


def texts(n):
    rng = random.Random(11)
    for _ in range(n):
        glue = rng.choice([None, None, " ", " / "])
        yield "".join(rng.choice(["", "", "\t", "x ", "as "]) + rng.choice([*LABELS, ""]) + rng.choice(SEPARATORS) + rng.choice(VALUES) + (glue or rng.choice(ENDS))
                      for _ in range(rng.randrange(12)))


def test_fields_are_those_of_the_line_by_line_form(spark):
    odd = [None, "", "\n", "Shipper: A\x0eB\nPOD: X", "POL: TBA\nPOL: BUSAN", "Shipper:\n\nPOL: X", "final destination\t| ", "_Shipper: A POL: B"]
    df = spark.createDataFrame([(t,) for t in [*texts(4000), *odd]], "text string").withColumn("unreadable", F.lit(False)).repartition(8)
    rows = X.with_fields(df).withColumn("lines", X.fields_of(F.col("text"))).collect()
    assert len(rows) == 4008 and sum(any(r.lines) for r in rows) > 3000
    assert [r.text for r in rows if r.fields != r.lines] == []


def test_most_texts_are_not_read_in_lambdas(spark):
    """A collapsed text is cut by searches: only odd ones, which are few, go through the folds over lines."""
    text = "SHIPPING INSTRUCTION Shipper: ACME Consignee (Non-Negotiable): BUYER Port of Loading (POL): A (ABCDE) POD: B Total Containers: 3 x 40HC Gross Wt (kgs): 500 KG ETD: 2026-03-04"
    df = spark.createDataFrame([(text,)], "t string").withColumn("o", F.regexp_replace("t", F.lit(X.OPENING), F.lit(X.OPENING_MARKS)))
    r = df.select(F.col("t").rlike(X.LETTERS_AND_SEPARATORS).alias("may"), (~F.col("o").rlike(X.PLAIN_OPENINGS) | F.col("o").rlike(X.FIELD_TWICE)).alias("odd"), X._cut(F.col("o")).alias("cut"),
                  X.segments(F.col("t")).alias("lines")).first()
    assert r.may and not r.odd and [x for x in r.cut.split("\n") if x] == r.lines and len(r.lines) == 8
    assert not spark.createDataFrame([("\tShipper: A\n Booking: 5\n\tPOL: B",)], "t string").select(F.col("t").rlike(X.LETTERS_AND_SEPARATORS)).first()[0]


def test_no_label_of_another_field_begins_inside_a_label(spark):
    """Openings take their label along, so places inside of it are not looked at."""
    words = {f: [p.replace(r"\s*", " ").replace(r"\s+", " ").replace(r"\b", "").replace("\\.?", ".").replace("(?:", "(").replace("?", "") for p in ps] for f, ps in rules.LABELS.items()}
    inner = [(f, w[i + 1:]) for f, ws in words.items() for w in ws for i, c in enumerate(w) if not c.isalnum() and w[i + 1:]]
    df = spark.createDataFrame(inner, "f string, rest string")
    hits = [F.when((F.col("f") != g) & F.col("rest").rlike(f"(?i)^(?:{X.ALTERNATION[g]})"), F.lit(g)) for g in rules.ALL_FIELDS]
    assert df.select("f", "rest", F.array_compact(F.array(*hits)).alias("g")).filter("size(g) > 0").collect() == []
