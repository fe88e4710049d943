"""What extraction does per line: as few searches as the result needs, with unchanged results."""
from pyspark.sql import functions as F

from cargolens import rules
from cargolens.functions import text as T
from cargolens.operators import evaluate as E, extract as X

ONE_LINE = "BILL OF LADING Shipper: ACME LTD Consignee: BUYER CO POL: BUSAN (KRPUS) eta/etd: 2026-03-04 Gross Weight: 5 KG"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_class_is_the_spelled_out_list(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string")
    found = {r.c for r in every.filter(F.col("c").rlike(T.WS)).collect()}
    assert found == set(T.WS_CHARS)
    assert {r.c for r in every.filter(F.col("c").rlike(T.ODD_WS)).collect()} == found - {" "}


def test_a_binding_takes_no_element_of_a_transform(spark):
    """An element of a transform asks for the type of the whole body at each row."""
    df = spark.range(1).select(T.let(F.col("id") + 1, lambda x: x * x).alias("v"))
    assert "transform(" not in plan(df) and df.first().v == 1


def test_one_pass_finds_the_openings_of_all_fields(spark):
    df = spark.createDataFrame([(ONE_LINE,)], "text string")
    pieces = df.select(X.segments(F.col("text")).alias("s"))
    assert "regexp_extract_all" not in plan(pieces)
    assert pieces.first().s == ["BILL OF LADING ", "Shipper: ACME LTD ", "Consignee: BUYER CO ", "POL: BUSAN (KRPUS) ", "eta/etd: 2026-03-04 ", "Gross Weight: 5 KG"]


def test_a_variant_is_worked_out_in_its_own_row_only(spark):
    docs = spark.createDataFrame([("m", "SI", "p", ONE_LINE)], "email_id string, doc_type string, path string, text string")
    rows = E.perturbed(docs)
    assert {r.perturbation for r in rows.collect()} == {"base", *E.PERTURBATIONS}
    made = [line for line in plan(rows.filter("perturbation = 'base'")).splitlines() if "Generate" in line]
    assert made and not any("md5" in line for line in made)


def test_labels_are_found_without_squeezing_the_line(spark):
    """Wide and odd white space inside a label, ties and label parts on raw and squeezed lines."""
    labels = ["port  of loading", "Place\tof delivery", "eta / etd", "betas", "G.W.", "_POL", "no. of  containers", "gross weight", "none", "NOTIFIED  PARTY"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    got = df.select(X.label_of(F.col("l")).alias("raw"), X.label_of(T.squeeze(F.col("l"))).alias("squeezed")).collect()
    names = [None if r.raw is None else rules.ALL_FIELDS[r.raw] for r in got]
    assert names == ["port_of_loading", "port_of_discharge", "etd", "eta", "gross_weight_kg", None, "container_count", "gross_weight_kg", None, "notify_party"]
    assert all(r.raw == r.squeezed for r in got)


def test_short_white_space_class_is_the_same(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string")
    assert {r.c for r in every.filter(F.col("c").rlike(T.SHORT_WS)).collect()} == set(T.WS_CHARS)
    assert T.WS not in X.LABEL


def test_a_tidy_value_is_searched_once_with_the_same_result(spark):
    values = ["ACME LTD", "tba", "nıl", "nıl ", "Foo  Bar", "Notify: X", "X; 5 Road", "xxx kgs", "", "-", "pod: BAR", "\xa0Foo ", " \t"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(T.strip(F.col("v")).alias("s"), T.bare(F.col("v")).alias("b"))
    s = F.col("s")
    rows = df.select("s", "b", T.blank_to_null(T.name_value(s)).alias("n"), T.value_or_null(T.clean_name(s)).alias("n0"),
                     T.blank_to_null(T.port_value(s)).alias("p"), T.value_or_null(T.clean_port(s)).alias("p0")).collect()
    assert all(r.s == r.b and r.n == r.n0 and r.p == r.p0 for r in rows) and rows[2].n is None


def test_a_value_below_its_label_skips_blank_lines(spark):
    text = "Shipper:\n\xa0\n\t\nACME LTD\nPOL:\n\nPOD: X\nGross Weight: 1.,2 tonnes"
    lines = X.lines_of(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(X.sources_of(lines).alias("s"), X.fields_of(F.col("t")).alias("f")).first()
    assert [(x.ln, x.ord, x.src) for x in got.s] == [(1, 0, "ACME LTD"), (5, 3, None), (7, 4, "X"), (8, 6, "1.,2 tonnes")]
    assert got.f.shipper == "ACME LTD" and got.f.port_of_loading is None and got.f.gross_weight_kg == 1200.0
    # Lines are not made into structs to leave out the blank ones: ink is asked for only below a label without a value.
    made = plan(spark.createDataFrame([(text,)], "t string").select(X.sources_of(lines)))
    assert made.count("slice(") == made.count(T.INK) > 0
