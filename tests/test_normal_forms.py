"""Normalised forms are worked out where two printed values differ, with unchanged outcomes."""
from pyspark.sql import functions as F

from cargolens import rules
from cargolens.functions import text as T
from cargolens.operators import compare as K, extract as X

TEXTS = [None, "ACME SDN BHD", "ACME", "ACMF", "AB CO", "CO LTD", "PORT KLANG (MYPKG)", "PORT KLANG", "PORT  KLANG", "KLANG (MYPKG)", "(MYPKG)", "-"]
NUMBERS = [None, 1.0, 1.0005, 2.0, float("nan"), float("inf")]


def test_outcomes_are_those_of_the_normalised_values(spark):
    for field in rules.ALL_FIELDS:
        kind, values = ("double", NUMBERS) if field == "gross_weight_kg" else ("bigint", [None, 1, 2]) if field == "container_count" else ("string", TEXTS)
        df = spark.createDataFrame([(a, b) for a in values for b in values], f"a {kind}, b {kind}")
        a, b = F.col("a"), F.col("b")
        rows = df.select("a", "b", K.match_as_printed(field, a, b).alias("got"), K.match_of(field, X.normal_value(field, a), X.normal_value(field, b)).alias("want")).collect()
        assert [r for r in rows if r.got != r.want] == [] and {r.got for r in rows} >= {"MATCH", "DIFF", "UNDECIDABLE"}


def test_verdicts_normalise_no_value_of_a_single_document(spark):
    si = "SHIPPING INSTRUCTION\nShipper: {}\nConsignee: B PTE LTD\nNotify: B PTE LTD\nPOL: KLANG (MYPKG)\nPOD: HAIPHONG\nTotal Containers: 2\nGross Weight: 5 KG"
    docs = spark.createDataFrame([("a_SI.txt", si.format("ACME SDN BHD")), ("a_BL.txt", si.format("ACME")[len("SHIPPING INSTRUCTION\n"):]),
                                  ("b_SI.txt", si.format("ACME")), ("b_BL.txt", si.format("OTHER HOUSE")[len("SHIPPING INSTRUCTION\n"):])], "path string, text string")
    mails = spark.createDataFrame([(k, "x@y.com", "docs", "see attached", [f"{k}_SI.txt", f"{k}_BL.txt"]) for k in "ab"],
                                  "email_id string, sender string, subject string, body string, attachments array<string>")
    v = K.verdicts(mails, docs).select("email_id", "status", "defect_fields")
    assert {r.email_id: (r.status, r.defect_fields) for r in v.collect()} == {"a": ("OK", []), "b": ("MISMATCH", ["shipper"])}
    plan, legal = v._jdf.queryExecution().optimizedPlan().toString(), T.LEGAL_SUFFIXES[:30]
    assert legal in plan and legal not in plan[plan.index("Join"):]
