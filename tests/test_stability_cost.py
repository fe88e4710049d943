"""What the perturbation study works out per row, with unchanged results."""
from pyspark.sql import functions as F

from cargolens.operators import compare as K, evaluate as E


def test_first_spelling_only_is_swapped(spark):
    text = "POD: A\npod: B\nExporter | C\nBuyer D"
    take = F.lit(True)
    got = spark.createDataFrame([(text,)], "t string").select(E._swapped("pod", "port of discharge", take)(F.col("t")).alias("a"), E._swapped("buyer", "consignee", take)(F.col("t")).alias("b"),
                                                              E._swapped("pod", "port of discharge", F.lit(False))(F.col("t")).alias("c")).first()
    assert got.a == text.replace("POD", "port of discharge", 1) and got.b == got.c == text


def test_a_pattern_of_a_variant_is_the_same_in_every_row(spark):
    df = spark.createDataFrame([("p", "t")], "path string, text string").select(E.perturb(F.col("text"), F.col("path"), "label_synonyms").alias("t"))
    assert r"\b\B" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_normalise_only_what_is_printed_differently(spark):
    read = K.read_documents(spark.createDataFrame([("m", "p", "Shipper: ACME LTD\nPOL: BUSAN (KRPUS)")], "email_id string, path string, text string"))
    pairs = K.compare_pairs(read, read, ["email_id"])
    plan = pairs.select("status", "defect_fields")._jdf.queryExecution().optimizedPlan().toString()
    assert "norm" not in plan and {"si_norm", "bl_norm"} <= set(pairs.columns)
    assert pairs.first().si_norm.port_of_loading.value == "BUSAN KRPUS"
