"""What a verdict costs: only what the asked columns need, with unchanged results."""
import os

import pytest

from check import ROOT
from cargolens.operators import classify as C, doctype as D

SF = f"{ROOT}/sf0.001"
MAIL = "email_id string, sender string, subject string, body string, attachments array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def mail(key, *attachments, subject="documents", body="see attached"):
    return (key, "a@b.com", subject, body, list(attachments))


def test_other_rules_are_asked_only_without_both_documents(spark):
    mails = [mail("both", "x_SI.txt", "x_BL.txt", subject="congrat winner: click here", body="unsubscribe"), mail("asks", "x_SI.txt", "x_BL.txt", subject="submit SI"),
             mail("spam", subject="congrat winner: click here", body="unsubscribe"), ("none", None, None, None, None), mail("one", "x_SI.txt", body="please confirm"),
             ("gap", "a@b.com", "hello", "x", [None, "x_SI.txt"])]
    df = C.classify(spark.createDataFrame(mails, MAIL))
    assert {r.email_id: (r.category, r.confidence) for r in df.collect()} == {
        "both": ("BL_COMPARISON", 0.95), "asks": ("SI_REQUEST", 0.95), "spam": ("SPAM", 0.9), "none": ("GENERAL", 0.6), "one": ("BL_COMPARISON", 0.7), "gap": ("GENERAL", 0.6)}
    text = plan(df)
    assert 0 < text.index("both documents attached") < text.index("congrat")


def test_the_looser_tier_is_asked_only_where_the_first_finds_none(spark):
    names = [("a", ["in/x_SI.txt", "x_BL.pdf"]), ("b", ["SI form.doc", "y_bl.TXT"]), ("c", ["x_SI.frombody.txt", "Shipping-Instruction.pdf", "draft bl.pdf"]), ("d", ["si and bl.pdf", None]), ("e", None)]
    df = D.with_pair(spark.createDataFrame(names, "email_id string, attachments array<string>"))
    assert {r.email_id: (r.si_path, r.bl_path) for r in df.collect()} == {
        "a": ("in/x_SI.txt", "x_BL.pdf"), "b": ("SI form.doc", "y_bl.TXT"), "c": ("Shipping-Instruction.pdf", "draft bl.pdf"), "d": (None, None), "e": (None, None)}
    assert "tier2" not in plan(df)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_score_of_planted_defects_reads_their_documents_only(spark):
    import __spark_entry__ as entry
    df = entry.queries()["evl4_caught"](spark, SF)
    assert "LeftSemi" in plan(df) and df.count() > 0
