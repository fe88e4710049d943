"""The evidence of a verdict rests on what its documents look like, not on their fields."""
from cargolens.operators import compare as K, extract as X

SI = "SHIPPING INSTRUCTION\nShipper: ACME LTD\nConsignee: BUYER CO\nNotify: BUYER CO\nPOL: BUSAN (KRPUS)\nPOD: PENANG (MYPEN)\nTotal Containers: 2 x 40'HC\nGross Wt (kgs): 500 KG"
BL = SI.replace("SHIPPING INSTRUCTION", "BILL OF LADING")
MAIL = "email_id string, sender string, subject string, body string, attachments array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def mail(key, *attachments, subject="documents", body="see attached"):
    return (key, "a@b.com", subject, body, list(attachments))


def verdicts(spark):
    mails = [mail(k, f"{k}_SI.txt", f"{k}_BL.txt") for k in ("same", "weight", "blank", "none", "packing")]
    mails += [mail("half", "half_SI.txt", body="please compare the SI and the draft BL")]
    texts = {"same_BL": BL, "weight_BL": BL.replace("500", "700"), "blank_BL": " \n\t\xa0　", "none_BL": None, "packing_BL": BL.replace("BILL OF LADING", "PACKING LIST")}
    docs = [(f"{m[0]}_SI.txt", SI) for m in mails] + [(f"{k}.txt", v) for k, v in texts.items()]
    return K.verdicts(spark.createDataFrame(mails, MAIL), spark.createDataFrame(docs, "path string, text string"))


def test_evidence_of_documents_reads_no_field(spark):
    v = verdicts(spark)
    evidence = v.select("email_id", "missing_documents", "present_documents", "unreadable_documents", "wrong_documents")
    assert X.LABEL in plan(v.select("status")) and X.LABEL not in plan(evidence)
    got = {r.email_id: tuple(",".join(x) for x in r[1:]) for r in evidence.collect()}
    assert got == {"same": ("", "", "", ""), "weight": ("", "", "", ""), "blank": ("", "", "BL", ""), "none": ("", "", "BL", ""),
                   "packing": ("", "", "", "BL"), "half": ("BL", "SI", "", "")}
    assert {r.email_id: (r.status, r.review_reason, r.defect_fields) for r in v.collect()} == {
        "same": ("OK", None, []), "weight": ("MISMATCH", None, ["gross_weight_kg"]), "blank": ("NEEDS_REVIEW", "unreadable", []),
        "none": ("NEEDS_REVIEW", "unreadable", []), "packing": ("NEEDS_REVIEW", "wrong_doc_type", []), "half": ("NEEDS_REVIEW", "missing_attachment", [])}
