"""Golden rows for the scalar functions and extraction."""
import pytest
from pyspark.sql import functions as F

from cargolens.functions import text as T
from cargolens.operators import extract as X, doctype as DT


def one(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_container_counts(spark):
    got = one(spark, T.container_count, "6 x 40'HC", "1x40HC + 2x20GP", "1x40HC and 1x20GP", "ABCU1234567", "06", "none", "22,000 kg")
    assert got == [6, 3, 2, None, 6, None, 22000]


def test_weights(spark):
    got = one(spark, T.weight_kg, "22,000.00 KGS", "22.5 MT", "131 058 KG", "22.000 KG", "GW: 500 KG", "ABOUT 22000MT", "1.234.567", "x")
    assert got == [22000.0, 22500.0, 131058.0, 22.0, 500.0, None, None, None]


def test_dates(spark):
    got = one(spark, T.iso_date, "15 MAR 2026", "2026-03-15", "March 15, 2026", "05/01/2026", "31/02/2026", "TBA")
    assert got == ["2026-03-15"] * 3 + ["2026-01-05", None, None]


def test_names_and_ports(spark):
    assert one(spark, T.norm_name, "East Bright FZ-LLC", "ACME Sdn. Bhd.", "AB Co. Ltd") == ["EAST BRIGHT", "ACME", "AB CO LTD"]
    assert one(spark, T.norm_port, "Nantong, China (CNNTG)", "nantong china") == ["NANTONG CHINA CNNTG", "NANTONG CHINA"]


def test_subjects_and_keys(spark):
    assert one(spark, T.clean_subject, "Re: Fwd: [FW] hello", "RE:") == ["hello", "RE:"]
    assert one(spark, T.label_from_key, "PortOfLoading", "port_of_loading", "SHPNumber") == ["Port Of Loading", "port of loading", "SHP Number"]


def test_document_names(spark):
    got = one(spark, DT.si_bl_of, "Draft_BL_v2.xlsx", "SI_and_BL.pdf", "Shipping_Instruction_PO1.pdf", "si.exe", "SILVER.pdf")
    assert got == ["BL", None, "SI", None, None]


def test_titles_that_hold_a_label(spark):
    titles = ["BILL OF LADING DETAILS", "COMMERCIAL INVOICE (RETAIL)", "CONTAINER BILL OF LADING", "SHIPPER'S SHIPPING INSTRUCTION", "BILL OF LADING - CONSIGNEE COPY"]
    got = one(spark, DT.declared_type, *[t + "\nShipper: ACME\nwith the packing list" for t in titles], "Shipper: BILL OF LADING HOUSE\nPACKING LIST", "Shipper\tBILL OF LADING HOUSE\nPACKING LIST")
    assert got == ["BL", "INVOICE", "BL", "SI", "BL", "PACKING_LIST", "PACKING_LIST"]


def test_invoice_total_below_its_label(spark):
    got = one(spark, X.invoice_fields, "Grand total:\nUSD 4,500.00", "Total amount (USD):\r\n  4,500.00", "Total in words: FIVE HUNDRED\nDate: 12 May\nGrand total: 500.00", "Total:\n\n\nno amount")
    assert [r["total_amount"] for r in got] == ["4500.00", "4500.00", "500.00", None]


def fields(spark, text):
    return one(spark, X.fields_of, text)[0].asDict()


def test_next_line_and_empty_label(spark):
    f = fields(spark, "Port of Loading (POL)\n\n  NHAVA SHEVA, INDIA\nCONSIGNEE:\nNotify: CLIFFORD PAPER INC\nShipper | ACME; Road 5")
    assert f["port_of_loading"] == "NHAVA SHEVA, INDIA" and f["consignee"] is None
    assert f["notify_party"] == "CLIFFORD PAPER INC" and f["shipper"] == "ACME"


def test_collapsed_line_is_split_per_label(spark):
    text = ("SHIPPING INSTRUCTION Shipper: ACME PAPER Consignee: BUYER HOUSE Notify Party: OTHER HOUSE Port of Loading: A TOWN "
            "Port of Discharge: B TOWN Total Containers: 3 x 40HC Gross Weight: 22,000 KG")
    f = fields(spark, text)
    # "BUYER" is a consignee label too, but each field opens one piece only.
    assert f["shipper"] == "ACME PAPER" and f["port_of_loading"] == "A TOWN"
    assert f["container_count"] == 3 and f["gross_weight_kg"] == 22000.0


@pytest.mark.parametrize("field, line, want", [
    ("notify_party", "Notify Party: SAME AS CONSIGNEE", "SAME AS CONSIGNEE"),
    ("shipper", "Shipper: Metal Works Ltd", "METAL WORKS LTD"), ("consignee", "Consignee: Beta Trading", "BETA TRADING"), ("shipper", "Shipper: Vegetable Oils", "VEGETABLE OILS")])
def test_values_that_hold_a_label_stay_whole(spark, field, line, want):
    assert fields(spark, line)[field] == want


def test_labels_with_brackets_and_slashes_open_pieces(spark):
    f = fields(spark, "Shipper/Exporter: METAL HOUSE Consignee (Non-Negotiable): BETA HOUSE Notify Party/Intermediate Consignee: OTHER HOUSE Port of Loading (POL): A TOWN Gross Wt (kgs): 500 KG ETA: 2026-04-15")
    assert (f["shipper"], f["consignee"], f["notify_party"], f["port_of_loading"]) == ("METAL HOUSE", "BETA HOUSE", "OTHER HOUSE", "A TOWN")
    assert f["gross_weight_kg"] == 500.0 and f["eta"] == "2026-04-15"


def test_the_first_look_at_a_line_loses_no_split(spark):
    """Whatever holds two labels with separators passes the linear test for two separators."""
    import random
    from cargolens.operators import extract as X
    rng = random.Random(5)
    parts = ["Shipper", "consignee", "Notify (a:b)", "POL", "containers:", "ETA / ETD", "gross weight (kgs)", ":", "：", "|", "\t", " ", "x", "\u0085", "/", "and address", "12"]
    lines = spark.createDataFrame([("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))),) for _ in range(20000)], "l string")
    both = lines.where(F.col("l").rlike(X.TWO_LABELS))
    assert both.count() > 200 and both.where(~F.col("l").rlike(X.TWO_SEPARATORS)).count() == 0


@pytest.mark.parametrize("value", ["TBA", "N/A", "____MT", "to be advised"])
def test_placeholders(spark, value):
    assert fields(spark, f"Shipper: {value}")["shipper"] is None
