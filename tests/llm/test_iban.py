"""IBANs with other words after them."""

import pytest

from tessera.llm import pii

IBANS = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
AFTER = ["", ".", " ok", " BIC COBADEFFXXX", " A note", " 12", " EUR 100", " AB12 3456", "\nGB82"]


@pytest.mark.parametrize("before", ["", "é🎉 to ", "REF AB12 3456 7890 123 ", "DE12 AB "])
def test_iban_is_found_whatever_follows(spark, before):
    texts = [before + i + a for i in IBANS for a in AFTER]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [(len(before), len(before) + len(i)) for i in IBANS for _ in AFTER]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["iban"]] for r in rows}
    assert [got[k] for k in range(len(texts))] == [[w] for w in want]


def test_what_is_no_iban(spark):
    texts = ["DE89 3704 0044 0532 0130 01", "DE89 3704 0044 0532 0130 00X", "XDE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130", "DE89"]
    assert [r["iban"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == [[]] * 5
    two = pii.redact(spark.createDataFrame([(0, f"{IBANS[0]} {IBANS[1]} {IBANS[2]} x")], "doc_id long, text string"))
    assert two.first()["text"] == "[iban] [iban] [iban] x"
