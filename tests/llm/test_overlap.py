"""Overlapping spans are masked as a whole."""

from itemloom.llm import pii


def test_no_tail_is_left(spark):
    # The address's last digit begins a card number; the phone number's tail begins an email.
    rows = [(1, "from 10.0.0.4 111111111111111 on"), (2, "at +1 (234) 555-1234.me@b.co now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.redact(pii.find_spans(df)).collect()}
    assert len(got[1].spans) == 2 and got[1].text == "from [IP] on"
    assert len(got[2].spans) == 2 and got[2].text == "at [PHONE] now"
