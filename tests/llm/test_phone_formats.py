"""Phone numbers of several countries, and numbers that only look like them."""

from concord.llm import pii

PHONES = ["06 12 34 56 78", "01.23.45.67.89", "612 34 56 78", "912 345 678", "030 12345678", "0171-2345678", "(030) 1234567", "030/1234567", "2125550187", "(212) 555-0187", "212-555-0187"]
OTHERS = ["on 12.05.2023 we met", "the date 2023-05-12 was set", "a total of 1 250 000 units", "order 2125550187 was sent", "isbn 978-3-16-148410-0", "from 1990-1995 on", "invoice 212.555.018 of order"]


def test_phones_of_several_countries(spark):
    texts = [f"{cue} {phone} today" for cue in ("please call", "tel:", "Tél.", "mobile", "Telefon", "fax") for phone in PHONES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.redact(df).orderBy("doc_id").collect()]
    assert [(t, o) for t, o in zip(texts, out) if any(c.isdigit() for c in o)] == []  # dotted pairs begin with an address, whose kind names the joint span


def test_other_numbers_stay(spark):
    df = spark.createDataFrame(list(enumerate(OTHERS)), "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == OTHERS
