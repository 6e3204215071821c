"""Numbers of the plan, of each area and kind, and others."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import fixed_values as V, phones


def _of(spark, texts, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = rows.select("i", phones.phones_in(F.col("t"), **how).alias("p"), phones.has_phone(F.col("t"), **how).alias("h"))
    return [([(p.digits, p.kind) for p in r.p or []], r.h) for r in got.orderBy("i").collect()]


def test_every_code_length_and_kind(spark):
    texts, want = [], []
    for code, after, lengths, kind in V.PHONE_PLAN:
        for n in lengths:
            digits = (code + (after[:1] or "5") + "0123456789")[:n]
            spaced = f"({code}) {digits[len(code):len(code) + 3]}-{digits[len(code) + 3:]}"
            for text in (digits, f"tel {spaced}.", f"+56 {digits}", f"+56{digits}", f"0056{digits}", f"00 56 {spaced}"):
                texts.append(text)
                want.append(([(digits, kind)], True))
            # One digit more or less is no number of this code.
            for wrong in (digits[:-1], digits + "7"):
                if len(wrong) not in lengths:
                    texts.append(f"a {wrong} b")
                    want.append(([], False))
    assert list(zip(texts, _of(spark, texts))) == list(zip(texts, want))


@pytest.mark.parametrize(
    "text",
    [
        "+1 604 699 4000", "+44 22 818 5000", "00 44 22 818 5000", "0044228185000", "Spokane, WA 99201-0301",
        "76 245 1000", "36 245 1000", "24 818 5000", "91 234 5678", "1228185000123", "a22 818 5000", "+22 818 5000",
        "56 245 1000", "", "59 2181 500", "700 123 456", "+56 12 345 6789", "1231 123 4567",
    ],
)
def test_numbers_that_are_not_of_the_plan(spark, text):
    assert _of(spark, [text]) == [([], False)]


def test_several_numbers_in_one_text(spark):
    (found, has) = _of(spark, ["Fono 22 818 5000 / 9 8765 4321, 600 600 1234; +1 604 699 4000; RUT 76.086.428-5"])[0]
    assert found == [("228185000", "fixed"), ("987654321", "mobile"), ("6006001234", "shared_cost")] and has
    assert _of(spark, [None]) == [([], None)]


def test_another_plan(spark):
    plan = [("20", "3478", (10,), "fixed"), ("7", "", (10,), "mobile")]
    texts = ["+44 20 7946 0018", "20 7946 0018", "+56 20 7946 0018", "7911 123456", "+44 22 818 5000"]
    got = _of(spark, texts, plan=plan, country="44")
    assert [p for p, _ in got] == [[("2079460018", "fixed")], [("2079460018", "fixed")], [], [("7911123456", "mobile")], []]
