import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import text, values


def one(spark, expression, **row):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("1,234.50 and 31,48,250", {1234.5, 3148250.0}), ("1,2,3", {1.0, 2.0, 3.0}), ("(-) 1,70,870", {170870.0, -170870.0}),
        ("(6-7) 8", {6.0, 7.0, -7.0, 8.0}), ("( 42 )", {42.0, -42.0}), ("- 5", {5.0, -5.0}), ("none", set()), ("", set()),
    ],
)
def test_numbers_in(spark, given_text, expected):
    assert set(one(spark, text.numbers_in(F.col("t")), t=given_text)) == expected


def window_model(phrase, hay):
    """Words of the phrase with their counts within twice its length, by trying all windows."""
    if phrase in hay:
        return True
    need, words = phrase.split(), hay.split()
    if len(need) < 2:
        return False
    spans = [words] if len(need) >= 6 else [words[k : k + 2 * len(need)] for k in range(max(1, len(words)))]
    return any(all(s.count(w) >= need.count(w) for w in need) for s in spans)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.lists(st.sampled_from("abcde"), max_size=14))
def test_phrase_in_agrees_with_all_windows(spark, phrase, hay):
    p, h = " ".join(phrase), " ".join(hay)
    got = one(spark, text.phrase_in(F.col("p"), F.col("h"), text.words_of(F.col("h"))), p=p, h=h)
    assert got == window_model(p, h)


def test_phone_and_keys(spark):
    assert one(spark, text.phone_in(F.col("a"), text.digits_only(F.col("b"))), a="+91 8919584215", b="tel 00918919584215")
    assert not one(spark, text.phone_in(F.col("a"), text.digits_only(F.col("b"))), a="123-45", b="12345")
    assert one(spark, text.match_key(F.col("a")), a="Total Income_2") == "totalincome2"
    assert one(spark, text.title_case(F.col("a")), a="income_tax-reTURN") == "Income Tax ReTURN"


@pytest.mark.parametrize("raw, expected", [("$1,234.50", 1234.5), ("₹ 12", 12.0), ("€ 1.234", 1.234), ("inf", None), ("1.5d", None), ("0x1F", None), ("", None), (None, None), ("-3e2", -300.0)])
def test_parse_number(spark, raw, expected):
    assert one(spark, values.parse_number(F.col("t")), t=raw) == expected


@pytest.mark.parametrize("raw, expected", [("Yes", True), ("0", False), (" yes", None), (None, None)])
def test_parse_boolean(spark, raw, expected):
    assert one(spark, values.parse_boolean(F.col("t")), t=raw) == expected


@pytest.mark.parametrize("raw, expected", [("Total Amount ($)", "total_amount"), ("_row_id", "row_id"), ("  ", "unnamed_column"), ("é", "unnamed_column"), ("a" * 70, "a" * 63), ("A__b  c", "a_b_c")])
def test_sanitize_name_and_its_twin(spark, raw, expected):
    assert one(spark, values.sanitize_name(F.col("t")), t=raw) == expected == values.sanitized(raw)


@pytest.mark.parametrize(
    "value, kind, name, expected",
    [
        ("2026-02-28", "date", "D", "valid"), ("2026-02-31", "date", "D", "invalid"), ("2026", "date", "D", "invalid"), ("a@b.co", "email", "E", "valid"), ("a@b", "email", "E", "invalid"),
        ("linkedin.com/in/x", "url", "U", "valid"), ("not a url", "url", "U", "invalid"), ("+1 (555) 123-4567", "text", "Phone", "valid"), ("call me", "text", "Mobile", "invalid"),
        ("INV-7", "text", "Invoice Number", "valid"), ("one two three four five", "text", "Order no", "invalid"), ("x", "text", "Title", "n/a"), (None, "text", "Email", "n/a"), ("a@b.co", "text", "E-mail", "valid"),
    ],
)
def test_validate_value(spark, value, kind, name, expected):
    assert one(spark, values.validate_value(F.col("v"), F.lit(False), F.col("k"), F.col("n")), v=value, k=kind, n=name) == expected


def test_number_text_and_guard(spark):
    assert one(spark, values.number_text(F.col("v")), v=1234.0) == "1234" and one(spark, values.number_text(F.col("v")), v=0.5) == "0.5"
    assert one(spark, values.introduces_unknown_number(F.col("p"), F.col("f")), p="In total 42", f="41 rows")
    assert not one(spark, values.introduces_unknown_number(F.col("p"), F.col("f")), p="All 41", f="41 rows")


def test_names():
    assert values.table_name("a-b") == "data_a_b" and values.table_name("a-b", "Line Items") == "data_a_b_line_items"
    assert values.escape_like(r"1%_\ ") == r"1\%\_\\ " and values.safe_filename("a b/ç.csv") == re.sub(r"[^\w-]", "_", "a b/ç.csv", flags=re.ASCII)
