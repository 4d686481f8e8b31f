"""Lenient values, names and format checks, as expressions and Python twins."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: What is taken out of a number before it is read.
NUMBER_NOISE = r"[,$€£¥₹\s]"
#: Words for true and false.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1", "y"), ("false", "no", "0", "n")
#: Formats of values.
EMAIL = r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$"
URL = r"(?i)^(https?://)?([\w-]+\.)+[a-z]{2,}(:\d+)?([/?#]\S*)?$"
PHONE_CHARS = r"^[0-9+()\-.\s/extEXT]+$"
#: Names of text columns that call for a check of their own.
EMAIL_NAME = r"(?i)e-?mail"
PHONE_NAME = r"(?i)(phone|mobile|cell|fax|telephone|\btel\b|whatsapp|contact[\s_-]?(number|no|num|phone|mobile))"
ID_NAME = r"(?i)(\bid\b|_id|number|\bno\b|\bnum\b|reference|\bref\b|\bcode\b|sku|account)"
#: Digits of a phone number; words and characters of an identifier.
PHONE_RANGE, ID_WORDS, ID_CHARS = (7, 17), 4, 64
#: Longest physical name.
NAME_CHARS = 63


def parse_number(text: Column) -> Column:
    """A number without currency signs, commas and white space; null if it isn't
    one. Spellings only Spark reads (hexadecimal, ``inf``, suffixes) are null."""
    plain = F.regexp_replace(text, NUMBER_NOISE, "")
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def parse_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def number_text(value: Column) -> Column:
    """A double as text: whole numbers without decimals."""
    whole = (value == F.rint(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def sanitize_name(name: Column) -> Column:
    """A physical name: lower case, other characters than letters, digits,
    underscores and white space dropped, white space to single underscores, one
    underscore off either end, cut to 63; ``unnamed_column`` if nothing is left."""
    out = F.regexp_replace(F.lower(name), r"[^a-z0-9_\s]", "")
    out = F.regexp_replace(F.regexp_replace(F.trim(out), r"\s+", "_"), "_+", "_")
    out = F.substring(F.regexp_replace(F.regexp_replace(out, "^_", ""), "_$", ""), 1, NAME_CHARS)
    return F.when(F.coalesce(out, F.lit("")) == "", "unnamed_column").otherwise(out)


def sanitized(name: str | None) -> str:
    """``sanitize_name`` for schema work on the driver."""
    out = re.sub(r"[^a-z0-9_\s]", "", (name or "").lower(), flags=re.ASCII)
    out = re.sub(r"_+", "_", re.sub(r"\s+", "_", out.strip()))
    return re.sub(r"_$", "", re.sub(r"^_", "", out))[:NAME_CHARS] or "unnamed_column"


def table_name(collection_id: str, entity: str | None = None) -> str:
    main = "data_" + collection_id.replace("-", "_")
    return main if entity is None else f"{main}_{sanitized(entity)}"


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def is_iso_date(text: Column) -> Column:
    plain = F.trim(text)
    return plain.rlike(r"^\d{4}-\d{2}-\d{2}$") & plain.try_cast("date").isNotNull()


def is_email(text: Column) -> Column:
    return F.trim(text).rlike(EMAIL)


def is_url(text: Column) -> Column:
    return F.trim(text).rlike(URL)


def is_phone(text: Column) -> Column:
    folded = F.translate(text, "–—", "--")
    return F.length(F.regexp_replace(text, r"\D", "")).between(*PHONE_RANGE) & folded.rlike(PHONE_CHARS)


def is_identifier(text: Column) -> Column:
    return (
        (F.length(text) <= ID_CHARS)
        & ~text.contains("\n")
        & (F.size(F.split(text, r"\s+")) <= ID_WORDS)
        & text.rlike(r"\d|\p{L}")
    )


def validate_value(text: Column, typed: Column, kind: Column, name: Column) -> Column:
    """``valid``, ``invalid`` or ``n/a``. ``text`` is the value as text (null
    where there is none), ``typed`` whether it already has its column's numeric
    or boolean type, ``kind`` the logical type, ``name`` the column's name."""
    word = lambda ok: F.when(ok, "valid").otherwise("invalid")
    plain = F.trim(text)
    by_name = (
        F.when((plain == "") | name.isNull(), "n/a")
        .when(name.rlike(EMAIL_NAME), word(is_email(plain)))
        .when(name.rlike(PHONE_NAME), word(is_phone(plain)))
        .when(name.rlike(ID_NAME), word(is_identifier(plain)))
        .otherwise("n/a")
    )
    return (
        F.when(text.isNull() | (kind == "entity_array"), "n/a")
        .when(kind.isin("number", "currency", "boolean"), word(typed))
        .when(kind == "date", word(is_iso_date(text)))
        .when(kind == "email", word(is_email(text)))
        .when(kind == "url", word(is_url(text)))
        .otherwise(by_name)
    )


def safe_filename(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_-]", "_", name)[:50]


def introduces_unknown_number(phrasing: Column, facts: Column) -> Column:
    """Whether a phrasing holds a numeral that the facts don't."""
    return F.exists(F.regexp_extract_all(phrasing, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda n: ~facts.contains(n))
