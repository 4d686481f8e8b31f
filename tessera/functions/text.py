"""Text matching as Catalyst expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A grouped number, Western or South Asian, and a plain number.
GROUPED = r"(?<![\d,])\d{1,3}(?:,\d{2,3})+(?:\.\d+)?(?![\d,])"
NUMBER = r"\d+(?:\.\d+)?"
#: Digits a phone number needs to be matched by digits alone; how
#: far a phrase's words may lie apart; words from which order doesn't count.
PHONE_DIGITS, WINDOW_SLACK, LONG_PHRASE = 7, 2, 6
#: Two numbers this close are the same.
NUMERIC_EPSILON = 0.005


def normalize_text(text: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def words_of(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D+", "")


def numbers_in(text: Column) -> Column:
    """The distinct numbers a text holds, with separators inside grouped numbers
    removed; a number marked negative also counts with its sign."""
    marked = F.split(F.regexp_replace(text, f"({GROUPED})", "\u0001$1\u0002"), "\u0001")
    joined = F.array_join(
        F.transform(
            marked,
            lambda part: F.when(
                part.contains("\u0002"),
                F.concat(F.regexp_replace(F.substring_index(part, "\u0002", 1), ",", ""), F.substring_index(part, "\u0002", -1)),
            ).otherwise(part),
        ),
        "",
    )
    plain = F.regexp_extract_all(joined, F.lit(f"({NUMBER})"), 1)
    negative = F.concat(
        F.regexp_extract_all(joined, F.lit(rf"(?:-|\(-\))\s*({NUMBER})"), 1),
        F.regexp_extract_all(joined, F.lit(rf"\(\s*({NUMBER})\s*\)"), 1),
    )
    signed = F.transform(negative, lambda n: F.concat(F.lit("-"), n))
    return F.array_distinct(F.transform(F.concat(plain, signed), lambda n: n.cast("double")))


def _count(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def phrase_in(phrase: Column, hay: Column, hay_words: Column) -> Column:
    """Whether a phrase is in a text, both normalised: as it stands; or, from two
    words on, with all its words in a window of twice its length; from six
    words on with all its words anywhere. An empty phrase is in every text."""
    needle = words_of(phrase)
    n = F.size(needle)

    def covered(span: Column) -> Column:
        return F.forall(F.array_distinct(needle), lambda w: _count(span, w) >= _count(needle, w))

    # a window that holds the phrase holds it from its first word of it on
    width = n * WINDOW_SLACK
    starts = F.array_compact(F.transform(hay_words, lambda w, at: F.when(F.array_contains(needle, w), at + 1)))
    near = F.exists(starts, lambda at: covered(F.slice(hay_words, at, width)))
    no_repeats = F.size(F.array_distinct(needle)) == n
    return (
        F.when(hay.contains(phrase), True)
        .when(n < 2, False)
        .when(F.size(F.array_except(needle, hay_words)) > 0, False)
        .when(n >= LONG_PHRASE, no_repeats | covered(hay_words))
        .otherwise(near)
    )


def phone_in(text: Column, hay_digits: Column) -> Column:
    digits = digits_only(text)
    return (F.length(digits) >= PHONE_DIGITS) & hay_digits.contains(digits)


def match_key(name: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def title_case(name: Column) -> Column:
    """Words of snake or kebab names with a capital first letter; the rest of
    each word stays as it is."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(name, r"[_\-\s]+", " ")), " "), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")
