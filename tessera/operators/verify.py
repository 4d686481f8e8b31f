"""Citations verified against the text, and confidence from it.

Cells in long form meet the chunk they cite first. What is found there is in the
document too, as all ways to match only gain by more text; only the cells that
still need it are joined with their whole document. Text is dropped from the rows
as soon as it has been searched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import NUMERIC_EPSILON, digits_only, normalize_text, numbers_in, phone_in, phrase_in, words_of
from tessera.functions.values import validate_value
from tessera.model import Column as Column_
from tessera.session import once

#: Levels by score, and what each finding takes off.
HIGH, MEDIUM = 0.8, 0.5
NO_CITATION, BAD_CITATION = 0.3, 0.5
QUOTE_ABSENT, QUOTE_MISPLACED, NO_QUOTE, VALUE_UNGROUNDED = 0.35, 0.25, 0.15, 0.2
FAILED_VALIDATION, DOUBT_MEDIUM, DOUBT_LOW = 0.3, 0.1, 0.3
#: What a total may be off by, and the shares that make a
#: document's level.
TOTAL_RATIO, TOTAL_LEAST = 0.01, 0.02
HIGH_SHARE, LOW_SHARE = 0.7, 0.3
#: Column names of line amounts, totals and what lies between.
LINE_AMOUNT, NOT_LINE_AMOUNT = r"(?i)(amount|line[\s_-]?total|extended|subtotal|total|price)", r"(?i)(unit|rate|per[\s_-]|each|tax|qty|quantity|discount|hours)"
SUBTOTAL, TOTAL = r"(?i)(sub[\s_-]?total|net[\s_-]?(amount|total))", r"(?i)(grand[\s_-]?total|total|amount[\s_-]?due|balance[\s_-]?due|amount[\s_-]?payable)"
SURCHARGE, DISCOUNT = r"(?i)(tax|vat|gst|shipping|freight|handling|fee|surcharge|delivery)", r"(?i)(discount|credit|rebate|adjustment)"
#: The wording of findings is given with them below.
IMAGE_NOTE = "Image document — the value could not be verified against extracted text"


def _forms(text: Column) -> Column:
    plain = normalize_text(text)
    return F.struct(plain.alias("text"), words_of(plain).alias("words"), numbers_in(text).alias("numbers"), digits_only(text).alias("digits"))


def searchable_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk in the forms matching needs."""
    rows = once(chunks.select("document_id", "chunk_index", "page", F.coalesce("text", F.lit("")).alias("text")), "document_id", "chunk_index")
    return rows.withColumn("forms", _forms(F.col("text")))


def searchable_documents(searchable: DataFrame) -> DataFrame:
    """Per document its whole text and each chunk, in the forms matching needs."""
    grouped = searchable.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "page", "text", "forms"))).alias("chunks"))
    whole = F.concat(F.array_join(F.transform("chunks", lambda c: c["text"]), "\n"), F.lit("\n"))
    return grouped.select("document_id", _forms(whole).alias("whole"), F.transform("chunks", lambda c: F.struct(c["chunk_index"].alias("index"), c["page"].alias("page"), c["forms"].alias("forms"))).alias("parts"))


def _value_in(hay: Column) -> Column:
    """Whether the row's value is in a text. Dates and booleans always count:
    they are written in a form of their own."""
    text = F.col("_text")
    return (
        F.when(F.col("column_type").isin("date", "boolean") | F.col("value_bool").isNotNull(), True)
        .when(F.col("_number").isNotNull(), F.exists(hay["numbers"], lambda n: F.abs(n - F.col("_number")) < NUMERIC_EPSILON))
        .otherwise(phrase_in(F.col("_plain"), hay["text"], hay["words"]) | phone_in(text, hay["digits"]))
    )


def _quote_in(hay: Column) -> Column:
    return phrase_in(F.col("_quote_plain"), hay["text"], hay["words"]) | phone_in(F.col("_quote"), hay["digits"])


def level_of(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def _rounded(score: Column) -> Column:
    return F.floor(score * 100 + 0.5) / 100


def _clamped(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def reported_level(word: Column) -> Column:
    plain = F.lower(F.trim(word))
    return F.when(plain.isin("high", "medium", "low"), plain).otherwise("medium")


def score_cells(cells: DataFrame, chunks: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """Verified cells: cell_id, document_id, level, score, page, chunk, note.

    A null value is low without a score. Cells of images (by ``uploads``) can't
    be verified and are medium at best. Documents without chunks are verified
    against an empty text. Repeated rows count once; unknown words of
    confidence count as medium; other columns are ignored.
    """
    kept = ["cell_id", "document_id", "column_name", "column_type", "value_text", "value_num", "value_bool", "reported", "page", "chunk", "raw_source"]
    rows = once(cells.select(*kept), "cell_id").withColumn("column_type", F.coalesce(F.lower("column_type"), F.lit("text")))
    numeric = F.col("column_type").isin("number", "currency")
    rows = (
        rows.withColumn("_number", F.when(F.col("value_num").isNotNull() & (numeric | F.col("value_text").isNull()), F.col("value_num")))
        .withColumn("_text", F.coalesce("value_text", F.col("value_num").cast("string"), F.col("value_bool").cast("string")))
        .withColumn("_plain", normalize_text(F.col("_text")))
        .withColumn("_quote", F.coalesce(F.trim("raw_source"), F.lit("")))
        .withColumn("_quote_plain", normalize_text(F.col("_quote")))
    )
    if uploads is not None:
        images = uploads.filter("file_format = 'image'").select("document_id").distinct().withColumn("is_image", F.lit(True))
        rows = rows.join(images, "document_id", "left").withColumn("is_image", F.coalesce("is_image", F.lit(False)))
    else:
        rows = rows.withColumn("is_image", F.lit(False))
    typed = F.when(numeric, F.col("_number").isNotNull()).otherwise(F.col("value_bool").isNotNull())
    outcome = validate_value(F.col("_text"), typed, F.col("column_type"), F.col("column_name"))
    no_quote = F.col("_quote") == ""
    rows = rows.withColumns({
        "_invalid": outcome == "invalid",
        "_value_quoted": F.when(~no_quote, _value_in(_forms(F.col("_quote")))).otherwise(True),
    })
    searchable = searchable_chunks(chunks)
    cited = searchable.select("document_id", F.col("chunk_index").alias("chunk"), F.struct(F.col("chunk_index").alias("index"), "page").alias("_cited"), F.col("forms").alias("_forms"))
    near = rows.join(cited, ["document_id", "chunk"], "left")
    here = F.col("_cited").isNotNull()
    near = near.withColumns({
        "_value_here": F.when(here, _value_in(F.col("_forms"))),
        "_quote_here": here & ~no_quote & F.coalesce(_quote_in(F.col("_forms")), F.lit(False)),
    }).drop("_forms")
    # cells with nothing left to look for don't meet their document
    found_here = F.coalesce("_value_here", F.lit(False))
    absent = (F.col("_text").isNull() & F.col("value_bool").isNull()) | (F.col("column_type") == "entity_array")
    seek = ~F.col("is_image") & ~absent & (~found_here | (~no_quote & ~F.col("_quote_here")))
    near = near.withColumn("_sought", F.when(seek, F.col("document_id")).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("cell_id", "column_name").cast("string"))))
    documents = searchable_documents(searchable).withColumnRenamed("document_id", "_sought")
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("words"), F.array().cast("array<double>").alias("numbers"), F.lit("").alias("digits"))
    far = near.join(documents, "_sought", "left").withColumn("whole", F.coalesce("whole", empty))
    far = far.withColumn("_located", F.col("is_image") | found_here | _value_in(F.col("whole")))
    recover = F.col("chunk").isNull() & F.col("_located") & ~F.col("is_image")
    holds = F.get(F.filter("parts", lambda c: _value_in(c["forms"])), F.lit(0))
    quoted_in = lambda c: F.struct(c["index"].alias("index"), c["page"].alias("page"), _quote_in(c["forms"]).alias("quoted"))
    first = F.get(F.transform(F.array(holds), lambda c: F.when(c.isNotNull(), quoted_in(c))), F.lit(0))
    far = far.withColumns({
        "_recovered": F.when(recover, first),
        "_quote_far": F.when(~no_quote & ~F.col("_quote_here"), _quote_in(F.col("whole"))),
    }).drop("whole", "parts")
    recovered = F.col("_recovered").isNotNull()
    far = far.withColumns({
        "_value_here": F.when(recovered, True).otherwise(F.col("_value_here")),
        "_quote_here": F.col("_quote_here") | (recovered & ~no_quote & F.coalesce(F.col("_recovered")["quoted"], F.lit(False))),
        "_recovered": F.when(recovered, F.struct(F.col("_recovered")["index"].alias("index"), F.col("_recovered")["page"].alias("page"))),
    })
    return scored(far.withColumns({
        "_source": F.coalesce("_cited", "_recovered"),
        "_quote_somewhere": F.col("_quote_here") | F.coalesce("_quote_far", F.lit(False)),
    }))


def scored(found: DataFrame) -> DataFrame:
    """The rubric: level, score, place and note from the findings of each cell."""
    image, bad = F.col("is_image"), F.col("chunk").isNotNull() & F.col("_cited").isNull()
    uncited = F.col("chunk").isNull()
    recovered = uncited & F.col("_recovered").isNotNull()
    no_quote = F.col("_quote") == ""
    here = F.coalesce("_value_here", F.lit(False))
    known = F.col("_source").isNotNull()
    citation = F.when(image, 0.0).when(bad, BAD_CITATION).when(uncited & ~recovered, NO_CITATION).otherwise(0.0)
    # the parts are added in the rubric's order, as floating point remembers it
    quoted = F.lit(0.0) + F.when(F.col("_quote_here"), 0.0).when(F.col("_quote_somewhere"), QUOTE_MISPLACED).otherwise(QUOTE_ABSENT) + F.when(F.col("_value_quoted"), 0.0).otherwise(VALUE_UNGROUNDED)
    unquoted = F.when(here, 0.0).otherwise(F.lit(NO_QUOTE) + F.when(known, VALUE_UNGROUNDED).otherwise(0.0))
    grounding = F.when(image, 0.0).when(no_quote, unquoted).otherwise(quoted)
    doubt = F.when(reported_level(F.col("reported")) == "low", DOUBT_LOW).when(reported_level(F.col("reported")) == "medium", DOUBT_MEDIUM).otherwise(0.0)
    raw = F.lit(1.0) - F.when(F.col("_invalid"), FAILED_VALIDATION).otherwise(0.0) - citation - grounding - doubt
    score = _clamped(raw)
    level = F.when(~F.col("_located") | F.col("_invalid"), "low").when(image & (level_of(score) == "high"), "medium").otherwise(level_of(score))
    source = F.col("_source")
    off_page = F.col("_cited").isNotNull() & ~F.col("page").eqNullSafe(F.col("_cited")["page"])
    note = lambda when, text: F.when(when, text if isinstance(text, Column) else F.lit(text))
    notes = F.array(
        note(F.col("_invalid"), F.format_string("Value failed %s validation", "column_type")),
        note(image, IMAGE_NOTE),
        note(~image & bad, F.format_string("Cited chunk %d does not exist in this document", "chunk")),
        note(~image & recovered, "Source chunk recovered from document text (model omitted citation)"),
        note(~image & uncited & ~recovered, "No source chunk was cited for this value"),
        note(~image & off_page, F.format_string("Cited page corrected to %d from the cited chunk", F.col("_cited")["page"])),
        note(~image & no_quote & here, "No verbatim source quote was supplied; value located in cited chunk"),
        note(~image & no_quote & ~here, "No verbatim source quote was supplied"),
        note(~image & no_quote & ~here & known, "Value does not appear in the cited chunk"),
        note(~image & ~no_quote & ~F.col("_quote_here") & F.col("_quote_somewhere"), "Quoted source text was found elsewhere in the document, not in the cited chunk"),
        note(~image & ~no_quote & ~F.col("_quote_somewhere"), "Quoted source text does not appear anywhere in the document"),
        note(~image & ~no_quote & ~F.col("_value_quoted"), "Value does not appear in the quoted source text"),
        note(~image & ~F.col("_located"), "Value does not appear anywhere in the document text"),
    )
    absent = F.col("_text").isNull() & F.col("value_bool").isNull()
    nested = F.col("column_type") == "entity_array"
    shown = lambda c: F.when(~absent & ~nested & ~image, c)
    return found.select(
        "cell_id",
        "document_id",
        F.when(nested, reported_level(F.col("reported"))).when(absent, "low").otherwise(level).alias("level"),
        F.when(~absent & ~nested, _rounded(score)).alias("score"),
        shown(source["page"]).alias("page"),
        shown(source["index"]).alias("chunk"),
        F.when(nested, F.lit(None).cast("string")).when(absent, "No value for this field was found in the document").otherwise(F.nullif(F.array_join(F.array_compact(notes), "; "), F.lit(""))).alias("note"),
        (~absent & ~nested).alias("has_value"),
    )


def document_confidence(scored: DataFrame) -> DataFrame:
    """Per document its level from the levels of its values, how many there are
    and how many are low, with a warning where some are."""
    counts = scored.groupBy("document_id").agg(
        F.count_if("has_value").alias("n_values"),
        F.count_if(F.col("has_value") & (F.col("level") == "high")).alias("n_high"),
        F.count_if(F.col("has_value") & (F.col("level") == "low")).alias("n_low"),
    )
    share = lambda c: F.col(c) / F.col("n_values")
    return counts.select(
        "document_id", "n_values", "n_high", "n_low",
        F.when(F.col("n_values") == 0, "low").when(share("n_high") > HIGH_SHARE, "high").when(share("n_low") > LOW_SHARE, "low").otherwise("medium").alias("confidence"),
        F.when(F.col("n_low") > 0, F.format_string("%d extracted value(s) could not be fully verified against the document and are marked low confidence", "n_low")).alias("warning"),
    )


def total_columns(columns: list[Column_]) -> tuple[str, str, str, bool, tuple[str, ...], tuple[str, ...]] | None:
    """What ``cross_check`` needs of a schema: (entity, amount, stated,
    is_subtotal, surcharges, discounts); None if it has no line amounts or no
    total. A subtotal goes before a total, as nothing is added to it."""
    numeric = lambda cs: [c for c in cs if c.type in ("number", "currency")]
    first = lambda cs, take, leave=None: next((c.name for c in numeric(cs) if re.search(take, c.name) and not (leave and re.search(leave, c.name))), None)
    lines = next(((c.name, a) for c in columns if c.type == "entity_array" and (a := first(c.children, LINE_AMOUNT, NOT_LINE_AMOUNT))), None)
    subtotal = first(columns, SUBTOTAL)
    stated = subtotal or first(columns, TOTAL, SUBTOTAL)
    if not lines or not stated:
        return None
    named = lambda pattern: tuple(c.name for c in numeric(columns) if re.search(pattern, c.name))
    return (*lines, stated, subtotal is not None, () if subtotal else named(SURCHARGE), () if subtotal else named(DISCOUNT))


def cross_check(parents: DataFrame, children: DataFrame, stated: str, amount: str, is_subtotal: bool = False, surcharges: tuple[str, ...] = (), discounts: tuple[str, ...] = ()) -> DataFrame:
    """Line items against the stated total of their parent: _row_id, expected,
    stated, agrees, note. Parents without numeric line items or total are left out."""
    sums = children.groupBy("_parent_row_id").agg(F.sum(amount).alias("line_sum")).filter("line_sum is not null")
    both = parents.join(sums, parents["_row_id"] == sums["_parent_row_id"]).filter(F.col(stated).isNotNull())
    expected = F.col("line_sum")
    if not is_subtotal:
        for name in surcharges:
            expected = expected + F.abs(F.coalesce(F.col(name), F.lit(0.0)))
        for name in discounts:
            expected = expected - F.abs(F.coalesce(F.col(name), F.lit(0.0)))
    shown = lambda x: F.when(x == F.rint(x), x.cast("bigint").cast("string")).otherwise(_rounded(x).cast("string"))
    out = both.select("_row_id", expected.alias("expected"), F.col(stated).alias("stated"))
    off = F.abs(F.col("expected") - F.col("stated")) > F.greatest(F.lit(TOTAL_LEAST), F.abs("stated") * TOTAL_RATIO)
    return out.withColumn("agrees", ~off).withColumn("note", F.when(off, F.concat(F.lit("Line items add up to "), shown(F.col("expected")), F.lit(" but the document states "), shown(F.col("stated")))))
