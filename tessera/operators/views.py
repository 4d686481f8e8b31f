"""What a reader of the tables does with them: search, sort, status, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera import model
from tessera.functions.values import sanitized

#: How a type is called where its own word reads badly.
TYPE_WORDS = {"url": "web address", "email": "email address", "currency": "amount", "boolean": "yes/no value"}
#: The names under which a profile field is looked for, in order.
PROFILE_ALIASES = {
    "name": ("candidatename", "fullname", "name"),
    "email": ("email", "emailaddress"),
    "phone": ("phone", "phonenumber", "mobile", "mobilenumber"),
    "location": ("location", "address", "city"),
    "linkedin": ("linkedin", "linkedinprofile", "linkedinurl"),
    "github": ("github", "githubprofile", "githuburl"),
    "portfolio": ("portfolio", "portfoliourl", "website", "personalwebsite"),
}
#: The operators offered by kind of column.
OFFERED = {
    "search": ("contains", "is_empty", "is_not_empty"),
    "boolean": ("eq", "is_empty", "is_not_empty"),
    "date": ("eq", "gt", "gte", "lt", "lte", "is_empty", "is_not_empty"),
    "number": ("eq", "neq", "gt", "gte", "lt", "lte", "is_empty", "is_not_empty"),
    "closed": ("eq", "neq", "is_empty", "is_not_empty"),
    "name": ("eq", "contains", "neq", "is_empty", "is_not_empty"),
    "text": ("contains", "eq", "neq", "starts_with", "ends_with", "is_empty", "is_not_empty"),
}
#: Kinds of column by role and by type, the roles first.
KIND_BY_ROLE = {
    "boolean": "boolean", "date": "date", "money": "number", "number": "number", "percentage": "number", "status": "closed",
    "currency": "closed", "company": "name", "organization": "name", "country": "name", "city": "name", "person_name": "name",
    "email": "name", "url": "name", "phone": "name", "identifier": "name",
}
KIND_BY_TYPE = {"boolean": "boolean", "date": "date", "number": "number", "currency": "number", "email": "name", "url": "name"}


def search_rows(rows: DataFrame, query: str) -> DataFrame:
    """Rows with the text in any business column, without regard to case."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if not c.startswith("_")]
    return rows.filter(F.lower(F.concat_ws("\u0001", *columns)).contains(query.lower()))


def natural_key(text: Column) -> Column:
    """Text that sorts numbers by their value: digit runs padded to 20."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < 20), F.lpad(p, 20, "0")).otherwise(p)), "")


def sort_naturally(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Nulls first ascending, last descending."""
    key = natural_key(F.col(column).cast("string"))
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first())


def provenance_status(value: Column, confidence: Column, page: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), "absent")
        .when(confidence == "low", "review")
        .when(page.isNotNull(), "verified")
        .otherwise("unverified")
    )


def confidence_label(level: Column, score: Column) -> Column:
    return F.when(level.isNotNull(), F.when(score.isNull(), F.initcap(level)).otherwise(F.format_string("%s (%.2f)", F.initcap(level), score)))


def review_reason(note: Column, status: Column) -> Column:
    """A finding in a reader's words; null if there is none or no value."""
    kind = F.lower(F.regexp_extract(note, r"(?i)failed (\w+) validation", 1))
    spoken = kind
    for name, words in TYPE_WORDS.items():
        spoken = F.when(kind == name, words).otherwise(spoken)
    return F.when(
        note.isNotNull() & (note != "") & (status != "absent"),
        F.when(note.rlike("(?i)line items add up to"), note)
        .when(note.rlike("(?i)does not appear anywhere in the document"), "The exact wording could not be located in the document text.")
        .when(kind != "", F.concat(F.lit("The value does not look like a valid "), spoken, F.lit(".")))
        .when(note.rlike("(?i)image document"), "This document is an image, so its text could not be checked.")
        .when(note.rlike("(?i)found elsewhere|does not appear in the cited|does not appear in the quoted"), "The value appears in a different part of the document than the extraction indicated.")
        .when(note.rlike("(?i)no source chunk was cited|does not exist in this document|no verbatim source quote"), "The extraction did not point to a specific place in the document."),
    )


def flatten_cells(nodes: DataFrame) -> DataFrame:
    """Nested records as paths (``education[0].degree``) with their values, from
    the nodes of ``shred_responses``: response_id, path, value."""
    records = nodes.filter("node_kind = 'record'").select("response_id", "steps", F.explode("fields").alias("name", "value"))
    # after the row's own position come pairs of a field and a place in it
    pairs = F.sequence(F.lit(2), F.size("steps") - 1, F.lit(2))
    head = F.when(F.size("steps") > 1, F.transform(pairs, lambda k: F.concat(F.element_at("steps", k), F.lit("["), F.element_at("steps", k + 1), F.lit("].")))).otherwise(F.array().cast("array<string>"))
    return records.select("response_id", F.element_at("steps", 1).cast("int").alias("row"), F.concat(F.array_join(head, ""), "name").alias("path"), "value")


def profile_fields(records: DataFrame) -> DataFrame:
    """Profile fields of each response, from its records (``shred_responses``
    with fields): response_id, field, value. Of several candidates the one
    nearest the top wins, then the alias named first."""
    named = records.filter("node_kind = 'record'").select("response_id", "dewey", F.explode("fields").alias("name", "value")).filter("trim(value) <> ''")
    keys = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    aliases = [(f, rank, a) for f, names in PROFILE_ALIASES.items() for rank, a in enumerate(names)]
    table = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("rank"), F.lit(a).alias("alias")) for f, r, a in aliases])
    hits = named.withColumn("key", keys).select("response_id", "dewey", "key", "value", F.explode(table).alias("p")).filter("key = p.alias")
    return hits.groupBy("response_id", F.col("p.field").alias("field")).agg(F.min_by("value", F.struct(F.size("dewey"), "p.rank", "dewey")).alias("value"))


def _prose(column: model.Column) -> bool:
    hint = column.hint or {}
    return hint.get("role") == "description" or hint.get("filterable") is False and column.type == "text"


def operators_for(column: model.Column) -> tuple[str, ...]:
    """The operators offered for a column: by its role and type, where either
    says number, date or boolean, that; prose can only be searched."""
    hint = column.hint or {}
    if _prose(column):
        return OFFERED["search"]
    kinds = (KIND_BY_ROLE.get(hint.get("role")), KIND_BY_TYPE.get(column.type))
    for kind in ("boolean", "date", "number", "closed"):
        if kind in kinds:
            return OFFERED[kind]
    return OFFERED["name" if "name" in kinds or hint.get("groupable") is True else "text"]


def filter_fields(columns: list[model.Column]) -> list[tuple[str | None, str]]:
    """(entity, column) of all scalar columns, nested ones one level down, in
    the schema's order."""
    out: list[tuple[str | None, str]] = []
    for c in columns:
        out += [(c.name, n.name) for n in c.children if n.type != "entity_array"] if c.type == "entity_array" else [(None, c.name)]
    return out


def sortable(column: model.Column) -> bool:
    return column.type != "entity_array" and (column.hint or {}).get("sortable") is not False and not _prose(column)


def suggested_questions(columns: list[model.Column], limit: int = 4) -> list[str]:
    """Questions the schema suggests, each once: a column's own example, else
    one made from its role and type."""
    by_role = {
        "money": "What is the total {}?", "currency": "What is the total {}?", "status": "How many rows are in each {}?",
        "person_name": "List the {}s", "company": "List the {}s", "organization": "List the {}s", "date": "Show the most recent {}",
    }
    out: dict[str, str] = {}
    for c in columns:
        hint = c.hint or {}
        made = by_role.get(hint.get("role")) or (
            "What is the average {}?" if c.type in ("number", "currency") else "Group by {}" if hint.get("groupable")
            else "Show all distinct {}" if hint.get("filterable") is not False and c.type == "text" else None
        )
        question = (c.example or (made.format(c.name.lower()) if made else "")).strip()
        if question and len(out) < limit:
            out.setdefault(question.lower(), question)
    return list(out.values())


def coverage_line(coverage: DataFrame) -> DataFrame:
    """The coverage of an answer in one line (``answer.coverage``); null where
    nothing can be said."""
    some = lambda n, one, more: F.when(F.col(n) == 1, one).otherwise(more)
    values = (
        F.when(F.col("low_cells") > 0, F.concat_ws(" ", "low_cells", F.lit("of"), "cells_with_values", some("cells_with_values", "value", "values"), F.lit("were low-confidence.")))
        .when(F.col("cells_with_values") > 0, F.concat_ws(" ", "cells_with_values", some("cells_with_values", "value", "values"), F.lit("backed by source evidence.")))
    )
    rows = F.when(F.col("excluded_rows") > 0, F.concat_ws(" ", "excluded_rows", F.lit("low-confidence"), some("excluded_rows", "row", "rows"), F.lit("excluded.")))
    return coverage.select(F.when(F.col("verifiable"), F.nullif(F.concat_ws(" ", values, rows), F.lit(""))).alias("line"))
