"""Responses mapped onto typed cells, rows and sections."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.errors import ExtractionError
from tessera.functions.arrow import pieces
from tessera.functions.json_text import embedded_json, recover_json
from tessera.functions.text import match_key, title_case
from tessera.functions.values import FALSE_WORDS, NUMBER_NOISE, TRUE_WORDS
from tessera.model import Column, load_schema, parse_columns, schema_columns
from tessera.session import once

#: Attributes of a cell, which are not fields of a record.
CELL_KEYS = frozenset(("confidence", "importance", "page", "chunk", "raw_source", "searchable"))
#: Names of texts that stay one value however long they are.
PROSE_NAMES = ("summary", "abstract", "description", "narrative", "overview", "purpose", "comment")
SCALAR_NAMES = frozenset(
    """
    note notes name fullname candidatename email emailaddress phone phonenumber mobile mobilenumber location address city
    linkedin linkedinurl linkedinprofile github githuburl website portfolio
    """.split()
)
#: A flat text from so many characters and words may hold several records.
FLAT_CHARS, FLAT_WORDS = 40, 6
CELLS = (
    "row_ordinal int, row_path string, column_name string, column_type string, value_text string, value_num double, "
    "value_bool boolean, reported string, importance string, page int, chunk int, raw_source string"
)


def infer_entity(name: str, value) -> Column | None:
    """An entity column for a value that holds records: an array of objects, or
    an object of two fields or more that isn't a cell."""
    if isinstance(value, list) and value and isinstance(value[0], dict):
        sample, least = value[0], 1
    elif isinstance(value, dict) and "value" not in value:
        sample, least = value, 2
    else:
        return None
    fields = [k for k in sample if k not in CELL_KEYS]
    if len(fields) < least:
        return None
    return Column(name, "entity_array", children=[Column(k, required=False) for k in fields], has_entity=True)


def promote_columns(columns: list[Column], first_row: dict | None) -> list[Column]:
    """Scalar columns whose value in the first row holds records become entity
    columns."""
    if not isinstance(first_row, dict):
        return columns
    out = []
    for c in columns:
        raw = first_row.get(c.name)
        value = raw["value"] if isinstance(raw, dict) and "value" in raw else raw
        found = None if c.type == "entity_array" else infer_entity(c.name, embedded_json(value))
        out.append(replace(found, description=c.description, required=c.required) if found else c)
    return out


def response_columns(body: dict, saved: list[Column] | None = None) -> tuple[list[Column], list[Column]]:
    """(columns rows are read by, new columns proposed). Without saved columns
    the response must bring a schema; with them its ``new_columns`` count only
    if they have a name and a type."""
    if saved is None:
        own = schema_columns(body["schema"]) if isinstance(body.get("schema"), (dict, list)) else None
        if not own:
            raise ExtractionError("The response has no schema columns")
        rows = body.get("rows")
        first = rows[0] if isinstance(rows, list) and rows else rows
        return promote_columns(own, first), []
    proposed = [c for c in body.get("new_columns") or [] if isinstance(c, dict) and c.get("name") and c.get("type")]
    return saved, parse_columns(proposed)


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _typed(value, kind: str) -> tuple[str | None, float | None, bool | None]:
    """A value as text, number or boolean, by its column's type."""
    if value is None:
        return None, None, None
    if kind in ("number", "currency"):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return None, float(value), None
        try:
            return None, float(re.sub(NUMBER_NOISE, "", str(value))), None
        except ValueError:
            pass
    if kind == "boolean":
        if isinstance(value, bool):
            return None, None, value
        word = str(value).lower()
        if word in TRUE_WORDS + FALSE_WORDS:
            return None, None, word in TRUE_WORDS
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False), None, None
    return ("true" if value else "false") if isinstance(value, bool) else str(value), None, None


def map_rows(rows, columns: list[Column]) -> list[tuple]:
    """Cells of a response's rows in long form. Each record has a cell for each
    of its columns: a missing one is low, a bare value medium; nested records
    follow under their path. An entity column's own cell has no value."""
    out: list[tuple] = []

    def walk(record: dict, known: list[Column], ordinal: int, path: str) -> None:
        for c in known:
            raw = record.get(c.name)
            is_cell = isinstance(raw, dict) and "value" in raw
            value = embedded_json(raw["value"]) if is_cell else embedded_json(raw)
            about = raw if is_cell else {}
            reported = "low" if raw is None else str(about.get("confidence") or "medium").lower()
            text, number, flag = (None, None, None) if c.type == "entity_array" else _typed(value, c.type)
            source = about.get("raw_source")
            out.append((ordinal, path, c.name, c.type, text, number, flag, reported, about.get("importance"), _whole(about.get("page")), _whole(about.get("chunk")), None if source is None else str(source)))
            if c.type == "entity_array":
                members = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
                for k, member in enumerate(members):
                    if isinstance(member, dict):
                        walk(member, c.children, ordinal, f"{path}/{c.name}/{k}" if path else f"{c.name}/{k}")

    for k, record in enumerate(rows if isinstance(rows, list) else [rows] if isinstance(rows, dict) else []):
        if isinstance(record, dict):
            walk(record, columns, k, "")
    return out


def map_responses(responses: DataFrame, collections: DataFrame) -> DataFrame:
    """Cells of all responses: response_id, document_id and the cells' columns.

    A response that brings a schema is read by it, another by the saved schema
    of its collection and version. Null, unreadable and cut-off responses, and
    those without any schema, give no cells; repeated rows count once.
    """
    rows = once(responses.select("response_id", "document_id", "collection_id", "schema_version", "response_json"), "response_id")
    saved = collections.select("collection_id", "schema_version", "schema_json").dropDuplicates(["collection_id", "schema_version"])
    joined = rows.join(saved, ["collection_id", "schema_version"], "left").select("response_id", "document_id", "response_json", "schema_json")
    kinds = [pa.int32(), *[pa.string()] * 4, pa.float64(), pa.bool_(), *[pa.string()] * 2, pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owners, cells = [], []
            for k, (text, schema) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                body = recover_json(text)
                if not isinstance(body, dict):
                    continue
                try:
                    columns, _ = response_columns(body, None if body.get("schema") else load_schema(schema))
                except ExtractionError:
                    continue
                found = map_rows(body.get("rows"), columns)
                owners += [k] * len(found)
                cells += found
            take = pa.array(owners, pa.int64())
            parts = list(zip(*cells)) if cells else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *[pa.array(p, t) for p, t in zip(parts, kinds)]],
                names=["response_id", "document_id", *[c.split()[0] for c in CELLS.split(", ")]],
            )

    return joined.mapInArrow(run, f"response_id bigint, document_id string, {CELLS}")


def flat_candidates(cells: DataFrame) -> DataFrame:
    """Text cells of the first row that may hold several records: long, of many
    words, and not of a kind that stays one value."""
    key = match_key(F.col("column_name"))
    prose = F.lit(False)
    for part in PROSE_NAMES:
        prose = prose | key.contains(part)
    words = F.size(F.split(F.trim("value_text"), r"\s+"))
    return cells.filter((F.col("row_ordinal") == 0) & (F.coalesce("row_path", F.lit("")) == "") & (F.lower("column_type") == "text") & (F.length(F.trim("value_text")) >= FLAT_CHARS) & (words >= FLAT_WORDS) & ~prose & ~key.isin(*SCALAR_NAMES))


def apply_restructure(columns: list[Column], rows: list[dict], repaired: dict) -> tuple[list[Column], list[dict]]:
    """Text columns replaced by entity columns where a repair brings columns and
    rows; ``repaired`` is the response's ``restructured`` object."""
    new_columns, new_rows = list(columns), [dict(r) for r in rows]
    for k, c in enumerate(columns):
        fix = repaired.get(c.name)
        schema = fix.get("entitySchema") or fix.get("entity_schema") if isinstance(fix, dict) else None
        children = parse_columns(schema.get("columns")) if isinstance(schema, dict) else []
        if c.type == "entity_array" or not children:
            continue
        new_columns[k] = replace(c, type="entity_array", children=children, has_entity=True)
        if new_rows:
            new_rows[0][c.name] = {"value": fix.get("rows") or [], "confidence": "high", "importance": "medium", "searchable": True}
    return new_columns, new_rows


def knowledge_sections(responses: DataFrame) -> DataFrame:
    """The sections of each response over its schema's columns: response_id,
    section_no, title, field. A field belongs to the first section that claims
    it, by letters and digits alone; fields no column has are dropped, sections
    left empty vanish, and each column unclaimed has a section of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = recover_json(text)
                if not isinstance(body, dict) or not isinstance(body.get("schema"), (dict, list)):
                    continue
                out += [(rid, None, None, None, k, c.name) for k, c in enumerate(schema_columns(body["schema"]) or [])]
                for s, section in enumerate(body.get("knowledge_sections") or []):
                    if isinstance(section, dict):
                        out += [(rid, s, section.get("title"), f, str(name), None) for f, name in enumerate(section.get("fields") or [])]
            yield pa.RecordBatch.from_pylist(
                [{"response_id": o[0], "section_no": o[1], "title": o[2], "place": o[3] if o[1] is not None else o[4], "field": o[4] if o[1] is not None else o[5]} for o in out],
                schema=pa.schema([("response_id", pa.int64()), ("section_no", pa.int32()), ("title", pa.string()), ("place", pa.int32()), ("field", pa.string())]),
            )

    rows = once(responses.select("response_id", "response_json"), "response_id")
    raw = rows.mapInArrow(run, "response_id bigint, section_no int, title string, place int, field string").withColumn("key", match_key(F.col("field")))
    columns = raw.filter("section_no is null")
    one = Window.partitionBy("response_id", "key").orderBy("place")
    columns = columns.withColumn("n", F.row_number().over(one)).filter("n = 1").select("response_id", "key", F.col("field").alias("column_name"), F.col("place").alias("column_place"))
    claims = raw.filter("section_no is not null").join(columns, ["response_id", "key"])
    first = Window.partitionBy("response_id", "column_name").orderBy("section_no", "place")
    kept = claims.withColumn("n", F.row_number().over(first)).filter("n = 1 and title is not null").select("response_id", "section_no", "title", F.col("column_name").alias("field"))
    claimed = claims.select("response_id", "column_name").distinct()
    left = columns.join(claimed, ["response_id", "column_name"], "left_anti").select("response_id", (F.col("column_place") + 1_000_000).alias("section_no"), title_case(F.col("column_name")).alias("title"), F.col("column_name").alias("field"))
    return kept.unionByName(left)


ANALYSIS = "document_type string, category string, purpose string, owner string, audience string, summary string, sections array<string>, warnings array<string>"


def response_analysis(responses: DataFrame) -> DataFrame:
    """What each response says about its document: response_id, document_type,
    category, purpose, owner, audience, summary, sections, warnings. A type
    without a spoken name takes the schema's word in title case; blank texts are
    null; unreadable responses have no row; repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda v: v if isinstance(v, str) and v.strip() else None
        texts = lambda v: [str(x) for x in v if x is not None] if isinstance(v, list) else []
        for batch in pieces(batches):
            out = []
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = recover_json(raw)
                if not isinstance(body, dict):
                    continue
                info = body.get("document_type_info") if isinstance(body.get("document_type_info"), dict) else {}
                about = body.get("document_analysis") if isinstance(body.get("document_analysis"), dict) else {}
                word = text(body.get("document_type"))
                spoken = text(info.get("name")) or (" ".join(w[:1].upper() + w[1:] for w in re.split(r"[\s_-]+", word.strip())) if word else None)
                out.append({
                    "response_id": rid, "document_type": spoken, "category": text(info.get("category")), "purpose": text(about.get("purpose")), "owner": text(about.get("owner")),
                    "audience": text(about.get("audience")), "summary": text(about.get("ai_summary")), "sections": texts(about.get("detected_sections")), "warnings": texts(body.get("warnings")),
                })
            names = ["document_type", "category", "purpose", "owner", "audience", "summary"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("response_id", pa.int64()), *[(n, pa.string()) for n in names], ("sections", pa.list_(pa.string())), ("warnings", pa.list_(pa.string()))]))

    rows = once(responses.select("response_id", "response_json"), "response_id")
    return rows.mapInArrow(run, f"response_id bigint, {ANALYSIS}")
