"""From responses to stored rows, and from a request to an answer."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tessera.functions.json_text import recover_json
from tessera.operators import answer, filters, mapping, verify
from tessera.operators.filters import Collection, FilterRequest
from tessera.plans.catalog import Catalog, Manifest, column_json


@dataclass
class Answer:
    """A grounded answer: projected rows of a page and what is said of them."""

    rows: DataFrame
    columns: list[str]
    kind: str
    headline: str
    total: int
    coverage: dict
    caveats: list[str] = field(default_factory=list)
    entity: str | None = None


def answer_request(collection: Collection, request: FilterRequest) -> Answer:
    """Filter, page, project and compose. Rows with low values are left out
    after paging, and the total is less by as many."""
    page, every, entity = filters.filter_page(collection, request)
    projected = answer.project_cells(page)
    # a page has a thousand rows at most: it is computed once
    projected = projected.sparkSession.createDataFrame(projected.collect(), projected.schema)
    cover = answer.coverage(projected, request.exclude_low).first().asDict()
    shown = answer.exclude_low(projected) if request.exclude_low else projected
    total = max(0, every.count() - (cover["excluded_rows"] if request.exclude_low else 0))
    columns = [c for c in shown.columns if not c.startswith("_")]
    n = cover["included_rows"]
    kind = answer.answer_type(columns, n, entity is not None)
    value = shown.first()[columns[0]]["value"] if n == 1 and len(columns) == 1 else None
    said = answer.headline(kind, columns, n, total, value, entity, entity is not None)
    return Answer(shown, columns, kind, said, total, cover, answer.caveats(cover["excluded_rows"], cover["low_cells"], cover["verifiable"], request.exclude_low), entity)


def create_collection(catalog: Catalog, collection_id: str, name: str, response_json: str) -> Manifest:
    """A collection whose schema is that of one response."""
    body = recover_json(response_json)
    columns, _ = mapping.response_columns(body if isinstance(body, dict) else {})
    return catalog.create(collection_id, name, columns)


def add_documents(catalog: Catalog, collection_id: str, responses: DataFrame, chunks: DataFrame, uploads: DataFrame | None = None, proposed: list | None = None) -> int:
    """Map the responses by the collection's schema, verify their cells, add
    proposed columns and append the rows; the number of rows."""
    if proposed:
        catalog.evolve(collection_id, proposed)
    manifest = catalog.read(collection_id)
    schema = json.dumps([column_json(c) for c in manifest.schema()], ensure_ascii=False)
    spark = responses.sparkSession
    saved = spark.createDataFrame([(collection_id, 1, schema)], "collection_id string, schema_version int, schema_json string")
    plain = responses.select("response_id", "document_id", F.lit(collection_id).alias("collection_id"), F.lit(1).alias("schema_version"), "response_json")
    cells = mapping.map_responses(plain, saved).withColumn("cell_id", F.xxhash64("response_id", "row_ordinal", "row_path", "column_name"))
    scored = verify.score_cells(cells, chunks, uploads)
    confidence = verify.document_confidence(scored)
    found = cells.drop("page", "chunk", "reported").join(scored.select("cell_id", "level", "score", "page", "chunk", "note"), "cell_id")
    return catalog.append(collection_id, found, confidence)
