"""Answers with their provenance: projected cells, coverage, headline, caveats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

CONFIDENCE, EVIDENCE, PARENT_COLUMN = "_confidence_json", "_evidence_json", "parent"
EVIDENCE_TYPE = "map<string,struct<level:string,score:double,page:int,chunk:int,note:string,rawSource:string>>"
#: Words that make a column an aggregate.
AGGREGATE = re.compile(r"\b(sum|count|avg|average|min|max|total)\b", re.IGNORECASE)


def business_columns(columns: list[str]) -> list[str]:
    """Without bookkeeping; the parent first."""
    kept = [c for c in columns if not c.startswith("_")]
    return [c for c in kept if c == PARENT_COLUMN] + [c for c in kept if c != PARENT_COLUMN]


def strip_internal(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def project_cells(rows: DataFrame) -> DataFrame:
    """Each business column as struct<value, confidence, page, raw_source>. The
    level is that of the confidence map, else of the evidence; unreadable
    provenance counts as none."""
    bare = lambda c: F.when(F.trim(c) != "", c)
    conf = F.from_json(bare(F.col(CONFIDENCE)), "map<string,string>") if CONFIDENCE in rows.columns else F.lit(None).cast("map<string,string>")
    proof = F.from_json(bare(F.col(EVIDENCE)), EVIDENCE_TYPE) if EVIDENCE in rows.columns else F.lit(None).cast(EVIDENCE_TYPE)
    marked = rows.withColumns({"_conf": conf, "_proof": proof})

    def cell(name: str) -> Column:
        own = F.try_element_at("_proof", F.lit(name))
        level = F.lower(F.coalesce(F.try_element_at("_conf", F.lit(name)), own["level"]))
        if name == PARENT_COLUMN:
            level = F.lit(None).cast("string")
        return F.struct(F.col(name).cast("string").alias("value"), level.alias("confidence"), own["page"].alias("page"), own["rawSource"].alias("raw_source")).alias(name)

    keys = [c for c in ("_row_id",) if c in rows.columns]
    return marked.select(*keys, *map(cell, business_columns(rows.columns)))


def long_cells(projected: DataFrame) -> DataFrame:
    """One row per projected cell: _row_id, column_name, value, confidence, page, raw_source."""
    names = [c for c in projected.columns if not c.startswith("_")]
    items = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`.value"), F.col(f"`{n}`.confidence"), F.col(f"`{n}`.page"), F.col(f"`{n}`.raw_source")) for n in names])
    return projected.select("_row_id", F.explode(items).alias("cell")).select("_row_id", "cell.*")


def exclude_low(projected: DataFrame) -> DataFrame:
    """Rows none of whose cells is low."""
    names = [c for c in projected.columns if not c.startswith("_")]
    low = F.exists(F.array(*[F.col(f"`{n}`.confidence") for n in names]), lambda c: F.coalesce(c == "low", F.lit(False)))
    return projected.filter(~low)


def coverage(projected: DataFrame, excluded: bool = False) -> DataFrame:
    """One row: total_rows, included_rows, excluded_rows, cells_with_values,
    low_cells, verifiable."""
    names = [c for c in projected.columns if not c.startswith("_")]
    values = F.array(*[F.col(f"`{n}`.value") for n in names if n != PARENT_COLUMN])
    levels = F.array(*[F.col(f"`{n}`.confidence") for n in names if n != PARENT_COLUMN])
    is_low = lambda c: F.coalesce(c == "low", F.lit(False))
    taken = ~F.exists(levels, is_low) if excluded else F.lit(True)
    sums = projected.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(taken).alias("included_rows"),
        F.coalesce(F.sum(F.when(taken, F.size(F.filter(values, lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))))), F.lit(0)).alias("cells_with_values"),
        F.coalesce(F.sum(F.when(taken, F.size(F.filter(levels, is_low)))), F.lit(0)).alias("low_cells"),
        F.coalesce(F.max(taken & F.exists(levels, lambda c: c.isNotNull())), F.lit(False)).alias("verifiable"),
    )
    return sums.withColumn("excluded_rows", F.col("total_rows") - F.col("included_rows"))


def sums_by_confidence(cells: DataFrame, value: str, level: str) -> DataFrame:
    """A sum with and without low cells."""
    return cells.agg(F.sum(value).alias("including_low"), F.sum(F.when(~F.coalesce(F.col(level) == "low", F.lit(False)), F.col(value))).alias("excluding_low"))


def answer_type(columns: list[str], n_rows: int, entries: bool = False) -> str:
    if entries:
        return "list" if len([c for c in columns if c != PARENT_COLUMN]) <= 1 else "table"
    if n_rows == 1:
        return "aggregate" if len(columns) == 1 and AGGREGATE.search(columns[0]) else "single_value"
    return "list" if len(columns) <= 1 else "table"


def headline(kind: str, columns: list[str], n_rows: int, total: int, value: object = None, entity: str | None = None, entries: bool = False) -> str:
    if entries:
        label = entity.strip() if entity and entity.strip() else "entry"
        count = total if n_rows else 0
        return f"No matching {label} entries" if count <= 0 else f"Found 1 {label} entry" if count == 1 else f"Found {count} {label} entries"
    if not n_rows:
        return "No matching results"
    if kind in ("single_value", "aggregate"):
        text = "" if value is None or len(columns) != 1 else str(value)
        return text if text.strip() else "1 result"
    count = max(total, n_rows)
    return f"{count} result" + ("" if count == 1 else "s")


def caveats(n_excluded: int, n_low: int, verifiable: bool, excluding: bool) -> list[str]:
    if excluding and n_excluded > 0:
        return [f"{n_excluded} row{'' if n_excluded == 1 else 's'} with low-confidence values were excluded."]
    if verifiable and n_low > 0:
        return ["Some values were extracted with low confidence — treat them with caution."]
    return []


def provenance_json(cells: DataFrame) -> DataFrame:
    """Per row the JSON a data table keeps beside its values: ``_confidence_json``
    and ``_evidence_json``, from cells (_row_id, column_name, level, score, page,
    chunk, note, raw_source). Parts that are null are left out."""
    proof = F.struct("level", "score", "page", "chunk", "note", F.col("raw_source").alias("rawSource"))
    entries = F.sort_array(F.collect_list(F.struct("column_name", F.coalesce("level", F.lit("low")).alias("level"), proof.alias("proof"))))
    grouped = cells.groupBy("_row_id").agg(entries.alias("e"))
    return grouped.select(
        "_row_id",
        F.to_json(F.map_from_arrays(F.col("e.column_name"), F.col("e.level"))).alias(CONFIDENCE),
        F.to_json(F.map_from_arrays(F.col("e.column_name"), F.col("e.proof"))).alias(EVIDENCE),
    )
