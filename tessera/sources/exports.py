"""Tables out to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.values import safe_filename
from tessera.operators.answer import strip_internal

#: Rows an export has at most.
EXPORT_ROWS = 100_000


def export_rows(table: DataFrame, limit: int = EXPORT_ROWS) -> DataFrame:
    return strip_internal(table.orderBy("_row_id").limit(limit))


def export_csv(table: DataFrame, folder: str, name: str) -> str:
    """One CSV file with a header, records ending in CRLF, nulls empty."""
    path = f"{folder}/{safe_filename(name)}.csv"
    export_rows(table).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("lineSep", "\r\n").csv(path)
    return path


def json_rows(table: DataFrame) -> DataFrame:
    """Rows as JSON objects, nulls kept."""
    rows = export_rows(table)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))


def export_json(table: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/{safe_filename(name)}.json"
    json_rows(table).coalesce(1).write.mode("overwrite").text(path)
    return path
