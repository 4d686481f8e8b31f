"""Uploaded files: scan, format detection and parsing to pages of text."""

from __future__ import annotations

import csv
import io
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Largest file taken, in bytes.
MAX_BYTES = 10_485_760
#: Formats by content type and by file extension.
BY_TYPE = {
    "application/pdf": "pdf", "text/csv": "csv", "text/plain": "text", "text/tab-separated-values": "csv",
    "image/png": "image", "image/jpeg": "image", "image/jpg": "image", "image/webp": "image", "image/tiff": "image",
}
BY_EXTENSION = {
    "pdf": "pdf", "csv": "csv", "tsv": "csv", "txt": "text", "text": "text", "md": "text", "log": "text",
    "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "tiff": "image", "tif": "image",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def detect_format(content_type: Column, filename: Column) -> Column:
    """pdf, image, csv or text by content type, else by extension; null if neither is known."""
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.coalesce(_lookup(BY_TYPE, F.lower(content_type)), _lookup(BY_EXTENSION, F.coalesce(extension, F.lit(""))))


def scan_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files below a folder with their digest and format. ``error`` says why a
    file isn't taken: too large, then empty, then of no known format."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return check_files(files.select("path", "modificationTime", "length", "content").withColumn("content_type", F.lit(None).cast("string")), max_bytes)


def check_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    kind = detect_format(F.col("content_type"), name)
    return files.select(
        "*",
        name.alias("filename"),
        F.sha2("content", 256).alias("content_hash"),
        kind.alias("file_format"),
        F.when(F.col("length") > max_bytes, "FILE_TOO_LARGE").when(F.col("length") == 0, "PARSE_ERROR").when(kind.isNull(), "UNSUPPORTED_FORMAT").alias("error"),
    )


def java_trim(text: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def delimited_counts(text: Column, content_type: Column) -> Column:
    """Rows (header included) and columns of the first row; tab-separated only
    if the content type says so; quoted fields may hold line breaks."""

    @F.pandas_udf("row_count int, column_count int")
    def count(texts, tabs):
        import pandas as pd

        out = []
        for body, tab in zip(texts, tabs):
            rows = [r for r in csv.reader(io.StringIO(body or ""), delimiter="\t" if tab else ",") if r and (len(r) > 1 or r[0].strip())]
            out.append((len(rows), len(rows[0]) if rows else 0))
        return pd.DataFrame(out, columns=["row_count", "column_count"])

    return count(text, F.coalesce(F.lower(content_type).contains("tab-separated"), F.lit(False)))


def parse_files(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Adds pages (array of texts), base64 (images), is_image, line_count,
    char_count, row_count, column_count and error. PDF text comes from
    ``pages`` (path, page, text), as no PDF library is at hand; without it a
    PDF is an error. Texts are UTF-8; blank ones are errors."""
    text = java_trim(F.decode("content", "UTF-8"))
    is_text = F.col("file_format").isin("text", "csv")
    out = files.withColumn("_text", F.when(F.col("error").isNull() & is_text, text))
    counts = delimited_counts(F.when(F.col("file_format") == "csv", F.col("_text")), F.col("content_type"))
    out = out.withColumn("_counts", counts).withColumn("_pages", F.lit(None).cast("array<string>"))
    if pages is not None:
        stripped = pages.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", F.trim("text").alias("text")))), lambda p: p["text"]).alias("_found"))
        out = out.join(stripped, "path", "left").withColumn("_pages", F.col("_found")).drop("_found")
    has_text = F.coalesce(F.exists("_pages", lambda p: p != ""), F.lit(False))
    return out.select(
        *[c for c in files.columns if c != "error"],
        F.when(F.col("file_format") == "pdf", F.col("_pages")).when(is_text & (F.col("_text") != ""), F.array("_text")).otherwise(F.array().cast("array<string>")).alias("pages"),
        F.when(F.col("file_format") == "image", F.base64("content")).alias("base64"),
        (F.coalesce(F.col("file_format"), F.lit("")) == "image").alias("is_image"),
        F.when(is_text, F.size(F.split("_text", "\r\n|\r|\n"))).alias("line_count"),
        F.when(is_text, F.length("_text")).alias("char_count"),
        F.when(F.col("file_format") == "csv", F.col("_counts.row_count")).alias("row_count"),
        F.when(F.col("file_format") == "csv", F.col("_counts.column_count")).alias("column_count"),
        F.coalesce(F.col("error"), F.when(is_text & (F.coalesce(F.col("_text"), F.lit("")) == ""), "PARSE_ERROR").when((F.col("file_format") == "pdf") & ~has_text, "PARSE_ERROR")).alias("error"),
    )


def page_rows(parsed: DataFrame, key: str = "path") -> DataFrame:
    """One row per page: key, page (from 1), text."""
    return parsed.filter("error is null").select(key, F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1)


def original_bytes(documents: DataFrame, collection_id: str, document_id: str) -> DataFrame:
    """content, content_type and filename of one document of a collection."""
    return documents.filter((F.col("collection_id") == collection_id) & (F.col("document_id") == document_id) & F.col("content").isNotNull()).select(
        "content", F.coalesce("content_type", F.lit("application/octet-stream")).alias("content_type"), "filename"
    )


def response_provider(responses: DataFrame):
    """The seam to a model: a function from prompts (document_id, prompt) to
    answers (document_id, response_json). This one answers from a table."""

    def complete(prompts: DataFrame) -> DataFrame:
        return prompts.select("document_id").join(responses.select("document_id", "response_json"), "document_id")

    return complete


