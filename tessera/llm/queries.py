"""Queries of the problems on training text, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.llm.history import replay_batches
from tessera.llm.leakage import find_leaks, leak_report
from tessera.llm.normalise import lookalike_records, normalised_fields
from tessera.llm.pii import find_pii, redact
from tessera.llm.spans import shared_spans
from tessera.llm.splitting import split_chunks
from tessera.llm.tokenising import TOKENIZER_DIR, decode_corpus, encode_corpus, encode_with_offsets
from tessera.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_records(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "cells"))


def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_fields(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "cells"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_batches(read_table(spark, sf_dir, "uploads"), read_table(spark, sf_dir, "chunks")).rejections()


def p3_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_batches(read_table(spark, sf_dir, "uploads"), read_table(spark, sf_dir, "chunks")).accepted()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(read_table(spark, sf_dir, "chunks")).filter("piece_no = 1").select("chunk_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(read_table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(*(read_table(spark, sf_dir, t) for t in ("chunks", "cells", "uploads")))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(*(read_table(spark, sf_dir, t) for t in ("chunks", "cells", "uploads")))


def p7_ids(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"), "byte_bpe_50k", folder)


def p7_decoded(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Every text back from its ids."""
    return decode_corpus(p7_ids(spark, sf_dir, folder), "byte_bpe_50k", folder)


def p7_covered(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Per document what the offsets of its tokens cover: from the first character
    to the last without a gap."""
    tokens = encode_with_offsets(read_table(spark, sf_dir, "documents"), "byte_bpe_50k", folder)
    order = Window.partitionBy("doc_id").orderBy("token_no")
    gap = F.col("begin_char") > F.coalesce(F.lag("end_char").over(order), F.lit(0))
    return tokens.withColumn("gap", gap).groupBy("doc_id").agg(F.max("end_char").alias("n_chars"), F.count_if("gap").alias("gaps"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(read_table(spark, sf_dir, "documents")).pairs()


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(read_table(spark, sf_dir, "documents")).coverage()


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(read_table(spark, sf_dir, "documents")).classes()


def queries() -> dict[str, Query]:
    found = (p2_found, p2_normalised, p3_found, p3_accepted, p5_found, p5_pieces, p6_found, p6_redacted, p7_ids, p7_decoded, p7_covered, p8_found, p8_report, p9_found, p9_coverage, p9_classes)
    return {f.__name__: f for f in found}


_WINDOWS = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400),
            w AS (SELECT DISTINCT doc_id, k, md5(substring(text, k, 400)) AS g
                  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS k FROM d))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2400",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_covered": "SELECT doc_id, CAST(length(text) AS INT) AS n_chars, CAST(0 AS BIGINT) AS gaps FROM documents WHERE text <> ''",
        "p8_found": """
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
            dg AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
            ig AS (SELECT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
        """,
        "p9_found": """
            WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400),
            w AS (SELECT DISTINCT doc_id, md5(substring(text, k, 400)) AS g
                  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS k FROM d))
            SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
            FROM w a JOIN w b ON a.g = b.g AND a.doc_id < b.doc_id
        """,
        "p9_coverage": f"""
            WITH {_WINDOWS},
            s AS (SELECT DISTINCT doc_id, k FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1)),
            e AS (SELECT doc_id, k, k - coalesce(max(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -400) AS gap FROM s),
            c AS (SELECT doc_id, CAST(sum(least(gap, 400)) AS BIGINT) AS shared_chars FROM e GROUP BY 1),
            l AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n_links FROM w a JOIN w b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1)
            SELECT doc_id, CAST(length(text) AS INT) AS n_chars, shared_chars, n_links FROM c JOIN l USING (doc_id) JOIN d USING (doc_id)
        """,
        "p9_classes": f"""
            WITH {_WINDOWS}
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS class_size
            FROM d WHERE doc_id IN (SELECT doc_id FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1))
        """,
    }
