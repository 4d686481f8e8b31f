"""Queries of the reference's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import text, values
from tessera.operators import answer, chunking, filters, mapping, verify, views
from tessera.operators.filters import Condition as C, FilterRequest as R
from tessera.operators.nested import link_parents, shred_responses
from tessera.plans import catalog, gateway
from tessera.plans.orders import SQL as BASE, orders_collection, with_provenance
from tessera.session import read_table
from tessera.sources.exports import json_rows
from tessera.sources.files import detect_format, java_trim
from tessera.streaming.limiter import charged, limit_requests

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


MAIN = "SELECT _row_id, customer_name, status, total, order_date, priority, segment, urgent FROM orders_main m"


def _documents(name: str, where: str, *conditions: C, match: str = "all") -> None:
    """A filter on the main table against its WHERE clause."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = filters.filter_documents(orders_collection(spark, sf_dir), R(list(conditions), match))
        return answer.strip_internal(found.withColumn("row_id", F.col("_row_id")))

    _add(name, query, f"WITH {BASE} {MAIN.replace('_row_id', '_row_id AS row_id')}" + (f" WHERE {where}" if where else ""))


_documents("flt_eq", "status = 'F'", C("Status", "eq", "F"))
_documents("flt_neq_null_safe", "status IS DISTINCT FROM 'F'", C("Status", "neq", "F"))
_documents("flt_contains", "customer_name ILIKE '%0007%'", C("Customer Name", "contains", "0007"))
_documents("flt_contains_number", "CASE WHEN total = round(total) THEN CAST(CAST(total AS BIGINT) AS VARCHAR) ELSE CAST(total AS VARCHAR) END ILIKE '%99.%'", C("Total", "contains", "99."))
_documents("flt_contains_escaped", "priority ILIKE '%1\\_URG%' ESCAPE '\\' OR priority ILIKE '%4-n%'", C("Priority", "contains", "1_URG"), C("Priority", "contains", "4-n"), match="any")
_documents("flt_starts", "segment ILIKE 'mach%'", C("Segment", "starts_with", "mach"))
_documents("flt_ends", "priority ILIKE '%low'", C("priority", "ends_with", "LOW"))
_documents("flt_range_num", "total >= 150000 AND total < 250000.5", C("Total", "gte", "$150,000"), C("Total", "lt", 250000.5))
_documents("flt_range_date_text", "order_date > '1995-06-01' AND order_date <= '1996-06-01'", C("Order Date", "gt", "1995-06-01"), C("order_date", "lte", "1996-06-01"))
_documents("flt_is_empty", "status IS NULL OR trim(status) = ''", C("Status", "is_empty"))
_documents("flt_is_not_empty", "NOT (status IS NULL OR trim(status) = '')", C("Status", "is_not_empty"))
_documents("flt_boolean", "urgent = true", C("Urgent", "eq", "Yes"))
_documents("flt_match_any", "status = 'O' OR total > 300000", C("Status", "eq", "O"), C("Total", "gt", 300000), match="any")
_documents("flt_match_all", "status = 'O' AND total > 200000", C("Status", "eq", "O"), C("Total", "gt", 200000))
_documents("flt_none", "")
ITEM = "EXISTS (SELECT 1 FROM line_items c WHERE c._parent_row_id = m._row_id AND {})"
PART = "EXISTS (SELECT 1 FROM parts c WHERE c._parent_row_id = m._row_id AND {})"
L, P = "Line Items", "Parts"
_documents("exists_same_row", ITEM.format("c.quantity > 45 AND c.return_flag = 'R'"), C("Quantity", "gt", 45, L), C("Return Flag", "eq", "R", L))
_documents("exists_any_row", ITEM.format("c.quantity > 49") + " OR " + ITEM.format("c.discount >= 0.1"), C("Quantity", "gt", 49, L), C("Discount", "gte", 0.1, L), match="any")
_documents("exists_two_entities", ITEM.format("c.quantity > 40") + " AND " + PART.format("c.size < 10"), C("Quantity", "gt", 40, L), C("Size", "lt", 10, P))
_documents("exists_mixed_or", "m.total > 350000 OR " + PART.format("c.size = 50"), C("Total", "gt", 350000), C("Size", "eq", 50, P), match="any")
_documents("exists_mixed_and", "m.status = 'F' AND " + ITEM.format("c.tax > 0.07"), C("Status", "eq", "F"), C("Tax", "gt", 0.07, L))


def page_sorted_desc(spark, sf_dir):
    page, _, _ = filters.filter_page(orders_collection(spark, sf_dir), R([], sort="Total", direction="desc", page=2, limit=50))
    return page.select(F.col("_row_id").alias("row_id"), "total")


_add("page_sorted_desc", page_sorted_desc, f"WITH {BASE} SELECT _row_id AS row_id, total FROM orders_main ORDER BY total DESC NULLS FIRST, _row_id LIMIT 50 OFFSET 50")


def page_sorted_asc(spark, sf_dir):
    page, _, _ = filters.filter_page(orders_collection(spark, sf_dir), R([C("Total", "gt", 1000)], sort="Status", page=1, limit=5000))
    return page.select(F.col("_row_id").alias("row_id"), "status")


_add("page_sorted_asc", page_sorted_asc, f"WITH {BASE} SELECT _row_id AS row_id, status FROM orders_main WHERE total > 1000 ORDER BY status ASC NULLS LAST, _row_id LIMIT 1000")
_add("page_of_table", lambda s, d: filters.page_of(orders_collection(s, d).main, 3, 25).select(F.col("_row_id").alias("row_id"), "customer_name"), f"WITH {BASE} SELECT _row_id AS row_id, customer_name FROM orders_main ORDER BY _row_id LIMIT 25 OFFSET 50")
_add("distinct_status", lambda s, d: filters.distinct_values(orders_collection(s, d), "Status"), f"WITH {BASE} SELECT DISTINCT status AS value FROM orders_main WHERE status IS NOT NULL AND trim(status) <> ''")
_add("distinct_nested_size", lambda s, d: filters.distinct_values(orders_collection(s, d), "Size", "Parts", 500), f"WITH {BASE} SELECT DISTINCT CAST(CAST(size AS BIGINT) AS VARCHAR) AS value FROM parts WHERE size IS NOT NULL ORDER BY 1 LIMIT 500")


def _entries(name: str, where: str, *conditions: C, match: str = "all") -> None:
    def query(spark, sf_dir):
        _, rows, entity = filters.filter_page(orders_collection(spark, sf_dir, numbered=True), R(list(conditions), match))
        assert entity == "Line Items"
        return rows.select(F.col("_row_id").alias("row_id"), "_parent_row_id", "quantity", "return_flag", "parent").withColumnRenamed("_parent_row_id", "parent_row_id")

    _add(name, query, f"WITH {BASE} SELECT c._row_id AS row_id, c._parent_row_id AS parent_row_id, c.quantity, c.return_flag, m.customer_name AS parent FROM line_items c JOIN orders_main m ON c._parent_row_id = m._row_id WHERE {where}")


_entries("entries_with_parent", "c.quantity > 48", C("Quantity", "gt", 48, L))
_entries("entries_parent_filter", "(c.quantity > 30 AND c.return_flag = 'A') AND (m.status = 'F')", C("Quantity", "gt", 30, L), C("Return Flag", "eq", "A", L), C("Status", "eq", "F"))
_entries("entries_match_any", "(c.quantity > 49 OR c.discount = 0) AND (m.total > 200000)", C("Quantity", "gt", 49, L), C("Discount", "eq", 0, L), C("Total", "gt", 200000), match="any")

LEVEL = "CASE WHEN _row_id % 7 = 0 THEN 'low' WHEN _row_id % 3 = 0 THEN 'medium' ELSE 'high' END"


def _projected(spark, sf_dir):
    return answer.project_cells(with_provenance(orders_collection(spark, sf_dir).main))


_add(
    "provenance_long",
    lambda s, d: answer.long_cells(_projected(s, d)).withColumnRenamed("_row_id", "row_id"),
    f"""WITH {BASE} SELECT _row_id AS row_id, 'customer_name' AS column_name, customer_name AS value, CAST(NULL AS VARCHAR) AS confidence, CAST(NULL AS INT) AS page, CAST(NULL AS VARCHAR) AS raw_source FROM orders_main
        UNION ALL SELECT _row_id, 'status', status, 'high', NULL, NULL FROM orders_main
        UNION ALL SELECT _row_id, 'total', CAST(total AS VARCHAR), {LEVEL}, CAST(_row_id % 5 + 1 AS INT), 'order ' || _row_id FROM orders_main""",
)
_add(
    "provenance_total",
    lambda s, d: _projected(s, d).select(F.col("_row_id").alias("row_id"), F.col("total.value").cast("double").alias("total"), F.col("total.confidence").alias("confidence"), F.col("total.page").alias("page"), F.col("total.raw_source").alias("raw_source")),
    f"WITH {BASE} SELECT _row_id AS row_id, total, {LEVEL} AS confidence, CAST(_row_id % 5 + 1 AS INT) AS page, 'order ' || _row_id AS raw_source FROM orders_main",
)
_add(
    "coverage_counts",
    lambda s, d: answer.coverage(_projected(s, d), excluded=True),
    f"""WITH {BASE} SELECT count(*) AS total_rows, count(*) FILTER (WHERE _row_id % 7 <> 0) AS included_rows, count(*) FILTER (WHERE _row_id % 7 = 0) AS excluded_rows,
        CAST(sum(CASE WHEN _row_id % 7 <> 0 THEN 2 + CASE WHEN status IS NULL THEN 0 ELSE 1 END ELSE 0 END) AS BIGINT) AS cells_with_values, CAST(0 AS BIGINT) AS low_cells, true AS verifiable FROM orders_main""",
)
_add("coverage_line", lambda s, d: views.coverage_line(answer.coverage(_projected(s, d))), f"WITH {BASE} SELECT sum(CASE WHEN _row_id % 7 = 0 THEN 1 ELSE 0 END) || ' of ' || sum(2 + CASE WHEN status IS NULL THEN 0 ELSE 1 END) || ' values were low-confidence.' AS line FROM orders_main")
_add("exclude_low_rows", lambda s, d: answer.exclude_low(_projected(s, d)).select(F.col("_row_id").alias("row_id")), f"WITH {BASE} SELECT _row_id AS row_id FROM orders_main WHERE _row_id % 7 <> 0")
_add(
    "sum_incl_excl_low",
    lambda s, d: answer.sums_by_confidence(_projected(s, d).select(F.col("total.value").cast("decimal(18,2)").alias("v"), F.col("total.confidence").alias("c")), "v", "c").select(*[F.col(c).cast("double").alias(c) for c in ("including_low", "excluding_low")]),
    f"WITH {BASE} SELECT CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS including_low, CAST(sum(CASE WHEN _row_id % 7 <> 0 THEN CAST(total AS DECIMAL(18,2)) END) AS DOUBLE) AS excluding_low FROM orders_main",
)


def answer_headline(spark, sf_dir):
    rows = filters.filter_documents(orders_collection(spark, sf_dir), R([C("Status", "eq", "O")]))
    total = rows.count()
    kind = answer.answer_type(["customer_name", "total"], min(total, filters.PAGE_ROWS))
    return spark.createDataFrame([(kind, answer.headline(kind, ["customer_name", "total"], min(total, filters.PAGE_ROWS), total))], "answer_type string, headline string")


_add("answer_headline", answer_headline, f"WITH {BASE} SELECT 'table' AS answer_type, count(*) || ' results' AS headline FROM orders_main WHERE status = 'O'")

_money = lambda c: F.col(c).cast("decimal(18,2)")


def total_crosscheck(spark, sf_dir):
    c = orders_collection(spark, sf_dir)
    exact = lambda c: F.col(c).cast("decimal(12,2)")
    items = c.children["Line Items"].withColumn("line", exact("amount") * (1 - exact("discount")) * (1 + exact("tax")))
    out = verify.cross_check(c.main, items, "total", "line", is_subtotal=True)
    return out.select(F.col("_row_id").alias("row_id"), F.col("expected").cast("double").alias("expected"), "stated", "agrees")


_add(
    "total_crosscheck", total_crosscheck,
    f"""WITH {BASE}, s AS (SELECT _parent_row_id, CAST(sum(CAST(amount AS DECIMAL(12,2)) * (1 - CAST(discount AS DECIMAL(12,2))) * (1 + CAST(tax AS DECIMAL(12,2)))) AS DOUBLE) AS expected FROM line_items GROUP BY 1)
        SELECT _row_id AS row_id, expected, total AS stated, abs(expected - total) <= greatest(0.02, abs(total) * 0.01) AS agrees FROM orders_main JOIN s ON _row_id = _parent_row_id""",
)
_add("export_strip", lambda s, d: answer.strip_internal(orders_collection(s, d).main), f"WITH {BASE} SELECT customer_name, status, total, order_date, priority, segment, urgent FROM orders_main")
_add("export_json", lambda s, d: json_rows(orders_collection(s, d).main.select("_row_id", "customer_name", "status", "urgent")), f"""WITH {BASE} SELECT '{{"customer_name":"' || customer_name || '","status":' || coalesce('"' || status || '"', 'null') || ',"urgent":' || CASE WHEN urgent THEN 'true' ELSE 'false' END || '}}' AS row FROM (SELECT * FROM orders_main ORDER BY _row_id LIMIT 100000)""")


def _gateway(name: str, sql: str) -> None:
    def query(spark, sf_dir):
        c = orders_collection(spark, sf_dir)
        return gateway.run_sql(spark, sql, {"data_o": c.main, "data_o_line_items": c.children["Line Items"], "data_o_parts": c.children["Parts"]})

    views_sql = "data_o AS (SELECT * FROM orders_main), data_o_line_items AS (SELECT * FROM line_items), data_o_parts AS (SELECT * FROM parts)"
    body = sql.rstrip(";")
    opening = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    own = body[len(opening):] if body.upper().startswith(opening) else None
    _add(name, query, f"{opening}{BASE}, {views_sql}, {own}" if own else f"WITH {BASE}, {views_sql} {body}")


_gateway("gateway_cte_groupby", "WITH t AS (SELECT segment, total FROM data_o WHERE total > 1000) SELECT segment, count(*) AS n, max(total) AS top FROM t GROUP BY segment HAVING count(*) > 1")
_gateway("gateway_join_child", "SELECT p.status, count(*) AS n FROM data_o p JOIN data_o_line_items c ON c._parent_row_id = p._row_id WHERE c.quantity > 10 GROUP BY p.status;")
_gateway("gateway_union", "SELECT status AS v FROM data_o UNION SELECT return_flag FROM data_o_line_items")
_gateway("gateway_except", "SELECT segment AS v FROM data_o EXCEPT SELECT segment FROM data_o WHERE segment LIKE 'A%'")
_gateway("gateway_exists_case", "SELECT CASE WHEN total > 200000 THEN 'large' ELSE 'small' END AS size_class, count(*) AS n FROM data_o m WHERE EXISTS (SELECT 1 FROM data_o_parts c WHERE c._parent_row_id = m._row_id AND c.size < 5) GROUP BY 1")
_gateway("gateway_window", "SELECT row_id, lag(total) OVER (ORDER BY row_id) AS before FROM (SELECT _row_id AS row_id, total FROM data_o WHERE urgent) x")
_gateway("gateway_outer_join", "SELECT a.segment, count(b.row_id) AS n FROM (SELECT DISTINCT segment FROM data_o) a LEFT JOIN (SELECT segment, _row_id AS row_id FROM data_o WHERE total > 300000) b ON a.segment = b.segment GROUP BY a.segment")
_gateway("top5_customers", "SELECT customer_name, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM data_o GROUP BY customer_name ORDER BY spend DESC, customer_name LIMIT 5")
_gateway("total_by_status", "SELECT status, count(*) AS n, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS sum_total FROM data_o GROUP BY status")
_gateway("avg_total", "SELECT CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / count(total) AS avg_total FROM data_o")
_gateway("most_recent_order", "SELECT _row_id AS row_id, order_date FROM data_o ORDER BY order_date DESC, _row_id DESC LIMIT 1")
_gateway("window_top3", "SELECT segment, row_id, place, total FROM (SELECT segment, _row_id AS row_id, total, row_number() OVER (PARTITION BY segment ORDER BY total DESC, _row_id) AS place FROM data_o) x WHERE place <= 3")
_gateway("grouping_sets", "SELECT status, segment, count(*) AS n, CAST(grouping(status) * 2 + grouping(segment) AS INT) AS gid FROM data_o GROUP BY CUBE (status, segment)")
_gateway("gateway_range_join", "SELECT b.low, count(*) AS n FROM data_o o JOIN (SELECT DISTINCT CAST(floor(total / 100000) * 100000 AS BIGINT) AS low FROM data_o) b ON o.total >= b.low AND o.total < b.low + 100000 GROUP BY b.low")
_gateway("gateway_lateral", "SELECT m._row_id AS row_id, x.top, x.n FROM data_o m, LATERAL (SELECT max(c.quantity) AS top, count(*) AS n FROM data_o_line_items c WHERE c._parent_row_id = m._row_id) x")
_gateway("gateway_recursive", "WITH RECURSIVE t(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t WHERE k < 5) SELECT t.k, count(o._row_id) AS n FROM t LEFT JOIN data_o o ON o._row_id % 7 = t.k GROUP BY t.k")
_gateway("gateway_casts", "SELECT (floor(total / 50000))::int AS band, count(*)::text AS n, min(order_date)::date AS first_day FROM data_o GROUP BY 1")
_gateway("gateway_functions", "SELECT upper(substr(segment, 1, 4)) AS seg, coalesce(status, 'none') AS status, extract(year FROM CAST(order_date AS DATE)) AS y, round(CAST(avg(total) AS DOUBLE) / 1000000, 3) AS mean, count(DISTINCT priority) AS kinds, count(*) FILTER (WHERE urgent) AS urgent FROM data_o GROUP BY 1, 2, 3")
_gateway("gateway_full_join", "SELECT a.k, a.n AS low_n, b.n AS high_n FROM (SELECT status AS k, count(*) AS n FROM data_o WHERE total < 50000 GROUP BY status) a FULL OUTER JOIN (SELECT status AS k, count(*) AS n FROM data_o WHERE total > 400000 GROUP BY status) b ON a.k = b.k")
_gateway("gateway_in_not_exists", "SELECT segment, count(*) AS n FROM data_o m WHERE status IN ('O', 'F') AND NOT EXISTS (SELECT 1 FROM data_o_line_items c WHERE c._parent_row_id = m._row_id AND c.return_flag = 'R') AND total BETWEEN 1000 AND 300000 GROUP BY segment")
_gateway("gateway_limit_offset", "SELECT _row_id AS row_id, total FROM data_o ORDER BY total DESC, _row_id LIMIT 20 OFFSET 40")
_gateway("gateway_intersect", "SELECT segment AS v FROM data_o WHERE urgent INTERSECT SELECT segment FROM data_o WHERE total > 200000")
_gateway("gateway_rollup", "SELECT status, segment, count(*) AS n FROM data_o GROUP BY ROLLUP (status, segment)")

# scalar functions and checks
_add("parse_number", lambda s, d: read_table(s, d, "orders").select("o_orderkey", values.parse_number(F.concat(F.lit("$ "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))).alias("number"), values.parse_number(F.col("o_orderpriority")).alias("none")), "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS none FROM orders")
_add("parse_boolean", lambda s, d: read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", values.parse_boolean(F.when(F.col("l_returnflag") == "R", "YES").when(F.col("l_returnflag") == "A", "0").otherwise(" y")).alias("flag")), "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS flag FROM lineitem")
_add("sanitize_names", lambda s, d: read_table(s, d, "part").select("p_partkey", values.sanitize_name(F.concat(F.lit("_"), "p_name", F.lit(" (N° 7)  ")) ).alias("name")), "SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower('_' || p_name || ' (N° 7)  '), '[^a-z0-9_\\s]', '', 'g')), '\\s+', '_', 'g'), '^_', ''), '_$', ''), 1, 63) AS name FROM part")
_add("content_sha256", lambda s, d: read_table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents")
_add("cache_dedupe", lambda s, d: read_table(s, d, "documents").select(catalog.cache_key(F.sha2("text", 256), F.coalesce("document_type", F.lit(""))).alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "SELECT CASE WHEN text IS NULL THEN NULL ELSE sha256(sha256(text) || chr(0) || coalesce(document_type, '')) END AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
_add("normalize_text", lambda s, d: read_table(s, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("plain")), "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")


def phrase_contains(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").withColumn("plain", text.normalize_text(F.col("text")))
    return rows.select("doc_id", text.phrase_in(F.lit("invoice"), F.col("plain"), text.words_of(F.col("plain"))).alias("found"))


_add("phrase_contains", phrase_contains, "SELECT doc_id, coalesce(contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'invoice'), false) AS found FROM documents")
_add("phone_digits", lambda s, d: read_table(s, d, "chunks").select("chunk_id", text.phone_in(F.lit("555-01-0"), text.digits_only(F.col("text"))).alias("short"), text.phone_in(F.lit("+020 7946"), text.digits_only(F.col("text"))).alias("found")), "SELECT chunk_id, CASE WHEN text IS NULL THEN CAST(false AS BOOLEAN) ELSE false END AS short, contains(regexp_replace(text, '\\D+', '', 'g'), '0207946') AS found FROM chunks")
_add("match_keys", lambda s, d: read_table(s, d, "cells").select("column_name").distinct().select("column_name", text.match_key(F.col("column_name")).alias("key"), text.title_case(F.col("column_name")).alias("title")).select("column_name", "key"), "SELECT DISTINCT column_name, regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g') AS key FROM cells")
_add("validate_email_text", lambda s, d: read_table(s, d, "cells").filter("column_type = 'email' and value_text is not null").select("cell_id", values.is_email(F.col("value_text")).alias("ok")), "SELECT cell_id, regexp_full_match(trim(value_text), '[^\\s@]+@[^\\s@.]+(\\.[^\\s@.]+)+') AS ok FROM cells WHERE column_type = 'email' AND value_text IS NOT NULL")
_add("validate_date", lambda s, d: read_table(s, d, "cells").filter("column_type = 'date' and value_text is not null").select("cell_id", values.is_iso_date(F.col("value_text")).alias("ok")), "SELECT cell_id, regexp_full_match(trim(value_text), '\\d{4}-\\d{2}-\\d{2}') AND TRY_CAST(trim(value_text) AS DATE) IS NOT NULL AS ok FROM cells WHERE column_type = 'date' AND value_text IS NOT NULL")
_add("validate_url", lambda s, d: read_table(s, d, "cells").filter("column_type = 'url' and value_text is not null").select("cell_id", values.is_url(F.col("value_text")).alias("ok")), "SELECT cell_id, regexp_full_match(trim(value_text), '(?i)(https?://)?([a-z0-9_-]+\\.)+[a-z]{2,}(:\\d+)?([/?#]\\S*)?') AS ok FROM cells WHERE column_type = 'url' AND value_text IS NOT NULL")
_add("format_detect", lambda s, d: read_table(s, d, "uploads").select("upload_id", detect_format(F.col("content_type"), F.col("filename")).alias("format")), """
    SELECT upload_id, coalesce(CASE lower(content_type) WHEN 'application/pdf' THEN 'pdf' WHEN 'text/csv' THEN 'csv' WHEN 'text/plain' THEN 'text' WHEN 'text/tab-separated-values' THEN 'csv'
        WHEN 'image/png' THEN 'image' WHEN 'image/jpeg' THEN 'image' WHEN 'image/jpg' THEN 'image' WHEN 'image/webp' THEN 'image' WHEN 'image/tiff' THEN 'image' END,
        CASE lower(regexp_extract(filename, '\\.([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'csv' WHEN 'txt' THEN 'text' WHEN 'text' THEN 'text' WHEN 'md' THEN 'text' WHEN 'log' THEN 'text'
        WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'tiff' THEN 'image' WHEN 'tif' THEN 'image' END) AS format FROM uploads""")
_add("text_trim", lambda s, d: read_table(s, d, "documents").select("doc_id", F.length(java_trim(F.col("text"))).alias("n")), "SELECT doc_id, CAST(length(regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS INT) AS n FROM documents")

# documents: chunking, scoring, mapping


def chunk_documents(spark, sf_dir):
    pages = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    return chunking.chunk_pages(pages).select("document_id", "chunk_index", "page", "text")


_add("chunk_pages", chunk_documents)
_add("chunk_counts", lambda s, d: chunk_documents(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")))


def _scored(spark, sf_dir):
    return verify.score_cells(read_table(spark, sf_dir, "cells"), read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "uploads"))


_add("score_cells", lambda s, d: _scored(s, d).drop("has_value"))
_add("doc_confidence", lambda s, d: verify.document_confidence(_scored(s, d)))
_add(
    "level_tally",
    lambda s, d: read_table(s, d, "cells").dropDuplicates(["cell_id"]).select("document_id", verify.reported_level(F.col("reported")).alias("level"), F.coalesce("value_text", F.col("value_num").cast("string"), F.col("value_bool").cast("string")).isNotNull().alias("has_value")).transform(verify.document_confidence),
    """WITH c AS (SELECT DISTINCT cell_id, document_id, CASE WHEN lower(trim(reported)) IN ('high', 'medium', 'low') THEN lower(trim(reported)) ELSE 'medium' END AS level,
            value_text IS NOT NULL OR value_num IS NOT NULL OR value_bool IS NOT NULL AS v FROM cells),
        t AS (SELECT document_id, count(*) FILTER (WHERE v) AS n_values, count(*) FILTER (WHERE v AND level = 'high') AS n_high, count(*) FILTER (WHERE v AND level = 'low') AS n_low FROM c GROUP BY 1)
       SELECT *, CASE WHEN n_values = 0 THEN 'low' WHEN n_high / n_values > 0.7 THEN 'high' WHEN n_low / n_values > 0.3 THEN 'low' ELSE 'medium' END AS confidence,
            CASE WHEN n_low > 0 THEN n_low || ' extracted value(s) could not be fully verified against the document and are marked low confidence' END AS warning FROM t""",
)
_add("map_responses", lambda s, d: mapping.map_responses(read_table(s, d, "model_responses"), read_table(s, d, "collections")))
_add("flat_candidates", lambda s, d: mapping.flat_candidates(read_table(s, d, "cells")).select("cell_id", "column_name").distinct())
_add("section_coverage", lambda s, d: mapping.knowledge_sections(read_table(s, d, "model_responses")))


def _linked(spark, sf_dir):
    return link_parents(shred_responses(read_table(spark, sf_dir, "model_responses"), read_table(spark, sf_dir, "collections")))


_add("view_flatten", lambda s, d: views.flatten_cells(_linked(s, d)))
_add("profile_fields", lambda s, d: views.profile_fields(_linked(s, d)))

# views
_add("view_search_any", lambda s, d: views.search_rows(orders_collection(s, d).main, "BUILD").select(F.col("_row_id").alias("row_id")), f"WITH {BASE} SELECT _row_id AS row_id FROM orders_main WHERE contains(lower(concat_ws(chr(1), customer_name, coalesce(status, ''), CAST(total AS VARCHAR), order_date, priority, segment, CAST(urgent AS VARCHAR))), 'build')")
_add(
    "view_status",
    lambda s, d: _projected(s, d).select(F.col("_row_id").alias("row_id"), views.provenance_status(F.col("total.value"), F.col("total.confidence"), F.col("total.page")).alias("total_status"), views.provenance_status(F.col("status.value"), F.col("status.confidence"), F.col("status.page")).alias("status_status"), views.confidence_label(F.col("total.confidence"), F.lit(0.5)).alias("label")),
    f"WITH {BASE} SELECT _row_id AS row_id, CASE WHEN _row_id % 7 = 0 THEN 'review' ELSE 'verified' END AS total_status, CASE WHEN status IS NULL THEN 'absent' ELSE 'unverified' END AS status_status, upper({LEVEL}[1]) || ({LEVEL})[2:] || ' (0.50)' AS label FROM orders_main".replace("upper(CASE", "upper((CASE").replace("END[1])", "END)[1])"),
)

# limits


def _requests(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("request_id"), F.col("user_id").cast("string").alias("client"), "ts")


_add("charged_calls", lambda s, d: charged(read_table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "post").otherwise("GET").alias("method"), F.when(F.col("event_id") % 3 == 0, "/api/collections").when(F.col("event_id") % 3 == 1, "/api/collections/7/query").otherwise("/api/health").alias("path"))).select("event_id"), "SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 IN (0, 1)")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
