"""Queries over stored collections, synthetic findings and listings, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as Col, DataFrame, SparkSession, Window, functions as F

from tessera.errors import QueryError
from tessera.functions import text, values
from tessera.model import Column
from tessera.operators import answer, chunking, filters, verify, views
from tessera.operators.filters import Condition as C, FilterRequest as R
from tessera.plans import catalog, gateway
from tessera.plans.catalog import Catalog
from tessera.plans.orders import SQL as BASE, orders_collection
from tessera.session import once, read_table, scratch_dir
from tessera.streaming.limiter import limit_requests

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _SQL[name] = query, sql


# a collection of three levels, stored: regions, their nations, those's suppliers

WORLD = [
    Column("Region", "text"), Column("Comment", "text"),
    Column("Nations", "entity_array", has_entity=True, children=[
        Column("Nation", "text"), Column("Suppliers", "entity_array", has_entity=True, children=[Column("Supplier", "text"), Column("Balance", "currency")]),
    ]),
]


def _cells(rows: DataFrame, row_path: Col, document: Col, *columns: tuple[str, str, str]) -> DataFrame:
    """Rows as cells: a column each of (name, source, value column)."""
    kinds = {"value_text": "string", "value_num": "double"}
    items = F.array(*[F.struct(F.lit(name).alias("column_name"), *[(F.col(source) if kind == k else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()], F.lit(None).cast("boolean").alias("value_bool")) for name, source, kind in columns])
    return rows.select(document.cast("string").alias("document_id"), F.lit(0).alias("row_ordinal"), row_path.alias("row_path"), F.explode(items).alias("c")).select("document_id", "row_ordinal", "row_path", "c.*")


def world(spark: SparkSession, sf_dir: str) -> Catalog:
    region, nation, supplier = (read_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    region = region.withColumn("r_comment", F.concat(F.lit("about "), F.lower("r_name")))
    nation = nation.withColumn("n", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    supplier = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("s", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    at = F.concat(F.lit("Nations/"), F.col("n"))
    cells = _cells(region, F.lit(""), F.col("r_regionkey"), ("Region", "r_name", "value_text"), ("Comment", "r_comment", "value_text"))
    cells = cells.unionByName(_cells(nation, at, F.col("n_regionkey"), ("Nation", "n_name", "value_text")))
    cells = cells.unionByName(_cells(supplier, F.concat(at, F.lit("/Suppliers/"), F.col("s")), F.col("n_regionkey"), ("Supplier", "s_name", "value_text"), ("Balance", "s_acctbal", "value_num")))
    store = Catalog(spark, scratch_dir(spark))
    store.create("w", "World", WORLD)
    store.append("w", cells)
    return store


def stored_levels(spark, sf_dir):
    """Every supplier under its nation and region, by the links of the stored tables."""
    t = world(spark, sf_dir).data_tables("w")
    main, nations, suppliers = (t[n] for n in ("data_w", "data_w_nations", "data_w_nations_suppliers"))
    return (
        suppliers.select("supplier", "balance", "_parent_row_id").join(nations.select(F.col("_row_id").alias("_n"), "nation", F.col("_parent_row_id").alias("_r")), F.col("_parent_row_id") == F.col("_n"))
        .join(main.select(F.col("_row_id").alias("_m"), "region"), F.col("_r") == F.col("_m")).select("region", "nation", "supplier", "balance")
    )


LEVELS = "SELECT r_name AS region, n_name AS nation, s_name AS supplier, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_add("stored_levels", stored_levels, LEVELS)


def stored_row_ids(spark, sf_dir):
    """Row ids of each stored table run from 1 without a gap."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("_row_id").alias("n_ids"), F.max("_row_id").alias("last_id")) for n, df in world(spark, sf_dir).data_tables("w").items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_add("stored_row_ids", stored_row_ids, "SELECT t AS table_name, n AS n_rows, n AS n_ids, n AS last_id FROM (SELECT 'data_w' AS t, count(*) AS n FROM region UNION ALL SELECT 'data_w_nations', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'data_w_nations_suppliers', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey)")


def gateway_grandchild(spark, sf_dir):
    sql = "SELECT n.nation, count(*) AS n, max(s.balance) AS top FROM data_w_nations n JOIN data_w_nations_suppliers s ON s._parent_row_id = n._row_id GROUP BY n.nation"
    return gateway.run_sql(spark, sql, world(spark, sf_dir).data_tables("w"))


_add("gateway_grandchild", gateway_grandchild, f"SELECT nation, count(*) AS n, max(balance) AS top FROM ({LEVELS}) GROUP BY 1")


def cell_edit(spark, sf_dir):
    """Values changed by hand: the last change of a cell holds, null empties it."""
    store = world(spark, sf_dir)
    ids = {r.region: r._row_id for r in store.table("w").select("region", "_row_id").collect()}
    for name, column, value in (("ASIA", "Comment", "first"), ("ASIA", "Comment", "second"), ("EUROPE", "comment", None), ("AFRICA", "Region", "Afrika")):
        store.update_cell("w", ids[name], column, value)
    return store.table("w").select("region", "comment")


_add("cell_edit", cell_edit, "SELECT CASE WHEN r_name = 'AFRICA' THEN 'Afrika' ELSE r_name END AS region, CASE WHEN r_name = 'ASIA' THEN 'second' WHEN r_name <> 'EUROPE' THEN 'about ' || lower(r_name) END AS comment FROM region")


def evolve_union(spark, sf_dir):
    """Rows stored before and after a column was added read as one table."""
    store = Catalog(spark, scratch_dir(spark))
    store.create("p", "Partners", [Column("Name", "text")])
    customer, supplier = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    store.append("p", _cells(customer, F.lit(""), F.concat(F.lit("c"), F.col("c_custkey")), ("Name", "c_name", "value_text")))
    store.evolve("p", [Column("Balance", "currency"), Column("NAME", "text")])
    store.append("p", _cells(supplier, F.lit(""), F.concat(F.lit("s"), F.col("s_suppkey")), ("Name", "s_name", "value_text"), ("Balance", "s_acctbal", "value_num")))
    return store.table("p").select(F.col("_document_id").alias("document_id"), "name", "balance")


_add("evolve_union", evolve_union, "SELECT 'c' || c_custkey AS document_id, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) FROM supplier")


def stored_state(spark, sf_dir):
    """What a collection's manifest counts, and that a dropped one is gone."""
    store = world(spark, sf_dir)
    m = store.read("w")
    store.create("gone", "Gone", [Column("A")])
    store.drop("gone")
    try:
        store.read("gone")
        state = "there"
    except Exception as error:
        state = error.code
    return spark.createDataFrame([(m.name, m.documents, m.rows, m.version, state)], "name string, documents bigint, n_rows bigint, version int, dropped string")


_add("stored_state", stored_state, "SELECT 'World' AS name, (SELECT count(*) FROM region) AS documents, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS n_rows, CAST(2 AS INT) AS version, 'NOT_FOUND' AS dropped".replace("'NOT_FOUND'", f"'{catalog.CollectionNotFound.code}'"))

# findings made from keys, through the rubric


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with made-up findings: which of them hold follows from their keys."""
    key = F.col("cell_id")
    rows = once(read_table(spark, sf_dir, "cells"), "cell_id").withColumn("column_type", F.coalesce(F.lower("column_type"), F.lit("text")))
    rows = rows.withColumns({"is_image": key % 11 == 0, "_invalid": key % 7 == 0, "_quote": F.coalesce(F.trim("raw_source"), F.lit("")), "_text": F.coalesce("value_text", F.col("value_num").cast("string"), F.col("value_bool").cast("string"))})
    rows = rows.withColumns({"_located": F.col("is_image") | (key % 5 != 0), "_cited": F.when(F.col("chunk").isNotNull() & (key % 3 != 0), F.struct(F.col("chunk").alias("index"), (F.col("page") + (key % 2).cast("int")).alias("page")))})
    rows = rows.withColumn("_recovered", F.when(F.col("chunk").isNull() & F.col("_located") & ~F.col("is_image") & (key % 4 == 0), F.struct(F.lit(9).alias("index"), F.lit(8).alias("page"))))
    rows = rows.withColumn("_source", F.coalesce("_cited", "_recovered"))
    rows = rows.withColumn("_quote_here", F.col("_source").isNotNull() & (F.col("_quote") != "") & (key % 3 == 1))
    return rows.withColumns({
        "_value_here": F.when(F.col("_source").isNotNull(), key % 2 == 0),
        "_quote_somewhere": F.col("_quote_here") | ((F.col("_quote") != "") & (key % 4 == 1)),
        "_value_quoted": (F.col("_quote") == "") | (key % 6 != 0),
    })


_RUBRIC = """
    k AS (SELECT DISTINCT cell_id, document_id, coalesce(lower(column_type), 'text') AS kind, lower(trim(reported)) AS word, page, chunk, trim(coalesce(raw_source, '')) AS quote,
                 value_text IS NULL AND value_num IS NULL AND value_bool IS NULL AS absent, cell_id % 11 = 0 AS image, cell_id % 7 = 0 AS invalid FROM cells),
    a AS (SELECT *, CASE WHEN word IN ('high', 'medium', 'low') THEN word ELSE 'medium' END AS said, image OR cell_id % 5 <> 0 AS located, chunk IS NOT NULL AND cell_id % 3 <> 0 AS cited, quote = '' AS bare FROM k),
    b AS (SELECT *, chunk IS NULL AND located AND NOT image AND cell_id % 4 = 0 AS recovered FROM a),
    c AS (SELECT *, cited OR recovered AS known, (cited OR recovered) AND NOT bare AND cell_id % 3 = 1 AS quote_here, (cited OR recovered) AND cell_id % 2 = 0 AS here, bare OR cell_id % 6 <> 0 AS quoted FROM b),
    d AS (SELECT *, quote_here OR (NOT bare AND cell_id % 4 = 1) AS somewhere FROM c),
    e AS (SELECT *, 1.0::DOUBLE - (CASE WHEN invalid THEN 0.3::DOUBLE ELSE 0 END)
                - (CASE WHEN image THEN 0::DOUBLE WHEN chunk IS NOT NULL AND NOT cited THEN 0.5::DOUBLE WHEN chunk IS NULL AND NOT recovered THEN 0.3::DOUBLE ELSE 0 END)
                - (CASE WHEN image THEN 0::DOUBLE WHEN bare THEN (CASE WHEN here THEN 0::DOUBLE ELSE 0.15::DOUBLE + (CASE WHEN known THEN 0.2::DOUBLE ELSE 0 END) END)
                        ELSE 0::DOUBLE + (CASE WHEN quote_here THEN 0::DOUBLE WHEN somewhere THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END) + (CASE WHEN quoted THEN 0::DOUBLE ELSE 0.2::DOUBLE END) END)
                - (CASE said WHEN 'low' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.1::DOUBLE ELSE 0 END) AS raw FROM d),
    f AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, raw)) AS points FROM e),
    g AS (SELECT *, CASE WHEN points >= 0.8::DOUBLE THEN 'high' WHEN points >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS by_points, NOT absent AND kind <> 'entity_array' AS has_value FROM f),
    rubric AS (SELECT cell_id, document_id, has_value,
        CASE WHEN kind = 'entity_array' THEN said WHEN absent THEN 'low' WHEN NOT located OR invalid THEN 'low' WHEN image AND by_points = 'high' THEN 'medium' ELSE by_points END AS level,
        CASE WHEN has_value THEN floor(points * 100 + 0.5) / 100 END AS score,
        CASE WHEN has_value AND NOT image THEN CASE WHEN cited THEN page + CAST(cell_id % 2 AS INT) WHEN recovered THEN 8 END END AS page,
        CASE WHEN has_value AND NOT image THEN CASE WHEN cited THEN chunk WHEN recovered THEN 9 END END AS chunk,
        CASE WHEN kind = 'entity_array' THEN NULL WHEN absent THEN 'No value for this field was found in the document' ELSE nullif(array_to_string(list_filter([
            CASE WHEN invalid THEN 'Value failed ' || kind || ' validation' END,
            CASE WHEN image THEN 'Image document — the value could not be verified against extracted text' END,
            CASE WHEN NOT image AND chunk IS NOT NULL AND NOT cited THEN 'Cited chunk ' || chunk || ' does not exist in this document' END,
            CASE WHEN NOT image AND recovered THEN 'Source chunk recovered from document text (model omitted citation)' END,
            CASE WHEN NOT image AND chunk IS NULL AND NOT recovered THEN 'No source chunk was cited for this value' END,
            CASE WHEN NOT image AND cited AND page IS DISTINCT FROM page + CAST(cell_id % 2 AS INT) THEN 'Cited page corrected to ' || (page + CAST(cell_id % 2 AS INT)) || ' from the cited chunk' END,
            CASE WHEN NOT image AND bare AND here THEN 'No verbatim source quote was supplied; value located in cited chunk' END,
            CASE WHEN NOT image AND bare AND NOT here THEN 'No verbatim source quote was supplied' END,
            CASE WHEN NOT image AND bare AND NOT here AND known THEN 'Value does not appear in the cited chunk' END,
            CASE WHEN NOT image AND NOT bare AND NOT quote_here AND somewhere THEN 'Quoted source text was found elsewhere in the document, not in the cited chunk' END,
            CASE WHEN NOT image AND NOT bare AND NOT somewhere THEN 'Quoted source text does not appear anywhere in the document' END,
            CASE WHEN NOT image AND NOT bare AND NOT quoted THEN 'Value does not appear in the quoted source text' END,
            CASE WHEN NOT image AND NOT located THEN 'Value does not appear anywhere in the document text' END], lambda x: x IS NOT NULL), '; '), '') END AS note FROM g)
"""
_add("score_rubric", lambda s, d: verify.scored(_findings(s, d)), f"WITH {_RUBRIC} SELECT * FROM rubric")
_add(
    "rubric_documents", lambda s, d: verify.document_confidence(verify.scored(_findings(s, d))),
    f"""WITH {_RUBRIC}, t AS (SELECT document_id, count(*) FILTER (WHERE has_value) AS n_values, count(*) FILTER (WHERE has_value AND level = 'high') AS n_high, count(*) FILTER (WHERE has_value AND level = 'low') AS n_low FROM rubric GROUP BY 1)
        SELECT *, CASE WHEN n_values = 0 THEN 'low' WHEN n_high / n_values > 0.7 THEN 'high' WHEN n_low / n_values > 0.3 THEN 'low' ELSE 'medium' END AS confidence,
            CASE WHEN n_low > 0 THEN n_low || ' extracted value(s) could not be fully verified against the document and are marked low confidence' END AS warning FROM t""",
)
_add(
    "review_reasons", lambda s, d: verify.scored(_findings(s, d)).select("cell_id", views.review_reason(F.col("note"), F.when(F.col("has_value"), "review").otherwise("absent")).alias("reason")),
    f"""WITH {_RUBRIC}, n AS (SELECT cell_id, note, lower(regexp_extract(note, '(?i)failed (\\w+) validation', 1)) AS kind FROM rubric WHERE has_value AND note IS NOT NULL)
        SELECT r.cell_id, CASE WHEN n.note IS NULL THEN NULL WHEN n.note LIKE '%does not appear anywhere in the document%' THEN 'The exact wording could not be located in the document text.'
            WHEN kind <> '' THEN 'The value does not look like a valid ' || CASE kind WHEN 'url' THEN 'web address' WHEN 'email' THEN 'email address' WHEN 'currency' THEN 'amount' WHEN 'boolean' THEN 'yes/no value' ELSE kind END || '.'
            WHEN n.note ILIKE '%image document%' THEN 'This document is an image, so its text could not be checked.'
            WHEN regexp_matches(n.note, '(?i)found elsewhere|does not appear in the cited|does not appear in the quoted') THEN 'The value appears in a different part of the document than the extraction indicated.'
            WHEN regexp_matches(n.note, '(?i)no source chunk was cited|does not exist in this document|no verbatim source quote') THEN 'The extraction did not point to a specific place in the document.' END AS reason
        FROM rubric r LEFT JOIN n ON r.cell_id = n.cell_id""",
)


def _validated(spark, sf_dir):
    rows = once(read_table(spark, sf_dir, "cells"), "cell_id").withColumn("kind", F.coalesce(F.lower("column_type"), F.lit("text")))
    typed = F.when(F.col("kind").isin("number", "currency"), F.col("value_num").isNotNull()).otherwise(F.col("value_bool").isNotNull())
    held = F.coalesce("value_text", F.when(F.col("value_num").isNotNull(), "1"), F.when(F.col("value_bool").isNotNull(), "true"))
    return rows.select("cell_id", values.validate_value(held, typed, F.col("kind"), F.col("column_name")).alias("outcome"))


_add(
    "validate_values", _validated,
    r"""WITH c AS (SELECT DISTINCT cell_id, column_name AS name, coalesce(lower(column_type), 'text') AS kind, value_num, value_bool, coalesce(value_text, CASE WHEN value_num IS NOT NULL THEN '1' END, CASE WHEN value_bool IS NOT NULL THEN 'true' END) AS t FROM cells),
        p AS (SELECT *, trim(t) AS plain, translate(trim(t), '–—', '--') AS folded, length(regexp_replace(trim(t), '\D', '', 'g')) AS digits FROM c),
        o AS (SELECT cell_id, CASE WHEN t IS NULL OR kind = 'entity_array' THEN NULL
            WHEN kind IN ('number', 'currency') THEN value_num IS NOT NULL WHEN kind = 'boolean' THEN value_bool IS NOT NULL
            WHEN kind = 'date' THEN regexp_full_match(plain, '\d{4}-\d{2}-\d{2}') AND try_cast(plain AS DATE) IS NOT NULL
            WHEN kind = 'email' THEN regexp_full_match(plain, '[^\s@]+@[^\s@.]+(\.[^\s@.]+)+')
            WHEN kind = 'url' THEN regexp_full_match(plain, '(?i)(https?://)?([\w-]+\.)+[a-z]{2,}(:\d+)?([/?#]\S*)?')
            WHEN plain = '' OR name IS NULL THEN NULL
            WHEN regexp_matches(name, '(?i)e-?mail') THEN regexp_full_match(plain, '[^\s@]+@[^\s@.]+(\.[^\s@.]+)+')
            WHEN regexp_matches(name, '(?i)(phone|mobile|cell|fax|telephone|\btel\b|whatsapp|contact[\s_-]?(number|no|num|phone|mobile))') THEN digits BETWEEN 7 AND 17 AND regexp_full_match(folded, '[0-9+()\-.\s/extEXT]+')
            WHEN regexp_matches(name, '(?i)(\bid\b|_id|number|\bno\b|\bnum\b|reference|\bref\b|\bcode\b|sku|account)') THEN length(plain) <= 64 AND NOT contains(plain, chr(10)) AND len(regexp_split_to_array(plain, '\s+')) <= 4 AND regexp_matches(plain, '\d|\p{L}')
            END AS ok FROM p)
        SELECT cell_id, CASE WHEN ok IS NULL THEN 'n/a' WHEN ok THEN 'valid' ELSE 'invalid' END AS outcome FROM o""",
)

# text


def numbers_in_text(spark, sf_dir):
    found = once(read_table(spark, sf_dir, "cells"), "cell_id").select("cell_id", F.array_distinct(F.transform(text.numbers_in(F.col("raw_source")), lambda x: x + F.lit(0.0))).alias("n"))  # one zero
    return found.select("cell_id", F.when(F.col("n").isNotNull(), F.size("n")).alias("n"), F.array_min("n").alias("least"), F.array_max("n").alias("most"))


_add(
    "numbers_in_text", numbers_in_text,
    r"""WITH c AS (SELECT DISTINCT cell_id, raw_source FROM cells),
        j AS (SELECT cell_id, array_to_string(list_transform(regexp_extract_all(raw_source, '[0-9,]+|[^0-9,]+'), lambda t: CASE WHEN regexp_full_match(t, '\d{1,3}(,\d{2,3})+') THEN replace(t, ',', '') ELSE t END), '') AS t FROM c),
        m AS (SELECT cell_id, t, list_distinct(list_transform(list_concat(regexp_extract_all(t, '\d+(?:\.\d+)?'), list_transform(list_concat(regexp_extract_all(t, '(?:-|\(-\))\s*(\d+(?:\.\d+)?)', 1), regexp_extract_all(t, '\(\s*(\d+(?:\.\d+)?)\s*\)', 1)), lambda x: '-' || x)), lambda x: CAST(x AS DOUBLE))) AS n FROM j)
        SELECT cell_id, CASE WHEN t IS NOT NULL THEN CAST(len(n) AS INT) END AS n, list_min(n) AS least, list_max(n) AS most FROM m""",
)


def phrases_in_sources(spark, sf_dir):
    rows = once(read_table(spark, sf_dir, "cells"), "cell_id").filter("value_text is not null and raw_source is not null")
    rows = rows.select("cell_id", text.normalize_text(F.col("value_text")).alias("p"), text.normalize_text(F.col("raw_source")).alias("h"))
    return rows.select("cell_id", text.phrase_in(F.col("p"), F.col("h"), text.words_of(F.col("h"))).alias("found"))


_add(
    "phrases_in_sources", phrases_in_sources,
    """WITH c AS (SELECT DISTINCT cell_id, trim(regexp_replace(lower(value_text), '[^a-z0-9]+', ' ', 'g')) AS p, trim(regexp_replace(lower(raw_source), '[^a-z0-9]+', ' ', 'g')) AS h FROM cells WHERE value_text IS NOT NULL AND raw_source IS NOT NULL),
        w AS (SELECT cell_id, p, h, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS pw, CASE WHEN h = '' THEN [] ELSE string_split(h, ' ') END AS hw FROM c),
        s AS (SELECT *, CASE WHEN len(pw) < 6 THEN list_transform(range(1, greatest(1, len(hw) - 2 * len(pw) + 1) + 1), lambda k: list_slice(hw, k, k + 2 * len(pw) - 1)) ELSE [hw] END AS spans FROM w)
       SELECT cell_id, contains(h, p) OR (len(pw) >= 2 AND len(list_filter(spans, lambda q: len(list_filter(list_distinct(pw), lambda x: len(list_filter(q, lambda y: y = x)) < len(list_filter(pw, lambda y: y = x)))) = 0)) > 0) AS found FROM s""",
)
_add(
    "match_titles", lambda s, d: read_table(s, d, "cells").select("column_name").distinct().select("column_name", text.title_case(F.col("column_name")).alias("title")),
    r"SELECT DISTINCT column_name, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(column_name, '[_\-\s]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM cells",
)
_add(
    "unknown_numbers", lambda s, d: once(read_table(s, d, "cells"), "cell_id").select("cell_id", values.introduces_unknown_number(F.coalesce("raw_source", F.lit("")), F.coalesce("value_text", F.lit(""))).alias("unknown")),
    r"SELECT DISTINCT cell_id, len(list_filter(regexp_extract_all(coalesce(raw_source, ''), '\d+(?:\.\d+)?'), lambda n: NOT contains(coalesce(value_text, ''), n))) > 0 AS unknown FROM cells",
)

# chunks


def chunk_content(spark, sf_dir):
    """All that isn't white space stays, in order, whatever the chunks."""
    pages = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    made = chunking.chunk_pages(pages)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "")
    return made.groupBy("document_id").agg(F.md5(F.regexp_replace(whole, r"[\p{javaWhitespace}]", "")).alias("digest"), F.max("chunk_index").alias("last"), F.count(F.lit(1)).cast("int").alias("n")).select("document_id", "digest", (F.col("last") == F.col("n")).alias("numbered"))


_WHITE = r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
_add("chunk_content", chunk_content, f"SELECT doc_id AS document_id, md5(regexp_replace(text, '{_WHITE}', '', 'g')) AS digest, true AS numbered FROM documents WHERE regexp_replace(text, '{_WHITE}', '', 'g') <> ''")
_add(
    "chunk_single",
    lambda s, d: chunking.chunk_pages(read_table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("text")).filter("n = 1").select("document_id", "text"),
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '\\n[ \\t\\n\\x{{0b}}\\f\\r]*\\n'), lambda x: regexp_replace(x, '^{_WHITE}+|{_WHITE}+$', '', 'g')), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL),
        -- one chunk: no paragraph is cut, and none but the first brings the chunk over 1,200
        w AS (SELECT doc_id, parts, list_sum(list_transform(parts, lambda x: length(x))) + 2 * (len(parts) - 1) AS whole, length(parts[-1]) AS last FROM p WHERE len(parts) > 0)
        SELECT doc_id AS document_id, array_to_string(parts, chr(10) || chr(10)) AS text FROM w WHERE len(parts) = 1 AND whole <= 2400 OR len(parts) > 1 AND whole - 2 <= 1200""",
)


def chunk_context(spark, sf_dir):
    rows = once(read_table(spark, sf_dir, "chunks"), "chunk_id").filter("text is not null")
    return chunking.chunk_context(rows).select("document_id", F.md5("context").alias("digest"))


_add(
    "chunk_context", chunk_context,
    """WITH c AS (SELECT DISTINCT chunk_id, document_id, chunk_index, page, text FROM chunks WHERE text IS NOT NULL)
       SELECT document_id, md5(string_agg('[chunk ' || coalesce(chunk_index::VARCHAR, 'null') || ' | page ' || coalesce(page::VARCHAR, 'null') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM c GROUP BY 1""",
)

# listings, pages, orders


_add(
    "collections_listing", lambda s, d: catalog.list_collections(read_table(s, d, "collections")),
    """WITH l AS (SELECT collection_id, max(schema_version) AS version, arg_max(name, schema_version) AS name, max(updated_at) AS updated_at FROM collections GROUP BY 1)
       SELECT *, CAST(row_number() OVER (ORDER BY updated_at DESC NULLS LAST, collection_id) AS INT) AS place FROM l""",
)
_add(
    "documents_listing", lambda s, d: catalog.list_documents(read_table(s, d, "uploads")),
    """WITH u AS (SELECT DISTINCT collection_id, upload_id, filename, file_format, row_count, confidence, created_at FROM uploads)
       SELECT *, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC NULLS LAST, upload_id) AS INT) AS place FROM u""",
)


def _placed(page: DataFrame, *columns: str) -> DataFrame:
    """The rows of a page with the places they come in."""
    numbered = page.withColumn("_at", F.monotonically_increasing_id())
    return numbered.select(*columns, F.row_number().over(Window.orderBy("_at")).alias("place"))


_add(
    "page_in_order", lambda s, d: _placed(filters.filter_page(orders_collection(s, d), R([C("Total", "gt", 1000)], sort="Status", direction="desc", page=2, limit=300))[0].withColumn("row_id", F.col("_row_id")), "row_id", "status"),
    f"WITH {BASE}, p AS (SELECT _row_id AS row_id, status FROM orders_main WHERE total > 1000 ORDER BY status DESC NULLS FIRST, _row_id LIMIT 300 OFFSET 300) SELECT *, CAST(row_number() OVER (ORDER BY status DESC NULLS FIRST, row_id) AS INT) AS place FROM p",
)
_add(
    "entries_in_order", lambda s, d: _placed(filters.filter_page(orders_collection(s, d, numbered=True), R([C("Quantity", "gt", 20, "Line Items"), C("Total", "gt", 100000)], limit=500))[0].withColumn("row_id", F.col("_row_id")), "row_id", "quantity"),
    f"WITH {BASE}, p AS (SELECT c._row_id AS row_id, c.quantity FROM line_items c JOIN orders_main m ON c._parent_row_id = m._row_id WHERE c.quantity > 20 AND m.total > 100000 ORDER BY c._row_id LIMIT 500) SELECT *, CAST(row_number() OVER (ORDER BY row_id) AS INT) AS place FROM p",
)
_add(
    "view_natural_sort", lambda s, d: _placed(views.sort_naturally(read_table(s, d, "part").select(F.concat(F.lit("Size "), "p_size", F.lit(" of "), F.regexp_replace("p_brand", "#", " "))  .alias("label")).distinct(), "label"), "label"),
    "SELECT label, CAST(row_number() OVER (ORDER BY size, brand) AS INT) AS place FROM (SELECT DISTINCT 'Size ' || p_size || ' of ' || replace(p_brand, '#', ' ') AS label, p_size AS size, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS brand FROM part)",
)


def crosscheck_total(spark, sf_dir):
    """Line items against a total with a surcharge and a discount, by the columns' names."""
    c = orders_collection(spark, sf_dir)
    main = c.main.withColumns({"freight": F.when(F.col("_row_id") % 3 != 0, (F.col("_row_id") % 10).cast("double")), "rebate": -(F.col("_row_id") % 4).cast("double")})
    schema = [Column("Freight", "currency"), Column("Rebate", "number"), Column("Total", "currency"), Column("Line Items", "entity_array", has_entity=True, children=[Column("Unit Price", "currency"), Column("Amount", "currency")])]
    _, amount, stated, is_subtotal, more, less = verify.total_columns(schema)
    items = c.children["Line Items"].withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    out = verify.cross_check(main, items, stated.lower(), amount.lower(), is_subtotal, tuple(map(str.lower, more)), tuple(map(str.lower, less)))
    return out.select(F.col("_row_id").alias("row_id"), F.col("expected").cast("double").alias("expected"), "stated", "agrees", F.col("note").isNotNull().alias("noted"))


_add(
    "crosscheck_total", crosscheck_total,
    f"""WITH {BASE}, s AS (SELECT _parent_row_id, CAST(sum(CAST(amount AS DECIMAL(12,2))) AS DOUBLE) AS lines FROM line_items GROUP BY 1),
        e AS (SELECT _row_id AS row_id, lines + CASE WHEN _row_id % 3 <> 0 THEN (_row_id % 10)::DOUBLE ELSE 0 END - (_row_id % 4)::DOUBLE AS expected, total AS stated FROM orders_main JOIN s ON _row_id = _parent_row_id)
        SELECT *, abs(expected - stated) <= greatest(0.02, abs(stated) * 0.01) AS agrees, abs(expected - stated) > greatest(0.02, abs(stated) * 0.01) AS noted FROM e""",
)

# answers and verdicts as case tables

#: columns, rows of the page, total, value, entity, entries; then type and headline
_ANSWERS = (
    (["customer_name", "total"], 100, 1500, None, None, False, "table", "1500 results"), (["total"], 1, 1, "12.5", None, False, "aggregate", "12.5"), (["name"], 1, 1, "Acme", None, False, "single_value", "Acme"),
    (["name"], 1, 1, None, None, False, "single_value", "1 result"), (["name"], 3, 3, None, None, False, "list", "3 results"), (["name", "x"], 0, 0, None, None, False, "table", "No matching results"), (["name", "x"], 1, 1, None, None, False, "single_value", "1 result"),
    (["parent", "name"], 2, 2, None, "Line Items", True, "list", "Found 2 Line Items entries"), (["parent", "name", "x"], 1, 1, None, "Parts", True, "table", "Found 1 Parts entry"), (["parent", "x", "y"], 0, 0, None, " ", True, "table", "No matching entry entries"),
)


def _literal(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def answer_cases(spark, sf_dir):
    rows = []
    for k, (columns, n, total, value, entity, entries, _, _) in enumerate(_ANSWERS):
        kind = answer.answer_type(columns, n, entries)
        rows.append((k, kind, answer.headline(kind, columns, n, total, value, entity, entries)))
    return spark.createDataFrame(rows, "no int, answer_type string, headline string")


_add("answer_cases", answer_cases, "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c[-2]}', '{c[-1]}')" for k, c in enumerate(_ANSWERS)) + ") t(no, answer_type, headline)")

#: statements, whether they may run, and what is said of those that may not
_VERDICTS = (
    ("SELECT * FROM data_o", None), ("WITH t AS (SELECT total FROM data_o) SELECT max(total) FROM t;", None), ("SELECT x::text FROM data_o", None), ("DELETE FROM data_o", "Only SELECT queries are allowed"), ("SELECT 1; DROP TABLE data_o", "Query contains forbidden operation: DROP"),
    ("SELECT 1 FROM data_o; SELECT 2", "Multiple SQL statements are not allowed"), ("SELECT * FROM pg_catalog.pg_tables", "Query references system tables: pg_catalog"), ("SELECT * FROM secrets", "Query references unauthorized table: secrets"), ("SELECT * FROM data_o JOIN db.data_o x ON true", "Query references unauthorized table: db.data_o"),
    ("SELECT total FROM data_o WHERE (", "Generated SQL could not be parsed for validation"), ("SELECT 1", "Query must reference the collection's tables"), ("SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM data_o", "Not allowed in a query: reflect()"), ("SELECT total FROM data_o WHERE java_method('a', 'b') = 'c'", "Not allowed in a query: java_method()"),
    ("SELECT current_user FROM data_o", "Not allowed in a query: current_user"), ("SELECT * FROM data_o WHERE total IN (SELECT total FROM other)", "Query references unauthorized table: other"),
)


def gateway_verdicts(spark, sf_dir):
    rows = []
    for k, (sql, _) in enumerate(_VERDICTS):
        try:
            gateway.check_sql(spark, sql, {"data_o", "data_o_line_items"})
            rows.append((k, True, None))
        except QueryError as error:
            rows.append((k, False, str(error)))
    return spark.createDataFrame(rows, "no int, taken boolean, said string")


_add("gateway_verdicts", gateway_verdicts, "SELECT * FROM (VALUES " + ", ".join(f"({k}, {_literal(said is None)}, {_literal(said)})" for k, (_, said) in enumerate(_VERDICTS)) + ") t(no, taken, said)")

# limits


def token_bucket(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("request_id"), F.col("user_id").cast("string").alias("client"), "ts")
    return limit_requests(rows, 3, 86_400)


_add(
    "token_bucket", token_bucket,
    """WITH RECURSIVE e AS (SELECT CAST(event_id AS BIGINT) AS request_id, CAST(user_id AS VARCHAR) AS client, ts, epoch_ns(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        b(client, n, tokens, credited, wait) AS (
            SELECT client, n, CAST(2 AS BIGINT), now, CAST(0 AS BIGINT) FROM e WHERE n = 1
            UNION ALL
            SELECT client, n, CASE WHEN have > 0 THEN have - 1 ELSE 0 END, since, CASE WHEN have > 0 THEN 0 ELSE greatest(1, since + 28800000000000 - now) END
            FROM (SELECT client, n, now, least(3, tokens + earned) AS have, CASE WHEN earned = 0 THEN credited WHEN tokens + earned >= 3 THEN now ELSE credited + earned * 28800000000000 END AS since
                  FROM (SELECT e.client, e.n, e.now, b.tokens, b.credited, greatest(0, e.now - b.credited) // 28800000000000 AS earned FROM b JOIN e ON e.client = b.client AND e.n = b.n + 1)))
       SELECT request_id, e.client, ts, wait = 0 AS allowed, CAST(ceil(wait / 1e9) AS BIGINT) AS retry_after_s FROM e JOIN b ON e.client = b.client AND e.n = b.n""",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
