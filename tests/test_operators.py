import json
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.errors import CollectionNotFound, QueryError, RowNotFound, SchemaConflict, ValidationError
from tessera.model import Column, parse_columns
from tessera.operators import answer, chunking, filters, mapping, verify, views
from tessera.operators.filters import Collection, Condition, FilterRequest
from tessera.plans import gateway
from tessera.plans.catalog import ATTEMPTS, Catalog, all_tables, cache_misses, collection_name, merge_columns, table_schema, trimmed_cache
from tessera.sources.files import check_files, page_rows, parse_files
from tessera.streaming.limiter import Bucket, limit_requests, limit_stream, refill_interval

SCHEMA = parse_columns([
    {"name": "Vendor", "type": "text", "queryHint": {"role": "company"}}, {"name": "Total", "type": "currency"}, {"name": "Paid", "type": "boolean"},
    {"name": "Line Items", "type": "entity_array", "entitySchema": {"columns": [{"name": "Description", "type": "text"}, {"name": "Amount", "type": "currency"}]}},
])


@pytest.fixture(scope="module")
def invoices(spark):
    main = spark.createDataFrame([(1, "Acme 50% Corp", 1234.5, True), (2, "acme_two", None, False), (3, None, 10.0, None), (4, "  ", 99.0, True)], "_row_id bigint, vendor string, total double, paid boolean")
    items = spark.createDataFrame([(1, 1, "Widget", 1000.0), (2, 1, "Gadget", 234.5), (3, 3, "Widget", 10.0)], "_row_id bigint, _parent_row_id bigint, description string, amount double")
    return Collection(SCHEMA, main, {"Line Items": items})


def ids(invoices, *conditions, match="all"):
    return sorted(r._row_id for r in filters.filter_documents(invoices, FilterRequest(list(conditions), match)).collect())


@pytest.mark.parametrize(
    "condition, expected",
    [
        (("Vendor", "eq", "acme_two"), [2]), (("Vendor", "neq", "acme_two"), [1, 3, 4]), (("Vendor", "contains", "50%"), [1]), (("Vendor", "contains", "e_t"), [2]),
        (("Vendor", "starts_with", "ACME"), [1, 2]), (("vendor", "ends_with", "TWO"), [2]), (("Total", "gte", "$1,234.50"), [1]), (("Total", "contains", "1234.5"), [1]), (("Total", "contains", "10.0"), []),
        (("Vendor", "is_empty", None), [3, 4]), (("Vendor", "is_not_empty", None), [1, 2]), (("Total", "is_empty", None), [2]), (("Paid", "eq", "Yes"), [1, 4]),
        (("Description", "eq", "Widget", "line items"), [1, 3]),
    ],
)
def test_conditions(invoices, condition, expected):
    assert ids(invoices, Condition(*condition)) == expected


def test_nested_all_means_the_same_child(invoices):
    both = Condition("Description", "eq", "Widget", "Line Items"), Condition("Amount", "lt", 300, "Line Items")
    assert ids(invoices, *both) == [3]
    assert ids(invoices, *both, match="any") == [1, 3]
    assert ids(invoices, Condition("Total", "eq", 99), both[1], match="any") == [1, 3, 4]
    assert ids(invoices) == [1, 2, 3, 4]


@pytest.mark.parametrize("bad", [("Nope", "eq", 1), ("Line Items", "eq", 1), ("Total", "eq", "abc"), ("Paid", "eq", "maybe"), ("Vendor", "like", "x"), ("Vendor", "eq", " "), ("X", "eq", 1, "Nope"), ("_row_id", "eq", 1)])
def test_bad_conditions(invoices, bad):
    with pytest.raises(ValidationError):
        ids(invoices, Condition(*bad))


def test_entries_paging_and_values(invoices):
    page, rows, entity = filters.filter_page(invoices, FilterRequest([Condition("Description", "eq", "Widget", "Line Items"), Condition("Total", "gt", 100)]))
    assert entity == "Line Items" and [(r._row_id, r.parent) for r in page.collect()] == [(1, "Acme 50% Corp")]
    page, _, entity = filters.filter_page(invoices, FilterRequest([Condition("Amount", "gt", 1, "Line Items")], result_unit="documents"))
    assert entity is None and [r._row_id for r in page.collect()] == [1, 3]
    page, _, _ = filters.filter_page(invoices, FilterRequest([], sort="Total", direction="desc", limit=2))
    assert [r._row_id for r in page.collect()] == [2, 1]
    page, _, _ = filters.filter_page(invoices, FilterRequest([], sort="Total", page=2, limit=3))
    assert [r._row_id for r in page.collect()] == [2]
    assert [r.value for r in filters.distinct_values(invoices, "Total").collect()] == ["10", "1234.5", "99"]
    for broken in (FilterRequest([], match="some"), FilterRequest([], direction="up"), FilterRequest([], result_unit="entries"), FilterRequest([], result_unit="x")):
        with pytest.raises(ValidationError):
            filters.filter_page(invoices, broken)


def test_answer_words():
    assert answer.answer_type(["total"], 1) == "aggregate" and answer.answer_type(["total_amount"], 1) == "single_value"
    assert answer.answer_type(["a"], 3) == "list" and answer.answer_type(["a", "b"], 3) == "table" and answer.answer_type(["parent", "a"], 9, entries=True) == "list"
    assert answer.headline("table", ["a", "b"], 2, 7) == "7 results" and answer.headline("single_value", ["a"], 1, 1, " ") == "1 result" and answer.headline("list", ["a"], 0, 0) == "No matching results"
    assert answer.headline("list", [], 1, 1, entity="Skill", entries=True) == "Found 1 Skill entry" and answer.headline("list", [], 0, 5, entries=True) == "No matching entry entries"
    assert answer.caveats(1, 0, True, True) == ["1 row with low-confidence values were excluded."] and answer.caveats(0, 2, False, False) == []


def test_projection_survives_bad_provenance(spark):
    rows = spark.createDataFrame([(1, "a", "{bad", " "), (2, "b", '{"v":"LOW"}', '{"v":{"page":3,"rawSource":"q"}}'), (3, None, None, '{"v":{"level":"High"}}')], "_row_id bigint, v string, _confidence_json string, _evidence_json string")
    got = {r._row_id: r.v for r in answer.project_cells(rows).collect()}
    assert got[1].confidence is None and (got[2].confidence, got[2].page, got[2].raw_source) == ("low", 3, "q") and got[3].confidence == "high"
    cov = answer.coverage(answer.project_cells(rows), excluded=True).first()
    assert (cov.total_rows, cov.included_rows, cov.excluded_rows, cov.cells_with_values, cov.low_cells, cov.verifiable) == (3, 2, 1, 1, 0, True)
    assert [r.included_rows for r in answer.coverage(answer.project_cells(rows.limit(0))).collect()] == [0]


CHUNKS = [("d", 1, 1, "Invoice INV-7 of March 14, 2026"), ("d", 2, 3, "Vendor Acme Corp mail a@acme.com Total 1,234.50 paid +91 891-958-4215")]


def score(spark, **cell):
    base = dict(cell_id=1, document_id="d", column_name="Vendor", column_type="text", value_text=None, value_num=None, value_bool=None, reported="high", page=3, chunk=2, raw_source=None)
    kinds = "cell_id bigint, document_id string, column_name string, column_type string, value_text string, value_num double, value_bool boolean, reported string, page int, chunk int, raw_source string"
    cells = spark.createDataFrame([tuple((base | cell).values())], kinds)
    chunks = spark.createDataFrame(CHUNKS, "document_id string, chunk_index int, page int, text string")
    uploads = spark.createDataFrame([("img", "image")], "document_id string, file_format string")
    r = verify.score_cells(cells, chunks, uploads).first()
    return r.level, r.score, r.page, r.chunk, r.note


def test_scores(spark):
    assert score(spark, value_text="Acme Corp", raw_source="Vendor Acme Corp") == ("high", 1.0, 3, 2, None)
    assert score(spark, value_text="Acme Corp", raw_source="Vendor Acme Corp", reported="?", page=1) == ("high", 0.9, 3, 2, "Cited page corrected to 3 from the cited chunk")
    assert score(spark, value_num=1234.5, column_type="currency", raw_source="Total 1,234.50") == ("high", 1.0, 3, 2, None)
    assert score(spark, value_text="Acme Corp", chunk=9, raw_source="Acme Corp") == ("low", 0.25, None, None, "Cited chunk 9 does not exist in this document; Quoted source text was found elsewhere in the document, not in the cited chunk")
    assert score(spark, value_text="Acme Corp", chunk=None) == ("high", 1.0, 3, 2, "Source chunk recovered from document text (model omitted citation); No verbatim source quote was supplied; value located in cited chunk")
    assert score(spark, value_text="Globex", raw_source="from Globex") == ("low", 0.65, 3, 2, "Quoted source text does not appear anywhere in the document; Value does not appear anywhere in the document text")
    assert score(spark) == ("low", None, None, None, "No value for this field was found in the document")
    assert score(spark, document_id="img", value_text="x", chunk=1)[:4] == ("medium", 1.0, None, None)
    assert score(spark, column_type="date", value_text="14 March", raw_source="March 14, 2026", chunk=1, page=1) == ("low", 0.7, 1, 1, "Value failed date validation")
    assert score(spark, column_name="Phone", value_text="+91 8919584215", raw_source="paid +91 891-958-4215")[0] == "high"


def test_document_confidence_and_cross_check(spark):
    scored = spark.createDataFrame([("a", "high", True)] * 8 + [("a", "low", True)] * 2 + [("b", "low", False)] + [("c", "low", True), ("c", "high", True)], "document_id string, level string, has_value boolean")
    assert {r.document_id: (r.confidence, r.n_low) for r in verify.document_confidence(scored).collect()} == {"a": ("high", 2), "b": ("low", 0), "c": ("low", 1)}
    parents = spark.createDataFrame([(1, 110.0, 10.0), (2, 500.0, 10.0), (3, 5.0, 1.0), (4, None, 0.0)], "_row_id bigint, total double, tax double")
    children = spark.createDataFrame([(1, 60.0), (1, 40.0), (2, 60.0), (2, 40.0), (3, None), (4, 1.0)], "_parent_row_id bigint, amount double")
    got = {r._row_id: (r.agrees, r.note) for r in verify.cross_check(parents, children, "total", "amount", surcharges=("tax",)).collect()}
    assert got == {1: (True, None), 2: (False, "Line items add up to 110 but the document states 500")}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(0, 900), min_size=1, max_size=6), max_size=6))
def test_chunk_fold_agrees_with_python(spark, shape):
    body = "\n\n".join("\n".join("w" * n for n in lines) for lines in shape)
    native = spark.createDataFrame([(body,)], "t string").select(chunking.fold_blocks(F.col("t"))).first()[0]
    assert native == chunking.page_blocks(body)


def test_chunk_pages_and_delimited(spark):
    pages = spark.createDataFrame([("d", 1, "one\n\ntwo"), ("d", 2, "  "), ("d", 3, "x" * 3000), ("e", 1, None)], "document_id string, page int, text string")
    assert [(r.chunk_index, r.page, len(r.text)) for r in chunking.chunk_pages(pages).orderBy("chunk_index").collect()] == [(1, 1, 8), (2, 3, 3000)]
    body = "h1,h2\n\n" + "\n".join(f"row {k:04d},{'v' * 20}" for k in range(200))
    blocks = chunking.delimited_blocks(body)
    assert all(b.startswith("h1,h2\n") and len(b) <= 1201 for b in blocks) and sum(b.count("row ") for b in blocks) == 200
    assert chunking.delimited_blocks("only") == ["only"] and chunking.delimited_blocks("") == []


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a" * 700, "b" * 1300, "c" * 30, "\n", "\n\n", "\u00a0", "\u2003", "\x1c", "\x85", "\u3000", "\u2028", " ", "\t", "\u202f", "\x0b", "\ufeff"]), max_size=9).map("".join), min_size=8, max_size=8))
def test_chunks_are_the_same_on_either_side(spark, texts):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string").select("k", chunking.fold_blocks(F.col("text")).alias("jvm"))
    assert {r.k: r.jvm for r in rows.collect()} == {k: chunking.page_blocks(x) for k, x in enumerate(texts)}


def test_the_switch_of_sides_changes_nothing(spark, monkeypatch):
    between = "\n\u00a0\n"
    pages = spark.createDataFrame([("d", 1, "x" * 700 + between + "y" * 700)], "document_id string, page int, text string")
    below = [r.text for r in chunking.chunk_pages(pages).collect()]
    monkeypatch.setattr(chunking, "FOLD_CHARS", 10)
    assert [r.text for r in chunking.chunk_pages(pages).collect()] == below and [len(x) for x in below] == [1403]


def test_edits_are_merged(spark, tmp_path, monkeypatch):
    from tessera.plans import catalog

    monkeypatch.setattr(catalog, "EDITS_MERGED", 3)
    cat = Catalog(spark, str(tmp_path))
    cat.create("e", "E", [Column("A"), Column("B")])
    cells = spark.createDataFrame([("d", 0, "", n, v, None, None) for n, v in (("A", "a"), ("B", "b"))], "document_id string, row_ordinal int, row_path string, column_name string, value_text string, value_num double, value_bool boolean")
    cat.append("e", cells)
    for k in range(4):
        cat.update_cell("e", 1, "A", f"a{k}")
    cat.update_cell("e", 1, "B", None)
    assert len(cat.read("e").tables["data_e#edits"]) == 1
    row = cat.table("e").first()
    assert (row.a, row.b) == ("a3", None)


def test_mapping(spark):
    body = {"rows": [{"A": {"value": "5", "page": 2, "chunk": "3", "confidence": "HIGH", "raw_source": "five"}, "N": "$1,000", "List": [{"x": 1, "y": 2}]}], "schema": {"columns": [{"name": "A"}, {"name": "N", "type": "number"}, {"name": "List"}, {"name": "Miss"}]}, "knowledge_sections": [{"title": "S", "fields": ["a", "nope", "A"]}, {"title": "T", "fields": ["A"]}]}
    responses = spark.createDataFrame([(1, "d", "c", 1, json.dumps(body)), (2, "d", "c", 1, None), (3, "d", "zz", 1, '{"rows": [{"A": 1}]}')], "response_id bigint, document_id string, collection_id string, schema_version int, response_json string")
    collections = spark.createDataFrame([("c", 1, "[]")], "collection_id string, schema_version int, schema_json string")
    got = {(r.row_path, r.column_name): r for r in mapping.map_responses(responses, collections).filter("response_id = 1").collect()}
    assert (got["", "A"].value_text, got["", "A"].page, got["", "A"].chunk, got["", "A"].reported) == ("5", 2, None, "high")
    assert got["", "N"].value_num == 1000.0 and got["", "N"].reported == "medium" and got["", "Miss"].reported == "low"
    assert got["", "List"].column_type == "entity_array" and got["List/0", "x"].value_text == "1"
    sections = [(r.title, r.field) for r in mapping.knowledge_sections(responses).orderBy("section_no").collect()]
    assert sections == [("S", "A"), ("N", "N"), ("List", "List"), ("Miss", "Miss")]
    assert mapping.infer_entity("x", {"value": 1}) is None and mapping.infer_entity("x", {"a": 1}) is None and mapping.infer_entity("x", [{"a": 1}]) is not None
    columns, rows = mapping.apply_restructure([Column("Jobs")], [{"Jobs": "long"}], {"Jobs": {"entitySchema": {"columns": [{"name": "Title"}]}, "rows": [{"Title": "x"}]}})
    assert columns[0].type == "entity_array" and rows[0]["Jobs"]["value"] == [{"Title": "x"}]


TABLES = {"d", "d_items"}


@pytest.mark.parametrize("sql", ["SELECT * FROM d", "WITH t AS (SELECT * FROM d) SELECT * FROM t;", "SELECT * FROM d JOIN d_items i ON i._p = d._r", 'SELECT "x" FROM "d" WHERE \'a"b\' = x', "SELECT x::text FROM d UNION SELECT y FROM d_items", "WITH d AS (SELECT * FROM d) SELECT * FROM d", "SELECT a, rank() OVER (ORDER BY b) FROM d LIMIT 3 OFFSET 1", "SELECT updated, created_at FROM d"])
def test_sql_taken(spark, sql):
    gateway.check_sql(spark, sql, TABLES)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE d", "SELECT 1", "SELECT * FROM other", "SELECT * FROM d, other", "SELECT * FROM d WHERE x IN (SELECT y FROM other)", "WITH t AS (SELECT * FROM other) SELECT * FROM t, d", "SELECT * FROM d UNION SELECT * FROM other",
        "SELECT * FROM d; SELECT 1", "SELECT * FROM pg_catalog.x", "SELECT * FROM information_schema.tables", "SELECT * FROM d -- \n, other", "SELECT * FROM range(5), d", "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM IDENTIFIER('other')",
        "WITH leaked AS (SELECT * FROM other), other AS (SELECT * FROM d) SELECT * FROM leaked", "SELECT * FROM d WHERE 'delete' = x", "SELECT FROM WHERE", "EXPLAIN SELECT * FROM d", "SELECT explode(x) FROM db.d", "SELECT * FROM d LATERAL VIEW explode(x) t AS y",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM d", "SELECT java_method('java.lang.System', 'getenv', 'PATH') FROM d", "SELECT try_reflect('java.lang.System', 'getProperty', 'x') FROM d",
        "SELECT x FROM d WHERE length(reflect('a', 'b')) > 1", "SELECT x FROM d ORDER BY java_method('a', 'b')", "SELECT sum(x) FILTER (WHERE reflect('a', 'b') = 'c') FROM d", "SELECT x FROM d WHERE x IN (SELECT reflect('a', 'b') FROM d)",
        "SELECT max(x) OVER (PARTITION BY reflect('a', 'b')) FROM d", "SELECT transform(x, y -> reflect('a', y)) FROM d", "SELECT IDENTIFIER('reflect')('a', 'b') FROM d", "SELECT system.builtin.reflect('a', 'b') FROM d",
        "SELECT current_user() FROM d", "SELECT current_user FROM d", "SELECT user FROM d", "SELECT session_user FROM d", "SELECT input_file_name() FROM d", "SELECT current_database() FROM d", "SELECT version() FROM d", "SELECT * FROM read_files('/etc') , d", "SELECT secret('a', 'b') FROM d",
        "SELECT * FROM d TABLESAMPLE (1 ROWS) JOIN other", "SELECT uuid() FROM d", "SELECT x FROM d GROUP BY x HAVING reflect('a', 'b') = 'c'", "SELECT * FROM d JOIN d_items i ON reflect('a', 'b') = i.x", "SELECT * FROM d LIMIT (SELECT length(reflect('a', 'b')) FROM d)",
    ],
)
def test_sql_turned_away(spark, sql):
    with pytest.raises(QueryError):
        gateway.check_sql(spark, sql, TABLES)


def test_sql_that_takes_long_to_parse(spark, monkeypatch):
    monkeypatch.setattr(gateway, "PARSE_SECONDS", 0.0)
    with pytest.raises(QueryError, match="too long"):
        gateway.check_sql(spark, "SELECT " + " + ".join(["x"] * 3000) + " FROM d", TABLES)


def test_columns_called_like_the_user(spark):
    rows = gateway.run_sql(spark, "SELECT user, upper(current_user) AS u FROM d_named", {"d_named": spark.createDataFrame([("a", "b")], "user string, current_user string")})
    assert tuple(rows.first()) == ("a", "B")


def test_verdicts_and_phrasing(spark):
    assert gateway.read_verdict('{"answerable": "true", "sql": "SELECT 1"}')[0] == "SELECT 1"
    for refused in (None, "hello", '{"answerable": false, "reason": ""}', '{"answerable": true}', '{"sql": "SELECT 1"}'):
        assert gateway.read_verdict(refused) == (None, gateway.REFUSAL)
    assert gateway.phrase("3 results", {"n": 3}, "There are 3.") == "There are 3." and gateway.phrase("3 results", {}, "All 4.") == "3 results"
    rows, _ = gateway.ask(spark, '{"answerable": true, "sql": "SELECT count(*) AS n FROM d"}', {"d": spark.range(3).toDF("x")})
    assert rows.first().n == 3
    assert "join: data_c_line_items._parent_row_id" in gateway.describe_tables("c", SCHEMA)


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.create("c-1", "Invoices", SCHEMA)
    with pytest.raises(SchemaConflict):
        cat.create("c-1", "Invoices", SCHEMA)
    assert cat.table("c-1").count() == 0
    cells = spark.createDataFrame(
        [("d", 0, "", "Vendor", "Acme", None, None, "high"), ("d", 0, "", "Total", None, 5.0, None, "low"), ("d", 0, "Line Items/0", "Amount", None, 2.0, None, "high"), ("d", 0, "Line Items/1", "Amount", None, 3.0, None, "high"), ("e", 0, "", "Vendor", "Bee", None, None, "high")],
        "document_id string, row_ordinal int, row_path string, column_name string, value_text string, value_num double, value_bool boolean, level string",
    )
    assert cat.append("c-1", cells) == 4 and cat.append("c-1", cells.filter("document_id = 'e'")) == 1
    main = {r._row_id: r for r in cat.table("c-1").collect()}
    assert sorted(main) == [1, 2, 3] and main[3].vendor == "Bee" and {main[1].vendor, main[2].vendor} == {"Acme", "Bee"}
    acme, bee = sorted((1, 2), key=lambda k: main[k].vendor)
    assert json.loads(main[acme]._confidence_json) == {"total": "low", "vendor": "high"}
    assert [(r._row_id, r._parent_row_id, r.amount) for r in cat.table("c-1", "data_c_1_line_items").orderBy("_row_id").collect()] == [(1, acme, 2.0), (2, acme, 3.0)]
    cat.update_cell("c-1", bee, "Total", "$7.50")
    cat.update_cell("c-1", bee, "total", 8)
    cat.update_cell("c-1", acme, "Vendor", None)
    after = {r._row_id: (r.vendor, r.total) for r in cat.table("c-1").collect()}
    assert after == {acme: (None, 5.0), bee: ("Bee", 8.0), 3: ("Bee", None)}
    with pytest.raises(RowNotFound):
        cat.update_cell("c-1", 99, "Total", 1)
    with pytest.raises(ValidationError):
        cat.table("c-1", "data_other")
    manifest, said = cat.evolve("c-1", [Column("TOTAL"), Column("Tax", "currency"), Column("Rows", "entity_array")])
    assert [c.name for c in manifest.schema()][-1] == "Tax" and said[-1] == "Schema evolved: 1 new column(s) detected" and "tax" in cat.table("c-1").columns
    # a second writer comes first, once: both columns survive
    first = [True]

    def change(m):
        if first.pop() if first else False:
            cat.evolve("c-1", [Column("Other")])
        m.columns = m.columns + [{"name": "Mine", "type": "text"}]

    assert {"Other", "Mine"} <= {c.name for c in cat.update("c-1", change).schema()}
    calls = []

    def always(m):
        calls.append(1)
        cat.evolve("c-1", [Column(f"x{len(calls)}")])

    with pytest.raises(SchemaConflict):
        cat.update("c-1", always)
    assert len(calls) == ATTEMPTS
    cat.drop("c-1")
    with pytest.raises(CollectionNotFound):
        cat.read("c-1")


def test_catalog_rules():
    merged, warnings = merge_columns(SCHEMA, [Column("vendor"), Column("New")])
    assert len(merged) == 5 and warnings == ["Schema evolved: 1 new column(s) detected"]
    with pytest.raises(ValidationError):
        table_schema([Column("A b"), Column("a_b")], False)
    deep = parse_columns([{"name": "A", "type": "entity_array", "entitySchema": {"columns": [{"name": "B", "type": "entity_array", "entitySchema": {"columns": [{"name": "c"}]}}]}}])
    assert sorted(all_tables("x", deep)) == ["data_x", "data_x_a", "data_x_a_b"]
    assert collection_name("my_invoice-7.pdf", "invoice") == "my invoice 7" and collection_name("scan.png", "bank_statement") == "bank statement — scan"


def test_cache(spark):
    cache = spark.createDataFrame([("a", datetime(2024, 1, 1, 12)), ("b", datetime(2024, 1, 1, 1)), ("a", datetime(2024, 1, 1, 2))], "key string, cached_at timestamp")
    requests = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    now = F.lit(datetime(2024, 1, 1, 13)).cast("timestamp")
    assert sorted(r.key for r in cache_misses(requests, cache, now).collect()) == ["b", "c"]
    assert [(r.key, r.cached_at.hour) for r in trimmed_cache(cache, 1).collect()] == [("a", 12)]


def test_files(spark, tmp_path):
    files = spark.createDataFrame(
        [("/x/a.TXT", None, bytearray(b" hi\nyou \n")), ("/x/b.csv", None, bytearray(b'a,b\n1,"x\ny"\n\n')), ("/x/c.bin", None, bytearray(b"z")), ("/x/d.png", "image/png", bytearray(b"\x89PN")), ("/x/e.txt", None, bytearray(b"")), ("/x/f.tsv", "text/tab-separated-values", bytearray(b"a\tb\n1\t2")), ("/x/g.txt", None, bytearray(b"   ")), ("/x/h.pdf", None, bytearray(b"%PDF"))],
        "path string, content_type string, content binary",
    ).withColumn("length", F.length("content"))
    parsed = {r.filename: r for r in parse_files(check_files(files, 100), spark.createDataFrame([("/x/h.pdf", 2, " two "), ("/x/h.pdf", 1, "one")], "path string, page int, text string")).collect()}
    assert parsed["a.TXT"].pages == ["hi\nyou"] and parsed["a.TXT"].line_count == 2 and parsed["b.csv"].row_count == 2 and parsed["b.csv"].column_count == 2 and parsed["f.tsv"].column_count == 2
    assert parsed["c.bin"].error == "UNSUPPORTED_FORMAT" and parsed["e.txt"].error == "PARSE_ERROR" and parsed["g.txt"].error == "PARSE_ERROR"
    assert parsed["d.png"].is_image and parsed["d.png"].base64 == "iVBO" and parsed["h.pdf"].pages == ["one", "two"] and parsed["h.pdf"].error is None
    assert {r.filename: r.error for r in check_files(files, 5).collect()}["a.TXT"] == "FILE_TOO_LARGE"


def test_bucket():
    step = refill_interval(3, 60)
    bucket = Bucket(3, 0)
    assert [bucket.take(0, 3, step) for _ in range(4)] == [0, 0, 0, step]
    assert bucket.take(step - 1, 3, step) == 1 and bucket.take(step, 3, step) == 0 and bucket.take(step + 5, 3, step) == step - 5
    assert bucket.take(100 * step, 3, step) == 0 and bucket.credited == 100 * step and bucket.tokens == 2
    assert refill_interval(10, 1e-9) == 1


def test_limits_in_batch_and_stream(spark, tmp_path):
    rows = [(k, "a", datetime(2024, 1, 1, 0, 0, s)) for k, s in enumerate((0, 0, 1, 40))] + [(9, "b", datetime(2024, 1, 1)), (10, None, datetime(2024, 1, 1)), (11, "c", None)]
    requests = spark.createDataFrame(rows, "request_id bigint, client string, ts timestamp")
    want = {0: (True, 0), 1: (True, 0), 2: (False, 29), 3: (True, 0), 9: (True, 0)}
    assert {r.request_id: (r.allowed, r.retry_after_s) for r in limit_requests(requests, 2, 60).collect()} == want
    requests.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limit_stream(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in")), 2, 60)
    query = stream.writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.request_id: (r.allowed, r.retry_after_s) for r in spark.sql("SELECT * FROM limits").collect()} == want


def test_views(spark):
    rows = spark.createDataFrame([("item 10", None), ("item 9", "x"), (None, "Y")], "a string, b string")
    assert [r.a for r in views.sort_naturally(rows, "a").collect()] == [None, "item 9", "item 10"]
    assert views.search_rows(rows, "y").count() == 1
    status = rows.select(views.provenance_status(F.col("a"), F.lit("low"), F.lit(1)).alias("s")).collect()
    assert [r.s for r in status] == ["review", "review", "absent"]
    reason = lambda note: spark.range(1).select(views.review_reason(F.lit(note), F.lit("review"))).first()[0]
    assert reason("Value failed currency validation") == "The value does not look like a valid amount." and reason("Cited page corrected to 2") is None
    assert views.operators_for(SCHEMA[1])[2] == "gt" and views.operators_for(Column("S", hint={"role": "status"})) == ("eq", "neq", "is_empty", "is_not_empty")
    assert views.filter_fields(SCHEMA) == [(None, "Vendor"), (None, "Total"), (None, "Paid"), ("Line Items", "Description"), ("Line Items", "Amount")]
    assert views.suggested_questions(SCHEMA) == ["List the vendors", "What is the average total?"]
