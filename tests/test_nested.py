import json

import pytest
from hypothesis import given, settings, strategies as st

from tessera.functions.json_text import embedded_json, recover_json
from tessera.operators.nested import link_parents, response_nodes, columns_table, schema_tables, shred_responses, table_of, values_table, write_tables

SCHEMA = [
    {"name": "A", "type": "text"},
    {"name": "Items", "type": "ENTITY_ARRAY", "entity_schema": {"columns": [
        {"name": "B"}, {"name": "Sub", "type": "entity_array", "entitySchema": {"columns": [{"name": "C"}]}}]}},
]


def paths(body, saved=None):
    return [(k, "/".join(s)) for k, _, s, _, _ in response_nodes(body if isinstance(body, (str, type(None))) else json.dumps(body), saved)]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, None),
        ("", None),
        ("no json", None),
        ('```json\n{"rows": []}\n```', {"rows": []}),
        ('Here is {the} result: {"a": "}"} and more', {"a": "}"}),
        ('{"rows": [{"a": "cut', None),
        ('{"rows": [{"a": 1},', None),
        ("[1, 2] tail", [1, 2]),
    ],
)
def test_recover_json(text, expected):
    assert recover_json(text) == expected


def test_embedded_json_keeps_other_strings():
    assert embedded_json("{pending} deposit") == "{pending} deposit"
    assert embedded_json('[{"a": 1}]') == [{"a": 1}]
    assert embedded_json("[]x") == "[]x"


def test_columns_and_records_of_every_shape():
    body = {
        "schema": {"columns": SCHEMA},
        "rows": [
            {"A": {"value": "x"}, "Items": {"value": [{"B": 1, "Sub": {"value": {"C": 2}}}, None, {"value": 3}, {"B": 2}]}},
            None,
            {"Items": json.dumps([{"B": 1}]), "Extra": [{"Z": 1}], "Lone": {"line": "a", "town": "b"}},
        ],
    }
    got = paths(body)
    assert [p for k, p in got if k == "column"] == ["A", "Items", "Items/B", "Items/Sub", "Items/Sub/C"]
    assert [p for k, p in got if k == "record"] == ["0", "0/Items/0", "0/Items/0/Sub/0", "0/Items/3", "2", "2/Items/0", "2/Extra/0"]


def test_lone_objects_need_an_entity_schema_in_the_response_or_the_saved_version():
    body = {"new_columns": [{"name": "N", "type": "text"}], "rows": {"Items": {"B": 1}, "Other": {"B": 1}}}
    assert paths(body) == [("column", "N"), ("record", "0")]
    assert paths(body, json.dumps(SCHEMA)) == [("column", "N"), ("record", "0"), ("record", "0/Items/0")]
    own = {"schema": {"columns": [{"name": "A"}]}, "rows": {"Items": {"B": 1}}}
    assert ("record", "0/Items/0") not in paths(own, json.dumps(SCHEMA))


def test_cut_off_and_null_responses_give_nothing():
    assert paths(None) == paths("") == paths('{"rows": [{"A": ') == []


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=6)), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.sampled_from(["a", "b", "value", "x/y"]), x, max_size=3)), max_leaves=25))
def test_labels_truncate_to_the_parent(rows):
    nodes = response_nodes(json.dumps({"rows": rows}))
    labels = {tuple(d) for _, d, _, _, _ in nodes}
    for _, dewey, steps, _, _ in nodes:
        assert len(dewey) == len(steps) and len(dewey) % 2 == 1
        assert len(dewey) == 1 or tuple(dewey[:-2]) in labels
    assert len(labels) == len(nodes)


def test_frames_with_repeats_nulls_and_extra_columns(spark):
    body = json.dumps({"rows": [{"Items": {"B": 1}}]})
    responses = spark.createDataFrame([(1, "c", 1, body, "x"), (1, "c", 1, body, "x"), (2, None, None, body, "x"), (3, "c", 1, None, "x"), (4, "c", 9, "{", "x")], "response_id bigint, collection_id string, schema_version int, response_json string, node_path string")
    collections = spark.createDataFrame([("c", 1, json.dumps(SCHEMA), 1), ("c", 1, json.dumps(SCHEMA), 1), ("c", None, None, 1)], "collection_id string, schema_version int, schema_json string, dewey int")
    linked = link_parents(shred_responses(responses, collections))
    got = sorted((r.response_id, r.node_kind, r.node_path, r.parent_path) for r in linked.collect())
    assert got == [(1, "record", "0", ""), (1, "record", "0/Items/0", "0"), (2, "record", "0", "")]
    assert {(r.schema_path, r.n_rows) for r in schema_tables(linked).collect()} == {("rows", 2), ("rows[]/Items", 1)}
    (row,) = table_of(linked, "rows[]/Items", ["B", "dewey"]).collect()
    assert row.B == "1" and list(row.dewey) == [0, 0, 0] and list(row.parent_dewey) == [0] and row.dewey_field is None
    assert shred_responses(responses.limit(0), collections.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "c", 1, body), (None, "c", 1, '{"rows": [{"A": 1}]}'), (None, None, None, None)], "response_id bigint, collection_id string, schema_version int, response_json string")
    assert shred_responses(nameless, collections).count() == 3


def test_flat_tables_have_all_nodes_and_values(spark, tmp_path):
    body = {"schema": {"columns": SCHEMA}, "rows": [{"Items": [{"B": {"value": 2.5}, "C": None}, None, {"B": "x"}], "A": True}]}
    responses = spark.createDataFrame([(1, "c", 1, json.dumps(body))], "response_id bigint, collection_id string, schema_version int, response_json string")
    collections = spark.createDataFrame([], "collection_id string, schema_version int, schema_json string")
    linked = link_parents(shred_responses(responses, collections))
    columns, values = columns_table(linked), values_table(linked)
    assert {(r.node_path, r.parent_path) for r in columns.collect()} == {(r.node_path, r.parent_path) for r in linked.filter("node_kind = 'column'").collect()}
    assert {(r.node_path, r.field, r.value) for r in values.collect()} == {("0", "A", "true"), ("0/Items/0", "B", "2.5"), ("0/Items/0", "C", None), ("0/Items/2", "B", "x")}
    write_tables(linked, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == linked.count() and back.filter("schema_path = 'rows[]/Items'").count() == 2

