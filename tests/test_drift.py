import json

from tessera.model import load_schema, parse_columns
from tessera.operators.drift import cast_value, consistent_table, fingerprint, follow, migration_steps, route, schema_changes, to_number


def cols(*specs):
    return parse_columns([{"name": n, "type": t, "description": d, **more} for n, t, d, *rest in specs for more in [rest[0] if rest else {}]])


def kinds(old, new):
    return [s[:3] for s in migration_steps(old, new)]


def test_steps_of_each_kind():
    old = cols(("A", "text", "first"), ("B", "varchar", "second one"), ("C", "number", None), ("D", "date", None, {"queryHint": {"example": "X-1"}}))
    new = cols(("A", "NUMBER", "first"), ("b", "text", "Second  ONE"), ("E", "text", None), ("F", "date", None, {"queryHint": {"example": "X-1"}}))
    assert sorted(kinds(old, new)) == sorted([("retyped", "A", "A"), ("renamed", "B", "b"), ("removed", "C", ""), ("added", "", "E"), ("renamed", "D", "F")])


def test_description_on_one_side_only_is_no_evidence():
    old = cols(("A", "text", "same", {"queryHint": {"example": "1"}}))
    new = cols(("B", "text", None, {"queryHint": {"example": "1"}}))
    assert sorted(kinds(old, new)) == [("added", "", "B"), ("removed", "A", "")]


def test_renamed_and_retyped_at_once_and_entities_inside():
    inner = lambda *names: {"entitySchema": {"columns": [{"name": n} for n in names]}}
    old = cols(("Items", "entity_array", "rows", inner("a", "b")), ("Gone", "entity_array", "x", inner("z")), ("T", "text", "t"))
    new = cols(("Lines", "ENTITY_ARRAY", "ROWS", inner("a", "c")), ("T2", "date", "t"))
    assert sorted(kinds(old, new)) == sorted([("renamed", "Items", "Lines"), ("removed", "Items/b", ""), ("added", "", "Lines/c"), ("removed", "Gone", ""), ("renamed", "T", "T2"), ("retyped", "T", "T2")])


def test_fingerprint_ignores_spelling_not_content():
    a = load_schema('{"columns": [{"name": "A", "type": "varchar"}]}')
    b = load_schema('[{"type": "TEXT", "name": "A", "entitySchema": null}]')
    assert fingerprint(a) == fingerprint(b) != fingerprint(load_schema('[{"name": "a"}]'))
    assert load_schema(None) is None and load_schema("{") is None and load_schema('"x"') is None


def step(kind, old, new, to="text"):
    return {"change_kind": kind, "old_path": old, "new_path": new, "old_type": "text", "new_type": to}


def test_route_chains_renames_and_casts():
    history = [(2, [step("renamed", "A", "B")]), (3, [step("renamed", "B", "C"), step("retyped", "B", "C", "number")]), (4, [step("renamed", "I", "J"), step("renamed", "I/x", "J/y")])]
    own = cols(("A", "text", None), ("K", "text", None), ("I", "entity_array", None, {"entitySchema": {"columns": [{"name": "x"}, {"name": "z"}]}}))
    assert route(history, 1, own) == {"A": ("C", ["number"], True), "I": ("J", [], True), "I/x": ("J/y", [], True), "I/z": ("J/z", [], True)}
    assert route(history, 4, own) == {}


def test_names_may_be_used_again():
    reused = [(2, [step("renamed", "A", "B"), step("added", "", "A")]), (4, [step("renamed", "A", "C")])]
    assert route(reused, 1, cols(("A", "text", None)))["A"] == ("B", [], True)
    assert route(reused, 2, cols(("A", "text", None), ("B", "text", None))) == {"A": ("C", [], True)}
    swapped = [(2, [step("renamed", "A", "B"), step("renamed", "B", "A")])]
    assert route(swapped, 1, cols(("A", "text", None), ("B", "text", None))) == {"A": ("B", [], True), "B": ("A", [], True)}
    again = [(2, [step("removed", "A", "")]), (3, [step("added", "", "A")]), (4, [step("retyped", "A", "A", "number")])]
    assert route(again, 1, cols(("A", "text", None))) == {"A": ("A", [], False)}
    # a field no schema has yet is taken up by the version that adds it
    assert route([*again, (5, [step("renamed", "A", "Z")])], 2, [])["A"] == ("Z", ["number"], True)
    inside = [(2, [step("retyped", "E", "E", "text")]), (3, [step("renamed", "E", "F")])]
    own = cols(("E", "entity_array", None, {"entitySchema": {"columns": [{"name": "x"}]}}))
    assert route(inside, 1, own) == {"E": ("F", ["text"], True), "E/x": ("E/x", [], False)}
    assert follow("E/x/deep", route(inside, 1, own)) == ("E/x/deep", [], False) and follow("other", {}) == ("other", [], True)


def test_values_cast():
    assert [to_number(x) for x in ("EUR 1,234.50", "1 835,96 €", "-3", "12,5", "1,234", "", None, "none")] == [1234.5, 1835.96, -3.0, 12.5, 1234.0, None, None, None]
    assert to_number("(5.00)") == -5.0 and to_number("(a) 5") == 5.0
    assert [cast_value(x, "date") for x in ("2024-03-05", "2024/3/5 10:00", "05.03.2024", "31/12/2024", "12/31/2024", "03/04/2024", "04/04/2024", "2024-02-31", "soon")] == ["2024-03-05", "2024-03-05", "2024-03-05", "2024-12-31", "2024-12-31", None, "2024-04-04", None, None]
    assert [cast_value(x, "email") for x in (" mailto:a@b.example", "a b")] == ["a@b.example", None] and cast_value("www.a.example/x", "url") == "www.a.example/x" and cast_value("no url", "url") is None
    assert [cast_value(x, "boolean") for x in ("Yes", "0", "maybe", None)] == ["true", "false", None, None]


def test_frames(spark):
    v1 = json.dumps([{"name": "A", "type": "text", "description": "d"}, {"name": "Old"}])
    v3 = json.dumps({"documentType": "x", "columns": [{"name": "B", "type": "number", "description": "D "}, {"name": "New", "type": "date"}]})
    rows = [("c", 1, v1, "y"), ("c", 1, v1, "y"), ("c", 3, v3, "y"), ("c", 2, None, "y"), ("c", None, v1, "y"), (None, 1, v1, "y"), ("d", 1, "{", "y")]
    collections = spark.createDataFrame(rows, "collection_id string, schema_version int, schema_json string, change_kind string")
    got = sorted((r.collection_id, r.schema_version, r.change_kind, r.old_path, r.new_path) for r in schema_changes(collections).collect())
    assert got == [("c", 3, "added", "", "New"), ("c", 3, "removed", "Old", ""), ("c", 3, "renamed", "A", "B"), ("c", 3, "retyped", "A", "B")]
    responses = spark.createDataFrame([(1, "c", 1, json.dumps({"rows": [{"A": "EUR 2.50", "Odd": 1}]})), (1, "c", 1, json.dumps({"rows": [{"A": "EUR 2.50", "Odd": 1}]})), (2, None, None, None)], "response_id bigint, collection_id string, schema_version int, response_json string")
    table = {(r.column_path, r.value, r.declared) for r in consistent_table(responses, collections).collect()}
    assert table == {("B", "2.5", True), ("Odd", "1", False), ("New", None, True)}
    filled = {(r.column_path, r.value) for r in consistent_table(responses, collections, defaults={"New": "2020-01-01"}).collect()}
    assert ("New", "2020-01-01") in filled
    assert schema_changes(collections.limit(0)).count() == 0


def test_table_against_hand_made_routes(spark):
    """Names that stay, go and come again, and versions not present, in a frame."""
    schemas = {
        1: [{"name": "A", "description": "first"}, {"name": "B", "description": "second"}, {"name": "R", "description": "old"}],
        2: [{"name": "B", "description": "first"}, {"name": "A", "description": "second"}],
        4: [{"name": "C", "description": "first", "type": "date"}, {"name": "A", "description": "second"}, {"name": "R", "description": "other", "type": "number"}],
    }
    collections = spark.createDataFrame([("c", v, json.dumps(s)) for v, s in schemas.items()], "collection_id string, schema_version int, schema_json string")
    body = json.dumps({"rows": [{"B": "05.03.2024", "A": "b", "R": "7"}]})
    swapped = json.dumps({"rows": [{"A": "b", "B": "05.03.2024"}]})
    rows = [(1, "c", 1, body), (2, "c", 3, swapped), (3, "c", 0, body), (None, "c", 4, "[]"), (None, "c", 4, '[{"A": "q"}]'), (5, "x", 1, body)]
    responses = spark.createDataFrame(rows, "response_id bigint, collection_id string, schema_version int, response_json string")
    got = {}
    for r in consistent_table(responses, collections).collect():
        got.setdefault(r.response_id, set()).add((r.column_path, r.source_path, r.value, r.declared))
    first = {("C", "B", "2024-03-05", True), ("A", "A", "b", True), ("R", "R", "7", False), ("R", None, None, True)}
    assert got[1] == first == got[3] and got[2] == {("C", "B", "2024-03-05", True), ("A", "A", "b", True), ("R", None, None, True)}
    assert got[None] == {("A", "A", "q", True), ("C", None, None, True), ("R", None, None, True)}
    assert got[5] == {("A", "A", "b", False), ("B", "B", "05.03.2024", False), ("R", "R", "7", False)}
