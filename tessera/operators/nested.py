"""Deeply nested responses as flat tables (problem 1).

Method: Dewey labelling. One pass over each document gives every node the path
of its ordinals from the root (``dewey``) and, step by step beside it, the
names on that path (``steps``). A node's parent is found by cutting its label
short, never by a join, and nodes with the same ``schema_path`` make one table.

Nodes are columns (of the schema a response brings) and records. Where a lone
object stands in place of an array the schema tells whether it is a record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions.arrow import pieces
from tessera.functions.json_text import embedded_json, recover_json
from tessera.model import Column, load_schema, parse_columns, schema_columns
from tessera.session import once

NODE_SCHEMA = (
    "node_kind string, dewey array<int>, steps array<string>, schema_path string, "
    "fields map<string,string>"
)


def _index(columns: list[Column]) -> dict[str, Column]:
    return {c.name: c for c in columns}


def _is_cell(value) -> bool:
    return isinstance(value, dict) and "value" in value


def _unwrap(value):
    """The value inside any cells and JSON strings around it."""
    while True:
        if _is_cell(value):
            value = value["value"]
            continue
        inner = embedded_json(value)
        if inner is value:
            return value
        value = inner


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return json.dumps(value, ensure_ascii=False)


def _column_nodes(columns: list[Column], dewey: list[int], steps: list[str], out: list) -> None:
    for place, column in enumerate(columns):
        label, names = [*dewey, place], [*steps, column.name]
        out.append(("column", label, names, "columns" + "[]/columns" * len(dewey), [
            ("name", column.name), ("type", column.type), ("description", column.description),
            ("required", "true" if column.required else "false"), ("example", column.example),
        ]))
        _column_nodes(column.children, label, names, out)


def _record_nodes(root, columns: list[Column] | None, out: list) -> None:
    """Depth first with a stack of its own: depth is bounded by memory only."""
    stack: list = []

    def push(items: list, dewey: list[int], steps: list[str], path: str, known) -> None:
        for place in range(len(items) - 1, -1, -1):
            if isinstance(items[place], dict) and not _is_cell(items[place]):
                stack.append((items[place], [*dewey, place], [*steps, str(place)], path, known))

    top = _index(columns or [])
    root = _unwrap(root)
    push(root if isinstance(root, list) else [root] if isinstance(root, dict) else [], [], [], "rows", top)
    while stack:
        record, dewey, steps, path, known = stack.pop()
        fields, below = [], []
        for place, (name, raw) in enumerate(record.items()):
            value = _unwrap(raw)
            column = known.get(name)
            lone = isinstance(value, dict) and column is not None and column.has_entity
            if lone:
                value = [value]
            if isinstance(value, list) and (lone or any(isinstance(x, dict) and not _is_cell(x) for x in value)):
                below.append((value, [*dewey, place], [*steps, name], f"{path}[]/{name}", _index(column.children) if column else {}))
            else:
                fields.append((name, _scalar(value)))
        out.append(("record", dewey, steps, path, fields))
        for args in reversed(below):
            push(*args)


def response_nodes(response_json: str | None, saved_schema: str | None = None) -> list[tuple]:
    """Nodes of one response as (kind, dewey, steps, schema_path, fields).

    Null, unreadable and cut-off responses give none. The schema is the
    response's own (``schema.columns``); where it brings none, the saved one
    with the response's ``new_columns`` added.
    """
    body = recover_json(response_json)
    if body is None:
        return []
    if isinstance(body, list):
        body = {"rows": body}
    out: list[tuple] = []
    own = schema_columns(body["schema"]) if isinstance(body.get("schema"), (dict, list)) else None
    new = parse_columns(body.get("new_columns"))
    declared = (own or []) + new
    _column_nodes(declared, [], [], out)
    if not own:
        names = {c.name for c in new}
        declared = new + [c for c in load_schema(saved_schema) or [] if c.name not in names]
    if "rows" in body:
        _record_nodes(body["rows"], declared, out)
    return out


def shred_responses(responses: DataFrame, collections: DataFrame, with_fields: bool = True) -> DataFrame:
    """Nodes of every response, one row each.

    ``responses`` needs response_id, collection_id, schema_version and
    response_json, ``collections`` collection_id, schema_version and
    schema_json; other columns are ignored. Result: response_id, node_kind,
    dewey, steps, schema_path, fields (null unless ``with_fields``).

    Repeated rows count once. Rows without an id are kept, each for itself; null, empty and
    unreadable JSON gives no rows; a response whose collection or version is
    missing is read by its own schema alone. Empty tables give an empty result.
    """
    ids = once(responses.select("response_id", "collection_id", "schema_version", "response_json"), "response_id")
    saved = (
        collections.select("collection_id", "schema_version", "schema_json")
        .dropDuplicates(["collection_id", "schema_version"])
    )
    joined = ids.join(saved, ["collection_id", "schema_version"], "left").select("response_id", "response_json", "schema_json")
    id_type = joined.schema["response_id"].dataType.simpleString()
    path_type, name_type = pa.list_(pa.int32()), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owners, rows = [], []
            ids_in, texts, schemas = batch.column(0), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                found = response_nodes(texts[k].as_py(), schemas[k].as_py())
                owners += [k] * len(found)
                rows += found
            kinds, labels, names, paths, fields = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    ids_in.take(pa.array(owners, pa.int64())),
                    pa.array(kinds, pa.string()),
                    pa.array(labels, path_type),
                    pa.array(names, name_type),
                    pa.array(paths, pa.string()),
                    pa.array([list(dict(f).items()) for f in fields] if with_fields else [None] * len(rows), pa.map_(pa.string(), pa.string())),
                ],
                names=["response_id", "node_kind", "dewey", "steps", "schema_path", "fields"],
            )

    return joined.mapInArrow(run, f"response_id {id_type}, {NODE_SCHEMA}")


def link_parents(nodes: DataFrame) -> DataFrame:
    """Adds node_path and, by cutting the label short, parent_dewey and
    parent_path (empty at the top). A column is one step below its parent, a
    record two: the field and the position in it."""
    depth = F.size("dewey") - F.when(F.col("node_kind") == "column", 1).otherwise(2)
    kept = F.greatest(depth, F.lit(0))
    return (
        nodes.withColumn("node_path", F.array_join("steps", "/"))
        .withColumn("parent_dewey", F.slice("dewey", F.lit(1), kept))
        .withColumn("parent_path", F.array_join(F.slice("steps", F.lit(1), kept), "/"))
    )


def schema_tables(linked: DataFrame) -> DataFrame:
    """The schema paths present, each one a table, with its row count."""
    return linked.groupBy("node_kind", "schema_path").agg(F.count(F.lit(1)).alias("n_rows"))


def table_of(linked: DataFrame, schema_path: str, columns: list[str] | None = None) -> DataFrame:
    """One flat table: the nodes of a schema path with the named fields as
    columns. Fields named like a link column get the suffix ``_field``."""
    links = ["response_id", "dewey", "parent_dewey", "node_path", "parent_path"]
    picked = [F.col("fields")[name].alias(name if name not in links else f"{name}_field") for name in columns or []]
    return linked.filter(F.col("schema_path") == schema_path).select(*links, *(picked or [F.col("fields")]))


def columns_table(linked: DataFrame) -> DataFrame:
    """All columns of all levels as one flat table with their links: their
    tables have the same fields, whatever the path."""
    links = ["response_id", "schema_path", "dewey", "parent_dewey", "node_path", "parent_path"]
    return linked.filter("node_kind = 'column'").select(*links, *[F.col("fields")[name].alias(name) for name in ("name", "type", "description", "required", "example")])


def values_table(linked: DataFrame) -> DataFrame:
    """The fields of all records, a row each, under the record they stand in."""
    records = linked.filter("node_kind = 'record'")
    return records.select("response_id", "schema_path", "dewey", "node_path", F.explode("fields").alias("field", "value"))


def write_tables(linked: DataFrame, folder: str) -> None:
    """Every schema path as a table of its own under ``folder``: one pass, one
    folder a path, its rows with their links and fields. ``table_of`` gives a
    table the columns wanted of it."""
    rows = linked.select("node_kind", "schema_path", "response_id", "dewey", "parent_dewey", "node_path", "parent_path", "fields")
    rows.write.mode("overwrite").partitionBy("node_kind", "schema_path").parquet(folder)
