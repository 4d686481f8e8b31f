"""Schemas that drift between versions (problem 4).

Method: every saved schema version gets a fingerprint; between a version and
the next one present stand explicit migration steps (added, removed, renamed,
retyped). A record is routed through the chain of steps from its own version
to the latest: renames move its fields, retypes cast them, additions fill in a
default, removals keep the value under the last name it had. All steps are
reported.

The chain is followed once per collection and version. All steps of a version
are taken at once, so that names may be swapped or used again; what comes of it
is a short list of the paths that end elsewhere, and only that list travels
with the records.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.arrow import pieces
from tessera.functions.json_text import recover_json
from tessera.functions.values import EMAIL, URL
from tessera.model import Column, load_schema, parse_columns, schema_columns
from tessera.operators.nested import response_nodes
from tessera.session import once

CHANGE_TYPE = "array<struct<change_kind:string,old_path:string,new_path:string,old_type:string,new_type:string>>"
_SPACE = re.compile(r"\s+")


def _same_text(text: str | None) -> str | None:
    """A description without regard to case and spacing."""
    return None if text is None else _SPACE.sub("", text).casefold() or None


def _evidence(column: Column) -> tuple[str, str] | None:
    """What tells a renamed column again: its description or, failing one, its example."""
    described = _same_text(column.description)
    if described:
        return ("description", described)
    return ("example", column.example) if column.example is not None else None


def fingerprint(columns: list[Column]) -> str:
    """Digest of a schema's content, whatever the spelling of its JSON."""
    text = json.dumps([c.canonical() for c in columns], ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def migration_steps(old: list[Column], new: list[Column], old_at: str = "", new_at: str = "") -> list[tuple]:
    """Steps from one schema to the next as (kind, old_path, new_path, old_type, new_type).

    Columns are the same if their names are equal; of the others at the same
    level one that goes and one that comes are a renamed column if their
    evidence agrees, the first with the first. A name that comes twice at one
    level counts once, at its first place. Only entity columns that stay
    entity columns are compared inside.
    """
    before = {c.name: c for c in reversed(old)}
    after = {c.name: c for c in reversed(new)}
    gone = [c for c in dict.fromkeys(x.name for x in old) if c not in after]
    come: dict[tuple, list[str]] = {}
    for name in dict.fromkeys(x.name for x in new):
        if name not in before and (proof := _evidence(after[name])):
            come.setdefault(proof, []).append(name)
    renamed: dict[str, str] = {}
    for name in gone:
        if waiting := come.get(_evidence(before[name]) or ()):
            renamed[name] = waiting.pop(0)
    steps: list[tuple] = []
    taken = set(renamed.values())
    for name, column in before.items():
        target = name if name in after else renamed.get(name)
        old_path = old_at + name
        if target is None:
            steps.append(("removed", old_path, "", column.type, None))
            continue
        other, new_path = after[target], new_at + target
        if target != name:
            steps.append(("renamed", old_path, new_path, column.type, other.type))
        if other.type != column.type:
            steps.append(("retyped", old_path, new_path, column.type, other.type))
        elif column.type == "entity_array":
            steps += migration_steps(column.children, other.children, old_path + "/", new_path + "/")
    steps += [("added", "", new_at + n, None, c.type) for n, c in after.items() if n not in before and n not in taken]
    return steps


def schema_versions(collections: DataFrame) -> DataFrame:
    """One row per collection and version with its fingerprint and the version
    before it. Versions with a null number, or a null or unreadable schema, are
    not present; repeated rows count once."""
    rows = (
        collections.select("collection_id", "schema_version", "schema_json")
        .filter("collection_id is not null and schema_version is not null and schema_json is not null")
        .dropDuplicates(["collection_id", "schema_version"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [load_schema(text) for text in batch.column(2).to_pylist()]
            marked = batch.append_column("fingerprint", pa.array([None if c is None else fingerprint(c) for c in found], pa.string()))
            yield marked.filter(pa.array([c is not None for c in found], pa.bool_()))

    order = Window.partitionBy("collection_id").orderBy("schema_version")
    return rows.mapInArrow(run, "collection_id string, schema_version int, schema_json string, fingerprint string").select(
        "*", *(F.lag(c).over(order).alias(f"previous_{c}") for c in ("schema_version", "schema_json", "fingerprint"))
    )


def _steps_udf():
    @F.pandas_udf(CHANGE_TYPE)
    def steps(old, new):
        names = ("change_kind", "old_path", "new_path", "old_type", "new_type")
        return new.__class__([
            [] if a is None else [dict(zip(names, s)) for s in migration_steps(load_schema(a) or [], load_schema(b) or [])]
            for a, b in zip(old, new)
        ])

    return steps


def schema_migrations(collections: DataFrame) -> DataFrame:
    """Collection, version, the version before and the steps between them;
    versions with equal fingerprints have no steps and aren't compared."""
    return schema_versions(collections).select(
        "collection_id", "schema_version", "previous_schema_version", "fingerprint", "schema_json",
        _steps_udf()(F.when(F.col("fingerprint") != F.col("previous_fingerprint"), F.col("previous_schema_json")), F.col("schema_json")).alias("steps"),
    )


def schema_changes(collections: DataFrame) -> DataFrame:
    """The report: a row per change, under the later version. Empty tables and
    collections with one version give no rows."""
    return schema_migrations(collections).select("collection_id", "schema_version", F.explode("steps").alias("s")).select(
        "collection_id", "schema_version", "s.change_kind", "s.old_path", "s.new_path", "s.old_type", "s.new_type"
    )


#: Words read as yes and no when a value is cast to boolean.
YES_WORDS, NO_WORDS = ("true", "yes", "1", "y"), ("false", "no", "0", "n")
_NUMBER = re.compile(r"[-+]?\d+(?:[.,'\s]\d+)*")
_YEAR_FIRST = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[T\s].*)?$")
_YEAR_LAST = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$")


def to_number(text: str | None) -> float | None:
    """A number out of money and quantity strings: the last separator followed
    by one or two digits is the decimal point, the others group. In brackets it
    is negative, as in accounts."""
    if text is None or not (found := _NUMBER.search(text)):
        return None
    digits = re.sub(r"['\s]", "", found.group())
    last = max(digits.rfind("."), digits.rfind(","))
    if last >= 0:
        whole, part = digits[:last], digits[last + 1 :]
        grouped = len(part) == 3 and (digits[last] == "," or whole.count(digits[last]) > 0)
        digits = re.sub(r"[.,]", "", whole) + ("" if grouped else ".") + part
    try:
        value = float(digits)
    except ValueError:
        return None
    return -value if re.search(r"^\s*\(.*\)\s*$", text) and value > 0 else value


def to_date(text: str) -> str | None:
    """An ISO date. With the year last, points and hyphens mean the day comes
    first; with slashes the order must show by a number over 12, else null."""
    plain = text.strip()
    if found := _YEAR_FIRST.match(plain):
        year, month, day = int(found[1]), int(found[3]), int(found[4])
    elif found := _YEAR_LAST.match(plain):
        one, two, year = int(found[1]), int(found[3]), int(found[4])
        if found[2] == "/" and one <= 12 and two <= 12 and one != two:
            return None
        day, month = (two, one) if found[2] == "/" and two > 12 else (one, two)
    else:
        return None
    try:
        return date(year, month, day).isoformat()
    except ValueError:
        return None


def cast_value(text: str | None, to_type: str) -> str | None:
    """``text`` as the given type, written in one way; null if it can't be."""
    if text is None:
        return None
    if to_type in ("number", "currency"):
        value = to_number(text)
        return None if value is None else repr(value)
    if to_type == "boolean":
        word = text.strip().lower()
        return "true" if word in YES_WORDS else "false" if word in NO_WORDS else None
    if to_type == "date":
        return to_date(text)
    if to_type in ("email", "url"):
        plain = re.sub(r"(?i)^mailto:", "", text.strip())
        return plain if re.search(EMAIL if to_type == "email" else URL, plain) else None
    return text


def _heads(path: str) -> Iterator[tuple[str, str]]:
    """A path and all above it, longest first, each with the rest after it."""
    end = len(path)
    while end > 0:
        yield path[:end], path[end:]
        end = path.rfind("/", 0, end)


def trace(path: str, chain: list[tuple[int, list[dict]]], declared: bool = True) -> tuple[str, list[str], bool]:
    """Where a path ends after the versions of ``chain`` (in order), the casts on
    the way, and whether the schema still has it. A path not yet declared is
    left alone until a version adds it. A removed one keeps its last name and
    takes no part in what follows, whoever bears the name then."""
    casts: list[str] = []
    for _, steps in chain:
        if not declared:
            added = {s["new_path"] for s in steps if s["change_kind"] == "added"}
            declared = any(head in added for head, _ in _heads(path))
            continue
        gone = {s["old_path"] for s in steps if s["change_kind"] == "removed"}
        renames = {s["old_path"]: s["new_path"] for s in steps if s["change_kind"] == "renamed"}
        retypes = {s["old_path"]: s["new_type"] for s in steps if s["change_kind"] == "retyped"}
        if any(head in gone or rest and head in retypes for head, rest in _heads(path)):
            return path, casts, False
        if path in retypes:
            casts.append(retypes[path])
        path = next((renames[head] + rest for head, rest in _heads(path) if head in renames), path)
    return path, casts, declared


def _flat(columns: list[Column], at: str = "") -> dict[str, str]:
    """Paths of a schema with their types."""
    out: dict[str, str] = {}
    for c in columns:
        out.setdefault(at + c.name, c.type)
        for path, kind in _flat(c.children, f"{at}{c.name}/").items():
            out.setdefault(path, kind)
    return out


#: Where a path ends: the final path, the casts on the way, whether it is declared.
Route = dict[str, tuple[str, list[str], bool]]


def route(chain: list[tuple[int, list[dict]]], version: int, columns: list[Column]) -> Route:
    """For records of ``version`` with that schema: the paths that don't simply
    stay what they are, those that a later version adds among them."""
    later = [(v, s) for v, s in chain if v > version]
    out = {p: end for p in _flat(columns) if (end := trace(p, later)) != (p, [], True)}
    known = _flat(columns)
    for _, steps in later:
        for s in steps:
            if s["change_kind"] == "added" and s["new_path"] not in known:
                out.setdefault(s["new_path"], trace(s["new_path"], later, declared=False))
    return out


def follow(path: str, routes: Route) -> tuple[str, list[str], bool]:
    """The end of a path by its own route, else by that of the longest path above it."""
    for head, rest in _heads(path):
        if end := routes.get(head):
            return end[0] + rest, [] if rest else list(end[1]), end[2]
    return path, [], True


ROUTES = "collection_id string, schema_version int, schema_json string, route string"


def migration_routes(collections: DataFrame) -> DataFrame:
    """Per collection and version present its schema and its route (as JSON)."""
    migrations = schema_migrations(collections)
    versions = migrations.groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("schema_version", "schema_json", "steps"))).alias("versions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for collection_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chain = [(v["schema_version"], v["steps"] or []) for v in found]
                for v in found:
                    own = route(chain, v["schema_version"], load_schema(v["schema_json"]) or [])
                    out.append((collection_id, v["schema_version"], v["schema_json"], json.dumps(own, ensure_ascii=False)))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["collection_id", "schema_version", "schema_json", "route"]
            )

    return versions.mapInArrow(run, ROUTES)


@lru_cache(maxsize=512)
def _known(schema_json: str | None) -> dict[str, str]:
    return _flat(load_schema(schema_json) or [])


VALUE_SCHEMA = "column_path string, source_path string, row_path string, column_type string, value string, raw string, declared boolean"


def _consistent(response_json, schema_json, latest_json, route_json, defaults: dict[str, str]) -> list[tuple]:
    latest = _known(latest_json)
    body = recover_json(response_json)
    own: list[Column] = []
    if isinstance(body, dict):
        own = (schema_columns(body["schema"]) if isinstance(body.get("schema"), (dict, list)) else None) or parse_columns(body.get("new_columns"))
    brought = _flat(own)
    known = set(_known(schema_json)) if schema_json is not None else None
    routes: Route = json.loads(route_json) if route_json else {}
    out: list[tuple] = []
    present: set[tuple[str, str]] = set()
    records: list[tuple[str, str]] = []
    for kind, _, steps, _, fields in response_nodes(response_json, schema_json):
        if kind != "record":
            continue
        above = "/".join(steps[1::2])
        row_path = "/".join(steps)
        records.append((row_path, follow(above, routes)[0] if above else ""))
        for name, raw in fields:
            source = f"{above}/{name}" if above else name
            target, casts, alive = follow(source, routes)
            if known is not None and source not in known and source not in routes:
                alive = source in brought  # no schema of the collection has it
            to = latest.get(target, brought.get(source, "text")) if alive else brought.get(source, "text")
            value = raw
            for cast in [*casts, to]:
                value = cast_value(value, cast)
            declared = alive and (target in latest or source in brought)
            out.append((target, source, row_path, to, value, raw, declared))
            if declared:
                present.add((row_path, target))
    # columns a record lacks are there with their default
    for row_path, above in records:
        for path, to in latest.items():
            if path.rpartition("/")[0] == above and to != "entity_array" and (row_path, path) not in present:
                out.append((path, None, row_path, to, defaults.get(path, defaults.get(to)), None, True))
    return out


def consistent_table(responses: DataFrame, collections: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """One long table of what all responses of a collection hold, under the
    column paths and types of its latest schema: collection_id, response_id,
    schema_version, column_path, source_path (null where a default fills in),
    row_path, column_type, value, raw (as it stood), declared.

    A value that can't be cast is null and keeps its ``raw``. ``defaults`` gives
    the value of missing columns by path or type, null for others. Fields no
    schema has, and those of removed columns, keep their last name with
    ``declared`` false. A version that isn't present is read as the one before
    it, or the first; responses without a collection or version as they stand.
    Repeated rows count once, null ids each for itself.
    """
    routes = migration_routes(collections)
    latest = routes.groupBy("collection_id").agg(F.max_by("schema_json", "schema_version").alias("latest_json"), F.sort_array(F.collect_set("schema_version")).alias("versions"))
    rows = once(responses.select("response_id", "collection_id", "schema_version", "response_json"), "response_id")
    before = F.array_max(F.filter("versions", lambda v: v <= F.col("schema_version")))
    dated = rows.join(latest, "collection_id", "left").withColumn("_version", F.when(F.col("schema_version").isNotNull(), F.coalesce(before, F.get("versions", F.lit(0)))))
    theirs = routes.select(F.col("collection_id"), F.col("schema_version").alias("_version"), "schema_json", "route")
    joined = dated.join(theirs, ["collection_id", "_version"], "left").select("response_id", "collection_id", "schema_version", "response_json", "schema_json", "latest_json", "route")
    id_type = joined.schema["response_id"].dataType.simpleString()
    given = dict(defaults or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owners, rows_out = [], []
            for k, r in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)))):
                found = _consistent(*r, given)
                owners += [k] * len(found)
                rows_out += found
            path, source, at, kind, value, raw, known = zip(*rows_out) if rows_out else ((),) * 7
            take = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(take) for k in range(3)]
                + [pa.array(x, pa.string()) for x in (path, source, at, kind, value, raw)]
                + [pa.array(known, pa.bool_())],
                names=["response_id", "collection_id", "schema_version", "column_path", "source_path", "row_path", "column_type", "value", "raw", "declared"],
            )

    return joined.mapInArrow(run, f"response_id {id_type}, collection_id string, schema_version int, {VALUE_SCHEMA}")
