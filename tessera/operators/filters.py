"""Structured filters over a collection's tables, as Catalyst predicates.

A request names columns, operators and values; values are bound as literals,
never put into text. Nested conditions become semi-joins: under ``all`` those on
one entity must hold on the same child row, under ``any`` each stands alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera import model
from tessera.errors import ValidationError
from tessera.functions.values import FALSE_WORDS, TRUE_WORDS, escape_like, number_text, sanitized

#: Operators, and those that take no value or a pattern.
OPERATORS = ("eq", "neq", "contains", "starts_with", "ends_with", "gt", "gte", "lt", "lte", "is_empty", "is_not_empty")
NO_VALUE, PATTERNS = ("is_empty", "is_not_empty"), ("contains", "starts_with", "ends_with")
#: Rows of a page: default and most. Distinct values: default and most.
PAGE_ROWS, PAGE_MOST, VALUES, VALUES_MOST = 100, 1000, 200, 500
ROW, PARENT = "_row_id", "_parent_row_id"


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: object = None
    entity: str | None = None


@dataclass
class FilterRequest:
    filters: list[Condition] = field(default_factory=list)
    match: str = "all"
    sort: str | None = None
    direction: str = "asc"
    page: int = 1
    limit: int | None = None
    exclude_low: bool = False
    result_unit: str | None = None


@dataclass
class Collection:
    """A collection's tables: ``main`` and one child table per entity, with
    bookkeeping columns beginning with an underscore; ``columns`` is its schema."""

    columns: list[model.Column]
    main: DataFrame
    children: dict[str, DataFrame] = field(default_factory=dict)

    def entity(self, name: str) -> tuple[model.Column, DataFrame]:
        for column in self.columns:
            if column.type == "entity_array" and sanitized(column.name) == sanitized(name):
                return column, self.children[column.name]
        raise ValidationError(f"Unknown entity: {name}")

    def resolve(self, name: str, entity: str | None = None) -> model.Column:
        known = self.columns if entity is None else self.entity(entity)[0].children
        for column in known:
            if column.name == name or sanitized(column.name) == sanitized(name) or column.name.lower() == name.lower():
                if column.type == "entity_array":
                    raise ValidationError(f"Column {name} holds entries; name a column inside it")
                return column
        raise ValidationError(f"Unknown column: {name}")

    def parent_label(self) -> str | None:
        """The column that names a parent row: a person's, else a firm's, else a
        text, else an identifier; a description last."""
        # Roles by how well they name a row.
        ranks = {"person_name": 0, "company": 1, "organization": 1, "identifier": 3, "email": 3, "description": 100}

        def rank(c: model.Column) -> int:
            return ranks.get((c.hint or {}).get("role"), 2 if c.type in ("text", "email") else 50)

        scalars = [c for c in self.columns if c.type != "entity_array"]
        return sanitized(min(scalars, key=rank).name) if scalars else None


def text_of(column: Column, kind: str) -> Column:
    return number_text(column) if kind in ("number", "currency") else column.cast("string")


def coerced(value: object, kind: str, operator: str) -> object:
    """A request's value as its column's type; raises if it can't be."""
    if operator in PATTERNS:
        return str(value)
    if kind in ("number", "currency"):
        try:
            return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else float(str(value).translate(str.maketrans("", "", ",$€£¥₹ \t\n")))
        except ValueError:
            raise ValidationError(f"Not a number: {value}") from None
    if kind == "boolean":
        word = str(value).lower()
        if word in TRUE_WORDS or word in FALSE_WORDS:
            return word in TRUE_WORDS
        raise ValidationError(f"Not a yes or no: {value}")
    return str(value)


def predicate(column: Column, kind: str, operator: str, value: object = None) -> Column:
    """One condition as a predicate. ``neq`` also takes rows without a value;
    texts and dates compare as text."""
    if operator not in OPERATORS:
        raise ValidationError(f"Unknown operator: {operator}")
    if operator in NO_VALUE:
        blank = column.isNull() if kind in ("number", "currency", "boolean") else column.isNull() | (F.trim(column) == "")
        return blank if operator == "is_empty" else ~blank
    if value is None or isinstance(value, str) and not value.strip():
        raise ValidationError(f"Operator {operator} needs a value")
    bound = coerced(value, kind, operator)
    if operator in PATTERNS:
        pattern = escape_like(bound)
        pattern = f"%{pattern}%" if operator == "contains" else f"{pattern}%" if operator == "starts_with" else f"%{pattern}"
        return text_of(column, kind).ilike(pattern)
    given = F.lit(bound)
    compare = {"eq": lambda: column == given, "neq": lambda: ~column.eqNullSafe(given), "gt": lambda: column > given, "gte": lambda: column >= given, "lt": lambda: column < given, "lte": lambda: column <= given}
    return compare[operator]()


def _joined(parts: Iterable[Column], match: str) -> Column:
    return reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), parts)


def _checked(request: FilterRequest) -> tuple[int, int]:
    if request.match not in ("all", "any"):
        raise ValidationError("match must be all or any")
    if request.direction not in ("asc", "desc"):
        raise ValidationError("direction must be asc or desc")
    if request.result_unit not in (None, "entries", "documents"):
        raise ValidationError("resultUnit must be entries or documents")
    limit = min(PAGE_MOST, max(1, request.limit if request.limit is not None else PAGE_ROWS))
    return limit, (max(1, request.page) - 1) * limit


def wants_entries(collection: Collection, request: FilterRequest) -> str | None:
    """The entity whose entries answer a request; None if documents do."""
    named = {collection.entity(c.entity)[0].name for c in request.filters if c.entity}
    if request.result_unit == "entries" and not named:
        raise ValidationError("Entries need a condition on a nested entity")
    return named.pop() if len(named) == 1 and request.result_unit != "documents" else None


def _condition(collection: Collection, c: Condition, alias: str | None = None) -> Column:
    column = collection.resolve(c.column, c.entity)
    name = sanitized(column.name)
    return predicate(F.col(f"{alias}.{name}" if alias else name), column.type, c.operator, c.value)


def filter_documents(collection: Collection, request: FilterRequest) -> DataFrame:
    """All rows of the main table that match, unordered."""
    plain = [_condition(collection, c) for c in request.filters if not c.entity]
    nested: dict[str, list[Condition]] = {}
    for c in request.filters:
        if c.entity:
            nested.setdefault(collection.entity(c.entity)[0].name, []).append(c)
    out = collection.main
    if request.match == "all":
        if plain:
            out = out.filter(_joined(plain, "all"))
        for entity, conditions in nested.items():
            child = collection.children[entity].filter(_joined([_condition(collection, c) for c in conditions], "all"))
            out = out.join(child.select(F.col(PARENT).alias(ROW)), ROW, "left_semi")
        return out
    flags = list(plain)
    k = 0
    for entity, conditions in nested.items():
        # one pass over the child table tells which of its conditions each parent
        # meets; rows that meet none are gone before the shuffle
        tests = [_condition(collection, c) for c in conditions]
        held = [F.max(F.coalesce(t, F.lit(False))).alias(f"_met{k + i}") for i, t in enumerate(tests)]
        met = collection.children[entity].filter(_joined(tests, "any")).groupBy(F.col(PARENT).alias(ROW)).agg(*held)
        out = out.join(met, ROW, "left")
        flags += [F.coalesce(F.col(f"_met{k + i}"), F.lit(False)) for i in range(len(conditions))]
        k += len(conditions)
    matched = out.filter(_joined(flags, "any")) if flags else out
    return matched.select(*collection.main.columns)


def filter_entries(collection: Collection, request: FilterRequest, entity: str) -> DataFrame:
    """Entries of an entity whose own conditions and whose parent's hold, with
    the parent's label as ``parent``."""
    child, main = collection.children[entity].alias("c"), collection.main.alias("m")
    groups = [
        _joined(found, request.match)
        for alias, wanted in (("c", True), ("m", False))
        if (found := [_condition(collection, c, alias) for c in request.filters if bool(c.entity) == wanted])
    ]
    joined = child.join(main, F.col(f"c.{PARENT}") == F.col(f"m.{ROW}"))
    if groups:
        joined = joined.filter(_joined(groups, "all"))
    label = collection.parent_label()
    return joined.select("c.*", (F.col(f"m.{label}").cast("string") if label else F.lit(None).cast("string")).alias("parent"))


def ordered(rows: DataFrame, name: str | None, direction: str) -> DataFrame:
    """Nulls last ascending, first descending; ties by row."""
    if name is None:
        return rows.orderBy(F.col(ROW).asc())
    key = F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_first()
    return rows.orderBy(key, F.col(ROW).asc())


def filter_page(collection: Collection, request: FilterRequest) -> tuple[DataFrame, DataFrame, str | None]:
    """A page of matching rows, all of them uncounted, and the entity they are
    entries of. Count the second for the total."""
    limit, offset = _checked(request)
    entity = wants_entries(collection, request)
    if entity:
        rows, sort = filter_entries(collection, request, entity), None
    else:
        rows = filter_documents(collection, request)
        sort = sanitized(collection.resolve(request.sort).name) if request.sort else None
    return ordered(rows, sort, request.direction).offset(offset).limit(limit), rows, entity


def distinct_values(collection: Collection, name: str, entity: str | None = None, limit: int = VALUES) -> DataFrame:
    """The distinct values of a column as text, ascending, without blanks."""
    column = collection.resolve(name, entity)
    table = collection.main if entity is None else collection.entity(entity)[1]
    value = text_of(F.col(sanitized(column.name)), column.type)
    return table.select(value.alias("value")).filter("value is not null and trim(value) <> ''").distinct().orderBy("value").limit(min(VALUES_MOST, max(1, limit)))


def page_of(table: DataFrame, page: int = 1, limit: int = PAGE_ROWS) -> DataFrame:
    limit = min(PAGE_MOST, max(1, limit))
    return table.orderBy(ROW).offset((max(1, page) - 1) * limit).limit(limit)
