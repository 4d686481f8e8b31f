"""Column, entity and collection schemas as they come in JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: The logical column types.
COLUMN_TYPES = ("text", "number", "date", "currency", "boolean", "email", "url", "entity_array")


def column_type(raw: object) -> str:
    """The logical type; anything unknown or missing counts as text."""
    name = str(raw).strip().lower() if raw is not None else "text"
    return name if name in COLUMN_TYPES else "text"


@dataclass
class Column:
    name: str
    type: str = "text"
    description: str | None = None
    required: bool = True
    example: str | None = None
    hint: dict | None = None
    children: list["Column"] = field(default_factory=list)
    has_entity: bool = False

    def child(self, name: str) -> "Column | None":
        return next((c for c in self.children if c.name == name), None)

    def canonical(self) -> list:
        return [self.name, self.type, self.required, self.description, self.example, [c.canonical() for c in self.children]]


def parse_columns(raw: object) -> list[Column]:
    """Columns of a JSON list; members that are not objects are left out, a
    missing name becomes ``column_<place from 1>``."""
    out = []
    for place, item in enumerate(raw if isinstance(raw, list) else [], 1):
        if not isinstance(item, dict):
            continue
        entity = next((item[k] for k in ("entitySchema", "entity_schema") if isinstance(item.get(k), dict)), None)
        hint = next((item[k] for k in ("queryHint", "query_hint") if isinstance(item.get(k), dict)), None)
        name = item.get("name")
        example = hint.get("example") if hint else None
        described = item.get("description")
        out.append(
            Column(
                name=str(name) if name is not None else f"column_{place}",
                type=column_type(item.get("type")),
                description=described if isinstance(described, str) and described.strip() else None,
                required=item.get("required") is not False,
                example=None if example is None else str(example),
                hint=hint,
                children=parse_columns(entity.get("columns")) if entity else [],
                has_entity=entity is not None,
            )
        )
    return out


def schema_columns(parsed: object) -> list[Column] | None:
    """Columns of a saved schema in any of its outer shapes: a bare list, an
    object with ``columns``, or such an object under ``schema``. None if there
    are none to be found."""
    if isinstance(parsed, list):
        return parse_columns(parsed)
    if isinstance(parsed, dict):
        if isinstance(parsed.get("columns"), list):
            return parse_columns(parsed["columns"])
        for key in ("schema", "Schema"):
            if key in parsed:
                return schema_columns(parsed[key])
    return None


def load_schema(text: str | None) -> list[Column] | None:
    """``schema_columns`` of JSON text; None for null and unreadable text."""
    if text is None:
        return None
    try:
        return schema_columns(json.loads(text))
    except ValueError:
        return None
