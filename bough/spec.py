"""The export description: a tree of entities and the filters a caller may supply.

The description is an argument, not a catalog. It can be written with the dataclasses below or
taken from a plain document with :meth:`Export.from_dict`.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field as dc_field
from typing import Any

from bough.errors import SpecError

# Declared types, filter operators, reserved output names and limits.
FIELD_TYPES = ("String", "Int32", "Int64", "Decimal", "Boolean", "DateTime", "Date", "Guid")
OPERATORS = (
    "Equals",
    "In",
    "GreaterThanOrEqual",
    "LessThanOrEqual",
    "Between",
    "IsNull",
    "IsNotNull",
)
RESERVED_FIELDS = ("RowNumber", "ParentRowNumber", "RealKey")
MAX_ENTITIES = 100
MAX_IDENTIFIER = 128
NO_RANGE_TYPES = ("String", "Boolean", "Guid")

# The code points that may start an XML name, and those that may follow, as the XML
# 1.0 and namespace standards publish them (the basic plane, without the colon).
NAME_START = (
    (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2FF),
    (0x370, 0x37D), (0x37F, 0x1FFF), (0x200C, 0x200D), (0x2070, 0x218F), (0x2C00, 0x2FEF),
    (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD),
)
NAME_MORE = (
    (0x2D, 0x2E), (0x30, 0x39), (0xB7, 0xB7), (0x300, 0x36F), (0x203F, 0x2040),
)


def _char_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


_NAME = re.compile(f"[{_char_class(NAME_START)}][{_char_class(NAME_START + NAME_MORE)}]*")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")


def _columns(value: str | list | tuple | None) -> tuple[str, ...]:
    if value is None:
        return ()
    return (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class Field:
    """One output value. ``collation`` names a Spark collation for filters on this field."""

    name: str
    column: str | None = None
    type: str = "String"
    lookup: str | None = None
    collation: str | None = None

    @property
    def source(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Entity:
    """One level. ``key`` and ``parent_key`` are one column name or several."""

    name: str
    table: str
    key: str | tuple[str, ...]
    fields: tuple[Field, ...]
    parent_key: str | tuple[str, ...] | None = None
    children: tuple["Entity", ...] = ()
    schema: str | None = None

    @property
    def key_columns(self) -> tuple[str, ...]:
        return _columns(self.key)

    @property
    def parent_key_columns(self) -> tuple[str, ...]:
        return _columns(self.parent_key)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Filter:
    """A predicate the caller may fill in at run time."""

    name: str
    entity: str
    field: str
    operator: str = "Equals"
    value_type: str = "String"
    request_lookup: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Export:
    name: str
    root: Entity
    filters: tuple[Filter, ...] = ()
    version: str = "1"
    description: str | None = None
    _parents: dict = dc_field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        for entity in self.entities():
            for child in entity.children:
                self._parents[child.name] = entity

    def entities(self) -> Iterator[Entity]:
        """Every entity, breadth first, parents before children."""
        queue = deque([self.root])
        while queue:
            entity = queue.popleft()
            yield entity
            queue.extend(entity.children)

    def entity(self, name: str) -> Entity | None:
        return next((e for e in self.entities() if e.name.lower() == (name or "").lower()), None)

    def parent(self, entity: Entity) -> Entity | None:
        return None if entity is self.root else self._parents.get(entity.name)

    def ancestry(self, entity: Entity) -> list[Entity]:
        """Root first, ``entity`` last."""
        chain = [entity]
        while (up := self.parent(chain[0])) is not None:
            chain.insert(0, up)
        return chain

    @property
    def is_flat(self) -> bool:
        return not self.root.children

    @staticmethod
    def from_dict(document: Mapping[str, Any]) -> "Export":
        """Read a document with camelCase members (``keyColumn``, ``parentKeyColumn``, ...)."""
        doc = _lower(document)
        missing = [m for m in ("name", "root") if m not in doc]
        if missing:
            raise SpecError([f"the export needs '{m}'" for m in missing])
        return Export(
            name=doc["name"],
            version=str(doc.get("version", "1")),
            description=doc.get("description"),
            root=_entity(doc["root"]),
            filters=tuple(_filter(f) for f in doc.get("filters") or ()),
        )

    def problems(self) -> list[str]:
        """Everything wrong with the description, so that it can be fixed in one pass."""
        found = _name_problems("export", self.name)
        every = list(self.entities())
        if len(every) > MAX_ENTITIES:
            found.append(f"{len(every)} entities; at most {MAX_ENTITIES} are allowed")
        seen: set[str] = set()
        for entity in every:
            found += self._entity_problems(entity, seen)
        seen = set()
        for flt in self.filters:
            found += self._filter_problems(flt, seen)
        return found

    def check(self) -> "Export":
        found = self.problems()
        if found:
            raise SpecError(found)
        return self

    def _entity_problems(self, entity: Entity, seen: set[str]) -> list[str]:
        if not _filled(entity.name):
            return ["an entity has no name"]
        where = f"entity '{entity.name}'"
        found = _name_problems("entity", entity.name)
        if entity.name.lower() in seen:
            found.append(f"{where}: the name is used twice")
        seen.add(entity.name.lower())

        found += _identifier_problems(f"{where}: table", (entity.table,))
        found += _identifier_problems(f"{where}: key column", entity.key_columns or ("",))
        if entity.schema:
            found += _identifier_problems(f"{where}: schema", (entity.schema,))
        if entity is not self.root or entity.parent_key_columns:
            found += _identifier_problems(
                f"{where}: parent key column", entity.parent_key_columns or ("",)
            )
        up = self.parent(entity)
        if (
            up is not None
            and entity.parent_key_columns
            and len(entity.parent_key_columns) != len(up.key_columns)
        ):
            found.append(f"{where}: the parent key and the key of '{up.name}' differ in length")

        if not entity.fields:
            found.append(f"{where}: no fields")
        child_names = {(c.name or "").lower() for c in entity.children}
        used: set[str] = set()
        for fld in entity.fields:
            found += _field_problems(where, fld, used, child_names)
        return found

    def _filter_problems(self, flt: Filter, seen: set[str]) -> list[str]:
        if not _filled(flt.name):
            return ["a filter has no name"]
        where = f"filter '{flt.name}'"
        found = _name_problems("filter", flt.name)
        if flt.name.lower() in seen:
            found.append(f"{where}: the name is used twice")
        seen.add(flt.name.lower())
        if flt.operator not in OPERATORS:
            found.append(f"{where}: unknown operator '{flt.operator}'")
        if flt.value_type not in FIELD_TYPES:
            found.append(f"{where}: unknown value type '{flt.value_type}'")
        if flt.operator == "Between" and flt.value_type in NO_RANGE_TYPES:
            found.append(f"{where}: Between does not work on {flt.value_type}")
        entity = self.entity(flt.entity)
        if entity is None:
            found.append(f"{where}: unknown entity '{flt.entity}'")
        elif entity.field(flt.field or "") is None:
            found.append(f"{where}: entity '{flt.entity}' has no field '{flt.field}'")
        return found


def valid_name(name: str) -> bool:
    return bool(_NAME.fullmatch(name))


def _filled(text: Any) -> bool:
    return isinstance(text, str) and bool(text.strip())


def _name_problems(what: str, name: str) -> list[str]:
    if not _filled(name):
        return [f"the {what} has no name"]
    if not valid_name(name):
        return [f"{what} name '{name}' is not an XML name without a colon"]
    return []


def _identifier_problems(what: str, names: tuple[str, ...]) -> list[str]:
    found = []
    for name in names:
        if not _filled(name):
            found.append(f"{what} is required")
        elif len(name) > MAX_IDENTIFIER or _CONTROL.search(name):
            found.append(f"{what} '{name}' must be 1-{MAX_IDENTIFIER} printable characters")
    return found


def _field_problems(where: str, fld: Field, used: set[str], child_names: set[str]) -> list[str]:
    if not _filled(fld.name):
        return [f"{where}: a field has no name"]
    low, found = fld.name.lower(), []
    if low in used:
        found.append(f"{where}: field '{fld.name}' is declared twice")
    used.add(low)
    if not valid_name(fld.name):
        found.append(f"{where}: field name '{fld.name}' is not an XML name without a colon")
    if low in {r.lower() for r in RESERVED_FIELDS}:
        found.append(f"{where}: field name '{fld.name}' is reserved")
    if low in child_names:
        found.append(f"{where}: field '{fld.name}' is named like a child entity")
    if fld.type not in FIELD_TYPES:
        found.append(f"{where}: field '{fld.name}' has unknown type '{fld.type}'")
    if fld.column is not None:
        found += _identifier_problems(f"{where}: column of field '{fld.name}'", (fld.column,))
    return found


def _lower(document: Mapping[str, Any]) -> dict[str, Any]:
    return {str(k).lower(): v for k, v in document.items()}


def _choice(value: str | None, choices: tuple[str, ...], default: str) -> str:
    """The declared spelling of ``value``, or ``value`` itself so that check() can name it."""
    if value is None:
        return default
    return next((c for c in choices if c.lower() == str(value).lower()), str(value))


def _entity(document: Mapping[str, Any]) -> Entity:
    doc = _lower(document)
    return Entity(
        name=doc.get("name") or "",
        table=doc.get("table") or "",
        schema=doc.get("schema"),
        key=doc.get("keycolumn") or "",
        parent_key=doc.get("parentkeycolumn"),
        fields=tuple(_field(f) for f in doc.get("fields") or ()),
        children=tuple(_entity(c) for c in doc.get("children") or ()),
    )


def _field(document: Mapping[str, Any]) -> Field:
    doc = _lower(document)
    return Field(
        name=doc.get("name") or "",
        column=doc.get("column"),
        type=_choice(doc.get("type"), FIELD_TYPES, "String"),
        lookup=doc.get("lookup"),
        collation=doc.get("collation"),
    )


def _filter(document: Mapping[str, Any]) -> Filter:
    doc = _lower(document)
    return Filter(
        name=doc.get("name") or "",
        entity=doc.get("entity") or "",
        field=doc.get("field") or "",
        operator=_choice(doc.get("operator"), OPERATORS, "Equals"),
        value_type=_choice(doc.get("valuetype"), FIELD_TYPES, "String"),
        request_lookup=doc.get("requestlookup"),
        required=bool(doc.get("required", False)),
    )
