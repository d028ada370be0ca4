"""Argument rules: everything that can be wrong with a request is found before any output."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bough.errors import FilterError, SetupError, UnknownCode
from bough.operators.filters import LISTED_VALUES, BoundFilter, Literals, typed_literals, value_table
from bough.spec import Export, Filter

# Fixed values.
FORMATS = ("json", "csv", "xml", "parquet")
DEFAULT_FORMAT = "json"


def bind(
    export: Export, supplied: Mapping[str, object], reserved: Iterable[str] = ()
) -> dict[str, list[str] | DataFrame]:
    """What was given for each declared filter, under the filter's own name.

    Case does not matter in names. ``reserved`` names belong to someone else; any other name has
    to be declared, since leaving out a misspelt filter would let all rows through.
    """
    own = {f.name.lower(): f.name for f in export.filters}
    given: dict[str, list[str]] = {}
    for name in supplied:
        given.setdefault(name.lower(), []).append(name)
    for name in {r.lower() for r in reserved}:
        given.pop(name, None)
    strange = [spelt for name in given.keys() - own.keys() for spelt in given[name]]
    if strange:
        raise FilterError(
            f"no such filter: {', '.join(sorted(strange))} (declared: {', '.join(own.values()) or 'none'})"
        )
    repeated = [own[name] for name, spellings in given.items() if len(spellings) > 1]
    if repeated:
        raise FilterError(f"given twice under different spellings: {', '.join(repeated)}")
    return {own[name]: _as_texts(supplied[spelt]) for name, (spelt,) in given.items()}


def _as_texts(value: object) -> list[str] | DataFrame:
    if value is None:
        return []
    if isinstance(value, DataFrame):
        return value
    if isinstance(value, (list, tuple)):
        return [str(v) for v in value]
    return [str(value)]


def resolve(
    spark: SparkSession,
    export: Export,
    supplied: Mapping[str, list[str] | DataFrame],
    lookups: Mapping[str, object],
    schemas: Mapping[str, T.StructType],
) -> dict[str, list[BoundFilter]]:
    """Bound filters by entity name, with request lookups applied and values typed."""
    by_entity: dict[str, list[BoundFilter]] = {}
    for flt in export.filters:
        if flt.name not in supplied:
            if flt.required:
                raise FilterError(f"filter '{flt.name}' is required")
            continue
        entity = export.entity(flt.entity)
        field = entity.field(flt.field)
        types = {f.name.lower(): f.dataType for f in schemas[entity.name]}
        column_type = types[field.source.lower()]
        values = supplied[flt.name]
        if isinstance(values, DataFrame) or (flt.operator == "In" and len(values) > LISTED_VALUES):
            found = BoundFilter(flt, field, Literals((), column_type), _table(spark, flt, field, values, lookups, column_type))
        else:
            values = _checked_values(flt, values)
            if values and flt.request_lookup:
                values = _looked_up(flt, values, lookups)
            found = BoundFilter(flt, field, typed_literals(spark, flt, values, column_type))
        by_entity.setdefault(entity.name, []).append(found)
    return by_entity


def _table(spark: SparkSession, flt: Filter, field, values, lookups, column_type: T.DataType) -> DataFrame:
    """The values of an In filter as a table: a given one, or a list too long to write into a plan."""
    if flt.operator != "In":
        raise FilterError(f"filter '{flt.name}' ({flt.operator}) takes no table of values")
    if isinstance(values, DataFrame):
        if len(values.columns) != 1:
            raise FilterError(f"filter '{flt.name}': a table of values has one column")
        table = values
    else:
        table = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "value string")
    if flt.request_lookup:
        lookup = _request_lookup(flt, lookups)
        try:
            table = lookup.ids_table(table)
        except UnknownCode as unknown:
            raise FilterError(f"filter '{flt.name}': {unknown}") from unknown
    return value_table(flt, table, column_type, field.collation)


def _checked_values(flt: Filter, values: list[str]) -> list[str]:
    if flt.operator in ("IsNull", "IsNotNull"):
        return []
    count = len(values)
    if flt.operator == "In":
        if not count:
            raise FilterError(f"filter '{flt.name}' takes at least one value")
        return values
    needed = 2 if flt.operator == "Between" else 1
    if count != needed:
        raise FilterError(f"filter '{flt.name}' ({flt.operator}) takes {needed} value(s), not {count}")
    return values


def _request_lookup(flt: Filter, lookups: Mapping[str, object]):
    lookup = lookups.get(flt.request_lookup.lower())
    if lookup is None or (hasattr(lookup, "request") and lookup.request is None):
        raise SetupError(f"filter '{flt.name}' needs request lookup '{flt.request_lookup}'")
    return lookup


def _looked_up(flt: Filter, values: list[str], lookups: Mapping[str, object]) -> list[str]:
    lookup = _request_lookup(flt, lookups)
    try:
        ids = lookup.ids_of(values)
    except UnknownCode as unknown:
        raise FilterError(f"filter '{flt.name}': {unknown}") from unknown
    return [ids[v] for v in values]


def require_lookups(export: Export, lookups: Mapping[str, object]) -> None:
    """Every field's lookup must be there before a row is read."""
    for entity in export.entities():
        for field in entity.fields:
            if not field.lookup:
                continue
            lookup = lookups.get(field.lookup.lower())
            if lookup is None or (hasattr(lookup, "render") and lookup.render is None):
                raise SetupError(
                    f"field '{field.name}' of '{entity.name}' needs lookup '{field.lookup}'"
                )


def output_format(name: str | None = None) -> str:
    """The output format by name, ``json`` when none is given."""
    wanted = (name or DEFAULT_FORMAT).lower()
    if wanted not in FORMATS:
        raise SetupError(f"unknown format '{name}'; supported: {', '.join(FORMATS)}")
    return wanted
