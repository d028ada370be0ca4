"""Predicates from supplied filter values.

Values become typed literals while the plan is built, so a bad value fails early and every
predicate can reach the scan. Long lists, and values that are a table, are joined instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.errors import FilterError
from bough.functions.parse import NUMBER, parse
from bough.names import col
from bough.operators.staging import small_rows, stage
from bough.spec import Field, Filter

#: More values than this are joined rather than written into the plan.
LISTED_VALUES = 2000
#: Values are broadcast up to this many; more are joined by shuffle.
BROADCAST_VALUES = 1_000_000
VALUE = "value:"
WIDEST = 38


@dataclass(frozen=True)
class Literals:
    """Typed values of one filter: their texts and the Spark type they are read as."""

    texts: tuple[str, ...]
    dtype: T.DataType

    def columns(self) -> list[Column]:
        if isinstance(self.dtype, T.DecimalType):
            return [F.lit(Decimal(t)) for t in self.texts]
        # A cast of a literal folds to a literal; text keeps time values free of zone shifts.
        return [F.lit(t).cast(self.dtype) for t in self.texts]


@dataclass(frozen=True)
class BoundFilter:
    """A declared filter with the literals it compares to, or a table of values to be among."""

    filter: Filter
    field: Field
    literals: Literals
    values: DataFrame | None = None


def _texts(spark: SparkSession, values: list[str], as_value) -> list[str | None]:
    """Evaluate an expression over the few supplied values, keeping their order."""
    given = small_rows(spark, list(enumerate(values)), "pos int, raw string")
    rows = given.select("pos", as_value(F.col("raw")).cast("string").alias("text")).collect()
    return [row.text for row in sorted(rows, key=lambda r: r.pos)]


def typed_literals(
    spark: SparkSession, flt: Filter, values: list[str], column_type: T.DataType
) -> Literals:
    """Read ``values`` as the filter's value type; text meant for a column of another type is read
    as that type, because the column decides what a text can match."""
    declared = flt.value_type
    if not values:
        return Literals((), column_type)
    if declared == "String" and not isinstance(column_type, T.StringType):
        dtype = column_type
        texts = _texts(spark, values, lambda c: c.try_cast(column_type))
    else:
        dtype = _type_of(declared, column_type)
        if declared == "String":
            texts = list(values)
        elif declared == "Decimal":
            texts = _decimal_texts(values)
        else:
            texts = _texts(spark, values, lambda c: parse(c, declared).cast(dtype))
    for value, found in zip(values, texts):
        if found is None:
            raise FilterError(f"filter '{flt.name}': '{value}' is not a valid {declared}")
    return Literals(tuple(texts), dtype)


def _type_of(declared: str, column_type: T.DataType) -> T.DataType:
    """The type that a filter's values are compared as. A date is midnight, but for a column of
    dates it stays one, so that the comparison is between like types and reaches the scan."""
    if declared == "Date" and isinstance(column_type, T.DateType):
        return T.DateType()
    return {
        "String": T.StringType(),
        "Int32": T.IntegerType(),
        "Int64": T.LongType(),
        "Boolean": T.BooleanType(),
        "Date": T.TimestampNTZType(),
        "DateTime": T.TimestampNTZType(),
        "Guid": T.StringType(),
        "Decimal": T.DecimalType(38, 18),
    }[declared]


def _decimal_texts(values: list[str]) -> list[str | None]:
    """Exact digits at the scale they were given in, so that a column keeps its own type; None for
    what is no number or needs more digits than the widest decimal has."""
    pattern = re.compile(NUMBER)
    return [_exact(v.strip()) if pattern.match(v) else None for v in values]


def _exact(text: str) -> str | None:
    try:
        number = Decimal(text)
        _, digits, exponent = number.as_tuple()
    except ArithmeticError:
        return None
    if not any(digits):
        return "0"
    kept = "".join(map(str, digits)).strip("0")
    exponent += len(digits) - len("".join(map(str, digits)).rstrip("0"))
    scale = max(0, -exponent)
    whole = max(0, len(kept.lstrip("0")) + exponent)
    # Bounded before it is written out: an exponent can be of any size.
    return f"{number:.{scale}f}" if scale <= WIDEST and whole + scale <= WIDEST else None


def value_table(
    flt: Filter, given: DataFrame, column_type: T.DataType, collation: str | None = None
) -> DataFrame:
    """Distinct typed values of an In filter as a table, from the texts in the only column of
    ``given``; they are read on the executors, and one that does not fit is an error.

    Values that a column of ``column_type`` cannot hold match nothing and are left out.
    """
    (name,) = given.columns
    raw = given.select(col(name).cast("string").alias("raw")).where("raw is not null")
    declared = flt.value_type
    if declared == "String":
        typed = F.col("raw") if isinstance(column_type, T.StringType) else F.col("raw").try_cast(column_type)
    else:
        typed = parse(F.col("raw"), declared)
    read = stage(raw.select("raw", typed.alias("typed")), "filter-values")
    wrong = read.where("typed is null").first()
    if wrong is not None:
        raise FilterError(f"filter '{flt.name}': '{wrong.raw}' is not a valid {declared}")
    if read.isEmpty():
        raise FilterError(f"filter '{flt.name}' takes at least one value")
    value = F.col("typed")
    if isinstance(column_type, T.StringType):
        value = value.cast("string")
        if collation and declared != "Guid":
            value = F.collate(value, collation)
    elif not isinstance(column_type, T.DatetimeType):
        held = value.try_cast(column_type)
        value = F.when(held == value, held)
    table = read.select(value.alias(VALUE)).where(f"`{VALUE}` is not null").distinct()
    return F.broadcast(table) if read.count() <= BROADCAST_VALUES else table


def among(df: DataFrame, bound: BoundFilter, column_type: T.DataType) -> DataFrame:
    """Rows whose value is in the table of a bound filter."""
    value = col(bound.field.source)
    if isinstance(column_type, T.StringType):
        if bound.filter.value_type == "Guid":
            value = F.lower(value)
        elif bound.field.collation:
            value = F.collate(value, bound.field.collation)
    return df.join(bound.values, value == col(VALUE), "left_semi")


def predicate(bound: BoundFilter, column_type: T.DataType) -> Column:
    """The condition of one filter on its source column, with SQL's three-valued logic."""
    flt = bound.filter
    value = col(bound.field.source)
    exact = isinstance(column_type, (T.DecimalType, T.IntegralType))
    if bound.literals.texts and flt.value_type == "Decimal" and exact:
        return _exactly_compared(flt, value, [Decimal(t) for t in bound.literals.texts], column_type)
    literals = bound.literals.columns()
    if isinstance(column_type, T.StringType):
        if flt.value_type == "Guid":
            if flt.operator in ("Equals", "In"):
                return _guid_among(value, bound.literals.texts)
            value = F.lower(value) if literals else value
        elif bound.field.collation:
            value = F.collate(value, bound.field.collation)
            literals = [F.collate(v, bound.field.collation) for v in literals]
    return _compared(flt, value, literals)


def _exactly_compared(flt: Filter, value: Column, numbers: list[Decimal], column_type: T.DataType) -> Column:
    """Decimals against a column of exact numbers, in the column's own type: a common type could be
    too narrow for the digits of both, and rounding one of them would change the answer."""
    if isinstance(column_type, T.DecimalType):
        unit = Decimal(1).scaleb(-column_type.scale)
        top = Decimal(10) ** (column_type.precision - column_type.scale) - unit
        bottom = -top
    else:
        bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[column_type.simpleString()]
        unit, top, bottom = Decimal(1), Decimal(2 ** (bits - 1) - 1), Decimal(-(2 ** (bits - 1)))

    def held(number: Decimal, rounding: str) -> Decimal:
        with localcontext(prec=2 * WIDEST + 2):
            return number.quantize(unit, rounding)

    def literal(number: Decimal) -> Column:
        return F.lit(f"{number:f}").cast(column_type)

    def from_(number: Decimal) -> Column:
        least = held(number, ROUND_CEILING)
        if least > top:
            return F.lit(False)
        return value >= literal(max(least, bottom))

    def to(number: Decimal) -> Column:
        most = held(number, ROUND_FLOOR)
        if most < bottom:
            return F.lit(False)
        return value <= literal(min(most, top))

    match flt.operator:
        case "GreaterThanOrEqual":
            return from_(numbers[0])
        case "LessThanOrEqual":
            return to(numbers[0])
        case "Between":
            return from_(numbers[0]) & to(numbers[1])
    same = [n for n in numbers if held(n, ROUND_FLOOR) == n and bottom <= n <= top]
    return value.isin([literal(n) for n in same]) if same else F.lit(False)


def _guid_among(value: Column, texts: tuple[str, ...]) -> Column:
    """Equality whatever the case of the letters. Every spelling of a GUID lies between its
    spelling in capitals and that in small letters, which the scan can use."""
    low, high = min(t.upper() for t in texts), max(texts)
    return value.between(low, high) & F.lower(value).isin(list(texts))


def _compared(flt: Filter, value: Column, literals: list[Column]) -> Column:
    match flt.operator:
        case "Equals":
            return value == literals[0]
        case "In":
            return value.isin(literals)
        case "GreaterThanOrEqual":
            return value >= literals[0]
        case "LessThanOrEqual":
            return value <= literals[0]
        case "Between":
            return value.between(*literals)
        case "IsNull":
            return value.isNull()
        case "IsNotNull":
            return value.isNotNull()
    raise FilterError(f"filter '{flt.name}': unknown operator '{flt.operator}'")


def conjunction(bound: list[BoundFilter], schema: T.StructType) -> Column | None:
    """All filters of one entity together, or None where it has none."""
    types = {f.name.lower(): f.dataType for f in schema}
    listed = [b for b in bound if b.values is None]
    conditions = [predicate(b, types[b.field.source.lower()]) for b in listed]
    return reduce(Column.__and__, conditions) if conditions else None
