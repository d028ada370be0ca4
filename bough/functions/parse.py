"""Text to declared types. A text that does not fit is a flag, never a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts each declared type accepts.
BLANKS = "\t\n\v\f\r "
_BLANK = r"[\t-\r ]*"
WHOLE = rf"^{_BLANK}[+-]?[0-9]+{_BLANK}$"
NUMBER = rf"^{_BLANK}[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{_BLANK}$"
BOOLEAN = rf"^(?i){_BLANK}(true|false){_BLANK}$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATE_TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,7})?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
)
GUID = (
    r"^(?i)([0-9a-f]{32}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|\([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\))$"
)
# The precision and scale of decimals whose reader names none.
DECIMAL = (38, 18)


def spark_type(declared: str, decimal: tuple[int, int] = DECIMAL) -> T.DataType:
    """The Spark type that holds values of a declared type."""
    return {
        "String": T.StringType(),
        "Int32": T.IntegerType(),
        "Int64": T.LongType(),
        "Decimal": T.DecimalType(*decimal),
        "Boolean": T.BooleanType(),
        "DateTime": T.TimestampNTZType(),
        "Date": T.TimestampNTZType(),
        "Guid": T.StringType(),
    }[declared]


def parse(raw: Column, declared: str, decimal: tuple[int, int] = DECIMAL) -> Column:
    """The typed value of a text, or null where the text does not fit."""
    target = spark_type(declared, decimal)
    if declared == "String":
        return raw
    trimmed = F.btrim(raw, F.lit(BLANKS))
    if declared in ("Int32", "Int64"):
        return F.when(raw.rlike(WHOLE), trimmed.try_cast(target))
    if declared == "Decimal":
        # Most texts have no exponent and few digits, which is seen at once.
        plain = raw.rlike(rf"^[+-]?[0-9]+(\.[0-9]{{0,{decimal[1]}}})?$")
        fits = raw.rlike(NUMBER) & (fraction_digits(trimmed) <= decimal[1])
        return F.when(plain | fits, trimmed.try_cast(target))
    if declared == "Boolean":
        return F.when(raw.rlike(BOOLEAN), F.lower(trimmed) == "true")
    if declared == "Date":
        return F.when(trimmed.rlike(DATE), trimmed.try_cast("date").cast(target))
    if declared == "DateTime":
        # A text with an offset is moved to the session's zone; Z keeps its clock reading.
        clock = F.regexp_replace(trimmed, "Z$", "")
        moved = clock.try_cast("timestamp").cast(target)
        local = clock.try_cast(target)
        return F.when(
            trimmed.rlike(DATE_TIME),
            F.when(clock.rlike("[+-][0-9]{2}:[0-9]{2}$"), moved).otherwise(local),
        )
    bare = F.regexp_replace(F.lower(trimmed), "[^0-9a-f]", "")
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(trimmed.rlike(GUID), dashed)


def fraction_digits(number: Column) -> Column:
    """How many digits after the point a number's text needs to be exact; zeros at its end are
    not needed, and an exponent moves the point."""
    mantissa = F.regexp_extract(number, r"^[+-]?([0-9.]*)", 1)
    exponent = F.regexp_extract(number, r"[eE]([+-]?[0-9]+)$", 1)
    fraction = F.regexp_extract(mantissa, r"\.([0-9]*)$", 1)
    digits = F.regexp_replace(mantissa, r"\.", "")
    needed = F.rtrim(digits, F.lit("0"))
    zeros = F.length(digits) - F.length(needed)
    # An exponent beyond a long leaves null, which no comparison accepts.
    moved = F.when(exponent == "", F.lit(0).cast("long")).otherwise(exponent.try_cast("long"))
    return F.when(needed == "", F.lit(0).cast("long")).otherwise(
        F.length(fraction) - zeros - moved
    )


def parse_text(raw: Column, declared: str, decimal: tuple[int, int] = DECIMAL) -> Column:
    """``struct(value, ok)``. Null is fine; a text that does not fit has ``ok`` false."""
    value = parse(raw, declared, decimal)
    return F.struct(value.alias("value"), (raw.isNull() | value.isNotNull()).alias("ok"))
