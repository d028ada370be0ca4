"""Values to text. Every function maps Columns to Columns, so rendering stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.names import quoted

# Fraction digits of a date-time, the pattern of an offset, and the shortest digit
# count at which floating-point text switches to the exponent form.
FRACTION_DIGITS = 7
OFFSET = "XXX"
DOUBLE_DIGITS = 15
FLOAT_DIGITS = 7
# Everything XML 1.0 cannot hold, as a Java pattern.
ILLEGAL_XML = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
REPLACEMENT = chr(0xFFFD)

_WHOLE = (T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_STAMPS = (T.TimestampType, T.TimestampNTZType)


def text(value: Column, dtype: T.DataType, declared: str = "String") -> Column:
    """Invariant text of a value; null stays null. ``declared`` only matters for dates."""
    if isinstance(dtype, (T.DateType, *_STAMPS)):
        return _day(value) if declared == "Date" else _date_time(value, dtype, trimmed=False)
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    if isinstance(dtype, T.DecimalType):
        return _decimal_text(value, dtype)
    if isinstance(dtype, _FLOATING):
        digits = DOUBLE_DIGITS if isinstance(dtype, T.DoubleType) else FLOAT_DIGITS
        return _floating_text(value, digits)
    return value.cast("string")


def _day(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, 10)


def _date_time(value: Column, dtype: T.DataType, trimmed: bool) -> Column:
    """ISO text with seven fraction digits, or with as many as are not zero.

    Taken from the plain text of the value: formatting would pass a value without a zone through
    the session's zone and move it where that zone skips an hour.
    """
    plain = value.cast("string")
    clock = F.replace(F.substring(plain, 1, 19), F.lit(" "), F.lit("T"))
    if isinstance(dtype, T.DateType):
        clock, fraction = F.concat(plain, F.lit("T00:00:00")), F.lit("")
    else:
        fraction = F.substring(plain, 21, 6)
    if trimmed:
        digits = F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction))
    else:
        digits = F.concat(F.lit("."), F.rpad(fraction, FRACTION_DIGITS, "0"))
    zone = [F.date_format(value, OFFSET)] if isinstance(dtype, T.TimestampType) else []
    return F.concat(clock, digits, *zone)


def _decimal_text(value: Column, dtype: T.DecimalType) -> Column:
    """Digits with the declared scale, also where the session prints tiny values as 1E-9."""
    plain = value.cast("string")
    if dtype.scale <= 6:
        return plain
    digits = F.regexp_replace(F.substring_index(plain, "E", 1), "[-.]", "")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    spelled = F.concat(sign, F.lit("0."), F.lpad(digits, dtype.scale, "0"))
    return F.when(plain.contains("E"), spelled).otherwise(plain)


def _floating_text(value: Column, limit: int) -> Column:
    """Shortest digits that read back: ``42``, ``0.5``, ``1E+16``, ``1.5E-07``.

    Spark's own text has an exponent outside 0.001 to 10 million; much of that range is spelled out
    here. The few branches keep the generated code small enough to be compiled.
    """
    plain = value.cast("string")
    exponent = F.substring_index(plain, "E", -1).try_cast("int")
    digits = F.length(F.ltrim(F.substring_index(plain, "E", 1), F.lit("-"))) - 1
    spelled_out = (exponent == -4) | ((exponent > 0) & (exponent < F.greatest(digits, F.lit(limit))))
    # 17 digits before the point and 21 after it hold every such value exactly.
    spelled = F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), r"\.?0+$", "")
    signed = F.regexp_replace(F.replace(plain, F.lit(".0E"), F.lit("E")), "E([0-9])", "E+$1")
    padded = F.regexp_replace(signed, "([+-])([0-9])$", "$10$2")
    return (
        F.when(~plain.contains("E"), F.regexp_replace(plain, r"\.0$", ""))
        .when(spelled_out, spelled)
        .otherwise(padded)
    )


def csv_field(value: Column) -> Column:
    """Quote only around a comma, quote or line break; null and empty both come out empty."""
    doubled = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\r\n]'), doubled).otherwise(F.coalesce(value, F.lit("")))


def csv_line(values: list[Column]) -> Column:
    """One record of already rendered texts."""
    return F.concat_ws(",", *[csv_field(v) for v in values])


def xml_clean(value: Column) -> Column:
    """Code points XML 1.0 cannot hold become U+FFFD; tab, line feed and return stay."""
    return F.regexp_replace(value, ILLEGAL_XML, REPLACEMENT)


def xml_element(name: str, value: Column) -> Column:
    """``<name>text</name>``; empty text closes itself and null is marked ``nil``."""
    safe = xml_clean(value)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(char), F.lit(entity))
    return (
        F.when(value.isNull(), F.lit(f'<{name} nil="true" />'))
        .when(value == "", F.lit(f"<{name} />"))
        .otherwise(F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name}>")))
    )


def json_string(value: Column) -> Column:
    """A quoted and escaped JSON string; null becomes ``null``."""
    # The array's brackets stand outside the quotes, so trimming them stops there.
    return F.when(value.isNull(), "null").otherwise(F.btrim(F.to_json(F.array(value)), F.lit("[]")))


def _json_stringy(value: Column, dtype: T.DataType, declared: str) -> Column | None:
    """The Spark value that ``to_json`` prints exactly, or None where it would not."""
    if isinstance(dtype, (T.DateType, *_STAMPS)):
        return _day(value) if declared == "Date" else _date_time(value, dtype, trimmed=True)
    if isinstance(dtype, (T.BooleanType, *_WHOLE)):
        return value
    if isinstance(dtype, (T.DecimalType, *_FLOATING)):
        return None
    return text(value, dtype, declared)


def json_value(
    value: Column, dtype: T.DataType, declared: str = "String", label: str = "value"
) -> Column:
    """One JSON value: numbers and booleans bare, everything else a string, null spelled out.

    JSON has no number that is not finite: one fails the run, whose message names the field.
    """
    if isinstance(dtype, (T.BooleanType, T.DecimalType, *_WHOLE, *_FLOATING)):
        written = F.coalesce(text(value, dtype, declared), F.lit("null"))
        if isinstance(dtype, _FLOATING):
            finite = value.isNull() | (~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
            wrong = F.concat(F.lit(f"{label}: JSON has no number "), written)
            return F.when(finite, written).otherwise(F.raise_error(wrong))
        return written
    return json_string(_json_stringy(value, dtype, declared))


def json_members(
    fields: list[tuple[str, Column, T.DataType, str, Column | None]], owner: str = "row"
) -> Column:
    """``"a":1,"b":"x"`` for (name, value, type, declared type, code found by a lookup).

    Neighbours that ``to_json`` prints exactly share one call. A found code is text while a
    missed one keeps the type of its raw value, so that choice is made per row.
    """
    pieces: list[Column] = []
    run: list[Column] = []

    def close_run() -> None:
        if run:
            whole = F.to_json(F.struct(*run), {"ignoreNullFields": "false"})
            # The last scalar never ends in a brace, so trimming takes the outer ones only.
            pieces.append(F.btrim(whole, F.lit("{}")))
            run.clear()

    for name, value, dtype, declared, found in fields:
        direct = _json_stringy(value, dtype, declared)
        if found is not None and not isinstance(dtype, T.StringType):
            direct = None
        elif found is not None:
            direct = F.coalesce(found, value)
        if direct is not None:
            run.append(direct.alias(name))
            continue
        close_run()
        raw = json_value(value, dtype, declared, f"entity '{owner}', field '{name}'")
        if found is not None:
            raw = F.when(found.isNotNull(), json_string(found)).otherwise(raw)
        pieces.append(F.concat(F.lit(f'"{name}":'), raw))
    close_run()
    return F.concat_ws(",", *pieces)


def field_text(df_schema: T.StructType, name: str, declared: str, code_name: str | None) -> Column:
    """Output text of a level column, with the code a lookup found taking its place."""
    value = text(F.col(quoted(name)), df_schema[name].dataType, declared)
    return F.coalesce(F.col(quoted(code_name)), value) if code_name else value
