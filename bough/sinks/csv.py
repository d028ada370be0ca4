"""Flat CSV, and the bundle of one CSV folder per entity.

Lines are rendered here rather than by the CSV writer, whose quoting rules differ, and end in
CR LF. The header is one more line that sorts first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.functions.render import csv_line, field_text, text
from bough.names import PARENT_ROW, ROW, code, col
from bough.operators.levels import Level
from bough.operators.ranges import TIE, ordered, row_bytes
from bough.operators.staging import row_hash, small_rows
from bough.sinks.writing import ENTITY, write_lines
from bough.spec import Entity, Export

# The key columns of a bundle and the line end.
KEY = "_key"
PARENT_KEY = "_parentKey"
LINE_END = "\r\n"
STEP = "step:"
#: About how many bytes a bundle file holds. A file is one task's work, written or read back.
FILE_BYTES = 16 << 20


def field_texts(entity: Entity, schema: T.StructType) -> list[Column]:
    """Output texts in declared order; codes found by lookups are already columns."""
    have = set(schema.names)
    return [
        field_text(schema, f.name, f.type, code(f.name) if code(f.name) in have else None)
        for f in entity.fields
    ]


def header(entity: Entity, bundled: bool) -> str:
    names = [f.name for f in entity.fields]
    if bundled:
        names = [KEY, *([PARENT_KEY] if entity.parent_key_columns else []), *names]
    return ",".join(names)


def flat_lines(level: Level) -> DataFrame:
    """``text`` of every row beside the level's key columns."""
    line = csv_line(field_texts(level.entity, level.df.schema))
    return level.df.select(*map(col, level.key_names), line.alias("text"))


def bundle_line(entity: Entity, schema: T.StructType, is_root: bool) -> Column:
    """A record with its keys in front. A root that names a parent key has that column, empty."""
    parents = []
    if entity.parent_key_columns:
        parents = [F.lit("") if is_root else text(col(PARENT_ROW), T.LongType())]
    return csv_line([text(col(ROW), T.LongType()), *parents, *field_texts(entity, schema)])


def bundle_lines(entity: Entity, numbered: DataFrame, is_root: bool) -> DataFrame:
    """``(RowNumber, text)`` for a numbered level."""
    line = bundle_line(entity, numbered.schema, is_root)
    return numbered.select(ROW, line.alias("text"))


def write_flat(level: Level, path: str) -> dict[str, int]:
    """One file's worth of ordered parts.

    Rows move once, to parts of bounded size, and become text in the tasks that write.
    """
    entity, df = level.entity, level.df
    line = csv_line(field_texts(entity, df.schema))
    size = F.octet_length(line) + len(LINE_END)
    told = below_header(df.withColumn(TIE, row_hash(df)))
    arranged = ordered(told, [STEP, *level.key_names, TIE], size, df.count() * (row_bytes(df, size) + 1))
    return write_lines(_as_lines(arranged, entity, line, False), path, [entity.name], LINE_END)


def write_bundle(export: Export, numbered: Mapping[str, DataFrame], path: str) -> dict[str, int]:
    """``path/{Entity}.csv/`` for every entity, a header even where there are no rows.

    ``numbered`` levels are in the order of their numbers, with the row of :func:`below_header` in front; a
    task writes what it holds of them.
    """
    counts: dict[str, int] = {}
    for entity in export.entities():
        df = numbered[entity.name]
        line = bundle_line(entity, df.schema, entity is export.root)
        folder = f"{path.rstrip('/')}/{entity.name}.csv"
        counts |= write_lines(_as_lines(df, entity, line, True), folder, [entity.name], LINE_END)
    return counts


def below_header(df: DataFrame) -> DataFrame:
    """Rows and, in front of them, one empty row that will become the header."""
    head = small_rows(df.sparkSession, [(0,)], f"`{STEP}` int")
    return df.withColumn(STEP, F.lit(1)).unionByName(head, allowMissingColumns=True)


def _as_lines(rows: DataFrame, entity: Entity, line: Column, bundled: bool) -> DataFrame:
    is_head = col(STEP) == 0
    return rows.select(
        F.when(~is_head, F.lit(entity.name)).alias(ENTITY),
        F.when(is_head, F.lit(header(entity, bundled))).otherwise(line).alias("text"),
    )
