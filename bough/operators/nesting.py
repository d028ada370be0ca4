"""Levels to nested rows, bottom up.

Each level is grouped under its parent's key before it meets the parent, so parent columns are
never copied onto child rows and every level is shuffled once.

A nested row holds its whole subtree by definition. ``subtree_rows`` measures that on request, before
a plan collects anything; the document and bundle sinks hold one record at a time and have no such limit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.names import PARENT_ROW, ROW, col, fk, key
from bough.operators import checks
from bough.operators.levels import Level
from bough.spec import Entity, Export


def nest(
    export: Export,
    levels: Mapping[str, Level],
    body: Callable[[Level, DataFrame], Column] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """One row per root: its ``key:i`` columns and ``row:``.

    ``row:`` is a struct of the fields and one array per child entity, in key order. ``body`` may
    build something else from a level's fields and its gathered children (text, for instance).
    ``ordered`` puts the roots in key order.
    """
    root, body = levels[export.root.name], body or _struct_body
    df = _with_children(export.root, levels, body)
    if ordered:
        # Sorted before the body is built, which is then built once, behind the sort.
        df = df.orderBy(*map(col, root.key_names))
    return df.select(*map(col, root.key_names), body(root, df).alias("row:"))


def _struct_body(level: Level, df: DataFrame) -> Column:
    children = [col(c.name) for c in level.entity.children]
    return F.struct(*[col(f.name) for f in level.entity.fields], *children)


def _with_children(entity: Entity, levels: Mapping[str, Level], body) -> DataFrame:
    """A level with one array per child entity, empty where a row has no such children."""
    level = levels[entity.name]
    df = level.df
    for child in entity.children:
        below = levels[child.name]
        kids = _with_children(child, levels, body)
        kept = map(col, [*below.key_names, *below.fk_names])
        kids = kids.select(*kept, body(below, kids).alias("row:"))
        item = kids.schema["row:"].dataType
        if child.children or not below.tied:
            # Lists do not shrink before the shuffle, so rows move first and are listed once.
            kids = kids.repartition(*map(col, below.fk_names))
        # Keys are unique, so the sort never looks past them; nulls come first.
        listed = F.sort_array(F.collect_list(F.struct(*map(col, below.key_names), F.col("row:"))))
        grouped = kids.groupBy(*map(col, below.fk_names)).agg(
            F.transform(listed, lambda pair: pair["row:"]).alias(child.name)
        )
        renamed = grouped.select(
            *[col(f).alias(f"down:{f}") for f in below.fk_names], col(child.name)
        )
        pairs = zip(level.key_names, below.fk_names)
        condition = [col(mine) == col(f"down:{theirs}") for mine, theirs in pairs]
        empty = F.array().cast(T.ArrayType(item))
        df = (
            df.join(renamed, condition, "left")
            .drop(*[f"down:{f}" for f in below.fk_names])
            .withColumn(child.name, F.coalesce(col(child.name), empty))
        )
    return df


def unpack(nested: DataFrame) -> DataFrame:
    """Field columns and child arrays of the roots; keys stay behind."""
    return nested.select("row:.*")


def subtree_rows(export: Export, levels: Mapping[str, Level]) -> DataFrame:
    """``rows``: how many rows the subtree of each root has, itself included.

    Only keys move, and every sum is combined before its shuffle.
    """

    def sizes(entity: Entity) -> DataFrame:
        level = levels[entity.name]
        df = level.df.select(*map(col, [*level.key_names, *level.fk_names])).withColumn(
            "rows", F.lit(1).cast("long")
        )
        for child in entity.children:
            below = levels[child.name]
            sums = sizes(child).groupBy(*map(col, below.fk_names)).agg(F.sum("rows").alias("more:"))
            named = sums.select(
                *[col(f).alias(f"down:{f}") for f in below.fk_names], F.col("more:")
            )
            pairs = zip(level.key_names, below.fk_names)
            condition = [col(mine) == col(f"down:{theirs}") for mine, theirs in pairs]
            df = df.join(named, condition, "left").select(
                *map(col, [*level.key_names, *level.fk_names]),
                (F.col("rows") + F.coalesce(F.col("more:"), F.lit(0))).alias("rows"),
            )
        return df

    return sizes(export.root)


def oversized_notes(export: Export, levels: Mapping[str, Level], most: int) -> DataFrame:
    """The largest subtree if it has more than ``most`` rows, in the shape of key violations."""
    largest = subtree_rows(export, levels).agg(F.max("rows").alias("rows"))
    return largest.where(F.col("rows") > most).select(
        F.lit(export.root.name).alias("entity"), F.lit(None).cast("string").alias("key"), "rows"
    )


def numbered_levels(export: Export, tables: Mapping[str, DataFrame]) -> dict[str, Level]:
    """Levels from ``(RowNumber, ParentRowNumber, fields...)`` tables; numbers act as the keys."""
    levels = {}
    for entity in export.entities():
        up = [] if entity is export.root else [col(PARENT_ROW).alias(fk(0))]
        by_number = Entity(
            name=entity.name,
            table=entity.table,
            key=ROW,
            parent_key=None if entity is export.root else PARENT_ROW,
            fields=entity.fields,
            children=entity.children,
        )
        df = tables[entity.name].select(
            col(ROW).alias(key(0)), *up, *[col(f.name) for f in entity.fields]
        )
        levels[entity.name] = Level(by_number, df)
    return levels


def rebuild(export: Export, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Nested rows from numbered levels, in root order. A number that two rows of a level have is
    an error. A root's subtree must fit a task, as in any nested row."""
    levels = numbered_levels(export, tables)
    checks.require_none(
        [checks.violation_notes(v.df, v.key_names, name) for name, v in levels.items()]
    )
    return unpack(nest(export, levels, ordered=True))


def write_nested(export: Export, nested: DataFrame, path: str) -> dict[str, int]:
    """Write nested rows as Parquet; the rows of every entity are counted in the tasks that write."""
    seen = Observation()
    counts = [F.coalesce(n, F.lit(0)).alias(name) for name, n in _sizes(export.root)]
    nested.observe(seen, *counts).write.parquet(path)
    return dict(seen.get)


def _sizes(root: Entity) -> list[tuple[str, Column]]:
    """Per entity an aggregate over nested root rows that counts its rows."""

    def held(rows: Column, path: tuple[str, ...]) -> Column:
        """How many rows lie at the end of a path of lists below an array of rows."""
        if not path:
            return F.size(rows).cast("long")
        each = F.transform(rows, lambda row: held(row[path[0]], path[1:]))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    found = [(root.name, F.count(F.lit(1)))]

    def walk(entity: Entity, path: tuple[str, ...]) -> None:
        for child in entity.children:
            below = (*path, child.name)
            found.append((child.name, F.sum(held(col(below[0]), below[1:]))))
            walk(child, below)

    walk(root, ())
    return found
