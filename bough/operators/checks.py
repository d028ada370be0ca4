"""Data-side checks and counts."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from bough.errors import DuplicateKeys, SubtreeTooLarge
from bough.names import col
from bough.operators.levels import Level
from bough.spec import Entity, Export


#: About how many rows a task holds the keys of while it looks for repeated ones.
CHECKED_ROWS = 250_000


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with ``rows`` saying how many.

    Rows are counted first, then their keys move to as many tasks as that takes, uncombined: keys hardly
    repeat, so to combine them first would hold every key that a task reads. Rows that do share a key are equal
    in all that moves.
    """
    own = [col(k) for k in keys]
    held = df.select(*own)
    return (
        held.repartition(max(1, math.ceil(held.count() / CHECKED_ROWS)), *own)
        .groupBy(*own)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def violation_notes(df: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Violations of any entity in one shape: ``(entity, key, rows)``, the key as text."""
    return key_violations(df, keys).select(
        F.lit(entity).alias("entity"),
        F.concat_ws(", ", *[col(k).cast("string") for k in keys]).alias("key"),
        "rows",
    )


def require_none(notes: list[DataFrame]) -> None:
    """Raise for any of the noted violations. All are looked for in one job that returns one row.

    A note without a key is about the size of a subtree.
    """
    example = first_note(notes)
    if example is None:
        return
    if example.key is None:
        raise SubtreeTooLarge(
            f"a nested row of '{example.entity}' would hold {example.rows} rows; write a json or "
            "xml document or a csv bundle instead, or raise the limit"
        )
    raise DuplicateKeys(
        f"entity '{example.entity}': {example.rows} rows share the key ({example.key})"
    )


def first_note(notes: list[DataFrame]) -> Row | None:
    """One of the violations, or None; one job looks for all and returns one row."""
    if not notes:
        return None
    one = F.first(F.struct("entity", "key", "rows"), ignorenulls=True)
    return reduce(DataFrame.union, notes).agg(one.alias("note")).first().note


def row_counts(levels: dict[str, DataFrame]) -> DataFrame:
    """``(entity, rows)`` for every level, levels without rows included."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("entity"), "rows")
        for name, df in levels.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def tree_counts(export: Export, levels: Mapping[str, Level]) -> DataFrame:
    """``(entity, rows)``: how many rows of every level have all their ancestors.

    From the leaves up, rows meet their parent's key in one grouping over both: a parent adds that it is
    there, children add how many they are and how many hang below them. Only keys and counts move, combined in
    the tasks before they do, so a parent that many share is one row a task. What meets no parent goes.
    Rows of an inner level that share a key but not a parent are an error.
    """

    def subtree(entity: Entity) -> list[str]:
        return [entity.name, *(n for child in entity.children for n in subtree(child))]

    def counts(names: list[str], have: list[str], one: str | None = None) -> list[Column]:
        """``n:`` columns for ``names``: those that rows have, 1 for ``one``, else 0."""
        held = [col(f"n:{n}") if n in have else F.lit(int(n == one)).cast("long") for n in names]
        return [c.alias(f"n:{n}") for c, n in zip(held, names)]

    def below(entity: Entity) -> DataFrame:
        """``fk:i`` and counts, more than one row a parent, of a level and what is below it."""
        level = levels[entity.name]
        fks, own = [*map(col, level.fk_names)], [*map(col, level.key_names)]
        names = subtree(entity)
        alone = level.df.select(*fks, *counts(names, [], entity.name))
        if not entity.children:
            return alone
        keyed = reduce(Column.__and__, [k.isNotNull() for k in own])
        # A row without a key has no children.
        unkeyed = level.df.where(~keyed).select(*fks, *counts(names, [], entity.name))
        here = counts(names, [], entity.name)
        parts = [level.df.where(keyed).select(*own, *fks, *here, F.lit(1).alias("here:"))]
        for child in entity.children:
            theirs = levels[child.name].fk_names
            rows = below(child).where(reduce(Column.__and__, [col(c).isNotNull() for c in theirs]))
            renamed = [col(c).alias(k) for c, k in zip(theirs, level.key_names)]
            nowhere = [F.lit(None).cast(level.df.schema[c].dataType).alias(c) for c in level.fk_names]
            hung = counts(names, subtree(child))
            parts.append(rows.select(*renamed, *nowhere, *hung, F.lit(0).alias("here:")))
        met = reduce(DataFrame.unionByName, parts).groupBy(*own).agg(
            F.sum("here:").alias("here:"),
            *[F.min(c).alias(f"least:{c}") for c in level.fk_names],
            *[F.max(c).alias(c) for c in level.fk_names],
            *[F.sum(col(f"n:{n}")).alias(f"n:{n}") for n in names],
        )
        alike = [
            F.when(col(c).eqNullSafe(col(f"least:{c}")), col(c)).otherwise(
                F.raise_error(F.lit(f"entity '{entity.name}': rows that share a key have different parents"))
            ).alias(c)
            for c in level.fk_names
        ]
        return met.where("`here:` > 0").select(*alike, *[col(f"n:{n}") for n in names]).unionByName(unkeyed)

    names = [e.name for e in export.entities()]
    totals = below(export.root).agg(*[F.coalesce(F.sum(col(f"n:{n}")), F.lit(0)).alias(f"n:{n}") for n in names])
    each = [F.struct(F.lit(n).alias("entity"), col(f"n:{n}").alias("rows")) for n in names]
    return totals.select(F.inline(F.array(*each)))
