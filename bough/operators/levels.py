"""Levels: project, filter and tie child rows to surviving parents."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from bough.errors import SetupError
from bough.names import col, fk, fks, key, keys
from bough.operators.staging import row_hash
from bough.spec import Entity


@dataclass(frozen=True)
class Level:
    """Rows of one entity: ``key:i``, ``fk:i`` and the declared fields under their output names.

    ``narrowed`` says whether a filter here or above can have removed rows, ``tied`` whether the
    rows were restricted to surviving parents, ``scanned`` whether they come from a scan without a join.
    """

    entity: Entity
    df: DataFrame
    narrowed: bool = False
    tied: bool = False
    scanned: bool = True

    @property
    def key_names(self) -> list[str]:
        return keys(len(self.entity.key_columns))

    @property
    def fk_names(self) -> list[str]:
        return fks(len(self.entity.parent_key_columns))

    def with_df(self, df: DataFrame) -> "Level":
        return replace(self, df=df)


def project(entity: Entity, table: DataFrame, condition: Column | None) -> Level:
    """Declared fields only, renamed, beside the key columns that tie levels together."""
    rows = table if condition is None else table.where(condition)
    df = rows.select(
        *[col(c).alias(key(i)) for i, c in enumerate(entity.key_columns)],
        *[col(c).alias(fk(i)) for i, c in enumerate(entity.parent_key_columns)],
        *[col(f.source).alias(f.name) for f in entity.fields],
    )
    return Level(entity, df, narrowed=condition is not None)


def check_key_types(child: Level, parent: Level) -> None:
    """A foreign key must be comparable to the parent's key without a cast of text."""
    for mine, theirs in zip(child.fk_names, parent.key_names):
        a, b = child.df.schema[mine].dataType, parent.df.schema[theirs].dataType
        numeric = isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
        timed = isinstance(a, T.DatetimeType) and isinstance(b, T.DatetimeType)
        if a != b and not numeric and not timed:
            raise SetupError(
                f"entity '{child.entity.name}': parent key is {a.simpleString()}, "
                f"the key of '{parent.entity.name}' is {b.simpleString()}"
            )


def _parent_keys(parent: Level, carried: list[str]) -> DataFrame:
    renamed = [col(k).alias(f"up:{k}") for k in parent.key_names]
    return parent.df.select(*renamed, *[col(c) for c in carried])


def _tied(child: Level, parent: Level) -> Column:
    pairs = zip(child.fk_names, parent.key_names)
    return reduce(Column.__and__, [col(mine) == col(f"up:{theirs}") for mine, theirs in pairs])


def key_order(level: Level) -> list[Column]:
    """Key order for rows whose keys nobody checked. Rows that share a key are told apart by a hash
    of the row, so that a key with a large share of the rows still spreads over many tasks."""
    return [*map(col, level.key_names), row_hash(level.df)]


def keep_surviving(child: Level, parent: Level) -> Level:
    """Child rows whose parent survived. Orphans and null foreign keys drop out.

    Where a scan finds few surviving parents, their keys become literals that reach the child's scan
    and let it skip what it need not read; otherwise the levels are joined.
    """
    listed = _listed_keys(child, parent) if parent.narrowed and parent.scanned else None
    if listed is not None:
        kept = child.df.where(col(child.fk_names[0]).isin(listed) if listed else "false")
        return replace(child, df=kept, narrowed=True, tied=True)
    kept = child.df.join(_parent_keys(parent, []), _tied(child, parent), "left_semi")
    return replace(child, df=kept, narrowed=True, tied=True, scanned=False)


#: Surviving parents whose keys are named to the child's scan.
LISTED_KEYS = 1000


def _listed_keys(child: Level, parent: Level) -> list | None:
    """The keys of the surviving parents, if they are few and one column of the foreign key's own type."""
    if len(parent.key_names) != 1 or len(child.fk_names) != 1:
        return None
    mine, theirs = child.fk_names[0], parent.key_names[0]
    kind = parent.df.schema[theirs].dataType
    # Only of these types a literal is sure to be the value itself.
    if child.df.schema[mine].dataType != kind or kind not in (T.LongType(), T.IntegerType(), T.ShortType(), T.StringType()):
        return None
    found = parent.df.select(col(theirs)).where(col(theirs).isNotNull()).limit(LISTED_KEYS + 1).collect()
    return list(dict.fromkeys(r[0] for r in found)) if len(found) <= LISTED_KEYS else None


def attach_parent(child: Level, parent: Level, carried: list[str]) -> DataFrame:
    """Child rows with columns carried down from their parent, one parent per child.

    Parent keys are unique, so a foreign key that many children share meets one row; an oversized
    partition of it is split by adaptive execution.
    """
    joined = child.df.join(_parent_keys(parent, carried), _tied(child, parent), "inner")
    return joined.drop(*[f"up:{k}" for k in parent.key_names])

