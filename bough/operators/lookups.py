"""Stored values to readable codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.functions.render import text
from bough.names import code, col
from bough.operators.levels import Level
from bough.operators.staging import stage
from bough.sources.codes import FunctionLookup

# A list is broadcast only when it is measured to be at most this big. A larger one is joined by
# shuffle, where adaptive execution splits the partition of a value that many rows share.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def sized_broadcast(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a broadcast hint if its measured size allows one.

    A larger list is written first: a join against a plain table can split the partition of a hot
    value, one against the output of an aggregate cannot.
    """
    size = pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("id") + F.octet_length("code")).alias("bytes"),
    ).first()
    small = size.rows <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES
    return F.broadcast(pairs) if small else stage(pairs, "codes")


class CodeJoins:
    """The lookups of one run. Each list is measured once, however many fields use it."""

    def __init__(self, lookups: Mapping[str, object]):
        self.lookups = lookups
        self._sized: dict[str, DataFrame] = {}

    def _pairs(self, name: str, values: DataFrame) -> DataFrame:
        lookup = self.lookups[name]
        if isinstance(lookup, FunctionLookup):
            # Python runs once per distinct value; the result is written so that measuring it and
            # joining it do not run it again.
            distinct = values.where(F.col("id").isNotNull()).distinct()
            return sized_broadcast(stage(lookup.pairs_for(distinct), "codes"))
        if name not in self._sized:
            self._sized[name] = sized_broadcast(lookup.by_id())
        return self._sized[name]

    def apply(self, level: Level) -> Level:
        """Adds ``code:field`` for every looked-up field: the code, or null on a miss or a null."""
        df = level.df
        for field in level.entity.fields:
            if not field.lookup:
                continue
            raw = text(col(field.name), df.schema[field.name].dataType, field.type)
            pairs = self._pairs(field.lookup.lower(), df.select(raw.alias("id")))
            named = pairs.select(F.col("id").alias("code:id"), F.col("code").alias(code(field.name)))
            df = df.join(named, raw == F.col("code:id"), "left").drop("code:id")
        return level.with_df(df)


def settle(level: Level) -> Level:
    """Looked-up fields become their code, or the text of the raw value where there is none."""
    df = level.df
    for field in level.entity.fields:
        if field.lookup:
            raw = text(col(field.name), df.schema[field.name].dataType, field.type)
            found = code(field.name)
            df = df.withColumn(field.name, F.coalesce(col(found), raw)).drop(found)
    return level.with_df(df)
