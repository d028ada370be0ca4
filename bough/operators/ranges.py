"""Cutting an ordered set of rows into ranges before any of them moves.

Bounds come from a sample of the columns that order the rows, and every row's range follows from its own
values: an expression, the same in every pass. So ranges can be counted or weighed from narrow columns
first, and the rows themselves move once, to the task that their range names, and are sorted there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bough.names import ROW, col
from bough.operators.staging import row_hash

#: About how many bytes of rows a range and a part of a document hold, and how many there are at most; beyond
#: that they grow. A bound is a literal in the plan, found by halving.
RANGE_BYTES = 16 << 20
PART_BYTES = 4 << 20
MOST_RANGES = 4096
#: Sampled rows for each range. The sample is what bounds cost the driver.
SAMPLED = 32
#: Of the sample.
SEED = 60_493
#: A range of one key that holds this many times its share is cut again, by row.
UNEVEN = 4
#: Rows that are looked at for the size of one.
MEASURED_ROWS = 1000

PART = "part:"
TIE = "tie:"


def ranges_for(rows: int, row_bytes: float, range_bytes: int | None = None) -> int:
    """How many ranges rows of this size make."""
    wanted = math.ceil(rows * row_bytes / (range_bytes or RANGE_BYTES))
    return min(max(1, wanted), MOST_RANGES)


def row_bytes(df: DataFrame, size: Column | None = None) -> float:
    """The mean size of the first rows that a few tasks come up with."""
    size = F.octet_length(F.to_csv(F.struct(*[text_of(df, c) for c in df.columns]))) if size is None else size
    first = df.select(size.alias("size:")).limit(MEASURED_ROWS)
    return first.agg(F.avg("size:")).first()[0] or 1.0


def text_of(df: DataFrame, name: str) -> Column:
    return col(name).cast("string")


@dataclass(frozen=True)
class Ranges:
    """A row is in the range whose number is how many bounds are not above it.

    ``bounds`` are values of the ``order`` columns, whose types ``types`` names; nulls come first.
    """

    order: tuple[str, ...]
    types: tuple
    bounds: tuple[tuple, ...] = ()

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    @cached_property
    def of_row(self) -> Column:
        """The number of a row's range, by halving."""
        place = F.struct(*[col(c) for c in self.order])

        def within(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(place < self._literal(middle), within(low, middle)).otherwise(within(middle + 1, high))

        return within(0, len(self.bounds))

    def _literal(self, i: int) -> Column:
        values = zip(self.order, self.bounds[i], self.types)
        return F.struct(*[F.lit(v).cast(t).alias(name) for name, v, t in values])

    def spread(self, df: DataFrame, *within: Column) -> DataFrame:
        """``df``, moved once: a task for each range, in order, with :data:`PART`. ``within`` orders the rows of a range,
        by default the columns that order the ranges."""
        placed = df.withColumn(PART, self.of_row).repartitionById(self.count, col(PART))
        return placed.sortWithinPartitions(*(within or map(col, self.order)))


def cut(
    df: DataFrame, order: Sequence[str], ranges: int, held: int, weight: str | None = None, range_bytes: int = 0
) -> Ranges:
    """Ranges of about equal numbers of rows, or of equal sums of the column ``weight``.

    ``held`` says how much that is in all, about, and ``ranges`` how many to make; with ``range_bytes`` as many of
    these as the sample shows a need for. A row is sampled with a probability that goes with its weight. Every task
    samples what it reads; only the sampled values are gathered, in one task that sorts them for the driver.
    """
    types = tuple(df.schema[c].dataType for c in order)
    if ranges <= 1 or not held:
        return Ranges(tuple(order), types)
    share = SAMPLED * ranges / held
    heavy = F.lit(1.0) if weight is None else col(weight)
    picked = df.where(F.rand(SEED) < heavy * share)
    # A row that is surely picked counts for what it has, any other for what a pick stands for.
    columns = [*map(col, order), F.greatest(heavy, F.lit(1 / share)).alias("stands:")]
    sample = picked.select(*columns).repartition(1).sortWithinPartitions(*map(col, order)).collect()
    total, seen, bounds = sum(r[-1] for r in sample), 0, []
    if range_bytes:
        ranges = ranges_for(1, total, range_bytes)
    for r in sample:
        # A bound stands where the share of the range before it is reached.
        if seen * ranges >= total * (len(bounds) + 1) and len(bounds) < ranges - 1:
            if not bounds or tuple(r[:-1]) != bounds[-1]:
                bounds.append(tuple(r[:-1]))
        seen += r[-1]
    return Ranges(tuple(order), types, tuple(dict.fromkeys(bounds)))


@dataclass(frozen=True)
class DenseOrder:
    """Ranges whose rows have been counted, which is all that dense numbers take."""

    ranges: Ranges
    counts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.counts)

    @classmethod
    def measured(
        cls, df: DataFrame, order: Sequence[str], size: float, unique: bool = False, range_bytes: int | None = None
    ) -> "DenseOrder":
        """From the columns in ``order`` alone; ``size`` is the bytes of a row without its number. Only where one of their values has far more rows than a range should
        hold are rows read whole, to tell those apart by a hash (not if they are ``unique``)."""
        keys = df.select(*map(col, order))
        rows = keys.count()
        wanted = ranges_for(rows, size + len(f"{rows},"), range_bytes)
        if wanted == 1:
            return cls(cut(keys, order, 1, rows), (rows,))
        found = cls._counted(keys, cut(keys, order, wanted, rows))
        if not unique and max(found.counts) > UNEVEN * rows / wanted:
            told = df.select(*map(col, order), row_hash(df).alias(TIE))
            found = cls._counted(told, cut(told, [*order, TIE], wanted, rows))
        return found

    @classmethod
    def _counted(cls, keys: DataFrame, ranges: Ranges) -> "DenseOrder":
        counted = keys.groupBy(ranges.of_row.alias(PART)).agg(F.count(F.lit(1)).alias("rows:"))
        held = {r[0]: r[1] for r in counted.collect()}
        return cls(ranges, tuple(held.get(i, 0) for i in range(ranges.count)))

    def number(self, df: DataFrame, order: Sequence[str], name: str = ROW, head: Column | None = None) -> DataFrame:
        """``df`` with ``name``, which counts its rows in the order of ``order``; one task for each range, in
        order, so written parts follow each other.

        Rows that tie are ordered by a hash of the row. Rows for which ``head`` holds come first and have
        no number. That the rows are those that were counted is checked as they are numbered.
        """
        told = df.withColumn(TIE, row_hash(df))
        lead = [] if head is None else [(~head).alias("follows:")]
        within = [*lead, *map(col, order), col(TIE)]
        placed = told.withColumn(PART, self.ranges.of_row if head is None else F.when(head, 0).otherwise(self.ranges.of_row))
        moved = placed.repartitionById(self.ranges.count, col(PART))
        spec = Window.partitionBy(col(PART)).orderBy(*within)
        if head is not None:
            moved = moved.withColumn("counts:", (~head).cast("int"))
            place = F.sum("counts:").over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            place = F.row_number().over(spec)
        before = [sum(self.counts[:i]) for i in range(self.ranges.count)]
        at = col(PART) + 1
        offset = F.element_at(F.lit(before).cast("array<bigint>"), at)
        held = F.element_at(F.lit(list(self.counts)).cast("array<bigint>"), at)
        number = F.when(col("place:") <= held, offset + col("place:")).otherwise(
            F.raise_error(F.lit("rows changed between counting and numbering them"))
        )
        if head is not None:
            number = F.when(~head, number)
        return moved.withColumn("place:", place).select(number.cast("long").alias(name), *map(col, df.columns))


def ordered(df: DataFrame, order: Sequence[str], weight: Column, heaviest: float) -> DataFrame:
    """``df`` in the order of ``order``, in parts of about :data:`PART_BYTES` of ``weight``.

    ``heaviest`` is no less than all weights together, about. Only ordering columns and what weighs a row are read to
    find the bounds; then rows move once, as they are. How many parts there are depends on the rows alone.
    """
    most = ranges_for(1, heaviest, PART_BYTES)
    narrow = df.select(*map(col, order), weight.cast("double").alias("weight:"))
    return cut(narrow, order, most, max(1, round(heaviest)), "weight:", PART_BYTES).spread(df).drop(PART)


__all__ = ["DenseOrder", "Ranges", "cut", "ordered", "ranges_for", "row_bytes"]
