"""Dense row numbers 1..N over a whole DataFrame without moving it through one task.

A window without a partition would put every row into a single task. Here ranges are cut and counted
from the ordering columns alone (:mod:`bough.operators.ranges`); then the rows move once, to their
range, and a row's number is what earlier ranges hold plus its place in its own. Nothing is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from bough.names import ROW
from bough.operators.ranges import DenseOrder, row_bytes


def dense_number(df: DataFrame, order: list[str], name: str = ROW, size: float | None = None) -> DataFrame:
    """``df`` with a long column ``name`` in front that counts rows in the order of ``order``.

    Rows that tie on ``order`` are told apart by a hash of the whole row, so that one value
    holding a large share of the rows still spreads over many tasks. The table is read more than once and
    must not change meanwhile. ``size`` is about how many bytes a row has; it is measured if not given.
    """
    measured = DenseOrder.measured(df, order, row_bytes(df) if size is None else size)
    return measured.number(df, order, name)
