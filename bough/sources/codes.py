"""Reference lists: ids that are stored, codes that people read.

One list serves both directions. Rendering output matches the id text exactly; reading a filter
value ignores the case of the code.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.errors import UnknownCode
from bough.functions.render import text
from bough.names import col
from bough.operators.staging import small_rows, stage

# The usual column names of a code table and its code type table.
ID_COLUMN = "TblCodeID"
CODE_COLUMN = "Code"
TYPE_ID_COLUMN = "TblCodeTypeID"
TYPE_NAME_COLUMN = "CodeType"


def code_list(
    codes: DataFrame,
    types: DataFrame,
    code_type: str,
    *,
    id_column: str = ID_COLUMN,
    code_column: str = CODE_COLUMN,
    type_id_column: str = TYPE_ID_COLUMN,
    type_name_column: str = TYPE_NAME_COLUMN,
    types_id_column: str | None = None,
) -> DataFrame:
    """``(id, code)`` of one code type.

    ``types_id_column`` is the type id's name in the type table where it differs.
    """
    wanted = types.where(col(type_name_column) == F.lit(code_type)).select(
        col(types_id_column or type_id_column).alias("type:id")
    )
    return (
        codes.join(wanted, col(type_id_column) == F.col("type:id"), "left_semi")
        .select(
            text(col(id_column), codes.schema[id_column].dataType).alias("id"),
            col(code_column).cast("string").alias("code"),
        )
    )


class CodeList:
    """A lookup over an ``(id, code)`` DataFrame, used for output and for filter values."""

    def __init__(self, pairs: DataFrame, label: str = "code list"):
        self.label = label
        self.pairs = pairs.select(
            text(col("id"), pairs.schema["id"].dataType).alias("id"),
            col("code").cast("string").alias("code"),
        )

    def by_id(self) -> DataFrame:
        """One row per id. Where a list repeats an id, its greatest code is taken."""
        return self.pairs.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("code").alias("code"))

    def ids_of(self, values: list[str]) -> dict[str, str]:
        """Stored id of each supplied text; one small row per value comes back.

        Where a list repeats a code, the greatest id is taken: numerically for whole numbers.
        """
        spark = self.pairs.sparkSession
        wanted = small_rows(spark, [(v,) for v in dict.fromkeys(values)], "value string")
        found = self._found(wanted, F.broadcast)
        ids = {row.value: row.id for row in found.where("id is not null").collect()}
        for value in values:
            if value not in ids:
                raise UnknownCode(f"'{value}' is not in {self.label}")
        return ids

    def ids_table(self, values: DataFrame) -> DataFrame:
        """The same for the texts in the only column of a table, as a table of ids."""
        (name,) = values.columns
        wanted = values.select(col(name).cast("string").alias("value")).where("value is not null").distinct()
        found = stage(self._found(wanted), "filter-codes")
        unknown = found.where("id is null").first()
        if unknown is not None:
            raise UnknownCode(f"'{unknown.value}' is not in {self.label}")
        return found.select("id")

    def _found(self, wanted: DataFrame, hint=lambda df: df) -> DataFrame:
        """``(value, id)``, the id null where no code has the text. Both sides fold case alike."""
        wanted = wanted.withColumn("folded", F.lower("value"))
        folded = self.pairs.select("id", F.lower("code").alias("folded"))
        rank = F.struct(F.col("id").try_cast("long"), F.col("id"))
        best = (
            folded.join(hint(wanted.select("folded").distinct()), "folded", "left_semi")
            .groupBy("folded")
            .agg(F.max_by("id", rank).alias("id"))
        )
        return wanted.join(best, "folded", "left").select("value", "id")


class FunctionLookup:
    """A lookup written in Python.

    ``render`` turns a pandas Series of id texts into a Series of codes, with None for "leave the
    value as it is". It sees each distinct value once, on the executors. ``request`` turns one
    supplied filter text into the stored text, or raises ``UnknownCode``.
    """

    def __init__(
        self,
        render: Callable | None = None,
        request: Callable[[str], str] | None = None,
        label: str = "lookup",
    ):
        self.render = render
        self.request = request
        self.label = label

    def pairs_for(self, distinct: DataFrame) -> DataFrame:
        """``(id, code)`` for a DataFrame of distinct ``id`` texts."""
        render = self.render

        # A local function travels by value, so workers need only what ``render`` needs.
        @F.pandas_udf("string")
        def codes(ids: pd.Series) -> pd.Series:
            return render(ids)

        return distinct.select("id", codes("id").alias("code"))

    def ids_of(self, values: list[str]) -> dict[str, str]:
        return {value: self.request(value) for value in dict.fromkeys(values)}

    def ids_table(self, values: DataFrame) -> DataFrame:
        """The stored texts of a table of values; ``request`` runs on the executors."""
        (name,) = values.columns
        request = self.request

        @F.pandas_udf("string")
        def stored(texts: pd.Series) -> pd.Series:
            return texts.map(request)

        wanted = values.select(col(name).cast("string").alias("value")).where("value is not null")
        return wanted.distinct().select(stored("value").alias("id"))
