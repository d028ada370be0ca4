"""Level scans: an entity's table name to a DataFrame.

A *reader* is any callable ``(schema, table) -> DataFrame``. Everything stays lazy, so filters and
column pruning reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

from bough.errors import SetupError
from bough.names import quoted
from bough.spec import Entity

Reader = Callable[[str | None, str], DataFrame]


def given_tables(tables: Mapping[str, DataFrame]) -> Reader:
    """DataFrames by ``schema.table`` or ``table``, whatever the case."""
    by_name = {name.lower(): df for name, df in tables.items()}

    def read(schema: str | None, table: str) -> DataFrame:
        names = [f"{schema}.{table}".lower()] if schema else []
        for name in [*names, table.lower()]:
            if name in by_name:
                return by_name[name]
        raise SetupError(f"no DataFrame was given for table '{table}'")

    return read


def catalog_tables(spark: SparkSession) -> Reader:
    """Tables and views of the session catalog; odd names are safe because they are quoted."""

    def read(schema: str | None, table: str) -> DataFrame:
        parts = [schema, table] if schema else [table]
        return spark.table(".".join(quoted(p) for p in parts))

    return read


def parquet_tables(spark: SparkSession, folder: str) -> Reader:
    """``folder/[schema/]table.parquet``."""

    def read(schema: str | None, table: str) -> DataFrame:
        path = f"{schema}/{table}" if schema else table
        return spark.read.parquet(f"{folder.rstrip('/')}/{path}.parquet")

    return read


def jdbc_tables(
    spark: SparkSession,
    url: str,
    options: Mapping[str, str] | None = None,
    partitioning: Mapping[str, Mapping[str, str]] | None = None,
    one_connection: Collection[str] = (),
    quote: tuple[str, str] = ('"', '"'),
) -> Reader:
    """Tables of a relational database.

    ``partitioning`` gives a table's ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``. A table without them would be read by one task; that has to be wanted, by
    naming it in ``one_connection``.
    """
    first, last = quote

    def read(schema: str | None, table: str) -> DataFrame:
        if table not in (partitioning or {}) and table not in one_connection:
            raise SetupError(f"table '{table}' needs partitioning, or to be named in one_connection")
        parts = [schema, table] if schema else [table]
        name = ".".join(first + p.replace(last, last * 2) + last for p in parts)
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        return reader.options(**(options or {})).options(
            **((partitioning or {}).get(table) or {})
        ).load()

    return read


def scan(entity: Entity, reader: Reader) -> DataFrame:
    """The table of one entity, checked for the columns the description names."""
    df = reader(entity.schema, entity.table)
    have = {c.lower() for c in df.columns}
    wanted = [*entity.key_columns, *entity.parent_key_columns, *(f.source for f in entity.fields)]
    missing = [c for c in dict.fromkeys(wanted) if c.lower() not in have]
    if missing:
        raise SetupError(f"table '{entity.table}' of '{entity.name}' lacks column(s) {missing}")
    return df
