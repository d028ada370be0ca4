"""Hierarchical exports of related tables, as Spark plans."""

from bough.errors import (
    DuplicateKeys,
    FilterError,
    SetupError,
    SpecError,
    SubtreeTooLarge,
    UnknownCode,
)
from bough.operators.nesting import rebuild
from bough.operators.numbering import dense_number
from bough.operators.staging import staged_here
from bough.plans.run import ExportRun
from bough.sources.bundle import read_bundle
from bough.sources.codes import CodeList, FunctionLookup, code_list
from bough.sources.tables import catalog_tables, given_tables, jdbc_tables, parquet_tables
from bough.spec import Entity, Export, Field, Filter

__all__ = [
    "CodeList",
    "DuplicateKeys",
    "Entity",
    "Export",
    "ExportRun",
    "Field",
    "Filter",
    "FilterError",
    "FunctionLookup",
    "SetupError",
    "SpecError",
    "SubtreeTooLarge",
    "UnknownCode",
    "catalog_tables",
    "code_list",
    "dense_number",
    "given_tables",
    "jdbc_tables",
    "parquet_tables",
    "read_bundle",
    "rebuild",
    "staged_here",
]
