"""One export run: a description, its tables, filter values and lookups, turned into plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bough.errors import SetupError
from bough.names import PARENT_ROW, ROW, col
from bough.operators import checks, nesting
from bough.operators.filters import among, conjunction
from bough.operators.levels import (
    Level,
    attach_parent,
    check_key_types,
    key_order,
    keep_surviving,
    project,
)
from bough.operators.lookups import CodeJoins, settle
from bough.operators.numbering import dense_number
from bough.operators.ranges import DenseOrder, row_bytes
from bough.operators.staging import stage
from bough.plans.request import bind, output_format, require_lookups, resolve
from bough.sinks import csv, document
from bough.sources.codes import CodeList
from bough.sources.tables import given_tables, scan
from bough.spec import Entity, Export


class ExportRun:
    """Checked on construction; every method then returns a DataFrame or writes one output.

    What needs checked keys, numbers, document places or a Python lookup runs jobs while its plan
    is built and writes small tables to the staging folder. ``with staged_here(spark):`` around a
    run and its outputs removes them at the end.

    ``tables`` is a mapping of DataFrames or a reader from :mod:`bough.sources.tables`.
    ``filters`` maps filter names to a value or a list of values, as text.
    ``lookups`` maps names to ``(id, code)`` DataFrames, CodeLists or FunctionLookups.
    ``transform`` is applied to the raw rows of every level: ``(entity name, df) -> df``.
    ``check_keys`` looks for rows of a tree level that share a key, which would be ambiguous;
    documents and numbers of a tree always do.
    """

    def __init__(
        self,
        spark: SparkSession,
        export: Export | Mapping,
        tables,
        filters: Mapping[str, object] | None = None,
        lookups: Mapping[str, object] | None = None,
        transform: Callable[[str, DataFrame], DataFrame] | None = None,
        check_keys: bool = True,
    ):
        self.spark = spark
        self.export = (export if isinstance(export, Export) else Export.from_dict(export)).check()
        self.check_keys = check_keys
        self.lookups = {
            name.lower(): CodeList(given, name) if isinstance(given, DataFrame) else given
            for name, given in (lookups or {}).items()
        }
        require_lookups(self.export, self.lookups)

        reader = tables if callable(tables) else given_tables(tables)
        sources = {e.name: scan(e, reader) for e in self.export.entities()}
        schemas = {name: df.schema for name, df in sources.items()}
        bound = resolve(
            spark, self.export, bind(self.export, filters or {}), self.lookups, schemas
        )
        self._projected: dict[str, Level] = {}
        for entity in self.export.entities():
            table = sources[entity.name]
            chosen = bound.get(entity.name, [])
            condition = conjunction(chosen, table.schema)
            types = {f.name.lower(): f.dataType for f in table.schema}
            joined = [b for b in chosen if b.values is not None]
            for b in joined:
                table = among(table, b, types[b.field.source.lower()])
            level = project(entity, table, condition)
            level = replace(level, narrowed=level.narrowed or bool(joined), scanned=not joined and transform is None)
            if transform is not None:
                level = level.with_df(transform(entity.name, level.df))
                self._require_columns(level)
            self._projected[entity.name] = level
            parent = self.export.parent(entity)
            if parent is not None:
                check_key_types(level, self._projected[parent.name])
        self._code_joins = CodeJoins(self.lookups)
        self._skeletons: dict[str, DataFrame] = {}
        self._orders: dict[str, DenseOrder] = {}
        self._keys_are_unique = False

    @staticmethod
    def _require_columns(level: Level) -> None:
        wanted = [*level.key_names, *level.fk_names, *(f.name for f in level.entity.fields)]
        lost = [c for c in wanted if c not in level.df.columns]
        if lost:
            raise SetupError(f"the transform of '{level.entity.name}' dropped column(s) {lost}")

    @cached_property
    def _surviving(self) -> dict[str, Level]:
        """Levels restricted to surviving parents, whether or not anything was filtered."""
        levels: dict[str, Level] = {}
        for entity in self.export.entities():
            level, parent = self._projected[entity.name], self.export.parent(entity)
            levels[entity.name] = level if parent is None else keep_surviving(level, levels[parent.name])
        return levels

    @cached_property
    def _pruned(self) -> dict[str, Level]:
        """Levels as nesting needs them: restricted only below a filter, since the join to the
        parent drops orphans anyway."""
        levels: dict[str, Level] = {}
        for entity in self.export.entities():
            level, parent = self._projected[entity.name], self.export.parent(entity)
            if parent is not None and levels[parent.name].narrowed:
                level = keep_surviving(level, levels[parent.name])
            levels[entity.name] = level
        return levels

    @cached_property
    def _coded(self) -> dict[str, Level]:
        """Pruned levels with the codes of looked-up fields beside the raw values."""
        return {name: self._code_joins.apply(level) for name, level in self._pruned.items()}

    def _document_pieces(self, kind: str):
        # Placing a row joins it to its parent, which is all the restricting it needs.
        style = {"json": document.JsonStyle, "xml": document.XmlStyle}[kind]()
        coded = {name: self._code_joins.apply(level) for name, level in self._projected.items()}
        return document.document_pieces(self.export, coded, self._projected, style)

    def _entity(self, name: str | None) -> Entity:
        if name is None:
            return self.export.root
        entity = self.export.entity(name)
        if entity is None:
            raise SetupError(f"no entity '{name}' in export '{self.export.name}'")
        return entity

    def _check_tree(self, max_subtree_rows: int | None = None, always: bool = False) -> None:
        """Keys of a tree are unique in every level; subtrees have at most as many rows as asked.

        Keys are looked at as they are scanned, without a join. Only if some repeat does it matter
        whether those rows survive.
        """
        if self.export.is_flat:
            return
        if (self.check_keys or always) and not self._keys_are_unique:
            if checks.first_note(self._key_notes(self._projected)) is not None:
                checks.require_none(self._key_notes(self._surviving))
            self._keys_are_unique = True
        if max_subtree_rows is not None:
            checks.require_none([nesting.oversized_notes(self.export, self._pruned, max_subtree_rows)])

    @staticmethod
    def _key_notes(levels: Mapping[str, Level]) -> list[DataFrame]:
        return [checks.violation_notes(v.df, v.key_names, name) for name, v in levels.items()]

    # ---- rows ------------------------------------------------------------------------------

    def level(self, name: str | None = None) -> DataFrame:
        """The fields of one level's surviving rows, codes rendered, in no order."""
        entity = self._entity(name)
        settled = settle(self._code_joins.apply(self._surviving[entity.name]))
        return settled.df.select(*[col(f.name) for f in entity.fields])

    def rows(self, ordered: bool = True, numbered: bool = False) -> DataFrame:
        """The root level alone, in key order: a flat export.

        Numbers are made on request: ranges of the rows are counted first, from their keys alone.
        """
        root = self.export.root
        level = settle(self._code_joins.apply(self._projected[root.name]))
        fields = [col(f.name) for f in root.fields]
        if numbered:
            counted = dense_number(level.df, level.key_names)
            return (counted.orderBy(ROW) if ordered else counted).select(ROW, *fields)
        df = level.df.orderBy(*key_order(level)) if ordered else level.df
        return df.select(*fields)

    def nested(self, ordered: bool = True, max_subtree_rows: int | None = None) -> DataFrame:
        """One row per root: fields, then an array of structs per child entity.

        A root's whole subtree is one row and must fit a task; ``max_subtree_rows`` makes larger
        ones an error before any is built, at the cost of a pass over the keys. Documents and CSV
        bundles have no such bound.
        """
        levels = {name: settle(level) for name, level in self._coded.items()}
        return self._nest(levels, None, ordered, max_subtree_rows)

    def json_rows(self, ordered: bool = True, max_subtree_rows: int | None = None) -> DataFrame:
        """One JSON object per root, as the column ``json``."""
        df = self._nest(self._coded, document.json_body, ordered, max_subtree_rows)
        return df.withColumnRenamed("row:", "json")

    def xml_rows(self, ordered: bool = True, max_subtree_rows: int | None = None) -> DataFrame:
        """One XML element per root, as the column ``xml``."""
        df = self._nest(self._coded, document.xml_body, ordered, max_subtree_rows)
        return df.withColumnRenamed("row:", "xml")

    def _nest(self, levels, body, ordered: bool, most: int | None) -> DataFrame:
        self._check_tree(most)
        nested = nesting.nest(self.export, levels, body, ordered)
        return nesting.unpack(nested) if body is None else nested.select("row:")

    # ---- numbered levels -------------------------------------------------------------------

    def _bare(self, entity: Entity) -> tuple[DataFrame, list[str]]:
        """``ParentRowNumber, key:i`` of the surviving rows of one level, and what orders them."""
        level, parent = self._projected[entity.name], self.export.parent(entity)
        own = [col(k) for k in level.key_names]
        if parent is None:
            return level.df.select(F.lit(0).cast("long").alias(PARENT_ROW), *own), level.key_names
        narrow = level.with_df(level.df.select(*own, *map(col, level.fk_names)))
        tied = attach_parent(narrow, self._numbered_parents(parent), [PARENT_ROW])
        return tied.select(PARENT_ROW, *own), [PARENT_ROW, *level.key_names]

    def _dense(self, entity: Entity) -> DenseOrder:
        """The ranges of one level, cut and counted from keys, once per run."""
        if entity.name not in self._orders:
            self._check_tree(always=True)
            bare, order = self._bare(entity)
            fields = self._projected[entity.name].df
            size = row_bytes(fields, F.octet_length(csv.csv_line(csv.field_texts(entity, fields.schema))))
            self._orders[entity.name] = DenseOrder.measured(bare, order, size, True, csv.FILE_BYTES)
        return self._orders[entity.name]

    def _numbered_parents(self, entity: Entity) -> Level:
        """``key:i, ParentRowNumber`` of a level that has children, its numbers under the name that they have
        for those. Only keys are sorted and written, once per run.

        Numbers restart nowhere: a child's number counts over its whole level, in the order of its parent's
        number and its own key.
        """
        if entity.name not in self._skeletons:
            bare, order = self._bare(entity)
            numbers = self._dense(entity).number(bare, order).drop(PARENT_ROW).withColumnRenamed(ROW, PARENT_ROW)
            self._skeletons[entity.name] = stage(numbers, entity.name)
        return self._projected[entity.name].with_df(self._skeletons[entity.name])

    def _numbered_level(self, entity: Entity, header: bool = False) -> Level:
        """Numbers beside the fields and the codes found by lookups, in the order of the numbers.

        Rows move once, to the task of their range, besides meeting their parent's number where that takes a
        shuffle. ``header`` puts one row without a number in front.
        """
        level, parent = self._projected[entity.name], self.export.parent(entity)
        if parent is None:
            df = level.df.withColumn(PARENT_ROW, F.lit(0).cast("long"))
        else:
            df = attach_parent(level, self._numbered_parents(parent), [PARENT_ROW])
        order, dense = self._bare_order(entity), self._dense(entity)
        if header:
            df = csv.below_header(df)
            numbered = dense.number(df, order, head=col(csv.STEP) == 0)
        else:
            numbered = dense.number(df, order)
        return self._code_joins.apply(level.with_df(numbered))

    def _bare_order(self, entity: Entity) -> list[str]:
        keys = self._projected[entity.name].key_names
        return keys if self.export.parent(entity) is None else [PARENT_ROW, *keys]

    def numbered_level(self, name: str | None = None) -> DataFrame:
        """``(RowNumber, ParentRowNumber, fields...)`` of one entity."""
        entity = self._entity(name)
        settled = settle(self._numbered_level(entity)).df
        return settled.select(ROW, PARENT_ROW, *[col(f.name) for f in entity.fields])

    def numbered(self) -> dict[str, DataFrame]:
        """``(RowNumber, ParentRowNumber, fields...)`` per entity."""
        return {e.name: self.numbered_level(e.name) for e in self.export.entities()}

    # ---- counts and outputs ----------------------------------------------------------------

    def row_counts(self) -> DataFrame:
        """``(entity, rows)`` of this run.

        No level is joined or written: see :func:`bough.operators.checks.tree_counts`.
        """
        return checks.tree_counts(self.export, self._projected)

    def csv_lines(self, name: str | None = None) -> DataFrame:
        """CSV records without the header: ``text`` of a flat export, ``(RowNumber, text)`` of one
        entity of a bundle."""
        entity = self._entity(name)
        if self.export.is_flat:
            return csv.flat_lines(self._coded[entity.name])
        numbered = self._numbered_level(entity).df
        return csv.bundle_lines(entity, numbered, entity is self.export.root)

    def document(self, format: str) -> tuple[DataFrame, list[str]]:
        """The pieces of a JSON or XML document and the columns that order them."""
        # Pieces are put in place by keys, so repeated ones would mix up two rows' children.
        self._check_tree(always=True)
        pieces, order, texts = self._document_pieces(format)
        return texts.rendered(pieces), order

    def write(self, path: str, format: str | None = None) -> dict[str, int]:
        """Write the export; returns the rows written per entity.

        ``json`` and ``xml`` are one document over ordered part files, ``csv`` is one file's worth
        of parts or a folder per entity, ``parquet`` is the nested rows.
        """
        kind = output_format(format)
        if kind == "csv" and self.export.is_flat:
            return csv.write_flat(self._coded[self.export.root.name], path)
        if kind == "csv":
            levels = {e.name: self._numbered_level(e, header=True).df for e in self.export.entities()}
            return csv.write_bundle(self.export, levels, path)
        if kind == "parquet":
            return nesting.write_nested(self.export, self.nested(), path)
        self._check_tree(always=True)
        return document.write_pieces(self.export, *self._document_pieces(kind), self._projected, path)


__all__ = ["ExportRun"]
