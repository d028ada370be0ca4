"""A whole export as one JSON or XML document, written by many tasks.

A nested document is a sequence of pieces: the opening of a row, the pieces of its children, its
closing. Each piece is a record that carries its place, namely the keys of its ancestors and which
child list it is in, so one range sort over all levels puts every piece where it belongs. No task
ever holds a subtree; a parent with a large share of all rows is spread like any other data.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bough.functions.render import json_members, text, xml_element
from bough.names import code, col, part
from bough.operators.checks import row_counts
from bough.operators.levels import Level, attach_parent
from bough.operators.ranges import TIE, ordered, row_bytes
from bough.operators.staging import row_hash, small_rows, stage
from bough.sinks.writing import ENTITY, write_lines
from bough.spec import Entity, Export

# Places among the pieces of one row: its opening has none (nulls sort first), then each child
# list has three, then the closing.
_LIST_OPEN, _LIST_ROWS, _LIST_CLOSE, _PER_LIST = 1, 2, 3, 3
_ROW_CLOSE = 2**31 - 1
_DOC_OPEN, _DOC_ROWS, _DOC_CLOSE = 0, 1, 2


def step(depth: int) -> str:
    return f"step:{depth}"


def first_child(name: str) -> str:
    return f"first:{name}"


class JsonStyle:
    """Fields, then one array per child entity that has rows; null fields are written."""

    lists = True

    def document(self, export: Export) -> tuple[str, str]:
        return "[", "]"

    def opening(self, level: Level, df: DataFrame, is_first: Column, held: str | None = None) -> Column:
        comma = F.when(is_first, "").otherwise(",")
        tail = "" if level.entity.children else "}"
        return F.concat(comma, F.lit("{"), members(level, df, held), F.lit(tail))

    def closing(self, entity: Entity) -> str:
        return "}"

    def list_opening(self, child: Entity) -> str:
        return f',"{child.name}":['

    def list_closing(self, child: Entity) -> str:
        return "]"


class XmlStyle:
    """An element per row named by its entity, an element per field, child rows after them."""

    lists = False

    def document(self, export: Export) -> tuple[str, str]:
        return f'<?xml version="1.0" encoding="utf-8"?><{export.name}>', f"</{export.name}>"

    def opening(self, level: Level, df: DataFrame, is_first: Column, held: str | None = None) -> Column:
        name = level.entity.name
        tail = "" if level.entity.children else f"</{name}>"
        return F.concat(F.lit(f"<{name}>"), *elements(level, df, held), F.lit(tail))

    def closing(self, entity: Entity) -> str:
        return f"</{entity.name}>"


def _fields(level: Level, df: DataFrame, held: str | None):
    """Field, value, type and found code of the fields of a row: columns of ``df``, or members of its
    struct ``held``."""
    schema = df.schema if held is None else df.schema[held].dataType
    for f in level.entity.fields:
        value, found = (col(c) if held is None else part(held, c) for c in (f.name, code(f.name)))
        yield f, value, schema[f.name].dataType, found if code(f.name) in schema.names else None


def members(level: Level, df: DataFrame, held: str | None = None) -> Column:
    """The fields of a row as JSON members."""
    fields = [(f.name, value, kind, f.type, found) for f, value, kind, found in _fields(level, df, held)]
    return json_members(fields, level.entity.name)


def elements(level: Level, df: DataFrame, held: str | None = None) -> list[Column]:
    """The fields of a row as XML elements."""
    return [
        xml_element(f.name, text(value, kind, f.type) if found is None else F.coalesce(found, text(value, kind, f.type)))
        for f, value, kind, found in _fields(level, df, held)
    ]


def json_body(level: Level, df: DataFrame) -> Column:
    """One row's whole JSON object; a child entity without rows leaves no member."""
    lists = [
        F.when(
            F.size(col(c.name)) > 0,
            F.concat(F.lit(f',"{c.name}":['), F.concat_ws(",", col(c.name)), F.lit("]")),
        ).otherwise("")
        for c in level.entity.children
    ]
    return F.concat(F.lit("{"), members(level, df), *lists, F.lit("}"))


def xml_body(level: Level, df: DataFrame) -> Column:
    """One row's whole XML element."""
    kids = [F.concat_ws("", col(c.name)) for c in level.entity.children]
    name = level.entity.name
    return F.concat(F.lit(f"<{name}>"), *elements(level, df), *kids, F.lit(f"</{name}>"))


@dataclass(frozen=True)
class _Placed:
    """A level whose rows carry their place: step and key columns of every ancestor and their own."""

    level: Level
    depth: int
    place: tuple[str, ...]


def _smallest(level: Level) -> list[Column]:
    """Aggregates for the smallest key, nulls first. A single key is aggregated as it is, which
    hashes; a struct would have to be sorted."""
    own = [col(k) for k in level.key_names]
    if len(own) > 1:
        return [F.min(F.struct(*own)).alias("smallest:")]
    return [F.min(own[0]).alias("smallest:"), F.bool_or(own[0].isNull()).alias("null:")]


def _smallest_key(level: Level) -> Column:
    """The smallest key as a struct; null only where there were no rows."""
    if len(level.key_names) > 1:
        return col("smallest:")
    name = level.key_names[0]
    return F.when(
        col("null:").isNotNull(), F.struct(F.when(~col("null:"), col("smallest:")).alias(name))
    )


def _with_firsts(level: Level, levels: Mapping[str, Level]) -> Level:
    """Each row's smallest child key per child entity, null where it has no such child.

    Only child keys move, combined before the shuffle.
    """
    df = level.df
    for child in level.entity.children:
        below = levels[child.name]
        firsts = (
            below.df.groupBy(*map(col, below.fk_names))
            .agg(*_smallest(below))
            .select(
                *[col(f).alias(f"down:{f}") for f in below.fk_names],
                _smallest_key(below).alias(first_child(child.name)),
            )
        )
        pairs = zip(level.key_names, below.fk_names)
        condition = [col(mine) == col(f"down:{theirs}") for mine, theirs in pairs]
        df = df.join(firsts, condition, "left").drop(*[f"down:{f}" for f in below.fk_names])
    return level.with_df(df)


FIRST_ROOT = "first row:"


def _with_first_root(level: Level) -> Level:
    """Marks the row that comes first, and only that one.

    Root keys may repeat in a flat export. Rows with the smallest key are told apart by a hash of
    the row, as in sorting, and rows that are equal in that too by counting them; only such copies
    of the very first row meet in a task, which holds one at a time.
    """
    place = F.struct(*map(col, level.key_names), row_hash(level.df).alias("hash:"))
    smallest = level.df.agg(F.min(place).alias(FIRST_ROOT))
    marked = level.df.join(F.broadcast(smallest), place.eqNullSafe(col(FIRST_ROOT)), "left")
    alike = Window.partitionBy(FIRST_ROOT).orderBy(FIRST_ROOT)
    least = col(FIRST_ROOT).isNotNull()
    firsts = marked.where(least).withColumn(FIRST_ROOT, F.row_number().over(alike) == 1)
    others = marked.where(~least).withColumn(FIRST_ROOT, F.lit(False))
    return level.with_df(firsts.union(others))


def _own(level: Level) -> Column:
    return F.struct(*map(col, level.key_names))


def _place(level: Level, above: _Placed | None, index: int, carried: list[str]) -> _Placed:
    """Give rows their place: that of their parent, the list they are in, their own key."""
    depth = 0 if above is None else above.depth + 1
    keys = {
        # Sibling entities share a column where their keys have one type.
        f"at:{depth}:{i}:{level.df.schema[name].dataType.simpleString()}": col(name)
        for i, name in enumerate(level.key_names)
    }
    if above is None:
        df, where, upper = level.df, _DOC_ROWS, ()
    else:
        df = attach_parent(level, above.level, [*above.place, *carried])
        where, upper = index * _PER_LIST + _LIST_ROWS, above.place
    df = df.withColumns({step(depth): F.lit(where), **keys})
    return _Placed(level.with_df(df), depth, (*upper, step(depth), *keys))


def raw(name: str) -> str:
    """What a row's opening is made of: its fields, codes found by lookups, whether it is the first of its list."""
    return f"raw:{name}"


IS_FIRST = "is first:"


def _row_pieces(placed: _Placed, texts: "_Texts", is_first: Column | None) -> DataFrame:
    """The opening of every row, not yet as text, and, where rows can have children, the closing."""
    level, entity, df = placed.level, placed.level.entity, placed.level.df
    written = [col(f.name) for f in entity.fields]
    written += [col(code(f.name)) for f in entity.fields if code(f.name) in df.columns]
    written.append((F.lit(False) if is_first is None else is_first).alias(IS_FIRST))
    fields, place = F.struct(*written), [*map(col, placed.place)]
    owner, opening = F.lit(entity.name), F.lit(texts.opening(entity))
    if not entity.children:
        return df.select(*place, owner.alias(ENTITY), opening.alias(WHAT), fields.alias(raw(entity.name)))
    nothing = F.lit(None).cast(df.select(fields).schema[0].dataType)
    pieces = [
        _piece(placed, None, opening, owner, fields.alias(raw(entity.name))),
        _piece(placed, F.lit(_ROW_CLOSE), F.lit(texts.fixed(texts.style.closing(entity))), None, nothing.alias(raw(entity.name))),
    ]
    return df.select(*place, F.inline(F.array(*pieces)))


def _piece(placed: _Placed, at: Column | None, what: Column, owner: Column | None, *more: Column) -> Column:
    nothing = F.lit(None)
    return F.struct(
        (nothing if at is None else at).cast("int").alias(step(placed.depth + 1)),
        (nothing if owner is None else owner).cast("string").alias(ENTITY),
        what.alias(WHAT),
        *more,
    )


def _list_pieces(placed: _Placed, texts: "_Texts") -> DataFrame:
    """The ends of every child list that has rows."""
    pieces = []
    for i, child in enumerate(placed.level.entity.children):
        has_rows = col(first_child(child.name)).isNotNull()
        for at, text in (
            (_LIST_OPEN, texts.style.list_opening(child)),
            (_LIST_CLOSE, texts.style.list_closing(child)),
        ):
            piece = _piece(placed, F.lit(i * _PER_LIST + at), F.lit(texts.fixed(text)), None)
            pieces.append(F.when(has_rows, piece))
    # A list that is not there leaves a null piece, which comes out as a row that is nothing.
    spread = placed.level.df.select(*map(col, placed.place), F.inline(F.array(*pieces)))
    return spread.where(col(WHAT).isNotNull())


#: Which piece a row is: an opening of an entity (0 and up) or a text that is always the same (below 0).
WHAT = "what:"


class _Texts:
    """What pieces are as text. Pieces move without it and are rendered where they are written."""

    def __init__(self, export: Export, levels: Mapping[str, Level], style):
        self.style, self.levels = style, levels
        self.names = [e.name for e in export.entities()]
        self.same: list[str] = []

    def opening(self, entity: Entity) -> int:
        return self.names.index(entity.name)

    def fixed(self, text: str) -> int:
        if text not in self.same:
            self.same.append(text)
        return -1 - self.same.index(text)

    def rendered(self, pieces: DataFrame) -> DataFrame:
        """``pieces`` with ``text`` instead of what it is made of."""
        text = F.element_at(F.lit(self.same), -col(WHAT))
        for i, name in enumerate(self.names):
            text = F.when(col(WHAT) == i, self._opening(name, pieces)).otherwise(text)
        parts = [WHAT, *map(raw, self.names)]
        return pieces.withColumn("text", text).drop(*parts)

    def _opening(self, name: str, pieces: DataFrame) -> Column:
        held = raw(name)
        return self.style.opening(self.levels[name], pieces, part(held, IS_FIRST), held)

    def weights(self, bare: Mapping[str, Level]) -> tuple[Column, float]:
        """About how many bytes a piece has as text, by what it is, and all of them together at most."""
        rows = {r.entity: r.rows for r in row_counts({n: v.df for n, v in bare.items()}).collect()}
        around = sum(len(t.encode()) + 1 for t in self.same)
        weight = F.element_at(F.lit([len(t.encode()) + 1.0 for t in self.same]), -col(WHAT))
        most = 0.0
        for i, name in enumerate(self.names):
            level = self.levels[name]
            mean = row_bytes(level.df, F.octet_length(self.style.opening(level, level.df, F.lit(False)))) + 1
            weight = F.when(col(WHAT) == i, F.lit(float(mean))).otherwise(weight)
            most += rows[name] * (mean + (around if level.entity.children else 0)) + around
        return weight, most


def document_pieces(
    export: Export, levels: Mapping[str, Level], bare: Mapping[str, Level], style
) -> tuple[DataFrame, list[str], _Texts]:
    """All pieces of a document, the columns that put them in order, and what makes them text.

    ``levels`` have what is written; ``bare`` are the same rows, used for their keys only.
    """
    parts: list[DataFrame] = []
    seats: dict[str, _Placed] = {}
    texts = _Texts(export, levels, style)
    indexes = {c.name: i for e in export.entities() for i, c in enumerate(e.children)}
    deepest = 0
    for entity in export.entities():
        level, parent = levels[entity.name], export.parent(entity)
        above = seats[parent.name] if parent else None
        index = indexes.get(entity.name, 0)
        is_first, carried = None, []
        if style.lists:
            is_first = _own(level).eqNullSafe(col(first_child(entity.name)))
            carried = [first_child(entity.name)]
            if parent is None:
                level, is_first = _with_first_root(level), col(FIRST_ROOT)
        placed = _place(level, above, index, carried)
        deepest = max(deepest, placed.depth)
        if export.is_flat:
            # Keys may repeat, so rows are told apart as the first one is found.
            tied = placed.level.df.withColumns({TIE: row_hash(levels[entity.name].df), _LATER: _later(is_first)})
            placed = replace(placed, level=level.with_df(tied), place=(*placed.place, TIE, _LATER))
        parts.append(_row_pieces(placed, texts, is_first))
        if entity.children:
            seats[entity.name] = _seats(bare, entity, above, index, style.lists)
            if style.lists:
                parts.append(_list_pieces(seats[entity.name], texts))

    first, last = style.document(export)
    ends = small_rows(
        parts[0].sparkSession,
        [(_DOC_OPEN, texts.fixed(first)), (_DOC_CLOSE, texts.fixed(last))],
        f"`{step(0)}` int, `{WHAT}` int",
    )
    pieces = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, ends])
    order = []
    for depth in range(deepest + 2):
        if step(depth) in pieces.columns:
            order.append(step(depth))
        order += sorted(c for c in pieces.columns if c.startswith(f"at:{depth}:"))
    return pieces, [*order, *([TIE, _LATER] if export.is_flat else [])], texts


_LATER = "later:"


def _later(is_first: Column | None) -> Column:
    return F.lit(True) if is_first is None else ~is_first


def _seats(
    bare: Mapping[str, Level], entity: Entity, above: _Placed | None, index: int, lists: bool
) -> _Placed:
    """Keys and places of the rows that children are tied to, without their fields.

    They are written, so that a deep tree does not work out its upper levels once per level, and
    so that the join of the children reads a plain table and can split a parent that many share.
    """
    level = bare[entity.name]
    keys = level.df.select(*map(col, [*level.key_names, *level.fk_names]))
    placed = _place(level.with_df(keys), above, index, [])
    seated = _with_firsts(placed.level, bare) if lists else placed.level
    if lists or above is not None:
        seated = seated.with_df(stage(seated.df.drop(*seated.fk_names), entity.name))
    return replace(placed, level=seated)


def write_pieces(
    export: Export, pieces: DataFrame, order: list[str], texts: _Texts, bare: Mapping[str, Level], path: str
) -> dict[str, int]:
    """Pieces move once, as fields, to the part they belong to, and become text in the task that writes it."""
    names = [e.name for e in export.entities()]
    weight, most = texts.weights(bare)
    return write_lines(texts.rendered(ordered(pieces, order, weight, most)), path, names, "\n")
