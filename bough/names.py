"""Column naming.

Output names are XML names, which never contain a colon, so every helper column carries one and
can sit beside the declared fields without a clash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW = "RowNumber"
PARENT_ROW = "ParentRowNumber"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, dots and dashes included."""
    return F.col(quoted(name))


def part(column: str, name: str) -> Column:
    """Field ``name`` of the struct column ``column``."""
    return F.col(f"{quoted(column)}.{quoted(name)}")


def key(i: int) -> str:
    return f"key:{i}"


def fk(i: int) -> str:
    return f"fk:{i}"


def code(field: str) -> str:
    return f"code:{field}"


def keys(n: int) -> list[str]:
    return [key(i) for i in range(n)]


def fks(n: int) -> list[str]:
    return [fk(i) for i in range(n)]
