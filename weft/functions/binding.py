"""A value bound to a name within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is planned and evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct; unlike aliases, its names also hold within functions of bound values."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])
