"""A value that an expression uses many times, evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for each row however often use() names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
