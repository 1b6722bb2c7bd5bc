"""One JSON document for each statement, from any number of result tables: all are grouped once, none is joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

KEY = "statement_id"


def _sortable(df: DataFrame, column: str) -> Column:
    """A text that sorts as the column does; nulls first."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, IntegralType):
        # beyond the smallest long, padded: whole numbers sort as texts of one length
        value = F.lpad((value.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def payloads(one: dict[str, DataFrame], many: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(statement_id, payload): an object for each table of one (null where a statement has no row), a list for each of many, in the order of its columns.

    Tables have statement_id, and their other columns become fields, nulls too. A statement's rows are one array.
    """
    names = [*one, *many]
    parts = []
    for k, name in enumerate(names):
        df, order = (one[name], []) if name in one else many[name]
        row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != KEY)), {"ignoreNullFields": "false"})
        place = F.array(*(_sortable(df, c) for c in order)) if order else F.array().cast("array<string>")
        parts.append(df.select(KEY, F.struct(F.lit(k).alias("part"), place.alias("place"), row.alias("json")).alias("x")))
    rows = reduce(DataFrame.unionByName, parts).groupBy(KEY).agg(F.array_sort(F.collect_list("x")).alias("rows"))
    found = lambda k: F.transform(F.filter("rows", lambda x: x["part"] == k), lambda x: x["json"])
    field = lambda k, name: F.concat(F.lit(f',"{name}":'), F.coalesce(F.get(found(k), F.lit(0)), F.lit("null")) if name in one else F.concat(F.lit("["), F.array_join(found(k), ","), F.lit("]")))
    head = F.to_json(F.struct(KEY))
    return rows.select(KEY, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), *(field(k, name) for k, name in enumerate(names)), F.lit("}")).alias("payload"))
