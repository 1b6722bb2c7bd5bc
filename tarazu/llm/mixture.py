"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in order of their names (code points, null last) weigh 5, 2, 1, repeating, and share the
size of all documents; a target stops at ``MOST_COPIES`` times its source's size and the excess is
shared again by weight. A document's expected copies are its source's target over its size. The
documents of a source are put in order, expected copies are prefix-summed from one offset that the
seed and the source's name give, and a copy is taken at each whole number that the sum crosses. Of
``OFFSETS`` offsets, a random one and those evenly after it, a source has the one whose copies' words come
nearest to its target, which matters where a few documents hold most of a small source.

The order is by size class, then by a salt of the id (of a null id, of the row), then by size, id and
a hash of the row, so it doesn't depend on how rows lie. Prefix sums run over groups of one class and
salt (bounded for each source), then within a group, so a source that holds most rows is dealt over
thousands of groups. Ordering by size makes the copies' words come near the target. Sources are one
row each where they are ranked.

Defined cases: a null text has size 0; a null source is a source, the last; repeated rows are drawn
each on its own; other columns are kept, but for those named like the new ones; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_PATTERN

WEIGHTS, MOST_COPIES, SALTS, OFFSETS = (5, 2, 1), 3, 64, 64
NEW = ("size", "source_size", "target", "copies", "taken")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) -> with target. A source is capped where its share by weight exceeds its cap."""
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.col("_r") - 1) % len(WEIGHTS)).cast("int"))
    ranked = ranked.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * MOST_COPIES)
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (total - before).cast("double") / rest)
    return level.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w") * F.max("_level").over(every))).select("source", "source_size", "target")


def taken_copies(at: Column, rate: Column, offset: Column) -> Column:
    """How often the prefix sum of expected copies crosses a whole number at a place."""
    return F.least(F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset), F.lit(MOST_COPIES)).cast("long")


def placed_rows(df: DataFrame, id_column: str, text_column: str, source_column: str, seed: int, columns: list[str]) -> DataFrame:
    """(own, size, source_size, target, copies); own has the given columns of the row, so that these may have any names."""
    rows = df.select(F.struct(*columns).alias("own"), F.col(id_column).alias("_id"), F.col(source_column).cast("string").alias("_s"), F.xxhash64(F.col(text_column).cast("string"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns if c != text_column)))).alias("_h"), F.coalesce(F.regexp_count(text_column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("_k", F.coalesce(F.concat(F.lit("="), "_s"), F.lit("null")))
    bits = F.length(F.bin("size"))
    rows = rows.withColumn("_b", (bits * 16 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 4, F.lit(0)))).cast("long"))
    name = F.col("_id").cast("string")
    salt = F.conv(F.substring(F.md5(F.coalesce(name, F.lit("null"))), 1, 4), 16, 10).cast("long") % SALTS
    rows = rows.withColumn("_salt", F.when(name.isNull(), F.pmod("_h", F.lit(SALTS))).otherwise(salt))
    groups = rows.groupBy("_k", "_s", "_b", "_salt").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    rates = targets(groups.groupBy(F.col("_s").alias("source")).agg(F.sum("_size").alias("source_size")))
    rates = rates.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_k"), "source_size", "target")
    order = Window.partitionBy("_k").orderBy("_b", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).join(rates, "_k").select("_k", "_b", "_salt", "_before", "source_size", "target")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_k", "_b", "_salt").orderBy("size", "_id", "_h"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shifts = [_unit(F.concat(F.lit(f"{seed}:"), "_k")) + j / OFFSETS for j in range(OFFSETS)]
    shifts = [x - F.floor(x) for x in shifts]
    slim = rows.select("_k", "_b", "_salt", "_id", "_h", "size").join(placed, ["_k", "_b", "_salt"]).select("_k", "size", "target", rate.alias("rate"), at.alias("at"))
    shifted = slim.withColumn("base", _unit(F.concat(F.lit(f"{seed}:"), "_k"))).select("_k", "size", "target", "rate", "at", *((F.col("base") + j / OFFSETS - F.floor(F.col("base") + j / OFFSETS)).alias(f"_x{j}") for j in range(OFFSETS)))
    sums = shifted.groupBy("_k").agg(F.max("target").alias("target"), *(F.sum(taken_copies(F.col("at"), F.col("rate"), F.col(f"_x{j}")) * F.col("size")).alias(f"_o{j}") for j in range(OFFSETS)))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"_o{j}") - F.col("target")).alias("off"), F.lit(j).alias("j")) for j in range(OFFSETS))))["j"]
    placed = placed.join(sums.select("_k", nearest.alias("_j")), "_k").withColumn("_x", F.get(F.array(*shifts), F.col("_j")))
    rows = rows.join(placed, ["_k", "_b", "_salt"]).withColumn("_at", at)
    copies = taken_copies(F.col("_at"), rate, F.col("_x"))
    return rows.select("own", "size", "source_size", "target", copies.alias("copies"))


def mixed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """The rows with size, source_size, target, copies and taken (copies times size). columns: those of the row to keep, by default all."""
    kept = [c for c in df.columns if c not in NEW and (columns is None or c in columns)]
    out = placed_rows(df, id_column, text_column, source_column, seed, kept)
    return out.select(*(F.col("own").getField(c).alias(c) for c in kept), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resampled(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0) -> DataFrame:
    """The rows in as many copies as the mix takes, with all their columns and no others."""
    out = placed_rows(df, id_column, text_column, source_column, seed, df.columns).filter("copies > 0")
    return out.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*")


def emitted(mix: DataFrame) -> DataFrame:
    """One row for each copy, without the columns of mixed()."""
    own = F.struct(*(c for c in mix.columns if c not in NEW)).alias("own")
    return mix.filter("copies > 0").select(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*")
