"""How filters interact: what each of five removes, in every order they can be applied in.

Failures of a document, as bits of a mask: A: under ``LEAST_WORDS`` words; B: 100 times its distinct
words are fewer than ``LEAST_DISTINCT`` times its words; C: 100 times its A-Z are more than
``MOST_CAPITALS`` times its code points; D: it holds one of ``SYMBOLS``; E: a document of smaller id
has the same text, removed or not.

Duplicates are found by sorting: rows are range-partitioned by the text's fingerprint and the id (so
a text that a third of all rows have is dealt over many partitions, and the bounds that Spark samples
are two numbers, no texts), sorted by fingerprint, whole text and id, and compared with their
predecessors. Of a text the first row of a partition alone stays undecided where the partition starts
with that fingerprint; these rows, a few for each partition, are settled by the texts that partitions
start and end with. Masks are counted by part and mask, and all orders follow from the counters.

Defined cases: a null text is the empty text, which is a text like others for E; a null id comes
after all others, rows of a null id aren't duplicates of one another, and have no labels; rows that
repeat an id and a text are no duplicates of one another; of several labels of an id any counts; a
null part is the empty string; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import batched, permutations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, byte_column, materialize, row_id

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKED = pa.schema([("part", pa.string()), ("id", pa.int64()), ("mask", pa.int32()), ("n", pa.int64()), ("fp", pa.int64()), ("digest", pa.binary()), ("edge", pa.string())])
BATCH = 8192


def own_mask(text: bytes) -> int:
    """The bits of A to D."""
    words = text.split()
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * len(text.decode()),
        SYMBOLS.search(text) is not None,
    )
    return sum(x << k for k, x in enumerate(failed))


def sorted_masks(rows: Iterator[tuple[str, int, bytes, int]]) -> Iterator[tuple]:
    """A sorted partition's rows (part, id, text, fp) -> rows of MASKED; repeated ones are counted."""
    opening = before = text = row = None
    n = least = own = 0
    digest, ends = b"", []
    for part, i, t, fp in rows:
        opening = fp if opening is None else opening
        if fp != before:
            before, text, ends = fp, None, []
        if t != text:
            text, least, own, digest = t, i, own_mask(t), hashlib.sha256(t).digest()
            ends.append((i, digest))
        edge = fp == opening and i == least
        now = (part, i, own | (i > least) << 4, *((fp, digest, "first") if edge else (None, None, None)))
        if now != row and row:
            yield *row[:3], n, *row[3:]
            n = 0
        row, n = now, n + 1
    if row:
        yield *row[:3], n, *row[3:]
    for i, d in ends:
        yield "", i, 0, 0, before, d, "last"


def masks(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, id, mask, n, fp, digest, edge). Rows of edge 'first' lack the bit of E where an earlier partition ends with their text; those of edge 'last' are no documents, but the texts that partitions end with."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = df.select(F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), row_id(id_column).alias("id"), text.alias("text")).withColumn("fp", F.xxhash64("text"))
    dealt = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp", "id").sortWithinPartitions("fp", "text", "id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_column(b, "text"), b.column(3).to_pylist(), strict=True))
        for some in batched(sorted_masks(rows), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), MASKED.types, strict=True)], schema=MASKED)

    return dealt.mapInArrow(run, "part string, id long, mask int, n long, fp long, digest binary, edge string")


def counters(df: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, and those of quality 1 and of toxic 1."""
    found = materialize(masks(df, **columns), "masks")
    ends = found.filter("edge = 'last'").groupBy("fp", "digest").agg(F.min("id").alias("least"))
    settled = found.filter("edge = 'first'").join(ends, ["fp", "digest"], "left").withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("least") < F.col("id"), 1 << 4).otherwise(0)))
    rows = found.filter("edge is null").select("part", "id", "mask", "n").unionByName(settled.select("part", "id", "mask", "n"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    nameless = F.col("id") == NULL_ID
    rows = rows.filter(~nameless).join(known, "id", "left").unionByName(rows.filter(nameless).withColumns({"quality": F.lit(0), "toxic": F.lit(0)}))
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def interactions(df: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step."""
    places = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(sum(1 << FILTERS.index(x) for x in o[:k])).alias("before"), F.lit(1 << FILTERS.index(o[k])).alias("bit")) for o in ORDERS for k in range(len(FILTERS))))
    # counters are few for a part: it has 32 masks at most
    rows = counters(df, labels, **columns).select("*", F.explode(places).alias("p")).select("part", "mask", "n", "good", "toxic", "p.*")
    has = lambda bits: F.col("mask").bitwiseAND(bits) != 0
    fails, gone = has(F.col("bit")), has(F.col("before"))
    count = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    shares = F.col("n") * (F.lit(len(ORDERS)) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    out = rows.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, shares)), F.lit(0)).alias("shapley"),
    )
    return out.select("part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
