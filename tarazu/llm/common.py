"""Pieces that several corpus operators share.

Words everywhere are maximal runs of characters other than space, tab, LF, VT, FF and CR, which is
what ``bytes.split()`` gives on the Python side and ``WORD_PATTERN`` gives on the JVM side.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: The row id that stands for a null doc_id, so that a null sorts after every other id.
NULL_ID = (1 << 63) - 1
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    if path := spark.conf.get("spark.checkpoint.dir", ""):
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="corpus-"))
    return _own_dir[0]


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """A written table with a bucket for each shuffle partition by hash of the column: groups and joins on it move none of its rows."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later plan reads."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        folder.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Spark drops shuffle files once the driver has forgotten their plans."""
    for _ in range(2):  # the first makes plans unreachable, the second finds what they held
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.5)


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def with_key(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Adds _id and _h, a key by which verdicts find their rows again. Repeated rows share it, and get one verdict."""
    return df.withColumns({"_id": row_id(id_column), "_h": F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))})


def keyed_rows(df: DataFrame, id_column: str, text_column: str, new: tuple[str, ...]) -> DataFrame:
    """(own, _id, _h, text): a row's other columns as one struct, less those that the operator makes anew."""
    own = [F.col(f"`{c}`") for c in df.columns if c != text_column and c not in new]
    rows = df.select(F.struct(*own).alias("own"), F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return with_key(rows).drop("doc_id")


def restored(rows: DataFrame, columns: list[str], text_column: str, text: Column | None = None) -> list[Column]:
    """A row's columns in their order, from keyed_rows; text stands for the text column."""
    return [(F.col("text") if text is None else text).alias(c) if c == text_column else F.col("own").getField(c).alias(c) for c in columns]


def made(rows: DataFrame, **columns: str) -> StructType:
    """own, and new columns by name and type."""
    return StructType([rows.schema["own"], *(StructField(c, _parse_datatype_string(t)) for c, t in columns.items())])


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a block's strings in one column hold about most_bytes at most; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, total = 0, 0
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            if i > at and total + n > most_bytes:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        yield batch.slice(at)


def by_block(texts: DataFrame, own: DataFrame) -> DataFrame:
    """texts with b, and own(b, own array): each block's rows together, after a row that has the block's array."""
    columns = [c for c in texts.columns if c != "b"]
    rows = texts.select("b", F.lit(1).alias("kind"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), *columns)
    first = own.select("b", F.lit(0).alias("kind"), "own", *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in columns))
    return rows.unionByName(first).repartition("b").sortWithinPartitions("b", "kind")


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array | None, pa.Table]]:
    """(the values of the block's array, its rows) of each block that has rows."""
    own, held, now = None, [], None
    for batch in batches:
        block = batch.column(0).to_pylist()
        cuts = [0, *(k for k in range(1, len(block)) if block[k] != block[k - 1]), len(block)] if block else [0]
        for at, end in zip(cuts, cuts[1:], strict=False):
            if block[at] != now:
                if held:
                    yield own, pa.Table.from_batches(held)
                own, held, now = None, [], block[at]
                if batch.column(1)[at].as_py() == 0:
                    own = batch.column(2).slice(at, 1).flatten()
                    at += 1
            if end > at:
                held.append(batch.slice(at, end - at))
    if held:
        yield own, pa.Table.from_batches(held)


def words_of(text: str = "text") -> Column:
    """The words as an array, on the JVM side (null: none)."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_PATTERN), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
