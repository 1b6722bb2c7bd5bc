"""Statement files as they arrive: each is cut, parsed and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import written
from ..sources import load, statements

TABLES = ("banks", "cards", "transactions", "rejects")


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, pattern: str = "*.{csv,tsv,txt,xlsx,xls,pdf}", once: bool = True) -> StreamingQuery:
    """Appends the tables of load.Loaded under target, a folder for each batch; a batch that is run again replaces its own.

    once: takes all files that are there and ends; else it goes on watching.
    """
    schema = spark.read.format("binaryFile").load(path).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def keep(batch: DataFrame, number: int) -> None:
        rows = written(statements.cut_files(batch), "grid")
        found = load.from_grid(rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select(statements.KEY, "reason"))
        for name in TABLES:
            getattr(found, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    writer = files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read(spark: SparkSession, target: str, table: str) -> DataFrame:
    """One of TABLES, all batches."""
    return spark.read.parquet(f"{target}/{table}")
