"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: list[str] = []


def session(name: str = "tarazu", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's plans count on; a running session is used as it is."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that may not find it on their path; once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tarazu-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)


def written(df: DataFrame, label: str) -> DataFrame:
    """A table written in the folder that all machines share, and read back: the plan and its lineage end there."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", "")
    if not folder and df.sparkSession.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not folder:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ledger-"))
        folder = _own[0]
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame, label: str) -> DataFrame:
    """written(), for tables that grow with the statements: joins shuffle them.

    Words and rules repeat their values, so their files weigh a small part of their rows; by the files' weight Spark
    would gather millions of rows in the driver for a broadcast.
    """
    return written(df, label).hint("merge")
