"""Session settings and the shared folder used for cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC keeps date truncation independent of the machine; AQE supplies runtime broadcast,
# partition coalescing and skew-join splitting, which the operators rely on instead of hints.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(app: str = "weekgrid", cores: str | int = "*", **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, and only on a local
    master, is a temporary folder made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.environ.get("WEEKGRID_LOCAL_DIR")
        if not folder:
            folder = os.environ["WEEKGRID_LOCAL_DIR"] = tempfile.mkdtemp(prefix="weekgrid-")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at the files.

    For results that several passes read. Unlike a cache it outlives executors, and the copies are pruned and
    filtered like any table.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """Like ``stored``, as a table in buckets of ``key``, so that joins by it leave its rows where they are; also its name, for who drops it.

    Dropping the table takes its name out of the catalogue, the files stay as those of ``stored`` do.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path, buckets = f"{shared_dir(spark).rstrip('/')}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name), name
