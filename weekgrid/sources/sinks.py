"""Table, artifact and stage sinks."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Canonical tables as Parquet, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


#: Files that a task of a partitioned write keeps open, and the bytes of a row group in each.
WRITERS, GROUP = 64, 1 << 25


def write_panel(panel: DataFrame, path: str, partition: str | None = "season") -> None:
    """The panel as Parquet, one directory per season.

    A task keeps a file open for each season that it meets, so rows are neither shuffled nor sorted to be written. Beyond ``WRITERS``
    seasons Spark sorts the rest of the task's rows.
    """
    if not partition:
        panel.write.mode("overwrite").parquet(path)
        return
    conf, name = panel.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, WRITERS)
    try:
        panel.write.mode("overwrite").option("parquet.block.size", GROUP).partitionBy(partition).parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def write_lookup_panel(panel: DataFrame, path: str, key: str = "player_id", group: int = 1 << 20, ranged: bool = False) -> None:
    """The panel laid out for reading single entities: files by range of the key, sorted inside, with Bloom filters of the key.

    A reader of one entity skips files and row groups by their key ranges, and those whose range holds the key by the filter. ``group``: bytes of a row group;
    ``ranged``: the rows come so already, else they are dealt by season and key.
    """
    layout = panel if ranged else panel.repartitionByRange("season", key).sortWithinPartitions("season", key, "week_start")
    filters = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(group)}
    layout.write.mode("overwrite").options(**filters).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(metrics: DataFrame, path: str) -> None:
    """A small metrics table as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def head_records(df: DataFrame, n: int = 100) -> DataFrame:
    """First n rows as JSON objects; nulls and NaN stay as explicit nulls."""
    columns = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.limit(n).select(record.alias("record"))


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, name string, type string"
    )


# --- stages -------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def code_version() -> str:
    """A digest of this package's sources: a plan names Python functions, but doesn't hold them."""
    root = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for file in sorted(root.rglob("*.py")):
        digest.update(f"{file.relative_to(root)}\n".encode() + file.read_bytes())
    return digest.hexdigest()


def plan_text(df: DataFrame) -> str:
    """The analyzed plan, with expression ids and the generated names of lambda variables numbered by their first appearance."""
    conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(name, None)
    conf.set(name, 1_000_000)
    try:
        text = df._jdf.queryExecution().analyzed().toString()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    names: dict[str, int] = {}
    for own in re.findall(r"lambda (\w+)#", text):
        names.setdefault(own, len(names))
    ids: dict[str, int] = {}
    text = re.sub(r"\b(\w+)#", lambda m: f"lambda_{names[m[1]]}#" if m[1] in names else m[0], text)
    return re.sub(r"#(\d+)", lambda m: f"#{ids.setdefault(m[1], len(ids))}", text)


def input_listing(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files that a plan reads, one listing for each folder."""
    spark = df.sparkSession
    files = set(df.inputFiles())
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            uri = status.getPath().toUri().toString()
            if not status.isDirectory() and (uri in files or uri.replace("file:/", "file:///", 1) in files):
                found.append((uri, status.getLen(), status.getModificationTime()))
    return sorted(found)


def fingerprint(df: DataFrame, *settings: object) -> str:
    """What a result depends on: its plan, the files it reads, the code, and the settings the plan doesn't show.

    Rows held in memory have no name that would tell them apart, so a plan over such rows never equals another one.
    """
    text = plan_text(df)
    memory = uuid.uuid4().hex if re.search(r"LogicalRDD|LocalRelation|ExternalRDD", text) else ""
    parts = [text, repr(df.schema.simpleString()), repr(input_listing(df)), code_version(), repr(settings), memory]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


class Published:
    """Folders that appear complete or not at all: written beside their place and put there by one rename."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, system = self._hadoop(f"{self.folder}/{name}")
        return system.exists(path)

    def publish(self, name: str, write: Callable[[str], None]) -> str:
        """The path of ``name``, written by ``write(path)`` unless somebody else has been first."""
        target, staged = f"{self.folder}/{name}", f"{self.folder}/.staged-{uuid.uuid4().hex}"
        write(staged)
        path, system = self._hadoop(target)
        system.mkdirs(path.getParent())
        # A rename into an existing folder would nest in it: who comes second leaves the first one's result.
        if system.exists(path) or not system.rename(self._hadoop(staged)[0], path):
            system.delete(self._hadoop(staged)[0], True)
        return target


class StageStore:
    """Step outputs kept as Parquet under one folder, by stage and by the fingerprint of what they are made from.

    A stage is reused while its plan, the files it reads and the code are the same. Stages that it builds on are among these files, under
    names that hold their own fingerprints; so a changed input changes the name of everything that hangs on it, and of
    nothing else. ``built`` and ``reused`` tell what this store did.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.files = Published(spark, self.folder)
        self.built: list[str] = []
        self.reused: list[str] = []
        self.current: dict[str, str] = {}

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def keys(self, stage: str) -> list[str]:
        """The keys kept for a stage, the latest first."""
        path, system = self.files._hadoop(self.path(stage))
        if not system.exists(path):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(path) if s.isDirectory()]
        return [name for _, name in sorted(found, reverse=True)]

    def stages(self, folder: str) -> list[str]:
        """The stages kept below a folder of the store."""
        path, system = self.files._hadoop(self.path(folder))
        if not system.exists(path):
            return []
        return sorted(f"{folder}/{s.getPath().getName()}" for s in system.listStatus(path) if s.isDirectory())

    def has(self, stage: str) -> bool:
        return stage in self.current or bool(self.keys(stage))

    def get(
        self, stage: str, build: Callable[[], DataFrame], *settings: object, write: Callable[[DataFrame, str], None] | None = None
    ) -> DataFrame:
        """The stage as ``build`` describes it, computed unless it is there. ``settings``: what its plan doesn't show; ``write``: its layout."""
        df = build()
        key = fingerprint(df, stage, *settings)
        if self.files.exists(f"{stage}/{key}"):
            self.reused.append(stage)
        else:
            self.files.publish(f"{stage}/{key}", (lambda path: write(df, path)) if write else df.write.option("compression", "zstd").parquet)
            self.built.append(stage)
        self.current[stage] = key
        return self.load(stage)

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        return self.get(stage, lambda: df)

    def load(self, stage: str) -> DataFrame:
        """The stage as this store has got it last, else the latest kept one."""
        key = self.current.get(stage) or next(iter(self.keys(stage)), None)
        if key is None:
            raise FileNotFoundError(f"missing stage {stage}: run it first")
        return self.spark.read.parquet(f"{self.path(stage)}/{key}")
