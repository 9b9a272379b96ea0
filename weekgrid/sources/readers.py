"""Lenient CSV and Parquet readers and folder discovery through the cluster's file system."""

from __future__ import annotations

import csv
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import lenient_date, slug
from ..operators.cleaning import rename_variants
from ..session import stored
from . import records


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _path(spark, path)
    return system.exists(hadoop)


@dataclass(frozen=True)
class FileInfo:
    path: str
    size: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def stem(self) -> str:
        return self.name.rsplit(".", 1)[0]

    @property
    def kind(self) -> str:
        return self.name.rsplit(".", 1)[-1].lower() if "." in self.name else ""


def list_files(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("csv",), recursive: bool = True) -> list[FileInfo]:
    """Files under ``root`` by path. The list is metadata: its size is the number of files, not of rows."""
    hadoop, system = _path(spark, root)
    found = []
    files = system.listFiles(hadoop, recursive)
    while files.hasNext():
        status = files.next()
        info = FileInfo(status.getPath().toString(), status.getLen())
        if info.kind in kinds:
            found.append(info)
    return sorted(found, key=lambda f: f.path)


def list_children(spark: SparkSession, folder: str, kind: str = "csv") -> list[FileInfo]:
    """The direct children of a folder with that extension, files and folders alike, by path."""
    hadoop, system = _path(spark, folder)
    found = [FileInfo(s.getPath().toString(), s.getLen()) for s in system.listStatus(hadoop)]
    return sorted((f for f in found if f.kind == kind), key=lambda f: f.path)


#: Two quotes inside a quoted field are one; a backslash is a letter like others.
CSV = {"header": "true", "mode": "PERMISSIVE", "encoding": "UTF-8", "quote": '"', "escape": '"'}


def read_text_columns(spark: SparkSession, path: str | list[str], extra: str | None = None) -> DataFrame:
    """A CSV (a file, a folder or several of one header) with every column as text: nothing fails before it is cast.

    ``extra`` names one more column for what stands behind the last one. Where a quoted field holds a line break, records
    are cut by :mod:`records`; other files go through the plain reader.
    """
    begins, broken = records.blocks(spark, path)
    if not broken:
        reader = spark.read.options(**CSV)
        if extra is None:
            return reader.csv(path)
        names = reader.csv(path).columns
        return reader.schema(_text_schema([*names, _unused(names, extra)])).csv(path)
    rows = records.read_records(spark, path, begins)
    header = rows.filter("first").orderBy("path").select("record").first()
    # An unnamed or repeated column gets its place as its name, as the plain reader does.
    given = _names(header["record"] if header else "")
    names = [f"_c{i}" if not c else c if given.count(c) == 1 else f"{c}{i}" for i, c in enumerate(given)]
    names = names if extra is None else [*names, _unused(names, extra)]
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    parsed = F.from_csv("record", schema, {k: v for k, v in CSV.items() if k != "header"})
    return rows.filter("NOT first").select(parsed.alias("fields")).select("fields.*")


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def _unused(names: list[str], name: str) -> str:
    while name in names:
        name += "_"
    return name


def _plain_path(path: Column | str) -> Column:
    """Spark reports paths URL-encoded and with more slashes than the file system lists them."""
    return F.regexp_replace(F.url_decode(path), "^file:/+", "file:/")


def _flat(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def first_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line, n_lines) of every CSV under ``root``, in one distributed pass over the files."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(root)
    start = F.col("_metadata.file_block_start")
    place = F.struct(start.alias("start"), F.monotonically_increasing_id().alias("at"))
    rows = text.select(_plain_path(F.col("_metadata.file_path")).alias("path"), "value", place.alias("place"))
    return rows.groupBy("path").agg(F.min_by("value", "place").alias("line"), F.count(F.lit(1)).alias("n_lines"))


def _names(line: str | None) -> list[str]:
    """The column names of a header line."""
    return next(csv.reader([(line or "").lstrip("\ufeff")]), [])


def headers(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Column names by file, read where the files are; what comes back is metadata, a line for each file."""
    return {r["path"]: _names(r["line"]) for r in first_lines(spark, root).select("path", "line").collect()}


def cast_to(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the listed columns that exist; text that does not fit becomes null."""
    out = df
    for name, kind in types.items():
        if name in out.columns:
            value = lenient_date(name) if kind == "date" else F.col(f"`{name}`").try_cast(kind)
            out = out.withColumn(name, value)
    return out


def parse_rate(df: DataFrame, column: str) -> DataFrame:
    """Rows, failures and failure percent of a lenient date parse; above 1 percent deserves a look."""
    parsed = lenient_date(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(parsed.isNull()).alias("failed"),
        (F.avg(parsed.isNull().cast("double")) * 100).alias("failed_pct"),
    )


def standardize_columns(df: DataFrame) -> DataFrame:
    def clean(name: str) -> str:
        return name.strip().lower().replace(" ", "_").replace("-", "_").replace("/", "_").replace(".", "")

    return df.toDF(*[clean(c) for c in df.columns])


def load_backbone(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four required tables with canonical types; a missing one is an error."""
    tables = {}
    for name, schema in S.BACKBONE.items():
        path = f"{folder}/{name}.csv"
        if not exists(spark, path):
            raise FileNotFoundError(f"required table is missing: {path}")
        types = {f.name: f.dataType.simpleString() for f in schema.fields if not isinstance(f.dataType, T.StringType)}
        tables[name] = cast_to(read_text_columns(spark, path), types)
    if "date" in tables["games"].columns:
        tables["games"] = tables["games"].withColumnRenamed("date", "game_date")
    return tables


def detect_tables(spark: SparkSession, root: str, cache: str | None = None) -> dict[str, list[str]]:
    """Table name -> files, by header signature. Files of one folder with one header are one table, whole.

    Of tables in different folders, or with different headers, the one with the least path wins, and an ``_alt``
    signature fills a gap.

    ``cache`` names a JSON text file that is read when present and written otherwise.
    """
    if cache and exists(spark, cache):
        return json.loads("".join(r.value for r in spark.read.text(cache).collect()))
    parts: dict[tuple, list[str]] = {}
    for path, names in sorted(headers(spark, root).items()):
        if S.SKIPPED_PATH_PART not in path:
            parts.setdefault((path.rsplit("/", 1)[0], *names), []).append(path)
    found: dict[str, list[str]] = {}
    for (_, *names), paths in sorted(parts.items(), key=lambda item: item[1][0]):
        for name, needed in S.SIGNATURES.items():
            if needed <= set(names):
                found.setdefault(name, paths)
    tables: dict[str, list[str]] = {}
    for name in S.SIGNATURES:
        if name in found:
            tables.setdefault(name.split("_alt")[0], found[name])
    if cache:
        line = spark.createDataFrame([(json.dumps(tables),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(cache)
    return tables


def load_labels(spark: SparkSession, root: str, cache: str | None = None) -> dict[str, DataFrame]:
    """Interval, profile, transfer and value tables found under ``root``, renamed and typed."""
    return read_labels(spark, detect_tables(spark, root, cache))


def read_labels(spark: SparkSession, found: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The detected tables by canonical name, renamed and typed."""
    tables = {}
    for source, name in (("injuries", "injuries"), ("profiles", "profiles"), ("transfers", "transfers"), ("market_value", "market_values")):
        if source not in found:
            continue
        df = read_text_columns(spark, found[source])
        if name == "injuries":
            df = rename_variants(df, S.INTERVAL_NAMES)
        if name == "market_values":
            if "date" not in df.columns and "date_unix" in df.columns:
                df = df.withColumnRenamed("date_unix", "date")
            if "value" not in df.columns and "market_value_in_eur" in df.columns:
                df = df.withColumnRenamed("market_value_in_eur", "value")
        tables[name] = cast_to(df, S.LABEL_TYPES[name])
    return tables


KINDS = ("bigint", "double", "boolean", "date", "timestamp")  # tried in this order


def _read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as text; short lines are padded with nulls, lines with more fields than the header are left out.

    An empty field behind the last one (a comma at the end of the line) is no field.
    """
    rows = read_text_columns(spark, path, "_extra")
    extra = rows.columns[-1]
    return rows.filter(F.col(f"`{extra}`").isNull()).drop(extra)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the first kind that holds all their values, found in one pass; otherwise they stay text."""
    def fits(c: str, kind: str) -> Column:
        return F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull()) == 0

    if not df.columns:
        return df
    checks = [fits(c, kind).alias(f"{i}_{kind}") for i, c in enumerate(df.columns) for kind in KINDS]
    filled = [F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(df.columns)]
    row = df.agg(*checks, *filled).first()

    def typed(i: int, c: str) -> Column:
        kind = next((k for k in KINDS if row[f"{i}_n"] and row[f"{i}_{k}"]), None)
        return F.col(f"`{c}`").try_cast(kind).alias(c) if kind else F.col(f"`{c}`")

    return df.select(*[typed(i, c) for i, c in enumerate(df.columns)])


def load_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """One CSV (lines with too many fields left out) or Parquet table, optionally its first ``rows`` rows."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = infer_types(_read_ragged(spark, path))
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported extension: {kind}")
    return df if rows is None else df.limit(rows)


#: A field of a record behind a comma: quoted, with what stands behind its closing quote, or plain.
FIELD = r',("[^"]*(?:""[^"]*)*"[^,]*|[^,]*)'
LOG = "table string, status string, n_rows bigint, n_columns bigint, skipped bigint, note string"


def load_log(spark: SparkSession, folder: str) -> DataFrame:
    """(table, status, n_rows, n_columns, skipped, note) of every CSV of a folder, from passes over all files together.

    Files are dealt to tasks, and one that can't be read ends neither the others nor the job: its table has failed. ``skipped``: records
    with more fields than the header.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], LOG)
    children = list_children(spark, folder)
    if not children:
        return spark.createDataFrame([], LOG)
    base, system = _path(spark, folder)
    prefix = system.getFileStatus(base).getPath().toString().rstrip("/")
    sizes = {c.name: 0 for c in children}
    files = system.listFiles(base, True)
    while files.hasNext():
        status = files.next()
        rest = status.getPath().toString()[len(prefix) + 1 :].split("/")
        if rest[0] in sizes and not rest[-1].startswith(("_", ".")):
            sizes[rest[0]] += status.getLen()
    known = spark.createDataFrame([(c.name, c.stem, sizes[c.name]) for c in children], "child string, table string, size long")
    options = {"ignoreCorruptFiles": "true", "recursiveFileLookup": "true"}
    paths = [c.path for c in children]
    begins, _ = records.blocks(spark, paths, **options)
    inside = F.substring(_plain_path("path"), F.lit(len(_flat(prefix)) + 2), F.lit(1 << 20))
    found = records.read_records(spark, paths, begins, **options).select(
        "path", F.split_part(inside, F.lit("/"), F.lit(1)).alias("child"), "first", F.regexp_count(F.concat(F.lit(","), "record"), F.lit(FIELD)).alias("fields"),
        F.col("record").endswith(",").alias("open_end"),
    )
    heads = found.filter("first").select("path", F.col("fields").alias("width"))
    # An empty field behind the last one is no field.
    extra = F.col("fields") > F.col("width") + F.when(F.col("open_end"), 1).otherwise(0)
    counted = found.join(heads, "path").groupBy("child").agg(
        F.count_if(~F.col("first") & ~extra).alias("n_rows"), F.max("width").cast("bigint").alias("n_columns"), F.count_if(~F.col("first") & extra).alias("skipped")
    )
    note = F.when(F.col("n_columns").isNotNull(), "").when(F.col("size") == 0, "empty").otherwise("unreadable")
    zero = F.lit(0).cast("bigint")
    return known.join(counted, "child", "left").select(
        "table", F.when(F.col("n_columns").isNotNull(), "loaded").otherwise("failed").alias("status"), F.coalesce("n_rows", zero).alias("n_rows"),
        F.coalesce("n_columns", zero).alias("n_columns"), F.coalesce("skipped", zero).alias("skipped"), note.alias("note"),
    )


def load_all_csvs(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every CSV of a folder that loads, by stem (a file, or a folder of parts named like one), and the log of all of them."""
    log = stored(load_log(spark, folder))
    loaded = {r["table"] for r in log.filter("status = 'loaded'").select("table").collect()}
    tables = {info.stem: load_table(spark, info.path) for info in list_children(spark, folder) if info.stem in loaded} if loaded else {}
    return tables, log


def discover_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(dataset_id, dataset, table, path, format) for every CSV and Parquet under the non-hidden children."""
    if not exists(spark, root):
        return spark.createDataFrame([], "dataset_id string, dataset string, table string, path string, format string")
    base = _path(spark, root)
    prefix = base[1].getFileStatus(base[0]).getPath().toString().rstrip("/") + "/"
    rows = []
    for info in list_files(spark, root, ("csv", "parquet")):
        child, _, rest = info.path[len(prefix):].partition("/")
        if child.startswith("."):
            continue
        rows.append((child if rest else info.stem, info.stem, info.path, info.kind))
    found = spark.createDataFrame(rows, "dataset string, table string, path string, format string")
    return found.select(slug("dataset").alias("dataset_id"), "dataset", "table", "path", "format")


def header_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Per CSV: columns, size and data rows (line breaks less the header), found where the data is."""
    described = spark.createDataFrame([(f.path, f.size) for f in list_files(spark, root)], "path string, size_bytes long")
    lines = first_lines(spark, root).withColumnRenamed("path", "_p")
    joined = described.join(lines, F.regexp_replace("path", "^file:/+", "file:/") == F.col("_p"), "left")
    # Names by the rules of CSV: a quoted name may hold commas and doubled quotes.
    field = F.regexp_extract_all(F.concat(F.lit(","), F.ltrim("line", F.lit("\ufeff"))), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    names = F.transform(field, lambda c: F.replace(F.regexp_replace(c, '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    names = F.when(F.coalesce(F.length("line"), F.lit(0)) > 0, names).otherwise(F.array().cast("array<string>"))
    return joined.select(
        "path", F.size(names).alias("n_cols"), names.alias("cols"), "size_bytes",
        F.greatest(F.lit(0), F.coalesce("n_lines", F.lit(0)) - 1).cast("bigint").alias("n_rows"),
    )
