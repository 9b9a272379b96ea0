"""Small helpers of the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filled(text: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` would also change other scripts."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lowered(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased: ``bytes.lower`` leaves everything else alone."""
    return (text or "").encode().lower()


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, so that extra columns of the caller never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, rows: int = 4096) -> DataFrame:
    """Apply a generator of row dicts to the partitions of ``df``; ``rows`` of its output travel together."""

    def run(batches):
        kind, kept = None, []
        for row in fn(batches):
            kept.append(row)
            if len(kept) == rows:
                kind = kind or arrow_schema(schema)
                yield pa.RecordBatch.from_pylist(kept, schema=kind)
                kept = []
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema=kind or arrow_schema(schema))

    return df.mapInArrow(run, schema)


#: Arrow's types for the names used in the schemas of this package.
KINDS = {
    "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "double": pa.float64(), "boolean": pa.bool_(),
}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic regression on few rows; the first column is the constant, ``y`` may be probabilities."""
    share = np.full(len(y), 1 / len(y)) if weights is None else weights / weights.sum()
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
