"""Risk model on the panel: weighting, boosting with calibration, resampling, importance, controls.

The boosted trees are :mod:`boosting`, calibration and baselines Spark ML; everything around them (weights, holdouts, draws, permutations,
metrics) is DataFrame work with hash-based draws, so reruns and recomputed partitions agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import HASH_BITS, ratio, stable_hash
from ..session import stored
from . import boosting, cleaning, ranking, sampling
from .boosting import Booster
from .features import KEY, WEEK

ROW_KEY = [KEY, WEEK, "season"]
SCORE = "raw_score"
RISK = "pred_risk"


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Positives weigh negatives / positives, negatives 1."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("_neg"), F.greatest(F.lit(1), F.count_if(F.col(label) == 1)).alias("_pos")
    )
    weight = F.when(F.col(label) == 1, F.col("_neg") / F.col("_pos")).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", weight).drop("_neg", "_pos")  # one row


def balanced_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Each class weighs rows / (2 * class rows)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), F.greatest(F.lit(1), F.count_if(F.col(label) == 1)).alias("_pos"),
        F.greatest(F.lit(1), F.count_if(F.col(label) == 0)).alias("_neg"),
    )
    weight = F.col("_n") / (F.lit(2.0) * F.when(F.col(label) == 1, F.col("_pos")).otherwise(F.col("_neg")))
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", weight).drop("_n", "_neg", "_pos")  # one row


def holdout(df: DataFrame, fraction: float, keys: Sequence[str], seed: object) -> Column:
    return stable_hash(list(keys), seed) < F.lit(int(fraction * 2**HASH_BITS))


@dataclass(frozen=True)
class Settings:
    learning_rate: float = 0.05
    max_iter: int = 500
    max_depth: int = 6
    max_leaves: int = 31
    min_rows: int = 20
    max_bins: int = 255
    holdout_fraction: float = 0.1
    patience: int = 20
    tolerance: float = 1e-7
    seed: int = 42


@dataclass(frozen=True)
class Calibrator:
    """Steps of the isotonic fit, linear in between; scores outside are clipped."""

    scores: np.ndarray
    risks: np.ndarray

    def column(self, spark, score: Column) -> Column:
        sent = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def risk(column: pa.Array) -> pa.Array:
            own = sent.value
            if not len(own.scores):
                return pa.nulls(len(column), pa.float64())
            return pa.array(np.interp(column.to_numpy(zero_copy_only=False), own.scores, own.risks))

        return risk(score)


@dataclass(frozen=True)
class FittedRisk:
    model: Booster
    calibrator: Calibrator
    features: list[str]


def _vector(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    frame = cleaning.aligned(df, features, keep)
    return VectorAssembler(inputCols=features, outputCol="features").transform(frame).select(*keep, "features")


def fit_booster(train: DataFrame, features: list[str], settings: Settings = Settings(), label: str = "target") -> Booster:
    """Weighted boosted trees that stop early on a hashed holdout."""
    weighted = class_weights(train, label).withColumn("_held", holdout(train, settings.holdout_fraction, ROW_KEY, settings.seed))
    frame = cleaning.aligned(weighted, features, [label, "weight", "_held"])
    return boosting.fit(
        frame, features, label, "weight", "_held", settings.max_iter, settings.max_depth, settings.max_leaves, settings.learning_rate,
        settings.max_bins, settings.patience, settings.tolerance, settings.min_rows,
    )


def raw_scores(df: DataFrame, model: Booster | Model, features: list[str], keep: list[str]) -> DataFrame:
    if isinstance(model, Booster):
        frame = cleaning.aligned(df, features, keep)
        return frame.select(*keep, boosting.score_column(df.sparkSession, model, F.array(*[F.col(f"`{c}`") for c in features])).alias(SCORE))
    scored = model.transform(_vector(df, features, keep))
    return scored.select(*keep, vector_to_array("probability").getItem(1).alias(SCORE))


def fit_calibrator(scored: DataFrame, label: str = "target") -> Calibrator:
    """Isotonic regression over (score, mean label, rows): equal scores are merged before it pools."""
    pooled = scored.groupBy(SCORE).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    fitted = IsotonicRegression(featuresCol=SCORE, labelCol="label", weightCol="weight", isotonic=True).fit(pooled)
    return Calibrator(fitted.boundaries.toArray(), fitted.predictions.toArray())


def calibrated(df: DataFrame, fit: FittedRisk, keep: list[str]) -> DataFrame:
    """Rows with ``raw_score`` and the calibrated ``pred_risk`` (scores outside the fitted range are clipped)."""
    scored = raw_scores(df, fit.model, fit.features, keep)
    return scored.withColumn(RISK, fit.calibrator.column(df.sparkSession, F.col(SCORE)))


def fit_risk(split: DataFrame, features: list[str], settings: Settings = Settings(), label: str = "target") -> FittedRisk:
    """Fit on split = train, calibrate on split = valid."""
    model = fit_booster(split.filter(F.col("split") == "train"), features, settings, label)
    valid = raw_scores(split.filter(F.col("split") == "valid"), model, features, [label])
    return FittedRisk(model, fit_calibrator(valid, label), list(features))


def tie_key() -> Column:
    """A number that orders rows by player, week, season: side by side in one decimal, so that no id overflows it."""
    day = F.unix_date(WEEK) + 5_000_000  # not negative for any date
    parts = F.col(KEY).cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")
    return (parts + day.cast("decimal(8,0)") * F.lit(10**5).cast("decimal(6,0)") + F.col("season").cast("decimal(5,0)")).cast("decimal(38,0)")


def evaluate(split: DataFrame, fit: FittedRisk, label: str = "target") -> DataFrame:
    test = split.filter(F.col("split") == "test").withColumn("_tie", tie_key())
    return ranking.evaluation(calibrated(test, fit, [label, "_tie"]), label, RISK, "_tie")


def split_manifest(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("target").alias("prevalence"),
        F.min(WEEK).alias("first_week"), F.max(WEEK).alias("last_week"),
    )


def score_player(
    panel: DataFrame, fit: FittedRisk, categories: list[str], player_id: int, include_ineligible: bool = False,
    split: str | None = None, tail: int = 60, valid_from: str | None = None, test_from: str | None = None,
) -> DataFrame:
    """Calibrated risk of one player's observable weeks, the last ``tail`` of them."""
    rows = panel.filter(
        (F.col(KEY) == player_id) & (F.col("not_censored") == 1) & (F.col("active_player") == 1) & (F.col("label_known") == 1)
    )
    if not include_ineligible:
        rows = rows.filter(F.col("ineligible") == 0)
    if split:
        dates = {k: v for k, v in {"valid_from": valid_from, "test_from": test_from}.items() if v}
        rows = cleaning.with_split(rows, **dates).filter(F.col("split") == split)
    keep = [KEY, WEEK, "target", "ineligible"]
    scored = calibrated(cleaning.with_dummies(rows, categories), fit, keep)
    return sampling.tail_rows(scored.select(*keep, RISK), [WEEK], tail)


# --- resampling ---------------------------------------------------------------------------------------


DRAWS = 1 << 20  # draws that one task makes at a time
CELL = 1 << 23  # draws, on average, that one task of a block of keys holds
WIDEST = 1 << 16  # keys of a block at most, so that a place in it has two bytes


def _numbered(keys: DataFrame, key: str) -> DataFrame:
    """(key, _index): the distinct keys with dense numbers from exact running counts."""
    distinct = keys.select(key).distinct().withColumn("_one", F.lit(1))
    return ranking.running_totals(distinct, key, ["_one"]).select(key, (F.col("cum__one") - 1).alias("_index"))


def _places(total: int, seed: object, width: int, step: int):
    """Draws as (rep, _block, places): of ``step`` draws of a replicate, those that fall into one block of ``width`` keys, two bytes each."""
    salt = str(seed)

    def make(batches):
        for batch in batches:
            for rep, first in zip(batch.column("rep").to_pylist(), batch.column("first").to_pylist()):
                begin = f"{salt}|{rep}|".encode()
                last = min(first + step, total)
                # The hash of functions.scalars.stable_hash: 13 hex digits of an MD5 digest.
                drawn = np.fromiter((int.from_bytes(md5(begin + b"%d" % i).digest()[:7]) >> 4 for i in range(first, last)), np.int64, last - first) % total
                drawn.sort()
                block = drawn // width
                at = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
                place = (drawn - block * width).astype("<u2")
                yield pa.RecordBatch.from_pydict({
                    "rep": pa.array([rep] * (len(at) - 1), pa.int32()), "_block": pa.array(block[at[:-1]], pa.int64()),
                    "places": pa.array([place[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary()),
                })

    return make


def _drawn_counts(width: int):
    """Rows and positives by (replicate, score) of one block of keys: each cell as often as its key was drawn."""

    def count(cells: pa.Table, drawn: pa.Table) -> pa.Table:
        score, n, pos, place = (cells.column(c).to_numpy() for c in ("score", "n", "pos", "_place"))
        known = cells.column("score").is_valid().to_numpy()
        scores, own = np.unique(score[known], return_inverse=True)
        code = np.full(len(score), len(scores), np.int64)  # a missing score is a score of its own, the last
        code[known] = own
        scores = np.append(scores, np.nan)
        out: list[tuple] = []
        order = np.argsort(drawn.column("rep").to_numpy(), kind="stable")
        reps, held = drawn.column("rep").to_numpy()[order], drawn.column("places").to_pylist()
        at = np.concatenate([[0], np.flatnonzero(np.diff(reps)) + 1, [len(reps)]]) if len(reps) else [0]
        for x, y in zip(at[:-1], at[1:]):
            times = np.bincount(np.frombuffer(b"".join(held[i] for i in order[x:y]), "<u2"), minlength=width)[place]
            # Sums of whole numbers below 2**53: exact.
            rows = np.bincount(code, times * n, len(scores)).astype(np.int64)
            hits = np.bincount(code, times * pos, len(scores)).astype(np.int64)
            some = np.flatnonzero(rows)
            out.append((np.full(len(some), reps[x], np.int32), some, rows[some], hits[some]))
        rep, some, rows, hits = (np.concatenate(c) for c in zip(*out)) if out else (np.array([], np.int64) for _ in range(4))
        found = pa.array(scores[some], pa.float64(), mask=some == len(scores) - 1)
        return pa.table({"rep": pa.array(rep, pa.int32()), "score": found, "n": pa.array(rows, pa.int64()), "pos": pa.array(hits, pa.int64())})

    return count


def _draw_tasks(spark: SparkSession, total: int, replicates: int, seed: object, width: int) -> DataFrame:
    chunks = -(-total // DRAWS)
    jobs = spark.range(replicates * chunks).select(
        (F.col("id") % replicates).cast("int").alias("rep"), (F.floor(F.col("id") / replicates) * DRAWS).alias("first")
    )
    return jobs.mapInArrow(_places(total, seed, width, DRAWS), "rep int, _block long, places binary")


def draws(keys: DataFrame, key: str, replicates: int, seed: object) -> DataFrame:
    """(rep, key, times): as many draws with replacement per replicate as there are distinct keys.

    Keys get dense numbers from exact running counts; each draw is a hash of (replicate, draw number), so
    all replicates are made in one distributed range and none is looped over.
    """
    numbered = stored(_numbered(keys, key))
    made = _draw_tasks(keys.sparkSession, numbered.count(), replicates, seed, WIDEST)
    single = made.mapInArrow(_unpacked, "rep int, _index long")
    return single.groupBy("rep", "_index").agg(F.count(F.lit(1)).alias("times")).join(numbered, "_index").select("rep", key, "times")


def _unpacked(batches):
    """(rep, _index) of every draw."""
    for batch in batches:
        for rep, block, places in zip(*(batch.column(c).to_pylist() for c in ("rep", "_block", "places"))):
            index = np.frombuffer(places, "<u2").astype(np.int64) + block * WIDEST
            yield pa.RecordBatch.from_pydict({"rep": pa.array(np.full(len(index), rep, np.int32)), "_index": pa.array(index)})


def bootstrap_metrics(
    scored: DataFrame, label: str, score: str, key: str, replicates: int, seed: object = 42, share: float = 0.05
) -> DataFrame:
    """Metrics per replicate when ``key`` groups are drawn with replacement (a row key gives the row bootstrap).

    Rows are reduced to (key, score) counts first; replicates without positives are left out. Keys lie in blocks of their numbers. Draws travel
    as their places in the blocks, two bytes each, and meet the counts of a block in one task, which returns sums by (replicate, score):
    (key, replicate) pairs are never rows. Only the number of keys reaches the driver.
    """
    cells = ranking.score_counts(scored, label, score, [key])
    numbered = stored(_numbered(scored, key))
    width = max(1, min(WIDEST, CELL // replicates))
    held = cells.join(numbered, key).select(
        F.floor(F.col("_index") / width).alias("_block"), (F.col("_index") % width).alias("_place"), "score", "n", F.coalesce("pos", F.lit(0)).alias("pos")
    )
    made = _draw_tasks(scored.sparkSession, numbered.count(), replicates, seed, width)
    sums = held.groupBy("_block").cogroup(made.groupBy("_block")).applyInArrow(_drawn_counts(width), "rep int, score double, n long, pos long")
    # Written once: the curve and the top share read it several times.
    counts = stored(sums.groupBy("rep", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    curve = ranking.curve_metrics(counts, ["rep"])
    top = ranking.expected_top_share(counts, share, ["rep"]).select("rep", "precision_top")
    return curve.join(top, "rep").filter(F.col("positives") > 0).select(
        "rep", "rows", "positives", "average_precision", "pr_auc_trap", "precision_top"
    )


def intervals(replicates: DataFrame, metrics: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and interpolated percentile interval per metric; one row per replicate comes in."""
    row = replicates.agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.percentile(m, F.array(F.lit(low), F.lit(high))).alias(f"{m}_ci") for m in metrics],
    )
    entries = [
        F.struct(
            F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_ci").getItem(0).alias("lower"),
            F.col(f"{m}_ci").getItem(1).alias("upper"),
        )
        for m in metrics
    ]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


# --- permutation importance ---------------------------------------------------------------------------


def permutation_importance(
    df: DataFrame, model: Booster, features: list[str], sample: int = 10_000, repeats: int = 10, seed: int = 42,
    label: str = "target",
) -> DataFrame:
    """Mean and spread of the drop in average precision when one feature is permuted.

    The sample has a fixed size, so a permutation is a ranking of ``sample`` rows; all (feature, repeat) copies are
    scored in one batch and evaluated in one grouped aggregation.
    """
    from pyspark.sql import Window

    rows = sampling.sample_rows(df, sample, ROW_KEY, seed)
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    order = Window.orderBy(stable_hash(ROW_KEY, seed), *ROW_KEY)  # bounded by the sample size
    base = rows.select(F.row_number().over(order).alias("_i"), F.col(label).alias("label"), values.alias("_x"))
    base = base.persist()
    copies = base.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    shuffled = Window.partitionBy("_f", "_r").orderBy(stable_hash(["_f", "_r", "_i"], seed), "_i")
    moved = copies.select(
        "_f", "_r", F.row_number().over(shuffled).alias("_i"), F.element_at("_x", F.col("_f") + 1).alias("_v")
    )
    replaced = moved.join(base, "_i").withColumn(
        "_x", F.transform("_x", lambda x, i: F.when(i == F.col("_f"), F.col("_v")).otherwise(x))
    )
    plain = base.select(F.lit(-1).alias("_f"), F.lit(0).alias("_r"), "label", "_x")
    batch = plain.unionByName(replaced.select("_f", "_r", "label", "_x"))
    scored = batch.select("_f", "_r", "label", boosting.score_column(df.sparkSession, model, F.col("_x")).alias(SCORE))
    counts = ranking.score_counts(scored, "label", SCORE, ["_f", "_r"])
    precision = ranking.curve_metrics(counts, ["_f", "_r"]).select("_f", "_r", "average_precision")
    reference = precision.filter(F.col("_f") < 0).agg(F.max("average_precision").alias("_base"))
    drops = precision.filter(F.col("_f") >= 0).crossJoin(F.broadcast(reference))  # one row
    drop = F.col("_base") - F.col("average_precision")
    names = F.array(*[F.lit(c) for c in features])
    return drops.groupBy("_f").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_std")).select(
        F.element_at(names, F.col("_f") + 1).alias("feature"), "importance", "importance_std",
        F.lit(repeats).alias("n_repeats"), F.lit("average_precision").alias("scoring"),
    )


# --- negative control ---------------------------------------------------------------------------------


def shuffled_labels(df: DataFrame, seed: object, label: str = "target", keys: Sequence[str] = tuple(ROW_KEY)) -> DataFrame:
    """A uniform permutation of a 0/1 label: as many positives, given to the rows with the smallest hashes."""
    positives = F.count_if(F.col(label) == 1)
    threshold = sampling.hash_threshold(df, positives, list(keys), seed)
    hashed = sampling.with_hash(df, list(keys), seed).crossJoin(F.broadcast(threshold))  # one row
    return hashed.withColumn(label, (F.col(sampling.HASH) <= F.col("_threshold")).cast("int")).drop(
        sampling.HASH, "_threshold"
    )


def negative_control(split: DataFrame, features: list[str], settings: Settings = Settings(), fitter=fit_risk) -> DataFrame:
    """Fit and calibrate on permuted labels; test precision should fall to prevalence."""
    def part(name: str) -> DataFrame:
        return split.filter(F.col("split") == name)

    mixed = shuffled_labels(part("train"), 1).unionByName(shuffled_labels(part("valid"), 2)).unionByName(part("test"))
    fit = fitter(mixed, features, settings)
    test = calibrated(part("test"), fit, [*ROW_KEY, "target"])
    honest = ranking.curve_metrics(ranking.score_counts(test, "target", RISK))
    mixed_test = ranking.curve_metrics(ranking.score_counts(shuffled_labels(test, 3), "target", RISK))
    wanted = ["average_precision", "pr_auc_trap"]
    return honest.select(
        *[F.col(c).alias(f"train_shuffled_{c}") for c in wanted],
        ratio(F.col("positives"), F.col("rows")).alias("test_prevalence"),
    ).crossJoin(F.broadcast(mixed_test.select(*[F.col(c).alias(f"test_label_shuffled_{c}") for c in wanted])))  # one row each


# --- simple baselines ---------------------------------------------------------------------------------


def logistic_baseline(train: DataFrame, features: list[str], label: str = "target", max_iter: int = 1000) -> Model:
    vectors = _vector(balanced_weights(train, label).withColumn(label, F.col(label).cast("double")), features, [label, "weight"])
    return LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter).fit(vectors)


#: Partitions of the rows that Spark ML grows trees on. A level of a tree is a job of two stages with a task for each of them, and every task's result
#: reaches the driver with its counters, and that of the first stage names all tasks of the second.
TREE_PARTITIONS = 32


def tree_rows(train: DataFrame, features: list[str], label: str = "target") -> DataFrame:
    """Weighted rows of features and label in at most ``TREE_PARTITIONS`` partitions; they are written once, so that what makes them stays as parallel as it is."""
    weighted = balanced_weights(train, label).withColumn(label, F.col(label).cast("double"))
    rows = stored(cleaning.aligned(weighted, features, [label, "weight"]))
    return _vector(rows.coalesce(TREE_PARTITIONS), features, [label, "weight"])


def tree_baseline(train: DataFrame, features: list[str], label: str = "target", trees: int = 100, boosted: bool = True) -> Model:
    vectors = tree_rows(train, features, label)
    if boosted:
        return GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=5, stepSize=0.1, seed=42).fit(vectors)
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=8, seed=42).fit(vectors)


def baseline_metrics(test: DataFrame, model: Model, features: list[str], name: str, label: str = "target") -> DataFrame:
    scored = raw_scores(test, model, features, [label])
    curve = ranking.curve_metrics(ranking.score_counts(scored, label, SCORE))
    return curve.select(F.lit(name).alias("model"), "roc_auc", F.col("average_precision").alias("pr_auc"), "brier")


def tree_importances(spark, model: Model, features: list[str], top: int = 20) -> DataFrame:
    """Impurity importances, largest first: as many numbers as there are features."""
    pairs = sorted(zip(features, (float(v) for v in model.featureImportances.toArray())), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame(pairs[:top], "feature string, importance double")
