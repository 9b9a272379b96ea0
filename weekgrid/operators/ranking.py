"""Exact global order statistics without a global sort in one task.

Rows are first counted per distinct value, so repeated values cost one row per map task. When the distinct
values are many, cut points from one approximate-percentile pass (one number for each ROWS_PER_BUCKET distinct values,
fixed on the driver so that every use sees the same ones) split the value range into buckets of similar size; running
counts are then local to a bucket plus the bucket's offset. The cut points only balance the work: results
are exact whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

ROWS_PER_BUCKET = 200_000
BUCKET = "_bucket"


def _cut_points(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Interior bucket limits per column, as many as keep a bucket near ROWS_PER_BUCKET distinct values."""
    sizes = df.agg(*[F.approx_count_distinct(c).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    wanted = {c: sizes[f"n_{i}"] // ROWS_PER_BUCKET for i, c in enumerate(columns)}
    asked = [c for c in columns if wanted[c]]
    if not asked:
        return {c: [] for c in columns}
    aggregates = []
    for i, c in enumerate(asked):
        points = F.array(*[F.lit(k / (wanted[c] + 1)) for k in range(1, wanted[c] + 1)])
        aggregates.append(F.percentile_approx(F.col(c).cast("double"), points, max(10_000, wanted[c] * 20)).alias(f"p_{i}"))
    row = df.agg(*aggregates).first()
    found = {c: row[f"p_{i}"] or [] for i, c in enumerate(asked)}
    return {c: sorted({v for v in found.get(c, []) if v is not None and math.isfinite(v)}) for c in columns}


def _with_buckets(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    split = {c: [-math.inf, *v, math.inf] for c, v in cuts.items() if v}
    out = df
    if split:
        out = Bucketizer(
            inputCols=list(split), outputCols=[f"{BUCKET}_{c}" for c in split], splitsArray=list(split.values()),
            handleInvalid="keep",
        ).transform(df)
    return out.withColumns({f"{BUCKET}_{c}": F.lit(0.0) for c in cuts if c not in split})


def running_totals(
    counted: DataFrame, value: str, measures: Sequence[str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """``counted`` has one row per (by, value). Adds ``cum_<measure>``: the total up to and including the row."""
    cuts = _cut_points(counted, [value])
    bucketed = _with_buckets(counted, cuts).withColumnRenamed(f"{BUCKET}_{value}", BUCKET)
    if descending:
        bucketed = bucketed.withColumn(BUCKET, -F.col(BUCKET))
    return _running(bucketed, value, measures, by, descending, single=not cuts[value])


def _running(bucketed, value, measures, by, descending, single) -> DataFrame:
    order = F.desc(value) if descending else F.asc(value)
    local = Window.partitionBy(*by, BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = bucketed.withColumns({f"cum_{m}": F.sum(m).over(local) for m in measures})
    if single:
        return out.drop(BUCKET)
    totals = bucketed.groupBy(*by, BUCKET).agg(*[F.sum(m).alias(m) for m in measures])
    ahead = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket and group.
    offsets = totals.select(*by, BUCKET, *[F.coalesce(F.sum(m).over(ahead), F.lit(0)).alias(f"_off_{m}") for m in measures])
    joined = out.join(offsets, [*by, BUCKET])
    names = [c for c in out.columns if c != BUCKET and not c.startswith("cum_")]
    return joined.select(*names, *[(F.col(f"cum_{m}") + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles as (column, p, value) rows, nulls and NaN left out."""
    wide = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    cuts = _cut_points(wide, columns)
    bucketed = _with_buckets(wide, cuts)
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{BUCKET}_{c}`").alias(BUCKET), F.col(f"`{c}`").alias("value"))
        for c in columns
    ]
    counted = (
        bucketed.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", BUCKET, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _quantiles_at(counted, _running(counted, "value", ["n"], ["column"], False, single=not any(cuts.values())), probabilities)


def counted_quantiles(counted: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """The same from one row per (column, value) with its count n."""
    return _quantiles_at(counted, running_totals(counted, "value", ["n"], ["column"]), probabilities)


def _quantiles_at(counted: DataFrame, placed: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    sizes = counted.groupBy("column").agg(F.sum("n").alias("_total"))  # one row per column
    targets = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    aims = sizes.select("column", targets.alias("p"), "_total").withColumn("_pos", F.col("p") * (F.col("_total") - 1))
    # One row per (column, probability): bounded by the arguments, so it is safe to broadcast.
    first = F.col("cum_n") - F.col("n")
    hit = placed.join(F.broadcast(aims), "column").filter(
        F.floor("_pos").between(first, F.col("cum_n") - 1) | F.ceil("_pos").between(first, F.col("cum_n") - 1)
    )
    low = F.max(F.when(F.floor("_pos") >= first, F.when(F.floor("_pos") < F.col("cum_n"), F.col("value"))))
    high = F.max(F.when(F.ceil("_pos") >= first, F.when(F.ceil("_pos") < F.col("cum_n"), F.col("value"))))
    return (
        hit.groupBy("column", "p", "_pos").agg(low.alias("_lo"), high.alias("_hi"))
        .select("column", "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias("value"))
    )


# --- ranking metrics ----------------------------------------------------------------------------------


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, score) -> rows and positives, summed before the shuffle."""
    w = weight if weight is not None else F.lit(1)
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(w.cast("bigint")).alias("n"), F.sum((w * F.col(label)).cast("bigint")).alias("pos")
    )


def curve_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, trapezoid PR area, ROC area and Brier score per group, over distinct scores.

    ``counts`` comes from :func:`score_counts`. Ties share a threshold; ROC gives tied pairs one half.
    """
    placed = running_totals(counts, "score", ["n", "pos"], by, descending=True)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    joined = placed.join(totals, list(by)) if by else placed.crossJoin(F.broadcast(totals))  # one row
    n, pos, cum_n, cum_pos = (F.col(c) for c in ("n", "pos", "cum_n", "cum_pos"))
    step = pos / F.greatest(F.col("positives"), F.lit(1))
    precision = cum_pos / cum_n
    earlier_n, earlier_pos = cum_n - n, cum_pos - pos
    earlier = F.when(earlier_n == 0, F.lit(1.0)).otherwise(F.try_divide(earlier_pos, earlier_n))
    negatives = F.col("rows") - F.col("positives")
    below = (F.col("rows") - cum_n) - (F.col("positives") - cum_pos)
    wins = pos * (below + 0.5 * (n - pos))
    loss = pos * (F.col("score") - 1) * (F.col("score") - 1) + (n - pos) * F.col("score") * F.col("score")
    return joined.groupBy(*by, "rows", "positives").agg(
        F.sum(step * precision).alias("average_precision"),
        F.sum(step * (precision + earlier) / 2).alias("pr_auc_trap"),
        F.sum(F.coalesce(F.try_divide(wins, negatives * F.col("positives")), F.lit(0.0))).alias("roc_auc"),
        F.sum(loss / F.col("rows")).alias("brier"),
    )


def top_share(
    df: DataFrame, label: str, score: str, tiebreak: str, share: float = 0.05, by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Hits, precision and recall among the top ``share`` of rows by score, ties by ascending ``tiebreak``.

    Rows above the score at the boundary count as a whole; only the rows tied on that score are ranked,
    again by buckets, so a score shared by many rows is no bottleneck.
    """
    keys = list(by)
    w = F.col(weight) if weight else F.lit(1)
    counts = score_counts(df, label, score, by, w)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    k = F.greatest(F.lit(1), F.floor(F.col("rows") * share)).cast("bigint")
    placed = running_totals(counts, "score", ["n", "pos"], by, descending=True)
    ranked = placed.join(totals, keys) if keys else placed.crossJoin(F.broadcast(totals))  # one row
    ranked = ranked.withColumn("k", k)
    boundary = ranked.filter((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k"))).select(
        *keys, F.col("score").alias("_cut"), "k", "rows", "positives",
        (F.col("k") - F.col("cum_n") + F.col("n")).alias("_room"), (F.col("cum_pos") - F.col("pos")).alias("_above"),
    )
    rows = df.select(
        *keys, F.col(score).cast("double").alias("_score"), F.col(label).alias("_y"), F.col(tiebreak).alias("_tie"), w.alias("_w")
    )
    tied = rows.join(boundary, keys) if keys else rows.crossJoin(F.broadcast(boundary))  # one row
    tied = tied.filter(F.col("_score") == F.col("_cut")).groupBy(*keys, "_tie", "_room").agg(
        F.sum(F.col("_w").cast("bigint")).alias("_n"), F.max("_y").alias("_y")
    )
    inside = running_totals(tied, "_tie", ["_n"], by).withColumn(
        "_in", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_room") - F.col("cum__n") + F.col("_n")))
    )
    extra = inside.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_in") * F.col("_y")), F.lit(0)).alias("_extra"))
    joined = boundary.join(extra, keys) if keys else boundary.crossJoin(F.broadcast(extra))  # one row each
    hits = (F.col("_above") + F.col("_extra")).cast("bigint")
    return joined.select(
        *keys, "k", hits.alias("hits"), ratio(hits, F.col("k")).alias("precision_top"),
        ratio(hits, F.greatest(F.col("positives"), F.lit(1))).alias("recall_top"),
    )


def expected_top_share(counts: DataFrame, share: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Precision among the top ``share``, rows tied at the boundary counted in proportion.

    Needs the score counts only, which is what resampling keeps per replicate.
    """
    totals = counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    placed = running_totals(counts, "score", ["n", "pos"], by, descending=True)
    ranked = placed.join(totals, list(by)) if by else placed.crossJoin(F.broadcast(totals))  # one row
    k = F.greatest(F.lit(1), F.floor(F.col("rows") * share))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("cum_n") + F.col("n")))
    hits = F.sum(taken * F.col("pos") / F.col("n"))
    return ranked.groupBy(*by, "rows", "positives").agg((hits / F.max(k)).alias("precision_top"))


def evaluation(df: DataFrame, label: str, score: str, tiebreak: str, share: float = 0.05) -> DataFrame:
    """One row with every ranking metric of a scored table."""
    curve = curve_metrics(score_counts(df, label, score))
    top = top_share(df, label, score, tiebreak, share)
    return curve.crossJoin(F.broadcast(top)).select(  # one row each
        "average_precision", "pr_auc_trap", "roc_auc", "brier", "precision_top", "recall_top",
        ratio(F.col("positives"), F.col("rows")).alias("prevalence"), "rows", "positives", "k", "hits",
    )
