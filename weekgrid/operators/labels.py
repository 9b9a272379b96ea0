"""Label universe, censoring, activity windows and the older labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .features import KEY, WEEK, injury_labels, panel_features
from .temporal import daily, at_probes, Feature, ahead, as_of, covers_probe, flag
from ..functions.scalars import day_number


def label_universe(injuries: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    ids = injuries.select(KEY)
    if profiles is not None:
        ids = ids.unionByName(profiles.select(KEY))
    return ids.filter(F.col(KEY).isNotNull()).distinct()


def add_label_known(panel: DataFrame, injuries: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    known = label_universe(injuries, profiles).withColumn("label_known", F.lit(1))
    return panel.join(known, KEY, "left").withColumn("label_known", F.coalesce("label_known", F.lit(0)))


def add_labels(panel: DataFrame, injuries: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    labelled = panel_features(panel, [injury_labels(injuries)])
    return add_label_known(labelled, injuries, profiles)


def add_not_censored(panel: DataFrame, injuries: DataFrame, horizon: int = S.HORIZON_DAYS) -> DataFrame:
    last = injuries.agg(F.max("injury_start").alias("_last_start"))
    return (
        panel.crossJoin(F.broadcast(last))  # one row
        .withColumn(
            "not_censored", F.when(F.date_add(WEEK, horizon) <= F.col("_last_start"), 1).otherwise(0)
        )
        .drop("_last_start")
    )


def activity_windows(appearances: DataFrame, games: DataFrame, buffer: int = S.ACTIVITY_BUFFER_DAYS) -> DataFrame:
    """(player, season) -> days from shortly before the first to shortly after the last appearance."""
    dated = appearances.select(KEY, "game_id", "date").join(games.select("game_id", "season"), "game_id")
    return windows_of(dated, buffer)


def windows_of(dated: DataFrame, buffer: int = S.ACTIVITY_BUFFER_DAYS) -> DataFrame:
    return (
        dated.filter(F.col("season").isNotNull() & F.col(KEY).isNotNull())
        .groupBy(KEY, "season")
        .agg(
            F.date_sub(F.min("date"), buffer).alias("_window_start"),
            F.date_add(F.max("date"), buffer).alias("_window_end"),
        )
    )


def add_active_player(panel: DataFrame, windows: DataFrame) -> DataFrame:
    return (
        panel.join(windows, [KEY, "season"], "left")
        .withColumn("active_player", F.when(F.col(WEEK).between(F.col("_window_start"), F.col("_window_end")), 1).otherwise(0))
        .drop("_window_start", "_window_end")
    )


def add_structural_flags(
    panel: DataFrame, injuries: DataFrame, appearances: DataFrame, games: DataFrame
) -> DataFrame:
    return add_active_player(add_not_censored(panel, injuries), activity_windows(appearances, games))


def legacy_labels(panel: DataFrame, injuries: DataFrame) -> DataFrame:
    """target from serious intervals; rows inside any interval, however short, are removed."""
    start, end = "injury_start_date", "injury_end_date"
    facts = daily(
        injuries, KEY, start,
        _serious=F.count(F.when(F.col("days_out") >= S.MIN_DAYS_OUT, 1)),
        _end=F.max(day_number(end)),
    )
    features = [
        Feature("target", "sum", "_serious", ahead(S.HORIZON_DAYS), flag),
        Feature("_inside", "max", "_end", as_of(), covers_probe),
    ]
    return at_probes(panel, KEY, WEEK, [facts], features).filter(F.col("_inside") == 0).drop("_inside")


def positive_pairs(panel: DataFrame, injuries: DataFrame, horizon: int = S.HORIZON_DAYS) -> DataFrame:
    """Number of (row, interval) pairs with the start in the horizon: any severity, repeats counted.

    The pairs are summed from per-row counts, never listed.
    """
    facts = daily(injuries, KEY, "injury_start", _n=F.count(F.lit(1)))
    counted = at_probes(
        panel.select(KEY, WEEK), KEY, WEEK, [facts],
        [Feature("_pairs", "sum", "_n", ahead(horizon), lambda v, d: F.coalesce(v, F.lit(0)))],
    )
    return counted.agg(F.coalesce(F.sum("_pairs"), F.lit(0)).cast("bigint").alias("positive_pairs"))
