"""Ad-hoc panel queries. Filters are Column objects built from picked values, never text."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import all_of, contains_ci
from .features import KEY, WEEK

FLAGS = ["target", "ineligible", "active_player", "not_censored", "label_known"]


@dataclass
class PanelFilter:
    """Picked values; anything left empty does not filter."""

    weeks: tuple[str, str] | None = None
    flags: dict[str, int] = field(default_factory=dict)
    picks: dict[str, list[str]] = field(default_factory=dict)

    def condition(self) -> Column:
        parts = []
        if self.weeks:
            parts.append(F.col(WEEK).between(*[F.lit(w).cast("date") for w in self.weeks]))
        parts += [F.col(c) == v for c, v in self.flags.items() if v is not None]
        parts += [F.col(c).cast("string").isin(v) for c, v in self.picks.items() if v]
        return all_of(parts)


def scan_panel(spark: SparkSession, path: str, sql: str, values: dict) -> DataFrame:
    """A query in SQL over the written panel, as the view ``panel``; values are bound, never pasted into the text."""
    view = f"panel_{uuid.uuid4().hex}"
    spark.read.parquet(path).createOrReplaceTempView(view)
    return spark.sql(f"WITH panel AS (SELECT * FROM {view}) {sql}", args=values)


def preview(
    panel: DataFrame, where: PanelFilter, columns: list[str] | None = None, limit: int | None = 1000
) -> DataFrame:
    rows = panel.filter(where.condition()).select(*(columns or panel.columns))
    return rows if limit is None else rows.limit(limit)


def export_rows(panel: DataFrame, where: PanelFilter, path: str, limit: int = 20_000) -> None:
    """A bounded CSV export of a filtered panel."""
    preview(panel, where, limit=limit).write.mode("overwrite").option("header", True).csv(path)


def count_rows(panel: DataFrame, where: PanelFilter) -> DataFrame:
    return panel.filter(where.condition()).agg(F.count(F.lit(1)).alias("n"))


def group_prevalence(panel: DataFrame, where: PanelFilter, by: str, limit: int = 200) -> DataFrame:
    grouped = panel.filter(where.condition()).groupBy(F.col(by).alias("group_key"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("prevalence")).orderBy(
        F.desc("n"), "group_key"
    ).limit(limit)


def player_rows(panel: DataFrame, player_id: int, columns: list[str] | None = None) -> DataFrame:
    return panel.filter(F.col(KEY) == player_id).select(*(columns or panel.columns)).orderBy(WEEK)


def search_names(players: DataFrame, text: str, limit: int = 50) -> DataFrame:
    return players.filter(contains_ci("name", text)).orderBy(KEY).limit(limit)


def filter_values(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each filter column, as (column, value) rows. One pass for all columns."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return panel.select(F.explode(F.array(*entries)).alias("_e")).select("_e.column", "_e.value").filter(
        F.col("value").isNotNull()
    ).distinct()


def week_range(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min(WEEK).alias("first_week"), F.max(WEEK).alias("last_week"))


def trace_player(
    panel: DataFrame, appearances: DataFrame, games: DataFrame, injuries: DataFrame, player_id: int
) -> dict[str, DataFrame]:
    """Panel rows, matches with their games, and intervals of one player, each in time order."""
    mine = F.col(KEY) == player_id
    matches = appearances.filter(mine).join(
        games.select("game_id", "game_date", "season"), "game_id", "left"
    )
    return {
        "panel": panel.filter(mine).orderBy(WEEK),
        "matches": matches.orderBy("game_date", "game_id"),
        "injuries": injuries.filter(mine).orderBy("injury_start"),
    }
