"""Feature families as declarations; :func:`panel_features` compiles all of them into one window pass."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import clip, day_number, measure
from .cleaning import drop_placeholder_dates
from .ranking import exact_quantiles
from .temporal import (
    Feature, ahead, as_of, at_least_zero, at_probes, at_weeks, before, covers_probe, daily, days_since, flag, or_zero,
    or_zero_count, prior, total,
)

KEY = "player_id"
WEEK = "week_start"


@dataclass
class Family:
    """Daily facts, the features read from them and the columns derived afterwards."""

    facts: list[DataFrame]
    features: list[Feature]
    derived: dict[str, Column] = field(default_factory=dict)
    constants: dict[str, Column] = field(default_factory=dict)

    def only(self, columns: Collection[str]) -> Family:
        """The family as far as ``columns`` need it: facts that no wanted feature reads take no part."""
        derived = {n: v for n, v in self.derived.items() if n in columns}
        wanted = set(columns).union(*[READ_BY[n] for n in derived])
        kept = [f for f in self.features if f.name in wanted]
        read = {f.measure for f in kept}
        return Family(
            [f for f in self.facts if read & set(f.columns)], kept, derived, {n: v for n, v in self.constants.items() if n in columns}
        )


#: What derived columns are computed from.
READ_BY = {
    "acwr": ("minutes_last_1w", "minutes_last_4w"),
    "away_match_share_28d": ("away_matches_last_28d", "matches_last_28d"),
    "log_market_value": ("market_value",),
    "market_value_trend": ("market_value", "market_value_6m"),
}

MINUTE_WINDOWS = {"minutes_last_1w": 7, "minutes_last_2w": 14, "minutes_last_4w": 28, "minutes_last_8w": 56}
MATCH_WINDOWS = {"matches_last_3d": 3, "matches_last_7d": 7, "matches_last_14d": 14, "matches_last_28d": 28}


def _acwr() -> Column:
    return F.col("minutes_last_1w") / (F.col("minutes_last_4w") / 4 + 1)


def _load_measures() -> dict[str, Column]:
    return {"wl_minutes": measure("minutes_played")}


def _load_features() -> list[Feature]:
    rest = days_since(S.NEVER)
    features = [Feature(n, "sum", "wl_minutes", prior(w), total) for n, w in MINUTE_WINDOWS.items()]
    features.append(
        Feature(
            "days_since_last_played", "day", "wl_played", before(),
            lambda value, day: clip(rest(value, day), 0, S.NEVER).cast("int"),
        )
    )
    return features


def _with_played(facts: DataFrame) -> DataFrame:
    return facts.withColumn("wl_played", F.when(F.col("wl_minutes") > 0, 1))


def workload(facts: DataFrame) -> Family:
    """Prior minutes by game date, the acute-chronic ratio and days since last played."""
    family = daily(facts, KEY, "game_date", **{n: F.sum(v) for n, v in _load_measures().items()})
    return Family([_with_played(family)], _load_features(), {"acwr": _acwr()})


def _density(facts: DataFrame) -> tuple[dict[str, Column], list[Feature], dict[str, Column]]:
    """Summed measures, features and derived columns of match density, as far as the columns allow."""
    minutes = measure("minutes_played")
    measures = {"cg_matches": F.lit(1.0), "cg_minutes": minutes}
    features = [Feature(n, "sum", "cg_matches", prior(w), total) for n, w in MATCH_WINDOWS.items()]
    features += [
        Feature("minutes_last_10d", "sum", "cg_minutes", prior(10), total),
        Feature("max_minutes_14d", "max", "cg_minutes", prior(14), at_least_zero),
    ]
    derived = {}
    if "away_club_id" in facts.columns and "player_club_id" in facts.columns:
        away = F.coalesce((F.col("player_club_id") == F.col("away_club_id")).cast("double"), F.lit(0.0))
        measures |= {"cg_away": away, "cg_away_minutes": minutes * away}
        features += [
            Feature("away_matches_last_28d", "sum", "cg_away", prior(28), total),
            Feature("away_minutes_last_28d", "sum", "cg_away_minutes", prior(28), total),
        ]
        derived["away_match_share_28d"] = F.col("away_matches_last_28d") / (F.col("matches_last_28d") + 1e-6)
    for colour, days in (("yellow", 28), ("red", 56)):
        if f"{colour}_cards" in facts.columns:
            measures[f"cg_{colour}"] = measure(f"{colour}_cards")
            features.append(Feature(f"{colour}_cards_last_{days}d", "sum", f"cg_{colour}", prior(days), total))
    return measures, features, derived


def congestion(facts: DataFrame) -> Family:
    """Match density, peak load, away load and cards by appearance date."""
    measures, features, derived = _density(facts)
    return Family([daily(facts, KEY, "date", **{n: F.sum(v) for n, v in measures.items()})], features, derived)


def appearance_load(facts: DataFrame) -> Family:
    """Workload and congestion together: the facts are read and shuffled once.

    Each appearance counts on its game date for workload and on its own date for congestion. The two are
    nearly always the same day, and then share one daily row.
    """
    by_game, by_own = _load_measures(), _density(facts)
    measures, features, derived = by_own
    dates = F.array(
        F.struct(F.lit(True).alias("game"), F.col("game_date").alias("day")),
        F.struct(F.lit(False).alias("game"), F.col("date").alias("day")),
    )
    dated = facts.withColumn("_on", F.explode(dates))
    game = F.col("_on.game")
    sums = {n: F.sum(F.when(game, v)) for n, v in by_game.items()} | {n: F.sum(F.when(~game, v)) for n, v in measures.items()}
    family = daily(dated, KEY, F.col("_on.day"), **sums)
    return Family([_with_played(family)], _load_features() + features, {"acwr": _acwr(), **derived})


def transfer_context(transfers: DataFrame | None) -> Family:
    if transfers is None:
        return Family([], [], {}, {"days_since_transfer": F.lit(S.NEVER)})
    dated = drop_placeholder_dates(transfers, "transfer_date")
    facts = daily(dated, KEY, "transfer_date", tr_any=F.max(F.lit(1)))
    return Family([facts], [Feature("days_since_transfer", "day", "tr_any", as_of(), days_since(S.NO_TRANSFER))])


VALUE_LAG_DAYS = 180
VALUE_SMOOTHING = 10000


def value_context(values: DataFrame | None, tiebreak: str | None = None) -> Family:
    """Value as of t and of t - 180 days. Same-day values resolve by ``tiebreak`` (default: the larger)."""
    if values is None:
        return Family([], [], {}, {"log_market_value": F.lit(0.0), "market_value_trend": F.lit(0.0)})
    now, past = F.col("market_value"), F.col("market_value_6m")
    # The latest row decides even when its value is missing, so a missing value travels as NaN.
    known = F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))
    facts = daily(values, KEY, "date", mv_value=F.max_by(known, F.struct(tiebreak or "value")))
    read = lambda value, day: F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
    features = [
        Feature("market_value", "last", "mv_value", as_of(), read),
        Feature("market_value_6m", "last", "mv_value", as_of(VALUE_LAG_DAYS), read),
    ]
    derived = {
        "log_market_value": F.log1p(now),
        "market_value_trend": (now - past) / (past + VALUE_SMOOTHING),
    }
    return Family([facts], features, derived)


def serious(injuries: DataFrame, min_days: int = S.MIN_DAYS_OUT) -> DataFrame:
    return injuries.filter(F.coalesce(F.col("days_out").cast("double"), F.lit(0.0)) >= min_days)


def _interval_starts(injuries: DataFrame, min_days: int) -> DataFrame:
    return daily(
        serious(injuries, min_days), KEY, "injury_start",
        in_count=F.count(F.lit(1)).cast("int"),
        in_days=F.sum(F.col("days_out").cast("double")),
        in_last=F.max(F.col("days_out").cast("double")),
        in_end=F.max(day_number("injury_end")),
    )


def _history_features(windows: Sequence[int]) -> list[Feature]:
    features = []
    for w in windows:
        features.append(Feature(f"injuries_last_{w}d", "sum", "in_count", prior(w), or_zero_count))
        features.append(Feature(f"days_out_last_{w}d", "sum", "in_days", prior(w), total))
    return features + [
        Feature("days_since_last_injury_start", "day", "in_count", before(), days_since(S.NEVER)),
        Feature("days_since_last_injury_end", "day", "en_any", before(), days_since(S.NEVER)),
        Feature("last_injury_days_out", "last", "in_last", before(), or_zero),
    ]


def _interval_ends(injuries: DataFrame, min_days: int) -> DataFrame:
    return daily(serious(injuries, min_days), KEY, "injury_end", en_any=F.max(F.lit(1)))


def injury_history(
    injuries: DataFrame, windows: Sequence[int] = (30, 180, 365), min_days: int = S.MIN_DAYS_OUT
) -> Family:
    """Counts, day sums, recency and the last interval, all strictly before t."""
    return Family([_interval_starts(injuries, min_days), _interval_ends(injuries, min_days)], _history_features(windows))


def injury_labels(
    injuries: DataFrame, horizon: int = S.HORIZON_DAYS, min_days: int = S.MIN_DAYS_OUT
) -> Family:
    """target: a serious interval starts in (t, t+horizon]; ineligible: t lies in a serious interval."""
    return Family([_interval_starts(injuries, min_days)], _label_features(horizon))


def _label_features(horizon: int) -> list[Feature]:
    return [
        Feature("target", "sum", "in_count", ahead(horizon), flag),
        Feature("ineligible", "max", "in_end", as_of(), covers_probe),
    ]


def injury_family(
    injuries: DataFrame, windows: Sequence[int] = (30, 180, 365), horizon: int = S.HORIZON_DAYS,
    min_days: int = S.MIN_DAYS_OUT,
) -> Family:
    """Labels and history together; they read the same daily facts."""
    return Family(
        [_interval_starts(injuries, min_days), _interval_ends(injuries, min_days)],
        _label_features(horizon) + _history_features(windows),
    )


def panel_features(panel: DataFrame, families: Sequence[Family]) -> DataFrame:
    """All families in one union, one shuffle by player and one window operator."""
    facts = [f for family in families for f in family.facts]
    features = [f for family in families for f in family.features]
    return _derived(at_probes(panel, KEY, WEEK, facts, features) if features else panel, families)


def weekly_features(spans: DataFrame, families: Sequence[Family], ranged: bool = False) -> DataFrame:
    """The same for every Monday from ``min_week`` to ``max_week`` of each span; the weeks are expanded behind the shuffle and the windows."""
    facts = [f for family in families for f in family.facts]
    features = [f for family in families for f in family.features]
    return _derived(at_weeks(spans, KEY, "min_week", "max_week", WEEK, facts, features, ranged), families)


def _derived(out: DataFrame, families: Sequence[Family]) -> DataFrame:
    for family in families:
        for name, value in {**family.derived, **family.constants}.items():
            out = out.withColumn(name, value)
    return out


# --- compatibility with the dense date x player matrix ------------------------------------------------

MATRIX_BUFFER_DAYS = 60


def matrix_span(panel: DataFrame, facts: DataFrame, date: str) -> DataFrame:
    """One row: first and last matrix day, and the earliest day events are read from."""
    bounds = panel.agg(F.min(WEEK).alias("_p0"), F.max(WEEK).alias("_p1"))
    players = panel.select(KEY).distinct()
    return (
        facts.join(players, KEY, "left_semi")
        .crossJoin(F.broadcast(bounds))  # one row
        .filter(F.col(date).between(F.date_sub("_p0", MATRIX_BUFFER_DAYS), F.col("_p1")))
        .agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    )


def mask_warmup(panel: DataFrame, span: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Zero the features whose window begins before the first matrix day or whose Monday follows the last.

    This reproduces a rolling matrix that needs a full window; the default keeps the documented definition.
    """
    names = panel.columns
    out = panel.crossJoin(F.broadcast(span))  # one row
    masked = {
        name: F.when(
            (F.date_sub(WEEK, days) >= F.col("_first")) & (F.col(WEEK) <= F.col("_last")), F.col(name)
        ).otherwise(F.lit(0.0))
        for name, days in windows.items()
    }
    if "days_since_last_played" in names:
        rest = F.col("days_since_last_played")
        masked["days_since_last_played"] = F.when(
            (F.col(WEEK) <= F.col("_last")) & (F.date_sub(WEEK, rest) >= F.col("_first")), rest
        ).otherwise(F.lit(S.NEVER))
    return out.withColumns(masked).select(*names)


CONGESTION_WINDOWS = {
    **MATCH_WINDOWS, "minutes_last_10d": 10, "max_minutes_14d": 14, "away_matches_last_28d": 28,
    "away_minutes_last_28d": 28, "yellow_cards_last_28d": 28, "red_cards_last_56d": 56,
}


def with_matrix_warmup(panel: DataFrame, facts: DataFrame) -> DataFrame:
    """``warmup="reference"``: workload columns as a dense matrix would give them, derived columns redone."""
    out = panel
    minutes = {n: w for n, w in MINUTE_WINDOWS.items() if n in panel.columns}
    if minutes:
        out = mask_warmup(out, matrix_span(panel, facts, "game_date"), minutes).withColumn("acwr", _acwr())
    dense = {n: w for n, w in CONGESTION_WINDOWS.items() if n in panel.columns}
    if dense:
        rest = [c for c in out.columns if c == "days_since_last_played"]
        kept = out.withColumnsRenamed({c: f"_kept_{c}" for c in rest})
        out = mask_warmup(kept, matrix_span(panel, facts, "date"), dense).withColumnsRenamed(
            {f"_kept_{c}": c for c in rest}
        )
        if "away_match_share_28d" in out.columns:
            share = F.col("away_matches_last_28d") / (F.col("matches_last_28d") + 1e-6)
            out = out.withColumn("away_match_share_28d", share)
    return out.select(*panel.columns)


# --- legacy row windows -------------------------------------------------------------------------------


def row_window_features(sparse: DataFrame) -> DataFrame:
    """Per player, over the last n rows of the sparse weekly grid including the current one."""
    order = Window.partitionBy(KEY).orderBy(WEEK)

    def rows(n: int):
        return order.rowsBetween(-(n - 1), 0)

    out = sparse
    for n in (1, 2, 4, 8):
        out = out.withColumn(f"minutes_{n}w", F.sum("minutes_week").over(rows(n)))
    for n in (1, 2, 4):
        out = out.withColumn(f"matches_{n}w", F.sum("matches_week").over(rows(n)))
    return out.withColumns(
        {
            "acwr_minutes": F.col("minutes_1w") / (F.col("minutes_4w") + 1e-6),
            "minutes_trend_4w": F.col("minutes_1w") - F.col("minutes_4w") / 4,
            "congestion_2w": F.col("matches_2w"),
        }
    )


# --- quantile bins ------------------------------------------------------------------------------------


def quantile_bins(df: DataFrame, column: str, q: int = 10, out: str = "decile") -> DataFrame:
    """Right-closed bins on interpolated quantile edges, lowest value included, repeated edges dropped.

    The edges are one row of at most q + 1 numbers.
    """
    edges = exact_quantiles(df, [column], [i / q for i in range(q + 1)]).agg(
        F.array_sort(F.collect_set("value")).alias("_edges")
    )
    below = F.size(F.filter("_edges", lambda e: e < F.col(column)))
    return (
        df.filter(F.col(column).isNotNull())
        .crossJoin(F.broadcast(edges))  # one row
        .withColumn(out, F.greatest(below - 1, F.lit(0)))
        .drop("_edges")
    )
