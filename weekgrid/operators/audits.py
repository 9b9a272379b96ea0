"""Gates and audits. Each returns rows (check, metric, value, status) and covers every row, not a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import measure, ratio
from .features import KEY, WEEK, serious
from .joins import key_presence, points_in_intervals, points_outside
from .temporal import band_sum


def report(one_row: DataFrame, check: str, metrics: dict[str, Column], passed: Column | bool = True) -> DataFrame:
    """One aggregate row to one row per metric."""
    status = F.when(F.lit(passed) if isinstance(passed, bool) else passed, "PASS").otherwise("FAIL")
    entries = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items()
    ]
    return one_row.select(F.lit(check).alias("check"), status.alias("status"), F.explode(F.array(*entries)).alias("_m")).select(
        "check", "_m.metric", "_m.value", "status"
    )


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = report(df.agg(F.count(F.lit(1)).alias("n")), "row_count", {name: F.col("n")})
        out = row if out is None else out.unionByName(row)
    return out


def overlap_gate(cohort: DataFrame, injuries: DataFrame, threshold: float = S.OVERLAP_GATE_PCT) -> DataFrame:
    """Share of cohort players that appear in the interval table; FAIL below the threshold."""
    seen = key_presence(cohort.select(KEY), injuries.select(KEY), KEY).filter(F.col(KEY).isNotNull())
    row = seen.agg(
        F.count_if(F.col("left_n") > 0).alias("a"),
        F.count_if(F.col("right_n") > 0).alias("b"),
        F.count_if((F.col("left_n") > 0) & (F.col("right_n") > 0)).alias("both"),
    )
    pct = ratio(F.col("both") * 100, F.col("a"))
    return report(
        row, "id_overlap", {"n_backbone": F.col("a"), "n_labels": F.col("b"), "overlap_pct": pct}, pct >= threshold
    )


def league_purity(panel: DataFrame, competitions: DataFrame) -> DataFrame:
    used = competitions.join(panel.select("competition_id").distinct(), "competition_id", "left_semi")
    odd = F.coalesce(F.col("name").rlike(f"(?i){S.NON_LEAGUE_NAME_PATTERN}"), F.lit(False))
    row = used.agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"))
    return report(
        row, "league_purity", {"competitions": F.col("n"), "suspicious": F.col("odd")},
        (F.col("n") > 0) & (F.col("odd") == 0),
    )


def label_validity(panel: DataFrame, injuries: DataFrame, horizon: int = S.HORIZON_DAYS) -> DataFrame:
    """Each positive row has a serious interval starting 1..horizon days later; days to the earliest one."""
    positives = panel.filter(F.col("target") == 1).select(KEY, WEEK)
    # A start s is in (t, t+h] exactly when t is in [s-h, s-1].
    start = F.col("injury_start")
    pairs = points_in_intervals(
        positives, serious(injuries).select(KEY, "injury_start"), KEY, WEEK,
        F.date_sub(start, horizon), F.date_sub(start, 1), "inner",
    )
    nearest = pairs.groupBy(KEY, WEEK).agg(F.datediff(F.min("injury_start"), F.col(WEEK)).alias("_delta"))
    found = nearest.agg(
        F.count(F.lit(1)).alias("matched"), F.min("_delta").alias("lo"), F.max("_delta").alias("hi"),
        F.avg("_delta").alias("mean"),
    )
    row = found.crossJoin(positives.distinct().agg(F.count(F.lit(1)).alias("checked")))  # one row each
    return report(
        row, "label_validity",
        {
            "checked": F.col("checked"), "errors": F.col("checked") - F.col("matched"),
            "delta_min": F.col("lo"), "delta_max": F.col("hi"), "delta_mean": F.col("mean"),
        },
        F.col("checked") == F.col("matched"),
    )


def ineligible_correctness(panel: DataFrame, injuries: DataFrame) -> DataFrame:
    """Each ineligible row lies in some interval, of any severity."""
    flagged = panel.filter(F.col("ineligible") == 1).select(KEY, WEEK)
    stray = points_outside(
        flagged, injuries.select(KEY, "injury_start", "injury_end"), KEY, WEEK, F.col("injury_start"), F.col("injury_end")
    )
    row = flagged.agg(F.count(F.lit(1)).alias("checked")).crossJoin(stray.agg(F.count(F.lit(1)).alias("errors")))
    return report(
        row, "ineligible_correctness", {"checked": F.col("checked"), "errors": F.col("errors")}, F.col("errors") == 0
    )


def rolling_recompute(
    panel: DataFrame, appearances: DataFrame, column: str = "minutes_last_1w", days: int = 7, tolerance: float = 1.0
) -> DataFrame:
    """The stored rolling sum against a band join over the raw appearances."""
    minutes = appearances.withColumn("minutes_played", measure("minutes_played"))
    probes = panel.select(KEY, WEEK, F.col(column).alias("_stored"))
    again = band_sum(minutes, probes, KEY, "date", WEEK, "minutes_played", "_again", days)
    gap = F.abs(F.col("_again") - F.col("_stored"))
    row = again.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(gap > tolerance).alias("errors"), F.max(gap).alias("gap")
    )
    return report(
        row, "rolling_recompute",
        {"checked": F.col("checked"), "errors": F.col("errors"), "max_gap": F.col("gap")}, F.col("errors") == 0,
    )


def history_recompute(panel: DataFrame, injuries: DataFrame, days: int = 365) -> DataFrame:
    """Rows with a positive count against a recount of serious intervals in [t - days, t)."""
    column = f"injuries_last_{days}d"
    probes = panel.filter(F.col(column) > 0).select(KEY, WEEK, F.col(column).alias("_stored"))
    ones = serious(injuries).select(KEY, "injury_start", F.lit(1.0).alias("_one"))
    again = band_sum(ones, probes, KEY, "injury_start", WEEK, "_one", "_again", days)
    row = again.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_again") != F.col("_stored")).alias("errors")
    )
    return report(
        row, "history_recompute", {"checked": F.col("checked"), "errors": F.col("errors")}, F.col("errors") == 0
    )


def missing_ids(panel: DataFrame, injuries: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """How many panel players the label tables do not know; FAIL when too many are in neither."""
    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select(KEY, F.lit(tag).alias("_tag")).filter(F.col(KEY).isNotNull())

    union = tagged(panel, "panel").unionByName(tagged(injuries, "injuries"))
    if profiles is not None:
        union = union.unionByName(tagged(profiles, "profiles"))
    per_player = union.groupBy(KEY).agg(
        *[F.bool_or(F.col("_tag") == t).alias(f"in_{t}") for t in ("panel", "injuries", "profiles")]
    )
    inside, hurt, known = F.col("in_panel"), F.col("in_injuries"), F.col("in_profiles")
    row = per_player.agg(
        F.count_if(inside).alias("n"),
        F.count_if(inside & ~hurt).alias("no_injury"),
        F.count_if(inside & ~known).alias("no_profile"),
        F.count_if(inside & known & ~hurt).alias("healthy"),
        F.count_if(inside & ~hurt & ~known).alias("neither"),
    )
    metrics = {
        "panel_players": F.col("n"),
        "missing_from_injuries": F.col("no_injury"),
        "missing_from_injuries_pct": ratio(F.col("no_injury") * 100, F.col("n")),
    }
    passed: Column | bool = True
    if profiles is not None:
        pct = ratio(F.col("neither") * 100, F.col("n"))
        metrics |= {
            "missing_from_profiles": F.col("no_profile"),
            "profile_without_injury": F.col("healthy"),
            "missing_from_both": F.col("neither"),
            "missing_from_both_pct": pct,
        }
        passed = pct <= S.MISSING_GATE_PCT
    return report(row, "missing_ids", metrics, passed)


def minutes_by_type(panel: DataFrame, appearances: DataFrame, competitions: DataFrame) -> DataFrame:
    """Minutes of panel players in the panel's date range, by competition type, with shares."""
    bounds = panel.agg(F.min(WEEK).alias("_a"), F.max(WEEK).alias("_b"))
    by_competition = (
        appearances.join(panel.select(KEY).distinct(), KEY, "left_semi")
        .crossJoin(F.broadcast(bounds))  # one row
        .filter(F.col("date").between(F.col("_a"), F.col("_b")))
        .groupBy("competition_id")
        .agg(F.sum(measure("minutes_played")).alias("minutes"))
    )
    typed = by_competition.join(competitions.select("competition_id", "type"), "competition_id", "left")
    by_type = typed.groupBy("type").agg(F.sum("minutes").alias("minutes"))
    total = by_type.agg(F.sum("minutes").alias("_total"))
    return by_type.crossJoin(F.broadcast(total)).select(  # one row
        "type", "minutes", ratio(F.col("minutes"), F.col("_total")).alias("share")
    )


def workload_composition(panel: DataFrame, appearances: DataFrame, competitions: DataFrame) -> DataFrame:
    row = minutes_by_type(panel, appearances, competitions).agg(
        F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("type") == "domestic_league", F.col("share"))), F.lit(0.0)).alias("share"),
    )
    return report(
        row, "workload_composition", {"total_minutes": F.col("total"), "domestic_league_share": F.col("share")},
        (F.col("total") > 0) & (F.col("share") <= S.DOMESTIC_SHARE_GATE),
    )


def key_and_date_check(table: DataFrame, key: str, dated: DataFrame, date: str) -> DataFrame:
    """Duplicate keys of one table and the latest date of another."""
    repeats = table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("dup")
    )
    row = repeats.crossJoin(dated.agg(F.max(date).alias("latest"), F.count(F.lit(1)).alias("rows")))  # one row each
    return report(
        row, "key_and_date",
        {"duplicate_keys": F.col("dup"), "dated_rows": F.col("rows"), "latest_day": F.unix_date("latest")},
        F.col("dup") == 0,
    )


def reference_coverage(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Percent of fact rows whose key exists in the dimension."""
    seen = key_presence(facts, dimension, key)
    row = seen.agg(
        F.sum("left_n").alias("rows"),
        F.sum(F.when(F.col(key).isNotNull() & (F.col("right_n") > 0), F.col("left_n")).otherwise(0)).alias("hit"),
    )
    pct = ratio(F.col("hit") * 100, F.col("rows"))
    return report(row, "reference_coverage", {f"{key}_coverage_pct": pct})


def run_counts(panel: DataFrame) -> DataFrame:
    row = panel.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(KEY).alias("players"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("pos"), F.coalesce(F.sum("ineligible"), F.lit(0)).alias("inel"),
    )
    return report(
        row, "run_counts",
        {
            "panel_rows": F.col("rows"), "panel_players": F.col("players"), "panel_positives": F.col("pos"),
            "panel_ineligible": F.col("inel"),
            "positive_pct": ratio(F.col("pos") * 100, F.col("rows")),
            "ineligible_pct": ratio(F.col("inel") * 100, F.col("rows")),
        },
    )


def quality_samples(panel: DataFrame, n: int = 5) -> dict[str, DataFrame]:
    """Example rows for the build report, in key order so that reruns agree."""
    key = [F.col(KEY), F.col(WEEK)]
    return {
        "positives": panel.filter(F.col("target") == 1).orderBy(*key).limit(n),
        "ineligible": panel.filter(F.col("ineligible") == 1).orderBy(*key).limit(n),
        "high_load_negatives": panel.filter((F.col("target") == 0) & (F.col("ineligible") == 0))
        .orderBy(F.desc("minutes_last_4w"), *key)
        .limit(n),
    }
