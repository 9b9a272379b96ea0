"""Edge cases of windows, labels, intervals and grids on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import T0, day, plus
from weekgrid.catalog import panel_queries
from weekgrid.operators import audits, cleaning, features, grid, joins, labels, temporal
from weekgrid.plans.panel import PanelInputs, build_panel
from weekgrid.sources.standins import Standins


def probe(spark, players=(1,)):
    return spark.createDataFrame([(p, T0, "GB1", 2023) for p in players], "player_id long, week_start date, competition_id string, season int")


def apps(spark, rows):
    """rows: (player, date, minutes)"""
    data = [(p, i, d, d, 2023, m, 10, 10, 20, 1, 0) for i, (p, d, m) in enumerate(rows)]
    schema = (
        "player_id long, game_id long, date date, game_date date, season int, minutes_played double, player_club_id long,"
        " away_club_id long, home_club_id long, yellow_cards int, red_cards int"
    )
    return spark.createDataFrame(data, schema)


def injuries(spark, rows):
    """rows: (player, start, end, days)"""
    return spark.createDataFrame(rows, "player_id long, injury_start date, injury_end date, days_out double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_prior_window_edges(spark):
    facts = apps(spark, [(1, plus(-8), 1.0), (1, plus(-7), 10.0), (1, plus(-1), 100.0), (1, T0, 1000.0)])
    row = one(features.panel_features(probe(spark), [features.workload(facts)]))
    assert row["minutes_last_1w"] == 110.0
    assert row["minutes_last_2w"] == 111.0
    assert row["acwr"] == pytest.approx(110 / (111 / 4 + 1))


def test_zero_minute_appearance_counts_as_match_not_as_played(spark):
    facts = apps(spark, [(1, plus(-2), 0.0), (1, plus(-9), 90.0)])
    row = one(features.panel_features(probe(spark), [features.workload(facts), features.congestion(facts)]))
    assert row["matches_last_3d"] == 1
    assert row["days_since_last_played"] == 9


def test_two_appearances_in_one_day(spark):
    facts = apps(spark, [(1, plus(-3), 45.0), (1, plus(-3), 45.0), (1, plus(-15), 500.0)])
    row = one(features.panel_features(probe(spark), [features.congestion(facts)]))
    assert row["max_minutes_14d"] == 90.0
    assert row["matches_last_7d"] == 2
    assert row["away_matches_last_28d"] == 3 and row["yellow_cards_last_28d"] == 3


@pytest.mark.parametrize("offset,inside", [(-14, True), (-15, False), (-1, True), (0, False)])
def test_bounded_maximum_edges(spark, offset, inside):
    row = one(features.panel_features(probe(spark), [features.congestion(apps(spark, [(1, plus(offset), 70.0)]))]))
    assert row["max_minutes_14d"] == (70.0 if inside else 0.0)


def test_never_played(spark):
    facts = apps(spark, [(2, plus(-1), 90.0)])
    row = one(features.panel_features(probe(spark), [features.workload(facts), features.congestion(facts)]))
    assert (row["minutes_last_8w"], row["days_since_last_played"], row["max_minutes_14d"]) == (0.0, 9999, 0.0)


def test_fractional_minutes_leave_no_residue(spark):
    facts = apps(spark, [(1, plus(-100), 0.1), (1, plus(-80), 0.2), (1, plus(-70), 0.7)])
    row = one(features.panel_features(probe(spark), [features.workload(facts)]))
    assert row["minutes_last_8w"] == 0.0


def test_warmup_options(spark):
    facts = apps(spark, [(1, plus(-5), 90.0), (1, plus(3), 1.0)])
    grid_rows = spark.createDataFrame(
        [(1, T0, "GB1", 2023), (1, plus(7), "GB1", 2023)], "player_id long, week_start date, competition_id string, season int"
    )
    panel = features.panel_features(grid_rows, [features.workload(facts), features.congestion(facts)])
    assert {r["week_start"]: r["minutes_last_1w"] for r in panel.collect()} == {T0: 90.0, plus(7): 1.0}
    compat = {r["week_start"]: r for r in features.with_matrix_warmup(panel, facts).collect()}
    assert compat[T0]["minutes_last_1w"] == 0.0  # first matrix day is 5 days back
    assert compat[plus(7)]["minutes_last_1w"] == 0.0  # the matrix ends before this Monday
    assert compat[plus(7)]["days_since_last_played"] == 9999


@pytest.mark.parametrize("offset,target", [(0, 0), (1, 1), (30, 1), (31, 0)])
def test_target_edges(spark, offset, target):
    inj = injuries(spark, [(1, plus(offset), plus(offset + 7), 7.0)])
    assert one(features.panel_features(probe(spark), [features.injury_labels(inj)]))["target"] == target


@pytest.mark.parametrize("days,target", [(6.0, 0), (7.0, 1), (None, 0)])
def test_severity(spark, days, target):
    inj = injuries(spark, [(1, plus(5), None, days)])
    assert one(features.panel_features(probe(spark), [features.injury_labels(inj)]))["target"] == target


@pytest.mark.parametrize(
    "start,end,inside",
    [(0, 9, 1), (-9, 0, 1), (-9, -1, 0), (-9, None, 0)],
)
def test_ineligible_edges(spark, start, end, inside):
    inj = injuries(spark, [(1, plus(start), None if end is None else plus(end), 9.0)])
    assert one(features.panel_features(probe(spark), [features.injury_labels(inj)]))["ineligible"] == inside


def test_nested_intervals(spark):
    inj = injuries(spark, [(1, plus(-40), plus(2), 42.0), (1, plus(-20), plus(-10), 10.0)])
    assert one(features.panel_features(probe(spark), [features.injury_labels(inj)]))["ineligible"] == 1


def test_history_edges_and_end_recency(spark):
    inj = injuries(spark, [(1, plus(-365), plus(-350), 15.0), (1, plus(-366), plus(-360), 9.0), (1, T0, plus(8), 8.0)])
    row = one(features.panel_features(probe(spark), [features.injury_history(inj)]))
    assert (row["injuries_last_365d"], row["days_out_last_365d"]) == (1, 15.0)
    inj = injuries(spark, [(1, plus(-50), plus(-5), 45.0), (1, plus(-20), plus(-15), 10.0)])
    row = one(features.panel_features(probe(spark), [features.injury_history(inj)]))
    assert (row["days_since_last_injury_end"], row["days_since_last_injury_start"]) == (5, 20)
    assert row["last_injury_days_out"] == 10.0


def test_clean_intervals(spark):
    raw = injuries(
        spark,
        [
            (1, None, plus(1), 3.0), (2, T0, None, 10.0), (3, T0, plus(4), None), (4, T0, plus(-1), 9.0),
            (5, T0, None, None), (6, T0, plus(5), 5.0), (6, T0, plus(12), 12.0),
        ],
    )
    got = {r["player_id"]: (r["injury_end"], r["days_out"]) for r in cleaning.clean_intervals(raw).collect()}
    assert got == {2: (plus(10), 10.0), 3: (plus(4), 4.0), 5: (None, None), 6: (plus(12), 12.0)}


def test_as_of_ties_and_edges(spark):
    facts = spark.createDataFrame(
        [(1, plus(-3), 1.0, 1), (1, T0, 2.0, 2), (1, T0, 3.0, 1), (1, plus(1), 9.0, 3)], "player_id long, date date, value double, pos int"
    )
    out = temporal.as_of_value(facts, probe(spark), "player_id", "date", "week_start", "value", "v", tiebreak="pos")
    assert one(out)["v"] == 2.0
    lagged = spark.createDataFrame([(1, plus(-181), 1.0), (1, plus(-180), 2.0), (1, plus(-179), 3.0)], "player_id long, date date, value double")
    row = one(features.panel_features(probe(spark), [features.value_context(lagged)]))
    assert (row["market_value"], row["market_value_6m"]) == (3.0, 2.0)


def test_missing_latest_value_is_zero(spark):
    facts = spark.createDataFrame([(1, plus(-9), 5.0), (1, plus(-1), None)], "player_id long, date date, value double")
    assert one(features.panel_features(probe(spark), [features.value_context(facts)]))["market_value"] == 0.0


def test_transfer_sentinels(spark):
    def read(rows):
        t = spark.createDataFrame(rows, "player_id long, transfer_date date")
        return one(features.panel_features(probe(spark), [features.transfer_context(t)]))["days_since_transfer"]

    assert read([(2, plus(-5))]) == 3650
    assert read([(1, day("1900-07-01"))]) == 3650
    assert read([(1, T0), (1, plus(-3))]) == 0
    absent = features.panel_features(probe(spark), [features.transfer_context(None), features.value_context(None)])
    row = one(absent)
    assert (row["days_since_transfer"], row["log_market_value"]) == (9999, 0.0)


@pytest.mark.parametrize("last,flag", [(30, 1), (29, 0)])
def test_censoring(spark, last, flag):
    inj = injuries(spark, [(9, plus(last), plus(last + 9), 9.0)])
    assert one(labels.add_not_censored(probe(spark), inj))["not_censored"] == flag


@pytest.mark.parametrize("first,flag", [(14, 1), (15, 0)])
def test_activity_window(spark, first, flag):
    windows = labels.windows_of(apps(spark, [(1, plus(first), 90.0)]))
    assert one(labels.add_active_player(probe(spark), windows))["active_player"] == flag


def games(spark, rows):
    return spark.createDataFrame(rows, "game_id long, competition_id string, season int, game_date date, home_club_id long, away_club_id long")


def test_calendar_fills_gaps(spark):
    g = games(spark, [(1, "GB1", 2023, T0, 1, 2), (2, "GB1", 2023, plus(23), 2, 1)])
    assert sorted(r["week_start"] for r in grid.league_calendar(g).collect()) == [T0, plus(7), plus(14), plus(21)]


def test_primary_league_tie_and_club_fallback(spark):
    g = games(spark, [(1, "GB1", 2023, T0, 1, 2), (2, "ES1", 2023, T0, 3, 4), (3, "CUP", 2023, T0, 8, 9)])
    leagues = grid.club_leagues(g.filter(F.col("competition_id") != "CUP"))
    a = spark.createDataFrame(
        [(1, 1, 1, 1, 45.0), (1, 2, 3, 3, 45.0), (2, 3, 8, 4, 10.0)],
        "player_id long, game_id long, player_club_id long, player_current_club_id long, minutes_played double",
    ).withColumn("date", F.lit(T0))
    minutes = grid.attributed_minutes(leagues, grid.appearance_facts(a, g))
    assert {r["player_id"]: r["competition_id"] for r in grid.primary_league(minutes).collect()} == {1: "ES1", 2: "ES1"}


def test_cohort_fallback(spark):
    comps = spark.createDataFrame(
        [("GB1", "x", "England", "first_tier"), ("ES1", "x", "Spain", "first_tier"), ("L1", "x", "Germany", "first_tier"),
         ("IT1", "x", "Italy", "first_tier"), ("LIGUE", "x", "France", "first_tier"), ("COUPE", "x", "France", "domestic_cup"),
         ("ERE", "x", "Netherlands", "first_tier")],
        "competition_id string, competition_code string, country_name string, sub_type string",
    )
    got = {r[0] for r in cleaning.target_competitions(comps).collect()}
    assert got == {"GB1", "ES1", "L1", "IT1", "LIGUE"}


@pytest.mark.parametrize("known,status", [(699, "FAIL"), (700, "PASS")])
def test_overlap_gate(spark, known, status):
    cohort = spark.range(1000).withColumnRenamed("id", "player_id")
    inj = spark.range(known).withColumnRenamed("id", "player_id")
    assert {r["status"] for r in audits.overlap_gate(cohort, inj).collect()} == {status}


def test_swept_windows_match_band_joins(spark):
    """Random events and probes, one entity with a third of all rows: both formulations agree."""
    events = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).cast("long").alias("player_id"),
        F.date_add(F.lit(T0), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200)).cast("int")).alias("date"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(91)).cast("double").alias("minutes"),
    )
    probes = spark.range(40).withColumnRenamed("id", "player_id").select(
        "player_id", F.explode(F.sequence(F.lit(T0), F.lit(plus(210)), F.expr("interval 7 days"))).alias("week_start")
    )
    for days in (3, 7, 10, 28, 56):
        fast = temporal.prior_sums(events, probes, "player_id", "date", "week_start", "minutes", {"m": days})
        slow = temporal.band_sum(events, probes, "player_id", "date", "week_start", "minutes", "b", days)
        assert fast.join(slow, ["player_id", "week_start"]).filter("m <> b").count() == 0
        assert fast.count() == probes.count()


def test_reference_plan_has_one_window_and_one_exchange_of_the_grid(spark):
    facts = apps(spark, [(1, plus(-1), 90.0)])
    inj = injuries(spark, [(1, plus(5), plus(20), 15.0)])
    out = features.panel_features(probe(spark), [features.workload(facts), features.congestion(facts), features.injury_family(inj)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1


def test_narrow_panel_equals_the_columns_of_the_whole(spark):
    facts = apps(spark, [(1, plus(-8), 1.0), (1, plus(-3), 30.0), (2, plus(-1), 90.0)])
    games = spark.createDataFrame(
        [(i, "GB1", 2023, d, 20, 10) for i, d in enumerate([plus(-8), plus(-3), plus(-1)])],
        "game_id long, competition_id string, season int, game_date date, home_club_id long, away_club_id long",
    )
    apps_ = facts.drop("game_date", "season", "home_club_id", "away_club_id").withColumn("player_current_club_id", F.lit(10).cast("long"))
    leagues = spark.createDataFrame([("GB1", "premier-league")], "competition_id string, competition_code string")
    profiles = spark.createDataFrame([(1, 180.0, "Back", day("2000-01-01"))], "player_id long, height double, position string, date_of_birth date")
    moves = spark.createDataFrame([(1, plus(-100))], "player_id long, transfer_date date")
    given = PanelInputs(apps_, games, leagues, injuries(spark, [(1, plus(-5), plus(6), 11.0), (None, T0, T0, 1.0)]), profiles, moves)
    whole = build_panel(given)
    for columns in (["player_id", "week_start", "season", "target", "label_known"], ["week_start", "acwr", "position", "log_market_value"]):
        narrow = build_panel(given, columns=columns)
        assert narrow.columns == columns
        assert sorted(map(repr, narrow.collect())) == sorted(map(repr, whole.select(*columns).collect()))
    # Labels need neither transfers nor the minutes of appearances.
    plan = build_panel(given, columns=["player_id", "week_start", "target"])._jdf.queryExecution().analyzed().toString()
    assert "transfer_date" not in plan and "wl_minutes" not in plan


def test_weeks_expanded_behind_the_windows(spark):
    """Spans that overlap, days shared by facts, keys without facts or without spans: the rows of probes that were expanded before."""
    spans = spark.createDataFrame(
        [(1, T0, plus(70), "a"), (1, plus(63), plus(140), "b"), (2, plus(7), plus(7), "a"), (3, T0, plus(28), "c")],
        "player_id long, min_week date, max_week date, season string",
    )
    facts = apps(spark, [(1, plus(d), float(m)) for d, m in ((-400, 9), (-3, 30), (0, 90), (0, 10), (6, 5), (64, 45), (300, 1))] + [(2, plus(7), 8.0), (9, T0, 1.0)])
    inj = injuries(spark, [(1, plus(5), plus(20), 15.0), (1, plus(18), plus(40), 9.0), (3, plus(-2), None, 8.0), (3, plus(30), plus(31), 2.0)])
    families = [features.appearance_load(facts), features.injury_family(inj)]
    probes = spans.withColumn("week_start", F.explode(F.sequence("min_week", "max_week", F.expr("interval 7 days")))).drop("min_week", "max_week")
    before = features.panel_features(probes, families)
    out = features.weekly_features(spans, families)
    assert out.count() == 11 + 12 + 1 + 5
    assert sorted(map(repr, out.select(*before.columns).collect())) == sorted(map(repr, before.collect()))


def test_panel_shuffles_and_sorts_no_weekly_rows(spark):
    games = spark.createDataFrame(
        [(0, "GB1", 2023, T0, 20, 10)], "game_id long, competition_id string, season int, game_date date, home_club_id long, away_club_id long"
    )
    apps_ = apps(spark, [(1, T0, 1.0)]).drop("game_date", "season", "home_club_id", "away_club_id").withColumn("player_current_club_id", F.lit(10).cast("long"))
    leagues = spark.createDataFrame([("GB1", "premier-league")], "competition_id string, competition_code string")
    profiles = spark.createDataFrame([(1, 180.0, "Back", day("2000-01-01"))], "player_id long, height double, position string, date_of_birth date")
    panel = build_panel(PanelInputs(apps_, games, leagues, injuries(spark, [(1, plus(1), plus(9), 8.0)]), profiles))
    plan = panel._jdf.queryExecution().optimizedPlan().toString().split("explode(sequence(")
    assert len(plan) == 2  # lines before it stand above it: they see weekly rows
    assert not any(step in plan[0] for step in ("Window", "Repartition", "Sort", "Aggregate", "LeftOuter"))


def test_points_outside_intervals(spark):
    """The same points as the join by bucket: repeats, null keys and dates, empty, reversed and undated intervals, limits of blocks, days before 1970."""
    rng = random.Random(5)
    date = lambda low, high: None if rng.random() < 0.05 else day("1969-11-01") + dt.timedelta(days=rng.randint(low, high))
    key = lambda: None if rng.random() < 0.05 else rng.randint(1, 6)
    points = [(key(), date(0, 400)) for _ in range(900)]
    points = spark.createDataFrame(points + points[:50], "player_id long, week_start date")
    spans = [(key(), date(0, 400)) for _ in range(25)]
    spans = [(k, a, a and rng.choice([None, a - dt.timedelta(days=1), a, a + dt.timedelta(days=rng.choice([5, 63, 64, 140]))])) for k, a in spans]
    spans = spark.createDataFrame(spans, "player_id long, injury_start date, injury_end date")
    ends = F.col("injury_start"), F.col("injury_end")
    asked = lambda df: sorted(map(str, df.collect()))
    want = joins.points_in_intervals(points, spans, "player_id", "week_start", *ends, "left_anti")
    found = asked(joins.points_outside(points, spans, "player_id", "week_start", *ends))
    assert found == asked(want) and 0 < len(found) < 950
    inside = joins.points_in_intervals(points, spans, "player_id", "week_start", *ends)
    assert joins.points_outside(inside, spans, "player_id", "week_start", *ends).isEmpty()


def test_ineligible_rows_are_not_shuffled(spark, tmp_path):
    """No exchange or sort of the audit carries weekly rows: what crosses it are blocks of days."""
    weeks = spark.range(200).select((F.col("id") % 2).alias("player_id"), F.date_add(F.lit(T0), (7 * F.floor(F.col("id") / 2)).cast("int")).alias("week_start"))
    panel = weeks.withColumn("ineligible", F.lit(1)).coalesce(1)
    spans = injuries(spark, [(p, T0, plus(650), 9.0) for p in (0, 1)])
    found = audits.ineligible_correctness(panel, spans)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftAnti" not in plan
    # Weeks 0 to 92 of each player lie in the interval, the last seven don't.
    assert {r["metric"]: r["value"] for r in found.collect()} == {"checked": 200.0, "errors": 14.0}


def test_recomputed_weeks_are_not_shuffled(spark):
    """What the recount shuffles are blocks of weeks, not weeks, and probes that come twice count once."""
    weeks = spark.range(600).select((F.col("id") % 2).alias("player_id"), F.date_add(F.lit(T0), (7 * F.floor(F.col("id") / 2)).cast("int")).alias("week_start"))
    spans = injuries(spark, [(p, plus(7 * i), plus(7 * i + 3), 9.0) for p in (0, 1) for i in range(0, 300, 10)])
    ones = spans.select("player_id", "injury_start", F.lit(1.0).alias("one"))
    by_day = {p: {i for i in range(0, 300, 10)} for p in (0, 1)}
    found = temporal.band_sum(ones, weeks.unionByName(weeks), "player_id", "injury_start", "week_start", "one", "n", 365)
    rows = {(r["player_id"], (r["week_start"] - T0).days // 7): r["n"] for r in found.collect()}
    assert found.count() == len(rows) == 600
    assert all(n == len([i for i in by_day[p] if 0 < w - i <= 52]) for (p, w), n in rows.items())
    panel = found.withColumnRenamed("n", "injuries_last_365d")
    events = spans.select("player_id", F.col("injury_start").alias("date"), F.lit(1).alias("minutes_played"))
    audited = (audits.history_recompute(panel, spans), 598.0), (audits.rolling_recompute(panel, events, "injuries_last_365d", 365), 600.0)
    for audit, checked in audited:  # the count of the first week is 0
        plan = audit._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "week_start" in line.split("hashpartitioning")[1].split(")")[0]]
        assert {r["metric"]: r["value"] for r in audit.collect() if r["metric"] != "max_gap"} == {"checked": checked, "errors": 0.0}


def test_panel_reads_its_joins_once(spark, tmp_path):
    """What several parts of the panel read is joined once and kept: the lines themselves are not in the plan any more."""
    number = F.col("id")
    day = F.date_add(F.lit("1997-01-06").cast("date"), (number * 7 % 900).cast("int")).cast("timestamp")
    status = F.when(number % 2 == 0, "F").otherwise("O")
    priority = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (number % 5 + 1).cast("int"))
    tables = {
        "orders": spark.range(1, 81).select(
            number.alias("o_orderkey"), (number % 9).alias("o_custkey"), status.alias("o_orderstatus"), (number * 10.0).alias("o_totalprice"),
            day.alias("o_orderdate"), priority.alias("o_orderpriority"),
        ),
        "lineitem": spark.range(300).select(
            (number % 85).alias("l_orderkey"), (number % 6).alias("l_suppkey"), (number % 7 + 1).cast("int").alias("l_linenumber"), (number % 50 + 1.0).alias("l_quantity"),
            (number % 4 / 100.0).alias("l_discount"), (number % 3 / 100.0).alias("l_tax"), F.when(number % 3 == 0, "R").otherwise("A").alias("l_returnflag"),
            status.alias("l_linestatus"), (day + F.expr("interval 20 days")).alias("l_shipdate"),
        ),
        "customer": spark.range(1, 9).select(number.alias("c_custkey"), F.lit("x").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Standins(spark, str(tmp_path))
    for columns in (None, panel_queries.LOADS):
        kept = panel_queries.panel(t, columns)
        assert not [f for f in kept.inputFiles() if "lineitem.parquet" in f]
        plain = build_panel(panel_queries.inputs(t), columns=columns)
        assert kept.columns == plain.columns and kept.count() == plain.count() > 100
        assert kept.exceptAll(plain).isEmpty()
    # A narrow panel without loads reads the appearances once, so they are not kept for it.
    store = panel_queries.stages(t)
    build_panel(panel_queries.inputs(t), stages=store, columns=["player_id", "week_start", "target"])
    assert store.built == store.reused == []
