"""Queries for aggregates, scalar functions, ordering, sampling, set operations, sources, sinks and matching."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cleaning, explore, fused, grid, joins, matching, profile, sampling
from ..operators.features import KEY, WEEK
from ..plans import jobs, steps
from ..session import shared_dir, stored
from ..sources import readers, sinks
from .audit_queries import BY_LOAD, BY_POSITION, BY_SEASON, PANEL_COLUMNS
from .panel_queries import LOADS, bigints, cohort, kept_inputs, kept_panel, panel, rounded
from .registry import query


def scratch(t) -> str:
    """A new folder in the shared space for what a query writes and reads back."""
    return f"{shared_dir(t.spark).rstrip('/')}/run-{uuid.uuid4().hex}"


# --- aggregates ---------------------------------------------------------------------------------------


@query("A1_group_sum_count", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2
""")
def group_sum_count(t):
    return t.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n")
    )


@query("A2_group_min_max", """
SELECT player_id, min(date) AS first_app, max(date) AS last_app FROM appearances GROUP BY 1
""")
def group_min_max(t):
    return t.appearances.groupBy(KEY).agg(F.min("date").alias("first_app"), F.max("date").alias("last_app"))


@query("A3_count_and_mean", """
SELECT event_type, count(*)::BIGINT AS n, round(avg((value > 20)::INTEGER), 6) AS prevalence FROM events GROUP BY 1
""")
def count_and_mean(t):
    big = t.raw("events").withColumn("target", (F.col("value") > 20).cast("int"))
    out = profile.prevalence_by(big, "event_type")
    return out.select("event_type", F.col("weeks").alias("n"), F.round(F.col("rate_pct") / 100, 6).alias("prevalence"))


@query("A4_distinct_count", """
SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers
FROM lineitem GROUP BY 1
""")
def distinct_count(t):
    return t.raw("lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query("A5_daily_long_form", """
SELECT player_id, date, sum(coalesce(minutes_played, 0))::DOUBLE AS minutes, count(*)::BIGINT AS matches
FROM appearances GROUP BY 1, 2
""")
def daily_long_form(t):
    return t.appearances.groupBy(KEY, "date").agg(
        F.sum(scalars.measure("minutes_played")).alias("minutes"), F.count(F.lit(1)).alias("matches")
    )


@query("A6_conditional_counts", """
SELECT injury_reason, count(*) FILTER (days_out >= 7)::BIGINT AS serious, count(*) FILTER (days_out < 7)::BIGINT AS minor,
  round(avg((days_out >= 7)::INTEGER), 6) AS serious_rate FROM injuries GROUP BY 1
""")
def conditional_counts(t):
    days = F.col("days_out")
    return t.injuries.groupBy("injury_reason").agg(
        F.count_if(days >= 7).alias("serious"), F.count_if(days < 7).alias("minor"),
        F.round(F.avg((days >= 7).cast("int")), 6).alias("serious_rate"),
    )


@query("A7_moments_and_quantiles", """
SELECT round(avg(minutes_played), 6) AS mean, round(stddev_samp(minutes_played), 6) AS std, min(minutes_played)::DOUBLE AS min,
  max(minutes_played)::DOUBLE AS max, round(quantile_cont(minutes_played::DOUBLE, 0.25), 6) AS p25,
  round(quantile_cont(minutes_played::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(minutes_played::DOUBLE, 0.75), 6) AS p75
FROM appearances
""")
def moments_and_quantiles(t):
    out = profile.numeric_summary(t.appearances.select("minutes_played")).drop("column", "count")
    return rounded(out, "mean", "std", "p25", "p50", "p75")


@query("A8_most_frequent_values", """
SELECT value, n::BIGINT AS n FROM (SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r
  FROM part GROUP BY 1) WHERE r <= 10
""")
def most_frequent_values(t):
    return profile.top_values(t.raw("part"), 10, ["p_brand"]).select("value", "n")


@query("A9_largest_values", """
SELECT row_number() OVER (ORDER BY v DESC)::BIGINT AS place, v AS value
FROM (SELECT o_totalprice AS v FROM orders ORDER BY 1 DESC LIMIT 5)
""")
def largest_values(t):
    return profile.largest_values(t.raw("orders").select("o_totalprice")).select("place", "value")


@query("A10_duplicate_rows", """
SELECT count(*)::BIGINT AS n_rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)))::BIGINT AS duplicate_rows
FROM (SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_size < 10)
""")
def duplicate_rows(t):
    """Whole rows; small parts are there twice."""
    part = t.raw("part")
    return profile.basic_stats(part.unionByName(part.filter("p_size < 10"))).select("n_rows", "duplicate_rows")


@query("A11_null_fraction", """
SELECT 'injury_start' AS "column", round(avg((injury_start IS NULL)::INTEGER), 6) AS fraction FROM raw_injuries
UNION ALL SELECT 'injury_end', round(avg((injury_end IS NULL)::INTEGER), 6) FROM raw_injuries
UNION ALL SELECT 'days_out', round(avg((days_out IS NULL)::INTEGER), 6) FROM raw_injuries
""")
def null_fraction(t):
    table = profile.missingness(t.raw_injuries.select("injury_start", "injury_end", "days_out"))
    return table.select("column", F.round(F.col("missing_pct") / 100, 6).alias("fraction"))


@query("A12_two_column_aggregate", """
SELECT s_nationkey::BIGINT AS nation, min(s_acctbal) AS lo, max(s_acctbal) AS hi, count(s_suppkey)::BIGINT AS n,
  round(avg(s_suppkey), 6) AS mean_key FROM supplier GROUP BY 1
""")
def two_column_aggregate(t):
    out = t.raw("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.count("s_suppkey").alias("n"),
        F.avg("s_suppkey").alias("mean_key"),
    )
    return rounded(bigints(out), "mean_key")


@query("A13_share_of_total", """
SELECT l_returnflag, sum(l_quantity) AS quantity, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS share
FROM lineitem GROUP BY 1
""")
def share_of_total(t):
    by_flag = t.raw("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"))
    total = by_flag.agg(F.sum("quantity").alias("_total"))
    return by_flag.crossJoin(F.broadcast(total)).select(  # one row
        "l_returnflag", "quantity", F.round(F.col("quantity") / F.col("_total"), 6).alias("share")
    )


@query("A14_prefix_sums", """
SELECT player_id, date, sum(m) OVER (PARTITION BY player_id ORDER BY date) AS running
FROM (SELECT player_id, date, sum(coalesce(minutes_played, 0))::DOUBLE AS m FROM appearances GROUP BY 1, 2)
""")
def prefix_sums(t):
    daily = daily_long_form(t)
    order = Window.partitionBy(KEY).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(KEY, "date", F.sum("minutes").over(order).alias("running"))


# --- scalar functions ---------------------------------------------------------------------------------


@query("F1_F2_F3_F4_date_functions", """
SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS monday, (isodow(o_orderdate) - 1)::BIGINT AS weekday,
  o_orderdate::DATE + 30 AS plus_30, o_orderdate::DATE - 180 AS minus_180,
  (DATE '2001-12-31' - o_orderdate::DATE)::BIGINT AS days_left, (o_orderdate::DATE - INTERVAL 6 MONTH)::DATE AS minus_6m
FROM orders
""")
def date_functions(t):
    d = F.col("o_orderdate").cast("date")
    return bigints(t.raw("orders").select(
        "o_orderkey", scalars.monday(d).alias("monday"), F.weekday(d).alias("weekday"), F.date_add(d, 30).alias("plus_30"),
        F.date_sub(d, 180).alias("minus_180"), F.datediff(F.lit("2001-12-31").cast("date"), d).alias("days_left"),
        F.add_months(d, -6).alias("minus_6m"),
    ))


@query("F5_F11_F12_number_functions", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS logged, round(o_custkey / (o_orderkey + 1 + 0.000001), 6) AS smoothed,
  least(greatest(o_totalprice, 1000), 200000) AS clipped,
  coalesce(try_cast(CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE o_custkey::VARCHAR END AS DOUBLE), 0) AS coerced
FROM orders
""")
def number_functions(t):
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    return t.raw("orders").select(
        "o_orderkey", F.round(F.log1p(price), 6).alias("logged"), F.round(key / (F.col("o_orderkey") + 1 + F.lit(0.000001)), 6).alias("smoothed"),
        scalars.clip(price, 1000.0, 200000.0).alias("clipped"),
        scalars.measure(F.when(F.col("o_orderstatus") == "F", "x").otherwise(key.cast("string"))).alias("coerced"),
    )


@query("F6_F7_F8_F9_text_functions", r"""
SELECT p_partkey, upper(p_name) AS upper_name, replace(p_name, ' ', '_') AS joined,
  regexp_replace(regexp_replace(lower(p_brand || ' - ' || p_name), '[\s\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS slug,
  (lower(p_type) LIKE '%nom%')::BIGINT AS has_nom, regexp_matches(p_name, '(?i)RING|bolt')::BIGINT AS pattern,
  (p_type IN ('SMALL', 'LARGE'))::BIGINT AS member
FROM part
""")
def text_functions(t):
    name = F.col("p_name")
    out = t.raw("part").select(
        "p_partkey", F.upper(name).alias("upper_name"), F.replace(name, F.lit(" "), F.lit("_")).alias("joined"),
        scalars.slug(F.concat_ws(" - ", "p_brand", "p_name")).alias("slug"),
        scalars.contains_ci("p_type", "NOM").cast("int").alias("has_nom"), name.rlike("(?i)RING|bolt").cast("int").alias("pattern"),
        F.col("p_type").isin("SMALL", "LARGE").cast("int").alias("member"),
    )
    return bigints(out)


@query("F10_position_groups", """
SELECT player_id, CASE WHEN position IS NULL THEN 'Unknown' WHEN lower(position) LIKE '%goalkeeper%' THEN 'GK'
  WHEN lower(position) LIKE '%defender%' OR lower(position) LIKE '%back%' THEN 'DEF' WHEN lower(position) LIKE '%midfield%' THEN 'MID'
  WHEN lower(position) LIKE '%attack%' OR lower(position) LIKE '%winger%' THEN 'FWD' ELSE 'Other' END AS pos_group FROM profiles
""")
def position_groups(t):
    return t.profiles.select(KEY, scalars.position_group("position").alias("pos_group"))


@query("F13_range_labels", "SELECT p_partkey, printf('%.0f-%.0f', p_size::DOUBLE, p_size + 10.0::DOUBLE) AS label FROM part")
def range_labels(t):
    return t.raw("part").select("p_partkey", scalars.range_label("p_size", F.col("p_size") + 10).alias("label"))


@query("F14_predicates", """
SELECT o_orderkey, o_orderdate::DATE AS day FROM orders
WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')
""")
def predicates(t):
    day = F.col("o_orderdate").cast("date")
    return t.raw("orders").filter(
        scalars.all_of([
            day.between(F.lit("1997-01-01").cast("date"), F.lit("1999-06-30").cast("date")),
            F.col("o_orderstatus") == "F", F.col("o_orderpriority").isin("1-URGENT", "5-LOW"),
        ])
    ).select("o_orderkey", day.alias("day"))


# --- order, top, samples, sets ------------------------------------------------------------------------


@query("T1_ordered_rows", "SELECT coalesce(transfer_date, DATE '1900-01-01') AS transfer_date, player_id FROM transfers ORDER BY 1, 2")
def ordered_rows(t):
    dated = t.transfers.select(F.coalesce("transfer_date", F.lit("1900-01-01").cast("date")).alias("transfer_date"), KEY)
    return dated.orderBy("transfer_date", KEY)


@query("T2_head", "SELECT player_id, name FROM players ORDER BY player_id LIMIT 200")
def head(t):
    return t.players.select(KEY, "name").orderBy(KEY).limit(200)


@query("T3_tail", "SELECT game_date, game_id FROM (SELECT game_date, game_id FROM games ORDER BY 1 DESC, 2 DESC LIMIT 60)")
def tail(t):
    return sampling.tail_rows(t.games.select("game_date", "game_id"), ["game_date", "game_id"], 60)


@query("T4_top_by_measure", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_by_measure(t):
    open_orders = t.raw("orders").filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")
    return sampling.top_rows(open_orders, "o_totalprice", 5, ["o_orderkey"])


@query("T6_seeded_sample", """
SELECT player_id, week_start FROM (SELECT player_id, week_start, season,
  ('0x' || substr(md5('42|' || player_id || '|' || week_start || '|' || season), 1, 13))::BIGINT AS h FROM grid
  ORDER BY h, player_id, week_start, season LIMIT 5000)
""")
def seeded_sample(t):
    return sampling.sample_rows(cohort(t), 5000, [KEY, WEEK, "season"], 42).select(KEY, WEEK)


@query("T7_union_all", """
SELECT season::BIGINT AS season, club_id, count(*)::BIGINT AS n FROM (SELECT season, home_club_id AS club_id FROM games
  UNION ALL SELECT season, away_club_id FROM games) WHERE club_id IS NOT NULL GROUP BY 1, 2
""")
def union_all(t):
    home = t.games.select("season", F.col("home_club_id").alias("club_id"))
    both = home.unionByName(t.games.select("season", F.col("away_club_id").alias("club_id")))
    return bigints(both.filter(F.col("club_id").isNotNull()).groupBy("season", "club_id").agg(F.count(F.lit(1)).alias("n")))


@query("T8_distinct_rows", "SELECT DISTINCT player_id, competition_id FROM appearances")
def distinct_rows(t):
    return t.appearances.select(KEY, "competition_id").distinct()


@query("T9_set_operations", """
SELECT 'union' AS kind, player_id FROM (SELECT player_id FROM injuries UNION SELECT player_id FROM profiles)
UNION ALL SELECT 'intersect', player_id FROM (SELECT player_id FROM injuries INTERSECT SELECT player_id FROM profiles)
UNION ALL SELECT 'except', player_id FROM (SELECT player_id FROM injuries EXCEPT SELECT player_id FROM profiles)
""")
def set_operations(t):
    # One pass over tagged keys answers all three, whatever share of the rows one key has.
    seen = joins.key_presence(t.injuries, t.profiles, KEY)
    left, right = F.col("left_n") > 0, F.col("right_n") > 0
    kinds = F.array(
        F.lit("union"), F.when(left & right, "intersect"), F.when(left & ~right, "except")
    )
    return seen.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), KEY)


@query("T10_groups_by_size", """
SELECT o_custkey, count(*)::BIGINT AS n, round(avg((o_orderstatus = 'F')::INTEGER), 6) AS prevalence FROM orders GROUP BY 1
ORDER BY n DESC, o_custkey LIMIT 200
""")
def groups_by_size(t):
    grouped = t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("prevalence"))
    return grouped.orderBy(F.desc("n"), "o_custkey").limit(200)


@query("U2_U3_native_row_functions", """
SELECT player_id, week_start, max(m) OVER (PARTITION BY player_id ORDER BY week_start ROWS 2 PRECEDING)::DOUBLE AS best3
FROM (SELECT player_id, date_trunc('week', date)::DATE AS week_start, sum(coalesce(minutes_played, 0)) AS m FROM appearances GROUP BY 1, 2)
""")
def native_row_functions(t):
    rows = Window.partitionBy(KEY).orderBy(WEEK).rowsBetween(-2, 0)
    sparse = grid.sparse_grid(t.games, t.appearances)
    return sparse.select(KEY, WEEK, F.max("minutes_week").over(rows).alias("best3"))


# --- matching -----------------------------------------------------------------------------------------


@query("U1_J13_fuzzy_matches")
def fuzzy_matches(t):
    names = t.raw("part").select(F.col("p_name").alias("injury_name")).unionByName(
        t.raw("supplier").select(F.concat_ws(" ", F.lit("crew"), "s_name").alias("injury_name"))
    )
    people = t.raw("part").select(
        F.col("p_partkey").alias("player_id"), F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), "p_brand").alias("name")
    )
    return matching.best_matches(names, people)


@query("J13_reordered_names", """
SELECT c_name || ' ' || c_mktsegment AS injury_name, c_mktsegment || ' ' || c_name AS candidate_name, 100.0::DOUBLE AS match_score,
  c_custkey AS player_id FROM customer
""")
def reordered_names(t):
    people = t.raw("customer")
    names = people.select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("injury_name"))
    players = people.select(F.col("c_custkey").alias("player_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))
    return matching.best_matches(names, players)


# --- sources and sinks --------------------------------------------------------------------------------


@query("S1_S13_backbone_round_trip", """
SELECT player_id, game_id, date, coalesce(minutes_played, -1)::DOUBLE AS minutes_played, season::BIGINT AS season, game_date
FROM appearances JOIN games USING (game_id)
""")
def backbone_round_trip(t):
    folder = scratch(t)
    tables = {"appearances": t.appearances, "games": t.games.withColumnRenamed("game_date", "date"), "players": t.players, "competitions": t.competitions}
    for name, df in tables.items():
        sinks.write_csv(df, f"{folder}/{name}.csv")
    back = readers.load_backbone(t.spark, folder)
    joined = back["appearances"].join(back["games"].select("game_id", "season", "game_date"), "game_id")
    return bigints(joined.select(
        KEY, "game_id", "date", F.coalesce("minutes_played", F.lit(-1.0)).alias("minutes_played"), "season", "game_date"
    ))


@query("S2_S4_label_tables", """
SELECT player_id, coalesce(injury_start, DATE '1900-01-01') AS injury_start, coalesce(injury_end, DATE '1900-01-01') AS injury_end,
  coalesce(days_out, -1)::DOUBLE AS days_out FROM raw_injuries
""")
def label_tables(t):
    folder = scratch(t)
    spelled = t.raw_injuries.withColumnsRenamed({"injury_start": "from_date", "injury_end": "end_date", "days_out": "days_missed"})
    sinks.write_csv(spelled.repartition(8), f"{folder}/injuries")  # eight parts, one table
    loaded = readers.load_labels(t.spark, folder)["injuries"]
    long_ago = F.lit("1900-01-01").cast("date")
    return loaded.select(
        KEY, F.coalesce("injury_start", long_ago).alias("injury_start"), F.coalesce("injury_end", long_ago).alias("injury_end"),
        F.coalesce("days_out", F.lit(-1.0)).alias("days_out"),
    )


@query("S3_S10_header_inventory", "SELECT 'c_custkey,c_mktsegment,c_name' AS header, count(*)::BIGINT AS n_rows FROM customer")
def header_inventory(t):
    folder = scratch(t)
    sinks.write_csv(t.raw("customer").select("c_custkey", "c_mktsegment", "c_name").repartition(4), folder)
    found = readers.header_inventory(t.spark, folder)
    return found.groupBy(F.array_join("cols", ",").alias("header")).agg(F.sum("n_rows").alias("n_rows"))


@query("S9_panel_scan", """
SELECT competition_id, season::BIGINT AS season, count(*)::BIGINT AS n, count(DISTINCT player_id)::BIGINT AS players
FROM grid WHERE competition_id = 'GB1' AND week_start >= DATE '1996-01-01' GROUP BY 1, 2
""")
def panel_scan(t):
    """The written panel as a view, asked in SQL with bound values."""
    folder = scratch(t)
    sinks.write_panel(cohort(t), f"{folder}/panel")
    return explore.scan_panel(
        t.spark, f"{folder}/panel", """
        SELECT competition_id, CAST(season AS BIGINT) AS season, count(*) AS n, count(DISTINCT player_id) AS players
        FROM panel WHERE competition_id = :league AND week_start >= :since GROUP BY competition_id, season
        """, {"league": "GB1", "since": dt.date(1996, 1, 1)},
    )


@query("S2_profile_transfer_value_tables", """
SELECT 'profiles' AS name, count(*)::BIGINT AS n, count(DISTINCT player_id)::BIGINT AS players FROM profiles
UNION ALL SELECT 'transfers', count(*), count(DISTINCT player_id) FROM transfers
UNION ALL SELECT 'market_values', count(*), count(DISTINCT player_id) FROM market_values
""")
def other_label_tables(t):
    folder = scratch(t)
    spelled = {
        "profiles": t.profiles, "transfers": t.transfers.withColumn("from_team_id", F.lit(0)),
        "market_values": t.market_values.withColumnRenamed("value", "market_value_in_eur"),
    }
    for name, df in spelled.items():
        sinks.write_csv(df.repartition(3), f"{folder}/{name}")
    loaded = readers.load_labels(t.spark, folder)
    out = None
    for name in ("profiles", "transfers", "market_values"):
        own = loaded[name].agg(F.count(F.lit(1)).alias("n"), F.countDistinct(KEY).alias("players"))
        own = own.select(F.lit(name).alias("name"), "n", "players")
        out = own if out is None else out.unionByName(own)
    return bigints(out)


@query("S7_ragged_lines", "SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS name FROM nation WHERE n_nationkey % 3 < 2")
def ragged_lines(t):
    """Lines with too few fields are kept, those with too many are not."""
    folder, key = scratch(t), F.col("n_nationkey").cast("string")
    line = F.when(key.cast("int") % 3 == 0, key).when(key.cast("int") % 3 == 1, F.concat_ws(",", key, "n_name")).otherwise(F.concat_ws(",", key, "n_name", F.lit("more")))
    lines = t.raw("nation").select("n_nationkey", line.alias("value"))
    header = t.spark.createDataFrame([(-1, "key,name")], "n_nationkey long, value string")
    header.unionByName(lines.withColumn("n_nationkey", F.col("n_nationkey").cast("long"))).repartitionByRange(1, "n_nationkey").sortWithinPartitions("n_nationkey").select("value").write.text(f"{folder}/t.csv")
    return readers.load_table(t.spark, f"{folder}/t.csv")


@query("S7_quoted_records", r"""
SELECT c_custkey::BIGINT AS key,
  CASE c_custkey % 5 WHEN 0 THEN c_name || chr(10) || 'said, "yes"' || chr(10) || chr(10) || c_mktsegment WHEN 1 THEN '"' || c_name || '"' WHEN 2 THEN c_name || chr(65533)
    WHEN 3 THEN c_name || ' 5" x' ELSE c_name || ',' END AS note,
  c_acctbal::DOUBLE AS balance FROM customer
""")
def quoted_records(t):
    """Fields with line breaks, doubled quotes, stray quotes, commas and bytes that are no UTF-8, in several files."""
    folder, key = scratch(t), F.col("c_custkey")
    bad = F.unhex(F.lit("FF")).cast("string")
    quoted = lambda *parts: F.concat(F.lit('"'), F.replace(F.concat(*parts), F.lit('"'), F.lit('""')), F.lit('"'))
    note = (
        F.when(key % 5 == 0, quoted(F.col("c_name"), F.lit('\nsaid, "yes"\n\n'), F.col("c_mktsegment"))).when(key % 5 == 1, quoted(F.lit('"'), F.col("c_name"), F.lit('"')))
        .when(key % 5 == 2, F.concat("c_name", bad)).when(key % 5 == 3, F.concat("c_name", F.lit(' 5" x'))).otherwise(quoted(F.col("c_name"), F.lit(",")))
    )
    lines = t.raw("customer").select(F.concat_ws(",", key.cast("string"), note, F.col("c_acctbal").cast("double").cast("string")).alias("value"))
    # The header stands at the head of every file: it travels with each file's first line.
    numbered = lines.repartition(3, "value").withColumn("at", F.monotonically_increasing_id())
    headed = F.when(F.pmod("at", F.lit(1 << 33)) == 0, F.concat(F.lit("key,note,balance\n"), F.col("value"))).otherwise(F.col("value"))
    numbered.select(headed.alias("value")).write.text(f"{folder}/notes.csv")
    return readers.load_table(t.spark, f"{folder}/notes.csv")


@query("S5_load_all_csvs", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def load_all_csvs(t):
    folder = scratch(t)
    for name in ("nation", "region"):
        sinks.write_csv(t.raw(name), f"{folder}/{name}.csv")
    tables, _ = readers.load_all_csvs(t.spark, folder)
    return tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query("S6_dataset_discovery", """
SELECT 'my_data_set_v2' AS dataset_id, 'My-Data Set (v2)' AS dataset, count(DISTINCT r_regionkey)::BIGINT AS regions FROM region
""")
def dataset_discovery(t):
    folder = scratch(t)
    t.raw("region").write.parquet(f"{folder}/My-Data Set (v2)/region")
    found = readers.discover_datasets(t.spark, folder)
    path = found.first()["path"]
    regions = t.spark.read.parquet(path).agg(F.countDistinct("r_regionkey").alias("regions"))
    return found.select("dataset_id", "dataset").distinct().crossJoin(F.broadcast(regions))  # one row each


@query("S7_capped_csv_load", "SELECT least(count(*), 1000)::BIGINT AS n_rows, 3::BIGINT AS n_columns FROM orders")
def capped_csv_load(t):
    folder = scratch(t)
    sinks.write_csv(t.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice"), f"{folder}/orders.csv")
    loaded = readers.load_table(t.spark, f"{folder}/orders.csv", rows=1000)
    return loaded.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(loaded.columns)).cast("bigint"))


@query("S8_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def pruned_scan(t):
    return t.raw("lineitem").filter(F.col("l_quantity") > 40).select("l_orderkey", "l_quantity")


@query("S11_S12_S16_tables_panel_and_stages", """
SELECT season::BIGINT AS season, count(*)::BIGINT AS n, count(DISTINCT player_id)::BIGINT AS players FROM grid GROUP BY 1
""")
def tables_panel_and_stages(t):
    folder = scratch(t)
    sinks.write_tables({"games": t.games, "appearances": t.appearances, "competitions": t.competitions}, folder)
    games, apps, comps = (t.spark.read.parquet(f"{folder}/{n}") for n in ("games", "appearances", "competitions"))
    stages = sinks.StageStore(t.spark, f"{folder}/stages")
    skeleton = stages.get("skeleton", lambda: grid.cohort_grid(cleaning.filter_target_leagues(games, apps, comps)[0], games, apps))
    sinks.write_panel(skeleton, f"{folder}/panel")
    panel_back = t.spark.read.parquet(f"{folder}/panel")
    return bigints(panel_back.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(KEY).alias("players")))


@query("S14_head_as_records", """
SELECT to_json({'player_id': player_id, 'date': date, 'value': value, 'row_order': row_order})::VARCHAR AS record
FROM market_values ORDER BY row_order LIMIT 100
""")
def head_as_records(t):
    return sinks.head_records(t.market_values.orderBy("row_order"), 100)


@query("D9_column_list", """
SELECT * FROM (VALUES (0::BIGINT, 'player_id', 'bigint'), (1, 'week_start', 'date'), (2, 'competition_id', 'string'), (3, 'season', 'int'))
v(position, name, type)
""")
def column_list(t):
    return bigints(sinks.column_types(cohort(t)))


@query("R2_standard_columns", "SELECT r_regionkey::BIGINT AS region_key, r_name AS name_en FROM region")
def standard_columns(t):
    odd = t.raw("region").select(F.col("r_regionkey").cast("bigint").alias(" Region-Key"), F.col("r_name").alias("Name/EN."))
    return readers.standardize_columns(odd)


@query("X7_bounded_export", "SELECT least(count(*), 20000)::BIGINT AS n FROM grid WHERE competition_id = 'GB1'")
def bounded_export(t):
    path = scratch(t)
    explore.export_rows(cohort(t), explore.PanelFilter(picks={"competition_id": ["GB1"]}), path, 20_000)
    return readers.read_text_columns(t.spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("D13_load_log", """
SELECT 'good' AS "table", 'loaded' AS status, count(*)::BIGINT AS n_rows, 3::BIGINT AS n_columns, 0::BIGINT AS skipped, '' AS note FROM customer
UNION ALL SELECT 'ragged', 'loaded', count(*) FILTER (n_nationkey % 3 < 2)::BIGINT, 2, count(*) FILTER (n_nationkey % 3 = 2)::BIGINT, '' FROM nation
UNION ALL SELECT 'quoted', 'loaded', count(*)::BIGINT, 2, 0, '' FROM supplier
UNION ALL SELECT 'empty', 'failed', 0, 0, 0, 'empty' UNION ALL SELECT 'broken', 'failed', 0, 0, 0, 'unreadable'
""")
def load_log(t):
    """A good table, one with long and short lines, one with quoted line breaks, an empty file and one that is no archive."""
    folder = scratch(t)

    def written(name: str, lines, header: str) -> None:
        headed = t.spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit(header).alias("value")).unionByName(lines)
        headed.repartitionByRange(1, "at").sortWithinPartitions("at").select("value").write.text(f"{folder}/{name}.csv")

    sinks.write_csv(t.raw("customer").select("c_custkey", "c_name", "c_mktsegment").repartition(3), f"{folder}/good.csv")
    key = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 3 == 0, key).when(F.col("n_nationkey") % 3 == 1, F.concat_ws(",", key, "n_name")).otherwise(F.concat_ws(",", key, "n_name", F.lit("more")))
    written("ragged", t.raw("nation").select(F.col("n_nationkey").cast("long").alias("at"), line.alias("value")), "key,name")
    quoted = F.concat(F.col("s_suppkey").cast("string"), F.lit(',"'), F.col("s_name"), F.lit('\n, again"'))
    written("quoted", t.raw("supplier").select(F.col("s_suppkey").cast("long").alias("at"), quoted.alias("value")), "key,name")
    t.raw("region").limit(0).select("r_name").write.text(f"{folder}/empty.csv")
    t.raw("region").select("r_name").coalesce(1).write.text(f"{folder}/_staged")
    hadoop, system = readers._path(t.spark, f"{folder}/_staged")
    part = next(s.getPath() for s in system.listStatus(hadoop) if s.getPath().getName().startswith("part-"))
    target = readers._path(t.spark, f"{folder}/broken.csv/part-0.csv.gz")[0]
    system.mkdirs(target.getParent())
    system.rename(part, target)
    return readers.load_log(t.spark, folder)


@query("D13_dataset_index", """
SELECT 'club_data' AS dataset_id, 'Club Data' AS dataset, 2::BIGINT AS tables, 'Injuries, Players' AS key_tables
""")
def dataset_index(t):
    folder = scratch(t)
    for name in ("injury_history", "players"):
        source = t.raw_injuries if name == "injury_history" else t.players
        sinks.write_csv(source, f"{folder}/Club Data/{name}.csv")
    found = readers.discover_datasets(t.spark, folder)
    # Spark writes folders named like files: their name, not the part files', is the table.
    named = found.withColumn("table", F.regexp_extract("path", r"/([^/]+)\.csv/[^/]+$", 1)).dropDuplicates(["dataset", "table"])
    return jobs.dataset_index(named)


# --- composite jobs -----------------------------------------------------------------------------------


@query("C1_S15_panel_job_manifest", """
SELECT 'panel_rows' AS metric, count(*)::DOUBLE AS value FROM grid UNION ALL
SELECT 'panel_players', count(DISTINCT player_id)::DOUBLE FROM grid UNION ALL
SELECT 'panel_positives', sum(target)::DOUBLE FROM grid JOIN labels_view USING (player_id, week_start) UNION ALL
SELECT 'panel_ineligible', sum(ineligible)::DOUBLE FROM grid JOIN labels_view USING (player_id, week_start) UNION ALL
SELECT 'games', count(*)::DOUBLE FROM games UNION ALL SELECT 'appearances', count(*)::DOUBLE FROM appearances UNION ALL
SELECT 'target_games', count(*)::DOUBLE FROM target_games UNION ALL
SELECT 'target_appearances', count(*)::DOUBLE FROM target_appearances
""")
def panel_job_manifest(t):
    folder = scratch(t)
    manifest = jobs.run_panel_job(kept_inputs(t), folder, sinks.StageStore(t.spark, f"{folder}/stages"))
    wanted = ["panel_rows", "panel_players", "panel_positives", "panel_ineligible", "games", "appearances", "target_games", "target_appearances"]
    return manifest.filter(F.col("metric").isin(wanted)).select("metric", "value")


@query("C2_verify_panel")
def verify_panel(t):
    return jobs.verify_panel(kept_panel(t, LOADS), t.appearances, t.competitions, t.injuries, t.profiles)


# Columns of the canonical tables by kind: n number, t text, d date (all of them, in order).
PROFILED = {
    "appearances": "player_id n game_id n player_club_id n player_current_club_id n date d competition_id t minutes_played n yellow_cards n red_cards n",
    "games": "game_id n competition_id t season n game_date d home_club_id n away_club_id n",
    "competitions": "competition_id t competition_code t name t sub_type t type t country_name t",
    "players": "player_id n name t current_club_name t position t",
    "raw_injuries": "player_id n injury_start d injury_end d days_out n injury_reason t",
    "profiles": "player_id n position t height n date_of_birth d",
    "transfers": "player_id n transfer_date d",
    "market_values": "player_id n date d value n row_order n",
}


def profile_sql() -> str:
    """One branch for each table, section and column, from the rules of the report."""
    out = []

    def add(table, section, column, metric, value, text="NULL", source=None):
        out.append(
            f"SELECT '{table}' AS \"table\", '{section}' AS section, '{column}' AS \"column\", {metric} AS metric, round(({value})::DOUBLE, 4) AS value, {text}::VARCHAR AS text"
            f" FROM {source or table}"
        )

    for table, listed in PROFILED.items():
        words = listed.split()
        columns = dict(zip(words[::2], words[1::2]))
        add(table, "basic", "*", "'n_rows'", "count(*)")
        add(table, "basic", "*", "'n_columns'", f"any_value({len(columns)})")
        add(table, "basic", "*", "'duplicate_rows'", f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))")
        for c, kind in columns.items():
            share = f"100 - count({c}) * 100.0 / count(*)"
            add(table, "missing", c, "'missing_pct'", share)
            add(table, "missing", c, "'high_missing'", f"({share} > 50)::INT")
            add(table, "missing", c, "'n_unique'", f"count(DISTINCT {c})")
            if kind == "t":
                add(table, "categorical", c, "'high_cardinality'", f"(count(DISTINCT {c}) / count(*) > 0.9)::INT")
                add(table, "frequent", c, "place::VARCHAR", "n", "v", f"(SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) WHERE place <= 10")
            if kind == "n":
                moments = {
                    "count": f"count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})",
                    **{f"p{q}": f"quantile_cont({c}::DOUBLE, {q / 100})" for q in (25, 50, 75)},
                }
                for metric, value in moments.items():
                    add(table, "numeric", c, f"'{metric}'", value)
                add(table, "largest", c, "(row_number() OVER (ORDER BY v DESC))::VARCHAR", "v", "NULL", f"(SELECT {c} AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY 1 DESC LIMIT 5)")
            if kind == "d":
                add(table, "dates", c, "'success_pct'", f"100 - (count(*) - count({c})) * 100.0 / count(*)")
                add(table, "dates", c, "'first_day'", f"min({c}) - DATE '1970-01-01'")
                add(table, "dates", c, "'last_day'", f"max({c}) - DATE '1970-01-01'")
                add(table, "dates", c, "'invalid'", f"count(*) - count({c})")
            if "_id" in c:
                add(table, "ids", c, "'null_pct'", share)
                add(table, "ids", c, "'uniqueness'", f"count(DISTINCT {c}) / count(*)")
                add(table, "ids", c, "'likely_key'", f"(count(DISTINCT {c}) = count(*))::INT")
    days = "injury_end - injury_start"
    for metric, test in (("negative_days", "< 0"), ("zero_days", "= 0"), ("time_loss_7plus", ">= 7")):
        add("raw_injuries", "checks", "injuries", f"'{metric}'", f"count(*) FILTER ({days} {test})")
    add("raw_injuries", "checks", "injuries", "'median_days'", f"quantile_cont(({days})::DOUBLE, 0.5)")
    minutes = {"zero_minutes_pct": "100.0 * count(*) FILTER (minutes_played = 0) / count(*)", "min": "min(minutes_played)", "max": "max(minutes_played)", "median": "quantile_cont(minutes_played::DOUBLE, 0.5)"}
    for metric, value in minutes.items():
        add("appearances", "checks", "minutes", f"'{metric}'", value)
    add("profiles", "checks", "height", "'outliers'", "count(*) FILTER (height < 140 OR height > 220)")
    for other, key in (("games", "game_id"), ("players", "player_id")):
        add("appearances", "integrity", key, f"'in_{other}_pct'", f"100.0 * count(*) FILTER ({key} IN (SELECT {key} FROM {other})) / count(*)")
    return " UNION ALL ".join(out)


@query("C6_raw_profile", profile_sql())
def raw_profile(t):
    tables = {name: getattr(t, name) for name in PROFILED}
    return rounded(fused.profile_tables(tables), "value", digits=4)


@query("C7_panel_slices", f"""
SELECT 'season' AS slice, season::VARCHAR AS value, weeks, rate_pct FROM ({BY_SEASON})
UNION ALL SELECT 'position', pos_group, weeks, rate_pct FROM ({BY_POSITION})
UNION ALL SELECT 'load', range, weeks, rate_pct FROM ({BY_LOAD})
""")
def panel_slices(t):
    return rounded(bigints(jobs.panel_slices(kept_panel(t, LOADS))), "rate_pct")


def coverage_sql(others: dict[str, str]) -> str:
    players = "(SELECT DISTINCT player_id FROM players WHERE player_id IS NOT NULL)"
    return " UNION ALL ".join(
        f"""SELECT 'players_vs_{name}' AS "join", 'player_id' AS key, (SELECT count(*) FROM players)::BIGINT AS left_rows,
        (SELECT count(*) FROM {table})::BIGINT AS right_rows, (SELECT count(*) FROM {players})::BIGINT AS left_unique,
        (SELECT count(DISTINCT player_id) FROM {table})::BIGINT AS right_unique,
        count(*) FILTER (l IS NOT NULL AND r IS NOT NULL)::BIGINT AS both_left, count(*) FILTER (l IS NOT NULL AND r IS NULL)::BIGINT AS left_only,
        round(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) / greatest(1, count(l)), 6) AS coverage_left,
        count(*) FILTER (l IS NOT NULL AND r IS NOT NULL)::BIGINT AS both_right, count(*) FILTER (l IS NULL AND r IS NOT NULL)::BIGINT AS right_only,
        round(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) / greatest(1, count(r)), 6) AS coverage_right
        FROM (SELECT player_id AS l FROM {players}) FULL JOIN (SELECT DISTINCT player_id AS r FROM {table} WHERE player_id IS NOT NULL) ON l = r"""
        for name, table in others.items()
    )


AUDITED = {"injuries": "injuries", "profiles": "profiles", "transfers": "transfers", "market_values": "market_values"}


@query("C8_join_audit", coverage_sql(AUDITED))
def join_audit(t):
    others = {name: getattr(t, name) for name in AUDITED}
    return rounded(jobs.join_audit(t.players, others).coverage, "coverage_left", "coverage_right")


@query("C8_join_samples", """
SELECT * FROM (
  SELECT 'players_vs_' || o AS "join", kind, k AS player_id FROM (
    SELECT o, kind, k, row_number() OVER (PARTITION BY o, kind ORDER BY ('0x' || substr(md5('42|' || k), 1, 13))::BIGINT, k) AS place FROM (
      SELECT o, CASE WHEN p AND q THEN 'both' WHEN p THEN 'left_only' ELSE 'right_only' END AS kind, k FROM (
        SELECT o, k, bool_or(side = 'l') AS p, bool_or(side = 'r') AS q FROM (
          SELECT 'injuries' AS o, 'r' AS side, player_id AS k FROM injuries UNION ALL SELECT 'profiles', 'r', player_id FROM profiles
          UNION ALL SELECT 'transfers', 'r', player_id FROM transfers UNION ALL SELECT 'market_values', 'r', player_id FROM market_values
          UNION ALL SELECT o, 'l', player_id FROM players, (SELECT unnest(['injuries', 'profiles', 'transfers', 'market_values']) AS o))
        WHERE k IS NOT NULL GROUP BY o, k)))
  WHERE place <= 25)
""")
def join_samples(t):
    others = {name: getattr(t, name) for name in AUDITED}
    return jobs.join_audit(t.players, others, sample=25).samples


@query("C9_panel_inspection", "SELECT feature, missing_pct, n_unique FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round((count(*) - count({c})) / count(*), 6)::DOUBLE AS missing_pct, count(DISTINCT {c})::BIGINT AS n_unique FROM panel" for c in PANEL_COLUMNS
) + ")")
def panel_inspection(t):
    """Every column of the whole panel."""
    table = jobs.inspect_panel(kept_panel(t)).select("feature", "missing_pct", "n_unique")
    return rounded(bigints(table), "missing_pct")


@query("C10_legacy_pipeline")
def legacy_pipeline(t):
    spelled = t.raw_injuries.withColumnsRenamed({"injury_start": "start", "injury_end": "end", "days_out": "duration"})
    named = spelled.join(t.players.select(KEY, F.col("name").alias("player_name")), KEY).drop(KEY)
    return jobs.legacy_metrics(t.appearances, t.games, named, t.players)


# The listed leagues' grid and what hangs on it, as the steps build it.
STEPWISE = """
SELECT * FROM (
  WITH g AS (SELECT * FROM games WHERE competition_id IN ('GB1', 'ES1', 'L1', 'IT1', 'FR1')),
  a AS (SELECT * FROM appearances WHERE game_id IN (SELECT game_id FROM g)),
  b AS (SELECT competition_id, season, min(date_trunc('week', game_date)::DATE) AS lo, max(date_trunc('week', game_date)::DATE) AS hi FROM g GROUP BY 1, 2),
  w AS (
    SELECT player_id, week_start, competition_id, season FROM (
      SELECT *, row_number() OVER (PARTITION BY player_id, week_start ORDER BY season, competition_id) AS rn FROM (
        SELECT player_id, b.competition_id, b.season, unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS week_start
        FROM (SELECT DISTINCT player_id, g.competition_id, g.season FROM a JOIN g ON a.game_id = g.game_id) s
        JOIN b ON b.competition_id = s.competition_id AND b.season = s.season))
    WHERE rn = 1),
  d AS (SELECT player_id, game_date AS day, sum(coalesce(minutes_played, 0)) AS minutes, count(*) AS matches FROM a JOIN g ON a.game_id = g.game_id GROUP BY 1, 2),
  f AS (
    SELECT w.player_id, w.week_start,
      coalesce(sum(CASE WHEN day >= week_start - 7 THEN minutes END), 0) AS minutes_last_1w,
      coalesce(sum(CASE WHEN day >= week_start - 28 THEN minutes END), 0) AS minutes_last_4w,
      coalesce(sum(minutes), 0) AS minutes_last_8w,
      coalesce(sum(CASE WHEN day >= week_start - 7 THEN matches END), 0) AS matches_last_7d,
      coalesce(max(CASE WHEN day >= week_start - 14 THEN minutes END), 0) AS max_minutes_14d
    FROM w LEFT JOIN d ON d.player_id = w.player_id AND day >= week_start - 56 AND day < week_start GROUP BY 1, 2),
  p AS (
    SELECT w.player_id, w.week_start, coalesce(least(week_start - max(day), 9999), 9999) AS days_since_last_played
    FROM w LEFT JOIN d ON d.player_id = w.player_id AND day < week_start AND minutes > 0 GROUP BY 1, 2),
  l AS (
    SELECT w.player_id, w.week_start,
      max(CASE WHEN injury_start > week_start AND injury_start <= week_start + 30 THEN 1 ELSE 0 END) AS target,
      max(CASE WHEN injury_start <= week_start AND injury_end >= week_start THEN 1 ELSE 0 END) AS ineligible
    FROM w LEFT JOIN serious_injuries i ON i.player_id = w.player_id GROUP BY 1, 2),
  v AS (SELECT player_id, g.season, min(date) - 14 AS lo, max(date) + 14 AS hi FROM a JOIN g ON a.game_id = g.game_id GROUP BY 1, 2)
  SELECT w.player_id, w.week_start, w.competition_id, w.season::BIGINT AS season, minutes_last_1w::DOUBLE AS minutes_last_1w,
    minutes_last_4w::DOUBLE AS minutes_last_4w, minutes_last_8w::DOUBLE AS minutes_last_8w,
    round(minutes_last_1w / (minutes_last_4w / 4 + 1), 6) AS acwr, days_since_last_played::BIGINT AS days_since_last_played,
    matches_last_7d::DOUBLE AS matches_last_7d, max_minutes_14d::DOUBLE AS max_minutes_14d, target::BIGINT AS target, ineligible::BIGINT AS ineligible,
    CASE WHEN w.player_id IN (SELECT player_id FROM injuries) THEN 1 ELSE 0 END::BIGINT AS label_known,
    CASE WHEN w.week_start + 30 <= (SELECT max(injury_start) FROM injuries) THEN 1 ELSE 0 END::BIGINT AS not_censored,
    CASE WHEN w.week_start BETWEEN v.lo AND v.hi THEN 1 ELSE 0 END::BIGINT AS active_player
  FROM w JOIN f USING (player_id, week_start) JOIN p USING (player_id, week_start) JOIN l USING (player_id, week_start)
  LEFT JOIN v ON v.player_id = w.player_id AND v.season = w.season)
"""


def step_sources(t) -> steps.Sources:
    """The tables as the files that the steps begin with."""
    folder = scratch(t)
    backbone = {"appearances": t.appearances, "games": t.games.withColumnRenamed("game_date", "date"), "players": t.players, "competitions": t.competitions}
    for name, df in backbone.items():
        sinks.write_csv(df, f"{folder}/backbone/{name}.csv")
    spelled = {
        "injuries": t.raw_injuries.withColumnsRenamed({"injury_start": "from_date", "injury_end": "end_date", "days_out": "days_missed"}),
        "transfers": t.transfers.withColumn("from_team_id", F.lit(0)), "market_values": t.market_values.withColumnRenamed("value", "market_value_in_eur"),
    }
    for name, df in spelled.items():
        sinks.write_csv(df, f"{folder}/other/{name}")
    return steps.Sources(t.spark, f"{folder}/backbone", f"{folder}/other")


@query("C11_stepwise_panel", STEPWISE)
def stepwise_panel(t):
    """All eighteen steps from files; the panel of the last one."""
    runner = steps.Runner(step_sources(t), sinks.StageStore(t.spark, f"{scratch(t)}/steps"))
    out = runner.run_all()["panel"]
    wanted = [
        KEY, WEEK, "competition_id", "season", "minutes_last_1w", "minutes_last_4w", "minutes_last_8w", "acwr", "days_since_last_played", "matches_last_7d",
        "max_minutes_14d", "target", "ineligible", "label_known", "not_censored", "active_player",
    ]
    return rounded(bigints(out.select(*wanted)), "acwr")
