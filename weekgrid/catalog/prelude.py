"""SQL views the oracle statements share: the stand-in inputs and the panel, written independently.

Order matters: a view may only use views above it.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["lo"] = """
SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

_COMPETITION = """
CASE o_orderpriority WHEN '1-URGENT' THEN 'GB1' WHEN '2-HIGH' THEN 'ES1' WHEN '3-MEDIUM' THEN 'SERA'
  WHEN '4-NOT SPECIFIED' THEN 'DFBP' WHEN '5-LOW' THEN 'BUND' END
"""

VIEWS["appearances"] = f"""
SELECT o_custkey AS player_id, o_orderkey AS game_id,
  CASE WHEN l_linenumber % 5 <> 0 THEN l_suppkey END AS player_club_id,
  o_custkey % 50 AS player_current_club_id,
  CAST(o_orderdate AS DATE) AS date,
  {_COMPETITION} AS competition_id,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 0
       WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN NULL ELSE l_quantity END AS minutes_played,
  CAST(l_returnflag = 'A' AS INTEGER) AS yellow_cards,
  CAST(l_returnflag = 'R' AS INTEGER) AS red_cards
FROM lo
"""

VIEWS["games"] = f"""
SELECT o_orderkey AS game_id, {_COMPETITION} AS competition_id,
  CAST(year(o_orderdate) AS INTEGER) AS season, CAST(o_orderdate AS DATE) AS game_date,
  home_club_id, away_club_id
FROM orders LEFT JOIN (
  SELECT l_orderkey, min(l_suppkey) AS home_club_id, max(l_suppkey) AS away_club_id FROM lineitem GROUP BY 1
) c ON o_orderkey = l_orderkey
"""

VIEWS["competitions"] = f"""
SELECT competition_id,
  CASE competition_id WHEN 'GB1' THEN 'premier-league' WHEN 'ES1' THEN 'laliga' WHEN 'SERA' THEN 'IT1'
    WHEN 'DFBP' THEN 'dfb-pokal' ELSE 'bundesliga' END AS competition_code,
  CASE competition_id WHEN 'GB1' THEN 'Premier League' WHEN 'ES1' THEN 'LaLiga' WHEN 'SERA' THEN 'Serie A'
    WHEN 'DFBP' THEN 'DFB-Pokal' ELSE 'Bundesliga' END AS name,
  CASE competition_id WHEN 'DFBP' THEN 'domestic_cup' ELSE 'first_tier' END AS sub_type,
  CASE competition_id WHEN 'DFBP' THEN 'domestic_cup' ELSE 'domestic_league' END AS type,
  CASE competition_id WHEN 'GB1' THEN 'England' WHEN 'ES1' THEN 'Spain' WHEN 'SERA' THEN 'Italy'
    ELSE 'Germany' END AS country_name
FROM (SELECT DISTINCT {_COMPETITION} AS competition_id FROM orders)
"""

VIEWS["raw_injuries"] = """
SELECT o_custkey AS player_id,
  CASE WHEN l_linenumber = 6 AND l_tax = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS injury_start,
  CASE WHEN l_linenumber % 3 = 2 OR (l_linenumber = 4 AND l_tax < 0.02) THEN NULL
       WHEN l_discount = 0 THEN CAST(l_shipdate AS DATE) - 3
       ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS injury_end,
  CASE WHEN l_linenumber % 3 <> 1 THEN l_quantity END AS days_out,
  l_linestatus AS injury_reason
FROM lo WHERE l_returnflag = 'R'
"""

VIEWS["injuries"] = """
SELECT player_id, injury_start, injury_end, days_out, injury_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id, injury_start
      ORDER BY days_out DESC NULLS LAST, injury_end DESC NULLS LAST, injury_reason DESC) AS rn
  FROM (
    SELECT player_id, injury_start, injury_reason,
      coalesce(injury_end, injury_start + CAST(days_out AS INTEGER)) AS injury_end,
      coalesce(days_out, injury_end - injury_start) AS days_out
    FROM raw_injuries WHERE injury_start IS NOT NULL
  ) WHERE injury_end IS NULL OR injury_end >= injury_start
) WHERE rn = 1
"""

VIEWS["serious_injuries"] = "SELECT * FROM injuries WHERE days_out >= 7"

VIEWS["transfers"] = """
SELECT o_custkey AS player_id,
  CASE WHEN o_orderkey % 97 = 0 THEN DATE '1900-07-01' WHEN o_orderkey % 89 = 0 THEN NULL
       ELSE CAST(o_orderdate AS DATE) END AS transfer_date
FROM orders WHERE o_orderstatus = 'F'
"""

VIEWS["market_values"] = """
SELECT o_custkey AS player_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderkey AS row_order
FROM orders
"""

VIEWS["profiles"] = """
SELECT c_custkey AS player_id,
  CASE WHEN c_custkey % 13 <> 0 THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Goalkeeper'
    WHEN 'BUILDING' THEN 'Centre-Back' WHEN 'FURNITURE' THEN 'Central Midfield'
    WHEN 'HOUSEHOLD' THEN 'Left Winger' WHEN 'MACHINERY' THEN 'Sweeper' END END AS position,
  CAST(130 + c_custkey % 90 AS DOUBLE) AS height,
  CASE WHEN c_custkey % 17 <> 0 THEN DATE '1970-01-01' + CAST(c_custkey * 37 % 9000 AS INTEGER) END AS date_of_birth
FROM customer WHERE c_custkey % 11 <> 0
"""

VIEWS["players"] = """
SELECT c_custkey AS player_id, c_name AS name, 'Club ' || c_nationkey AS current_club_name, c_mktsegment AS position
FROM customer
"""

VIEWS["target_competitions"] = """
SELECT DISTINCT competition_id FROM competitions, (
  SELECT count(DISTINCT CASE WHEN upper(competition_id) IN ('GB1','ES1','L1','IT1','FR1') THEN competition_id END)
       + count(DISTINCT CASE WHEN upper(competition_code) IN ('GB1','ES1','L1','IT1','FR1') THEN competition_id END) AS n
  FROM competitions)
WHERE upper(competition_id) IN ('GB1','ES1','L1','IT1','FR1')
   OR upper(competition_code) IN ('GB1','ES1','L1','IT1','FR1')
   OR (n < 5 AND lower(country_name) IN ('england','spain','germany','italy','france')
       AND regexp_matches(lower(sub_type), 'first_tier|domestic_league'))
"""

VIEWS["target_games"] = "SELECT * FROM games WHERE competition_id IN (SELECT competition_id FROM target_competitions)"

VIEWS["target_appearances"] = "SELECT * FROM appearances WHERE game_id IN (SELECT game_id FROM target_games)"

VIEWS["calendar_bounds"] = """
SELECT competition_id, season, min(date_trunc('week', game_date)::DATE) AS min_week,
  max(date_trunc('week', game_date)::DATE) AS max_week
FROM target_games GROUP BY 1, 2
"""

VIEWS["league_calendar"] = """
SELECT competition_id, season, unnest(generate_series(min_week, max_week, INTERVAL 7 DAY))::DATE AS week_start
FROM calendar_bounds
"""

VIEWS["club_leagues"] = """
SELECT season, club_id, competition_id AS league_competition_id FROM (
  SELECT season, club_id, competition_id,
    row_number() OVER (PARTITION BY season, club_id ORDER BY count(*) DESC, competition_id) AS rn
  FROM (SELECT season, competition_id, home_club_id AS club_id FROM target_games
        UNION ALL SELECT season, competition_id, away_club_id FROM target_games)
  WHERE club_id IS NOT NULL GROUP BY season, club_id, competition_id)
WHERE rn = 1
"""

VIEWS["attributed"] = """
SELECT a.player_id, g.season, coalesce(m.league_competition_id, c.league_competition_id) AS league_competition_id,
  coalesce(a.minutes_played, 0) AS minutes
FROM appearances a JOIN games g ON a.game_id = g.game_id
LEFT JOIN club_leagues m ON m.season = g.season AND m.club_id = a.player_club_id
LEFT JOIN club_leagues c ON c.season = g.season AND c.club_id = a.player_current_club_id
WHERE coalesce(m.league_competition_id, c.league_competition_id) IS NOT NULL
"""

VIEWS["primary_league"] = """
SELECT player_id, season, league_competition_id AS competition_id FROM (
  SELECT player_id, season, league_competition_id,
    row_number() OVER (PARTITION BY player_id, season ORDER BY sum(minutes) DESC, league_competition_id) AS rn
  FROM attributed GROUP BY 1, 2, 3)
WHERE rn = 1
"""

VIEWS["grid"] = """
SELECT p.player_id, w.week_start, p.competition_id, p.season
FROM primary_league p JOIN league_calendar w ON p.season = w.season AND p.competition_id = w.competition_id
"""

VIEWS["probes"] = "SELECT DISTINCT player_id, week_start FROM grid"

VIEWS["daily_load"] = """
SELECT a.player_id, game_date AS day, sum(coalesce(minutes_played, 0)) AS minutes, count(*) AS matches,
  sum(CASE WHEN player_club_id = away_club_id THEN 1 ELSE 0 END) AS away,
  sum(CASE WHEN player_club_id = away_club_id THEN coalesce(minutes_played, 0) ELSE 0 END) AS away_minutes,
  sum(yellow_cards) AS yellow, sum(red_cards) AS red
FROM appearances a JOIN games g ON a.game_id = g.game_id GROUP BY 1, 2
"""

VIEWS["workload"] = """
SELECT p.player_id, p.week_start,
  coalesce(sum(CASE WHEN day >= week_start - 7 THEN minutes END), 0) AS minutes_last_1w,
  coalesce(sum(CASE WHEN day >= week_start - 14 THEN minutes END), 0) AS minutes_last_2w,
  coalesce(sum(CASE WHEN day >= week_start - 28 THEN minutes END), 0) AS minutes_last_4w,
  coalesce(sum(minutes), 0) AS minutes_last_8w,
  coalesce(sum(CASE WHEN day >= week_start - 3 THEN matches END), 0) AS matches_last_3d,
  coalesce(sum(CASE WHEN day >= week_start - 7 THEN matches END), 0) AS matches_last_7d,
  coalesce(sum(CASE WHEN day >= week_start - 14 THEN matches END), 0) AS matches_last_14d,
  coalesce(sum(CASE WHEN day >= week_start - 28 THEN matches END), 0) AS matches_last_28d,
  coalesce(sum(CASE WHEN day >= week_start - 10 THEN minutes END), 0) AS minutes_last_10d,
  coalesce(max(CASE WHEN day >= week_start - 14 THEN minutes END), 0) AS max_minutes_14d,
  coalesce(sum(CASE WHEN day >= week_start - 28 THEN away END), 0) AS away_matches_last_28d,
  coalesce(sum(CASE WHEN day >= week_start - 28 THEN away_minutes END), 0) AS away_minutes_last_28d,
  coalesce(sum(CASE WHEN day >= week_start - 28 THEN yellow END), 0) AS yellow_cards_last_28d,
  coalesce(sum(red), 0) AS red_cards_last_56d
FROM probes p LEFT JOIN daily_load d
  ON d.player_id = p.player_id AND day >= week_start - 56 AND day < week_start
GROUP BY 1, 2
"""

VIEWS["last_played"] = """
SELECT p.player_id, p.week_start, coalesce(least(week_start - max(day), 9999), 9999) AS days_since_last_played
FROM probes p LEFT JOIN daily_load d ON d.player_id = p.player_id AND day < week_start AND minutes > 0
GROUP BY 1, 2
"""

VIEWS["transfer_context"] = """
SELECT p.player_id, p.week_start, coalesce(week_start - max(transfer_date), 3650) AS days_since_transfer
FROM probes p LEFT JOIN transfers t ON t.player_id = p.player_id AND transfer_date <= week_start
  AND transfer_date >= DATE '1950-01-01'
GROUP BY 1, 2
"""

VIEWS["daily_value"] = """
SELECT player_id, date, arg_max(value, row_order) AS value FROM market_values GROUP BY 1, 2
"""

VIEWS["value_context"] = """
SELECT player_id, week_start, coalesce(n.value, 0) AS market_value, coalesce(o.value, 0) AS market_value_6m
FROM (
  SELECT p.player_id, p.week_start, n.value FROM probes p ASOF LEFT JOIN daily_value n
    ON p.player_id = n.player_id AND p.week_start >= n.date) n
JOIN (
  SELECT p.player_id, p.week_start, o.value
  FROM (SELECT player_id, week_start, week_start - 180 AS lagged FROM probes) p ASOF LEFT JOIN daily_value o
    ON p.player_id = o.player_id AND p.lagged >= o.date) o
USING (player_id, week_start)
"""

VIEWS["labels_view"] = """
SELECT p.player_id, p.week_start,
  max(CASE WHEN injury_start > week_start AND injury_start <= week_start + 30 THEN 1 ELSE 0 END) AS target,
  max(CASE WHEN injury_start <= week_start AND injury_end >= week_start THEN 1 ELSE 0 END) AS ineligible
FROM probes p LEFT JOIN serious_injuries i ON i.player_id = p.player_id
GROUP BY 1, 2
"""

VIEWS["history"] = """
SELECT p.player_id, p.week_start,
  count(CASE WHEN injury_start >= week_start - 30 AND injury_start < week_start THEN 1 END) AS injuries_last_30d,
  count(CASE WHEN injury_start >= week_start - 180 AND injury_start < week_start THEN 1 END) AS injuries_last_180d,
  count(CASE WHEN injury_start >= week_start - 365 AND injury_start < week_start THEN 1 END) AS injuries_last_365d,
  coalesce(sum(CASE WHEN injury_start >= week_start - 30 AND injury_start < week_start THEN days_out END), 0) AS days_out_last_30d,
  coalesce(sum(CASE WHEN injury_start >= week_start - 180 AND injury_start < week_start THEN days_out END), 0) AS days_out_last_180d,
  coalesce(sum(CASE WHEN injury_start >= week_start - 365 AND injury_start < week_start THEN days_out END), 0) AS days_out_last_365d,
  coalesce(week_start - max(CASE WHEN injury_start < week_start THEN injury_start END), 9999) AS days_since_last_injury_start,
  coalesce(week_start - max(CASE WHEN injury_end < week_start THEN injury_end END), 9999) AS days_since_last_injury_end,
  coalesce(arg_max(days_out, injury_start) FILTER (injury_start < week_start), 0) AS last_injury_days_out
FROM probes p LEFT JOIN serious_injuries i ON i.player_id = p.player_id
GROUP BY 1, 2
"""

VIEWS["universe"] = "SELECT player_id FROM injuries UNION SELECT player_id FROM profiles"

VIEWS["activity"] = """
SELECT a.player_id, g.season, min(a.date) - 14 AS window_start, max(a.date) + 14 AS window_end
FROM appearances a JOIN games g ON a.game_id = g.game_id GROUP BY 1, 2
"""

VIEWS["flags"] = """
SELECT g.player_id, g.week_start, g.season,
  CASE WHEN g.week_start + 30 <= (SELECT max(injury_start) FROM injuries) THEN 1 ELSE 0 END AS not_censored,
  CASE WHEN g.week_start BETWEEN window_start AND window_end THEN 1 ELSE 0 END AS active_player,
  CASE WHEN g.player_id IN (SELECT player_id FROM universe) THEN 1 ELSE 0 END AS label_known
FROM grid g LEFT JOIN activity v ON v.player_id = g.player_id AND v.season = g.season
"""

VIEWS["panel"] = """
SELECT g.player_id, g.week_start, g.competition_id, g.season,
  w.* EXCLUDE (player_id, week_start),
  minutes_last_1w / (minutes_last_4w / 4 + 1) AS acwr,
  away_matches_last_28d / (matches_last_28d + 0.000001) AS away_match_share_28d,
  days_since_last_played, days_since_transfer, market_value, market_value_6m,
  ln(1 + market_value) AS log_market_value,
  (market_value - market_value_6m) / (market_value_6m + 10000) AS market_value_trend,
  target, ineligible, h.* EXCLUDE (player_id, week_start),
  f.not_censored, f.active_player, f.label_known,
  CASE WHEN height BETWEEN 140 AND 210 THEN height END AS height, position, date_of_birth,
  (g.week_start - date_of_birth) / 365.25 AS age
FROM grid g
JOIN workload w USING (player_id, week_start)
JOIN last_played l USING (player_id, week_start)
JOIN transfer_context t USING (player_id, week_start)
JOIN value_context v USING (player_id, week_start)
JOIN labels_view b USING (player_id, week_start)
JOIN history h USING (player_id, week_start)
JOIN flags f USING (player_id, week_start, season)
LEFT JOIN profiles pr ON pr.player_id = g.player_id
"""

VIEWS["strict_panel"] = """
SELECT * FROM panel WHERE ineligible = 0 AND not_censored = 1 AND active_player = 1 AND label_known = 1
"""
