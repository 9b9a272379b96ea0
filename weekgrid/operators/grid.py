"""Calendars, cohorts and weekly skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import measure, monday


def appearance_facts(appearances: DataFrame, games: DataFrame) -> DataFrame:
    """Appearances with the date, season and sides of their game: the one join every family shares."""
    wanted = ("player_club_id", "player_current_club_id", "yellow_cards", "red_cards")
    optional = [c for c in wanted if c in appearances.columns]
    sides = [c for c in ("home_club_id", "away_club_id") if c in games.columns]
    return appearances.select("player_id", "game_id", "date", "minutes_played", *optional).join(
        games.select("game_id", "game_date", "season", *sides), "game_id", "left"
    )


def calendar_bounds(games: DataFrame) -> DataFrame:
    """First and last Monday per (competition, season): one row each."""
    return (
        games.filter(
            F.col("competition_id").isNotNull() & F.col("season").isNotNull() & F.col("game_date").isNotNull()
        )
        .groupBy("competition_id", "season")
        .agg(F.min(monday("game_date")).alias("min_week"), F.max(monday("game_date")).alias("max_week"))
    )


def explode_weeks(df: DataFrame) -> DataFrame:
    """Every Monday from min_week to max_week. A map-side expansion: no shuffle, rows bounded per input row."""
    weeks = F.sequence("min_week", "max_week", F.expr("interval 7 days"))
    return df.withColumn("week_start", F.explode(weeks)).drop("min_week", "max_week")


def league_calendar(games: DataFrame) -> DataFrame:
    return explode_weeks(calendar_bounds(games))


def club_leagues(games: DataFrame) -> DataFrame:
    """(season, club) -> competition. A club seen in several takes the one with most games, then the least id."""
    home_away = F.explode(F.array(F.col("home_club_id"), F.col("away_club_id")))
    counted = (
        games.select("season", "competition_id", home_away.alias("club_id"))
        .filter(F.col("season").isNotNull() & F.col("competition_id").isNotNull() & F.col("club_id").isNotNull())
        .groupBy("season", "club_id", "competition_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.groupBy("season", "club_id").agg(
        F.min(F.struct(-F.col("_n"), F.col("competition_id"))).getField("competition_id").alias("league_competition_id")
    )


def attributed_minutes(leagues: DataFrame, facts: DataFrame) -> DataFrame:
    """Minutes per (player, season, league): league of the match club, else of the current club.

    Minutes are summed per (player, season, club pair) before the two lookups, so those joins see one row
    per affiliation instead of one per appearance.
    """
    known = _affiliations(leagues, facts).filter(F.col("league_competition_id").isNotNull())
    return known.select("player_id", "season", "league_competition_id", "minutes")


def _affiliations(leagues: DataFrame, facts: DataFrame) -> DataFrame:
    """(player, season, league or null) with minutes and the first and last appearance."""
    affiliated = (
        facts.filter(F.col("player_id").isNotNull() & F.col("season").isNotNull())
        .groupBy("player_id", "season", "player_club_id", "player_current_club_id")
        .agg(
            F.sum(measure("minutes_played")).alias("minutes"), F.min("date").alias("first_app"), F.max("date").alias("last_app")
        )
    )
    match = leagues.select("season", F.col("club_id").alias("player_club_id"), F.col("league_competition_id").alias("_m"))
    current = leagues.select(
        "season", F.col("club_id").alias("player_current_club_id"), F.col("league_competition_id").alias("_c")
    )
    return (
        affiliated.join(match, ["season", "player_club_id"], "left")
        .join(current, ["season", "player_current_club_id"], "left")
        .withColumn("league_competition_id", F.coalesce("_m", "_c"))
        .groupBy("player_id", "season", "league_competition_id")
        .agg(F.sum("minutes").alias("minutes"), F.min("first_app").alias("first_app"), F.max("last_app").alias("last_app"))
    )


def primary_league(minutes: DataFrame) -> DataFrame:
    """(player, season) -> league with most minutes; equal minutes go to the least id."""
    return minutes.groupBy("player_id", "season").agg(
        F.min(F.struct(-F.col("minutes"), F.col("league_competition_id")))
        .getField("league_competition_id")
        .alias("competition_id")
    )


def cohort_seasons(target_games: DataFrame, facts: DataFrame) -> DataFrame:
    """Players of target-league clubs: one row per (player, season) with league, calendar bounds and the
    season's first and last appearance in any competition, all from one pass over the facts.

    The join carries only the calendar's bounds (one row per league season), so the wide weekly rows are
    never shuffled by the few (league, season) values.
    """
    league = F.col("league_competition_id")
    # Unattributed minutes take part in the dates, not in the choice.
    choice = F.min(F.when(league.isNotNull(), F.struct(-F.col("minutes"), league)))
    primary = (
        _affiliations(club_leagues(target_games), facts)
        .groupBy("player_id", "season")
        .agg(
            choice.getField("league_competition_id").alias("competition_id"),
            F.min("first_app").alias("first_app"), F.max("last_app").alias("last_app"),
        )
        .filter(F.col("competition_id").isNotNull())
    )
    return primary.join(calendar_bounds(target_games), ["season", "competition_id"])


def cohort_grid(target_games: DataFrame, games: DataFrame, appearances: DataFrame) -> DataFrame:
    """player_id, week_start, competition_id, season for players of target-league clubs."""
    weeks = explode_weeks(cohort_seasons(target_games, appearance_facts(appearances, games)))
    return weeks.select("player_id", "week_start", "competition_id", "season")


def appearance_grid(games: DataFrame, appearances: DataFrame) -> DataFrame:
    """Every Monday of each (competition, season) a player appeared in; one row per (player, week).

    When competitions overlap in a week the earliest season, then the least competition id, is kept.
    """
    # Each (season, competition) gets its place in that order: one row per league season, so ranking them is
    # small, and the weekly rows then carry and compare one integer.
    places = Window.orderBy("season", "competition_id")
    calendar = calendar_bounds(games).withColumn("_place", F.row_number().over(places))
    scope = (
        appearances.select("player_id", "game_id")
        .join(games.select("game_id", "competition_id", "season"), "game_id")
        .filter(F.col("player_id").isNotNull())
        .select("player_id", "competition_id", "season")
        .distinct()
    )
    placed = scope.join(calendar, ["competition_id", "season"]).select("player_id", "_place", "min_week", "max_week")
    picked = explode_weeks(placed).groupBy("player_id", "week_start").agg(F.min("_place").alias("_place"))
    return picked.join(calendar.select("_place", "competition_id", "season"), "_place").select(
        "player_id", "week_start", "competition_id", "season"
    )


def players_per_season(games: DataFrame, appearances: DataFrame) -> DataFrame:
    pairs = appearances.select("player_id", "game_id").join(games.select("game_id", "season"), "game_id")
    return pairs.groupBy("season").agg(F.countDistinct("player_id").alias("players"))


def sparse_grid(games: DataFrame, appearances: DataFrame) -> DataFrame:
    """(player, week) rows that have appearances, with minutes and match counts."""
    dated = appearances.select("player_id", "game_id", "minutes_played").join(
        games.select("game_id", F.col("game_date").alias("_date")), "game_id", "left"
    )
    return (
        dated.withColumn("week_start", monday("_date"))
        .filter(F.col("player_id").isNotNull() & F.col("week_start").isNotNull())
        .groupBy("player_id", "week_start")
        .agg(
            F.sum(measure("minutes_played")).alias("minutes_week"),
            F.count("game_id").alias("matches_week"),
        )
    )


def densify_daily(events: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """One row per day between an entity's first and last event, missing days as 0."""
    totals = events.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key, date).agg(
        F.sum(measure(value)).alias(value)
    )
    spans = totals.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = spans.select(key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    return days.join(totals, [key, date], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


