"""Canonical panel inputs derived from an order-entry star schema.

Customers act as players, orders as games, order lines as appearances, returned lines as injuries. Every
table is a lazy transformation of the given Parquet tables. The matching SQL is in ``catalog/prelude.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_intervals

# Order priority -> competition attributes (fixed values of the stand-in).
COMPETITIONS = {
    "1-URGENT": ("GB1", "premier-league", "Premier League", "first_tier", "domestic_league", "England"),
    "2-HIGH": ("ES1", "laliga", "LaLiga", "first_tier", "domestic_league", "Spain"),
    "3-MEDIUM": ("SERA", "IT1", "Serie A", "first_tier", "domestic_league", "Italy"),
    "4-NOT SPECIFIED": ("DFBP", "dfb-pokal", "DFB-Pokal", "domestic_cup", "domestic_cup", "Germany"),
    "5-LOW": ("BUND", "bundesliga", "Bundesliga", "first_tier", "domestic_league", "Germany"),
}
COMPETITION_COLUMNS = ["competition_id", "competition_code", "name", "sub_type", "type", "country_name"]
POSITIONS = {
    "AUTOMOBILE": "Goalkeeper",
    "BUILDING": "Centre-Back",
    "FURNITURE": "Central Midfield",
    "HOUSEHOLD": "Left Winger",
    "MACHINERY": "Sweeper",
}


def _competition(position: int) -> Column:
    out = F.lit(None).cast("string")
    for priority, values in COMPETITIONS.items():
        out = F.when(F.col("o_orderpriority") == priority, values[position]).otherwise(out)
    return out


class Standins:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def appearances(self) -> DataFrame:
        line = F.col("l_linenumber")
        return self._lines.select(
            F.col("o_custkey").alias("player_id"),
            F.col("o_orderkey").alias("game_id"),
            F.when(line % 5 != 0, F.col("l_suppkey")).alias("player_club_id"),
            (F.col("o_custkey") % 50).alias("player_current_club_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            _competition(0).alias("competition_id"),
            F.when((F.col("l_linestatus") == "O") & (line == 1), 0.0)
            .when((F.col("l_linestatus") == "F") & (line == 2), F.lit(None).cast("double"))
            .otherwise(F.col("l_quantity"))
            .alias("minutes_played"),
            (F.col("l_returnflag") == "A").cast("int").alias("yellow_cards"),
            (F.col("l_returnflag") == "R").cast("int").alias("red_cards"),
        )

    @cached_property
    def games(self) -> DataFrame:
        clubs = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.min("l_suppkey").alias("home_club_id"), F.max("l_suppkey").alias("away_club_id")
        )
        orders = self.raw("orders")
        return orders.join(clubs, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("game_id"),
            _competition(0).alias("competition_id"),
            F.year(F.col("o_orderdate").cast("date")).alias("season"),
            F.col("o_orderdate").cast("date").alias("game_date"),
            "home_club_id",
            "away_club_id",
        )

    @cached_property
    def competitions(self) -> DataFrame:
        return self.raw("orders").select("o_orderpriority").distinct().select(
            *[_competition(i).alias(name) for i, name in enumerate(COMPETITION_COLUMNS)]
        )

    @cached_property
    def raw_injuries(self) -> DataFrame:
        ship, line, quantity = F.col("l_shipdate").cast("date"), F.col("l_linenumber"), F.col("l_quantity")
        undated_end = (line % 3 == 2) | ((line == 4) & (F.col("l_tax") < 0.02))
        return self._lines.filter(F.col("l_returnflag") == "R").select(
            F.col("o_custkey").alias("player_id"),
            F.when((line == 6) & (F.col("l_tax") == 0), F.lit(None).cast("date")).otherwise(ship).alias("injury_start"),
            F.when(undated_end, F.lit(None).cast("date"))
            .when(F.col("l_discount") == 0, F.date_sub(ship, 3))
            .otherwise(F.date_add(ship, quantity.cast("int")))
            .alias("injury_end"),
            F.when(line % 3 != 1, quantity).alias("days_out"),
            F.col("l_linestatus").alias("injury_reason"),
        )

    @cached_property
    def injuries(self) -> DataFrame:
        return clean_intervals(self.raw_injuries)

    @cached_property
    def transfers(self) -> DataFrame:
        date = F.col("o_orderdate").cast("date")
        return self.raw("orders").filter(F.col("o_orderstatus") == "F").select(
            F.col("o_custkey").alias("player_id"),
            F.when(F.col("o_orderkey") % 97 == 0, F.lit("1900-07-01").cast("date"))
            .when(F.col("o_orderkey") % 89 == 0, F.lit(None).cast("date"))
            .otherwise(date)
            .alias("transfer_date"),
        )

    @cached_property
    def market_values(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("player_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_totalprice").alias("value"),
            F.col("o_orderkey").alias("row_order"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        key = F.col("c_custkey")
        segment = F.col("c_mktsegment")
        position = F.lit(None).cast("string")
        for name, group in POSITIONS.items():
            position = F.when(segment == name, group).otherwise(position)
        return self.raw("customer").filter(key % 11 != 0).select(
            key.alias("player_id"),
            F.when(key % 13 != 0, position).alias("position"),
            (130 + key % 90).cast("double").alias("height"),
            F.when(key % 17 != 0, F.date_add(F.lit("1970-01-01").cast("date"), (key * 37 % 9000).cast("int")))
            .alias("date_of_birth"),
        )

    @cached_property
    def players(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("player_id"),
            F.col("c_name").alias("name"),
            F.concat_ws(" ", F.lit("Club"), F.col("c_nationkey").cast("string")).alias("current_club_name"),
            F.col("c_mktsegment").alias("position"),
        )
