"""Whole tables from part files, ragged lines, and values that no calendar or register holds."""

import datetime as dt

from pyspark.sql import functions as F

from weekgrid.functions import scalars
from weekgrid.operators import cleaning, risk, sampling
from weekgrid.operators.sampling import HASH, with_hash
from weekgrid.sources import readers, sinks


def test_a_folder_of_parts_is_one_table(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("player_id"), F.lit("2024-01-02").alias("from_date"), F.lit("5").alias("days_missed"))
    sinks.write_csv(rows.repartition(8), f"{tmp_path}/z/injuries")
    assert readers.load_labels(spark, str(tmp_path))["injuries"].count() == 1000
    # A table of a lesser path is another table; it wins, whole.
    sinks.write_csv(rows.limit(300).repartition(3), f"{tmp_path}/a/injuries")
    assert readers.load_labels(spark, str(tmp_path))["injuries"].count() == 300


def test_ragged_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,2,3\n4,5\n6\n7,8,9,10\n11,12,13,\n"x, y",,\n')
    df = readers.load_table(spark, f"{tmp_path}/t.csv")
    assert sorted((tuple(r) for r in df.collect()), key=str) == [("1", 2, 3), ("11", 12, 13), ("4", 5, None), ("6", None, None), ("x, y", None, None)]
    assert dict(df.dtypes) == {"a": "string", "b": "bigint", "c": "bigint"}
    (tmp_path / "e.csv").write_text("")
    tables, log = readers.load_all_csvs(spark, str(tmp_path))
    assert tables["t"].count() == 5 and {r["table"] for r in log.collect()} == {"t", "e"}


def test_inventory_reads_quoted_names(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,"a, b","say ""x"""\n1,2,3\n')
    row = readers.header_inventory(spark, str(tmp_path)).first()
    assert (row["cols"], row["n_cols"], row["n_rows"]) == (["id", "a, b", 'say "x"'], 3, 1)
    assert readers.headers(spark, str(tmp_path)).popitem()[1] == ["id", "a, b", 'say "x"']


def test_measures_are_finite(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), ("-Infinity",), ("7.5",), ("x",), (None,)], "m string")
    assert sorted(r[0] for r in df.select(scalars.measure("m")).collect()) == [0, 0, 0, 0, 0, 7.5]


def test_impossible_durations_are_unknown(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, None, float("nan")), (2, day, None, 1e12), (3, day, None, 4.0), (4, day, dt.date(2024, 1, 9), float("inf"))]
    found = cleaning.clean_intervals(spark.createDataFrame(rows, "player_id long, injury_start date, injury_end date, days_out double"))
    assert {r["player_id"]: (r["injury_end"], r["days_out"]) for r in found.collect()} == {
        1: (None, None), 2: (None, None), 3: (dt.date(2024, 1, 5), 4.0), 4: (dt.date(2024, 1, 9), 8.0),
    }


def test_tie_key_orders_any_id(spark):
    rows = [(i, dt.date(2024, 1, d), s) for i in (1, 10**13, 9 * 10**18) for d in (1, 8) for s in (2009, 2010)]
    df = spark.createDataFrame(rows[::-1], "player_id long, week_start date, season int")
    assert [tuple(r)[:3] for r in df.withColumn("k", risk.tie_key()).orderBy("k").collect()] == rows


def test_hash_threshold_at_every_place(spark):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(3)
    ordered = sorted(r[0] for r in with_hash(df, ["k"], 5).select(HASH).collect())
    for n in (1, 2, 250, 499, 500):
        assert sampling.hash_threshold(df, n, ["k"], 5).first()[0] == ordered[n - 1]
    assert sampling.hash_threshold(df, 501, ["k"], 5).first()[0] == -1


def test_rebalanced_panel_is_whole(spark, tmp_path):
    panel = spark.range(300).select(F.col("id").alias("player_id"), (F.col("id") % 3).alias("season"))
    sinks.write_panel(panel, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").groupBy("season").count().count() == 3


def test_panel_is_written_without_a_shuffle(spark, tmp_path):
    """Each of three tasks writes its own file of each season; the session's setting stays."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    panel = spark.range(0, 300, 1, 3).select(F.col("id").alias("player_id"), (F.col("id") % 3).alias("season"))
    sinks.write_panel(panel, f"{tmp_path}/p")
    assert len(list(tmp_path.glob("p/season=*/part-*.parquet"))) == 9
    assert spark.read.parquet(f"{tmp_path}/p").count() == 300 and spark.conf.get(name) == before
