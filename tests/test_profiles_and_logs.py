"""The fused profile against the separate ones, load logs with bad files, and coverage of several pairs at once."""

import gzip

import pytest
from pyspark.sql import functions as F

from weekgrid.operators import fused, joins, profile
from weekgrid.plans import jobs
from weekgrid.sources import readers


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(500).select(
        (F.col("id") % 37).alias("player_id"), F.when(F.col("id") % 11 != 0, F.col("id") % 7 * 0.25).alias("minutes"),
        F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") % 90 + 130.0).alias("height"),
        F.when(F.col("id") % 3 == 0, "soon").otherwise(F.date_add(F.lit("2020-01-01"), (F.col("id") % 40).cast("int")).cast("string")).alias("from_date"),
        F.date_add(F.lit("2020-01-05"), (F.col("id") % 40).cast("int")).alias("until"), F.when(F.col("id") % 2 == 0, "").alias("note"),
        F.array("id").alias("tags"),
    )


def cells(rows):
    return {(r["section"], r["column"], r["metric"]): (r["value"], r["text"]) for r in rows.collect()}


def test_fused_profile_is_the_separate_one(table):
    got = cells(fused.profile_counts(fused.value_counts(table), table))
    value = lambda *key: got[key][0]
    basic = profile.basic_stats(table).first()
    assert [value("basic", "*", m) for m in ("n_rows", "n_columns", "duplicate_rows")] == [basic["n_rows"], basic["n_columns"], basic["duplicate_rows"]]
    plain = table.withColumn("height", F.when(~F.isnan("height"), F.col("height")))
    for r in profile.missingness(plain).collect():
        assert value("missing", r["column"], "missing_pct") == pytest.approx(r["missing_pct"])
    for r in profile.numeric_summary(plain).collect():
        for metric in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"):
            assert value("numeric", r["column"], metric) == pytest.approx(r[metric]), (r["column"], metric)
    for r in profile.largest_values(plain).collect():
        assert value("largest", r["column"], str(r["place"])) == r["value"]
    for r in profile.top_values(table).collect():
        assert got["frequent", r["column"], str(r["place"])] == (r["n"], r["value"])
    for r in profile.date_columns(table).collect():
        assert value("dates", r["column"], "success_pct") == pytest.approx(r["success_pct"]) and value("dates", r["column"], "invalid") == r["invalid"]
    for r in profile.id_columns(table).collect():
        assert value("ids", r["column"], "uniqueness") == pytest.approx(r["uniqueness"]) and value("ids", r["column"], "likely_key") == r["likely_key"]
    for r in profile.interval_checks(plain).collect():
        if (key := ("checks", r["check"], r["metric"])) in got:
            assert value(*key) == pytest.approx(r["value"]), key
    assert ("checks", "injuries", "median_days") in got and ("checks", "height", "outliers") in got and ("checks", "minutes", "median") in got


def test_fused_profile_reads_once(table, tmp_path, spark):
    table.write.parquet(str(tmp_path / "t"))
    plan = fused.value_counts(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_fused_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "a_id int, name string, start_day string, end_day string, height double")
    got = cells(fused.profile_counts(fused.value_counts(empty), empty))
    assert not [k for k in got if k[0] not in ("basic", "checks")]


def test_load_log(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n3,\n")
    (tmp_path / "ragged.csv").write_text('a,b\n1\n2,3,\n4,5,6\n7,"x\n,y"\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "broken.csv").mkdir()
    (tmp_path / "broken.csv" / "p.csv.gz").write_bytes(b"no archive")
    (tmp_path / "zipped.csv").mkdir()
    (tmp_path / "zipped.csv" / "p.csv.gz").write_bytes(gzip.compress(b"a\n1\n2\n"))
    tables, log = readers.load_all_csvs(spark, str(tmp_path))
    assert sorted(tuple(r) for r in log.collect()) == [
        ("broken", "failed", 0, 0, 0, "unreadable"), ("empty", "failed", 0, 0, 0, "empty"), ("good", "loaded", 2, 2, 0, ""),
        ("ragged", "loaded", 3, 2, 1, ""), ("zipped", "loaded", 2, 1, 0, ""),
    ]
    assert sorted(tables) == ["good", "ragged", "zipped"] and all(tables[r["table"]].count() == r["n_rows"] for r in log.filter("status = 'loaded'").collect())
    assert readers.load_log(spark, str(tmp_path / "nowhere")).count() == 0


def test_coverage_of_several_pairs(spark):
    def keys(*values):
        return spark.createDataFrame([(v,) for v in values], "player_id int")

    tables = {"players": keys(1, 2, 3, None, 3), "one": keys(2, 2, 9), "two": keys(), "three": keys(None, 1, 2, 3)}
    members = joins.membership(tables, "player_id")
    got = [r.asDict() for r in joins.coverage_of_pairs(members, "player_id", list(tables)).collect()]
    want = [joins.join_coverage(tables["players"], tables[n], "player_id", f"players_vs_{n}").first().asDict() for n in ("one", "two", "three")]
    for g, w in zip(got, want):
        assert {k: v for k, v in g.items() if not k.startswith("coverage")} == {k: v for k, v in w.items() if not k.startswith("coverage")}
        assert g["coverage_left"] == pytest.approx(w["coverage_left"]) and g["coverage_right"] == pytest.approx(w["coverage_right"] or 0)
    audit = jobs.join_audit(tables["players"], {n: tables[n] for n in ("one", "two", "three")}, sample=1)
    found = {(r["join"], r["kind"]): r["player_id"] for r in audit.samples.collect()}
    assert found["players_vs_one", "right_only"] == 9 and found["players_vs_one", "both"] == 2 and ("players_vs_two", "both") not in found
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookups_skip_files_and_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    from weekgrid.sources import sinks

    before = spark.conf.get("spark.sql.shuffle.partitions")
    panel = spark.range(400_000).select((F.col("id") % 5000 * 2).alias("player_id"), F.date_add(F.lit("2020-01-06"), (F.col("id") / 5000).cast("int") * 7).alias("week_start"),
                                        (F.col("id") % 2 + 2020).cast("int").alias("season"), F.md5(F.col("id").cast("string")).alias("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_lookup_panel(panel, str(tmp_path / "p"), group=1 << 18)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = holding = 0
    for file in (tmp_path / "p").glob("part-*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            column = next(c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns)) if c.path_in_schema == "player_id")
            groups += 1
            holding += column.statistics.min <= 4000 <= column.statistics.max
    assert groups >= 8 and holding <= groups / 3
    assert any(b"parquet-mr" in (pq.ParquetFile(f).metadata.created_by or "").encode() for f in (tmp_path / "p").glob("part-*.parquet"))
    read = spark.read.parquet(str(tmp_path / "p"))
    assert read.filter("player_id = 4000").count() == 80
    # An odd id lies inside the ranges, but in no filter: not a single row leaves the scan.
    query = read.filter("player_id = 4001").select("x")
    assert query.collect() == [] and "PushedFilters: [IsNotNull(player_id), EqualTo(player_id,4001)]" in query._jdf.queryExecution().executedPlan().toString()
    scan = query._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() == 0


def test_lookups_are_built_by_ranges_of_players(spark):
    import pyarrow.parquet as pq

    from weekgrid.catalog import panel_queries as q
    from weekgrid.sources.standins import Standins

    t = Standins(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = q.lookup_panel(t)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, q.panel(t, q.LOOKED_UP).collect()))
    plan = q.panel(t, q.LOOKED_UP, ranged=True)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(player_id" in plan.split("Window")[-1] and "rangepartitioning" not in plan.split("Window")[0]
    files = [pq.read_table(f.removeprefix("file://"), columns=["player_id"])["player_id"].to_pylist() for f in kept.inputFiles()]
    spans = sorted((min(ids), max(ids)) for ids in files if ids)
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and all(ids == sorted(ids) for ids in files)


def test_catalog_counts_the_values_of_a_table_once(spark, tmp_path):
    data = [(1, 2**53, 0.5, "x"), (1, 2**53 + 1, float("nan"), None), (None, None, None, "x"), (4, 7, 0.25, "")]
    spark.createDataFrame(data, "whole int, big long, part double, name string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    table = profile.feature_catalog(df, excluded=[])
    assert "Relation [whole#" not in table._jdf.queryExecution().optimizedPlan().toString()  # the report reads the counted values only
    got = {r["feature"]: r for r in table.collect()}
    assert {c: (r["missing_pct"], r["n_unique"]) for c, r in got.items()} == {"whole": (0.25, 2), "big": (0.25, 3), "part": (0.25, 3), "name": (0.25, 2)}
    assert got["whole"]["mean"] == 2.0 and got["whole"]["std"] == pytest.approx(3**0.5) and got["big"]["min"] == 7.0
    assert got["whole"]["p50"] == 1.0 and got["whole"]["max"] == 4.0 and got["part"]["p50"] == 0.375 and got["name"]["p50"] is None
    empty = {r["feature"]: r for r in profile.feature_catalog(df.limit(0), excluded=[]).collect()}
    assert empty["whole"]["missing_pct"] is None and empty["whole"]["n_unique"] == 0 and len(empty) == 4
