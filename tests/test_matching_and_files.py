"""Fuzzy matching against brute force, and readers over hand-written files."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weekgrid.functions import scalars
from weekgrid.operators import matching
from weekgrid.plans import steps
from weekgrid.sources import readers, sinks


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
        assert matching.lcs_length(a, b) == brute_lcs(a, b)


@pytest.mark.parametrize("common,block", [(1.0, 20_000), (0.3, 7), (0.0, 5)])
def test_best_matches_equal_brute_force(spark, monkeypatch, common, block):
    monkeypatch.setattr(matching.scan_matches, "__defaults__", (3, block))
    rng = random.Random(block)
    first, last = ["bernardo", "joao", "luis", "marc", "eden"], ["silva", "hazard", "cancelo", "suarez", "stegen", "de jong"]
    players = [(i, f"{rng.choice(first)} {rng.choice(last)}{rng.choice(['', 's', ' jr'])}") for i in range(40)]
    names = [f"{rng.choice(last)} {rng.choice(first)}{rng.choice(['', 'x', 'zz'])}" for _ in range(30)] + ["Qqq", None]
    got = matching.best_matches(
        spark.createDataFrame([(n,) for n in names], "injury_name string"),
        spark.createDataFrame(players, "player_id long, name string"), common=common,
    ).collect()
    key = lambda s: " ".join(sorted(s.split()))
    order, last_id = {}, {}
    for pid, name in players:
        order.setdefault(name, pid)
        last_id[name] = pid
    for row in got:
        best = min(order, key=lambda n: (-matching.similarity(key(row["injury_name"]), key(n)), order[n]))
        assert row["match_score"] == pytest.approx(matching.similarity(key(row["injury_name"]), key(best)))
        assert (row["candidate_name"], row["player_id"]) == (best, last_id[best])
    assert {r["injury_name"] for r in got} == {n for n in names if n}


def test_block_scores_equal_single_ones():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé \U0001f600") for _ in range(rng.randint(0, 70))) for _ in range(60)] + [""]
    offers = matching.Offers(words)
    for name in [*words[:20], "", "x" * 64, "ab" * 40]:
        assert offers.scores(name).tolist() == [matching.similarity(name, w) for w in words]
    assert matching.Offers([]).scores("a").tolist() == [] and matching.Offers([""]).scores("").tolist() == [100.0]


def test_falling_bound_finds_the_first_best():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé xyz") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "a\0b"]
    offers = matching.Offers(words)
    for name in [*("".join(rng.choice("abcdé xyzq") for _ in range(rng.randint(0, 30))) for _ in range(60)), "", "x" * 70, "a\0b", words[5]]:
        scores = offers.scores(name)
        at, score = offers.best(name)
        assert (at, score) == (int(scores.argmax()), float(scores.max()))


def test_scored_pairs_grow_less_than_all():
    rng = random.Random(2)
    first = ["".join(rng.choice("aeioubcdfgklmnprst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    people = [f"{rng.choice(first)} {rng.choice(first)}" for _ in range(16_000)]
    asked = [p[:3] + rng.choice("xyz") + p[4:] for p in rng.sample(people, 60)]
    scored = []
    for n in (4_000, 16_000):
        offers = matching.Offers(people[:n])
        for name in asked:
            offers.best(name)
        scored.append(offers.scored)
    assert scored[1] < 2.8 * scored[0] and scored[1] < 0.2 * len(asked) * 16_000, scored


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not mounted")
def test_whole_tables_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{folder}/part.parquet").collect()
    names = {r["p_name"] for r in parts} | {"crew " + r["s_name"] for r in spark.read.parquet(f"{folder}/supplier.parquet").collect()}
    order, last_id = {}, {}
    for r in sorted(parts, key=lambda r: r["p_partkey"]):
        name = f"{r['p_name'].split(' ')[-1]} {r['p_brand']}"
        order.setdefault(name, r["p_partkey"])
        last_id[name] = r["p_partkey"]
    key = lambda s: " ".join(sorted(s.split()))
    want = set()
    for name in names:
        best = min(order, key=lambda n: (-round(matching.similarity(key(name), key(n)), 9), order[n]))
        want.add((name, best, round(matching.similarity(key(name), key(best)), 6), last_id[best]))
    got = entry.queries()["U1_J13_fuzzy_matches"](spark, folder).collect()
    assert {(r["injury_name"], r["candidate_name"], round(r["match_score"], 6), r["player_id"]) for r in got} == want


def test_many_unlike_names_end(spark):
    """Names that no filter settles: the scan alone has to be fast enough."""
    names = spark.range(2000).select(F.concat(F.lit("qx "), F.md5(F.col("id").cast("string"))).alias("injury_name"))
    players = spark.range(20_000).select(F.col("id").alias("player_id"), F.concat(F.lit("zu "), F.md5((F.col("id") + 7000).cast("string"))).alias("name"))
    assert matching.best_matches(names, players).count() == 2000


def test_reordered_tokens_score_100(spark):
    row = matching.best_matches(
        spark.createDataFrame([("Silva Bernardo",)], "injury_name string"),
        spark.createDataFrame([(1, "Bernardo Silva"), (2, "Bernard Silva")], "player_id long, name string"),
    ).first()
    assert (row["match_score"], row["player_id"]) == (100.0, 1)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_detect_tables(spark, tmp_path):
    write(tmp_path / "b/inj.csv", "player_id,from_date,days_missed,extra\n1,2024-01-02,5,x\n")
    write(tmp_path / "a/inj_alt.csv", "player_id,injury_start,days_missed\n1,2024-01-02,5\n")
    write(tmp_path / "m/player_latest_market_value/v.csv", "player_id,date_unix,value\n1,2024-01-02,5\n")
    write(tmp_path / "p/prof.csv", "player_id,height,position\n1,180,GK\n")
    write(tmp_path / "i/other.csv", "player_id,from,until,Days\n1,2024-01-02,2024-01-05,3\n")
    found = {k: v[0].rsplit("/", 1)[-1] for k, v in readers.detect_tables(spark, str(tmp_path)).items()}
    assert found == {"injuries": "inj.csv", "injuries_irrazional": "other.csv"}
    cache = str(tmp_path / "cache")
    assert readers.detect_tables(spark, str(tmp_path), cache) == readers.detect_tables(spark, "/nowhere", cache)


def test_load_labels_and_lenient_types(spark, tmp_path):
    write(tmp_path / "inj.csv", "player_id,from_date,end_date,days_missed\n1,2024-01-02,bad,5\n2,,2024-02-01,x\nz,2024-01-03,2024-01-09,6\n")
    write(tmp_path / "mv.csv", "player_id,date_unix,value\n1,2023-12-19,100\n")
    got = readers.load_labels(spark, str(tmp_path))
    rows = {r["player_id"]: r for r in got["injuries"].collect()}
    assert rows[1]["injury_end"] is None and rows[1]["days_out"] == 5.0
    assert rows[2]["injury_start"] is None and rows[2]["days_out"] is None
    assert None in rows
    assert str(got["market_values"].first()["date"]) == "2023-12-19"


def test_backbone_needs_all_tables(spark, tmp_path):
    write(tmp_path / "appearances.csv", "player_id\n1\n")
    with pytest.raises(FileNotFoundError):
        readers.load_backbone(spark, str(tmp_path))


def test_folder_loads_and_inventory(spark, tmp_path):
    write(tmp_path / "My-Data Set (v2)/t one.csv", "a,b\n1,2\n3,4,5\n6,7\n")
    write(tmp_path / "solo.csv", "a\n1\n2\n")
    found = {(r["dataset_id"], r["table"]) for r in readers.discover_datasets(spark, str(tmp_path)).collect()}
    assert found == {("my_data_set_v2", "t one"), ("solo", "solo")}
    sizes = {r["path"].rsplit("/", 1)[-1]: (r["n_cols"], r["n_rows"]) for r in readers.header_inventory(spark, str(tmp_path)).collect()}
    assert sizes["solo.csv"] == (1, 2) and sizes["t one.csv"] == (2, 3)
    tables, log = readers.load_all_csvs(spark, str(tmp_path))
    assert set(tables) == {"solo"} and log.first()["status"] == "loaded"
    with pytest.raises(ValueError):
        readers.load_table(spark, "x.xlsx")


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-02", "My-Data Set (v2)", None), ("bad", "x", "Centre-Back"), ("", "y", "Left Winger")], "d string, s string, p string")
    rows = df.select(scalars.lenient_date("d").alias("d"), scalars.slug("s").alias("s"), scalars.position_group("p").alias("p")).collect()
    assert [str(r["d"]) for r in rows] == ["2024-01-02", "None", "None"]
    assert rows[0]["s"] == "my_data_set_v2"
    assert [r["p"] for r in rows] == ["Unknown", "DEF", "FWD"]
    renamed = readers.standardize_columns(spark.createDataFrame([(1, 2)], "` A b/c.` int, `X-y` int"))
    assert renamed.columns == ["a_b_c", "x_y"]


def test_stage_store(spark, tmp_path):
    stages = sinks.StageStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        stages.load("a")
    assert stages.get("a", lambda: spark.range(3)).count() == 3 and stages.get("a", lambda: spark.range(3)).count() == 3
    assert stages.built == ["a"] and stages.reused == ["a"]
    assert stages.get("a", lambda: spark.range(4)).count() == 4 and stages.load("a").count() == 4
    # Lambda variables and expression ids get other names in every plan.
    twice = lambda: spark.range(3).select(F.transform(F.array("id"), lambda x: x + 1).alias("v"))
    assert sinks.fingerprint(twice()) == sinks.fingerprint(twice()) != sinks.fingerprint(spark.range(3).select(F.transform(F.array("id"), lambda x: x + 2).alias("v")))
    # Rows in memory can't be told apart by their plan.
    rows = lambda v: spark.createDataFrame([(v,)], "v int")
    assert [stages.get("m", lambda v=v: rows(v)).first()["v"] for v in (1, 2, 2)] == [1, 2, 2]


def test_changed_input_rebuilds_what_hangs_on_it(spark, tmp_path):
    def write(name, rows):
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))

    def run():
        stages = sinks.StageStore(spark, str(tmp_path / "stages"))
        left = stages.get("left", lambda: spark.read.parquet(str(tmp_path / "l")).filter("v > 0"))
        right = stages.get("right", lambda: spark.read.parquet(str(tmp_path / "r")))
        both = stages.get("both", lambda: left.join(right.withColumnRenamed("v", "w"), "k"))
        total = stages.get("total", lambda: both.groupBy("k").sum("w"))
        return stages.built, sorted((r[0], r[1]) for r in total.collect())

    write("l", [(1, 1), (2, 0)])
    write("r", [(1, 5), (2, 6)])
    assert run() == (["left", "right", "both", "total"], [(1, 5)])
    assert run() == ([], [(1, 5)])
    write("r", [(1, 7), (2, 6), (1, 1)])
    assert run() == (["right", "both", "total"], [(1, 8)])
    assert not [p for p in (tmp_path / "stages").iterdir() if p.name.startswith(".staged")]


def test_half_written_stage_is_not_there(spark, tmp_path):
    files = sinks.Published(spark, str(tmp_path))

    def broken(path):
        spark.range(2).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        files.publish("x/key", broken)
    assert not files.exists("x/key")
    files.publish("x/key", spark.range(2).write.parquet)
    files.publish("x/key", spark.range(5).write.parquet)  # who comes second leaves the first result
    assert spark.read.parquet(str(tmp_path / "x/key")).count() == 2


def test_steps(spark, tmp_path):
    """Eighteen steps over files; a changed transfer file touches its own cleaning only, a changed interval file what hangs on it."""
    days = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    back, other = tmp_path / "back", tmp_path / "other"
    tables = {
        back / "players.csv": ["player_id,name", "1,A", "2,B"],
        back / "competitions.csv": ["competition_id,name", "GB1,x", "XX,y"],
        back / "games.csv": ["game_id,competition_id,season,date,home_club_id,away_club_id", *(f"{g},{'GB1' if g % 4 else 'XX'},2024,{days(g * 3)},10,11" for g in range(40))],
        back / "appearances.csv": ["appearance_id,game_id,player_id,player_club_id,player_current_club_id,date,competition_id,yellow_cards,red_cards,goals,assists,minutes_played",
                                   *(f"{g}_{p},{g},{p},10,10,{days(g * 3)},GB1,0,0,0,0,90" for g in range(40) for p in (1, 2))],
        other / "injuries.csv": ["player_id,injury_reason,from_date,end_date,days_missed", "1,knee,2024-02-20,2024-03-20,29"],
        other / "transfers.csv": ["player_id,transfer_date,from_team_id", "1,2023-07-01,5"],
        other / "values.csv": ["player_id,date_unix,value", "1,2023-07-01,5"],
    }
    for path, lines in tables.items():
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(lines) + "\n")
    sources = steps.Sources(spark, str(back), str(other))

    def run():
        store = sinks.StageStore(spark, str(tmp_path / "store"))
        panel = steps.Runner(sources, store).run_all()["panel"]
        return {s.split("/")[0][5:] for s in store.built}, {(r["player_id"], str(r["week_start"])): r["target"] for r in panel.collect()}

    with pytest.raises(FileNotFoundError, match="3_3"):
        steps.Runner(sources, sinks.StageStore(spark, str(tmp_path / "store"))).run("4_2")
    built, first = run()
    assert len(steps.STEPS) == 18 and built == set(steps.STEPS)
    assert first[(1, "2024-02-19")] == 1 and first[(2, "2024-02-19")] == 0
    assert run() == (set(), first)
    (other / "transfers.csv").write_text("player_id,transfer_date,from_team_id\n1,2022-07-01,5\n")
    assert run() == ({"1_4", "2_2"}, first)
    (other / "injuries.csv").write_text("player_id,injury_reason,from_date,end_date,days_missed\n2,knee,2024-02-20,2024-03-20,29\n")
    built, second = run()
    assert built == {"1_4", "2_1", "2_5", "5_1", "5_3"} and second[(1, "2024-02-19")] == 0 and second[(2, "2024-02-19")] == 1


def test_head_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "a int, b double")
    assert [r["record"] for r in sinks.head_records(df).orderBy(F.col("record")).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":null}']


def test_matching_broadcasts_no_names(spark):
    """Names and candidates grow with the input: whatever their files' sizes, none goes through the driver."""
    people = spark.range(40).selectExpr("id AS player_id", "concat('Person ', id) AS name")
    names = spark.range(40).selectExpr("concat(id, ' Person') AS injury_name")
    plan = matching.best_matches(names, people)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
