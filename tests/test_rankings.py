"""Exact ranks, quantiles, metrics, samples and draws against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekgrid.operators import profile, ranking, risk, sampling


@pytest.fixture(params=["one bucket", "many buckets"])
def buckets(request, monkeypatch):
    if request.param == "many buckets":
        monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 20)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 1500
    score = np.where(rng.random(n) < 0.34, 0.5, np.round(rng.random(n), 2))
    label = (rng.random(n) < 0.2 + 0.5 * score).astype(int)
    rows = [(int(i % 60), int(i), float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))]
    return spark.createDataFrame(rows, "player_id long, tie long, p double, target int"), rows


def brute(rows):
    p = np.array([r[2] for r in rows])
    y = np.array([r[3] for r in rows])
    cuts = sorted(set(p), reverse=True)
    ap = trap = 0.0
    last_r, last_p = 0.0, 1.0
    for c in cuts:
        sel = p >= c
        prec, rec = y[sel].mean(), y[sel].sum() / y.sum()
        ap += (rec - last_r) * prec
        trap += (rec - last_r) * (prec + last_p) / 2
        last_r, last_p = rec, prec
    pos, neg = p[y == 1], p[y == 0]
    roc = np.mean([(np.sum(neg < v) + 0.5 * np.sum(neg == v)) / len(neg) for v in pos])
    k = max(1, int(0.05 * len(p)))
    top = sorted(rows, key=lambda r: (-r[2], r[1]))[:k]
    return ap, trap, roc, np.mean((p - y) ** 2), sum(r[3] for r in top), k


def test_metrics(scored, buckets):
    df, rows = scored
    ap, trap, roc, brier, hits, k = brute(rows)
    got = ranking.evaluation(df, "target", "p", "tie").first()
    assert got["average_precision"] == pytest.approx(ap, abs=1e-12)
    assert got["pr_auc_trap"] == pytest.approx(trap, abs=1e-12)
    assert got["roc_auc"] == pytest.approx(roc, abs=1e-12)
    assert got["brier"] == pytest.approx(brier, abs=1e-12)
    assert (got["hits"], got["k"]) == (hits, k)


@pytest.mark.parametrize("n,k", [(10, 1), (100, 5), (139, 6)])
def test_top_share_sizes(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("tie"), F.lit(0.5).alias("p"), F.lit(1).alias("target"))
    got = ranking.top_share(df, "target", "p", "tie").first()
    assert (got["k"], got["hits"]) == (k, k)


def test_quantiles(spark, scored, buckets):
    df, rows = scored
    wanted = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in ranking.exact_quantiles(df, ["p", "tie"], wanted).collect()}
    for name, at in (("p", 2), ("tie", 1)):
        for q in wanted:
            assert got[name, q] == pytest.approx(np.quantile([r[at] for r in rows], q), abs=1e-9)


def test_running_totals(scored, buckets):
    df, rows = scored
    counted = df.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    got = {r["p"]: r["cum_n"] for r in ranking.running_totals(counted, "p", ["n"]).collect()}
    assert got == {v: sum(r[2] <= v for r in rows) for v in got}


def test_decile_edges_drop_repeats(spark):
    from weekgrid.operators.features import quantile_bins

    df = spark.createDataFrame([(float(v),) for v in [1] * 80 + list(range(2, 22))], "x double")
    bins = {r["decile"]: r["n"] for r in quantile_bins(df, "x").groupBy("decile").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(bins) == {0, 1} or len(bins) < 10
    assert bins[0] >= 80


def test_sample_is_exact_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r[0] for r in sampling.sample_rows(df, 321, ["k"], 1).collect()}
    b = {r[0] for r in sampling.sample_rows(df.repartition(17), 321, ["k"], 1).collect()}
    assert len(a) == 321 and a == b
    assert sampling.sample_rows(df, 99999, ["k"], 1).count() == 5000


def test_shuffled_labels_keep_the_count(scored):
    df, rows = scored
    mixed = risk.shuffled_labels(df, 3, keys=["player_id", "tie"])
    assert mixed.agg(F.sum("target")).first()[0] == sum(r[3] for r in rows)
    changed = mixed.withColumnRenamed("target", "t2").join(df, ["player_id", "tie"]).filter("t2 <> target").count()
    assert changed > 100


def test_draws_are_complete(spark):
    keys = spark.range(50).withColumnRenamed("id", "k")
    per_rep = risk.draws(keys, "k", 20, 1).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert len(per_rep) == 20 and {r["n"] for r in per_rep} == {50}


def test_bootstrap_interval_covers_the_estimate(scored):
    df, rows = scored
    reps = risk.bootstrap_metrics(df, "target", "p", "player_id", 60)
    ci = {r["metric"]: r for r in risk.intervals(reps, ["average_precision"]).collect()}["average_precision"]
    assert ci["lower"] < brute(rows)[0] < ci["upper"]


def test_largest_values_repeat(spark):
    df = spark.createDataFrame([(v,) for v in [9.0, 9.0, 9.0, 8.0, 7.0, 7.0, 1.0]], "x double")
    got = [r["value"] for r in profile.largest_values(df).orderBy("place").collect()]
    assert got == [9.0, 9.0, 9.0, 8.0, 7.0]


def test_bootstrap_equals_draws_joined_to_rows(spark, monkeypatch):
    """Blocks of three keys, draws made five at a time: every draw counts once; null keys and null scores included."""
    monkeypatch.setattr(risk, "CELL", 12)
    monkeypatch.setattr(risk, "DRAWS", 5)
    rows = [(k, (k * 7 + i) % 5 / 4 if (k + i) % 6 else None, (k + i) % 3 // 2) for k in [*range(17), 40, 41] for i in range(3)]
    df = spark.createDataFrame(rows + [(None, 0.5, 1)], "k long, p double, target int")
    n = df.select("k").distinct().count()
    keys = [None, *sorted({r[0] for r in rows})]
    wanted = {}
    for rep in range(4):
        for i in range(n):
            key = keys[int(hashlib.md5(f"42|{rep}|{i}".encode()).hexdigest()[:13], 16) % n]
            for _, p, target in (r for r in rows if r[0] == key):
                own = wanted.setdefault(rep, [0, 0])
                own[0], own[1] = own[0] + 1, own[1] + target
    made = risk.bootstrap_metrics(df, "target", "p", "k", 4)
    assert {r["rep"]: [r["rows"], r["positives"]] for r in made.collect()} == wanted
    times = {}
    for r in risk.draws(df, "k", 4, 42).collect():
        times[r["rep"]] = times.get(r["rep"], 0) + r["times"]
    assert times == {rep: n for rep in range(4)}
    # No (key, replicate) rows: draws meet the counts block by block.
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "md5" not in plan
