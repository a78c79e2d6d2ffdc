"""Quantiles, bins, global order and lookups, with limits lowered so that the large-table paths run."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep.functions import bins, columns, counts, lookup, order, power, quantiles, tail

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def frame(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double").repartition(5)


SHAPES = {
    "even": [float(i) for i in range(3000)],
    "hot": [7.0] * 1000 + [float(i % 50) for i in range(2000)],
    "hot_low": [0.0] * 2000 + [random.Random(1).expovariate(0.01) for _ in range(1000)],
    "two": [1.0, 2.0] * 700,
    "wild": [math.copysign(10.0 ** random.Random(i).uniform(-20, 200), i % 3 - 1) for i in range(2000)],
    "constant": [3.5] * 500,
    "one": [42.0],
    "with_nulls": [None if i % 3 == 0 else float(i) for i in range(2000)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_narrowed_quantiles_are_exact(spark, monkeypatch, shape):
    """A coarse sketch, and intervals of one or 20 rows at most: several rounds are needed."""
    monkeypatch.setattr(quantiles, "SKETCH", 40)
    monkeypatch.setattr(quantiles, "_SLACK", 0.05)
    monkeypatch.setattr(quantiles, "GRID", 16)
    values = SHAPES[shape]
    want = np.quantile([v for v in values if v is not None], PROBS)
    for rows in (1, 20):
        got = quantiles.fit(frame(spark, values), ["x"], PROBS, exact_rows=rows)["x"]
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_quantiles_outside_their_brackets_are_repaired(spark, monkeypatch):
    """Brackets that miss the ranks cost a read, not the result."""
    monkeypatch.setattr(quantiles, "_around", lambda p: [0.4, 0.6])
    for rows in (1, 50_000):
        got = quantiles.fit(frame(spark, SHAPES["hot_low"]), ["x"], PROBS, exact_rows=rows)["x"]
        np.testing.assert_allclose(got, np.quantile(SHAPES["hot_low"], PROBS), rtol=1e-12)


def reads(spark, work):
    """What work() returns, and how often Spark scanned a table for it: stages that read input, each once."""
    sc, group = spark.sparkContext, f"g{random.random()}"
    sc.setJobGroup(group, group)
    try:
        out = work()
    finally:
        sc._jsc.clearJobGroup()
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def test_quantiles_take_two_reads_and_three_beyond_the_bound(spark):
    df = spark.range(0, 300_000, 1, 8).select(
        F.rand(3).alias("x"), (F.col("id") % 50).cast("double").alias("few"), F.when(F.col("id") % 3 > 0, F.randn(5)).alias("gaps")
    )
    cols, probs = ["x", "few", "gaps"], [0.01, 0.25, 0.5, 0.77, 0.99]
    table = df.toPandas()
    want = {c: np.quantile(table[c].dropna(), probs) for c in cols}
    for rows, most in ((50_000, 4), (20, 6)):  # a read is a job for the tasks that scan and one for their results
        got, jobs = reads(spark, lambda rows=rows: quantiles.fit(df, cols, probs, exact_rows=rows, also={"n": F.count(F.lit(1))}))
        assert jobs <= most and got.pop("n") == 300_000
        for c in cols:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = frame(spark, [None, None])
    assert quantiles.fit(df, ["x"], [0.5])["x"] == [None]
    assert quantiles.fit(df, ["x"], [0.5], exact_rows=0)["x"] == [None]


def test_quantiles_skip_nan(spark):
    df = frame(spark, [1.0, 2.0, float("nan"), 3.0])
    assert quantiles.fit(df, ["x"], [0.5])["x"] == [2.0]


def test_approx_quantiles_are_close(spark):
    got = quantiles.fit(frame(spark, SHAPES["even"]), ["x"], [0.5], mode="approx")["x"][0]
    assert abs(got - 1499.5) < 5


@pytest.mark.parametrize("values", [list(map(float, [1, 1, 1, 2, 3, 4, 5, 5, 5, 9])), [0.0] * 8 + [1.0, 2.0], list(map(float, range(23)))])
def test_right_closed_bins_equal_qcut(spark, values):
    df = frame(spark, values)
    edge = bins.edges(df, ["x"], 5)[0]["x"]
    got = {r["x"]: r["b"] for r in df.select("x", bins.index(F.col("x"), edge).alias("b")).collect()}
    want = pd.qcut(pd.Series(values), 5, labels=False, duplicates="drop")
    assert got == dict(zip(values, want))


def test_left_closed_bins_equal_histogram(spark):
    values = list(map(float, [0, 1, 1, 2, 3, 5, 8, 8, 9, -1, 11]))
    edge = [0.0, 1.0, 3.0, 8.0, 9.0]
    df = frame(spark, values).select(bins.index(F.col("x"), edge, "left").alias("b"))
    got = [0] * 4
    for r in df.collect():
        if r["b"] is not None:
            got[r["b"]] += 1
    assert got == list(np.histogram(values, edge)[0])


def test_many_edges_use_the_same_rule(spark):
    edge = [float(i) for i in range(200)]
    df = frame(spark, [0.0, 0.5, 99.0, 199.0, 200.0])
    got = {r["x"]: r["b"] for r in df.select("x", bins.index(F.col("x"), edge, "right").alias("b")).collect()}
    assert got == {0.0: 0, 0.5: 0, 99.0: 98, 199.0: 198, 200.0: None}


def test_clamped_bins(spark):
    df = frame(spark, [-5.0, 0.5, 99.0]).select(bins.index(F.col("x"), [0.0, 1.0, 2.0], "left", "clamp").alias("b"))
    assert sorted(r["b"] for r in df.collect()) == [0, 0, 1]


@pytest.mark.parametrize("per, fan", [(10**9, 1000), (40, 1000), (7, 1000), (7, 3)])
def test_running_sum(spark, monkeypatch, per, fan):
    monkeypatch.setattr(order, "FAN", fan)
    monkeypatch.setattr(order, "ROWS_PER_RANGE", per)
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    flat = {r["k"]: r["s"] for r in order.running(df, ["k"], {"s": F.col("v")}).collect()}
    grouped = {r["k"]: r["s"] for r in order.running(df, ["k"], {"s": F.col("v")}, by=["g"]).collect()}
    total, per_group = 0, {}
    for g, k, v in rows:
        total += v
        per_group[g] = per_group.get(g, 0) + v
        assert flat[k] == total
        assert grouped[k] == per_group[g]


def test_ten_thousand_ranges(spark):
    """Earlier ranges are summed up by a tree of several levels; no level sees more than FAN of them."""
    totals = spark.range(10_000).select(F.col("id").alias("_range"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    sums = {r["_range"]: r["v"] for r in order._earlier(totals, ["v"], 10_000).collect()}
    last = {r["_range"]: r["v"] for r in order._earlier(totals, ["v"], 10_000, last=True).collect()}
    total, seen = 0, None
    for i in range(10_000):
        assert (sums[i] or 0) == total and last[i] == seen
        if i % 7 == 0:
            total, seen = total + i, i


def test_rows_in_five_hundred_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(order, "FAN", 8)
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 10).alias("v"))
    got = order.running(df, ["k"], {"s": F.col("v")}, stored=True)
    wrong = got.where(F.col("s") != F.floor(F.col("k") / 10) * 45 + (F.col("k") % 10) * (F.col("k") % 10 + 1) / 2)
    assert got.count() == 20_000 and wrong.count() == 0


@pytest.mark.parametrize("per", [10**9, 60])
def test_rank_of_text(spark, monkeypatch, per):
    monkeypatch.setattr(order, "ROWS_PER_RANGE", per)
    words = [f"w{i:04d}é" if i % 2 else f"W{i}" for i in range(700)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    got = {r["w"]: r["p"] for r in order.rank(df, ["w"], "p").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}


@pytest.mark.parametrize("per", [10**9, 50, 9])
@pytest.mark.parametrize("by", [[], ["p"]])
def test_forward_fill(spark, monkeypatch, per, by):
    monkeypatch.setattr(order, "ROWS_PER_RANGE", per)
    rng = random.Random(5)
    # one partition value holds a third of the rows, and one stretch is empty for long
    rows = [(0 if i % 3 == 0 else rng.randint(1, 5), i, None if 100 < i < 300 or rng.random() < 0.6 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "p int, o int, v double").repartition(7)
    got = {r["o"]: r["v"] for r in order.fill_forward(df, ["v"], ["o"], by).collect()}
    last = {}
    for p, o, v in rows:
        key = p if by else 0
        last[key] = v if v is not None else last.get(key)
        assert got[o] == last[key]


@pytest.mark.parametrize("limit", [10**6, 3])
def test_lookup_small_and_large(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(lookup, "HOT_SHARE", 4)
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"v{i % 11}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    table = counts.value_counts(df, ["k"]).filter("value is not null").withColumn("code", F.length("value"))
    found = lookup.freeze(table, {"k": 12})["k"]
    assert found.small == (limit > 3)
    out = lookup.join(df, F.col("k"), found, "x_")
    assert out.columns == ["k", "i", "x_code"]
    got = sorted((r["i"], r["k"], r["x_code"]) for r in out.collect())
    assert got == [(i, k, None if k is None else len(k)) for k, i in rows]


def test_values_that_turn_hot_after_the_fit(spark, monkeypatch):
    """A later batch with one value in a third of its rows: known, rare in the fit, or unknown to it."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    old = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id") % 5_000).alias("k"))
    table = counts.value_counts(old, ["k"]).withColumn("code", F.length("value"))
    found = lookup.freeze(table, {"k": 5_000})["k"]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for hot in ("v17", "new"):
            batch = spark.range(0, 30_000, 1, 6).select(
                "id", F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("v"), F.col("id") % 5_000)).alias("k")
            )
            out = lookup.join(batch, F.col("k"), found, "x_").withColumn("task", F.spark_partition_id())
            rows = out.toPandas()
            assert len(rows) == 30_000
            want = [None if k == "new" else len(k) for k in rows["k"]]
            assert [None if c != c else c for c in rows["x_code"]] == want
            per_task = rows.groupby("task").size()
            assert per_task.max() <= 2 * per_task.median()
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_top_and_mode_break_ties_by_value(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("a", 2), ("b", 1), ("c", 9), (None, 3), (None, 3), (None, 3)], "t string, n int")
    top = [(r["value"], r["n"]) for r in counts.top(counts.value_counts(df, ["t"]), 2).orderBy("rank").collect()]
    assert top == [("a", 2), ("b", 2)]
    assert counts.modes(df, ["t", "n"]) == {"t": "a", "n": 3}


def test_top_limits_rows_before_the_exchange(spark):
    df = spark.createDataFrame([("a",)], "t string")
    plan = counts.top(counts.value_counts(df, ["t"]), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_normalize_nan(spark):
    df = frame(spark, [1.0, float("nan"), None])
    assert columns.normalize_nan(df).agg(F.count("x")).first()[0] == 1


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0,)], "`a.b` double")
    assert columns.replace(df, {"a.b": columns.num("a.b") + 1}).first()[0] == 2.0


def test_f_tail():
    # critical values of the F table
    assert tail.f_upper(4.9646027, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert tail.f_upper(3.3258345, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert tail.f_upper(0.0, 3, 7) == 1.0


def _likelihood(x, lam, family):
    if family == "box_cox":
        t, jac = (np.log(x) if abs(lam) < 1e-9 else np.expm1(lam * np.log(x)) / lam), np.log(x)
    else:
        up = lambda u, p: u if abs(p) < 1e-9 else np.expm1(p * u) / p
        t, jac = np.where(x >= 0, up(np.log1p(np.abs(x)), lam), -up(np.log1p(np.abs(x)), 2 - lam)), np.sign(x) * np.log1p(np.abs(x))
    return (lam - 1) * jac.sum() - len(x) / 2 * np.log(t.var())


def test_power_fit_against_a_fine_grid(spark, monkeypatch):
    """Many columns of different shapes: six reads, and no better exponent on a fine grid."""
    rng = np.random.default_rng(7)
    table = pd.DataFrame({f"p{i}": np.exp(rng.normal(0, 0.2 + 0.1 * i, 800)) for i in range(8)})
    for i in range(8):
        table[f"q{i}"] = rng.gamma(0.5 + i, 1.0 + i, 800)
        table[f"r{i}"] = rng.normal(i - 4, 1.0 + i / 2, 800) ** 3
    df = spark.createDataFrame(table).repartition(4).cache()
    rounds = []
    whole = power._slopes
    for family, cols in (("box_cox", [c for c in table if c[0] != "r"]), ("yeo_johnson", list(table))):
        rounds.clear()
        monkeypatch.setattr(power, "_slopes", lambda x, lam, f: (rounds.append(1), whole(x, lam, f))[1])
        got = power.fit(df, cols, family)
        assert len(rounds) <= 6 * len(cols)
        for c in cols:
            x = table[c].to_numpy()
            grid = np.arange(-5, 5.0001, 0.005)
            best = grid[np.argmax([_likelihood(x, g, family) for g in grid])]
            assert got[c] == pytest.approx(best, abs=0.006), (family, c)


def test_power_fit_finds_the_exponent(spark):
    rng = random.Random(2)
    normal = [rng.gauss(6, 1) for _ in range(4000)]
    cubes = frame(spark, [max(v, 0.1) ** 3 for v in normal])
    assert power.fit(cubes, ["x"], "box_cox")["x"] == pytest.approx(1 / 3, abs=0.12)
    logs = frame(spark, [math.expm1(v / 4) for v in normal])
    assert abs(power.fit(logs, ["x"], "yeo_johnson")["x"]) < 0.25
    assert power.fit(frame(spark, [2.0, 2.0]), ["x"], "box_cox")["x"] is None
