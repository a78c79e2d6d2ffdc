"""Plans: fit on one table, apply to another, store and read back, batch and stream."""

import datetime
import glob
import time

import pytest
from pyspark.sql import functions as F

from sparkprep import session
from sparkprep.catalog import plan_queries, stream_queries
from sparkprep.functions import lookup
from sparkprep.plans.ledger import Ledger
from sparkprep.plans.plan import Plan, apply_phase, fit_phase
from sparkprep.plans.prep import Prep, fast
from sparkprep.sources import files, stages
from sparkprep.streaming import stability

CHOSEN = {
    "sentinels": {"x": "null"},
    "outliers": {"x": "winsorize"},
    "missing": {"x": "median", "t": "mode"},
    "encoding": {"t": "label", "u": "target", "w": "onehot", "v": "binary"},
    "transformations": {"x": "quantile"},
}


def train(spark):
    rows = [(float(i) if i % 5 else None, "abc"[i % 3], "pq"[i % 2], "mn"[i % 2], "wxyz"[i % 4], i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "x double, t string, u string, w string, v string, y int")


def fit(df):
    plan = Plan()
    for phase, strategies in CHOSEN.items():
        steps = fit_phase(df, phase, strategies, "y")
        plan.steps += steps
        df = apply_phase(df, phase, steps)
    return plan, df


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("limit", [10**6, 1])
def test_fit_apply_save_read(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
    df = train(spark)
    plan, once = fit(df)
    assert same(once, plan.transform(df))
    plan.save(spark, str(tmp_path / "plan"))
    again = Plan.read(spark, str(tmp_path / "plan"))
    assert same(once, again.transform(df))
    assert [s.strategy for s in again.steps] == [s.strategy for s in plan.steps]


def test_unseen_and_missing_values(spark):
    plan, _ = fit(train(spark))
    new = spark.createDataFrame([(None, "zzz", None, "zzz", "zzz", 0)], "x double, t string, u string, w string, v string, y int")
    r = plan.transform(new).first()
    assert r["t"] is None and r["u"] == pytest.approx(0.5) and r["w_m"] == 0 and 0 <= r["x"] <= 1


def test_transform_starts_no_job(spark):
    plan, _ = fit(train(spark))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quiet", "transform")
    plan.transform(train(spark))
    assert len(tracker.getJobIdsForGroup("quiet")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_treatments_are_projections(spark):
    plan = Plan(fit(train(spark))[0].of("missing") + fit(train(spark))[0].of("transformations"))
    text = plan.transform(train(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_prep_protects_the_target(spark):
    df = train(spark).withColumn("y", F.when(F.rand(1) < 0.9, F.col("y")))
    plan, out = Prep("y", overrides={"outliers": {"x": "null_iqr"}}).fit_transform(df)
    assert all(s.column != "y" for s in plan.steps)
    assert out.filter("y is null").count() == df.filter("y is null").count()
    assert ("outliers", "x", "null_iqr") in [(s.phase, s.column, s.strategy) for s in plan.steps]


def test_durable_phases_give_the_same(spark):
    df = train(spark)
    a, b = (Prep("y", write_between=w).fit_transform(df)[1] for w in (False, True))
    assert same(a, b)


def test_fast_keeps_informative_features(spark):
    rows = [(float(i % 7), float(i), 3.0, i % 2) for i in range(200)]
    rows = [(a, b + 100 * y + (b % 3), c, y) for a, b, c, y in rows]
    done = fast(spark.createDataFrame(rows, "noise double, signal double, same double, y int"), "y")
    assert "signal" in done.table.columns and "same" not in done.table.columns
    assert [r["step"] for r in done.ledger.to_df(spark).orderBy("position").collect()] == ["drop_constant", "numeric_only", "iv"]


def test_ledger_reverts(spark):
    ledger = Ledger(["a", "b", "c", "y"])
    ledger.add("iv", {"threshold": 0.02}, ["a", "y"])
    assert ledger.to_df(spark).first()["total_reduction_pct"] == 50.0
    assert ledger.revert() == ["a", "b", "c", "y"] and ledger.to_df(spark).count() == 0


def test_stream_equals_batch(spark):
    folder = "/root/testdata/sf0.001"
    stream = stream_queries.stream_apply_plan(spark, folder)
    assert same(stream, plan_queries.apply_plan(spark, folder))


def test_stability_on_a_stream_with_late_rows(spark, tmp_path):
    """Batches change the index of open windows; what comes after the watermark does not, and files follow the windows."""
    day = lambda d, h=1: datetime.datetime(2024, 1, d, h)
    early = spark.createDataFrame([(day(1), float(i % 10), float(i)) for i in range(100)], "ts timestamp, a double, b double")
    base = stability.baseline(early, ["a", "b"], 5)
    batches = [
        [(day(2), 1.0, 5.0), (day(2, 5), 8.0, None), (day(3), 2.0, 7.0)],
        [(day(2, 9), 3.0, 60.0), (day(9), 4.0, 70.0)],  # day 2 is still open, then day 9 moves the watermark past it
        [(day(9, 2), 5.0, 1.0), (day(10), 0.0, 3.0)],
        [(day(2, 3), 9.0, 99.0), (day(10, 2), 6.0, 2.0)],  # the first row is too late
    ]
    for i, rows in enumerate(batches):
        part = str(tmp_path / f"in/b{i}")
        spark.createDataFrame(rows, early.schema).coalesce(1).write.parquet(part)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(early.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stability.csi_stream(stream, base, "ts", out, str(tmp_path / "checkpoint"), late="1 day").awaitTermination()
    got = {(r["window_start"].day, r["feature"]): r["csi"] for r in stability.latest(spark, out).collect()}
    on_time = [r for rows in batches for r in rows if r[0] != day(2, 3)]
    want = {(r["window_start"].day, r["feature"]): r["csi"] for r in stability.csi_windows(spark.createDataFrame(on_time, early.schema), base, "ts").collect()}
    assert got == pytest.approx(want) and len(got) == 8
    assert len(glob.glob(f"{out}/window_start=*/feature=*/*.parquet")) == 8


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", comma', 2.5), (2, None, float("nan"))], "i int, t string, d double")
    for fmt in ("csv", "tsv", "json", "parquet", "orc"):
        path = str(tmp_path / fmt)
        files.write(df, path, fmt)
        back = files.read(spark, path, fmt, schema=df.schema, multiline=False).orderBy("i").collect()
        assert [tuple(r) for r in back] == [(1, 'a "quoted", comma', 2.5), (2, None, None)], fmt
    with pytest.raises(ValueError):
        files.read(spark, "x", "excel")


def test_sniff(spark, tmp_path):
    samples = {"a.csv": "x", "b.tsv": "x", "c.json": "x", "d.dat": "a,b\n1,2\n3,4", "e.dat": "a\tb\n1\t2\n3\t4", "f.dat": ' {"a": 1}', "g.dat": "plain"}
    for name, body in samples.items():
        (tmp_path / name).write_text(body)
    got = {r["path"].rsplit("/", 1)[1]: r["fmt"] for r in files.sniff(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "csv", "b.tsv": "tsv", "c.json": "json", "d.dat": "csv", "e.dat": "tsv", "f.dat": "json", "g.dat": "csv"}


def test_encodings_of_text_files(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name\ncafé\n".encode("latin-1"))
    assert files.read(spark, str(tmp_path / "l.csv"), encoding="latin-1").first()["name"] == "café"
    assert files.read(spark, str(tmp_path / "l.csv"), encoding="auto", multiline=False).first()["name"] == "café"
    (tmp_path / "w.csv").write_bytes("name\n5 € –\n".encode("cp1252"))
    assert files.read(spark, str(tmp_path / "w.csv"), encoding="cp1252").first()["name"] == "5 € –"


def test_stages(spark, tmp_path):
    df = spark.range(3)
    assert stages.save(df, str(tmp_path), "r", "raw").count() == stages.load(spark, str(tmp_path), "r", "raw").count() == 3
    with pytest.raises(ValueError):
        stages.save(df, str(tmp_path), "r", "other")


def test_phases_read_their_columns_alone(spark):
    """The table between phases is stored in columns, types that parquet has not in rows."""
    df = spark.createDataFrame([(float(i), f"t{i % 3}", i % 2) for i in range(40)], "x double, t string, y int")
    _, out = Prep("y").fit_transform(df)
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())
    odd = session.written(df.withColumn("none", F.lit(None)))
    assert odd.columns == ["x", "t", "y", "none"] and odd.count() == 40
