"""Hand-worked answers on small frames: nulls, ties, constant and empty columns, unseen values."""

import math

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import encode, evaluate, features, impute, model, outliers, profile, recommend, text, transform, validate


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def by_id(df, name, key="id"):
    return {r[key]: r[name] for r in df.collect()}


def test_profile_of_the_session_table(small):
    out = {r["column"]: r for r in profile.full(small, "target").collect()}
    f1 = out["feature1"]
    assert (f1["median"], f1["q1"], f1["q3"]) == (4.0, 2.0, 5.0)
    assert f1["outlier_pct"] == pytest.approx(20.0)
    assert f1["missing_pct"] == pytest.approx(100 / 6)
    assert out["feature2"]["mean"] == pytest.approx(34.0)
    assert out["feature3"]["unique_count"] == 3
    assert out["target"]["is_target"] and not f1["is_target"]


def test_outlier_reports_need_five_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (900.0,)], "x double")
    assert profile.outliers_iqr(df).count() == 0
    assert profile.outliers_z(df).count() == 0


def test_moments_match_numpy(spark):
    values = [1.0, 2.0, 2.0, 3.0, 8.0, 13.0]
    r = profile.moments(spark.createDataFrame([(v,) for v in values], "x double")).first()
    d = np.array(values) - np.mean(values)
    assert r["skewness"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)
    assert r["kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert r["std"] == pytest.approx(np.std(values, ddof=1))


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None, i) for i in range(12)], "same double, none double, i int")
    out = {r["column"]: r for r in profile.full(df).collect()}
    assert out["same"]["normality_p"] is None and out["none"]["median"] is None
    assert features.constant_columns(df) == ["same", "none"]
    checks = {r["check"]: r["ok"] for r in validate.table(df).collect()}
    assert checks == {"not_empty": True, "min_rows": True, "min_cols": True, "no_empty_column": False}


def test_zero_mean_gives_infinite_variation(spark):
    r = profile.moments(spark.createDataFrame([(-1.0,), (1.0,)], "x double")).first()
    assert math.isinf(r["cv"])


def test_normality_of_known_moments():
    # n, skewness, kurtosis and p-value of the values 0..19 squared
    v = np.arange(20.0) ** 2
    d = v - v.mean()
    skew, kurt = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    assert 0.1 < profile.k2_p_value(20, skew, kurt) < 0.4
    assert profile.k2_p_value(8, skew, kurt) is None


def test_sentinels_and_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 9999.0, -999999.0, inf, -inf, 1e13, -2e12, None)], "x double")
    assert [r["x"] for r in outliers.sentinels(df).collect()] == [1.0] + [None] * 7
    r = outliers.sentinel_report(df).first()
    assert (r["n"], r["infinities"], r["extreme_positive"], r["extreme_negative"]) == (6, 2, 1, 1)


def test_winsorize_keeps_nulls(small):
    out = by_id(outliers.winsorize(small, ["feature1"], 0.05, 0.95), "feature1")
    assert out[2] is None and out[5] < 100 and out[1] == 2.0


def test_sequential_row_removal(spark):
    data = [(float(i), float(i)) for i in range(20)] + [(500.0, 9.0), (7.0, 400.0), (None, 3.0)]
    df = spark.createDataFrame(data, "a double, b double")
    kept = outliers.drop_rows(df, ["a", "b"])
    assert kept.count() == 20 and kept.agg(F.max("a"), F.max("b")).first() == (19.0, 19.0)


def test_imputation(small):
    assert by_id(impute.median(small, ["feature1"]), "feature1")[2] == 4.0
    assert by_id(impute.mean(small, ["feature2"]), "feature2")[3] == 34.0
    assert by_id(impute.constant(small, {"feature1": None}), "feature1")[2] == -222.0
    untouched = impute.apply(small, {"target": "mean", "feature1": "no_such"})
    assert untouched.schema["target"].dataType.simpleString() == "int"
    assert by_id(untouched, "feature1")[2] == 4.0


def test_mode_of_empty_columns(spark):
    df = spark.createDataFrame([(None, None)], "n double, t string")
    assert impute.mode(df, ["n", "t"]).first() == (0.0, "")


def test_encodings_of_the_session_table(small):
    assert by_id(encode.label(small, ["feature3"]), "feature3") == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2, 5: 0}
    means = by_id(encode.target(small, ["feature3"], "target"), "feature3")
    assert means[0] == pytest.approx(1 / 3) and means[1] == 1.0 and means[4] == 0.0
    wide = encode.onehot(small, ["feature3"])
    assert wide.columns[-3:] == ["feature3_A", "feature3_B", "feature3_C"]
    assert rows(wide, "id", "feature3_A")[:2] == [(0, 1), (1, 0)]
    bits = encode.binary(small, ["feature3"])
    assert rows(bits, "id", "feature3_binary_0", "feature3_binary_1")[4] == (4, 0, 1)
    assert by_id(encode.ordinal(small.withColumn("back", -F.col("id")), ["feature3"], ["back"]), "feature3")[0] == 0


def test_null_category_is_a_value_of_its_own(spark):
    df = spark.createDataFrame([("z",), (None,), ("a",)], "t string")
    assert [r["t"] for r in encode.label(df, ["t"]).collect()] == [2, 1, 0]
    assert encode.onehot(df, ["t"]).agg(F.sum("t_a"), F.sum("t_z")).first() == (1, 1)


def test_single_category_is_label_encoded(spark):
    df = spark.createDataFrame([("x",), ("x",)], "t string")
    assert encode.binary(df, ["t"]).columns == ["t"]


def test_rest_of_many_categories(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(15) for _ in range(15 - i)] + [(None,)], "t string")
    wide = encode.onehot(df, ["t"])
    assert len(wide.columns) == 11 and "t_Other" in wide.columns
    assert wide.agg(F.sum("t_Other")).first()[0] == 5 + 4 + 3 + 2 + 1 + 1


def test_transforms(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 3.0, None)], "x double")
    get = lambda d: [r["x"] for r in d.collect()]
    assert get(transform.log(df, ["x"]))[0] == pytest.approx(math.log1p(1))
    assert get(transform.sqrt(df, ["x"])) == [0.0, 1.0, 2.0, None]
    assert get(transform.minmax(df, ["x"])) == [0.0, 0.25, 1.0, None]
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert get(transform.minmax(same, ["x"])) == [2.0, 2.0]
    assert get(transform.standardize(same, ["x"])) == [0.0, 0.0]
    assert get(transform.box_cox(df, ["x"])) == get(transform.log1p(df, ["x"]))


def test_plain_and_shifted_logarithm(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 3.0, None)], "x double")
    get = lambda d: [r["x"] for r in d.collect()]
    assert get(transform.log(df, ["x"], shift=False)) == [-math.inf, 0.0, pytest.approx(math.log(3)), None]
    assert get(transform.log(df, ["x"])) == get(transform.log1p(df, ["x"]))
    positive = df.filter("x > 0")
    assert get(transform.log(positive, ["x"])) == get(transform.log(positive, ["x"], shift=False))


def test_given_box_cox_exponent_takes_zeros(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 8.0, None)], "x double")
    get = lambda d: [r["x"] for r in d.collect()]
    got = get(transform.box_cox(df, ["x"], lam=0.3))
    assert got[:3] == pytest.approx([(v**0.3 - 1) / 0.3 for v in (0.0, 1.0, 8.0)]) and got[3] is None
    shifted = get(transform.log1p(df, ["x"]))
    assert get(transform.box_cox(df, ["x"], lam=-0.3)) == get(transform.box_cox(df, ["x"], lam=0.0)) == shifted
    assert get(transform.box_cox(df, ["x"])) == shifted
    below = spark.createDataFrame([(-1.0,), (2.0,)], "x double")
    assert get(transform.box_cox(below, ["x"], lam=0.3)) == get(transform.log1p(below, ["x"]))


def test_quantile_position_of_flat_stretches(spark):
    values = [0.0] * 50 + [float(i) for i in range(1, 52)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = {r["x"]: r["p"] for r in transform.quantile(df.withColumn("p", F.col("x")), ["p"]).collect()}
    assert out[0.0] == 0.0 and out[51.0] == 1.0 and 0.49 < out[1.0] < 0.52


def test_recommendations_cover_every_rule(spark):
    fields = "column string, kind string, total long, missing long, missing_pct double, unique_count long, unique_ratio double, skewness double, kurtosis double, p1 double, outlier_pct double, extreme_pct double, is_normal boolean, is_ordinal boolean, is_target boolean"
    num = lambda c, **k: {"column": c, "kind": "numeric", "total": 100, "missing": 0, "missing_pct": 0.0, "unique_count": 50, "unique_ratio": 0.5, "skewness": 0.0, "kurtosis": 0.0, "p1": 1.0, "outlier_pct": 0.0, "extreme_pct": 0.0, "is_normal": False, "is_ordinal": False, "is_target": False, **k}
    table = [
        num("a", outlier_pct=20.0, extreme_pct=6.0, skewness=6.0, kurtosis=50.0),
        num("b", outlier_pct=1.0, skewness=2.0, kurtosis=9.0),
        num("price", outlier_pct=4.0, skewness=3.5, kurtosis=9.0),
        num("c", outlier_pct=4.0, skewness=2.5, kurtosis=9.0, p1=0.0),
        num("d", missing=90, missing_pct=90.0, is_normal=True),
        num("e", missing=2, missing_pct=2.0, skewness=1.2),
        num("zz", kind="categorical", missing=3, missing_pct=3.0, unique_ratio=0.03, unique_count=3),
        num("city", kind="categorical", unique_ratio=0.2, unique_count=20),
        num("t", outlier_pct=50.0, is_target=True),
    ]
    names = [f.split()[0] for f in fields.split(", ")]
    p = spark.createDataFrame([tuple(r[n] for n in names) for r in table], fields)
    pick = lambda d: {r["column"]: r["strategy"] for r in d.collect()}
    assert pick(recommend.outliers(p)) == {"a": "winsorize", "b": "keep", "price": "keep", "c": "uncertain"}
    assert pick(recommend.missing(p)) == {"d": "constant", "e": "median", "zz": "mode"}
    assert pick(recommend.encoding(p)) == {"zz": "label", "city": "target"}
    got = pick(recommend.transforms(p))
    assert (got["a"], got["b"], got["price"], got["c"]) == ("yeo_johnson", "log", "sqrt", "log1p") and "d" not in got
    # part of a word counts by default, whole words on request
    wide = p.withColumn("column", F.when(F.col("column") == "c", "width").otherwise(F.col("column")))
    assert pick(recommend.outliers(wide))["width"] == "keep"
    assert pick(recommend.outliers(wide, word_match=True))["width"] == "uncertain"


def test_numeric_text(spark):
    df = spark.createDataFrame([("1,200", "1d", " 3 ", "x"), ("3 400", "NaN", "4.5e1", None), ("7", "2", "-.5", "y")], "a string, b string, c string, d string")
    out = features.coerce_numeric(df)
    assert [r["a"] for r in out.collect()] == [1200.0, 3400.0, 7.0]
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "double", "d": "string"}


def test_vif_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = [r["vif"] for r in features.vif(df).collect()]
    np.testing.assert_allclose(got, np.diag(np.linalg.inv(np.corrcoef(x.T))), rtol=1e-8)
    twin = df.withColumn("e", F.col("b") * 2).withColumn("f", F.lit(1.0))
    out = {r["feature"]: r["vif"] for r in features.vif(twin).collect()}
    assert math.isinf(out["b"]) and math.isinf(out["e"]) and out["f"] is None and out["c"] < 2


def test_wide_and_narrow_correlations_agree(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(200, 5))], [f"c{i}" for i in range(5)])
    a = rows(features.corr_matrix(df), "a", "b", "r")
    b = rows(features.corr_matrix(df, complete=True), "a", "b", "r")
    assert [x[:2] for x in a] == [x[:2] for x in b]
    np.testing.assert_allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-9)


def test_pruning_counts_dropped_columns_too(spark):
    # b follows a, c follows b but not a closely enough: c goes although b is gone
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    b = a + 0.6 * rng.normal(size=400)
    c = b + 0.7 * rng.normal(size=400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    r = {(x["a"], x["b"]): x["r"] for x in features.corr_matrix(df).collect()}
    assert r["a", "b"] > 0.8 > r["a", "c"] and r["b", "c"] > 0.8
    assert features.filter_corr(df, "t").columns == ["a"]
    with pytest.raises(ValueError):
        features.filter_corr(df, "t", 5)


def test_csi_edge_cases(spark):
    data = [(f"2023-{m:02d}-15", float(i), 1.0, None if m > 8 else 1.0, float(i) + (1000 if m > 8 else 0)) for m in range(1, 13) for i in range(30)]
    df = spark.createDataFrame(data, "d string, x double, same double, gone double, moved double")
    got = {r["feature"]: r["csi"] for r in features.csi(df, "d", "2023M09", ["x", "same", "gone", "moved"]).collect()}
    assert got["x"] == pytest.approx(0.0) and math.isinf(got["same"]) and math.isinf(got["gone"])
    assert got["moved"] == 0.0  # nothing of the later period lies in the range of the earlier one
    clamped = {r["feature"]: r["csi"] for r in features.csi(df, "d", "2023M09", ["moved"], out_of_range="clamp").collect()}
    assert clamped["moved"] > 0.5
    with pytest.raises(ValueError):
        features.csi(df, "d", "2030M01", ["x"])


def test_iv_uses_the_two_smallest_classes(spark):
    df = spark.createDataFrame([(float(i), i % 3, 1.0) for i in range(90)], "x double, t int, same double")
    two = features.iv(df.filter("t < 2"), "t", ["x"]).first()["iv"]
    assert features.iv(df, "t", ["x", "same"]).collect()[0]["iv"] == pytest.approx(two, rel=0.2)
    assert {r["feature"]: r["iv"] for r in features.iv(df, "t").collect()}["same"] == 0.0
    assert features.iv(df.filter("t = 1"), "t", ["x"]).first()["iv"] == 0.0


def test_auc_and_curve(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1), (1, None)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()[0] == pytest.approx(3.5 / 4)
    curve = [(r["threshold"], r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()]
    assert curve == [(math.inf, 0, 0), (0.9, 0, 0.5), (0.8, 0.5, 1), (0.1, 1, 1)]
    assert evaluate.average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    r = evaluate.classification(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["specificity"]) == (0.0, 0.0, 0.0, 1.0)


def test_huber_and_mape(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 7.0)], "y double, p double")
    r = evaluate.regression(df, "y", "p", 0).first()
    assert r["huber"] == pytest.approx((0.5 + 1.35 * 3 - 0.5 * 1.35**2) / 2)
    assert r["mape"] == pytest.approx((1 + 0.3) / 2 * 100)


def test_rank_ordering_merges_equal_edges(spark):
    df = spark.createDataFrame([(i % 2, 0.1 if i < 60 else i / 100) for i in range(100)], "y int, s double")
    out = evaluate.rank_ordering(df, "y", "s").orderBy("bucket").collect()
    assert [r["bucket"] for r in out] == [1, 2, 3, 4, 5] and out[-1]["coverage"] == 100.0 and out[0]["users"] == 60


def test_keyword_labels(spark):
    words = {"clean": ["missing label", "outlier"], "train": ["model", "fit"]}
    texts = ["find the outliers", "labels that are missing", "fit a model", "nothing here", "run the full pipeline", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert by_id(text.keyword_label(df, "t", words), "label") == {
        0: "clean", 1: "clean", 2: "train", 3: "general_query", 4: "full_pipeline", 5: None, 6: "general_query",
    }


def _plain_keyword_label(low, keywords):
    """(label, hits per word, lead): keyword by keyword and word by word."""
    words = {text.singular(w) for w in re.findall(r"\w+", low)}
    found = lambda k: k in low or (bool(re.findall(r"\w+", k)) and all(text.singular(w) in words for w in re.findall(r"\w+", k)))
    hits = [sum(found(k.lower()) for k in some) for some in keywords.values()]
    best = max(range(len(hits)), key=lambda i: (hits[i], -i))
    second, n = sorted(hits, reverse=True)[1], max(1, len(low.split()))
    return list(keywords)[best] if hits[best] else "general_query", hits[best] / n, hits[best] / n - second / n


@pytest.mark.parametrize("many", [20, 1000])
def test_keywords_against_a_plain_loop(spark, many):
    rng = random.Random(many)
    parts = ["".join(rng.choice("abcdeis") for _ in range(rng.randint(1, 5))) for _ in range(400)] + ["été", "naïve", "data_set"]
    draw = lambda: rng.choice(parts) + rng.choice(["", "", "s", "es"])
    keywords = {f"l{i}": [" ".join(draw() for _ in range(rng.choice([1, 1, 1, 2, 3]))) for _ in range(many // 10)] for i in range(10)}
    keywords["l0"] += ["it's", "a'b \\", "(x)", "c++"]
    keywords["l1"].append(keywords["l2"][0])
    texts = [" ".join(rng.choice([draw(), draw().upper() + ",", "it's", "(x)", "c++"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += ["-", "x" * 5000 + " " + keywords["l3"][0] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r for r in text.keyword_label(df, "t", keywords, overrides={}).collect()}
    for i, t in enumerate(texts):
        label, score, margin = _plain_keyword_label(t.lower(), keywords)
        assert got[i]["label"] == label
        assert (got[i]["label_score"], got[i]["label_margin"]) == pytest.approx((score, margin))


def test_weighted_labels(spark):
    patterns = {"use_existing": "current", "create_new": "new model", "educational": "method"}
    texts = ["build a table of deciles", "a new model", "what are different methods", "create a new table", "skip it"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = text.weighted_label(df, "t", patterns)
    assert by_id(got, "label") == {0: "use_existing", 1: "create_new", 2: "educational", 3: "create_new", 4: "use_existing"}
    assert by_id(got, "label_score")[2] == 1 + 8


def test_prototypes_and_thresholds(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.0, 2.0], "y"), (2, [1.0, 1.0], None), (3, [0.0, 0.0], None), (4, None, None)], "id int, v array<double>, l string")
    named = text.prototypes(df, "v", "l")
    assert named == {"x": [1.0, 0.0], "y": [0.0, 2.0]}
    out = text.prototype_label(df, "v", named)
    assert by_id(out, "accepted") == {0: True, 1: True, 2: False, 3: False, 4: False}
    assert by_id(out, "best_label")[1] == "y"
    assert text.thresholds("critical_routing", (0.5, -1.0)) == (0.7, 0.03)


def test_many_prototypes(spark, monkeypatch):
    """A hundred thousand prototypes in several tiles; equal ones go to the label named first."""
    rng = np.random.default_rng(11)
    lines = rng.normal(size=(100_000, 8))
    lines[70_000] = lines[5]
    lines[99_999] = 3 * lines[6]
    x = np.concatenate([lines[[5, 6, 50_000]], rng.normal(size=(40, 8)), np.zeros((1, 8))])
    monkeypatch.setattr(text, "TILE_BYTES", 8 * 8 * 30_000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] * 8)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    got = {r["id"]: r for r in text.prototype_label(df, "v", {f"p{i}": v.tolist() for i, v in enumerate(lines)}).collect()}
    unit = lines / np.linalg.norm(lines, axis=1)[:, None]
    for i, v in enumerate(x[:-1]):
        s = np.sort(unit @ v / np.linalg.norm(v))[::-1]
        assert (got[i]["best_score"], got[i]["second_score"]) == pytest.approx((s[0], s[1]))
    assert [got[i]["best_label"] for i in (0, 1, 2)] == ["p5", "p6", "p50000"]
    assert got[len(x) - 1]["best_label"] == "p0" and got[len(x) - 1]["best_score"] == 0
    assert all(got[i]["best_label"] is None and not got[i]["accepted"] for i in (900, 901, 902))


def test_importances_sum_to_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, r), int(r[1] > 0)) for r in x], "a double, b double, c double, t int")
    out = {r["feature"]: r["score"] for r in features.importance(df, "t", trees=5).collect()}
    assert sum(out.values()) == pytest.approx(1.0) and max(out, key=out.get) == "b"
    kept = features.rfe(df, "t", n=1).filter("kept").first()["feature"]
    assert kept == "b"


def test_lasso_reads_the_data_once(spark):
    """The cross products of all folds are one pass; the folds pick a strength between the ends of the list."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 8))
    y = x[:, 0] * 0.5 + rng.normal(size=400)
    cols = [f"x{i}" for i in range(8)]
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"id long, {', '.join(c + ' double' for c in cols)}, y double").repartition(4)
    seen = []
    for strengths in ([0.0001, 0.05, 2.0], [0.05]):
        spark.sparkContext.setJobGroup(f"lasso{len(strengths)}", "lasso")
        got = {r["feature"]: r["score"] for r in features.lasso(df, "y", cols, strengths=strengths, fold="id").collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"lasso{len(strengths)}")
        spark.sparkContext._jsc.clearJobGroup()
        assert len(jobs) <= 8  # the head of the table, one pass with its sums, and the result
        seen.append(got)
    assert seen[0] == pytest.approx(seen[1])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    b, c, g = np.zeros(8), z.T @ (y - y.mean()) / 400, z.T @ z / 400
    for _ in range(500):
        for j in range(8):
            rest = c[j] - g[j] @ b + g[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - 0.05 * y.std(), 0) / g[j, j]
    assert [seen[0][k] for k in cols] == pytest.approx(np.abs(b), abs=1e-9)


def test_lasso_and_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, r), float(3 * r[0])) for r in x], "a double, b double, c double, t double")
    out = {r["feature"]: r["score"] for r in features.lasso(df, "t").collect()}
    assert out["a"] > 1 and out["b"] < 0.1
    parts = features.pca(df.drop("t"))
    assert parts.agg(F.max("cumulative")).first()[0] == pytest.approx(1.0, abs=0.06)


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(7)
    data = [(float(v), "yes" if v > 0 else "no") for v in rng.normal(size=200)] + [(None, "no")]
    df = spark.createDataFrame(data, "x double, t string")
    fitted = model.train(df, "t", "dt")
    path = model.save(fitted, str(tmp_path), "r1", "tree")
    assert model.newest(spark, str(tmp_path), "r1").endswith("/r1/tree")
    a = rows(model.score(fitted, df.na.drop()), "x", "predictions", "predictions_probability")
    assert a == rows(model.score(model.load(spark, path), df.na.drop()), "x", "predictions", "predictions_probability")
    assert all((p > 0.5) == (lab == "yes") for _, lab, p in a)
    rules = model.tree_rules(fitted, ["x"]).orderBy("node").collect()
    assert rules[0]["depth"] == 0 and rules[0]["share"] == 1.0 and abs(rules[0]["threshold"]) < 0.3
    # scoring needs no target column
    assert "predictions" in model.score(fitted, df.drop("t")).columns


def test_split_is_stable(spark):
    df = spark.range(2000)
    a = {r["id"]: r["split"] for r in model.split(df, ["id"]).collect()}
    b = {r["id"]: r["split"] for r in model.split(df.repartition(13), ["id"]).collect()}
    assert a == b and 0.15 < sum(v == "test" for v in a.values()) / 2000 < 0.25


def test_cross_products_of_many_columns_are_two_passes(spark):
    k = 200
    cols = [F.when(F.col("id") % (i + 5) != 0, F.sin(F.col("id") * (i + 1))).alias(f"c{i}") for i in range(k - 1)]
    df = spark.range(400, numPartitions=3).select(*cols, F.lit(0.1).alias(f"c{k - 1}"))
    sc = spark.sparkContext
    sc.setJobGroup("cross", "correlations")
    got = features.corr_matrix(df, df.columns)
    jobs = len(sc.statusTracker().getJobIdsForGroup("cross"))
    sc.setJobGroup("other", "")
    assert jobs <= 3  # means (a pass, and its one-row result) and cross products
    pdf = df.toPandas()
    want = pdf.corr().abs()
    for r in got.sample(0.02, 1).collect():
        if r["b"] == f"c{k - 1}":
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-9)


def test_positive_class_of_text_labels(spark):
    rows = [("no", "no")] * 5 + [("yes", "yes")] * 3 + [("yes", "no")] * 1 + [("no", "yes")] * 1
    df = spark.createDataFrame(rows, "y string, p string")
    got = evaluate.classification(df, "y", "p").first()
    assert (got["precision"], got["recall"], got["averaging"]) == (0.75, 0.75, "binary")
    assert got["specificity"] == pytest.approx(5 / 6)
    other = evaluate.classification(df, "y", "p", positive="no").first()
    assert other["recall"] == pytest.approx(5 / 6) and other["specificity"] == 0.75


def test_equal_rows_are_learned_from_once(spark, monkeypatch):
    """The estimators read the different rows with their counts, and learn the same as from all rows."""
    table = [(float(i % 3 == 0), float(i % 2), "ab"[(i % 3 == 0) ^ (i % 7 == 0)]) for i in range(4000)]
    df = spark.createDataFrame(table, "x double, z double, y string")
    seen, whole = {}, model._merged

    def watched(data, cols, vector, name):
        out, weight = whole(data, cols, vector, name)
        seen[name] = out.count(), weight and out.agg(F.sum(weight), F.max(weight)).first()
        return out, weight

    monkeypatch.setattr(model, "_merged", watched)
    monkeypatch.setattr(model, "BAG_UNITS", 500)
    merged = model.train(df, "y", "lr", features=["x", "z"]).stages[-2]
    trees = model.score(model.train(df, "y", "rf", features=["x", "z"], numTrees=5), df)
    assert seen["lr"][0] == 8 and seen["lr"][1][0] == 4000
    assert 500 <= seen["rf"][0] <= 508 and tuple(seen["rf"][1]) == (4000, 8)
    assert trees.filter("predictions = y").count() == sum((x > 0) == (y == "b") for x, _, y in table)
    monkeypatch.setattr(model, "MERGE_AT", 10_000)
    plain = model.train(df, "y", "lr", features=["x", "z"]).stages[-2]
    assert seen["lr"] == (4000, None)
    assert merged.coefficients.toArray() == pytest.approx(plain.coefficients.toArray(), abs=1e-4)
    assert merged.intercept == pytest.approx(plain.intercept, abs=1e-4)
