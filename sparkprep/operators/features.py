"""Feature cleaning, scores and filters. Scores are frames (feature, score); filters are projections."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import agg, bins, counts
from ..functions.agg import count_if
from ..functions.columns import categorical, kind, num, numeric, ref, replace

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _scores(df: DataFrame, rows: list[tuple[str, float | None]], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, f"feature string, {name} double")


def _keep(df: DataFrame, names: set[str], target: str) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns if c in names or c == target])


# ---- cleaning ---------------------------------------------------------------------------------------


def constant_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value: smallest equals largest, no distinct count needed."""
    cols = [f.name for f in df.schema.fields if f.name not in (exclude or []) and not isinstance(f.dataType, T.MapType)]
    got = agg.fit(df, {c: F.min(ref(c)).eqNullSafe(F.max(ref(c))) for c in cols})
    return [c for c in cols if got[c]]


def drop_constant(df: DataFrame, target: str) -> DataFrame:
    return df.drop(*constant_columns(df, [target]))


def numeric_text(df: DataFrame, cols: list[str] | None = None) -> dict[str, tuple[bool, bool]]:
    """{text column: (accepted as number, separators must be removed first)}."""
    cols = categorical(df) if cols is None else cols
    if not cols:
        return {}
    exprs = {}
    for c in cols:
        exprs[c, "rows"] = F.count(F.lit(1))
        exprs[c, "given"] = F.count(ref(c))
        exprs[c, "plain"] = F.count(_as_number(ref(c)))
        exprs[c, "clean"] = F.count(_as_number(_without_separators(ref(c))))
    got = agg.fit(df, exprs)
    out = {}
    for c in cols:
        clean = got[c, "rows"] - got[c, "plain"] > got[c, "rows"] * 0.5
        usable = got[c, "clean" if clean else "plain"]
        out[c] = (usable >= got[c, "given"] * 0.8, clean)
    return out


def _without_separators(c: Column) -> Column:
    return F.regexp_replace(c, "[, ]", "")


def _as_number(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def coerce_numeric(df: DataFrame, cols: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Text columns whose values are mostly numbers -> double; others stay as they are."""
    cols = categorical(df, exclude or []) if cols is None else cols
    found = numeric_text(df, cols)
    new = {c: _as_number(_without_separators(ref(c)) if clean else ref(c)) for c, (ok, clean) in found.items() if ok}
    return replace(df, new)


def numeric_only(df: DataFrame, target: str, coerce: bool = True) -> DataFrame:
    """Numeric and boolean columns, and the target; text is converted where it holds numbers."""
    if coerce:
        df = coerce_numeric(df, exclude=[target])
    names = {f.name for f in df.schema.fields if kind(f.dataType) in ("numeric", "boolean")}
    return _keep(df, names, target)


# ---- information value ------------------------------------------------------------------------------


def _second(df: DataFrame, target: str, first: object) -> object:
    """The smallest target value above the first: each task sends one value, however many there are."""
    t = ref(target)
    row = df.where(t > F.lit(first).cast(df.schema[target].dataType)).select(t.alias("v")).orderBy("v").first()
    return row["v"] if row else None


def _weights(df: DataFrame, target: str, cols: list[str], bins_n: int, mode: str) -> tuple[DataFrame | None, list[str]]:
    """(feature, bins): per feature the array of its quantile bins with counts, shares, weight and contribution; and who has none.

    The classes are the two smallest target values; no frame without them or without a column that has bins.
    """
    found, also = bins.edges(df, cols, bins_n, mode, also={"first": F.min(ref(target))})
    edge = {c: e for c, e in found.items() if len(e) > 1}
    first = also.get("first")
    second = None if first is None or not edge else _second(df, target, first)
    if second is None:
        return None, cols
    classes = [F.col("_y") == F.lit(v).cast(df.schema[target].dataType) for v in (first, second)]
    melted = bins.melt(df, edge, {"_y": ref(target)})
    counted = lambda here: [count_if(here).alias("rows"), *[count_if(here & y).alias(f"n{k}") for k, y in enumerate(classes)]]
    if bins_n <= 8:  # one row of counts per feature and task, so one shuffle
        every = F.array(*[F.struct(F.lit(i).alias("bin"), *counted(F.col("bin") == i)) for i in range(bins_n)])
        wide = melted.groupBy("feature").agg(F.filter(every, lambda b: b["rows"] > 0).alias("_bins"))
    else:
        per_bin = melted.groupBy("feature", "bin").agg(*counted(F.lit(True)))
        wide = per_bin.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "rows", "n0", "n1"))).alias("_bins"))  # bins_n at most
    summed = lambda name: F.aggregate("_bins", F.lit(0).cast("long"), lambda s, b: s + b[name]).cast("double")
    total = [summed("n0"), summed("n1")]
    shares = F.transform("_bins", lambda b: F.struct(b["bin"].alias("bin"), b["n0"].alias("n0"), b["n1"].alias("n1"), *[
        F.try_divide(b[f"n{k}"].cast("double"), t).alias(f"share{k}") for k, t in enumerate(total)
    ]))
    both = lambda b: (b["share0"] > 0) & (b["share1"] > 0)
    weighed = F.transform(shares, lambda b: b.withField("woe", F.when(both(b), F.ln(F.try_divide(b["share1"], b["share0"])))))
    weighed = F.transform(weighed, lambda b: b.withField("contribution", (b["share1"] - b["share0"]) * b["woe"]))
    return wide.select("feature", weighed.alias("bins")), [c for c in cols if c not in edge]


def woe(df: DataFrame, target: str, cols: list[str] | None = None, bins_n: int = 5, mode: str = "exact") -> DataFrame:
    """(feature, bin, n0, n1, share0, share1, woe, contribution) per quantile bin."""
    found, _ = _weights(df, target, numeric(df, exclude=[target]) if cols is None else cols, bins_n, mode)
    if found is None:
        schema = "feature string, bin int, n0 bigint, n1 bigint, share0 double, share1 double, woe double, contribution double"
        return df.sparkSession.createDataFrame([], schema)
    return found.select("feature", F.inline("bins"))


def iv(df: DataFrame, target: str, cols: list[str] | None = None, bins_n: int = 5, mode: str = "exact") -> DataFrame:
    """(feature, iv); 0 for a feature that cannot be binned."""
    cols = numeric(df, exclude=[target]) if cols is None else cols
    found, without = _weights(df, target, cols, bins_n, mode)
    none = df.sparkSession.createDataFrame([(c, 0.0) for c in without], "feature string, iv double")
    if found is None:
        return none
    summed = F.aggregate("bins", F.lit(0.0), lambda s, b: s + F.coalesce(b["contribution"], F.lit(0.0)))
    scored = found.select("feature", F.abs(summed).alias("iv"))
    return scored.union(none) if without else scored


def _values(scores: DataFrame, name: str) -> dict[str, float]:
    """A score table on the driver: one row per feature."""
    return {r["feature"]: r[name] for r in scores.collect()}


def filter_iv(df: DataFrame, target: str, threshold: float = 0.02, cols: list[str] | None = None) -> DataFrame:
    """Features whose information value reaches the threshold, and the target."""
    got = _values(iv(df, target, cols), "iv")
    return _keep(df, {c for c, v in got.items() if v >= threshold}, target)


# ---- correlation ------------------------------------------------------------------------------------


def corr_matrix(df: DataFrame, cols: list[str] | None = None, complete: bool = False) -> DataFrame:
    """(a, b, r): absolute Pearson correlation of every pair, a before b in column order, over rows with both.

    ``complete`` uses rows without any null and one pass over vectors, which suits wide tables.
    """
    cols = numeric(df) if cols is None else cols
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if complete:
        m = _vector_corr(df.select(*[num(c).alias(f"_x{i}") for i, c in enumerate(cols)]).dropna(), len(cols))
        rows = [(cols[i], cols[j], None if math.isnan(m[i, j]) else abs(float(m[i, j]))) for i, j in pairs]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    if len(pairs) <= agg.CHUNK:  # few pairs are one plain aggregate
        clean = [F.nanvl(num(c), F.lit(None).cast("double")) for c in cols]
        got = agg.fit(df, {(i, j): agg.corr(clean[i], clean[j]) for i, j in pairs})
        rows = [(cols[i], cols[j], None if got[i, j] is None or math.isnan(got[i, j]) else min(1.0, abs(got[i, j]))) for i, j in pairs]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    m = _pairwise_corr(*_cross(df, {c: num(c) for c in cols}))
    rows = [(cols[i], cols[j], None if math.isnan(m[i, j]) else min(1.0, abs(float(m[i, j])))) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def _cross(df: DataFrame, values: dict[str, Column], center: bool = True) -> tuple[np.ndarray, ...]:
    """(n, x, xx, xy): for every pair of columns the rows with both, the first's sum and sum of squares, and the sum of products.

    Two jobs for any number of columns: the means, then one pass over vectors of masks, centered values and squares, whose
    cross products hold all pairs. The driver gets a matrix of three times the number of columns.
    """
    cols, k = list(values), len(values)
    x = [v.cast("double") for v in values.values()]
    means = list(df.agg(*[F.avg(F.nanvl(v, F.lit(None))).alias(f"m{i}") for i, v in enumerate(x)]).first()) if center else [0.0] * k
    there = [v.isNotNull() & ~F.isnan(v) for v in x]
    gap = [F.when(t, v - F.lit(m or 0.0)).otherwise(F.lit(0.0)) for t, v, m in zip(there, x, means)]
    slim = df.select(*[t.cast("double").alias(f"_m{i}") for i, t in enumerate(there)], *[g.alias(f"_x{i}") for i, g in enumerate(gap)])
    slim = slim.select("*", *[(F.col(f"_x{i}") * F.col(f"_x{i}")).alias(f"_s{i}") for i in range(k)])
    vec = VectorAssembler(inputCols=[f"_{p}{i}" for p in "mxs" for i in range(k)], outputCol="_v").transform(slim).select("_v")
    g = RowMatrix(MLUtils.convertVectorColumnsFromML(vec, "_v"), 0, 3 * k).computeGramianMatrix().toArray().copy()
    m, x, s = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
    # what rounding leaves of a constant after centering is no variation
    still = [k + i for i in range(k) if center and g[k + i, k + i] <= 1e-20 * g[i, i] * (means[i] or 0.0) ** 2]
    for i in [*still, *(i + k for i in still)]:
        g[i, :] = g[:, i] = 0.0
    return g[m, m], g[x, m], g[s, m], g[x, x]


def _few_products(df: DataFrame, cols: list[str], center: bool) -> np.ndarray:
    """The sums of products of ``_cross`` as one plain aggregate, after the means."""
    x = [F.nanvl(num(c), F.lit(None).cast("double")) for c in cols]
    means = agg.fit(df, {i: F.avg(v) for i, v in enumerate(x)}) if center else {}
    moved = [v - F.lit(means.get(i) or 0.0) for i, v in enumerate(x)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = agg.fit(df, {(i, j): F.sum(moved[i] * moved[j]) for i, j in pairs} | {"n": F.count(F.lit(1))})
    m = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        m[i, j] = m[j, i] = got[i, j] or 0.0
    # what rounding leaves of a constant after centering is no variation
    still = [i for i in range(len(cols)) if center and m[i, i] <= 1e-20 * got["n"] * (means[i] or 0.0) ** 2]
    m[still, :] = m[:, still] = 0.0
    return m


def _pairwise_corr(n: np.ndarray, x: np.ndarray, xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Correlations over the rows with both values; NaN where a side does not vary there."""
    left = n * xx - x * x
    still = left <= 1e-12 * np.maximum(n * xx, np.diag(xx)[:, None] * 1e-6)
    left = np.where(still, np.nan, left)
    with np.errstate(invalid="ignore"):
        return (n * xy - x * x.T) / np.sqrt(left * left.T)


def _vector_corr(df: DataFrame, k: int) -> np.ndarray:
    vec = VectorAssembler(inputCols=[f"_x{i}" for i in range(k)], outputCol="_f").transform(df)
    return Correlation.corr(vec, "_f").first()[0].toArray()


def correlated(df: DataFrame, target: str, threshold: float = 0.8, cols: list[str] | None = None) -> list[str]:
    """Columns that correlate with an earlier column at the threshold or above."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    cols = numeric(df, exclude=[target]) if cols is None else cols
    if len(cols) < 2:
        return []
    hit = corr_matrix(df, cols).filter(F.col("r") >= threshold).select("b").distinct()
    return [r["b"] for r in hit.collect()]


def filter_corr(df: DataFrame, target: str, threshold: float = 0.8, cols: list[str] | None = None) -> DataFrame:
    return df.drop(*correlated(df, target, threshold, cols))


def top_pairs(df: DataFrame, cols: list[str] | None = None, n: int = 10) -> DataFrame:
    """The n most correlated pairs."""
    return corr_matrix(df, cols).orderBy(F.desc_nulls_last("r"), "a", "b").limit(n)


def rank_by_target(df: DataFrame, target: str, n: int = 10, cols: list[str] | None = None) -> DataFrame:
    """(feature, r): the n features with the highest absolute correlation with the target."""
    cols = numeric(df, exclude=[target]) if cols is None else cols
    table = agg.long(df, {c: {"r": agg.corr(num(c), num(target))} for c in cols}, "feature")
    r = F.abs(F.coalesce(F.nanvl(F.col("r"), F.lit(None)), F.lit(0.0)))
    return table.select("feature", r.alias("r")).orderBy(F.desc("r"), "feature").limit(n)


# ---- variance inflation -----------------------------------------------------------------------------


def _inflation(m: np.ndarray) -> list[float]:
    """1 / (1 - R^2) of every variable on the others from their (scaled) cross products."""
    k = len(m)
    if k == 1:
        return [1.0]
    if np.linalg.cond(m) < 1e12:
        return [float(v) for v in np.diag(np.linalg.inv(m)) * np.diag(m)]
    out = []
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        if m[i, i] <= 0:
            out.append(float("nan"))
            continue
        left = 1 - m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)], rcond=1e-10) @ m[rest, i] / m[i, i]
        out.append(float("inf") if left < 1e-10 else float(1 / left))
    return out


def vif(df: DataFrame, cols: list[str] | None = None, center: bool = True) -> DataFrame:
    """(feature, vif). Centered: nulls filled with the mean. Raw: nulls filled with zero, no intercept.

    The cross products come from one pass (see ``_cross``); only the k x k matrix is solved on the driver. A constant feature has no inflation: null.
    """
    cols = numeric(df) if cols is None else cols
    k = len(cols)
    # a gap is the mean, or zero where nothing is centered: it adds nothing to a product
    few = k * (k + 1) // 2 <= agg.CHUNK
    m = _few_products(df, cols, center) if few else np.array(_cross(df, {c: num(c) for c in cols}, center)[3])
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.sqrt(np.diag(m))
        m = m / np.outer(d, d)
    if center:
        m[np.arange(k), np.arange(k)] = 1.0
    dead = [i for i in range(k) if k > 1 and np.isnan(np.delete(m[i], i)).all()]
    live = [i for i in range(k) if i not in dead]
    found = dict(zip(live, _inflation(m[np.ix_(live, live)]))) if live else {}
    return _scores(df, [(c, found.get(i)) for i, c in enumerate(cols)], "vif")


def filter_vif(df: DataFrame, target: str, threshold: float = 5.0, cols: list[str] | None = None) -> DataFrame:
    """Drop every feature above the threshold at once."""
    cols = numeric(df, exclude=[target]) if cols is None else cols
    got = _values(vif(df, cols), "vif")
    return df.drop(*[c for c, v in got.items() if v is not None and v > threshold])


# ---- stability over time ----------------------------------------------------------------------------


def month_start(oot: str) -> datetime:
    """First moment of the out-of-time period: 2023M09 or a date."""
    if "M" in oot:
        year, month = oot.split("M")
        return datetime(int(year), int(month), 1)
    return datetime.fromisoformat(oot)


def _late(df: DataFrame, ts: str, oot: str) -> Column:
    t = ref(ts) if kind(df.schema[ts].dataType) == "datetime" else F.try_to_timestamp(ref(ts))
    return t >= F.lit(month_start(oot).isoformat(sep=" ")).cast("timestamp_ntz").cast(
        "timestamp_ntz" if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else "timestamp"
    )


def csi_edges(df: DataFrame, ts: str, oot: str, cols: list[str], n: int = 10, mode: str = "exact") -> dict[str, list[float]]:
    """Decile edges of the development period."""
    return bins.edges(df.filter(~_late(df, ts, oot)), cols, n, mode)[0]


def stability(shares: DataFrame, dev: str = "dev", oot: str = "oot", by: list[str] | None = None) -> DataFrame:
    """Adds shares of two counted distributions per feature and their contribution to the index."""
    whole = Window.partitionBy(*(by or []), "feature")  # a few bins per feature
    s_dev = F.try_divide(F.col(dev).cast("double"), F.sum(dev).over(whole).cast("double"))
    s_oot = F.try_divide(F.col(oot).cast("double"), F.sum(oot).over(whole).cast("double"))
    out = shares.withColumn("dev_share", s_dev).withColumn("oot_share", s_oot)
    both = (F.col("dev_share") > 0) & (F.col("oot_share") > 0)
    gap = (F.col("oot_share") - F.col("dev_share")) * F.ln(F.try_divide("oot_share", "dev_share"))
    return out.withColumn("contribution", F.when(both, gap).otherwise(F.lit(0.0)))


def csi_bins(
    df: DataFrame,
    ts: str,
    oot: str,
    cols: list[str] | None = None,
    n: int = 10,
    out_of_range: str = "drop",
    mode: str = "exact",
) -> DataFrame:
    """(feature, bin, dev, oot, dev_share, oot_share, contribution); bins of the development deciles."""
    cols = numeric(df) if cols is None else cols
    edge = {c: e for c, e in csi_edges(df, ts, oot, cols, n, mode).items() if len(e) > 1}
    if not edge:
        return df.sparkSession.createDataFrame(
            [],
            "feature string, bin int, dev bigint, oot bigint, dev_share double, oot_share double, contribution double",
        )
    return _csi_bins(df, ts, oot, edge, out_of_range)


def _csi_bins(df: DataFrame, ts: str, oot: str, edge: dict[str, list[float]], out_of_range: str) -> DataFrame:
    counted = (
        bins.melt(df, edge, {"_late": _late(df, ts, oot)}, closed="left", outside=out_of_range)
        .groupBy("feature", "bin")
        .agg(count_if(~F.col("_late")).alias("dev"), count_if(F.col("_late")).alias("oot"))
    )
    return stability(counted)


def csi(
    df: DataFrame,
    ts: str,
    oot: str,
    cols: list[str] | None = None,
    n: int = 10,
    out_of_range: str = "drop",
    mode: str = "exact",
) -> DataFrame:
    """(feature, csi): shift of each feature between the periods; infinite when a side has no values."""
    cols = [c for c in (numeric(df) if cols is None else cols) if c != ts]
    late = _late(df, ts, oot)
    exprs = {("rows", s): count_if(c) for s, c in (("dev", ~late), ("oot", late))}
    exprs.update({(c, "oot"): count_if(late & ref(c).isNotNull()) for c in cols})
    sizes = agg.fit(df, exprs)
    if not sizes["rows", "dev"] or not sizes["rows", "oot"]:
        raise ValueError(f"no rows before or after {oot}")
    edge = csi_edges(df, ts, oot, cols, n, mode)
    fine = {c: e for c, e in edge.items() if len(e) > 1 and sizes[c, "oot"]}
    broken = _scores(df, [(c, float("inf")) for c in cols if c not in fine], "csi")
    if not fine:
        return broken
    table = _csi_bins(df, ts, oot, fine, out_of_range)
    return table.groupBy("feature").agg(F.sum("contribution").alias("csi")).unionByName(broken)


def filter_csi(df: DataFrame, ts: str, oot: str, threshold: float = 0.2, cols: list[str] | None = None) -> DataFrame:
    """Drop features whose index is above the threshold."""
    got = _values(csi(df, ts, oot, cols), "csi")
    return df.drop(*[c for c, v in got.items() if v > threshold])


# ---- model-based scores -----------------------------------------------------------------------------


def is_classification(df: DataFrame, target: str, max_classes: int = 10) -> bool:
    """Whole-number, text or boolean target with few distinct values."""
    dtype = df.schema[target].dataType
    if not (isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)) or kind(dtype) == "categorical"):
        return False
    return df.select(ref(target)).distinct().limit(max_classes + 1).count() <= max_classes


def _design(df: DataFrame, target: str, cols: list[str], classify: bool, keep: list[str] | None = None) -> DataFrame:
    """(_f vector, _y label, kept columns): features filled with their mean, target with its mode."""
    means = agg.fit(df, {c: F.avg(num(c)) for c in cols})
    x = [F.coalesce(num(c), F.lit(means[c] or 0.0)).alias(f"_x{i}") for i, c in enumerate(cols)]
    y = ref(target)
    if agg.fit(df, {"gaps": agg.count_if(y.isNull())})["gaps"]:
        y = F.coalesce(y, F.lit(counts.modes(df, [target])[target]).cast(df.schema[target].dataType))
    y = y.cast("string") if classify else y.cast("double")
    out = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="_f").transform(
        df.select(*x, y.alias("_t"), *(keep or []))
    )
    if classify:
        indexer = StringIndexer(inputCol="_t", outputCol="_y", stringOrderType="alphabetAsc")
        return indexer.fit(out).transform(out).select("_f", "_y", *(keep or []))
    return out.select("_f", F.col("_t").alias("_y"), *(keep or []))


def importance(
    df: DataFrame,
    target: str,
    cols: list[str] | None = None,
    trees: int = 100,
    depth: int = 10,
    train_share: float = 0.7,
    key: list[str] | None = None,
) -> DataFrame:
    """(feature, score): impurity importances of a random forest trained on a share of the rows.

    Gaps are filled from all rows. The rows are chosen by a hash of the key columns (default: all columns), so the same
    rows are chosen however the table is stored; rows that are equal in the key are chosen together.
    """
    cols = numeric(df, exclude=[target]) if cols is None else cols
    if len(cols) < 2:
        raise ValueError("importances need at least two features")
    classify = is_classification(df, target)
    make = RandomForestClassifier if classify else RandomForestRegressor
    spot = F.pmod(F.xxhash64(*[ref(c) for c in key or df.columns]), F.lit(10_000))
    learn = _design(df.withColumn("_learn", spot < round(train_share * 10_000)), target, cols, classify, ["_learn"])
    forest = make(featuresCol="_f", labelCol="_y", numTrees=trees, maxDepth=depth, seed=42)
    scores = forest.fit(learn.filter("_learn")).featureImportances.toArray()
    return _scores(df, [(c, float(v)) for c, v in zip(cols, scores)], "score")


def filter_scores(
    df: DataFrame,
    target: str,
    scores: DataFrame,
    top_n: int | None = None,
    min_score: float | None = None,
    name: str = "score",
) -> DataFrame:
    """Keep the scored features with the n best scores or at least the minimum; others and the target stay."""
    scored = _values(scores, name)
    if top_n is not None:
        kept = set(sorted(scored, key=lambda c: (-scored[c], c))[:top_n])
    elif min_score is not None:
        kept = {c for c, v in scored.items() if v >= min_score}
    else:
        kept = set(scored)
    return df.drop(*[c for c in scored if c not in kept and c != target])


def _fold_products(df: DataFrame, values: list[Column], fold: Column, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """((fold, 2v + 1, 2v + 1) cross products of one, the masks and the shifted values of each fold, and the shifts).

    One pass for all folds: a row is a vector that is zero outside its own fold's block, so the blocks of one matrix of
    cross products are the folds. The shifts are means of a few rows; they only keep the sums small.
    """
    v = len(values)
    there = [x.isNotNull() & ~F.isnan(x) for x in values]
    slim = df.select(*[F.when(t, x).alias(f"_x{i}") for i, (x, t) in enumerate(zip(values, there))], fold.alias("_fold"))
    near = slim.limit(1000).agg(*[F.avg(f"_x{i}") for i in range(v)]).first()
    shift = np.array([m or 0.0 for m in near])
    row = [F.lit(1.0), *[F.col(f"_x{i}").isNotNull().cast("double") for i in range(v)]]
    row += [F.coalesce(F.col(f"_x{i}") - F.lit(float(shift[i])), F.lit(0.0)) for i in range(v)]
    width = len(row)
    cells = [F.when(F.col("_fold") == f, x).otherwise(F.lit(0.0)).alias(f"c{f * width + i}") for f in range(folds) for i, x in enumerate(row)]
    vec = VectorAssembler(inputCols=[f"c{i}" for i in range(folds * width)], outputCol="_v").transform(slim.select(*cells)).select("_v")
    g = RowMatrix(MLUtils.convertVectorColumnsFromML(vec, "_v"), 0, folds * width).computeGramianMatrix().toArray()
    return np.stack([g[f * width : (f + 1) * width, f * width : (f + 1) * width] for f in range(folds)]), shift


def _descend(g: np.ndarray, c: np.ndarray, strengths: list[float], rounds: int = 10_000) -> list[np.ndarray]:
    """Coefficients of min 1/2 b'gb - c'b + strength |b|_1 for each strength, from the strongest on, each from the one before."""
    b, out = np.zeros(len(c)), {}
    for w in sorted(set(strengths), reverse=True):
        for _ in range(rounds):
            last = b.copy()
            for j in range(len(c)):
                if g[j, j] > 0:
                    rest = c[j] - g[j] @ b + g[j, j] * b[j]
                    b[j] = np.sign(rest) * max(abs(rest) - w, 0.0) / g[j, j]
            if np.abs(b - last).max(initial=0.0) <= 1e-13 * max(1e-300, np.abs(b).max(initial=0.0)):
                break
        out[w] = b.copy()
    return [out[w] for w in strengths]


def _centered(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(covariances, covariances with the target, means, mean of the target) from the products of one, features and target."""
    n = max(p[0, 0], 1.0)
    cov = p[1:, 1:] / n - np.outer(p[0, 1:], p[0, 1:]) / n**2
    return cov[:-1, :-1], cov[:-1, -1], p[0, 1:-1] / n, p[0, -1] / n


def lasso(
    df: DataFrame,
    target: str,
    cols: list[str] | None = None,
    folds: int = 5,
    strengths: list[float] | None = None,
    fold: str | None = None,
) -> DataFrame:
    """(feature, score): absolute coefficients of the cross-validated L1 regression on standardized features.

    Gaps of a feature are its mean, those of the target its mode. Strengths are shares of the target's deviation; the one
    with the least mean squared error over the folds is used on all rows, of equal ones the strongest. The fold of a row is
    the remainder of a whole-number column, or of a hash of the row. The data are read once, for the cross products of
    every fold; what trains a fold is the total minus its own, and the search works on matrices of the number of features.
    """
    cols = numeric(df, exclude=[target]) if cols is None else cols
    v = len(cols)
    spot = F.pmod(ref(fold).cast("long") if fold else F.xxhash64(*[ref(c) for c in df.columns]), F.lit(folds)).cast("int")
    products, shift = _fold_products(df, [num(c) for c in [*cols, target]], spot, folds)
    total = products.sum(0)
    n, given, sums = total[0, 0], total[0, 1 : v + 2], np.diag(total[1 : v + 2, v + 2 :])
    fill = np.divide(sums, given, out=np.zeros(v + 1), where=given > 0)
    if given[v] < n:
        mode = counts.modes(df, [target])[target]
        fill[v] = 0.0 if mode is None else float(mode) - shift[v]
    # from (one, masks, values) to (one, filled values), and then to standardized features
    filled = np.zeros((v + 2, 2 * v + 3))
    filled[0, 0] = 1.0
    for i in range(v + 1):
        filled[1 + i, [0, 1 + i, v + 2 + i]] = fill[i], -fill[i], 1.0
    products = filled @ products @ filled.T
    cov, _, means, _ = _centered(products.sum(0))
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0) * n / max(n - 1, 1))
    scale = np.eye(v + 2)
    for i in range(v):
        still = spread[i] <= 1e-12 * (abs(means[i]) + abs(shift[i]) + 1e-300)
        scale[1 + i, [0, 1 + i]] = (0.0, 0.0) if still else (-means[i] / spread[i], 1 / spread[i])
    products = scale @ products @ scale.T
    total = products.sum(0)
    deviation = math.sqrt(max(total[-1, -1] / max(n, 1) - (total[0, -1] / max(n, 1)) ** 2, 0.0)) or 1.0
    weights = sorted((deviation * s for s in strengths or (0.001, 0.01, 0.1, 0.5)), reverse=True)
    errors = np.zeros(len(weights))
    for own in products:
        g, c, x, y = _centered(total - own)
        for i, b in enumerate(_descend(g, c, weights)):
            line = np.r_[y - x @ b, b, -1.0]  # the residual of a row of (one, features, target), but for its sign
            errors[i] += line @ own @ line / max(own[0, 0], 1.0) / folds
    g, c, _, _ = _centered(total)
    best = _descend(g, c, weights)[int(np.argmin(errors))]
    return _scores(df, [(f, abs(float(w))) for f, w in zip(cols, best)], "score")


def pca(df: DataFrame, cols: list[str] | None = None, k: int | None = None, variance: float = 0.95) -> DataFrame:
    """(component, feature, loading, explained, cumulative): components up to k or to the share of variance."""
    cols = numeric(df) if cols is None else cols
    means = agg.fit(df, {c: F.avg(num(c)) for c in cols})
    x = [F.coalesce(num(c), F.lit(means[c] or 0.0)).alias(f"_x{i}") for i, c in enumerate(cols)]
    vec = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="_f").transform(df.select(*x))
    scaled = StandardScaler(inputCol="_f", outputCol="_z", withMean=True, withStd=True).fit(vec).transform(vec)
    fitted = PCA(k=k or len(cols), inputCol="_z", outputCol="_p").fit(scaled.select("_z"))
    share = fitted.explainedVariance.toArray()
    total = np.cumsum(share)
    last = len(share) if k else min(len(share), int(np.searchsorted(total, variance - 1e-12)) + 1)
    loadings = fitted.pc.toArray()
    rows = [
        (j + 1, c, float(loadings[i, j]), float(share[j]), float(total[j]))
        for j in range(last)
        for i, c in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(
        rows, "component int, feature string, loading double, explained double, cumulative double"
    )


def rfe(df: DataFrame, target: str, cols: list[str] | None = None, n: int = 5, depth: int = 5) -> DataFrame:
    """(feature, rank, kept): features dropped one by one, weakest share of a tree first; rank 1 is kept."""
    cols = list(numeric(df, exclude=[target]) if cols is None else cols)
    classify = is_classification(df, target)
    make = DecisionTreeClassifier if classify else DecisionTreeRegressor
    slim = df.select(*[ref(c) for c in cols], ref(target)).persist()
    ranks: dict[str, int] = {}
    try:
        left = list(cols)
        while len(left) > n:
            tree = make(featuresCol="_f", labelCol="_y", maxDepth=depth, seed=42)
            share = tree.fit(_design(slim, target, left, classify)).featureImportances.toArray()
            weakest = min(range(len(left)), key=lambda i: (share[i], -i))
            ranks[left.pop(weakest)] = len(left) - n + 2
    finally:
        slim.unpersist()
    rows = [(c, ranks.get(c, 1), c not in ranks) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, kept boolean")


# ---- questions about scores -------------------------------------------------------------------------


def query(scores: DataFrame, name: str = "score", top: int | None = None, gt: float | None = None) -> DataFrame:
    """Rows of a score table above a value and / or the n highest. Never re-runs an analysis."""
    out = scores if gt is None else scores.filter(F.col(name) > gt)
    return out if top is None else out.orderBy(F.desc(name), "feature").limit(top)


def query_count(scores: DataFrame, gt: float, name: str = "score") -> DataFrame:
    """(above, total) number of features above a value."""
    return scores.agg(count_if(F.col(name) > gt).alias("above"), F.count(F.lit(1)).alias("total"))


