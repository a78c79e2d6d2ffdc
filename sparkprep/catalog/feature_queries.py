"""Feature cleaning, scores and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, impute, outliers
from ..plans.ledger import Ledger
from .registry import ORACLES, cte, load, q, query, r, rounded, source, table

_FEATURES = ["quantity", "price", "discount", "revenue"]
_WITH_TARGET = [*_FEATURES, "target"]


def _binned(c: str, origin: str, n: int = 5) -> str:
    """(feature, bin, target) in (a, b] quantile bins with equal edges merged."""
    probs = ", ".join(str(i / n) for i in range(n + 1))
    return f"""SELECT '{c}' AS feature, CAST(len(list_filter(g[2:len(g) - 1], lambda e: {c} > e)) AS INTEGER) AS bin, target
    FROM {origin}, (SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS g FROM {origin}) f
    WHERE {c} IS NOT NULL"""


def _woe(cols: list[str], origin: str, n: int = 5) -> str:
    return f"""SELECT *, CASE WHEN share0 > 0 AND share1 > 0 THEN ln(share1 / share0) END AS woe,
    CASE WHEN share0 > 0 AND share1 > 0 THEN (share1 - share0) * ln(share1 / share0) END AS contribution FROM
    (SELECT feature, bin, n0, n1, n0 * 1.0 / sum(n0) OVER (PARTITION BY feature) AS share0,
     n1 * 1.0 / sum(n1) OVER (PARTITION BY feature) AS share1 FROM
     (SELECT feature, bin, count(CASE WHEN target = 0 THEN 1 END) AS n0, count(CASE WHEN target = 1 THEN 1 END) AS n1
      FROM ({" UNION ALL ".join(_binned(c, origin, n) for c in cols)}) GROUP BY feature, bin))"""


def _iv(cols: list[str], origin: str) -> str:
    return f"SELECT feature, abs(sum(contribution)) AS iv FROM ({_woe(cols, origin)}) GROUP BY feature"


def _prepared(c: str) -> str:
    """Clipped to the 1st and 99th percentile, then filled with the median of what is left."""
    clip = f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {q(c, 0.01)}), {q(c, 0.99)}) END"
    return f"coalesce({clip}, (SELECT quantile_cont({clip}, 0.5) FROM t)) AS {c}"


@query(
    "information_value",
    f"""{cte("items", _WITH_TARGET)}, u AS (SELECT {", ".join(_prepared(c) for c in _FEATURES)}, target FROM t)
    SELECT feature, {r("iv", "iv", 8)} FROM ({_iv(_FEATURES, "u")})""",
)
def information_value(spark, folder):
    df = load(spark, folder, "items", _WITH_TARGET)
    ready = impute.median_of_clipped(df, _FEATURES)
    return rounded(features.iv(ready, "target", _FEATURES), 8)


@query(
    "woe_table",
    f"""{cte("items", _WITH_TARGET)} SELECT feature, bin, n0, n1, {r("share0", "share0")}, {r("share1", "share1")}, {r("woe", "woe")},
    {r("contribution", "contribution", 8)} FROM ({_woe(_FEATURES, "t")})""",
)
def woe_table(spark, folder):
    out = features.woe(load(spark, folder, "items", _WITH_TARGET), "target", _FEATURES)
    return rounded(rounded(out, only=["share0", "share1", "woe"]), 8, ["contribution"])


_LABELLED = """SELECT value, value * value AS squared, user_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS target FROM events"""


def _decided(scores, name: str, kept, digits: int = 6):
    """(feature, score, kept): what a filter decided about each scored feature, from the columns it left."""
    out = scores.select("feature", F.col(name).cast("double").alias("score"), F.col("feature").isin(kept.columns).alias("kept"))
    return rounded(out, digits)


def _labelled(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "value", "value * value AS squared", "user_id", "CASE WHEN value > 20 THEN 1 ELSE 0 END AS target"
    )


_SCORED = ["value", "squared", "user_id"]


@query(
    "iv_filter",
    f"""WITH t AS ({_LABELLED}) SELECT feature, {r("coalesce(iv, 0)", "score")}, coalesce(iv, 0) >= 0.1 AS kept FROM
    (SELECT unnest([{", ".join(f"'{c}'" for c in _SCORED)}]) AS feature) LEFT JOIN ({_iv(_SCORED, "t")}) USING (feature)""",
)
def iv_filter(spark, folder):
    """Which features stay follows from their information value."""
    df = _labelled(spark, folder)
    return _decided(features.iv(df, "target", _SCORED), "iv", features.filter_iv(df, "target", 0.1))


_SAME = {"l_orderkey": "l_orderkey", "l_discount": "l_discount", "same": "7", "empty": "CAST(NULL AS {s})"}


@query(
    "drop_constant_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(count(DISTINCT {e.format(s='VARCHAR')}) AS DOUBLE) AS score, count(DISTINCT {e.format(s='VARCHAR')}) > 1 AS kept FROM lineitem"
        for c, e in _SAME.items()
    ),
)
def drop_constant_columns(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(*[f"{e.format(s='STRING')} AS {c}" for c, e in _SAME.items()], "1 AS target")
    many = df.agg(*[F.count_distinct(c).alias(c) for c in _SAME]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in _SAME]))
    )
    return _decided(many, "n", features.drop_constant(df, "target"))


_TEXTS = {
    "plain": "CAST(l_quantity AS {s})",
    "comma": "CAST(l_orderkey % 90 + 1 AS {s}) || ',' || lpad(CAST(l_partkey % 1000 AS {s}), 3, '0')",
    "mostly": "CASE WHEN l_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS {s}) END",
    "words": "CASE WHEN l_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS {s}) END",
}


@query(
    "coerce_numeric_strings",
    """SELECT l_orderkey, l_quantity AS plain, CAST((l_orderkey % 90 + 1) * 1000 + l_partkey % 1000 AS DOUBLE) AS comma,
    CASE WHEN l_orderkey % 10 <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS mostly,
    CASE WHEN l_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS words FROM lineitem""",
)
def coerce_numeric_strings(spark, folder):
    exprs = [f"{e.format(s='STRING')} AS {n}" for n, e in _TEXTS.items()]
    return features.coerce_numeric(table(spark, folder, "lineitem").selectExpr("l_orderkey", *exprs))


_MIXED = ["l_orderkey", "quantity", "flag", "status", "target"]


@query(
    "drop_non_numeric",
    f"WITH t AS ({source('items', _MIXED)}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, max(CASE WHEN typeof({c}) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 1.0 ELSE 0.0 END) AS score, "
        f"max(CASE WHEN typeof({c}) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 1 ELSE 0 END) = 1 AS kept FROM t"
        for c in _MIXED
    ),
)
def drop_non_numeric(spark, folder):
    """Score: 1 for a column of numbers."""
    df = load(spark, folder, "items", _MIXED)
    numbers = [(c, float(t in ("bigint", "int", "double"))) for c, t in df.dtypes]
    scores = spark.createDataFrame(numbers, "feature string, number double")
    return _decided(scores, "number", features.numeric_only(df, "target"))


# ---- correlation ------------------------------------------------------------------------------------


def _pairs(cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM t" for i, a in enumerate(cols) for b in cols[i + 1 :]
    )


@query("correlation_matrix", f"{cte('items', _FEATURES)} SELECT a, b, {r('r', 'r')} FROM ({_pairs(_FEATURES)})")
def correlation_matrix(spark, folder):
    return rounded(features.corr_matrix(load(spark, folder, "items", _FEATURES), _FEATURES))


@query(
    "correlation_matrix_wide",
    f"""WITH t AS (SELECT * FROM ({source("items", _FEATURES)}) WHERE quantity IS NOT NULL AND price IS NOT NULL)
    SELECT a, b, {r("r", "r")} FROM ({_pairs(_FEATURES)})""",
)
def correlation_matrix_wide(spark, folder):
    """Complete rows only, one pass over vectors."""
    return rounded(features.corr_matrix(load(spark, folder, "items", _FEATURES), _FEATURES, complete=True))


@query(
    "correlation_prune",
    f"""{cte("items", _WITH_TARGET)} SELECT feature, {r("max(r)", "score")}, max(r) < 0.8 AS kept FROM (
    SELECT b AS feature, r FROM ({_pairs(_FEATURES)}) UNION ALL SELECT '{_FEATURES[0]}', 0) GROUP BY 1""",
)
def correlation_prune(spark, folder):
    """Score: the largest correlation with a column that comes earlier."""
    df = load(spark, folder, "items", _WITH_TARGET)
    pairs = features.corr_matrix(df, _FEATURES).select(F.col("b").alias("feature"), "r")
    first = spark.createDataFrame([(_FEATURES[0], 0.0)], "feature string, r double")
    scores = pairs.unionByName(first).groupBy("feature").agg(F.max("r").alias("r"))
    return _decided(scores, "r", features.filter_corr(df, "target", 0.8))


@query(
    "top_correlated_pairs",
    f"{cte('items', _FEATURES)} SELECT a, b, {r('r', 'r')} FROM ({_pairs(_FEATURES)}) ORDER BY r DESC, a, b LIMIT 10",
)
def top_correlated_pairs(spark, folder):
    return rounded(features.top_pairs(load(spark, folder, "items", _FEATURES), _FEATURES))


@query(
    "target_ranking",
    f"{cte('items', _WITH_TARGET)} SELECT feature, {r('r', 'r')} FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(coalesce(corr({c}, target), 0)) AS r FROM t" for c in _FEATURES)
    + ") ORDER BY r DESC, feature LIMIT 10",
)
def target_ranking(spark, folder):
    return rounded(features.rank_by_target(load(spark, folder, "items", _WITH_TARGET), "target"))


# ---- variance inflation -----------------------------------------------------------------------------

_THREE = ["quantity", "price", "revenue"]


def _vif(cols: list[str]) -> str:
    """Diagonal of the inverse of a 3 x 3 correlation matrix."""
    return f"""SELECT 'quantity' AS feature, {r("(1 - c * c) / d", "vif", 5)} FROM k UNION ALL
    SELECT 'price', {r("(1 - b * b) / d", "vif", 5)} FROM k UNION ALL SELECT 'revenue', {r("(1 - a * a) / d", "vif", 5)} FROM k"""


_FILLED = f"""{cte("items", _THREE)}, u AS (SELECT {", ".join(f"coalesce({c}, (SELECT avg({c}) FROM t)) AS {c}" for c in _THREE)} FROM t),
    k AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM
    (SELECT corr(quantity, price) AS a, corr(quantity, revenue) AS b, corr(price, revenue) AS c FROM u))"""


@query("vif", f"{_FILLED} {_vif(_THREE)}")
def vif(spark, folder):
    return rounded(features.vif(load(spark, folder, "items", _THREE), _THREE), 5)


@query(
    "vif_raw",
    f"""{cte("items", ["quantity", "price"])}, k AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM
    (SELECT coalesce(quantity, 0) AS x, coalesce(price, 0) AS y FROM t))
    SELECT 'quantity' AS feature, {r("a * c / (a * c - b * b)", "vif")} FROM k
    UNION ALL SELECT 'price', {r("a * c / (a * c - b * b)", "vif")} FROM k""",
)
def vif_raw(spark, folder):
    return rounded(features.vif(load(spark, folder, "items", ["quantity", "price"]), ["quantity", "price"], center=False))


@query(
    "vif_filter",
    f"SELECT feature, vif AS score, vif <= 5 AS kept FROM ({ORACLES['vif']})",
)
def vif_filter(spark, folder):
    """Price and revenue explain each other, so both go."""
    df = load(spark, folder, "items", _THREE)
    return _decided(features.vif(df, _THREE), "vif", features.filter_vif(df, "target", 5.0, _THREE), 5)


# ---- stability --------------------------------------------------------------------------------------

_OOT = "2000M06"
_ORDERS = f"""SELECT orderdate, total, o_custkey, total * CASE WHEN orderdate >= '2000-06-01' THEN 0.4 ELSE 1 END AS shifted
    FROM ({source("sales", ["orderdate", "total", "o_custkey"])})"""


def _orders(spark, folder):
    return load(spark, folder, "sales", ["orderdate", "total", "o_custkey"]).selectExpr(
        "orderdate", "total", "o_custkey", "total * CASE WHEN orderdate >= '2000-06-01' THEN 0.4 ELSE 1 END AS shifted"
    )


def _csi_bins(cols: list[str], clamp: bool = False) -> str:
    """Counts and shares in [a, b) bins of the development deciles, the last closed."""
    probs = ", ".join(str(i / 10) for i in range(11))
    inside = "" if clamp else "AND {c} BETWEEN g[1] AND g[len(g)]"
    cells = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(len(list_filter(g[2:len(g) - 1], lambda e: {c} >= e)) AS INTEGER) AS bin, late FROM t,
        (SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS g FROM t WHERE NOT late) f
        WHERE {c} IS NOT NULL {inside.format(c=c)}"""
        for c in cols
    )
    return f"""WITH t AS (SELECT *, orderdate >= '2000-06-01' AS late FROM ({_ORDERS})), b AS (SELECT *,
    dev * 1.0 / sum(dev) OVER (PARTITION BY feature) AS dev_share, oot * 1.0 / sum(oot) OVER (PARTITION BY feature) AS oot_share FROM
    (SELECT feature, bin, count(CASE WHEN NOT late THEN 1 END) AS dev, count(CASE WHEN late THEN 1 END) AS oot FROM ({cells})
     GROUP BY feature, bin)), s AS (SELECT *, CASE WHEN dev_share > 0 AND oot_share > 0
     THEN (oot_share - dev_share) * ln(oot_share / dev_share) ELSE 0 END AS contribution FROM b) """


_DRIFTING = ["total", "o_custkey", "shifted"]


@query("csi", _csi_bins(_DRIFTING) + f"SELECT feature, {r('sum(contribution)', 'csi')} FROM s GROUP BY feature")
def csi(spark, folder):
    return rounded(features.csi(_orders(spark, folder), "orderdate", _OOT, _DRIFTING))


_BIN_ROW = f"feature, bin, dev, oot, {r('dev_share', 'dev_share')}, {r('oot_share', 'oot_share')}, {r('contribution', 'contribution')}"


@query("csi_bins", _csi_bins(_DRIFTING) + f"SELECT {_BIN_ROW} FROM s")
def csi_bins(spark, folder):
    return rounded(features.csi_bins(_orders(spark, folder), "orderdate", _OOT, _DRIFTING))


@query("csi_bins_clamped", _csi_bins(_DRIFTING, clamp=True) + f"SELECT {_BIN_ROW} FROM s")
def csi_bins_clamped(spark, folder):
    return rounded(features.csi_bins(_orders(spark, folder), "orderdate", _OOT, _DRIFTING, out_of_range="clamp"))


@query("csi_filter", f"SELECT feature, csi AS score, csi <= 0.2 AS kept FROM ({ORACLES['csi']})")
def csi_filter(spark, folder):
    """The shifted column moved between the periods."""
    df = _orders(spark, folder)
    return _decided(features.csi(df, "orderdate", _OOT, _DRIFTING), "csi", features.filter_csi(df, "orderdate", _OOT, 0.2, _DRIFTING))


# ---- model-based scores -----------------------------------------------------------------------------


def _r_scores(spark, folder):
    return features.rank_by_target(_labelled(spark, folder), "target", 10).withColumnRenamed("r", "score")


_R_SCORES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(coalesce(corr({c}, target), 0)) AS r FROM ({_LABELLED})" for c in ("value", "squared", "user_id")
)


@query(
    "importance_filter",
    f"SELECT feature, {r('r', 'score')}, row_number() OVER (ORDER BY r DESC, feature) <= 2 AS kept FROM ({_R_SCORES})",
)
def importance_filter(spark, folder):
    """Any score table works: here the correlation with the target."""
    df, scores = _labelled(spark, folder), _r_scores(spark, folder)
    return _decided(scores, "score", features.filter_scores(df, "target", scores, top_n=2))


@query("importance_filter_min", f"SELECT feature, {r('r', 'score')}, r >= 0.1 AS kept FROM ({_R_SCORES})")
def importance_filter_min(spark, folder):
    df, scores = _labelled(spark, folder), _r_scores(spark, folder)
    return _decided(scores, "score", features.filter_scores(df, "target", scores, min_score=0.1))


# the discount lowers what is paid, the others have no part in it
_LASSO = {
    "discount": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END", "quantity": "l_quantity", "tax": "l_tax", "line": "CAST(l_linenumber AS DOUBLE)",
    "part": "CAST(l_partkey % 97 AS DOUBLE)", "supplier": "CAST(l_suppkey % 13 AS DOUBLE)",
}
_PAID = "l_extendedprice * (1 - l_discount)"
_STRENGTHS = (0.0003, 0.003, 0.03, 0.3)


def _lasso_sql() -> str:
    """Fold sums, coordinate descent as a recursion over all folds and strengths, errors of the folds, and the choice."""
    names = list(_LASSO)
    pairs = [(a, b) for i, a in enumerate([*names, "y"]) for b in [*names, "y"][i:]]
    at = lambda a, b: f"s_{a}_{b}" if (a, b) in pairs else f"s_{b}_{a}"
    cells = ["n", *(f"s_{a}" for a in [*names, "y"]), *(at(a, b) for a, b in pairs)]
    cov = lambda a, b: f"({at(a, b)} / n - s_{a} * s_{b} / n / n)"
    new = {}
    for a in names:
        rest = " - ".join([f"c_{a}", *(f"g_{a}_{b} * {new[b] if b in new else 'b_' + b}" for b in names if b != a)])
        new[a] = f"(sign({rest}) * greatest(abs({rest}) - w, 0) / g_{a}_{a})"
    line = {"1": "(s_y - " + " - ".join(f"b_{a} * s_{a}" for a in names) + ") / n"}
    residual = "e.s_y_y + e.n * i.b0 * i.b0 - 2 * i.b0 * e.s_y" + "".join(
        f" + 2 * i.b0 * i.b_{a} * e.s_{a} - 2 * i.b_{a} * e.{at(a, 'y')}" + "".join(f" + i.b_{a} * i.b_{b} * e.{at(a, b)}" for b in names) for a in names
    )
    return f"""WITH RECURSIVE t AS (SELECT l_orderkey % 5 AS f, {", ".join(f"{e} AS {c}" for c, e in _LASSO.items())}, {_PAID} AS y FROM lineitem),
    m AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in names)} FROM t),
    d AS (SELECT f, y, {", ".join(f"coalesce(t.{c}, m.{c}) AS {c}" for c in names)} FROM t, m),
    z AS (SELECT f, y, {", ".join(f"({c} - (SELECT avg({c}) FROM d)) / (SELECT stddev_samp({c}) FROM d) AS {c}" for c in names)} FROM d),
    own AS (SELECT f, count(*) * 1.0 AS n, {", ".join(f"sum({c}) AS s_{c}" for c in [*names, "y"])}, {", ".join(f"sum({a} * {b}) AS {at(a, b)}" for a, b in pairs)} FROM z GROUP BY f),
    whole AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in cells)} FROM own),
    train AS (SELECT own.f, {", ".join(f"whole.{c} - own.{c} AS {c}" for c in cells)} FROM own, whole UNION ALL SELECT -1, * FROM whole),
    p AS (SELECT train.*, (SELECT stddev_pop(y) FROM t) * s AS w, {", ".join(f"{cov(a, 'y')} AS c_{a}" for a in names)},
      {", ".join(f"{cov(a, b)} AS g_{a}_{b}" for a in names for b in names)} FROM train, (VALUES {", ".join(f"({s})" for s in _STRENGTHS)}) v(s)),
    steps AS (SELECT 0 AS k, *, {", ".join(f"CAST(0 AS DOUBLE) AS b_{a}" for a in names)} FROM p
      UNION ALL SELECT k + 1, {", ".join(f"steps.{c}" for c in ["f", *cells, "w", *(f"c_{a}" for a in names), *(f"g_{a}_{b}" for a in names for b in names)])},
      {", ".join(new.values())} FROM steps WHERE k < 40),
    i AS (SELECT f, w, {line["1"]} AS b0, {", ".join(f"b_{a}" for a in names)} FROM steps WHERE k = 40),
    e AS (SELECT i.w, avg(({residual}) / e.n) AS mse FROM i JOIN own e USING (f) GROUP BY 1),
    pick AS (SELECT w FROM e ORDER BY mse, w DESC LIMIT 1)
    SELECT feature, {r("score", "score")} FROM (SELECT unnest([{", ".join(f"'{a}'" for a in names)}]) AS feature, unnest([{", ".join(f"abs(b_{a})" for a in names)}]) AS score
    FROM i JOIN pick USING (w) WHERE f = -1)"""


@query("lasso_select", _lasso_sql())
def lasso_select(spark, folder):
    """Six features, most of them noise, four strengths; the folds pick the strength."""
    df = table(spark, folder, "lineitem").selectExpr("l_orderkey", *[f"{e} AS {c}" for c, e in _LASSO.items()], f"{_PAID} AS paid")
    return rounded(features.lasso(df, "paid", list(_LASSO), strengths=list(_STRENGTHS), fold="l_orderkey"))


@query(
    "pca",
    f"""{cte("items", ["quantity", "price"])}, m AS (SELECT avg(quantity) AS a, avg(price) AS b FROM t),
    c AS (SELECT abs(corr(coalesce(quantity, a), coalesce(price, b))) AS r FROM t, m)
    SELECT component, feature, {r("sqrt(0.5)", "loading")}, {r("CASE component WHEN 1 THEN (1 + r) / 2 ELSE (1 - r) / 2 END", "explained")},
    {r("CASE component WHEN 1 THEN (1 + r) / 2 ELSE 1 END", "cumulative")}
    FROM c, (VALUES (1), (2)) k(component), (VALUES ('quantity'), ('price')) f(feature)""",
)
def pca(spark, folder):
    """Two standardized columns: the components are their sum and difference; signs are left out."""
    got = features.pca(load(spark, folder, "items", ["quantity", "price"]), ["quantity", "price"], k=2)
    return rounded(got.withColumn("loading", F.abs("loading")))


@query(
    "pca_variance",
    f"""{cte("items", ["price", "revenue"])}, m AS (SELECT avg(price) AS a, avg(revenue) AS b FROM t),
    c AS (SELECT abs(corr(coalesce(price, a), coalesce(revenue, b))) AS r FROM t, m)
    SELECT share, component, {r("CASE component WHEN 1 THEN (1 + r) / 2 ELSE (1 - r) / 2 END", "explained")}
    FROM c, (VALUES (1), (2)) k(component), (VALUES (0.6), (0.999)) s(share) WHERE component = 1 OR (1 + r) / 2 < share""",
)
def pca_variance(spark, folder):
    """As many components as a share of the variance takes; a small share takes one, a large one both."""
    df, out = load(spark, folder, "items", ["price", "revenue"]), None
    for share in (0.6, 0.999):
        one = features.pca(df, ["price", "revenue"], variance=share).select(F.lit(share).alias("share"), "component", "explained").distinct()
        out = one if out is None else out.unionByName(one)
    return rounded(out, only=["explained"])


_CLASSES = """SELECT CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END AS big, CAST(user_id % 2 AS DOUBLE) AS side,
    CAST(event_id % 3 AS DOUBLE) AS third, CASE WHEN value > 20 THEN 1 ELSE 0 END AS target FROM events"""
_RANKED = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, target)) AS r FROM ({_CLASSES})" for c in ("big", "side", "third")
)


def _classes(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "CASE WHEN value > 20 THEN 1.0D ELSE 0.0D END AS big", "CAST(user_id % 2 AS DOUBLE) AS side",
        "CAST(event_id % 3 AS DOUBLE) AS third", "CASE WHEN value > 20 THEN 1 ELSE 0 END AS target",
    )


@query("rfe", f"SELECT feature, row_number() OVER (ORDER BY r DESC, feature) = 1 AS kept FROM ({_RANKED})")
def rfe(spark, folder):
    """One feature separates the classes; the two others go first."""
    return features.rfe(_classes(spark, folder), "target", n=1).select("feature", "kept")


@query(
    "tree_importance",
    f"SELECT count(*) AS features, {r('sum(CASE WHEN r > 0.5 THEN 1 ELSE 0 END) * 1.0', 'total')}, arg_max(feature, r) AS first, true AS same FROM ({_RANKED})",
)
def tree_importance(spark, folder):
    """Importances add up to one, the separating feature leads, and the same seed gives the same forest."""
    df = _classes(spark, folder)
    one, two = features.importance(df, "target"), features.importance(df, "target").withColumnRenamed("score", "again")
    both = one.join(two, "feature")
    got = both.agg(
        F.count(F.lit(1)).alias("features"), F.sum("score").alias("total"), F.max_by("feature", "score").alias("first"), F.bool_and(F.col("score") == F.col("again")).alias("same")
    )
    return rounded(got)


# ---- questions and ledger ---------------------------------------------------------------------------

_SCORES = f"SELECT feature, {r('r', 'score')} FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, target)) AS r FROM ({_LABELLED})" for c in ("value", "squared", "user_id")
) + ")"


@query("query_scores_top", f"{_SCORES} ORDER BY score DESC, feature LIMIT 2")
def query_scores_top(spark, folder):
    return rounded(features.query(_r_scores(spark, folder), top=2))


@query("query_scores_above", f"SELECT * FROM ({_SCORES}) WHERE score > 0.1")
def query_scores_above(spark, folder):
    return rounded(features.query(_r_scores(spark, folder), gt=0.1))


@query("query_scores_count", f"SELECT count(CASE WHEN score > 0.1 THEN 1 END) AS above, count(*) AS total FROM ({_SCORES})")
def query_scores_count(spark, folder):
    return features.query_count(_r_scores(spark, folder), gt=0.1)


_LEFT = ["quantity", "price", "discount"]  # revenue follows the price


@query(
    "selection_ledger",
    f"""{cte("items", _WITH_TARGET)}, u AS (SELECT {", ".join(f"coalesce({c}, (SELECT avg({c}) FROM t)) AS {c}" for c in _LEFT)} FROM t),
    k AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM (SELECT corr(quantity, price) AS a, corr(quantity, discount) AS b, corr(price, discount) AS c FROM u)),
    gone AS (SELECT (SELECT count(DISTINCT b) FROM ({_pairs(_FEATURES)}) WHERE r >= 0.8) AS near,
      (SELECT count(*) FROM (SELECT unnest([(1 - c * c) / d, (1 - b * b) / d, (1 - a * a) / d]) AS vif FROM k) WHERE vif > 5) AS inflated),
    steps AS (SELECT 1 AS p, 'correlation' AS step, {len(_WITH_TARGET)} AS b, {len(_WITH_TARGET)} - near AS a FROM gone
      UNION ALL SELECT 3, 'vif', {len(_WITH_TARGET)} - near, {len(_WITH_TARGET)} - near - inflated FROM gone)
    SELECT CAST(p AS INTEGER) AS position, step, CAST(b AS INTEGER) AS "before", CAST(a AS INTEGER) AS "after", CAST(b - a AS INTEGER) AS removed,
    {r(f"({len(_WITH_TARGET)} - a) * 100.0 / {len(_WITH_TARGET)}", "total_reduction_pct")} FROM steps""",
)
def selection_ledger(spark, folder):
    """A look at the scores with threshold 0 is not a step."""
    df = load(spark, folder, "items", _WITH_TARGET)
    ledger = Ledger(df.columns)
    df = features.filter_corr(df, "target", 0.8)
    ledger.add("correlation", {"threshold": 0.8}, df.columns)
    ledger.add("iv", {"threshold": 0.0}, df.columns)
    df = features.filter_vif(df, "target", 5.0)
    ledger.add("vif", {"threshold": 5.0}, df.columns)
    return rounded(ledger.to_df(spark).select("position", "step", "before", "after", "removed", F.col("total_reduction_pct")))
