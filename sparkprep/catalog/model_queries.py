"""Splits, metrics, rank ordering, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, model
from .registry import ORACLES, with_limits, cte, load, query, r, rounded, table
from .source_queries import scratch


@query(
    "split_train_test",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 2 THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def split_train_test(spark, folder):
    return model.split_by(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_train_test_hash",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey || '|42'), 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS split
    FROM orders""",
)
def split_train_test_hash(spark, folder):
    return model.split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])


@query("confusion_matrix", f"{cte('scored', ['y3', 'pred3'])} SELECT y3 AS actual, pred3 AS predicted, count(*) AS n FROM t GROUP BY ALL")
def confusion_matrix(spark, folder):
    return evaluate.confusion(load(spark, folder, "scored", ["y3", "pred3"]), "y3", "pred3")


_BINARY = """SELECT count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) * 1.0 AS tp, count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) * 1.0 AS fp,
    count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) * 1.0 AS fn, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) * 1.0 AS tn"""
_BINARY_OUT = f"""{r("(tp + tn) / (tp + fp + fn + tn)", "accuracy")}, {r("tp / (tp + fp)", "precision")}, {r("tp / (tp + fn)", "recall")},
    {r("2 * tp / (2 * tp + fp + fn)", "f1")}, {r("tn / (tn + fp)", "specificity")}"""


@query("classification_metrics", f"{cte('scored', ['y', 'pred'])} SELECT {_BINARY_OUT}, 'binary' AS averaging FROM ({_BINARY} FROM t)")
def classification_metrics(spark, folder):
    return rounded(evaluate.classification(load(spark, folder, "scored", ["y", "pred"]), "y", "pred"))


_CLASSES = """SELECT c, support, tp, tp * 1.0 / predicted AS p, tp * 1.0 / support AS q, 2.0 * tp / (predicted + support) AS f,
    sum(support) OVER () AS n FROM (SELECT c, (SELECT count(*) FROM t WHERE y3 = c) AS support,
    (SELECT count(*) FROM t WHERE pred3 = c) AS predicted, (SELECT count(*) FROM t WHERE y3 = c AND pred3 = c) AS tp
    FROM (VALUES ('A'), ('N'), ('R')) v(c))"""


@query(
    "averaged_metrics",
    f"""{cte("scored", ["y3", "pred3"])}, k AS ({_CLASSES})
    SELECT {r("sum(tp) / max(n)", "accuracy")}, {r("avg(p)", "precision")}, {r("avg(q)", "recall")}, {r("avg(f)", "f1")},
    0.0 AS specificity, 'macro' AS averaging FROM k
    UNION ALL SELECT {r("sum(tp) / max(n)", "accuracy")}, {r("sum(p * support) / max(n)", "precision")},
    {r("sum(q * support) / max(n)", "recall")}, {r("sum(f * support) / max(n)", "f1")}, 0.0, 'weighted' FROM k
    UNION ALL SELECT {r("sum(tp) / max(n)", "accuracy")}, {r("sum(tp) / max(n)", "precision")}, {r("sum(tp) / max(n)", "recall")},
    {r("sum(tp) / max(n)", "f1")}, 0.0, 'micro' FROM k""",
)
def averaged_metrics(spark, folder):
    df = load(spark, folder, "scored", ["y3", "pred3"])
    out = evaluate.classification(df, "y3", "pred3")
    for how in ("weighted", "micro"):
        out = out.unionByName(evaluate.classification(df, "y3", "pred3", average=how))
    return rounded(out)


def _auc(hit: str, score: str) -> str:
    """Pairs won plus half of the ties, from running counts over the distinct scores."""
    return f"""SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * 1.0 * sum(neg)) AS auc FROM (SELECT pos, neg,
    sum(neg) OVER (ORDER BY s) - neg AS below FROM (SELECT {score} AS s, count(CASE WHEN {hit} THEN 1 END) AS pos,
    count(CASE WHEN NOT ({hit}) THEN 1 END) AS neg FROM t GROUP BY 1))"""


@query("roc_auc", f"{cte('scored', ['y', 'score'])} SELECT {r('auc', 'roc_auc')} FROM ({_auc('y = 1', 'score')})")
def roc_auc(spark, folder):
    return rounded(evaluate.roc_auc(load(spark, folder, "scored", ["y", "score"]), "y", "score"))


@query("roc_auc_ties", f"{cte('scored', ['y', 'coarse'])} SELECT {r('auc', 'roc_auc')} FROM ({_auc('y = 1', 'coarse')})")
def roc_auc_ties(spark, folder):
    return rounded(evaluate.roc_auc(load(spark, folder, "scored", ["y", "coarse"]), "y", "coarse"))


_OVR = {"A": "s_a", "N": "s_n", "R": "s_r"}


@query(
    "roc_auc_multiclass",
    f"{cte('scored', ['y3', *_OVR.values()])} SELECT {r('avg(auc)', 'roc_auc')} FROM ("
    + " UNION ALL ".join(_auc(f"y3 = '{c}'", s) for c, s in _OVR.items())
    + ")",
)
def roc_auc_multiclass(spark, folder):
    return rounded(evaluate.roc_auc_ovr(load(spark, folder, "scored", ["y3", *_OVR.values()]), "y3", _OVR))


_POINTS = """SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () * 1.0 AS p, sum(neg) OVER () * 1.0 AS n
    FROM (SELECT {s} AS s, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM t GROUP BY 1)
    WINDOW w AS (ORDER BY s DESC)"""


@query(
    "roc_curve",
    f"""{cte("scored", ["y", "score"])} SELECT {r("s", "threshold", 9)}, {r("fp / n", "fpr")}, {r("tp / p", "tpr")}
    FROM ({_POINTS.format(s="score")}) UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0, 0.0""",
)
def roc_curve(spark, folder):
    out = evaluate.roc_curve(load(spark, folder, "scored", ["y", "score"]), "y", "score")
    return rounded(rounded(out, only=["fpr", "tpr"]), 9, ["threshold"])


@query(
    "log_loss",
    f"""{cte("scored", ["y", "score"])} SELECT {r("avg(-(y * ln(p) + (1 - y) * ln(1 - p)))", "log_loss")}
    FROM (SELECT y, greatest(least(score, 1 - 1e-15), 1e-15) AS p FROM t)""",
)
def log_loss(spark, folder):
    return rounded(evaluate.log_loss(load(spark, folder, "scored", ["y", "score"]), "y", "score"))


@query(
    "average_precision",
    f"""{cte("scored", ["y", "coarse"])} SELECT {r("sum(pos / p * tp / (tp + fp))", "average_precision")}
    FROM ({_POINTS.format(s="coarse")})""",
)
def average_precision(spark, folder):
    return rounded(evaluate.average_precision(load(spark, folder, "scored", ["y", "coarse"]), "y", "coarse"))


_ERRORS = """SELECT count(*) AS n, avg(abs(e)) AS mae, avg(e * e) AS mse, avg(abs(e / CASE WHEN actual <> 0 THEN actual ELSE 1 END)) * 100 AS mape,
    1 - avg(e * e) / var_pop(actual) AS r2, avg(CASE WHEN abs(e) <= 1.35 THEN 0.5 * e * e ELSE 1.35 * abs(e) - 0.5 * 1.35 * 1.35 END) AS huber"""
_ADJUSTED = "1 - (1 - r2) * (n - 1) / (n - 3 - 1)"


@query(
    "regression_metrics",
    f"""{cte("scored", ["actual", "guess"])} SELECT {r("mae", "mae", 3)}, {r("mse", "mse", -1)}, {r("sqrt(mse)", "rmse", 3)},
    {r("mape", "mape", 4)}, {r("r2", "r2")}, {r(_ADJUSTED, "adjusted_r2")}, {r("huber", "huber", 3)}
    FROM ({_ERRORS} FROM (SELECT actual, actual - guess AS e FROM t))""",
)
def regression_metrics(spark, folder):
    out = evaluate.regression(load(spark, folder, "scored", ["actual", "guess"]), "actual", "guess", 3)
    out = rounded(rounded(out, 3, ["mae", "rmse", "huber"]), 4, ["mape"])
    return rounded(rounded(out, only=["r2", "adjusted_r2"]), -1, ["mse"])


def _verdict(cols: dict[str, int], inner: str) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, max(CASE WHEN split = 'train' THEN {m} END) AS train,
        max(CASE WHEN split = 'test' THEN {m} END) AS test FROM b"""
        for m in cols
    )
    return f""", b AS ({inner}) SELECT metric, {r("train", "train", 3)}, {r("test", "test", 3)}, {r("train - test", "gap", 3)},
    CASE WHEN train - test > 0.05 THEN 'overfitting' WHEN train - test < 0.02 THEN 'good' ELSE 'moderate' END AS verdict FROM ({rows})"""


_SIDES = dict.fromkeys(("accuracy", "precision", "recall", "f1", "specificity"), 3)


@query(
    "overfit_report",
    cte("scored", ["y", "pred", "split"])
    + _verdict(_SIDES, f"SELECT split, {_BINARY_OUT} FROM ({_BINARY}, split FROM t GROUP BY split)"),
)
def overfit_report(spark, folder):
    df = load(spark, folder, "scored", ["y", "pred", "split"])
    return rounded(evaluate.compare_splits(df, "y", "pred", "split"), 3)


@query(
    "overfit_report_regression",
    cte("scored", ["actual", "guess", "split"])
    + _verdict(
        dict.fromkeys(("mae", "rmse", "mape", "r2", "adjusted_r2", "huber"), 3),
        f"""SELECT split, mae, sqrt(mse) AS rmse, mape, r2, {_ADJUSTED} AS adjusted_r2, huber FROM
        ({_ERRORS}, split FROM (SELECT split, actual, actual - guess AS e FROM t) GROUP BY split)""",
    ),
)
def overfit_report_regression(spark, folder):
    df = load(spark, folder, "scored", ["actual", "guess", "split"])
    out = evaluate.compare_splits(df, "actual", "guess", "split", task="regression", k=3)
    return rounded(out.filter("metric <> 'mse'"), 3)


def _ranked(origin: str) -> str:
    probs = ", ".join(str(i / 10) for i in range(11))
    return f"""SELECT bucket, bads, users, {r("bads * 1.0 / users", "bad_rate", 4)}, CAST(sum(bads) OVER w AS BIGINT) AS cum_bads,
    CAST(sum(users) OVER w AS BIGINT) AS cum_users, {r("sum(bads) OVER w * 1.0 / sum(users) OVER w", "cum_bad_rate", 4)},
    {r("sum(users) OVER w * 100.0 / sum(users) OVER ()", "coverage", 2)}, {r("av", "avg_score", 4)}, {r("lo", "min_score", 4)},
    {r("hi", "max_score", 4)} FROM (SELECT CAST(len(list_filter(g[2:len(g) - 1], lambda e: score > e)) + 1 AS INTEGER) AS bucket,
    CAST(sum(y) AS BIGINT) AS bads, count(*) AS users, avg(score) AS av, min(score) AS lo, max(score) AS hi FROM {origin},
    (SELECT list_sort(list_distinct(quantile_cont(score, [{probs}]))) AS g FROM {origin}) f GROUP BY 1)
    WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("rank_ordering", f"{cte('scored', ['y', 'score'])} {_ranked('t')}")
def rank_ordering(spark, folder):
    return evaluate.rank_ordering(load(spark, folder, "scored", ["y", "score"]), "y", "score")


@query(
    "rank_ordering_scope",
    f"{cte('scored', ['y', 'score', 'split'])}, u AS (SELECT * FROM t WHERE split = 'test') {_ranked('u')}",
)
def rank_ordering_scope(spark, folder):
    df = load(spark, folder, "scored", ["y", "score", "split"])
    return evaluate.rank_ordering(df, "y", "score", split="split", scope="test")


@query(
    "compare_models",
    f"""{cte("scored", ["y", "pred"])}, s AS (SELECT 'rule' AS model, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS score FROM t
    UNION ALL SELECT 'always_no', avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END) FROM t
    UNION ALL SELECT 'always_yes', avg(CASE WHEN y = 1 THEN 1.0 ELSE 0 END) FROM t)
    SELECT CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS "rank", model, {r("score", "score")},
    score = max(score) OVER () AS is_best, score = min(score) OVER () AS is_worst,
    {r("(max(score) OVER () - min(score) OVER ()) * 100 / min(score) OVER ()", "improvement_pct")} FROM s""",
)
def compare_models(spark, folder):
    """The ranking of three rules by accuracy."""
    df = load(spark, folder, "scored", ["y", "pred"])
    rules = {"rule": F.col("pred"), "always_no": F.lit(0), "always_yes": F.lit(1)}
    hits = [F.avg(F.when(F.col("y") == p, 1.0).otherwise(0.0)).alias(n) for n, p in rules.items()]
    scores = df.agg(*hits).unpivot([], list(rules), "model", "score")
    return rounded(evaluate.rank_models(scores))


# ---- training ---------------------------------------------------------------------------------------

# A feature that separates the classes and one that does not: what a tree must find can be computed.
_SEPARABLE = """SELECT event_id, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END AS big, CAST(user_id % 2 AS DOUBLE) AS side,
    CASE WHEN value > 20 THEN 1 ELSE 0 END AS target FROM events"""
_SEP_X = ["big", "side"]


def _separable(spark, folder):
    df = table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN value > 20 THEN 1.0D ELSE 0.0D END AS big", "CAST(user_id % 2 AS DOUBLE) AS side",
        "CASE WHEN value > 20 THEN 1 ELSE 0 END AS target",
    )
    return model.split_by(df, "event_id")


_RULE = f"SELECT avg(CASE WHEN (big > 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END) AS hits FROM ({_SEPARABLE})"


@query("train_classifier", f"SELECT model, {r('hits', 'accuracy')} FROM (VALUES ('dt'), ('gbt'), ('lr'), ('mlp'), ('rf'), ('svm')) m(model), ({_RULE} WHERE event_id % 10 < 2)")
def train_classifier(spark, folder):
    """Every model with its own defaults reaches the accuracy of the rule on the test rows."""
    df, out = _separable(spark, folder), None
    for name in ("dt", "gbt", "lr", "mlp", "rf", "svm"):
        scored = model.score(model.train(df.filter("split = 'train'"), "target", name, features=_SEP_X), df.filter("split = 'test'"))
        one = evaluate.classification(scored, "target", "predictions").select(F.lit(name).alias("model"), "accuracy")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# Features that overlap between the classes: every cell of the two has rows of both, and the best rule for a cell is its
# majority among the train rows.
_NOISY = """SELECT event_id, value, CASE WHEN (value > 20) <> (event_id % 9 = 0) THEN 1.0 ELSE 0.0 END AS big,
    CASE WHEN (user_id % 2 = 1) <> (event_id % 11 = 0) THEN 1.0 ELSE 0.0 END AS side, CASE WHEN value > 20 THEN 1 ELSE 0 END AS target,
    CASE WHEN value > 20 AND user_id % 2 = 1 THEN 1 ELSE 0 END AS pair,
    CASE WHEN value > 20 THEN 'high' WHEN user_id % 2 = 1 THEN 'odd' ELSE 'even' END AS three, event_id % 10 < 2 AS test FROM events"""


def _noisy(spark, folder):
    return model.split_by(table(spark, folder, "events").selectExpr(*_columns(_NOISY)), "event_id")


def _columns(select: str) -> list[str]:
    """The expressions of a SELECT without its table, cut at commas outside brackets."""
    out, depth = [""], 0
    for sign in select[len("SELECT ") : select.rindex(" FROM ")]:
        depth += (sign == "(") - (sign == ")")
        if sign == "," and not depth:
            out.append("")
        else:
            out[-1] += sign
    return out


def _majority(y: str, cells: str = "big, side") -> str:
    """The accuracy on the test rows of the majority of the train rows of each cell, and how many classes it names."""
    return f"""SELECT avg(CASE WHEN n.{y} = m.best THEN 1.0 ELSE 0.0 END) AS hits, count(DISTINCT best) AS classes FROM ({_NOISY}) n JOIN
    (SELECT {cells}, arg_max({y}, k) AS best FROM (SELECT {cells}, {y}, count(*) AS k FROM ({_NOISY}) WHERE NOT test GROUP BY ALL) GROUP BY {cells}) m
    USING ({cells}) WHERE test"""


_ALL = ("dt", "gbt", "lr", "mlp", "rf", "svm")


@query(
    "train_regressor",
    f"""WITH n AS ({_NOISY}), c AS (SELECT big, side, avg(value) AS guess FROM n WHERE NOT test GROUP BY ALL),
    e AS (SELECT 1 - sum((value - guess) ^ 2) / sum((value - (SELECT avg(value) FROM n WHERE test)) ^ 2) AS r2 FROM n JOIN c USING (big, side) WHERE test)
    SELECT model, {r("r2", "r2", 1)} FROM (VALUES ('dt'), ('gbt'), ('lasso'), ('lr'), ('rf'), ('ridge')) m(model), e""",
)
def train_regressor(spark, folder):
    """Every model explains as much of the value on the test rows as the train means of the cells do."""
    df, out = _noisy(spark, folder), None
    for name in ("dt", "gbt", "lasso", "lr", "rf", "ridge"):
        fitted = model.train(df.filter("split = 'train'"), "value", name, "regression", _SEP_X)
        one = evaluate.regression(model.score(fitted, df.filter("split = 'test'")), "value", "predictions", 2).select(F.lit(name).alias("model"), "r2")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 1)


@query(
    "compare_trained_models",
    f"SELECT model, {r('hits', 'score')} FROM (VALUES {', '.join(f"('{m}')" for m in _ALL)}) m(model), ({_majority('target')})",
)
def compare_trained_models(spark, folder):
    """All models with their defaults reach the accuracy of the best rule on overlapping features."""
    got = model.compare(_noisy(spark, folder), "target", list(_ALL), features=_SEP_X)
    return rounded(got.select("model", "score"))


@query(
    "score_table",
    f"""SELECT event_id, big, side, target, CASE WHEN event_id % 10 < 2 THEN 'test' ELSE 'train' END AS split,
    CAST(CASE WHEN big > 0.5 THEN 1 ELSE 0 END AS VARCHAR) AS predictions, big AS predictions_probability FROM ({_SEPARABLE})""",
)
def score_table(spark, folder):
    df = _separable(spark, folder)
    return rounded(model.score(model.train(df, "target", "dt", features=_SEP_X, maxDepth=1), df))


_CONFUSED = f"SELECT target AS actual, CAST(CASE WHEN big > 0.5 THEN 1 ELSE 0 END AS VARCHAR) AS predicted, count(*) AS n FROM ({_SEPARABLE}) GROUP BY ALL"


@query("save_model", _CONFUSED)
def save_model(spark, folder):
    """Stored under a run and name, read back from the path."""
    df = _separable(spark, folder)
    path = model.save(model.train(df, "target", "dt", features=_SEP_X), scratch(spark, "models"), "r1", "tree")
    return evaluate.confusion(model.score(model.load(spark, path), df), "target", "predictions")


@query("load_model", _CONFUSED)
def load_model(spark, folder):
    """Stored, found as the newest of its run, and used."""
    df = _separable(spark, folder)
    root = scratch(spark, "models")
    model.save(model.train(df, "target", "dt", features=_SEP_X), root, "r1", "tree")
    fitted = model.load(spark, model.newest(spark, root, "r1"))
    return evaluate.confusion(model.score(fitted, df), "target", "predictions")


@query(
    "tree_rules",
    f"""WITH t AS ({_SEPARABLE}), n AS (SELECT avg(big) AS p FROM t)
    SELECT 0 AS node, 0 AS depth, NULL AS parent, NULL AS side, 'big' AS feature, 0.5 AS threshold, 1.0 AS share, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END AS prediction FROM n
    UNION ALL SELECT 1, 1, 0, 'left', NULL, NULL, {r("1 - p", "share")}, 0.0 FROM n
    UNION ALL SELECT 2, 1, 0, 'right', NULL, NULL, {r("p", "share")}, 1.0 FROM n""",
)
def tree_rules(spark, folder):
    """One cut suffices; both leaves are pure."""
    return rounded(model.tree_rules(model.train(_separable(spark, folder), "target", "dt", features=_SEP_X, maxDepth=1), _SEP_X))


def _best_cells(y: str, cells: str) -> str:
    """Share of the rows that are in the majority of their cell."""
    return f"(SELECT sum(k) * 1.0 / (SELECT count(*) FROM n) FROM (SELECT max(k) AS k FROM (SELECT {cells}, {y}, count(*) AS k FROM n GROUP BY ALL) GROUP BY {cells}))"


@query(
    "tune",
    f"""WITH n AS ({_NOISY}) SELECT '1' AS depth, {r(f"greatest({_best_cells('pair', 'big')}, {_best_cells('pair', 'side')})", "score", 2)}
    UNION ALL SELECT '3', {r(_best_cells("pair", "big, side"), "score", 2)}""",
)
def tune(spark, folder):
    """Three folds; one cut cannot tell where both conditions hold, three levels can."""
    _, tried = model.tune(_noisy(spark, folder), "pair", "dt", {"maxDepth": [1, 3]}, features=_SEP_X)
    return rounded(tried.select(F.col("params")["maxDepth"].alias("depth"), "score"), 2)


@query(
    "train_classifier_multiclass",
    f"SELECT model, {r('hits', 'accuracy')}, classes FROM (VALUES {', '.join(f"('{m}')" for m in _ALL)}) m(model), ({_majority('three')})",
)
def train_classifier_multiclass(spark, folder):
    """Three classes on overlapping features: every model with its defaults, one against the rest or not, finds the best rule."""
    df, out = _noisy(spark, folder), None
    for name in _ALL:
        scored = model.score(model.train(df.filter("split = 'train'"), "three", name, features=_SEP_X), df.filter("split = 'test'"))
        one = scored.agg(F.avg((F.col("three") == F.col("predictions")).cast("double")).alias("accuracy"), F.count_distinct("predictions").alias("classes"))
        one = one.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("roc_auc_ranges", ORACLES["roc_auc"])
def roc_auc_ranges(spark, folder):
    return with_limits(spark, {"rowsPerRange": 2_000}, lambda: roc_auc(spark, folder))
