"""Rules, plans and preparation flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import profile, recommend
from ..plans import prep
from ..plans.plan import Plan, apply_phase, fit_phase
from .profile_queries import _k2
from .registry import cte, load, q, query, r, rounded, source
from .source_queries import scratch

_NUMS = ["event_id", "value", "squared", "sparse", "income", "balance", "zeroed"]
_TEXTS = ["event_type", "state", "tier", "pair", "note", "created", "tag"]
_WORDS = ", ".join(f"'{w}'" for w in profile.SIZE_WORDS + profile.RATING_WORDS)


def _number(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'numeric' AS kind, count(*) AS total, count(*) - count(x) AS missing,
    count(DISTINCT x) AS unique_count, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew,
    avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurt, any_value(p1) AS p1,
    100.0 * count(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 END) / count(x) AS outlier_pct,
    100.0 * count(CASE WHEN abs(d) > 5 * s THEN 1 END) / count(x) AS extreme_pct,
    (SELECT is_normal FROM ({_k2(c)})) AS is_normal, false AS is_ordinal
    FROM (SELECT {c} AS x, {c} - m AS d, p1, q1, q3, s FROM t, (SELECT avg({c}) AS m, stddev_pop({c}) AS s,
    quantile_cont({c}, 0.01) AS p1, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t) f)"""


def _text(c: str) -> str:
    return f"""SELECT '{c}', 'categorical', count(*), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, false,
    count(DISTINCT {c}) >= 3 AND (bool_or(lower({c}) IN ({_WORDS})) OR bool_and(try_cast({c} AS DOUBLE) IS NOT NULL)) FROM t"""


_TRAITS = source("traits").replace("STRING", "VARCHAR")
_PROFILE = (
    f"WITH t AS ({_TRAITS}), p AS (SELECT *, 100.0 * missing / total AS share, unique_count * 1.0 / total AS ratio FROM ("
    + " UNION ALL ".join([_number(c) for c in _NUMS] + [_text(c) for c in _TEXTS])
    + ")) "
)


def _has(parts) -> str:
    return "(" + " OR ".join(f"contains(lower(\"column\"), '{p}')" for p in parts) + ")"


def _case(rules: list[tuple[str, str, float]], where: str) -> str:
    pick = " ".join(f"WHEN {cond} THEN '{s}'" for cond, s, _ in rules)
    sure = " ".join(f"WHEN {cond} THEN CAST({v} AS DOUBLE)" for cond, _, v in rules)
    return f"""SELECT "column", CASE {pick} ELSE 'uncertain' END AS strategy, CASE {sure} ELSE CAST(0.5 AS DOUBLE) END AS confidence
    FROM p WHERE {where}"""


_IS_NUM, _IS_TEXT = "kind = 'numeric'", "kind = 'categorical'"
_SKEW, _KURT = "abs(coalesce(skew, 0))", "abs(coalesce(kurt, 0))"
_RULE_SQL = {
    "outliers": _case(
        [
            ("extreme_pct > 5", "winsorize", 0.9),
            ("outlier_pct > 15", "winsorize", 0.9),
            ("outlier_pct < 2", "keep", 0.85),
            (_has(recommend.KEEP_NAMES), "keep", 0.8),
        ],
        f"{_IS_NUM} AND outlier_pct > 0",
    ),
    "missing": _case(
        [
            ("share > 80", "constant", 0.95),
            (_has(recommend.KEY_NAMES), "constant", 0.95),
            (f"share < 5 AND {_IS_NUM} AND {_SKEW} < 1", "mean", 0.85),
            (f"share < 5 AND {_IS_NUM}", "median", 0.85),
            (f"{_IS_TEXT} AND share < 10 AND ratio < 0.1", "mode", 0.8),
            (f"{_IS_TEXT} AND ratio > 0.8", "constant", 0.85),
        ],
        "missing > 0",
    ),
    "encoding": _case(
        [
            ("ratio > 0.25", "skip", 0.95),
            (_has(recommend.DATE_NAMES), "skip", 0.9),
            ("unique_count <= 3", "label", 0.9),
            (_has(recommend.PLACE_NAMES), "target", 0.8),
            ("is_ordinal", "label", 0.8),
        ],
        _IS_TEXT,
    ),
    "transformations": _case(
        [
            (f"{_SKEW} < 1.5 AND {_KURT} < 7", "none", 0.9),
            (f"{_SKEW} > 5", "yeo_johnson", 0.9),
            (f"{_SKEW} > 1 AND {_SKEW} < 3 AND p1 > 0", "log", 0.85),
            (f"{_SKEW} > 2 AND p1 = 0", "log1p", 0.85),
            (f"{_has(recommend.MONEY_NAMES)} AND {_SKEW} > 1 AND {_SKEW} < 4 AND p1 >= 0", "sqrt", 0.8),
        ],
        f"{_IS_NUM} AND NOT ({_SKEW} < 1 AND {_KURT} < 5 AND is_normal)",
    ),
}
_FALLBACK_SQL = {
    "outliers": "CASE WHEN coalesce(outlier_pct, 0) > 5 THEN 'winsorize' ELSE 'keep' END",
    "missing": f"CASE WHEN share > 50 THEN 'constant' WHEN {_IS_NUM} THEN 'median' ELSE 'mode' END",
    "encoding": "CASE WHEN unique_count <= 15 THEN 'onehot' ELSE 'target' END",
    "transformations": f"CASE WHEN {_SKEW} > 2 THEN 'log1p' ELSE 'none' END",
}
_SIMPLE_SQL = {
    "outliers": (
        "CASE WHEN coalesce(outlier_pct, 0) > 20 OR coalesce(skew, 0) > 2 OR coalesce(outlier_pct, 0) > 10 "
        "THEN 'winsorize' ELSE 'keep' END",
        _IS_NUM,
    ),
    "missing": (
        f"CASE WHEN {_IS_TEXT} THEN 'mode' WHEN share > 50 THEN 'constant' ELSE 'median' END",
        "missing > 0",
    ),
    "encoding": (
        "CASE WHEN unique_count > 1000 THEN 'skip' WHEN unique_count > 50 THEN 'target' "
        "WHEN unique_count > 10 THEN 'onehot' ELSE 'label' END",
        _IS_TEXT,
    ),
    "transformations": (
        "CASE WHEN skew > 2 THEN 'log1p' WHEN skew > 1 THEN 'sqrt' WHEN skew < -1 THEN 'square' ELSE 'standardize' END",
        _IS_NUM,
    ),
}


def _profile(spark, folder):
    return profile.full(load(spark, folder, "traits", [*_NUMS, *_TEXTS]))


def _rule_query(phase: str):
    def run(spark, folder):
        if phase == "outliers":  # its rules read numbers only, and no distinct counts
            table = profile.full(load(spark, folder, "traits", _NUMS), unique_counts=False)
        else:
            table = _profile(spark, folder)
        return recommend.RULES[phase](table).drop("reason")

    return run


for _phase, _name in (
    ("outliers", "recommend_outliers"),
    ("missing", "recommend_missing"),
    ("encoding", "recommend_encoding"),
    ("transformations", "recommend_transforms"),
):
    query(_name, _PROFILE + _RULE_SQL[_phase])(_rule_query(_phase))


def _by_phase(spark, folder, make) -> DataFrame:
    table = _profile(spark, folder)
    parts = [make(table, p).withColumn("phase", F.lit(p)) for p in recommend.PHASES]
    return reduce(DataFrame.unionByName, parts)


@query(
    "recommend_fallback",
    _PROFILE + " UNION ALL ".join(f"SELECT \"column\", {s} AS strategy, '{p}' AS phase FROM p" for p, s in _FALLBACK_SQL.items()),
)
def recommend_fallback(spark, folder):
    return _by_phase(spark, folder, recommend.fallback)


@query(
    "recommend_simple",
    _PROFILE
    + " UNION ALL ".join(
        f"SELECT \"column\", {s} AS strategy, '{p}' AS phase FROM p WHERE {w}" for p, (s, w) in _SIMPLE_SQL.items()
    ),
)
def recommend_simple(spark, folder):
    return _by_phase(spark, folder, recommend.simple)


@query(
    "recommend_simple_chunked",
    _PROFILE
    + f"""SELECT "column", CASE WHEN {_SKEW} > 2 THEN 'log1p' WHEN {_SKEW} > 1 THEN 'sqrt' WHEN {_KURT} > 5 THEN 'standardize'
    ELSE 'none' END AS strategy FROM p WHERE {_IS_NUM}""",
)
def recommend_simple_chunked(spark, folder):
    return recommend.simple(_profile(spark, folder), "transformations", chunked=True)


def _resolved(phase: str, column: str, choice: str) -> str:
    return f"""SELECT "column", CASE WHEN "column" = '{column}' THEN '{choice}' WHEN confidence >= 0.8 THEN strategy ELSE cautious
    END AS strategy, CASE WHEN "column" = '{column}' THEN 'user' WHEN confidence >= 0.8 THEN 'rule' ELSE 'fallback' END AS source,
    '{phase}' AS phase FROM ({_RULE_SQL[phase]}) JOIN (SELECT "column", {_FALLBACK_SQL[phase]} AS cautious FROM p) USING ("column")"""


_CHOICES = {
    "outliers": ("value", "null_iqr"),
    "missing": ("tag", "constant"),
    "encoding": ("state", "binary"),
    "transformations": ("squared", "log"),
}


@query("resolve_strategy", _PROFILE + " UNION ALL ".join(_resolved(p, *c) for p, c in _CHOICES.items()))
def resolve_strategy(spark, folder):
    def make(table, phase):
        user = spark.createDataFrame([_CHOICES[phase]], "column string, strategy string")
        return recommend.resolve(recommend.RULES[phase](table), recommend.fallback(table, phase), user)

    return _by_phase(spark, folder, make)


# ---- plans ------------------------------------------------------------------------------------------

_FLOW = ["event_id", "event_type", "raw", "is_big"]
# event numbers that look like a sentinel are emptied and, as identifiers, filled with the constant
_FLOW_SQL = f"""WITH t0 AS (SELECT CASE WHEN event_id IN (9999, 999999) THEN -222 ELSE event_id END AS event_id, event_type, raw AS reading, CASE WHEN is_big THEN 1 ELSE 0 END AS target
      FROM ({source("clicks", _FLOW)})),
    t AS (SELECT event_id, event_type, target, CASE WHEN abs(reading) > 1e12 OR reading = 9999 THEN NULL ELSE reading END AS reading FROM t0),
    w AS (SELECT event_id, event_type, target, CASE WHEN reading IS NOT NULL
          THEN least(greatest(reading, {q("reading", 0.01)}), {q("reading", 0.99)}) END AS reading FROM t),
    m AS (SELECT event_id, target, coalesce(event_type, (SELECT event_type FROM w WHERE event_type IS NOT NULL GROUP BY 1
          ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type, coalesce(reading, (SELECT quantile_cont(reading, 0.5) FROM w)) AS reading FROM w)
    SELECT event_id, {r("(reading - (SELECT avg(reading) FROM m)) / (SELECT stddev_pop(reading) FROM m)", "reading")}, target,
    """ + ", ".join(
    f"CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END AS event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")
) + " FROM m"


def _flow(spark, folder):
    df = load(spark, folder, "clicks", _FLOW)
    return df.selectExpr("event_id", "event_type", "raw AS reading", "CASE WHEN is_big THEN 1 ELSE 0 END AS target")


_OVERRIDES = {
    "outliers": {"reading": "winsorize"},
    "missing": {"reading": "median"},
    "transformations": {"reading": "standardize", "event_id": "none"},
}


@query("run_phases", _FLOW_SQL)
def run_phases(spark, folder):
    """Sentinels, outliers, missing values, encoding, transforms; each fitted on the output of the one before."""
    flow = prep.Prep("target", overrides=_OVERRIDES, phases=("sentinels", "outliers", "missing", "encoding", "transformations"))
    _, out = flow.fit_transform(_flow(spark, folder))
    return rounded(out, only=["reading"])


_CHOSEN = {
    "outliers": {"value": "winsorize"},
    "missing": {"value": "median", "event_type": "mode"},
    "encoding": {"event_type": "label"},
    "transformations": {"value": "standardize"},
}


def _train_plan(df: DataFrame) -> Plan:
    plan = Plan(overrides=[("outliers", "value")])
    for phase, strategies in _CHOSEN.items():
        steps = fit_phase(df, phase, strategies)
        plan.steps += steps
        df = apply_phase(df, phase, steps)
    return plan


_FIT = """w AS (SELECT event_id, event_type, CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS value
      FROM t, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM t) f),
    c AS (SELECT (SELECT quantile_cont(value, 0.01) FROM t) AS lo, (SELECT quantile_cont(value, 0.99) FROM t) AS hi,
      (SELECT quantile_cont(value, 0.5) FROM w) AS med,
      (SELECT event_type FROM w WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mo),
    m AS (SELECT coalesce(value, med) AS value FROM w, c)"""
_TRAIN = f"WITH s AS ({source('clicks', ['event_id', 'event_type', 'value', 'is_even'])}), t AS (SELECT * FROM s WHERE is_even), {_FIT}"


def _even(spark, folder):
    df = load(spark, folder, "clicks", ["event_id", "event_type", "value", "is_even"])
    return df, df.filter("is_even")


@query(
    "freeze_plan",
    f"""{_TRAIN} SELECT CAST(0 AS INTEGER) AS position, 'outliers' AS phase, 'value' AS "column", 'winsorize' AS strategy,
      'lo' AS name, {r("lo", "number")}, CAST(NULL AS VARCHAR) AS word FROM c
    UNION ALL SELECT 0, 'outliers', 'value', 'winsorize', 'hi', {r("hi", "number")}, NULL FROM c
    UNION ALL SELECT 1, 'missing', 'value', 'median', 'fill', {r("med", "number")}, NULL FROM c
    UNION ALL SELECT 2, 'missing', 'event_type', 'mode', 'fill', NULL, mo FROM c
    UNION ALL SELECT 4, 'transformations', 'value', 'standardize', 'mean', {r("avg(value)", "number")}, NULL FROM m
    UNION ALL SELECT 4, 'transformations', 'value', 'standardize', 'std', {r("stddev_pop(value)", "number")}, NULL FROM m""",
)
def freeze_plan(spark, folder):
    """Fitted values of every step after a round trip through files, one row per value."""
    path = scratch(spark, "plan")
    _train_plan(_even(spark, folder)[1]).save(spark, path)
    table = Plan.read(spark, path).to_df(spark)
    numbers = table.select("position", "phase", "column", "strategy", F.explode("params").alias("name", "number"))
    words = table.select("position", "phase", "column", "strategy", F.explode("mapping").alias("name", "word"))
    return rounded(numbers.unionByName(words, allowMissingColumns=True))


@query(
    "apply_plan",
    f"""{_TRAIN}, codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
        (SELECT DISTINCT coalesce(event_type, (SELECT mo FROM c)) AS v FROM w))
    SELECT event_id, code AS event_type, {r('''(CASE WHEN value IS NULL THEN med ELSE least(greatest(value, lo), hi) END
      - (SELECT avg(value) FROM m)) / (SELECT stddev_pop(value) FROM m)''', "value")}, is_even
    FROM s, c JOIN codes ON v = coalesce(event_type, mo)""",
)
def apply_plan(spark, folder):
    """Fitted on half of the rows, stored, read back and applied to all of them."""
    every, half = _even(spark, folder)
    path = scratch(spark, "plan")
    _train_plan(half).save(spark, path)
    return rounded(Plan.read(spark, path).transform(every), only=["value"])


@query(
    "plan_summary",
    f"""{_TRAIN} SELECT CAST(step AS INTEGER) AS step, phase, strategy, CAST(k AS BIGINT) AS columns,
    CAST(o AS BIGINT) AS overridden FROM (VALUES (2, 'outliers', 'winsorize', 1, 1), (3, 'missing', 'median', 1, 0),
    (3, 'missing', 'mode', 1, 0), (4, 'encoding', 'label', 1, 0), (5, 'transformations', 'standardize', 1, 0))
    a(step, phase, strategy, k, o) WHERE (SELECT count(*) FROM m) > 0""",
)
def plan_summary(spark, folder):
    """Of a plan that was stored and read back."""
    path = scratch(spark, "plan")
    _train_plan(_even(spark, folder)[1]).save(spark, path)
    return Plan.read(spark, path).summary(spark)


@query(
    "plan_shape",
    f"""WITH t AS ({source("clicks", ["event_id", "value"])}) SELECT count(*) AS rows_before, CAST(2 AS BIGINT) AS columns_before,
    count(CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN 1 END) AS rows_after,
    CAST(2 AS BIGINT) AS columns_after FROM t, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM t) f""",
)
def plan_shape(spark, folder):
    df = load(spark, folder, "clicks", ["event_id", "value"])
    return Plan(fit_phase(df, "outliers", {"value": "remove"})).shape(df)


_FAST = ["event_id", "value", "sparse", "balance", "event_type", "state", "tier", "tag", "target"]


@query("fast_preparation")
def fast_preparation(spark, folder):
    """Prepared table with the features that survive selection."""
    return prep.fast(load(spark, folder, "traits", _FAST), "target").table


@query("fast_preparation_steps")
def fast_preparation_steps(spark, folder):
    return prep.fast(load(spark, folder, "traits", _FAST), "target").ledger.to_df(spark)
