"""Numeric transforms."""

from __future__ import annotations

from ..functions import power
from ..operators import transform
from .registry import cte, load, q, query, r, rounded

_COLS = ["event_id", "user_id", "value"]
_MIN = {c: f"(SELECT min({c}) FROM t)" for c in ("user_id", "value")}


def _sql(value: str | None = None, user: str | None = None) -> str:
    """event_id with the transformed value and user number."""
    a = r(value, "value") if value else "value"
    b = r(user, "user_id") if user else "user_id"
    return f"{cte('clicks', _COLS)} SELECT event_id, {b}, {a} FROM t"


def _run(spark, folder, fn, cols=("value",), **options):
    return rounded(fn(load(spark, folder, "clicks", _COLS), list(cols), **options), only=list(cols))


# user numbers start at 0 and are shifted; the SQL takes the plain logarithm of the values, also of the zeros that larger tables have
@query("tx_log", _sql("ln(value)", f"ln(1 + user_id - {_MIN['user_id']} + 1)"))
def tx_log(spark, folder):
    plain = transform.log(load(spark, folder, "clicks", _COLS), ["value"], shift=False)
    return rounded(transform.log(plain, ["user_id"]), only=["value", "user_id"])


@query("tx_log1p", _sql(f"ln(1 + value - {_MIN['value']} + 1)"))
def tx_log1p(spark, folder):
    return _run(spark, folder, transform.log1p)


@query("tx_log1p_plain", _sql("ln(1 + value)"))
def tx_log1p_plain(spark, folder):
    return _run(spark, folder, transform.log1p, shift=False)


@query("tx_sqrt", _sql("sqrt(value)"))
def tx_sqrt(spark, folder):
    return _run(spark, folder, transform.sqrt)


@query("tx_sqrt_shift", _sql(f"sqrt(value - {_MIN['value']})"))
def tx_sqrt_shift(spark, folder):
    return _run(spark, folder, transform.sqrt_shift)


@query("tx_square", _sql("value * value"))
def tx_square(spark, folder):
    return _run(spark, folder, transform.square)


@query("tx_standardize", _sql("(value - (SELECT avg(value) FROM t)) / (SELECT stddev_pop(value) FROM t)"))
def tx_standardize(spark, folder):
    return _run(spark, folder, transform.standardize)


@query(
    "tx_normalize",
    _sql(
        f"(value - {_MIN['value']}) / (SELECT max(value) - min(value) FROM t)",
        f"(user_id - {_MIN['user_id']}) * 1.0 / (SELECT max(user_id) - min(user_id) FROM t)",
    ),
)
def tx_normalize(spark, folder):
    return _run(spark, folder, transform.minmax, ("value", "user_id"))


@query("tx_robust", _sql(f"(value - {q('value', 0.5)}) / ({q('value', 0.75)} - {q('value', 0.25)})"))
def tx_robust(spark, folder):
    return _run(spark, folder, transform.robust)


def _place(c: str) -> str:
    """Linear position on 101 quantiles; the middle of the flat part where grid points are equal."""
    return f"""CASE WHEN {c} <= g[1] THEN 0.0 WHEN {c} >= g[101] THEN 1.0 WHEN le > lt THEN (le - 1 + lt) / 200.0
    WHEN {c} IS NOT NULL THEN (le - 1 + ({c} - g[le]) / (g[le + 1] - g[le])) / 100.0 END"""


@query(
    "tx_quantile",
    f"""{cte("clicks", _COLS)}, f AS (SELECT quantile_cont(value, [{", ".join(str(i / 100) for i in range(101))}]) AS g FROM t)
    SELECT event_id, user_id, {r(_place("value"), "value")} FROM (SELECT *, len(list_filter(g, lambda e: e <= value)) AS le,
    len(list_filter(g, lambda e: e < value)) AS lt FROM t, f)""",
)
def tx_quantile(spark, folder):
    return _run(spark, folder, transform.quantile)


@query("tx_box_cox", _sql("(pow(value, 0.3) - 1) / 0.3"))
def tx_box_cox(spark, folder):
    return _run(spark, folder, transform.box_cox, lam=0.3)


def _likeliest(x: str, power: str, log: str) -> str:
    """The exponent of two decimals with the highest likelihood, by trying all between -5 and 5."""
    y = f"CASE WHEN lam = 0 THEN {log} ELSE (pow({power}, lam) - 1) / lam END"
    return f"""{cte("clicks", _COLS)}, g AS (SELECT i / 100.0 AS lam FROM range(-500, 501) r(i)),
    l AS (SELECT lam, (lam - 1) * sum({log}) - count(*) / 2.0 * ln(var_pop({y})) AS l FROM t, g WHERE {x} IS NOT NULL GROUP BY lam),
    b AS (SELECT lam FROM l ORDER BY l DESC LIMIT 1)
    SELECT event_id, user_id, {r(y, "value")} FROM t, b"""


def _fitted(spark, folder, how, family: str):
    """The fitted exponent, to two decimals, applied; where there is none the operator's own choice."""
    lam = power.fit(load(spark, folder, "clicks", _COLS), ["value"], family)["value"]
    return _run(spark, folder, how, lam=None if lam is None else round(lam, 2))


@query("tx_box_cox_fit", _likeliest("value", "value", "ln(value)"))
def tx_box_cox_fit(spark, folder):
    return _fitted(spark, folder, transform.box_cox, "box_cox")


@query("tx_yeo_johnson", _sql("(pow(value + 1, -0.2) - 1) / -0.2"))
def tx_yeo_johnson(spark, folder):
    return _run(spark, folder, transform.yeo_johnson, lam=-0.2)


@query("tx_yeo_johnson_fit", _likeliest("value", "value + 1", "ln(value + 1)"))
def tx_yeo_johnson_fit(spark, folder):
    return _fitted(spark, folder, transform.yeo_johnson, "yeo_johnson")


@query(
    "tx_yeo_johnson_std",
    f"""{cte("clicks", _COLS)}, u AS (SELECT event_id, user_id, (pow(value + 1, -0.2) - 1) / -0.2 AS y FROM t)
    SELECT event_id, user_id, {r("(y - (SELECT avg(y) FROM u)) / (SELECT stddev_pop(y) FROM u)", "value")} FROM u""",
)
def tx_yeo_johnson_std(spark, folder):
    return _run(spark, folder, transform.yeo_johnson, lam=-0.2, standardize=True)


@query(
    "tx_auto",
    f"""{cte("clicks", [*_COLS, "event_type"])} SELECT event_id, {r("user_id * user_id * 1.0", "user_id")},
    {r(f"(value - {q('value', 0.5)}) / ({q('value', 0.75)} - {q('value', 0.25)})", "value")}, event_type FROM t""",
)
def tx_auto(spark, folder):
    df = load(spark, folder, "clicks", [*_COLS, "event_type"])
    chosen = {"value": "Robust-Scale", "user_id": "square", "event_type": "log", "event_id": "no_such_transform"}
    return rounded(transform.apply(df, chosen), only=["value", "user_id"])


@query("tx_none", _sql())
def tx_none(spark, folder):
    return transform.apply(load(spark, folder, "clicks", _COLS), {"value": "none", "user_id": "none"})
