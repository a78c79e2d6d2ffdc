"""Outliers, sentinels and missing values."""

from __future__ import annotations

from ..operators import impute, outliers
from ..plans.plan import Plan, fit_phase
from .registry import ORACLES, with_limits, cte, load, q, query, r, rounded, source, table
from .source_queries import scratch

_KEY = ["l_orderkey", "quantity", "price", "discount"]

_BAD = (
    "abs({c}) > 1e14 OR {c} < -1e12 OR {c} > 1e12 OR {c} IN (-999999, 999999, -9999, 9999, -1.7e308) "
    "OR abs({c}) IN (1.79769313486e308, 2.22507385851e-308)"
)


@query(
    "sentinel_to_null",
    f"""{cte("clicks", ["event_id", "raw"])} SELECT event_id, CASE WHEN NOT ({_BAD.replace("{c}", "raw")}) THEN raw END AS raw
    FROM t""",
)
def sentinel_to_null(spark, folder):
    return outliers.sentinels(load(spark, folder, "clicks", ["event_id", "raw"]), ["raw"])


@query(
    "sentinel_report",
    f"""{cte("clicks", ["raw", "value"])} SELECT * FROM (SELECT 'raw' AS "column", count(CASE WHEN {_BAD.replace("{c}", "raw")} THEN 1 END) AS n,
    {r(f"100.0 * count(CASE WHEN {_BAD.replace('{c}', 'raw')} THEN 1 END) / count(*)", "pct")},
    count(CASE WHEN isinf(raw) THEN 1 END) AS infinities, count(CASE WHEN raw < -1e100 THEN 1 END) AS extreme_negative,
    count(CASE WHEN raw > 1e100 THEN 1 END) AS extreme_positive, count(CASE WHEN abs(raw) > 1e300 THEN 1 END) AS default_double
    FROM t) WHERE n > 0""",
)
def sentinel_report(spark, folder):
    return rounded(outliers.sentinel_report(load(spark, folder, "clicks", ["raw", "value"]), ["raw", "value"]))


def _clip(c: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {q(c, lo)}), {q(c, hi)}) END"


def _clipped(lo: float, hi: float) -> str:
    return f"""{cte("items", _KEY)} SELECT l_orderkey, {r(_clip("quantity", lo, hi), "quantity")},
    {r(_clip("price", lo, hi), "price")}, discount FROM t"""


@query("winsorize", _clipped(0.01, 0.99))
def winsorize(spark, folder):
    return rounded(outliers.winsorize(load(spark, folder, "items", _KEY), ["quantity", "price"]), only=["quantity", "price"])


@query("winsorize_5_95", _clipped(0.05, 0.95))
def winsorize_5_95(spark, folder):
    df = load(spark, folder, "items", _KEY)
    return rounded(outliers.winsorize(df, ["quantity", "price"], 0.05, 0.95), only=["quantity", "price"])


def _iqr(c: str) -> tuple[str, str]:
    a, b = q(c, 0.25), q(c, 0.75)
    return f"({a} - 1.5 * ({b} - {a}))", f"({b} + 1.5 * ({b} - {a}))"


_VALUE = ["event_id", "user_id", "value"]


@query(
    "outliers_to_null_iqr",
    f"""{cte("clicks", _VALUE)} SELECT event_id, user_id,
    CASE WHEN value BETWEEN {_iqr("value")[0]} AND {_iqr("value")[1]} THEN value END AS value FROM t""",
)
def outliers_to_null_iqr(spark, folder):
    return outliers.to_null(load(spark, folder, "clicks", _VALUE), ["value"], rule="iqr")


@query(
    "outliers_to_null_pct",
    f"""{cte("clicks", _VALUE)} SELECT event_id, user_id,
    CASE WHEN value BETWEEN {q("value", 0.01)} AND {q("value", 0.99)} THEN value END AS value FROM t""",
)
def outliers_to_null_pct(spark, folder):
    return outliers.to_null(load(spark, folder, "clicks", _VALUE), ["value"], rule="pct")


def _kept(origin: str, c: str) -> str:
    return f"""SELECT o.* FROM {origin} o, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {origin}) f
    WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)"""


_NULLED = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, value * value AS squared FROM events"


def _squares(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value", "value * value AS squared"
    )


@query("drop_outlier_rows", f"WITH t AS ({_NULLED}), u AS ({_kept('t', 'value')}) {_kept('u', 'squared')}")
def drop_outlier_rows(spark, folder):
    return outliers.drop_rows(_squares(spark, folder), ["value", "squared"], sequential=True)


@query(
    "drop_outlier_rows_at_once",
    f"""WITH t AS ({_NULLED}) SELECT t.* FROM t,
    (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b,
            quantile_cont(squared, 0.25) AS c, quantile_cont(squared, 0.75) AS d FROM t) f
    WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AND squared BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c)""",
)
def drop_outlier_rows_at_once(spark, folder):
    return outliers.drop_rows(_squares(spark, folder), ["value", "squared"], sequential=False)


def _centered(center: str) -> str:
    return f"""{cte("clicks", _VALUE)} SELECT event_id, user_id,
    {r(f"CASE WHEN value BETWEEN {q('value', 0.01)} AND {q('value', 0.99)} OR value IS NULL THEN value ELSE {center} END", "value")}
    FROM t"""


@query("outliers_to_center", _centered(q("value", 0.5)))
def outliers_to_center(spark, folder):
    return rounded(outliers.to_center(load(spark, folder, "clicks", _VALUE), ["value"], "median"), only=["value"])


@query("outliers_to_mean", _centered("(SELECT avg(value) FROM t)"))
def outliers_to_mean(spark, folder):
    return rounded(outliers.to_center(load(spark, folder, "clicks", _VALUE), ["value"], "mean"), only=["value"])


# ---- missing values ---------------------------------------------------------------------------------

_GAPS = ["l_orderkey", "quantity", "price", "flag"]


def _mode(c: str, origin: str = "t") -> str:
    return f"(SELECT {c} FROM {origin} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute_mean",
    f"""{cte("items", _GAPS)} SELECT l_orderkey, {r("coalesce(quantity, (SELECT avg(quantity) FROM t))", "quantity")},
    {r("coalesce(price, (SELECT avg(price) FROM t))", "price", 4)}, coalesce(flag, {_mode("flag")}) AS flag FROM t""",
)
def impute_mean(spark, folder):
    out = impute.mean(load(spark, folder, "items", _GAPS), ["quantity", "price", "flag"])
    return rounded(rounded(out, only=["quantity"]), 4, ["price"])


@query(
    "impute_median",
    f"""{cte("items", _GAPS)} SELECT l_orderkey, {r(f"coalesce(quantity, {q('quantity', 0.5)})", "quantity")},
    {r(f"coalesce(price, {q('price', 0.5)})", "price")}, coalesce(flag, {_mode("flag")}) AS flag FROM t""",
)
def impute_median(spark, folder):
    return rounded(impute.median(load(spark, folder, "items", _GAPS), ["quantity", "price", "flag"]))


@query(
    "impute_mode",
    f"""{cte("items", _GAPS)} SELECT l_orderkey, coalesce(quantity, {_mode("quantity")}) AS quantity,
    coalesce(price, {_mode("price")}) AS price, coalesce(flag, {_mode("flag")}) AS flag FROM t""",
)
def impute_mode(spark, folder):
    return impute.mode(load(spark, folder, "items", _GAPS), ["quantity", "price", "flag"])


@query(
    "impute_constant",
    f"""{cte("items", _GAPS)} SELECT l_orderkey, coalesce(quantity, -222) AS quantity, coalesce(price, 0.5) AS price,
    coalesce(flag, 'Unknown') AS flag FROM t""",
)
def impute_constant(spark, folder):
    return impute.constant(load(spark, folder, "items", _GAPS), {"quantity": None, "price": 0.5, "flag": None})


_BIG = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey + 9007199254740992 END"  # beyond what a double can hold


def _big(spark, folder):
    return table(spark, folder, "orders").selectExpr("o_orderkey", f"{_BIG} AS big")


def _big_filled(fill: str) -> str:
    return f"WITH t AS (SELECT o_orderkey, {_BIG} AS big FROM orders) SELECT o_orderkey, coalesce(big, {fill}) AS big FROM t"


@query("impute_mode_bigint", _big_filled(_mode("big")))
def impute_mode_bigint(spark, folder):
    return impute.mode(_big(spark, folder), ["big"])


@query("impute_constant_bigint", _big_filled("9007199254740993"))
def impute_constant_bigint(spark, folder):
    return impute.constant(_big(spark, folder), {"big": 9007199254740993})


@query("impute_bigint_read_back", _big_filled(_mode("big")))
def impute_bigint_read_back(spark, folder):
    """The fill of a plan that was saved and read again."""
    df, path = _big(spark, folder), scratch(spark, "plan")
    Plan(fit_phase(df, "missing", {"big": "mode"})).save(spark, path)
    return Plan.read(spark, path).transform(df)


@query(
    "impute_model_fallback",
    f"""{cte("items", ["l_orderkey", "price", "discount"])} SELECT l_orderkey, {r(f"coalesce(price, {q('price', 0.5)})", "price")},
    discount FROM t""",
)
def impute_model_fallback(spark, folder):
    """No column correlates with the price, so the median fills it."""
    return rounded(impute.model(load(spark, folder, "items", ["l_orderkey", "price", "discount"]), "price"))


@query(
    "impute_model",
    f"""WITH t AS ({source("items", ["l_orderkey", "price", "revenue"])}),
    f AS (SELECT regr_slope(price, revenue) AS a, regr_intercept(price, revenue) AS b FROM t)
    SELECT l_orderkey, {r("coalesce(price, b + a * revenue)", "price", 3)}, {r("revenue", "revenue", 4)} FROM t, f""",
)
def impute_model(spark, folder):
    out = impute.model(load(spark, folder, "items", ["l_orderkey", "price", "revenue"]), "price")
    return rounded(rounded(out, 3, ["price"]), 4, ["revenue"])


@query(
    "forward_fill",
    f"""{cte("clicks", ["event_id", "user_id", "event_type", "value"])} SELECT event_id, user_id,
    last_value(event_type IGNORE NULLS) OVER w AS event_type, last_value(value IGNORE NULLS) OVER w AS value FROM t
    WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill(spark, folder):
    df = load(spark, folder, "clicks", ["event_id", "user_id", "event_type", "value"])
    return impute.ffill(df, ["event_type", "value"], ["event_id"])


@query(
    "forward_fill_by_user",
    f"""{cte("clicks", ["event_id", "user_id", "event_type", "value"])} SELECT event_id, user_id, event_type,
    last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM t""",
)
def forward_fill_by_user(spark, folder):
    df = load(spark, folder, "clicks", ["event_id", "user_id", "event_type", "value"])
    return impute.ffill(df, ["value"], ["event_id"], ["user_id"])


@query("drop_missing_columns", source("items", ["l_orderkey", "flag"]))
def drop_missing_columns(spark, folder):
    return impute.drop(load(spark, folder, "items", _GAPS), ["quantity", "price"])


@query(
    "impute_auto",
    f"""{cte("items", [*_GAPS, "discount", "status"])} SELECT l_orderkey, {r(f"coalesce(quantity, {q('quantity', 0.5)})", "quantity")},
    {r("coalesce(price, (SELECT avg(price) FROM t))", "price", 4)}, coalesce(flag, {_mode("flag")}) AS flag, discount FROM t""",
)
def impute_auto(spark, folder):
    df = load(spark, folder, "items", [*_GAPS, "discount", "status"])
    chosen = {"quantity": "auto", "price": "mean", "flag": "median", "discount": "mean", "status": "drop_column"}
    return rounded(rounded(impute.apply(df, chosen), only=["quantity"]), 4, ["price"])


@query(
    "impute_all_mean",
    f"""{cte("items", ["quantity", "price"])} SELECT {r("coalesce(quantity, (SELECT avg(quantity) FROM t))", "quantity")},
    {r("coalesce(price, (SELECT avg(price) FROM t))", "price", 4)} FROM t""",
)
def impute_all_mean(spark, folder):
    out = impute.all(load(spark, folder, "items", ["quantity", "price"]), ["quantity", "price"], "mean")
    return rounded(rounded(out, only=["quantity"]), 4, ["price"])


@query(
    "impute_all_zero",
    f"{cte('items', ['quantity', 'price'])} SELECT coalesce(quantity, 0) AS quantity, coalesce(price, 0) AS price FROM t",
)
def impute_all_zero(spark, folder):
    return impute.all(load(spark, folder, "items", ["quantity", "price"]), ["quantity", "price"], "zero")


@query("forward_fill_ranges", ORACLES["forward_fill"])
def forward_fill_ranges(spark, folder):
    return with_limits(spark, {"rowsPerRange": 2_000}, lambda: forward_fill(spark, folder))


@query("outliers_keep", source("clicks", _VALUE))
def outliers_keep(spark, folder):
    df = load(spark, folder, "clicks", _VALUE)
    return Plan(fit_phase(df, "outliers", {"value": "keep"})).transform(df)
