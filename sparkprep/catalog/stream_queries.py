"""Plans and stability on streams; each stream reads the files that hold the table and runs to their end."""

from __future__ import annotations

from ..streaming import apply, stability
from .plan_queries import _train_plan
from .registry import INPUTS, ORACLES, load, query, r, rounded, source, table
from .source_queries import scratch

_COLS = ["event_id", "event_type", "value", "is_even"]


def _stream(spark, folder):
    return apply.read_files(spark, f"{folder}/events.parquet", table(spark, folder, "events").schema)


@query("stream_apply_plan", ORACLES["apply_plan"])
def stream_apply_plan(spark, folder):
    """The plan of ``apply_plan`` on a stream gives the same rows."""
    plan = _train_plan(load(spark, folder, "clicks", _COLS).filter("is_even"))
    exprs = INPUTS["clicks"][1]
    stream = _stream(spark, folder).selectExpr(*[f"{exprs[c]} AS {c}" for c in _COLS])
    root = scratch(spark, "stream")
    apply.run_plan(stream, plan, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out"), only=["value"])


_BASE = "ts < TIMESTAMP '2024-01-11'"
_PROBS = ", ".join(str(i / 10) for i in range(11))


def _cells(c: str) -> str:
    return f"""SELECT date_trunc('day', ts) AS day, '{c}' AS feature, {_BASE} AS early,
    CAST(len(list_filter(g[2:len(g) - 1], lambda e: {c} >= e)) AS INTEGER) AS bin FROM t,
    (SELECT list_sort(list_distinct(quantile_cont({c}, [{_PROBS}]))) AS g FROM t WHERE {_BASE}) f
    WHERE {c} IS NOT NULL AND {c} BETWEEN g[1] AND g[len(g)]"""


_CSI_SQL = f"""WITH t AS ({source("clicks", ["ts", "value", "user_id"])}), c AS ({_cells("value")} UNION ALL {_cells("user_id")}),
    d AS (SELECT feature, bin, count(*) AS dev FROM c WHERE early GROUP BY ALL),
    o AS (SELECT day, feature, bin, count(*) AS oot FROM c GROUP BY ALL),
    g AS (SELECT day, feature, bin, coalesce(dev, 0) AS dev, coalesce(oot, 0) AS oot FROM
      (SELECT DISTINCT day, feature FROM o) JOIN d USING (feature) FULL JOIN o USING (day, feature, bin)),
    s AS (SELECT *, dev * 1.0 / sum(dev) OVER (PARTITION BY day, feature) AS a, oot * 1.0 / sum(oot) OVER (PARTITION BY day, feature) AS b FROM g)
    SELECT day AS window_start, feature, {r("sum(CASE WHEN a > 0 AND b > 0 THEN (b - a) * ln(b / a) ELSE 0 END)", "csi")}
    FROM s GROUP BY ALL"""


def _baseline(spark, folder):
    df = load(spark, folder, "clicks", ["ts", "value", "user_id"])
    return df, stability.baseline(df.filter(_BASE), ["value", "user_id"])


@query("csi_windows", _CSI_SQL)
def csi_windows(spark, folder):
    """The batch form: one index per day and feature."""
    df, base = _baseline(spark, folder)
    return rounded(stability.csi_windows(df, base, "ts"))


@query("stream_csi", _CSI_SQL)
def stream_csi(spark, folder):
    """The index of every day as the stream wrote it, from counts kept as state."""
    _, base = _baseline(spark, folder)
    exprs = INPUTS["clicks"][1]
    stream = _stream(spark, folder).selectExpr(*[f"{exprs[c]} AS {c}" for c in ("ts", "value", "user_id")])
    root = scratch(spark, "stream")
    stability.csi_stream(stream, base, "ts", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return rounded(stability.latest(spark, f"{root}/out", dict(stream.dtypes)["ts"]))
