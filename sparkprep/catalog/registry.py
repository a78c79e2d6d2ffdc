"""Where the query modules put their entries, and the helpers both sides of an entry share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) and the SQL statement with the same result."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Double columns rounded for comparison; adding zero removes the sign of a negative zero.

    The double times a power of ten is rounded, half away from zero, as SQL's round does; Spark's own rounds the decimal
    digits of the double, which differs where a share ends on a half of the last digit.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "double" and (only is None or f.name in only):
            near = F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)
            c = (F.when(F.abs(near) < F.lit(float("inf")), near).otherwise(c) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# Inputs: (table, {column: expression valid in Spark and in the oracle}). Nulls, sentinels and flags are made
# here because the stored tables have none.
INPUTS: dict[str, tuple[str, dict[str, str]]] = {
    "items": (
        "lineitem",
        {
            "l_orderkey": "l_orderkey",
            "quantity": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END",
            "price": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END",
            "discount": "l_discount",
            "revenue": "l_extendedprice * (1 - l_discount)",
            "flag": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END",
            "status": "l_linestatus",
            "target": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
            "shipdate": "l_shipdate",
        },
    ),
    "clicks": (
        "events",
        {
            "event_id": "event_id",
            "ts": "ts",
            "user_id": "user_id",
            "event_type": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END",
            "value": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END",
            "raw": "CASE WHEN event_id % 97 = 0 THEN CAST(9999 AS DOUBLE) WHEN event_id % 101 = 0 THEN CAST(1e15 AS DOUBLE) "
            "WHEN event_id % 103 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 7 = 0 THEN NULL ELSE value END",
            "is_big": "value > 20",
            "is_even": "event_id % 2 = 0",
        },
    ),
    "sales": (
        "orders",
        {
            "o_orderkey": "o_orderkey",
            "o_custkey": "o_custkey",
            "status": "o_orderstatus",
            "priority": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END",
            "total": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END",
            "urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END",
            "orderdate": "o_orderdate",
        },
    ),
    "goods": (
        "part",
        {
            "p_partkey": "p_partkey",
            "p_name": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END",
            "p_brand": "p_brand",
            "p_type": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END",
            "p_size": "p_size",
            "p_retailprice": "p_retailprice",
        },
    ),
    # one column per situation the rules tell apart
    "traits": (
        "events",
        {
            "event_id": "event_id",
            "value": "value",
            "squared": "value * value",
            "sparse": "CASE WHEN event_id % 10 = 0 THEN value END",
            "income": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END",
            "balance": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END",
            "zeroed": "CASE WHEN value < 60 THEN 0 ELSE value END",
            "event_type": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END",
            "state": "event_type || '_' || CAST(user_id % 4 AS STRING)",
            "tier": "CASE user_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'giant' END",
            "pair": "CASE WHEN user_id < 50 THEN 'a' ELSE 'b' END",
            "note": "CAST(event_id AS STRING)",
            "created": "CAST(event_id % 50 AS STRING)",
            "tag": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(user_id AS STRING) END",
            "target": "CASE WHEN value > 20 THEN 1 ELSE 0 END",
        },
    ),
    "scored": (
        "lineitem",
        {
            "l_orderkey": "l_orderkey",
            "y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
            "pred": "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END",
            "score": "l_extendedprice / 110000",
            "coarse": "l_quantity / 51",
            "y3": "l_returnflag",
            "pred3": "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END",
            "s_a": "l_quantity / 51",
            "s_n": "l_extendedprice / 110000",
            "s_r": "l_discount * 10",
            "actual": "l_extendedprice",
            "guess": "l_quantity * 2000",
            "split": "CASE WHEN l_orderkey % 10 < 2 THEN 'test' ELSE 'train' END",
        },
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """An input frame, with only the named columns."""
    source, exprs = INPUTS[name]
    return table(spark, folder, source).selectExpr(*[f"{exprs[c]} AS {c}" for c in columns or exprs])


def source(name: str, columns: list[str] | None = None) -> str:
    """The same input as a SQL statement."""
    origin, exprs = INPUTS[name]
    return f"SELECT {', '.join(f'{exprs[c]} AS {c}' for c in columns or exprs)} FROM {origin}"


def cte(name: str, columns: list[str] | None = None) -> str:
    return f"WITH t AS ({source(name, columns)})"


def q(column: str, p: float) -> str:
    """Linear quantile of a column of t as a scalar subquery."""
    return f"(SELECT quantile_cont({column}, {p}) FROM t)"


def each(columns: list[str], select: str, suffix: str = "") -> str:
    """One SELECT per column, joined by UNION ALL; {c} stands for the column."""
    return " UNION ALL ".join(select.replace("{c}", c) + suffix for c in columns)


def with_limits(spark: SparkSession, limits: dict[str, int], make: Callable[[], DataFrame]) -> DataFrame:
    """The frame made under other bounds (sparkprep.<name>), so that small tables take the path of large ones."""
    for k, v in limits.items():
        spark.conf.set(f"sparkprep.{k}", str(v))
    try:
        return make()
    finally:
        for k in limits:
            spark.conf.unset(f"sparkprep.{k}")
