"""Categorical encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode
from .registry import ORACLES, with_limits, cte, load, query, r, rounded, source, table

_SALE = ["o_orderkey", "status", "priority", "total"]


def _code(c: str, key: str = "v", origin: str = "t") -> str:
    """Position of each value among the distinct ones, missing counted as the text nan."""
    return f"""(SELECT v, n, row_number() OVER (ORDER BY {key}) - 1 AS code FROM
    (SELECT coalesce({c}, 'nan') AS v, count(*) AS n FROM {origin} GROUP BY 1))"""


@query(
    "label_encode",
    f"""{cte("sales", _SALE)} SELECT o_orderkey, a.code AS status, b.code AS priority, total FROM t
    JOIN {_code("status")} a ON coalesce(status, 'nan') = a.v JOIN {_code("priority")} b ON coalesce(priority, 'nan') = b.v""",
)
def label_encode(spark, folder):
    return encode.label(load(spark, folder, "sales", _SALE), ["status", "priority"])


@query(
    "label_encode_names",
    f"""WITH t AS (SELECT c_custkey, c_name FROM customer) SELECT c_custkey, a.code AS c_name FROM t
    JOIN {_code("c_name")} a ON c_name = a.v""",
)
def label_encode_names(spark, folder):
    return encode.label(table(spark, folder, "customer").select("c_custkey", "c_name"), ["c_name"])


@query(
    "ordinal_encode",
    f"""{cte("clicks", ["event_id", "event_type", "ts"])} SELECT event_id, code AS event_type, ts FROM t JOIN
    (SELECT v, row_number() OVER (ORDER BY f) - 1 AS code FROM
      (SELECT coalesce(event_type, 'nan') AS v, min(event_id) AS f FROM t GROUP BY 1)) ON v = coalesce(event_type, 'nan')""",
)
def ordinal_encode(spark, folder):
    return encode.ordinal(load(spark, folder, "clicks", ["event_id", "event_type", "ts"]), ["event_type"], ["event_id"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "onehot_encode",
    f"""{cte("sales", _SALE)} SELECT o_orderkey, status, total, """
    + ", ".join(f"CASE WHEN priority = '{p}' THEN 1 ELSE 0 END AS \"priority_{p}\"" for p in _PRIORITIES)
    + " FROM t",
)
def onehot_encode(spark, folder):
    return encode.onehot(load(spark, folder, "sales", _SALE), ["priority"])


_TOP = f"""{cte("goods", ["p_partkey", "p_brand"])}, best AS (SELECT p_brand AS v FROM t WHERE p_brand IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)"""


@query(
    "onehot_top10",
    f"""{_TOP}, named AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM best)
    SELECT p_partkey, {", ".join(f"CASE WHEN k = {i} THEN 1 ELSE 0 END AS brand_{i}" for i in range(1, 11))}, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS other
    FROM t LEFT JOIN named ON p_brand = v""",
)
def onehot_top10(spark, folder):
    """The ten most frequent brands in the order of their names, and the rest; names follow the data, so columns are numbered."""
    wide = encode.onehot(load(spark, folder, "goods", ["p_partkey", "p_brand"]), ["p_brand"])
    marks = sorted(c for c in wide.columns if c not in ("p_partkey", "p_brand_Other"))
    return wide.select("p_partkey", *[F.col(f"`{c}`").alias(f"brand_{i}") for i, c in enumerate(marks, 1)], F.col("p_brand_Other").alias("other"))


@query(
    "onehot_top10_long",
    f"""{_TOP}
    SELECT p_partkey, 'p_brand_' || coalesce(v, 'Other') AS one FROM t LEFT JOIN best ON p_brand = v""",
)
def onehot_top10_long(spark, folder):
    wide = encode.onehot(load(spark, folder, "goods", ["p_partkey", "p_brand"]), ["p_brand"])
    marks = [c for c in wide.columns if c != "p_partkey"]
    return wide.unpivot("p_partkey", marks, "one", "hit").filter("hit = 1").select("p_partkey", "one")


_MEANS = "(SELECT {c} AS v, avg(urgent) AS m, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1)"
_TARGETED = ["o_orderkey", "status", "priority", "total", "urgent"]


@query(
    "target_encode",
    f"""WITH t AS (SELECT o_orderkey, status, priority, total FROM ({source("sales", _TARGETED)})) SELECT o_orderkey,
    {r("coalesce(a.m, (SELECT avg(total) FROM t))", "status", 3)}, {r("coalesce(b.m, (SELECT avg(total) FROM t))", "priority", 3)}, total
    FROM t LEFT JOIN (SELECT status AS v, avg(total) AS m FROM t WHERE status IS NOT NULL GROUP BY 1) a ON status = a.v
    LEFT JOIN (SELECT priority AS v, avg(total) AS m FROM t WHERE priority IS NOT NULL GROUP BY 1) b ON priority = b.v""",
)
def target_encode(spark, folder):
    df = load(spark, folder, "sales", ["o_orderkey", "status", "priority", "total"])
    return rounded(encode.target(df, ["status", "priority"], "total"), 3, ["status", "priority"])


@query(
    "smoothed_target_encode",
    f"""{cte("sales", ["o_orderkey", "o_custkey", "urgent"])} SELECT o_orderkey, urgent,
    {r("(n * m + 10 * (SELECT avg(urgent) FROM t)) / (n + 10)", "customer")} FROM
    (SELECT *, CAST(o_custkey AS VARCHAR) AS customer FROM t) JOIN
    (SELECT CAST(o_custkey AS VARCHAR) AS v, avg(urgent) AS m, count(*) AS n FROM t GROUP BY 1) ON customer = v""",
)
def smoothed_target_encode(spark, folder):
    df = load(spark, folder, "sales", ["o_orderkey", "o_custkey", "urgent"])
    df = df.selectExpr("o_orderkey", "urgent", "CAST(o_custkey AS STRING) AS customer")
    return rounded(encode.target(df, ["customer"], "urgent", smoothing=10))


@query(
    "binary_encode",
    f"""{cte("sales", _SALE)} SELECT o_orderkey, status, total, CAST(code & 1 AS INTEGER) AS priority_binary_0,
    CAST((code >> 1) & 1 AS INTEGER) AS priority_binary_1, CAST((code >> 2) & 1 AS INTEGER) AS priority_binary_2
    FROM t JOIN {_code("priority")} ON coalesce(priority, 'nan') = v""",
)
def binary_encode(spark, folder):
    return encode.binary(load(spark, folder, "sales", _SALE), ["priority"])


@query(
    "encode_auto",
    f"""{cte("sales", _TARGETED)} SELECT o_orderkey, a.code AS status, {r("coalesce(b.m, (SELECT avg(urgent) FROM t))", "priority")},
    total, urgent FROM t JOIN {_code("status")} a ON status = a.v LEFT JOIN {_MEANS.replace("{c}", "priority")} b ON priority = b.v""",
)
def encode_auto(spark, folder):
    df = load(spark, folder, "sales", _TARGETED)
    chosen = {"status": "Label-Encoding", "priority": "target_encoding", "total": "onehot"}
    return rounded(encode.apply(df, chosen, "urgent"), only=["priority"])


@query(
    "encoding_dictionary",
    f"""{cte("sales", _TARGETED)} SELECT 'status' AS "column", 'label' AS strategy, v AS value, code, CAST(NULL AS DOUBLE) AS mean,
    CAST(NULL AS VARCHAR) AS bits, n FROM {_code("status")}
    UNION ALL SELECT 'priority', 'target', v, NULL, {r("m", "mean")}, NULL, n FROM {_MEANS.replace("{c}", "priority")}""",
)
def encoding_dictionary(spark, folder):
    df = load(spark, folder, "sales", _TARGETED)
    return rounded(encode.dictionary(encode.fit(df, {"status": "label", "priority": "target"}, "urgent")))


@query(
    "encoding_dictionary_bits",
    f"""{cte("sales", ["priority"])} SELECT 'priority' AS "column", 'binary' AS strategy, v AS value, code,
    CAST(NULL AS DOUBLE) AS mean, lpad(bin(code), 3, '0') AS bits, n FROM {_code("priority")}""",
)
def encoding_dictionary_bits(spark, folder):
    return encode.dictionary(encode.fit(load(spark, folder, "sales", ["priority"]), {"priority": "binary"}))


@query("label_encode_shuffled", ORACLES["label_encode_names"])
def label_encode_shuffled(spark, folder):
    return with_limits(spark, {"broadcastRows": 100}, lambda: label_encode_names(spark, folder))


@query("encode_skip_drop", source("sales", ["o_orderkey", "status", "total"]))
def encode_skip_drop(spark, folder):
    """One column left as it is, one dropped."""
    df = load(spark, folder, "sales", ["o_orderkey", "status", "priority", "total"])
    return encode.apply(df, {"status": "skip", "priority": "drop"})
