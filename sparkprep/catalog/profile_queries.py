"""Profiling and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers, profile, validate
from .registry import ORACLES, with_limits, cte, each, load, query, r, rounded, source, table

_NUM = ["quantity", "price", "discount", "revenue"]
_TEXT = ["flag", "status"]
_ALL = [*_NUM, *_TEXT]


@query(
    "validate_table",
    f"""{cte("sales")}
    SELECT 'not_empty' AS "check", count(*) > 0 AS ok, count(*) || ' rows' AS detail FROM t
    UNION ALL SELECT 'min_rows', count(*) >= 10, count(*) || ' of 10 rows' FROM t
    UNION ALL SELECT 'min_cols', true, '7 of 2 columns'
    UNION ALL SELECT 'no_empty_column', bool_and(n > 0), coalesce(string_agg(CASE WHEN n = 0 THEN c END, ', '), '')
    FROM ({each(["o_orderkey", "o_custkey", "status", "priority", "total", "urgent", "orderdate"],
                "SELECT '{c}' AS c, count({c}) AS n FROM t")})""",
)
def validate_table(spark, folder):
    return validate.table(load(spark, folder, "sales"))


@query(
    "table_stats",
    f"""{cte("items")} SELECT a."column", a.dtype, a.kind, total, nulls FROM (VALUES
    ('l_orderkey', 'bigint', 'numeric'), ('quantity', 'double', 'numeric'), ('price', 'double', 'numeric'),
    ('discount', 'double', 'numeric'), ('revenue', 'double', 'numeric'), ('flag', 'string', 'categorical'),
    ('status', 'string', 'categorical'), ('target', 'int', 'numeric')) a("column", dtype, kind) JOIN
    ({each(["l_orderkey", *_ALL, "target"],
           "SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls FROM t")}) USING ("column")""",
)
def table_stats(spark, folder):
    return profile.table_stats(load(spark, folder, "items", ["l_orderkey", *_ALL, "target"]))


@query(
    "describe_numeric",
    cte("items", _NUM)
    + each(
        _NUM,
        f"""SELECT '{{c}}' AS "column", count({{c}}) AS "count", {r("avg({c})", "mean", 4)},
        {r("stddev_samp({c})", "std", 4)}, {r("min({c})", "min")}, {r("quantile_cont({c}, 0.25)", "q25")},
        {r("quantile_cont({c}, 0.5)", "q50")}, {r("quantile_cont({c}, 0.75)", "q75")}, {r("max({c})", "max")} FROM t""",
    ),
)
def describe_numeric(spark, folder):
    return rounded(rounded(profile.describe(load(spark, folder, "items", _NUM))), 4, ["mean", "std"])


@query(
    "top_values",
    cte("goods", ["p_name", "p_brand", "p_type"])
    + each(
        ["p_name", "p_brand", "p_type"],
        """SELECT * FROM (SELECT '{c}' AS "column",
        CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS "rank", {c} AS value, count(*) AS n
        FROM t WHERE {c} IS NOT NULL GROUP BY {c}) WHERE "rank" <= 5""",
    ),
)
def top_values(spark, folder):
    return profile.top_values(load(spark, folder, "goods", ["p_name", "p_brand", "p_type"]), k=5)


def _fences(c: str) -> str:
    return f"""SELECT count({c}) AS n, count(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 END) AS k
    FROM t, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM t) f"""


_OVER = ["user_id", "value", "event_type"]


@query(
    "overview_scan",
    f"""{cte("clicks", [*_OVER, "is_big"])} SELECT CAST(3 AS BIGINT) AS total_columns, CAST(2 AS BIGINT) AS numeric_columns,
    CAST(1 AS BIGINT) AS categorical_columns,
    CAST((SELECT sum(CASE WHEN n > 4 AND k > 0 THEN 1 ELSE 0 END) FROM ({each(_OVER[:2], "{f}")
        .replace("{f}", _fences("user_id"), 1).replace("{f}", _fences("value"), 1)})) AS BIGINT) AS with_outliers,
    CAST((SELECT sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) FROM ({each(_OVER, "SELECT count(*) - count({c}) AS m FROM t")}))
        AS BIGINT) AS with_missing""",
)
def overview_scan(spark, folder):
    return profile.overview(load(spark, folder, "clicks", [*_OVER, "is_big"]), "is_big")


@query(
    "column_basics",
    cte("goods", ["p_name", "p_brand", "p_type", "p_size"])
    + each(
        ["p_name", "p_brand", "p_type", "p_size"],
        f"""SELECT '{{c}}' AS "column", count(*) AS total, count(*) - count({{c}}) AS missing,
        {r("100.0 * (count(*) - count({c})) / count(*)", "missing_pct")}, count(DISTINCT {{c}}) AS unique_count,
        {r("count(DISTINCT {c}) * 1.0 / count(*)", "unique_ratio")},
        (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT DISTINCT {{c}} AS k, CAST({{c}} AS VARCHAR) AS v FROM t
         WHERE {{c}} IS NOT NULL ORDER BY k LIMIT 5)) AS sample_values FROM t""",
    ),
)
def column_basics(spark, folder):
    out = profile.basics(load(spark, folder, "goods", ["p_name", "p_brand", "p_type", "p_size"]))
    return rounded(out.withColumn("sample_values", F.array_join("sample_values", "|")))


def _moments(c: str, digits: int) -> str:
    """Skewness and kurtosis from centered sums, as the population forms are not built in."""
    return f"""SELECT '{c}' AS "column", {r("m", "mean", digits)}, {r("med", "median")}, {r("s", "std", digits)},
    {r("avg(d * d * d) / pow(avg(d * d), 1.5)", "skewness")}, {r("avg(d * d * d * d) / pow(avg(d * d), 2) - 3", "kurtosis")},
    {r("s / m", "cv")}, {r("lo", "min")}, {r("hi", "max")} FROM (SELECT {c} - m AS d, m, med, s, lo, hi FROM t,
    (SELECT avg({c}) AS m, quantile_cont({c}, 0.5) AS med, stddev_samp({c}) AS s, min({c}) AS lo, max({c}) AS hi FROM t) f)
    GROUP BY m, med, s, lo, hi"""




@query("numeric_moments", cte("items", _NUM) + " UNION ALL ".join(_moments(c, 4) for c in _NUM))
def numeric_moments(spark, folder):
    return rounded(rounded(profile.moments(load(spark, folder, "items", _NUM))), 4, ["mean", "std"])


_PCT = [("p1", 0.01), ("p5", 0.05), ("q1", 0.25), ("q3", 0.75), ("p95", 0.95), ("p99", 0.99)]


@query(
    "numeric_percentiles",
    cte("items", _NUM)
    + each(
        _NUM,
        "SELECT '{c}' AS \"column\", "
        + ", ".join(r(f"quantile_cont({{c}}, {p})", n) for n, p in _PCT)
        + ", "
        + r("quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "iqr")
        + " FROM t",
    ),
)
def numeric_percentiles(spark, folder):
    return rounded(profile.percentiles(load(spark, folder, "items", _NUM)))


@query(
    "iqr_outlier_report",
    cte("clicks", ["value", "user_id"])
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", k AS outliers, {r("100.0 * k / n", "outlier_pct")} FROM ({_fences(c)})"""
        for c in ("value", "user_id")
    ),
)
def iqr_outlier_report(spark, folder):
    return rounded(profile.outliers_iqr(load(spark, folder, "clicks", ["value", "user_id"])))


@query(
    "zscore_outlier_report",
    cte("clicks", ["value", "user_id"])
    + each(
        ["value", "user_id"],
        f"""SELECT '{{c}}' AS "column", count(CASE WHEN z > 3 THEN 1 END) AS outliers_z,
        {r("100.0 * count(CASE WHEN z > 3 THEN 1 END) / count({c})", "outlier_z_pct")},
        count(CASE WHEN z > 5 THEN 1 END) AS extreme,
        {r("100.0 * count(CASE WHEN z > 5 THEN 1 END) / count({c})", "extreme_pct")}
        FROM (SELECT {{c}}, abs({{c}} - m) / s AS z FROM t, (SELECT avg({{c}}) AS m, stddev_pop({{c}}) AS s FROM t) f)""",
    ),
)
def zscore_outlier_report(spark, folder):
    return rounded(profile.outliers_z(load(spark, folder, "clicks", ["value", "user_id"])))


def _k2(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {r("exp(-(z1 * z1 + z2 * z2) / 2)", "normality_p")},
    exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal FROM (
    SELECT ln(y / alpha + sqrt(y / alpha * y / alpha + 1)) / sqrt(0.5 * ln(w2)) AS z1,
      (1 - 2 / (9 * a) - sign(base) * pow((1 - 2 / a) / abs(base), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM (
    SELECT *, sqrt(2 / (w2 - 1)) AS alpha, 1 + x * sqrt(2 / (a - 4)) AS base FROM (
    SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM (
    SELECT sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
      (ku + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM (
    SELECT CAST(count(*) AS DOUBLE) AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS sk,
      avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS ku FROM (
    SELECT {c} - (SELECT avg({c}) FROM t) AS d FROM t WHERE {c} IS NOT NULL))))))"""


_SUMS = """WITH t AS (SELECT l_orderkey, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax
    FROM lineitem GROUP BY l_orderkey)"""


@query("normality_test", _SUMS + " UNION ALL ".join(_k2(c) for c in ("quantity", "discount", "tax")))
def normality_test(spark, folder):
    means = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.avg("l_quantity").alias("quantity"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
        )
    )
    return rounded(profile.normality(means, ["quantity", "discount", "tax"]))


@query(
    "boolean_profile",
    cte("clicks", ["is_big", "is_even"])
    + each(
        ["is_big", "is_even"],
        f"""SELECT '{{c}}' AS "column", count(CASE WHEN {{c}} THEN 1 END) AS true_count,
        count(CASE WHEN NOT {{c}} THEN 1 END) AS false_count,
        {r("100.0 * count(CASE WHEN {c} THEN 1 END) / count(*)", "true_pct")},
        {r("100.0 * count(CASE WHEN NOT {c} THEN 1 END) / count(*)", "false_pct")},
        abs(100.0 * count(CASE WHEN {{c}} THEN 1 END) / count(*) - 50) < 10 AS is_balanced FROM t""",
    ),
)
def boolean_profile(spark, folder):
    return rounded(profile.booleans(load(spark, folder, "clicks", ["is_big", "is_even"])))


@query(
    "categorical_profile",
    cte("goods", ["p_name", "p_brand", "p_type"])
    + each(
        ["p_name", "p_brand", "p_type"],
        f"""SELECT '{{c}}' AS "column", k AS cardinality, v AS most_frequent_value, n AS most_frequent_count,
        {r("100.0 * n / total", "most_frequent_pct")}, k <= 5 AS low_cardinality, k BETWEEN 6 AND 20 AS medium_cardinality,
        k > 20 AS high_cardinality, k > 50 AS very_high_cardinality, (SELECT list(u || ':' || m ORDER BY m DESC, u) FROM
        (SELECT {{c}} AS u, count(*) AS m FROM t WHERE {{c}} IS NOT NULL GROUP BY 1 ORDER BY m DESC, u LIMIT 5)) AS top_5 FROM
        (SELECT count(DISTINCT {{c}}) AS k, count(*) AS total FROM t),
        (SELECT {{c}} AS v, count(*) AS n FROM t WHERE {{c}} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)""",
        "",
    ),
)
def categorical_profile(spark, folder):
    return rounded(profile.categoricals(load(spark, folder, "goods", ["p_name", "p_brand", "p_type"])))


_STRENGTH = "CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength"


@query(
    "target_correlation",
    cte("items", [*_NUM, "target"])
    + f""" SELECT "column", {r("r", "r")}, {_STRENGTH} FROM ("""
    + each([*_NUM[:3], "target"], "SELECT '{c}' AS \"column\", corr({c}, revenue) AS r FROM t")
    + ")",
)
def target_correlation(spark, folder):
    return rounded(profile.target_corr(load(spark, folder, "items", [*_NUM, "target"]), "revenue"))


@query(
    "point_biserial",
    cte("clicks", ["is_big", "is_even", "value"])
    + each(
        ["is_big", "is_even"],
        f"""SELECT '{{c}}' AS "column", {r('''(avg(CASE WHEN {c} THEN value END) - avg(CASE WHEN NOT {c} THEN value END))
        / stddev_samp(value) * sqrt(count(CASE WHEN {c} AND value IS NOT NULL THEN 1 END) * 1.0
        * count(CASE WHEN NOT {c} AND value IS NOT NULL THEN 1 END) / count(value))''', "r")} FROM t""",
    ),
)
def point_biserial(spark, folder):
    return rounded(profile.point_biserial(load(spark, folder, "clicks", ["is_big", "is_even", "value"]), "value"))


@query(
    "point_biserial_standard",
    cte("clicks", ["is_big", "is_even", "value"])
    + each(["is_big", "is_even"], f"""SELECT '{{c}}' AS "column", {r("corr(CAST({c} AS INTEGER), value)", "r")} FROM t"""),
)
def point_biserial_standard(spark, folder):
    """The textbook form is the correlation with the 0/1 values."""
    df = load(spark, folder, "clicks", ["is_big", "is_even", "value"])
    return rounded(profile.point_biserial(df, "value", form="standard"))


def _anova(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {r("(sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))", "f")}
    FROM (SELECT {c}, avg(total) AS m, count(total) AS n, var_pop(total) AS v FROM t
          WHERE {c} IS NOT NULL AND total IS NOT NULL GROUP BY {c}),
         (SELECT avg(total) AS g FROM t WHERE {c} IS NOT NULL AND total IS NOT NULL)"""


@query("anova_f", cte("sales", ["priority", "status", "total"]) + " UNION ALL ".join(_anova(c) for c in ("priority", "status")))
def anova_f(spark, folder):
    return rounded(profile.anova(load(spark, folder, "sales", ["priority", "status", "total"]), "total", p_values=False))


@query(
    "anova_p_value",
    f"""{cte("sales", ["status", "total"])}, d AS (SELECT count(*) AS n FROM t WHERE status IS NOT NULL AND total IS NOT NULL)
    SELECT "column", f, {r("pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0)", "p")}, pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0) < 0.05 AS significant FROM ({_anova("status")}), d""",
)
def anova_p_value(spark, folder):
    """Three groups: with two degrees of freedom the tail of the distribution is a power."""
    return rounded(profile.anova(load(spark, folder, "sales", ["status", "total"]), "total"))


def _patterns(c: str, origin: str) -> str:
    share = lambda cond, name: r(f"count(CASE WHEN {cond} THEN 1 END) * 1.0 / count(s)", name)
    letters = "upper(s) <> lower(s)"
    return f"""SELECT '{c}' AS "column", {share("contains(s, '@')", "contains_at")},
    {share("regexp_matches(s, '[0-9]')", "contains_digits")}, {share("regexp_matches(s, '[ \\t\\n\\x0B\\f\\r]')", "contains_spaces")},
    {share("regexp_matches(s, '[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r]')", "contains_special")},
    {share(f"{letters} AND s = upper(s)", "all_upper")}, {share(f"{letters} AND s = lower(s)", "all_lower")},
    {share(f"NOT ({letters} AND s = upper(s)) AND NOT ({letters} AND s = lower(s))", "mixed_case")},
    {r("avg(length(s))", "avg_length")}, {r("stddev_samp(length(s))", "length_std")}, min(length(s))::INTEGER AS min_length,
    max(length(s))::INTEGER AS max_length, stddev_samp(length(s)) < 2 AS consistent_length
    FROM (SELECT trim({c}) AS s FROM {origin})"""


@query("string_pattern_profile", _patterns("url", "pages") + " UNION ALL " + _patterns("html", "pages"))
def string_pattern_profile(spark, folder):
    return rounded(profile.string_patterns(table(spark, folder, "pages").select("url", "html")))


@query(
    "missing_report",
    cte("items", _ALL)
    + f"""SELECT "column", missing, {r("100.0 * missing / n", "missing_pct")} FROM ("""
    + each(_ALL, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM t")
    + ") WHERE missing > 0",
)
def missing_report(spark, folder):
    return rounded(profile.missing(load(spark, folder, "items", _ALL)))




@query(
    "missing_drift",
    f"""WITH s AS ({source("clicks", ["value"])}), t AS (SELECT value FROM s),
    f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t)
    SELECT 'value' AS "column", {r("100.0 * (count(*) - count(value)) / count(*)", "before_pct")},
    {r("100.0 * (count(*) - count(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END)) / count(*)",
       "after_pct")} FROM t, f""",
)
def missing_drift(spark, folder):
    before = load(spark, folder, "clicks", ["user_id", "value"])
    after = outliers.to_null(before, ["user_id", "value"], rule="iqr")
    return rounded(profile.missing_drift(before, after))


@query(
    "problem_type",
    """SELECT 'l_linenumber' AS target, count(DISTINCT l_linenumber) AS distinct_values,
       CASE WHEN count(DISTINCT l_linenumber) <= 20 THEN 'classification' ELSE 'regression' END AS problem FROM lineitem
       UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice),
       CASE WHEN count(DISTINCT l_extendedprice) <= 20 THEN 'classification' ELSE 'regression' END FROM lineitem
       UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'classification' FROM lineitem""",
)
def problem_type(spark, folder):
    df = table(spark, folder, "lineitem")
    out = profile.problem_type(df, "l_linenumber")
    return out.union(profile.problem_type(df, "l_extendedprice")).union(profile.problem_type(df, "l_returnflag"))


@query(
    "datetime_candidates",
    """SELECT 'event_type' AS "column", true AS by_name, false AS by_type,
       100.0 * count(try_cast(event_type AS TIMESTAMP)) / count(event_type) AS parsed_pct FROM events
       UNION ALL SELECT 'event_id', true, false, 0.0 FROM (SELECT 1)
       UNION ALL SELECT 'ts', false, true, 100.0 FROM (SELECT 1)
       UNION ALL SELECT 'day_text', false, false, NULL WHERE false""",
)
def datetime_candidates(spark, folder):
    return profile.datetime_columns(table(spark, folder, "events"))


_WORDS = ", ".join(f"'{w}'" for w in profile.SIZE_WORDS + profile.RATING_WORDS)


@query(
    "ordinal_detector",
    """WITH t AS (SELECT p_type, p_name, p_brand, CAST(p_size AS VARCHAR) AS size_text FROM part) """
    + """SELECT *, unique_count >= 3 AND (has_word OR all_numbers) AS is_ordinal FROM ("""
    + each(
        ["p_type", "p_name", "p_brand", "size_text"],
        f"""SELECT '{{c}}' AS "column", count(DISTINCT {{c}}) AS unique_count, bool_or(lower({{c}}) IN ({_WORDS})) AS has_word,
        bool_and(regexp_matches({{c}}, '^[.-]*[0-9][0-9.-]*$') AND try_cast({{c}} AS DOUBLE) IS NOT NULL) AS all_numbers FROM t""",
    )
    + ")",
)
def ordinal_detector(spark, folder):
    df = table(spark, folder, "part")
    return profile.ordinal(df.select("p_type", "p_name", "p_brand", F.col("p_size").cast("string").alias("size_text")))


@query(
    "cell_missing_pct",
    f"""{cte("items", _ALL)} SELECT missing_cells, cells, {r("100.0 * missing_cells / cells", "missing_pct")} FROM (SELECT
    {len(_ALL)} * count(*) - {" - ".join(f"count({c})" for c in _ALL)} AS missing_cells, {len(_ALL)} * count(*) AS cells FROM t)""",
)
def cell_missing_pct(spark, folder):
    return rounded(profile.cell_missing(load(spark, folder, "items", _ALL)))


@query("numeric_percentiles_narrow", ORACLES["numeric_percentiles"])
def numeric_percentiles_narrow(spark, folder):
    return with_limits(spark, {"exactRows": 1}, lambda: numeric_percentiles(spark, folder))
