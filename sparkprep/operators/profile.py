"""Column profiles: long reports with one row per column, each from one batched aggregate."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import agg, counts, quantiles, tail
from ..functions.agg import count_if, pct
from ..functions.columns import any_of, categorical, kind, kinds, num, numeric, of_kind, ref

PERCENTILES = {"p1": 0.01, "p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}

# Name parts of date-like columns, size and rating words of ordered categories.
DATETIME_NAMES = (
    "date", "time", "timestamp", "created", "updated",
    "modified", "transaction", "event", "log", "month", "year",
)
SIZE_WORDS = ("small", "medium", "large", "xs", "s", "m", "l", "xl", "low", "high")
RATING_WORDS = ("poor", "fair", "good", "excellent", "bad", "average", "great")


def _rows() -> Column:
    return F.count(F.lit(1))


def _nulls(c: str) -> Column:
    return count_if(ref(c).isNull())


def _literal_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _known(values: dict[str, object]) -> Column:
    """Value of each row's column where it is already known on the driver."""
    table = F.create_map(*[F.lit(x) for c, v in values.items() if v is not None for x in (c, v)])
    return F.element_at(table, F.col("column")) if any(v is not None for v in values.values()) else F.lit(None).cast("double")


# ---- table level ------------------------------------------------------------------------------------


def table_stats(df: DataFrame) -> DataFrame:
    """(column, dtype, kind, total, nulls): types from the schema, null counts from one aggregate."""
    out = agg.long(df, {c: {"total": _rows(), "nulls": _nulls(c)} for c in df.columns})
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return out.select("column", _known(types).alias("dtype"), _known(kinds(df)).alias("kind"), "total", "nulls")


def missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, missing, missing_pct) of the columns that have nulls."""
    return missing_all(df, cols).filter(F.col("missing") > 0)


def missing_all(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = df.columns if cols is None else cols
    return agg.long(df, {c: {"missing": _nulls(c), "missing_pct": pct(_nulls(c), _rows())} for c in cols})


def missing_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before_pct, after_pct) where the share of nulls rose."""
    shared = [c for c in before.columns if c in after.columns]
    b = missing_all(before, shared).select("column", F.col("missing_pct").alias("before_pct"))
    a = missing_all(after, shared).select("column", F.col("missing_pct").alias("after_pct"))
    return b.join(a, "column").filter(F.col("after_pct") > F.col("before_pct"))


def cell_missing(df: DataFrame) -> DataFrame:
    """(missing_cells, cells, missing_pct) of the whole table."""
    filled = reduce(lambda a, b: a + b, [F.count(ref(c)) for c in df.columns])
    one = df.agg((_rows() * len(df.columns)).alias("cells"), filled.alias("filled"))
    gaps = F.col("cells") - F.col("filled")
    return one.select(gaps.alias("missing_cells"), "cells", pct(gaps, F.col("cells")).alias("missing_pct"))


def problem_type(df: DataFrame, target: str, max_classes: int = 20) -> DataFrame:
    """(target, distinct_values, problem): few distinct numbers or text -> classification, else regression."""
    is_num = kind(df.schema[target].dataType) == "numeric"
    few = F.col("distinct_values") <= max_classes if is_num else F.lit(True)
    return df.agg(F.count_distinct(ref(target)).alias("distinct_values")).select(
        F.lit(target).alias("target"),
        "distinct_values",
        F.when(few, "classification").otherwise("regression").alias("problem"),
    )


def datetime_columns(df: DataFrame) -> DataFrame:
    """(column, by_name, by_type, parsed_pct): candidates by name or type; text is tried as a timestamp."""
    stats, names, types = {}, {}, {}
    for f in df.schema.fields:
        by_name = any(p in f.name.lower() for p in DATETIME_NAMES)
        by_type = kind(f.dataType) == "datetime"
        if not (by_name or by_type):
            continue
        c = ref(f.name)
        parsed = F.try_to_timestamp(c).isNotNull() if kind(f.dataType) == "categorical" else F.lit(by_type) & c.isNotNull()
        stats[f.name] = {"parsed_pct": pct(count_if(parsed), F.count(c))}
        names[f.name], types[f.name] = by_name, by_type
    if not stats:
        return _literal_rows(df, [], "column string, by_name boolean, by_type boolean, parsed_pct double")
    return agg.long(df, stats).select("column", _known(names).alias("by_name"), _known(types).alias("by_type"), "parsed_pct")


# ---- any column -------------------------------------------------------------------------------------


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """(column, unique_count). Exact counts shuffle the distinct values once per column."""
    how = F.approx_count_distinct if approx else F.count_distinct
    return agg.long(df, {c: {"unique_count": how(ref(c))} for c in cols}, chunk=3)


def basics(df: DataFrame, cols: list[str] | None = None, approx: bool = False, k: int = 5) -> DataFrame:
    """(column, total, missing, missing_pct, unique_count, unique_ratio, sample_values: the k smallest as text).

    Exact: everything comes from one count of the values per type. ``approx`` estimates the distinct counts
    in the scan and leaves the samples out.
    """
    cols = df.columns if cols is None else cols
    if approx:
        stats = {c: {"total": _rows(), "missing": _nulls(c), "unique_count": F.approx_count_distinct(ref(c))} for c in cols}
        out = agg.long(df, stats).withColumn("sample_values", F.lit(None).cast("array<string>"))
    else:
        out = reduce(DataFrame.unionByName, [_counted_basics(df, g, k) for g in counts.by_family(df, cols).values()])
    return out.select(
        "column",
        "total",
        "missing",
        pct(F.col("missing"), F.col("total")).alias("missing_pct"),
        "unique_count",
        F.try_divide(F.col("unique_count").cast("double"), F.col("total").cast("double")).alias("unique_ratio"),
        "sample_values",
    )


def _counted_basics(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    counted = counts.value_counts(df, cols)
    stats = counted.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("unique_count"),
    )
    w = Window.partitionBy("column").orderBy("value")
    first = counted.filter(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    pairs = F.collect_list(F.struct("rank", F.col("value").cast("string").alias("value")))  # k per column
    few = first.groupBy("column").agg(F.transform(F.sort_array(pairs), lambda s: s["value"]).alias("sample_values"))
    return stats.join(few, "column", "left")


# ---- numeric columns --------------------------------------------------------------------------------


def describe(df: DataFrame, cols: list[str] | None = None, mode: str = "exact") -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max)."""
    cols = numeric(df) if cols is None else cols
    q = quantiles.fit(df, cols, [0.25, 0.5, 0.75], mode)
    out = agg.long(
        df,
        {
            c: {
                "count": F.count(ref(c)),
                "mean": F.avg(num(c)),
                "std": F.stddev_samp(num(c)),
                "min": F.min(num(c)),
                "max": F.max(num(c)),
            }
            for c in cols
        },
    )
    return out.select(
        "column", "count", "mean", "std", "min",
        *[_known({c: q[c][i] for c in cols}).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max",
    )


def moments(df: DataFrame, cols: list[str] | None = None, mode: str = "exact") -> DataFrame:
    """(column, mean, median, std, skewness, kurtosis, cv, min, max); population skewness and excess kurtosis."""
    cols = numeric(df) if cols is None else cols
    q = quantiles.fit(df, cols, [0.5], mode)
    out = agg.long(
        df,
        {
            c: {
                "mean": F.avg(num(c)),
                "std": F.stddev_samp(num(c)),
                "skewness": F.skewness(num(c)),
                "kurtosis": F.kurtosis(num(c)),
                "min": F.min(num(c)),
                "max": F.max(num(c)),
            }
            for c in cols
        },
    )
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(F.try_divide("std", "mean"))
    out = out.withColumn("median", _known({c: q[c][0] for c in cols}))
    return out.select("column", "mean", "median", "std", "skewness", "kurtosis", cv.alias("cv"), "min", "max")


def percentiles(df: DataFrame, cols: list[str] | None = None, mode: str = "exact") -> DataFrame:
    """(column, p1, p5, q1, q3, p95, p99, iqr)."""
    cols = numeric(df) if cols is None else cols
    names = [n for n in PERCENTILES if n != "median"]
    q = quantiles.fit(df, cols, [PERCENTILES[n] for n in names], mode)
    schema = "column string, " + ", ".join(f"{n} double" for n in names)
    out = _literal_rows(df, [(c, *q[c]) for c in cols], schema)
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def _outside(c: str, lo: float | None, hi: float | None) -> Column:
    if lo is None:
        return F.lit(False)
    return (num(c) < F.lit(lo)) | (num(c) > F.lit(hi))


def outliers_iqr(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, mode: str = "exact") -> DataFrame:
    """(column, outliers, outlier_pct) outside the interquartile fences; columns with 5 or more values."""
    cols = numeric(df) if cols is None else cols
    q = quantiles.fit(df, cols, [0.25, 0.75], mode)
    f = {c: quantiles.fences(*v, k) if v[0] is not None else (None, None) for c, v in q.items()}
    out = agg.long(
        df,
        {
            c: {
                "n": F.count(ref(c)),
                "outliers": count_if(_outside(c, *f[c])),
                "outlier_pct": pct(count_if(_outside(c, *f[c])), F.count(ref(c))),
            }
            for c in cols
        },
    )
    return out.filter(F.col("n") > 4).drop("n")


def outliers_z(
    df: DataFrame, cols: list[str] | None = None, limit: float = 3.0, extreme: float = 5.0
) -> DataFrame:
    """(column, outliers_z, outlier_z_pct, extreme, extreme_pct) by distance from the mean in population std."""
    cols = numeric(df) if cols is None else cols
    got = agg.fit(df, {(c, n): f(num(c)) for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))})

    def far(c: str, k: float) -> Column:
        m, s = got[c, "m"], got[c, "s"]
        return F.abs(num(c) - F.lit(m)) / F.lit(s) > k if s else F.lit(False)

    out = agg.long(
        df,
        {
            c: {
                "n": F.count(ref(c)),
                "outliers_z": count_if(far(c, limit)),
                "outlier_z_pct": pct(count_if(far(c, limit)), F.count(ref(c))),
                "extreme": count_if(far(c, extreme)),
                "extreme_pct": pct(count_if(far(c, extreme)), F.count(ref(c))),
            }
            for c in cols
        },
    )
    return out.filter(F.col("n") > 4).drop("n")


def k2_p_value(n: int, skew: float | None, kurt: float | None) -> float | None:
    """p-value of the D'Agostino-Pearson statistic from three moments of a column.

    Both parts are turned into normal scores; the chi-square(2) upper tail of their squares is exp(-K2 / 2).
    """
    if n <= 8 or skew is None or kurt is None or math.isnan(skew) or math.isnan(kurt):
        return None
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    z1 = math.asinh(y / math.sqrt(2.0 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 6.0 / (n + 1)) / math.sqrt(var)  # distance of the excess kurtosis from its expectation
    beta1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / beta1 * (2.0 / beta1 + math.sqrt(1 + 4.0 / beta1**2))
    base = 1 + x * math.sqrt(2 / (a - 4.0))
    if base == 0:
        return None
    third = math.copysign(((1 - 2.0 / a) / abs(base)) ** (1 / 3), base)
    z2 = (1 - 2 / (9.0 * a) - third) / math.sqrt(2 / (9.0 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def normality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, normality_p, is_normal); null p for fewer than 9 values or a constant column."""
    cols = numeric(df) if cols is None else cols
    parts = {"n": F.count, "skew": F.skewness, "kurt": F.kurtosis}
    got = agg.fit(df, {(c, k): f(num(c)) for c in cols for k, f in parts.items()})
    p = {c: k2_p_value(got[c, "n"], got[c, "skew"], got[c, "kurt"]) for c in cols}
    rows = [(c, v, v is not None and v > 0.05) for c, v in p.items()]
    return _literal_rows(df, rows, "column string, normality_p double, is_normal boolean")


# ---- boolean and text columns -----------------------------------------------------------------------


def booleans(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, true_count, false_count, true_pct, false_pct, is_balanced)."""
    cols = of_kind(df, "boolean") if cols is None else cols
    out = agg.long(
        df,
        {
            c: {
                "true_count": count_if(ref(c)),
                "false_count": count_if(~ref(c)),
                "true_pct": pct(count_if(ref(c)), _rows()),
                "false_pct": pct(count_if(~ref(c)), _rows()),
            }
            for c in cols
        },
    )
    return out.withColumn("is_balanced", F.abs(F.col("true_pct") - 50) < 10)


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 3) -> DataFrame:
    """(column, rank, value, n): the k most frequent values of each text column."""
    cols = categorical(df) if cols is None else cols
    return counts.top(counts.value_counts(df, cols), k).select("column", "rank", "value", "n")


def categoricals(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, cardinality, most_frequent_value, most_frequent_count, most_frequent_pct, low .. very_high, top_5).

    top_5 lists the five most frequent values with their counts, "value:count", ties to the smaller value.
    """
    cols = categorical(df) if cols is None else cols
    counted = counts.value_counts(df, cols)
    first = counts.top(counted, 5).groupBy(F.col("column").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "value", F.col("n").cast("string")).alias("one")))).alias("top")
    )  # five rows a column
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value"))))
    out = counted.groupBy("column").agg(
        F.count("value").alias("cardinality"), best.alias("best"), F.sum("n").alias("total")
    )
    card = F.col("cardinality")
    out = out.join(first, F.col("column") == F.col("of"), "left")
    return out.select(
        "column",
        "cardinality",
        F.transform("top", lambda t: t["one"]).alias("top_5"),
        F.col("best.value").alias("most_frequent_value"),
        (-F.col("best.n")).alias("most_frequent_count"),
        pct(-F.col("best.n"), F.col("total")).alias("most_frequent_pct"),
        (card <= 5).alias("low_cardinality"),
        card.between(6, 20).alias("medium_cardinality"),
        (card > 20).alias("high_cardinality"),
        (card > 50).alias("very_high_cardinality"),
    )


def string_patterns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Shares of trimmed non-null values with a pattern, and the statistics of their length."""
    cols = categorical(df) if cols is None else cols
    stats = {}
    for c in cols:
        s = F.trim(ref(c))
        n = F.count(ref(c))
        has_letter = F.upper(s) != F.lower(s)
        upper = has_letter & (s == F.upper(s))
        lower = has_letter & (s == F.lower(s))

        def share(cond: Column, n: Column = n) -> Column:
            return F.try_divide(count_if(cond).cast("double"), n.cast("double"))

        stats[c] = {
            "contains_at": share(s.contains("@")),
            "contains_digits": share(s.rlike("[0-9]")),
            "contains_spaces": share(s.rlike(r"\s")),
            "contains_special": share(s.rlike(r"[^a-zA-Z0-9\s]")),
            "all_upper": share(upper),
            "all_lower": share(lower),
            "mixed_case": share(s.isNotNull() & ~upper & ~lower),
            "avg_length": F.avg(F.length(s)),
            "length_std": F.stddev_samp(F.length(s)),
            "min_length": F.min(F.length(s)),
            "max_length": F.max(F.length(s)),
        }
    return agg.long(df, stats).withColumn("consistent_length", F.col("length_std") < 2.0)


def _has_word(c: str) -> Column:
    return F.coalesce(F.bool_or(F.lower(ref(c)).isin(*SIZE_WORDS, *RATING_WORDS)), F.lit(False))


def _all_numbers(c: str) -> Column:
    number = ref(c).rlike("^[.-]*[0-9][0-9.-]*$") & ref(c).try_cast("double").isNotNull()
    return F.coalesce(F.bool_and(number), F.lit(False))


def ordinal(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique_count, has_word, all_numbers, is_ordinal) of text columns."""
    cols = categorical(df) if cols is None else cols
    stats = {c: {"has_word": _has_word(c), "all_numbers": _all_numbers(c)} for c in cols}
    out = agg.long(df, stats).join(distinct_counts(df, cols, approx), "column")
    hit = (F.col("unique_count") >= 3) & (F.col("has_word") | F.col("all_numbers"))
    return out.select("column", "unique_count", "has_word", "all_numbers", hit.alias("is_ordinal"))


# ---- relation to the target -------------------------------------------------------------------------


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")


def target_corr(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """(column, r, strength): Pearson over rows with both values, 0 where it is undefined."""
    cols = numeric(df, exclude=[target]) if cols is None else cols
    t = num(target)
    out = agg.long(df, {c: {"r": agg.corr(num(c), t)} for c in cols})
    r = F.coalesce(F.nanvl(F.col("r"), F.lit(None)), F.lit(0.0))
    return out.select("column", r.alias("r")).withColumn("strength", strength(F.col("r")))


def point_biserial(df: DataFrame, target: str, cols: list[str] | None = None, form: str = "ref") -> DataFrame:
    """(column, r): standardized difference of the target means; ``ref`` divides by n, ``standard`` by n^2."""
    cols = of_kind(df, "boolean") if cols is None else cols
    t = num(target)
    stats = {}
    for c in cols:
        both = ref(c).isNotNull() & t.isNotNull()
        n = count_if(both).cast("double")
        n1, n0 = (count_if(both & cond).cast("double") for cond in (ref(c), ~ref(c)))
        gap = F.avg(F.when(ref(c), t)) - F.avg(F.when(~ref(c), t))
        # the reference form takes the sample deviation of the whole target, the textbook one the population's
        spread = F.stddev_samp(t) if form == "ref" else F.stddev_pop(F.when(both, t))
        scale = n if form == "ref" else n * n
        stats[c] = {"r": F.try_divide(gap, spread) * F.sqrt(F.try_divide(n1 * n0, scale))}
    out = agg.long(df, stats)
    return out.select("column", F.coalesce("r", F.lit(0.0)).alias("r"))


def anova_table(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """(column, k, n, ss_between, ss_within) from counts, means and variances per group."""
    t = num(target)
    keep = {"_t": t}
    stats = {"m": F.avg("_t"), "c": F.count("_t"), "v": F.var_pop("_t")}
    groups = (
        counts.value_counts(df.filter(t.isNotNull()), cols, stats, keep)
        .filter(F.col("value").isNotNull() & (F.col("c") > 0))
    )
    # deviations from a fixed center keep the sums of squares well conditioned
    center = F.lit(agg.fit(df, {"m": F.avg(t)})["m"])
    shift = F.col("m") - center
    sums = groups.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("c").alias("n"),
        F.sum(F.col("c") * shift).alias("s1"),
        F.sum(F.col("c") * shift * shift).alias("s2"),
        F.sum(F.col("c") * F.col("v")).alias("ss_within"),
    )
    between = F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), F.col("n").cast("double"))
    return sums.select("column", "k", "n", between.alias("ss_between"), "ss_within")


def f_statistic() -> Column:
    between = F.col("ss_between") / (F.col("k") - 1)
    within = F.try_divide(F.col("ss_within"), F.col("n") - F.col("k"))
    return F.when(F.col("k") > 1, F.try_divide(between, within))


def anova(df: DataFrame, target: str, cols: list[str] | None = None, p_values: bool = True) -> DataFrame:
    """(column, f[, p, significant]): one-way analysis of variance of the target over each text column."""
    cols = categorical(df, exclude=[target]) if cols is None else cols
    table = anova_table(df, target, cols)
    if not p_values:
        return table.select("column", F.when(F.col("k") > 1, f_statistic()).alias("f"))
    rows = []
    for r in table.filter(F.col("k") > 1).withColumn("f", f_statistic()).collect():  # one row per column
        p = None if r["f"] is None else tail.f_upper(r["f"], r["k"] - 1, r["n"] - r["k"])
        rows.append((r["column"], r["f"], p, None if p is None else p < 0.05))
    return _literal_rows(df, rows, "column string, f double, p double, significant boolean")


# ---- the whole profile ------------------------------------------------------------------------------

NUMERIC_FIELDS = (
    "mean", "median", "std", "skewness", "kurtosis", "min", "max", "p1", "p5", "q1", "q3", "p95", "p99",
    "outlier_pct", "outlier_z_pct", "extreme_pct",
)


def full(
    df: DataFrame,
    target: str | None = None,
    cols: list[str] | None = None,
    approx: bool = False,
    unique_counts: bool = True,
) -> DataFrame:
    """Profile the rules read: one row per column with counts, distribution and outlier shares.

    Moments and quantiles give the fences, one more aggregate the shares beyond them. All of it is one row
    per column, kept as local data so that the rules on top of it do not read the table again. Distinct
    counts shuffle the values; ``unique_counts=False`` leaves them (and ``is_ordinal``) null.
    """
    cols = df.columns if cols is None else cols
    mode = "approx" if approx else "exact"
    what = kinds(df)
    nums = [c for c in cols if what[c] == "numeric"]
    texts = [c for c in cols if what[c] == "categorical"]
    q = quantiles.fit(df, nums, list(PERCENTILES.values()), mode)
    at = {c: dict(zip(PERCENTILES, v)) for c, v in q.items()}
    moment = {"mean": F.avg, "std": F.stddev_samp, "skewness": F.skewness, "kurtosis": F.kurtosis, "min": F.min, "max": F.max}
    exprs: dict = {"total": _rows(), **{(c, "missing"): _nulls(c) for c in cols}}
    exprs.update({(c, n): f(num(c)) for c in nums for n, f in moment.items()})
    exprs.update({(c, "has_word"): _has_word(c) for c in texts})
    exprs.update({(c, "all_numbers"): _all_numbers(c) for c in texts})
    got = agg.fit(df, exprs)
    total = got["total"]
    far: dict = {}
    for c in nums:
        n = total - got[c, "missing"]
        if n <= 4:
            continue
        far[c, "outlier_pct"] = count_if(_outside(c, *quantiles.fences(at[c]["q1"], at[c]["q3"])))
        spread = (got[c, "std"] or 0.0) * math.sqrt((n - 1) / n)  # population form
        for name, k in (("outlier_z_pct", 3), ("extreme_pct", 5)):
            z = F.abs(num(c) - F.lit(got[c, "mean"]))
            far[c, name] = count_if(z > F.lit(k * spread)) if spread else count_if(F.lit(False))
    share = {k: 100.0 * v / (total - got[k[0], "missing"]) for k, v in (agg.fit(df, far) if far else {}).items()}
    unique = dict.fromkeys(cols)
    if unique_counts and cols:
        unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, cols, approx).collect()}
    rows = []
    for c in cols:
        numbers = {**at.get(c, {}), **{n: got.get((c, n)) for n in moment}, **{n: v for (k, n), v in share.items() if k == c}}
        p = k2_p_value(total - got[c, "missing"], got.get((c, "skewness")), got.get((c, "kurtosis")))
        ordered = bool(got.get((c, "has_word")) or got.get((c, "all_numbers")))
        rows.append(
            (
                c,
                what[c],
                total,
                got[c, "missing"],
                100.0 * got[c, "missing"] / total if total else None,
                unique[c],
                unique[c] / total if total and unique[c] is not None else None,
                *[None if numbers.get(n) is None else float(numbers[n]) for n in NUMERIC_FIELDS],
                None if unique[c] is None else unique[c] >= 3 and ordered,
                c == target,
                p,
                p is not None and p > 0.05,
            )
        )
    schema = (
        "column string, kind string, total bigint, missing bigint, missing_pct double, unique_count bigint, "
        "unique_ratio double, " + ", ".join(f"{n} double" for n in NUMERIC_FIELDS) 
        + ", is_ordinal boolean, is_target boolean, normality_p double, is_normal boolean"
    )
    return _literal_rows(df, rows, schema)


def overview(df: DataFrame, target: str | None = None, mode: str = "exact") -> DataFrame:
    """(total_columns, numeric_columns, categorical_columns, with_outliers, with_missing), target left out."""
    cols = [c for c in df.columns if c != target]
    what = kinds(df)
    nums = [c for c in cols if what[c] == "numeric"]
    q = quantiles.fit(df, nums, [0.25, 0.75], mode)
    exprs = {}
    for c in cols:
        exprs[c, "missing"] = (_nulls(c) > 0).cast("int")
        if c in nums and q[c][0] is not None:
            lo, hi = quantiles.fences(*q[c])
            exprs[c, "outliers"] = ((F.count(ref(c)) > 4) & (count_if(_outside(c, lo, hi)) > 0)).cast("int")
    got = agg.fit(df, exprs)
    row = (
        len(cols),
        len(nums),
        sum(what[c] == "categorical" for c in cols),
        sum(v for (c, n), v in got.items() if n == "outliers"),
        sum(v for (c, n), v in got.items() if n == "missing"),
    )
    names = ("total_columns", "numeric_columns", "categorical_columns", "with_outliers", "with_missing")
    return _literal_rows(df, [row], ", ".join(f"{n} bigint" for n in names))
