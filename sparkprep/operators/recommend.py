"""Strategy per column from its profile: fixed rules, a cautious fallback, and what the user said.

Every function is a projection of the profile frame (one row per column), so the rules cost nothing next to
the profile itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import any_of

CONFIDENT = 0.8  # rules at or above this are final

# Parts of column names the rules look for.
KEEP_NAMES = ("id", "account", "balance", "amount", "price", "income", "revenue", "cost")
KEY_NAMES = ("id", "key", "uuid", "guid")
DATE_NAMES = ("date", "time", "timestamp", "created", "updated", "birth", "till", "year", "month", "day")
PLACE_NAMES = ("city", "state", "country", "region", "location", "zip", "postal")
MONEY_NAMES = ("amount", "price", "income", "balance", "cost", "revenue")

PHASES = ("outliers", "missing", "encoding", "transformations")


def _named(parts: tuple[str, ...], word_match: bool = False) -> Column:
    """Name contains a part; with ``word_match`` as a whole word between underscores, dots or blanks."""
    name = F.lower("column")
    if not word_match:
        return any_of(name, parts)
    return F.arrays_overlap(F.split(name, "[^a-z0-9]+"), F.array(*[F.lit(p) for p in parts]))


def _chain(df: DataFrame, rules: list[tuple[Column, str, float, str]], otherwise: tuple[str, float, str]) -> DataFrame:
    """First matching rule per row as (column, strategy, confidence, reason)."""
    pick = None
    for cond, *value in rules:
        found = _choice(*value)
        pick = F.when(cond, found) if pick is None else pick.when(cond, found)
    return df.select("column", pick.otherwise(_choice(*otherwise)).alias("_r")).select("column", "_r.*")


def _choice(strategy: str, confidence: float, reason: str) -> Column:
    return F.struct(
        F.lit(strategy).alias("strategy"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(reason).alias("reason"),
    )


_GRAY = ("uncertain", 0.5, "needs a decision in context")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def outliers(profile: DataFrame, word_match: bool = False) -> DataFrame:
    """Rules for numeric columns with interquartile outliers."""
    share, extreme = _zero("outlier_pct"), _zero("extreme_pct")
    todo = profile.filter((F.col("kind") == "numeric") & ~F.col("is_target") & (share > 0))
    return _chain(
        todo,
        [
            (extreme > 5, "winsorize", 0.90, "many extreme values"),
            (share > 15, "winsorize", 0.90, "very many outliers"),
            (share < 2, "keep", 0.85, "few outliers"),
            (_named(KEEP_NAMES, word_match), "keep", 0.80, "extreme values are expected here"),
        ],
        _GRAY,
    )


def missing(profile: DataFrame, word_match: bool = False) -> DataFrame:
    """Rules for columns with nulls."""
    share, ratio = F.col("missing_pct"), F.col("unique_ratio")
    is_num = F.col("kind") == "numeric"
    skew = F.when(is_num, F.abs(_zero("skewness"))).otherwise(F.lit(0.0))
    return _chain(
        profile.filter(F.col("missing") > 0),
        [
            (share > 80, "constant", 0.95, "mostly missing"),
            (_named(KEY_NAMES, word_match), "constant", 0.95, "identifier"),
            ((share < 5) & is_num & (skew < 1), "mean", 0.85, "few missing, symmetric"),
            ((share < 5) & is_num, "median", 0.85, "few missing, skewed"),
            (~is_num & (share < 10) & (ratio < 0.1), "mode", 0.80, "few missing, few categories"),
            (~is_num & (ratio > 0.8), "constant", 0.85, "nearly unique text"),
        ],
        _GRAY,
    )


def encoding(profile: DataFrame, word_match: bool = False) -> DataFrame:
    """Rules for text columns."""
    todo = profile.filter((F.col("kind") == "categorical") & ~F.col("is_target"))
    return _chain(
        todo,
        [
            (F.col("unique_ratio") > 0.25, "skip", 0.95, "too many categories"),
            (_named(DATE_NAMES, word_match), "skip", 0.90, "date in text form"),
            (F.col("unique_count") <= 3, "label", 0.90, "very few categories"),
            (_named(PLACE_NAMES, word_match), "target", 0.80, "place"),
            (F.col("is_ordinal"), "label", 0.80, "ordered categories"),
        ],
        _GRAY,
    )


def transforms(profile: DataFrame, word_match: bool = False) -> DataFrame:
    """Rules for numeric columns that are not near normal already."""
    skew, kurt = F.abs(_zero("skewness")), F.abs(_zero("kurtosis"))
    low = F.col("p1")
    negative = F.coalesce(low, F.lit(0.0)) < 0
    zero = F.coalesce(low, F.lit(1.0)) <= 0
    normal = (skew < 1) & (kurt < 5) & F.col("is_normal")
    todo = profile.filter((F.col("kind") == "numeric") & ~F.col("is_target") & ~normal)
    return _chain(
        todo,
        [
            ((skew < 1.5) & (kurt < 7), "none", 0.90, "near normal"),
            (skew > 5, "yeo_johnson", 0.90, "extreme skew"),
            ((skew > 1) & (skew < 3) & ~zero & ~negative, "log", 0.85, "skewed, positive"),
            ((skew > 2) & zero & ~negative, "log1p", 0.85, "skewed, with zeros"),
            (
                _named(MONEY_NAMES, word_match) & (skew > 1) & (skew < 4) & ~negative,
                "sqrt",
                0.80,
                "money with moderate skew",
            ),
        ],
        _GRAY,
    )


RULES = {"outliers": outliers, "missing": missing, "encoding": encoding, "transformations": transforms}


def fallback(profile: DataFrame, phase: str) -> DataFrame:
    """(column, strategy) of the cautious choice for columns the rules leave open."""
    is_num = F.col("kind") == "numeric"
    if phase == "outliers":
        pick = F.when(_zero("outlier_pct") > 5, "winsorize").otherwise("keep")
    elif phase == "missing":
        pick = F.when(F.col("missing_pct") > 50, "constant").when(is_num, "median").otherwise("mode")
    elif phase == "encoding":
        pick = F.when(F.col("unique_count") <= 15, "onehot").otherwise("target")
    elif phase == "transformations":
        pick = F.when(F.abs(_zero("skewness")) > 2, "log1p").otherwise("none")
    else:
        raise ValueError(f"unknown phase {phase!r}")
    return profile.select("column", pick.alias("strategy"))


def simple(profile: DataFrame, phase: str, chunked: bool = False) -> DataFrame:
    """(column, strategy) of the plain threshold defaults; ``chunked`` is their variant for wide tables."""
    kind, skew, count = F.col("kind"), _zero("skewness"), F.col("unique_count")
    if phase == "outliers":
        share = _zero("outlier_pct")
        todo = profile.filter(kind == "numeric")
        pick = F.when((share > 20) | (skew > 2) | (share > 10), "winsorize").otherwise("keep")
    elif phase == "missing":
        todo = profile.filter(F.col("missing") > 0)
        pick = (
            F.when(kind == "categorical", "mode")
            .when(kind == "numeric", F.when(F.col("missing_pct") > 50, "constant").otherwise("median"))
            .otherwise("mode")
        )
    elif phase == "encoding":
        todo = profile.filter(kind == "categorical")
        pick = F.when(count > 1000, "skip").when(count > 50, "target").when(count > 10, "onehot").otherwise("label")
    elif phase == "transformations":
        todo = profile.filter(kind == "numeric")
        if chunked:
            pick = (
                F.when(F.abs(skew) > 2, "log1p")
                .when(F.abs(skew) > 1, "sqrt")
                .when(F.abs(_zero("kurtosis")) > 5, "standardize")
                .otherwise("none")
            )
        else:
            pick = F.when(skew > 2, "log1p").when(skew > 1, "sqrt").when(skew < -1, "square").otherwise("standardize")
    else:
        raise ValueError(f"unknown phase {phase!r}")
    return todo.filter(~F.col("is_target")).select("column", pick.alias("strategy"))


def resolve(rules: DataFrame, fallback: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(column, strategy, source): the user's choice, else a confident rule, else the fallback."""
    out = rules.select("column", F.col("strategy").alias("_rule"), "confidence").join(
        fallback.select("column", F.col("strategy").alias("_fallback")), "column", "left"
    )
    if overrides is None:
        out = out.withColumn("_user", F.lit(None).cast("string"))
    else:
        out = out.join(overrides.select("column", F.col("strategy").alias("_user")), "column", "left")
    sure = F.col("confidence") >= CONFIDENT
    return out.select(
        "column",
        F.when(F.col("_user").isNotNull(), F.col("_user"))
        .when(sure, F.col("_rule"))
        .otherwise(F.col("_fallback"))
        .alias("strategy"),
        F.when(F.col("_user").isNotNull(), "user").when(sure, "rule").otherwise("fallback").alias("source"),
    )
