"""Metrics of scored tables. Counts are grouped first; curves use running sums over key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bins, order, quantiles
from ..functions.agg import count_if
from ..functions.columns import num, ref

OVERFIT_GAP, GOOD_GAP = 0.05, 0.02
HUBER_DELTA = 1.35


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(actual, predicted, n)."""
    return df.groupBy(ref(y).alias("actual"), ref(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., class, support, predicted, tp, precision, recall, f1) from the confusion counts."""
    by = by or []
    cells = (
        df.filter(ref(y).isNotNull() & ref(pred).isNotNull())
        .groupBy(*[ref(b) for b in by], ref(y).alias("_a"), ref(pred).cast(df.schema[y].dataType).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("_a") == F.col("_p"), F.col("_n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("_a").alias("class"), F.col("_n").alias("s"), zero.alias("p"), hit.alias("t")),
        F.struct(F.col("_p").alias("class"), zero.alias("s"), F.col("_n").alias("p"), zero.alias("t")),
    )
    table = (
        cells.select(*[ref(b) for b in by], F.inline(sides))
        .groupBy(*[ref(b) for b in by], "class")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    )
    precision, recall = _div(F.col("tp"), F.col("predicted")), _div(F.col("tp"), F.col("support"))
    table = table.withColumn("precision", precision).withColumn("recall", recall)
    f1 = _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return table.withColumn("f1", f1)


def classification(
    df: DataFrame, y: str, pred: str, average: str = "auto", positive: object = None, by: list[str] | None = None
) -> DataFrame:
    """(by..., accuracy, precision, recall, f1, specificity, averaging).

    The positive class is the larger label unless one is named. ``auto`` is binary for two classes and macro otherwise. Undefined ratios are 0; specificity is the recall
    of the negative class and 0 unless there are two classes.
    """
    by = by or []
    table = per_class(df, y, pred, by)
    n, support = F.sum("support"), F.col("support")

    def of_positive(c: Column) -> Column:
        if positive is None:
            return F.max_by(c, F.col("class"))
        return F.max(F.when(F.col("class") == F.lit(positive).cast(table.schema["class"].dataType), c))

    def of_others(c: str) -> Column:
        return F.sum(c) - F.coalesce(of_positive(F.col(c)), F.lit(0))

    aggs = [
        F.count(F.lit(1)).alias("_classes"),
        count_if(support > 0).alias("_actual"),
        _div(F.sum("tp"), n).alias("accuracy"),
        _div(of_others("tp"), of_others("support")).alias("_spec"),
    ]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.coalesce(of_positive(F.col(m)), F.lit(0.0)).alias(f"_binary_{m}"))
        aggs.append(F.avg(m).alias(f"_macro_{m}"))
        aggs.append(_div(F.sum(F.col(m) * support), n).alias(f"_weighted_{m}"))
    one = table.groupBy(*[ref(b) for b in by]).agg(*aggs) if by else table.agg(*aggs)
    if average == "auto":
        kind = F.when(F.col("_actual") == 2, "binary").otherwise("macro")
    else:
        kind = F.lit(average)

    def pick(m: str) -> Column:
        out = F.when(kind == "micro", F.col("accuracy"))
        for a in ("binary", "macro", "weighted"):
            out = out.when(kind == a, F.col(f"_{a}_{m}"))
        return out.alias(m)

    return one.select(
        *[ref(b) for b in by],
        "accuracy",
        pick("precision"),
        pick("recall"),
        pick("f1"),
        F.when(F.col("_classes") == 2, F.col("_spec")).otherwise(F.lit(0.0)).alias("specificity"),
        kind.alias("averaging"),
    )


# ---- ranking quality --------------------------------------------------------------------------------


def _by_score(df: DataFrame, y: str, score: str, positive: object, by: list[str] | None = None) -> DataFrame:
    """(by..., score, pos, neg, pos_upto, neg_upto): counts per distinct score and running sums over them.

    Grouping comes first, so a score shared by a third of the rows is one row of the running sum.
    """
    by = by or []
    hit = ref(y) == F.lit(positive).cast(df.schema[y].dataType)
    grouped = (
        df.filter(ref(y).isNotNull() & ref(score).isNotNull())
        .groupBy(*[ref(b) for b in by], num(score).alias("score"))
        .agg(count_if(hit).alias("pos"), count_if(~hit).alias("neg"))
    )
    sums = {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}
    return order.running(grouped, ["score"], sums, by, at_most=df.count())


def _auc() -> Column:
    under = (F.col("neg_upto") - F.col("neg")).cast("double") + F.col("neg").cast("double") / 2
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.try_divide(F.sum(F.col("pos").cast("double") * under), pairs)


def roc_auc(df: DataFrame, y: str, score: str, positive: object = 1) -> DataFrame:
    """(roc_auc): probability that a positive row scores above a negative one, ties count half."""
    return _by_score(df, y, score, positive).agg(_auc().alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, y: str, scores: dict[object, str]) -> DataFrame:
    """(roc_auc): mean over classes of the one-against-rest area; ``scores`` is {class: score column}."""
    cells = F.array(
        *[
            F.struct(
                F.lit(str(c)).alias("class"),
                (ref(y).cast("string") == F.lit(str(c))).cast("int").alias("hit"),
                num(s).alias("s"),
            )
            for c, s in scores.items()
        ]
    )
    long = df.filter(ref(y).isNotNull()).select(F.inline(cells))
    areas = _by_score(long, "hit", "s", 1, by=["class"]).groupBy("class").agg(_auc().alias("auc"))
    return areas.agg(F.avg("auc").alias("roc_auc"))


def roc_curve(df: DataFrame, y: str, score: str, positive: object = 1) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score, rows at or above it called positive; starts at infinity."""
    points = _by_score(df, y, score, positive)
    hit = ref(y) == F.lit(positive).cast(df.schema[y].dataType)
    totals = df.filter(ref(y).isNotNull() & ref(score).isNotNull()).agg(count_if(hit), count_if(~hit)).first()
    p, n = F.lit(totals[0]).cast("double"), F.lit(totals[1]).cast("double")
    tp = p - (F.col("pos_upto") - F.col("pos"))
    fp = n - (F.col("neg_upto") - F.col("neg"))
    curve = points.select(F.col("score").alias("threshold"), F.try_divide(fp, n).alias("fpr"), F.try_divide(tp, p).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return curve.unionByName(start)


def average_precision(df: DataFrame, y: str, score: str, positive: object = 1) -> DataFrame:
    """(average_precision): precision at every distinct score weighted by the recall gained there."""
    points = _by_score(df, y, score, positive)
    hit = ref(y) == F.lit(positive).cast(df.schema[y].dataType)
    totals = df.filter(ref(y).isNotNull() & ref(score).isNotNull()).agg(count_if(hit), count_if(~hit)).first()
    p, n = F.lit(totals[0]).cast("double"), F.lit(totals[1]).cast("double")
    tp = p - (F.col("pos_upto") - F.col("pos"))
    called = tp + n - (F.col("neg_upto") - F.col("neg"))
    gained = F.try_divide(F.col("pos").cast("double"), p) * F.try_divide(tp, called)
    return points.agg(F.sum(gained).alias("average_precision"))


def log_loss(df: DataFrame, y: str, score: str, positive: object = 1, eps: float = 1e-15) -> DataFrame:
    """(log_loss): mean negative log likelihood with clipped probabilities."""
    p = F.greatest(F.least(num(score), F.lit(1 - eps)), F.lit(eps))
    hit = ref(y) == F.lit(positive).cast(df.schema[y].dataType)
    loss = -F.when(hit, F.ln(p)).otherwise(F.ln(1 - p))
    return df.agg(F.avg(F.when(ref(y).isNotNull() & ref(score).isNotNull(), loss)).alias("log_loss"))


# ---- regression -------------------------------------------------------------------------------------


def regression(df: DataFrame, y: str, pred: str, k: int, by: list[str] | None = None) -> DataFrame:
    """(by..., mae, mse, rmse, mape, r2, adjusted_r2, huber); k is the number of features."""
    by = by or []
    t, e = num(y), num(y) - num(pred)
    size = F.abs(e)
    huber = F.when(size <= HUBER_DELTA, 0.5 * e * e).otherwise(HUBER_DELTA * size - 0.5 * HUBER_DELTA**2)
    base = F.when(t != 0, t).otherwise(F.lit(1.0))
    rows = df.filter(t.isNotNull() & num(pred).isNotNull())
    grouped = rows.groupBy(*[ref(b) for b in by]) if by else rows.groupBy()
    one = grouped.agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.avg(size).alias("mae"),
        F.avg(e * e).alias("mse"),
        (F.avg(F.abs(e / base)) * 100).alias("mape"),
        F.var_pop(t).alias("_var"),
        F.avg(huber).alias("huber"),
    )
    r2 = 1 - F.try_divide("mse", "_var")
    one = one.withColumn("r2", r2)
    adjusted = 1 - F.try_divide((1 - F.col("r2")) * (F.col("_n") - 1), F.col("_n") - F.lit(k) - 1)
    return one.select(
        *[ref(b) for b in by], "mae", "mse", F.sqrt("mse").alias("rmse"), "mape", "r2",
        adjusted.alias("adjusted_r2"), "huber",
    )


def compare_splits(
    df: DataFrame,
    y: str,
    pred: str,
    split: str,
    train: str = "train",
    test: str = "test",
    task: str = "classification",
    k: int = 1,
    average: str = "auto",
) -> DataFrame:
    """(metric, train, test, gap, verdict): every metric on both splits side by side, in one pass."""
    if task == "classification":
        names = ["accuracy", "precision", "recall", "f1", "specificity"]
        table = classification(df, y, pred, average, by=[split])
    else:
        names = ["mae", "mse", "rmse", "mape", "r2", "adjusted_r2", "huber"]
        table = regression(df, y, pred, k, by=[split])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    long = table.select(ref(split).alias("_split"), F.inline(rows))
    side = long.groupBy("metric").agg(
        F.max(F.when(F.col("_split") == train, F.col("value"))).alias("train"),
        F.max(F.when(F.col("_split") == test, F.col("value"))).alias("test"),
    )
    gap = F.col("train") - F.col("test")
    verdict = F.when(gap > OVERFIT_GAP, "overfitting").when(gap < GOOD_GAP, "good").otherwise("moderate")
    return side.withColumn("gap", gap).withColumn("verdict", verdict)


# ---- rank ordering ----------------------------------------------------------------------------------


def rank_ordering(
    df: DataFrame,
    y: str,
    score: str,
    n: int = 10,
    split: str | None = None,
    scope: str | None = None,
    mode: str = "exact",
) -> DataFrame:
    """Score buckets from 1 (lowest) with bad counts and rates, cumulative ones, and coverage.

    ``split``/``scope`` restrict the rows to one value of a split column.
    """
    if split is not None and scope is not None:
        df = df.filter(ref(split) == F.lit(scope))
    rows = df.filter(ref(score).isNotNull())
    edge = bins.merge_edges(quantiles.fit(rows, [score], [i / n for i in range(n + 1)], mode)[score])
    spot = bins.index(num(score), edge) if len(edge) > 1 else F.lit(0)
    table = (
        rows.groupBy((spot + 1).alias("bucket"))
        .agg(
            F.sum(num(y)).alias("bads"),
            F.count(F.lit(1)).alias("users"),
            F.avg(num(score)).alias("avg_score"),
            F.min(num(score)).alias("min_score"),
            F.max(num(score)).alias("max_score"),
        )
    )
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most n rows
    every = Window.partitionBy(F.lit(0))
    cum_bads, cum_users = F.sum("bads").over(upto), F.sum("users").over(upto)
    return table.select(
        "bucket",
        F.col("bads").cast("bigint").alias("bads"),
        "users",
        F.round(F.try_divide(F.col("bads"), F.col("users").cast("double")), 4).alias("bad_rate"),
        cum_bads.cast("bigint").alias("cum_bads"),
        cum_users.alias("cum_users"),
        F.round(F.try_divide(cum_bads, cum_users.cast("double")), 4).alias("cum_bad_rate"),
        F.round(cum_users / F.sum("users").over(every) * 100, 2).alias("coverage"),
        F.round("avg_score", 4).alias("avg_score"),
        F.round("min_score", 4).alias("min_score"),
        F.round("max_score", 4).alias("max_score"),
    )


def rank_models(scores: DataFrame, metric: str = "score", higher_is_better: bool = True) -> DataFrame:
    """(rank, model, metric, is_best, is_worst, improvement_pct over the worst) of a score table."""
    w = Window.orderBy(F.desc(metric) if higher_is_better else F.asc(metric), F.asc("model"))  # one row per model
    every = Window.partitionBy(F.lit(0))
    best = F.max(metric).over(every) if higher_is_better else F.min(metric).over(every)
    worst = F.min(metric).over(every) if higher_is_better else F.max(metric).over(every)
    gain = F.try_divide((best - worst) * 100.0, F.abs(worst))
    ranked = scores.select("model", F.col(metric), F.row_number().over(w).alias("rank"), gain.alias("improvement_pct"))
    return ranked.select(
        "rank",
        "model",
        metric,
        (F.col("rank") == 1).alias("is_best"),
        (F.col("rank") == F.count(F.lit(1)).over(every)).alias("is_worst"),
        "improvement_pct",
    )
