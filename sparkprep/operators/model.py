"""Splitting, training, scoring, comparing and storing models built from ``pyspark.ml`` stages."""

from __future__ import annotations

import math
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, IndexToString, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import num, numeric, ref
from ..session import checkpoint_dir
from . import evaluate

TEST_SHARE = 0.2
SEED = 42
MAX_CLASSES = 1_000  # classes are held on the driver
_TWO_CLASSES = ("gbt", "svm")  # estimators that know two classes only

_CLASSIFIERS = {
    "rf": lambda **o: RandomForestClassifier(seed=SEED, **{"numTrees": 100, "maxDepth": 10, **o}),
    "gbt": lambda **o: GBTClassifier(seed=SEED, **{"maxIter": 20, **o}),
    "mlp": lambda **o: MultilayerPerceptronClassifier(seed=SEED, **o),
    "dt": lambda **o: DecisionTreeClassifier(seed=SEED, **{"maxDepth": 5, **o}),
    "lr": lambda **o: LogisticRegression(**o),
    "svm": lambda **o: LinearSVC(**{"maxIter": 50, "regParam": 0.01, **o}),
}
_REGRESSORS = {
    "rf": lambda **o: RandomForestRegressor(seed=SEED, **{"numTrees": 100, "maxDepth": 10, **o}),
    "gbt": lambda **o: GBTRegressor(seed=SEED, **{"maxIter": 20, **o}),
    "dt": lambda **o: DecisionTreeRegressor(seed=SEED, **{"maxDepth": 5, **o}),
    "lr": lambda **o: LinearRegression(**o),
    "ridge": lambda **o: LinearRegression(**{"elasticNetParam": 0.0, "regParam": 1.0, **o}),
    "lasso": lambda **o: LinearRegression(**{"elasticNetParam": 1.0, "regParam": 1.0, **o}),
}
_WEIGHED = ("gbt", "lr", "rf", "svm")  # classifiers that take equal rows as one row with a weight
MERGE_AT = 10  # equal rows are merged where there are so many to one on average
BAG_UNITS = 100_000  # rows a forest's bags draw from, where equal rows can be merged to so few
_SCALED = ("mlp", "lr", "svm", "ridge", "lasso")  # sensitive to the size of the features


def split(df: DataFrame, key: list[str], test: float = TEST_SHARE, name: str = "split") -> DataFrame:
    """Adds ``train`` / ``test`` by a hash of the key as text: the same row lands on the same side in any engine."""
    limit = round(test * 10_000)
    text = F.concat_ws("|", *[F.coalesce(ref(k).cast("string"), F.lit("")) for k in key], F.lit(str(SEED)))
    spot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10_000
    return df.withColumn(name, F.when(spot < limit, "test").otherwise("train"))


def split_by(df: DataFrame, key: str, of: int = 10, test: int = 2, name: str = "split") -> DataFrame:
    """The same with plain arithmetic on a whole-number key: ``test`` parts out of ``of``."""
    return df.withColumn(name, F.when(F.pmod(ref(key), F.lit(of)) < test, "test").otherwise("train"))


def features_of(df: DataFrame, target: str, features: list[str] | None = None) -> list[str]:
    return numeric(df, exclude=[target]) if features is None else features


def build(
    df: DataFrame,
    target: str,
    name: str,
    task: str = "classification",
    features: list[str] | None = None,
    labels: list[str] | None = None,
    **options,
) -> Pipeline:
    """Unfitted stages: cast, fill with the mean, assemble, scale where needed, estimate.

    ``labels`` are the classes in order, read from the target where they are not given. Models for two classes are
    trained once per class, against the rest, where there are more.
    """
    cols = features_of(df, target, features)
    table = _CLASSIFIERS if task == "classification" else _REGRESSORS
    if name not in table:
        raise ValueError(f"unknown model {name!r} for {task}, expected one of {sorted(table)}")
    casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `_f_{i}`" for i, c in enumerate(cols))
    raw = [f"_f_{i}" for i in range(len(cols))]
    filled = [f"_i_{i}" for i in range(len(cols))]
    stages = [
        SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
        Imputer(inputCols=raw, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="_features"),
    ]
    vector = "_features"
    if name in _SCALED:
        stages.append(StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True))
        vector = "_scaled"
    if task == "classification":
        labels = classes(df, target) if labels is None else labels
        if name == "mlp" and "layers" not in options:
            options["layers"] = [len(cols), max(8, 2 * len(cols)), len(labels)]
        estimator = table[name](**options)
        estimator.setFeaturesCol(vector).setLabelCol("_label").setPredictionCol("_predicted")
        if name in _TWO_CLASSES and len(labels) > 2:
            estimator = OneVsRest(classifier=estimator, featuresCol=vector, labelCol="_label", predictionCol="_predicted")
        stages += [estimator, IndexToString(inputCol="_predicted", outputCol="predictions", labels=list(labels))]
    else:
        estimator = table[name](**options)
        estimator.setFeaturesCol(vector).setLabelCol("_label").setPredictionCol("predictions")
        stages.append(estimator)
    return Pipeline(stages=stages)


def classes(df: DataFrame, target: str) -> list[str]:
    """The classes of a target in alphabetical order; more than MAX_CLASSES are an error."""
    seen = df.select(ref(target).cast("string").alias("c")).filter("c is not null").distinct().limit(MAX_CLASSES + 1)
    found = sorted(r["c"] for r in seen.collect())
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return found


def labelled(df: DataFrame, target: str, task: str, labels: list[str] | None = None) -> DataFrame:
    """Rows with a target, and the label column training needs. Scoring needs neither."""
    known = df.filter(ref(target).isNotNull())
    if task != "classification":
        return known.withColumn("_label", num(target))
    labels = classes(df, target) if labels is None else labels
    return StringIndexerModel.from_labels(labels, inputCol=target, outputCol="_label").transform(known)


def train(
    df: DataFrame,
    target: str,
    name: str,
    task: str = "classification",
    features: list[str] | None = None,
    **options,
) -> PipelineModel:
    """Fitted model with all its preparation stages."""
    cols = features_of(df, target, features)
    labels = classes(df, target) if task == "classification" else None
    data = labelled(df.select(*[ref(c) for c in cols], ref(target)), target, task, labels)
    flow = build(df, target, name, task, cols, labels, **options)
    if task != "classification" or name not in _WEIGHED:
        return flow.fit(data)
    *first, estimator, last = flow.getStages()
    ready = Pipeline(stages=first).fit(data)
    rows, weight = _merged(ready.transform(data), [f"_i_{i}" for i in range(len(cols))], estimator.getFeaturesCol(), name)
    fitted = (estimator.setWeightCol(weight) if weight else estimator).fit(rows)
    return PipelineModel([*ready.stages, fitted, last])


def _merged(data: DataFrame, cols: list[str], vector: str, name: str) -> tuple[DataFrame, str | None]:
    """The rows an estimator learns from, and the column of their weights, None where they have none.

    Every step of an estimator reads all its rows. Where few of them differ they are counted once, and the steps read the
    different ones with their counts, which gives the same sums. A forest draws rows for its bags: its rows are merged
    only as far as BAG_UNITS units of equal rows are left.
    """
    key = F.xxhash64(*cols, "_label")
    n, different = data.agg(F.count(F.lit(1)), F.approx_count_distinct(key)).first()
    unit = n // BAG_UNITS if name == "rf" else n
    if different * MERGE_AT > n or unit <= 1:
        return data, None
    cells = data.groupBy(*cols, "_label").agg(F.any_value(vector).alias(vector), F.count(F.lit(1)).alias("_n"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(unit).cast("long"))).alias("_start")
    units = cells.select(vector, "_label", "_n", start).repartition(math.ceil((different + (n // unit)) / BAG_UNITS))
    return units.select(vector, "_label", F.least(F.col("_n") - F.col("_start"), F.lit(unit)).cast("double").alias("_weight")), "_weight"


def score(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predictions`` and ``predictions_probability``.

    The probability is that of the second class for two classes and of the predicted class otherwise. A
    margin classifier, and models of one class against the rest, give their margin (for more classes that of the
    predicted one) instead, which ranks rows as well; regressions give null.
    """
    out = fitted.transform(df)
    made = out.columns
    if "probability" in made:
        p = vector_to_array("probability")
        value = F.when(F.size(p) == 2, F.get(p, F.lit(1))).otherwise(F.get(p, F.col("_predicted").cast("int")))
    elif "rawPrediction" in made:
        raw = vector_to_array("rawPrediction")
        value = F.when(F.size(raw) == 2, F.get(raw, F.lit(1))).otherwise(F.get(raw, F.col("_predicted").cast("int")))
    else:
        value = F.lit(None).cast("double")
    return out.select(*[ref(c) for c in df.columns], "predictions", value.alias("predictions_probability"))


def compare(
    df: DataFrame,
    target: str,
    names: list[str],
    metric: str | None = None,
    task: str = "classification",
    features: list[str] | None = None,
    split_column: str = "split",
) -> DataFrame:
    """Train each model on the train rows, score the test rows, and rank them by one metric.

    Classification: accuracy, precision, recall, f1 (weighted). Regression: the usual errors and r2.
    """
    if len(names) < 2:
        raise ValueError("a comparison needs at least two models")
    cols = features_of(df, target, features)
    metric = metric or ("accuracy" if task == "classification" else "r2")
    slim = df.select(*[ref(c) for c in cols], ref(target), ref(split_column)).persist()
    parts = None
    try:
        learn, hold = (slim.filter(ref(split_column) == s) for s in ("train", "test"))
        for name in names:
            scored = score(train(learn, target, name, task, cols), hold)
            if task == "classification":
                one = evaluate.classification(scored, target, "predictions", average="weighted")
            else:
                one = evaluate.regression(scored, target, "predictions", len(cols))
            row = one.select(F.lit(name).alias("model"), F.col(metric).alias("score")).first()
            parts = [*(parts or []), (row["model"], row["score"])]
    finally:
        slim.unpersist()
    table = df.sparkSession.createDataFrame(parts, "model string, score double")
    return evaluate.rank_models(table, "score", metric not in ("mae", "mse", "rmse", "mape", "huber"))


def save(fitted: PipelineModel, root: str, run: str, name: str) -> str:
    """Store under ``root/run/name`` and return the path."""
    path = f"{root.rstrip('/')}/{run}/{name}"
    fitted.write().overwrite().save(path)
    return path


def load(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)


def newest(spark: SparkSession, root: str, run: str) -> str | None:
    """Path of the model of a run written last, by the time of its metadata."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(f"{root.rstrip('/')}/{run}/*/metadata")
        .select("path", "modificationTime")
        .orderBy(F.desc("modificationTime"), F.desc("path"))
        .limit(1)
        .collect()
    )
    return found[0]["path"].rsplit("/metadata/", 1)[0] if found else None


def tree_rules(fitted: PipelineModel, features: list[str]) -> DataFrame:
    """(node, depth, parent, side, feature, threshold, share, prediction) of the fitted decision tree.

    Read from the node table Spark stores with the model; a tree of depth d has fewer than 2^(d+1) nodes.
    """
    tree = next(s for s in fitted.stages if hasattr(s, "toDebugString"))
    spark = SparkSession.getActiveSession()
    path = f"{checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    tree.write().save(path)
    nodes = {r["id"]: r for r in spark.read.parquet(f"{path}/data").collect()}
    total = nodes[0]["rawCount"]
    rows: list[tuple] = []
    open_nodes = [(0, 0, None, None)]
    while open_nodes:
        i, depth, parent, side = open_nodes.pop()
        r = nodes[i]
        leaf = r["leftChild"] < 0
        cut = r["split"]
        points = cut["leftCategoriesOrThreshold"]
        rows.append(
            (
                i,
                depth,
                parent,
                side,
                None if leaf else features[cut["featureIndex"]],
                None if leaf or not points else float(points[0]),
                r["rawCount"] / total if total else None,
                float(r["prediction"]),
            )
        )
        if not leaf:
            open_nodes += [(r["leftChild"], depth + 1, i, "left"), (r["rightChild"], depth + 1, i, "right")]
    return spark.createDataFrame(
        sorted(rows),
        "node int, depth int, parent int, side string, feature string, threshold double, share double, "
        "prediction double",
    )


def tune(
    df: DataFrame,
    target: str,
    name: str,
    grid: dict[str, list],
    folds: int = 3,
    task: str = "classification",
    features: list[str] | None = None,
    metric: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Best model over a parameter grid by cross validation, and (params, score) of every point tried."""
    cols = features_of(df, target, features)
    labels = classes(df, target) if task == "classification" else None
    data = labelled(df.select(*[ref(c) for c in cols], ref(target)), target, task, labels).persist()
    try:
        flow = build(df, target, name, task, cols, labels)
        estimator = next(s for s in flow.getStages() if s.hasParam("labelCol"))
        points = ParamGridBuilder()
        for p, values in grid.items():
            points = points.addGrid(estimator.getParam(p), values)
        maps = points.build()
        if task == "classification":
            check = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="_predicted", metricName=metric or "accuracy")
        else:
            check = RegressionEvaluator(labelCol="_label", predictionCol="predictions", metricName=metric or "r2")
        search = CrossValidator(
            estimator=flow, estimatorParamMaps=maps, evaluator=check, numFolds=folds, seed=SEED, parallelism=2
        ).fit(data)
    finally:
        data.unpersist()
    rows = [({k.name: str(v) for k, v in m.items()}, float(s)) for m, s in zip(maps, search.avgMetrics)]
    return search.bestModel, df.sparkSession.createDataFrame(rows, "params map<string,string>, score double")
