"""What selection did: the steps, the features after each of them, and a way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Ledger:
    """Feature lists after every step. A snapshot is a list of names, never a copy of the data."""

    def __init__(self, start: list[str], label: str = "after_cleaning"):
        self._steps: list[tuple[str, dict[str, float], list[str]]] = [(label, {}, list(start))]

    @property
    def features(self) -> list[str]:
        return self._steps[-1][2]

    def add(self, step: str, params: dict[str, float], features: list[str]) -> None:
        self._steps.append((step, dict(params), list(features)))

    def revert(self, label: str = "after_cleaning") -> list[str]:
        """Back to the named step; later steps are forgotten."""
        names = [s[0] for s in self._steps]
        self._steps = self._steps[: names.index(label) + 1]
        return self.features

    def select(self, df: DataFrame) -> DataFrame:
        """The current features of the saved table; Spark reads only these columns."""
        return df.select(*["`" + c.replace("`", "``") + "`" for c in self.features])

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(position, step, params, before, after, removed, total_reduction_pct).

        A step with threshold 0 that removed nothing only looked at the scores and is left out.
        """
        rows = []
        for i, (name, params, after) in enumerate(self._steps[1:], 1):
            rows.append((i, name, params, len(self._steps[i - 1][2]), len(after)))
        table = spark.createDataFrame(
            rows, "position int, step string, params map<string,double>, before int, after int"
        )
        table = table.withColumn("removed", F.col("before") - F.col("after"))
        threshold = F.element_at("params", F.lit("threshold"))
        looked = F.coalesce(threshold == 0, F.lit(False)) & (F.col("removed") == 0)
        start = F.lit(len(self._steps[0][2]))
        return table.filter(~looked).withColumn(
            "total_reduction_pct", F.try_divide((start - F.col("after")) * 100.0, start.cast("double"))
        )
