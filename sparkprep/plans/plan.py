"""A plan: fitted steps that turn a raw table into a prepared one, stored as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lookup
from ..functions.columns import numeric, replace
from ..operators import encode, impute, outliers, transform
from .step import PHASES, Step

_SCHEMA = (
    "position int, phase string, column string, strategy string, "
    "params map<string,double>, mapping map<string,string>"
)


def fit_phase(
    df: DataFrame,
    phase: str,
    strategies: dict[str, str],
    target: str | None = None,
    **options,
) -> list[Step]:
    """Fitted steps of one phase on the table as it stands before the phase."""
    if phase == "sentinels":
        return [Step("sentinels", c, "null") for c in strategies]
    if phase == "outliers":
        named = {c: outliers.ALIASES.get(s, s) for c, s in strategies.items()}
        removing = [c for c, s in named.items() if s == "drop_rows"]
        steps = outliers.fit_drop(df, removing) if removing else []
        return steps + outliers.fit(df, {c: s for c, s in named.items() if c not in removing})
    if phase == "missing":
        return impute.fit(df, strategies, **options)
    if phase == "encoding":
        return encode.fit(df, strategies, target, **options)
    if phase == "transformations":
        return transform.fit(df, strategies, **options)
    raise ValueError(f"unknown phase {phase!r}, expected one of {PHASES}")


def apply_phase(df: DataFrame, phase: str, steps: list[Step]) -> DataFrame:
    """Steps of one phase as filters, one projection and the joins of its mappings. Starts no job."""
    if not steps:
        return df
    if phase == "sentinels":
        return outliers.sentinels(df, [s.column for s in steps])
    if phase == "outliers":
        for s in steps:
            cond = outliers.row_filter(s)
            df = df if cond is None else df.filter(cond)
        return replace(df, {s.column: outliers.expr(s) for s in steps})
    if phase == "missing":
        return impute._fill(df, steps)
    if phase == "encoding":
        return encode.transform(df, steps)
    return replace(df, {s.column: transform.expr(s) for s in steps})


@dataclass
class Plan:
    """Fitted steps in the order of the phases; ``transform`` works on batches and streams alike."""

    steps: list[Step] = field(default_factory=list)
    overrides: list[tuple[str, str]] = field(default_factory=list)  # (phase, column) the user decided

    def of(self, phase: str) -> list[Step]:
        return [s for s in self.steps if s.phase == phase]

    def transform(self, df: DataFrame) -> DataFrame:
        for phase in PHASES:
            df = apply_phase(df, phase, [s for s in self.of(phase) if s.column in df.columns])
        return df

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(position, phase, column, strategy, params, mapping): one row per step."""
        rows = [(i, s.phase, s.column, s.strategy, s.params, s.mapping) for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, _SCHEMA)

    def lookups(self, spark: SparkSession) -> DataFrame:
        """(position, value, n, code, mean) of the steps whose mapping is a table."""
        out = spark.createDataFrame([], "position int, value string, n bigint, code bigint, mean double")
        for i, s in enumerate(self.steps):
            if s.lookup is None:
                continue
            f = s.lookup.frame
            code = F.col("code").cast("bigint") if "code" in f.columns else F.lit(None).cast("bigint")
            mean = F.col("mean").cast("double") if "mean" in f.columns else F.lit(None).cast("double")
            out = out.unionByName(
                f.select(F.lit(i).alias("position"), "value", F.col("n").cast("bigint").alias("n"),
                         code.alias("code"), mean.alias("mean"))
            )
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).write.mode("overwrite").parquet(f"{path}/steps")
        self.lookups(spark).write.mode("overwrite").partitionBy("position").parquet(f"{path}/mappings")
        decided = spark.createDataFrame(self.overrides, "phase string, column string")
        decided.write.mode("overwrite").parquet(f"{path}/overrides")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Plan:
        steps = [
            Step(r["phase"], r["column"], r["strategy"], dict(r["params"]), dict(r["mapping"]))
            for r in spark.read.parquet(f"{path}/steps").orderBy("position").collect()
        ]
        wanted = [
            i for i, s in enumerate(steps)
            if s.strategy in ("label", "first_seen", "binary", "target", "smoothed_target")
        ]
        if wanted:
            stored = spark.read.schema(
                "value string, n bigint, code bigint, mean double, position int"
            ).parquet(f"{path}/mappings")
            keyed = stored.withColumn("column", F.col("position").cast("string")).drop("position")
            found = lookup.freeze(keyed, lookup.sizes(keyed, [str(i) for i in wanted]), stored=True)
            for i in wanted:
                steps[i].lookup = found[str(i)]
        decided = spark.read.schema("phase string, column string").parquet(f"{path}/overrides").collect()
        return Plan(steps, [(r["phase"], r["column"]) for r in decided])

    def shape(self, df: DataFrame) -> DataFrame:
        """(rows_before, columns_before, rows_after, columns_after) of applying the plan."""
        after = self.transform(df)
        row = (df.count(), len(df.columns), after.count(), len(after.columns))
        names = ("rows_before", "columns_before", "rows_after", "columns_after")
        return df.sparkSession.createDataFrame([row], ", ".join(f"{n} bigint" for n in names))

    def summary(self, spark: SparkSession) -> DataFrame:
        """(phase, strategy, columns, overridden) in the order in which phases run."""
        marked = [(s.phase, s.strategy, int((s.phase, s.column) in self.overrides)) for s in self.steps]
        table = spark.createDataFrame(marked, "phase string, strategy string, over int")
        place = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
        return (
            table.groupBy("phase", "strategy")
            .agg(F.count(F.lit(1)).alias("columns"), F.sum("over").alias("overridden"))
            .select(place.cast("int").alias("step"), "phase", "strategy", "columns", "overridden")
        )


def all_sentinels(df: DataFrame, target: str | None) -> dict[str, str]:
    return {c: "null" for c in numeric(df, exclude=[target] if target else [])}
