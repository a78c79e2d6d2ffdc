"""From a raw table to a plan: each phase is profiled and fitted on the output of the one before it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..functions import agg
from ..functions.columns import categorical, numeric, ref
from ..operators import features, model as models, profile, recommend
from ..session import written
from .ledger import Ledger
from .plan import Plan, all_sentinels, apply_phase, fit_phase
from .step import PHASES


@dataclass
class Prep:
    """Rules, fallback and overrides for every phase.

    ``overrides`` is {phase: {column: strategy}}. ``write_between`` stores the table after each phase in the
    shared folder (the default), since every fit of the next phase reads it again.
    """

    target: str
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)
    phases: tuple[str, ...] = PHASES
    approx: bool = False
    write_between: bool = True

    def strategies(self, df: DataFrame, phase: str) -> dict[str, str]:
        """{column: strategy} of one phase on the current table; the target is never treated."""
        if phase == "sentinels":
            return all_sentinels(df, self.target)
        table = self.profile(df, phase)
        rules = recommend.RULES[phase](table)
        given = {c: s for c, s in self.overrides.get(phase, {}).items() if c in df.columns}
        user = None
        if given:
            user = df.sparkSession.createDataFrame(list(given.items()), "column string, strategy string")
        if table.isEmpty():
            return {c: s for c, s in given.items() if c != self.target}
        picked = recommend.resolve(rules, recommend.fallback(table, phase), user).collect()
        out = {r["column"]: r["strategy"] for r in picked if r["column"] != self.target}
        return {**out, **{c: s for c, s in given.items() if c != self.target}}

    def profile(self, df: DataFrame, phase: str) -> DataFrame:
        """Only the columns the rules of the phase look at, and distinct values only where they count."""
        if phase in ("outliers", "transformations"):
            cols = numeric(df, [self.target])
        elif phase == "encoding":
            cols = categorical(df, [self.target])
        else:
            nulls = agg.fit(df, {c: agg.count_if(ref(c).isNull()) for c in df.columns if c != self.target})
            cols = [c for c, n in nulls.items() if n]
        unique = phase in ("missing", "encoding")
        return profile.full(df, self.target, cols, approx=self.approx, unique_counts=unique)

    def fit_transform(self, df: DataFrame) -> tuple[Plan, DataFrame]:
        plan = Plan(overrides=[(p, c) for p, m in self.overrides.items() for c in m])
        for phase in self.phases:
            steps = fit_phase(df, phase, self.strategies(df, phase), self.target)
            plan.steps += steps
            df = apply_phase(df, phase, steps)
            if self.write_between:
                df = written(df)
        return plan, df

    def fit(self, df: DataFrame) -> Plan:
        return self.fit_transform(df)[0]


@dataclass
class Prepared:
    plan: Plan
    table: DataFrame
    ledger: Ledger
    model: PipelineModel | None = None


def fast(
    df: DataFrame,
    target: str,
    min_iv: float = 0.02,
    max_vif: float = 5.0,
    approx: bool = False,
    write_between: bool = True,
    learner: str | None = "dt",
) -> Prepared:
    """Sentinels, outliers, missing values, encoding, selection by information value and inflation, and a model.

    ``learner`` names the model trained on what is left, a tree of depth 5 unless another is asked for; None trains none,
    and neither does a table without features.
    """
    phases = tuple(p for p in PHASES if p != "transformations")
    prep = Prep(target, phases=phases, approx=approx, write_between=write_between)
    plan, table = prep.fit_transform(df)
    ledger = Ledger(table.columns)
    table = features.drop_constant(table, target)
    ledger.add("drop_constant", {}, table.columns)
    table = features.numeric_only(table, target)
    ledger.add("numeric_only", {}, table.columns)
    table = features.filter_iv(table, target, min_iv)
    ledger.add("iv", {"threshold": min_iv}, table.columns)
    if len(table.columns) > 2:
        table = features.filter_vif(table, target, max_vif)
        ledger.add("vif", {"threshold": max_vif}, table.columns)
    model = None
    if learner and len(table.columns) > 1:
        task = "classification" if features.is_classification(table, target) else "regression"
        model = models.train(table, target, learner, task)
    return Prepared(plan, table, ledger, model)
