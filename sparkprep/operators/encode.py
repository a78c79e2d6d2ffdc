"""Categorical encodings: the fitted mapping is a small table per column, applied as a projection or a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import agg, counts, lookup, order
from ..functions.columns import kind, num, ref, replace
from ..plans.step import Step

NULL_TEXT = "nan"  # fixed value: missing categories are coded as this text
OTHER = "Other"  # fixed value: the name of the rest in a top-k one-hot encoding
ONEHOT_LIMIT = 10
SMOOTHING = 10.0

ALIASES = {
    "label_encoding": "label",
    "ordinal": "label",
    "onehot_encoding": "onehot",
    "one_hot": "onehot",
    "target_encoding": "target",
    "binary_encoding": "binary",
    "drop_column": "drop",
    "leave_as_is": "skip",
    "none": "skip",
    "keep": "skip",
}
KNOWN = ("label", "first_seen", "onehot", "target", "smoothed_target", "binary", "drop", "skip")


def normalize_name(strategy: str) -> str:
    s = str(strategy).lower().replace("-", "_")
    return ALIASES.get(s, s)


def _text(name: str) -> Column:
    return F.coalesce(ref(name).cast("string"), F.lit(NULL_TEXT))


def _codes(counted: DataFrame, cols: list[str], keys: list[str]) -> dict[str, lookup.Lookup]:
    """Position of every value within its column in the order of ``keys``."""
    counted = lookup.settle(counted)
    ranked = order.rank(counted, keys, "code", by=["column"], stored=True)
    return lookup.freeze(ranked.select("column", "value", "n", "code"), lookup.sizes(counted, cols))


def fit_label(df: DataFrame, cols: list[str]) -> dict[str, lookup.Lookup]:
    """Codes in code-point order of the distinct values."""
    texts = df.select(*[_text(c).alias(c) for c in cols])
    return _codes(counts.value_counts(texts, cols), cols, ["value"])


def fit_first_seen(df: DataFrame, cols: list[str], order_by: list[str]) -> dict[str, lookup.Lookup]:
    """Codes in the order in which the values first appear."""
    if not order_by:
        raise ValueError("codes by first appearance need an order column")
    base = df.select(*[_text(c).alias(c) for c in cols], *[ref(o).alias(f"_o{i}") for i, o in enumerate(order_by)])
    at = F.struct(*[F.col(f"_o{i}") for i in range(len(order_by))])
    counted = counts.value_counts(base, cols, {"first": F.min("_at")}, keep={"_at": at})
    keys = [f"_f{i}" for i in range(len(order_by))]
    flat = counted.select("column", "value", "n", *[F.col("first")[f"_o{i}"].alias(k) for i, k in enumerate(keys)])
    return _codes(flat, cols, [*keys, "value"])


def fit_target(
    df: DataFrame, cols: list[str], target: str, smoothing: float = 0.0
) -> tuple[dict[str, lookup.Lookup], float]:
    """Mean target per value (shrunk to the overall mean by ``smoothing`` pseudo-rows) and the overall mean."""
    overall = agg.fit(df, {"m": F.avg(num(target))})["m"]
    texts = df.select(*[ref(c).cast("string").alias(c) for c in cols], num(target).alias("_t"))
    counted = counts.value_counts(
        texts, cols, {"seen": F.count("_t"), "total": F.sum("_t")}, keep={"_t": F.col("_t")}
    ).filter(F.col("value").isNotNull())
    shrunk = F.try_divide(
        F.coalesce(F.col("total"), F.lit(0.0)) + F.lit(float(smoothing)) * F.lit(overall),
        F.col("seen") + F.lit(float(smoothing)),
    )
    counted = lookup.settle(counted)
    mapping = counted.select("column", "value", "n", shrunk.alias("mean"))
    return lookup.freeze(mapping, lookup.sizes(counted, cols)), overall


def fit_onehot(df: DataFrame, cols: list[str], top: int = ONEHOT_LIMIT) -> dict[str, tuple[list[str], bool]]:
    """Values that get a column, sorted, and whether the rest is grouped: at most ``top`` + 1 per column."""
    texts = df.select(*[ref(c).cast("string").alias(c) for c in cols])
    found: dict[str, list[str]] = {c: [] for c in cols}
    for r in counts.top(counts.value_counts(texts, cols), top + 1).orderBy("column", "rank").collect():
        found[r["column"]].append(r["value"])
    return {c: (sorted(v[:top]), len(v) > top) for c, v in found.items()}


def fit(
    df: DataFrame,
    strategies: dict[str, str],
    target: str | None = None,
    order_by: list[str] | None = None,
    smoothing: float = SMOOTHING,
    top: int = ONEHOT_LIMIT,
) -> list[Step]:
    """Mappings of every column, one count per kind of encoding. Numeric columns are skipped."""
    named = {}
    for c, s in strategies.items():
        if kind(df.schema[c].dataType) == "numeric":
            continue
        s = normalize_name(s)
        if s not in KNOWN:
            s = "skip"
        if s in ("target", "smoothed_target") and (target is None or target not in df.columns):
            s = "label"
        named[c] = s
    of = lambda *names: [c for c, s in named.items() if s in names]
    tables: dict[str, lookup.Lookup] = {}
    params: dict[str, dict[str, float]] = {c: {} for c in named}
    texts: dict[str, dict[str, str]] = {c: {} for c in named}
    if cols := of("label", "binary"):
        tables.update(fit_label(df, cols))
    if cols := of("first_seen"):
        tables.update(fit_first_seen(df, cols, order_by or []))
    for name, weight in (("target", 0.0), ("smoothed_target", smoothing)):
        if cols := of(name):
            found, overall = fit_target(df, cols, target, weight)
            tables.update(found)
            for c in cols:
                params[c]["overall"] = overall
    if cols := of("onehot"):
        for c, (values, rest) in fit_onehot(df, cols, top).items():
            params[c]["grouped"] = float(rest)
            texts[c] = {f"v{i}": v for i, v in enumerate(values)}
    for c in of("binary"):
        if tables[c].rows <= 1:
            named[c] = "label"
        else:
            params[c]["bits"] = float((tables[c].rows - 1).bit_length())
    return [Step("encoding", c, s, params[c], texts[c], tables.get(c)) for c, s in named.items()]


def onehot_columns(step: Step) -> dict[str, Column]:
    """0/1 columns ``column_value``; null is all zero, or part of the rest where there is one."""
    c = ref(step.column).cast("string")
    values = [step.mapping[f"v{i}"] for i in range(len(step.mapping))]
    out = {v: F.when(c == F.lit(v), F.lit(1)).otherwise(F.lit(0)) for v in values}
    if step.params.get("grouped"):
        known = c.isin(*values)
        rest = F.when(known, F.lit(0)).otherwise(F.lit(1))
        out[OTHER] = F.greatest(out[OTHER], rest) if OTHER in out else rest
    return {f"{step.column}_{v}": out[v] for v in sorted(out)}


def transform(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Apply fitted encodings: joins for the mappings, then one projection."""
    new: dict[str, Column] = {}
    added: dict[str, Column] = {}
    gone: list[str] = []
    names = df.columns
    for i, s in enumerate(steps):
        pre = f"_enc{i}_"
        if s.strategy in ("label", "first_seen", "binary"):
            df = lookup.join(df, _text(s.column), s.lookup, pre)
            code = ref(pre + "code")
            if s.strategy == "binary":
                gone.append(s.column)
                for b in range(int(s.params["bits"])):
                    bit = F.shiftright(code, b).bitwiseAND(F.lit(1)).cast("int")
                    added[f"{s.column}_binary_{b}"] = bit
            else:
                new[s.column] = code
        elif s.strategy in ("target", "smoothed_target"):
            df = lookup.join(df, ref(s.column).cast("string"), s.lookup, pre)
            new[s.column] = F.coalesce(ref(pre + "mean"), F.lit(s.params["overall"]))
        elif s.strategy == "onehot":
            gone.append(s.column)
            added.update(onehot_columns(s))
        elif s.strategy == "drop":
            gone.append(s.column)
    kept = [new[n].alias(n) if n in new else ref(n) for n in names if n not in gone]
    return df.select(*kept, *[e.alias(n) for n, e in added.items()])


def apply(df: DataFrame, strategies: dict[str, str], target: str | None = None, **options) -> DataFrame:
    """Named encoding per column."""
    return transform(df, fit(df, strategies, target, **options))


def label(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply(df, {c: "label" for c in cols})


def ordinal(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """Code by order of first appearance."""
    return apply(df, {c: "first_seen" for c in cols}, order_by=order_by)


def onehot(df: DataFrame, cols: list[str], top: int = ONEHOT_LIMIT) -> DataFrame:
    return apply(df, {c: "onehot" for c in cols}, top=top)


def target(df: DataFrame, cols: list[str], target: str, smoothing: float = 0.0) -> DataFrame:
    """Mean target per value; nulls and unknown values get the overall mean."""
    name = "smoothed_target" if smoothing else "target"
    return apply(df, {c: name for c in cols}, target, smoothing=smoothing)


def binary(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply(df, {c: "binary" for c in cols})


def dictionary(steps: list[Step]) -> DataFrame:
    """(column, strategy, value, code, mean, bits, n) of every fitted mapping held as a table."""
    parts = []
    for s in steps:
        if s.lookup is None:
            continue
        f = s.lookup.frame
        code = F.col("code").cast("bigint") if "code" in f.columns else F.lit(None).cast("bigint")
        mean = F.col("mean") if "mean" in f.columns else F.lit(None).cast("double")
        bits = F.lit(None).cast("string")
        if s.strategy == "binary":
            bits = F.lpad(F.bin(code), int(s.params["bits"]), "0")
        parts.append(
            f.select(
                F.lit(s.column).alias("column"),
                F.lit(s.strategy).alias("strategy"),
                "value",
                code.alias("code"),
                mean.cast("double").alias("mean"),
                bits.alias("bits"),
                F.col("n").cast("bigint").alias("n"),
            )
        )
    if not parts:
        raise ValueError("no step holds a mapping")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
