"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target share of the words. Within a source each document has the same expected number of copies;
its fraction is rounded by dependent rounding: of two documents with fractional probabilities, words are moved from one
to the other, in a random direction that keeps both expectations, until one of the probabilities is 0 or 1. The words a
source takes stay as they are with every move. Leaves of a reduction tree (bounded groups of a source's documents) leave
one fractional document each; those meet in the next level, until one of the source is left, which a draw decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order import rank
from .shared import free, stored, unit_hash

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _unfolded(rows: DataFrame, times: str, key: list[str], name: str, size: int = 4096) -> DataFrame:
    """Every row `times` times, numbered from 0 as name.

    Rows with more than `size` copies are first cut into ranges of that many, which are dealt to all tasks.
    """
    first, count = F.lit(0).cast("long"), F.col(times).cast("long")
    few = rows.where(count.between(1, size)).withColumn(name, F.explode(F.sequence(first, count - 1)))
    many = rows.where(count > size).withColumn(name, F.explode(F.sequence(first, F.floor((count - 1) / size))))
    start = F.col(name) * size
    many = many.repartition(*key, name).withColumn(name, F.explode(F.sequence(start, F.least(start + size, count) - 1)))
    return few.unionByName(many)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds rank and target to (source, source_size).

    Sources in code point order, null last, take the weights in turn. The total is share times all sizes. A target
    stops at most times the source's size; what is above is dealt to the others by weight until none is above.
    """
    ordered = rank(sizes.withColumn("no_name", F.col("source").isNull().cast("int")), ["no_name", "source"], "rank").drop("no_name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ordered = stored(ordered.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        got = ordered.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.coalesce(F.sum(above.cast("long")), F.lit(0)).alias("capped"),
        ).first()
        if got["capped"] == capped or not got["free"]:
            break
        capped = got["capped"]
        level = max(level, (share * got["words"] - got["taken"]) / got["free"])
    return ordered.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> None:
    """Dependent rounding of p in place, in the given order; at most one value stays fractional."""
    held = -1
    for i in range(len(p)):
        if held < 0:
            held = i
            continue
        up = min((1.0 - p[held]) * size[held], p[i] * size[i])  # words that can move to the held one
        down = min(p[held] * size[held], (1.0 - p[i]) * size[i])
        if draw[i] * (up + down) < down:
            a, b, moved = held, i, up
        else:
            a, b, moved = i, held, down
        full, none = moved >= (1.0 - p[a]) * size[a], moved >= p[b] * size[b]
        p[a] = 1.0 if full else p[a] + moved / size[a]
        p[b] = 0.0 if none else p[b] - moved / size[b]
        loose = [k for k in (held, i) if 0.0 < p[k] < 1.0]
        held = loose[0] if loose else -1


def _round_group(seed: int, level: int):
    def run(t: pa.Table) -> pa.Table:
        size, p, key = (t.column(c).to_numpy() for c in ("size", "p", "key"))
        order = np.lexsort((key, -size))  # alike sizes meet, the smallest come last; equal rows are interchangeable
        p = p[order].copy()
        rng = np.random.default_rng([seed, level, int(t.column("rank")[0].as_py()), int(t.column("node")[0].as_py())])
        _pivot(p, size[order].astype(float), rng.random(len(p)))
        return t.take(pa.array(order)).set_column(t.schema.get_field_index("p"), "p", pa.array(p))

    return run


def copies(
    units: DataFrame,
    ids: list[str],
    source: str = "source",
    size: str = "size",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    leaf_rows: int = 4096,
    fan_in: int = 64,
    seed: int = 1,
) -> DataFrame:
    """(ids..., source, size, rows, item, source_size, target, copies) with one row for every row of units.

    Rows equal in ids, source and size are told apart by item, from 0 to rows - 1, and are interchangeable. Rows of size
    0 have no words to move: a hash of their own rounds them. Null ids and sources are values like others. An empty
    table gives an empty result. The same rows and seed give the same copies, however the rows are partitioned.
    """
    same = units.select(*ids, F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    same = stored(same.groupBy(*ids, "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    sizes = same.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("rows"))).alias("units")
    )
    plan = stored(targets(sizes, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(
        F.col("source").alias("of"), "rank", "source_size", "target", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("p"),
        F.ceil(F.coalesce(F.col("units"), F.lit(1)) / leaf_rows).alias("leaves"),
    )
    most_leaves = plan.agg(F.max("leaves")).first()[0] or 1
    rows = _unfolded(same, "rows", [*ids, "source", "size"], "item")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).drop("of")
    rows = rows.withColumn("key", F.xxhash64(*ids, "item", F.lit(seed)))
    rows = rows.withColumn("node", F.pmod(F.xxhash64("key", "size"), F.col("leaves"))).drop("leaves")
    own = (unit_hash(F.col("key"), seed + 1) < F.col("p")).cast("double")
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(own))
    loose = (F.col("p") > 0) & (F.col("p") < 1)
    open_rows, done = rows.where(loose), [rows.where(~loose)]
    level, nodes = 0, most_leaves
    while True:
        open_rows = stored(open_rows.groupBy("rank", "node").applyInArrow(_round_group(seed, level), open_rows.schema), f"level{level}")
        done.append(open_rows.where(~loose))
        open_rows = open_rows.where(loose)
        if nodes <= 1:
            break
        nodes = -(-nodes // fan_in)
        open_rows = open_rows.withColumn("node", F.floor(F.col("node") / fan_in))
        level += 1
    last = (unit_hash(F.col("key"), seed + 2) < F.col("p")).cast("double")
    out = open_rows.withColumn("p", last)
    for part in done:
        out = out.unionByName(part)
    return out.select(*ids, "source", "size", "rows", "item", "source_size", "target", (F.col("base") + F.col("p")).cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.

    A row is known by its id and a hash of all its columns; rows that are equal in every column are interchangeable.
    """
    row, uid, times, rows = (free(docs, n) for n in ("mix_row", "mix_id", "mix_copies", "mix_rows"))
    kept = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    units = kept.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    taken = copies(units, ["id", "row"], **settings).groupBy("id", "row").agg(F.sum("copies").cast("int").alias("copies"), F.max("rows").alias("rows"))
    same = free(docs, "mix_same")
    taken = stored(taken, "copies").where("copies > 0").toDF(uid, same, times, rows)
    # by a shuffle at every size: there is a row for nearly every document
    both = kept.join(taken.hint("merge"), kept[id_col].eqNullSafe(taken[uid]) & (kept[row] == taken[same]))
    out = [f"`{c}`" for c in docs.columns]
    once = both.where(F.col(rows) == 1).select(*out, times)
    many = both.where(F.col(rows) > 1).dropDuplicates([uid, row]).select(*out, times, row)
    many = _unfolded(many, times, [row], same).drop(row, same, times)
    return once.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).drop(times).unionByName(many)
