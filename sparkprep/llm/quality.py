"""Quality: a compression classifier.

One zstandard dictionary is trained from blocks of texts labelled good, another from blocks of texts labelled bad. A
text is cut into blocks, so that the dictionaries matter in all parts of a long text, and compressed with both; the
difference of the compressed sizes, divided by the size of the text, is calibrated to a probability by a logistic
curve fitted on labelled texts that went into neither dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import fold, labelled_sample, python_columns, stored, unit_hash

FOLD, HELD_OUT = 3, 1


@dataclass
class Model:
    """The two dictionaries, and slope and intercept of the calibration; without dictionaries only the intercept counts."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    block: int
    level: int


def blocks(text: str | None, size: int) -> list[bytes]:
    """The UTF-8 bytes of a text in pieces of a size, the last one shorter; none for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little text to train one, the text itself."""
    raw = b"".join(samples)
    if len(samples) >= 16 and len(raw) >= 8 * size:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return raw[:size]


def difference(model: Model):
    """A function of a text giving (bytes with the bad dictionary - bytes with the good one) / bytes of the text."""

    def packer(raw: bytes):
        trained = raw[:4] == b"\x37\xa4\x30\xec"  # the mark at the start of a trained dictionary
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        return zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))

    if not model.good or not model.bad:
        return lambda text: 0.0
    good, bad = packer(model.good), packer(model.bad)

    def of(text: str | None) -> float:
        parts = blocks(text, model.block)
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / max(1, sum(map(len, parts)))

    return of


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-6, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by damped Newton steps; labels are smoothed as Platt proposed."""
    pos, neg = w[y == 1].sum(), w[y == 0].sum()
    if not len(x) or not pos or not neg:
        return 0.0, float(np.log((pos + 0.5) / (neg + 0.5)))
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = x.std() or 1.0
    a = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    b = np.array([0.0, np.log(pos / neg)])

    def loss(c):
        s = a @ c
        return (w * (np.logaddexp(0, s) - t * s)).sum() + ridge * c @ c

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -60, 60)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 2 * ridge * np.eye(2), a.T @ (w * (p - t)) + 2 * ridge * b)
        while np.abs(step).max() > 1e-9 and loss(b - step) > loss(b):
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1] - b[0] * x.mean() / scale)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 5_000,
    dict_bytes: int = 1 << 16,
    dict_blocks: int = 12_000,
    block: int = 1024,
    level: int = 3,
    seed: int = 2,
) -> Model:
    """Learn from labelled rows outside the held-out part (crc32 of the id as text, modulo 3, equal to 1).

    Bounds of the sample, all documented parameters: about per_class ids of each label, of which two thirds give about
    dict_blocks blocks a label to the dictionaries and one third the calibration. Null texts count as empty. Ids with
    both labels are left out. With one label only, every score is that label's smoothed share; with none it is 0.5.
    """
    picked, counts = labelled_sample(labels, id_col, label_col, fold(id_col, FOLD) != HELD_OUT, per_class, seed)
    empty = Model(b"", b"", 0.0, float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))), block, level)
    if len(counts) < 2:
        return empty
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    sample = sample.withColumn("part", F.when(unit_hash(F.col("id"), seed + 1) < 2 / 3, "dictionary").otherwise("calibration"))

    def cut():
        def batch(b):
            parts = [blocks(t, block) for t in b.column("text").to_pylist()]
            at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            return at, {"block": [x for p in parts for x in p]}

        return batch

    found = python_columns(sample.where("part = 'dictionary'"), cut, ["id", "y"], "block binary")
    found = stored(found.distinct(), "blocks")
    many = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for k, n in many.items():
        rate = F.when(F.col("y") == k, F.lit(min(1.0, dict_blocks / n))).otherwise(rate)

    def build(t: pa.Table) -> pa.Table:
        order = sorted(t.column("block").to_pylist())
        order = [order[i] for i in np.random.default_rng(seed).permutation(len(order))]
        return pa.table({"y": pa.array([t.column("y")[0].as_py()], pa.int32()), "dictionary": pa.array([dictionary(order, dict_bytes)], pa.binary())})

    few = found.where(unit_hash(F.col("block"), F.col("id"), seed) < rate).select("y", "block")
    made = {r["y"]: bytes(r["dictionary"]) for r in few.groupBy("y").applyInArrow(build, "y int, dictionary binary").collect()}
    model = Model(made.get(1, b""), made.get(0, b""), 1.0, 0.0, block, level)
    if not model.good or not model.bad:
        return empty

    def measured():
        of = difference(model)
        return lambda b: {"x": [of(t) for t in b.column("text").to_pylist()]}

    got = python_columns(sample.where("part = 'calibration'"), measured, ["id", "y"], "x double").groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], int)
    w = np.where(y == 1, *(counts[k] / max(1, (y == k).sum()) for k in (1, 0)))  # the sample is balanced, the corpus is not
    w = w * len(x) / max(1e-9, w.sum())
    if len(x):
        x = np.clip(x, *np.quantile(x, [0.01, 0.99]))  # a few odd texts must not bend the curve
    model.slope, model.intercept = logistic(x, y, w)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row, from the whole text; a null or empty text has difference 0."""

    def scores():
        of = difference(model)

        def batch(b):
            x = np.array([of(t) for t in b.column("text").to_pylist()], float)
            out = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -60, 60)))
            return {"score": out, "predicted": (out >= 0.5).astype(np.int32)}

        return batch

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(id_col, FOLD) == HELD_OUT).alias("held_out"))
    return python_columns(slim, scores, ["id", "held_out"], "score double, predicted int").withColumnRenamed("id", id_col)
