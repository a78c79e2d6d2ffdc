"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the sets of its words, word pairs and pairs with one word between, as 32-bit hashes of the
lower-cased words. Training folds the hashes into 2^bits coordinates with per-coordinate rates; the L1 term leaves few
of them different from zero. The hashes seen at least min_rows times in the sample at those coordinates become the
model, so that in a very long text a rare word cannot take over a weight by sharing its coordinate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .ftrl import Rates, fit as fit_ftrl, sharded
from .shared import WORD, HashCache, fold, labelled_sample, mixed, python_columns, word_hashes

FOLD, HELD_OUT = 5, 0


@dataclass
class Model:
    """Sorted 32-bit hashes, a weight for each, and the bias; bias None if nothing could be learned."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float | None


def grams(words: np.ndarray) -> np.ndarray:
    """32-bit hashes of words, neighbours and next-but-one pairs; repeats stay."""
    one = mixed(words)
    parts = [one]
    for gap in (1, 2):
        if len(words) > gap:
            parts.append(mixed(one[:-gap] * np.uint64(3) + words[gap:] + np.uint64(gap)))
    return (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 5_000,
    bits: int = 18,
    epochs: int = 4,
    shards: int = 4,
    min_rows: int = 3,
    rates: Rates = Rates(alpha=4.0, beta=1.0, l1=2.0, l2=0.0),
    seed: int = 4,
) -> Model:
    """Learn from labelled rows outside the held-out part (crc32 of the id as text, modulo 5, equal to 0).

    The sample has about per_class ids of each label (documented bound). Null texts count as empty. Of documents that
    share an id one text is used. Ids with both labels are left out. Without labelled rows the bias is None.
    """
    picked, counts = labelled_sample(labels, id_col, label_col, fold(id_col, FOLD) != HELD_OUT, per_class, seed)
    if not counts:
        return Model(np.empty(0, np.uint32), np.empty(0), None)

    def features():
        cache = HashCache()
        return lambda b: {"hashes": [np.unique(grams(word_hashes(t, cache))).tobytes() for t in b.column("text").to_pylist()]}

    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    sample = python_columns(sample, features, ["id", "y"], "hashes binary")
    sample = sharded(sample.groupBy("id", "y").agg(F.min("hashes").alias("hashes")), "id", shards)
    dims = 1 << bits

    def folded():
        def one(h: bytes) -> bytes:
            return np.append(np.unique(np.frombuffer(h, "<u4") & np.uint32(dims - 1)), dims).astype("<u4").tobytes()

        return lambda b: {"idx": [one(h) for h in b.column("hashes").to_pylist()], "val": [None] * len(b)}

    rows = python_columns(sample, folded, ["shard", "y"], "idx binary, val binary")
    w = fit_ftrl(rows, 2, dims + 1, rates, epochs)[0]  # the last coordinate is the bias
    live = np.flatnonzero(w[:-1]).astype(np.uint32)

    def seen():
        on = np.zeros(dims, bool)
        on[live] = True

        def count(b):
            found = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(h, "<u4") for h in b.column("hashes").to_pylist())])
            h, n = np.unique(found[on[found & np.uint32(dims - 1)]], return_counts=True)
            return np.zeros(len(h)), {"hash": h.astype(np.int64), "n": n.astype(np.int64)}

        return count

    kept = (
        python_columns(sample, seen, [], "hash long, n long")
        .groupBy("hash")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_rows)
        .select("hash")
        .collect()
    )  # at most 1 / min_rows of the sample's features, by the L1 term far fewer
    hashes = np.sort(np.array([r["hash"] for r in kept], np.uint32))
    # the sample is balanced, the corpus is not: move the bias to the odds of all labelled ids
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    shift = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    shift -= np.log((counts.get(1, 0) * share.get(1, 0) + 0.5) / (counts.get(0, 0) * share.get(0, 0) + 0.5))
    return Model(hashes, w[hashes & np.uint32(dims - 1)], float(w[-1] + shift))


def scorer(model: Model):
    """A function of a text giving its probability to be toxic."""
    hashes, w, bias = model.hashes, model.weights, model.bias
    cache = HashCache()
    on = np.zeros(1 << 16, bool)
    on[hashes >> np.uint32(16)] = True

    def one(text: str | None) -> float:
        if bias is None:
            return 0.0
        g = grams(word_hashes(text, cache))
        g = np.unique(g[on[g >> np.uint32(16)]])
        s = bias
        if len(g) and len(hashes):
            at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
            s += w[at][hashes[at] == g].sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(s, -60, 60))))

    return one


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row, from the whole text.

    Null and empty texts have no features and get the score of the bias alone; without a learned bias every score is 0.
    """

    def scores():
        one = scorer(model)

        def batch(b):
            out = np.array([one(t) for t in b.column("text").to_pylist()], float)
            return {"score": out, "predicted": (out >= 0.5).astype(np.int32)}

        return batch

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(id_col, FOLD) == HELD_OUT).alias("held_out"))
    return python_columns(slim, scores, ["id", "held_out"], "score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns.

    Rows without any word have nothing that could be toxic and stay, whatever the bias.
    """

    def rows():
        one = scorer(model)

        def batch(b):
            texts = b.column(text_col).to_pylist()
            return [i for i, t in enumerate(texts) if not t or not WORD.search(t) or one(t) < threshold], {}

        return batch

    return python_columns(docs, rows, docs.columns, "")
