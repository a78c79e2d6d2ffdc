"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text becomes lower-cased code points; runs of one to three of them, hashed to 2^bits coordinates, are counted, divided
by their number and weighted by the inverse document frequency over all texts of the learning part. The weights are
trained by follow-the-regularised-leader with an elastic net; a temperature fitted on sample texts that were not
trained on makes the probabilities honest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .ftrl import Rates, fit as fit_ftrl, sharded
from .shared import fold, python_columns, unit_hash

FOLD, HELD_OUT = 4, 2
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """The languages in order, weights times document weights (a line per coordinate), and the temperature."""

    langs: list[str]
    table: np.ndarray
    temperature: float


def grams(text: str, bits: int) -> np.ndarray:
    """Coordinates of all runs of one to three characters of the lower-cased text with a blank at both ends."""
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    shift = np.uint32(32 - bits)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] + np.uint32(0x85EBCA6B))) * np.uint32(2246822519)
    three = (two[:-1] ^ (c[2:] + np.uint32(0xC2B2AE35))) * np.uint32(3266489917)
    return np.concatenate([one, two, three]) >> shift


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def learning(id_col: str, lang_col: str) -> Column:
    return (fold(id_col, FOLD) != HELD_OUT) & F.col(lang_col).isNotNull()


def document_weights(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bits: int) -> np.ndarray:
    """ln((1 + texts) / (1 + texts with the coordinate)) + 1 over every text of the learning part; 2^bits numbers."""
    dims = 1 << bits

    def counted():
        def batch(b):
            n = np.zeros(dims + 1, np.int64)
            for t in b.column("text").to_pylist():
                if has_letter(t):
                    here = np.zeros(dims, bool)
                    here[grams(t, bits)] = True
                    n[:dims] += here
                    n[dims] += 1
            at = np.flatnonzero(n)
            return np.zeros(len(at)), {"at": at.astype(np.int32), "n": n[at]}

        return batch

    texts = docs.where(learning(id_col, lang_col)).select(F.col(text_col).alias("text"))
    n = np.zeros(dims + 1)
    for r in python_columns(texts, counted, [], "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        n[r["at"]] = r["n"]
    return np.log((1 + n[dims]) / (1 + n[:dims])) + 1


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes the labels likeliest, by golden section between 1/20 and 20."""
    if not len(y):
        return 1.0

    def loss(u: float) -> float:
        s = logits / np.exp(u)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        u, v = b - g * (b - a), a + g * (b - a)
        a, b = (a, v) if loss(u) < loss(v) else (u, b)
    return float(np.exp((a + b) / 2))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 1_000,
    max_langs: int = 500,
    bits: int = 16,
    epochs: int = 3,
    shards: int = 4,
    rates: Rates = Rates(alpha=1.0, beta=1.0, l1=0.02, l2=0.001),
    scale: float = 20.0,
    seed: int = 7,
) -> Model:
    """Learn from rows with a language outside the held-out part (crc32 of the id as text, modulo 4, equal to 2).

    Document weights come from all those texts; the weights of the model from about per_lang texts with a letter of each
    language, a fifth of which fits the temperature instead (documented bounds). More than max_langs languages are an
    error. Rows equal in id, text and language are one example, so that a row that fills a third of the table cannot fill the
    sample. Without any text no language is known. scale multiplies the inputs.
    """
    own = docs.where(learning(id_col, lang_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    named = own.select("lang", "id", F.xxhash64("text").alias("text_hash")).distinct()
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << bits, 0)), 1.0)
    idf = document_weights(docs, id_col, text_col, lang_col, bits)
    dims = 1 << bits

    y, rate = F.lit(-1), F.lit(0.0)
    for k, name in enumerate(langs):
        y = F.when(F.col("lang") == name, k).otherwise(y)
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, per_lang / counts[name]))).otherwise(rate)
    own = own.withColumn("text_hash", F.xxhash64("text"))
    # copies of a row are drawn together; each task keeps one of them before any text travels
    sample = own.where(unit_hash(F.col("id"), F.col("text_hash"), seed) < rate).dropDuplicates(["lang", "id", "text_hash"])
    sample = sample.select("text", y.alias("y"), F.xxhash64("id", "text").alias("row"))

    def rows():
        def one(t: str):
            at, n = np.unique(grams(t, bits), return_counts=True)
            val = scale * n / n.sum() * idf[at]
            return np.append(at, dims).astype("<u4").tobytes(), np.append(val, 1.0).astype("<f4").tobytes()

        def batch(b):
            texts = b.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if has_letter(t)]
            made = [one(texts[i]) for i in at]
            return at, {"idx": [m[0] for m in made], "val": [m[1] for m in made]}

        return batch

    made = python_columns(sample, rows, ["row", "y"], "idx binary, val binary")
    made = sharded(made.withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(5))), "row", shards)
    classes = max(2, len(langs))
    w = fit_ftrl(made.where("part <> 0"), classes, dims + 1, rates, epochs)
    if len(w) == 1:
        w = np.concatenate([np.zeros_like(w), w])

    def logits():
        def one(i: bytes, v: bytes) -> bytes:
            return (w[:, np.frombuffer(i, "<u4").astype(np.int64)] @ np.frombuffer(v, "<f4")).astype("<f8").tobytes()

        return lambda b: {"s": [one(i, v) for i, v in zip(b.column("idx").to_pylist(), b.column("val").to_pylist())]}

    got = python_columns(made.where("part = 0"), logits, ["y"], "s binary").collect()
    heat = temperature(np.array([np.frombuffer(r["s"]) for r in got]), np.array([r["y"] for r in got], int))
    table = np.concatenate([w[: len(langs), :-1] * idf * scale, w[: len(langs), -1:]], 1).T
    return Model(langs, np.ascontiguousarray(table), heat)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row, from the whole text; the score is the language's probability.

    Null texts, texts without a letter, and every text if no language was learned, are "und" with score 0.
    """
    bits = int(np.log2(max(1, len(model.table) - 1)))
    sent = docs.sparkSession.sparkContext.broadcast(model.table.astype(np.float32))
    langs, heat = model.langs, model.temperature

    def scored():
        table = sent.value

        def one(text: str | None):
            if not langs or not has_letter(text):
                return UNKNOWN, 0.0
            at = grams(text, bits)
            s = np.zeros(len(langs))
            for i in range(0, len(at), 1 << 16):
                s += table[at[i : i + (1 << 16)]].sum(0, dtype=np.float64)
            s = (s / len(at) + table[-1]) / heat
            p = np.exp(s - s.max())
            k = int(p.argmax())
            return langs[k], float(p[k] / p.sum())

        def batch(b):
            out = [one(t) for t in b.column("text").to_pylist()]
            return {"lang_pred": [o[0] for o in out], "score": [o[1] for o in out]}

        return batch

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(id_col, FOLD) == HELD_OUT).alias("held_out"))
    return python_columns(slim, scored, ["id", "held_out"], "lang_pred string, score double").withColumnRenamed("id", id_col)
