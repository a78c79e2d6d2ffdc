"""Labelling a text column: keywords, embedding prototypes, and the two in a row.

Keyword tables and prototypes are definitions given by the caller. Keywords enter the query as literals, prototypes as
broadcast matrices, so every operator here is one pass over the rows: no shuffle. Keywords are an index from word forms to
keywords and one expression for all phrases, so a text costs about the same for ten keywords and for thousands.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import any_of, ref

NO_MATCH = "general_query"  # fixed value: label of a text without any hit
FULL_RUN = "full_pipeline"  # fixed value: label given by the phrases below, whatever the keywords say
FULL_RUN_PHRASES = ("complete pipeline", "full pipeline", "end to end", "build complete", "entire pipeline")

# Fixed values: (similarity threshold, margin threshold) per use case, and the ranges adjustments stay in.
THRESHOLDS = {
    "critical_routing": (0.50, 0.12),
    "intent_classification": (0.40, 0.08),
    "skip_patterns": (0.35, 0.08),
    "session_continuation": (0.35, 0.06),
    "feature_detection": (0.30, 0.05),
    "educational_queries": (0.30, 0.06),
    "model_sub_classification": (0.30, 0.04),
}
SIMILARITY_RANGE = (0.2, 0.7)
MARGIN_RANGE = (0.03, 0.2)

_NO_WORD = r"[^\p{L}\p{N}_]+"
_TOKEN = r"[^\s\p{Z}]+"
PROTOTYPE_BYTES = 1 << 30  # all prototypes together, on the driver
TILE_BYTES = 64 << 20  # prototypes sent at once


# Plural endings, what stands for them in the singular, and the shortest word they are cut from. The first
# ending that fits counts.
PLURALS = (("ies", "y", 5), ("es", "", 4), ("s", "", 3))


def singular(word: str) -> str:
    """The word with its plural ending replaced."""
    return next((word[: -len(end)] + new for end, new, least in PLURALS if word.endswith(end) and len(word) >= least), word)


def same_singular(word: str) -> list[str]:
    """All words with the same singular as the word: at most one per ending and the singular itself."""
    base = singular(word)
    forms = {base} | {base[: len(base) - len(new)] + end for end, new, _ in PLURALS if base.endswith(new)}
    return sorted(f for f in forms if singular(f) == base)


FEW = 64  # so many keywords are tested phrase by phrase; beyond, one expression looks for all of them at once
_LABEL = 1 << 16  # a keyword's number: its label's place times this, and its place within the label


def _text(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lookup(entries: dict[str, list[str]], kind: str) -> str:
    """SQL of an array of small maps, one per checksum of the key, so that a look-up does not go through all keys."""
    n = 1 << max(0, (len(entries) // 2).bit_length())
    cells: list[list[str]] = [[f"'', CAST(array() AS ARRAY<{kind}>)"] for _ in range(n)]
    for key, values in entries.items():
        cells[zlib.crc32(key.encode()) % n].append(f"{_text(key)}, array({', '.join(values)})")
    return f"array({', '.join(f'map({chr(44).join(c)})' for c in cells)})"


def _found(keys: str, entries: dict[str, list[str]], kind: str) -> str:
    """SQL of all entries of the keys of an array; keys without entries are passed over."""
    if not entries:
        return f"CAST(array() AS ARRAY<{kind}>)"
    known = ", ".join(map(_text, entries))
    n = 1 << max(0, (len(entries) // 2).bit_length())
    hits = f"filter({keys}, w -> w IN ({known}))"
    return f"flatten(transform({hits}, w -> element_at({_lookup(entries, kind)}[CAST(crc32(CAST(w AS BINARY)) % {n} AS INT)], w)))"


def _any_part(parts: set[str]) -> str:
    """One regular expression that looks ahead from any place for the longest of the parts that starts there.

    Parts with a common beginning share it, so at every place a search follows one branch.
    """
    tree: dict = {}
    for p in parts:
        node = tree
        for sign in p:
            node = node.setdefault(sign, {})
        node[""] = {}

    def rule(node: dict) -> str:
        ways = [sign + rule(below) for sign, below in sorted(node.items()) if sign]
        if not ways:
            return ""
        return ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" + "?" * ("" in node)

    return f"(?=[{''.join(sorted(tree))}])(?=({rule(tree)}))"


def _find_keywords(df: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Adds ``_numbers``: of the keywords in ``_lower`` as a phrase, or with a form of each of their words among its words.

    A keyword is entered under its longest word. The forms of that word are looked up among the words of the text, and the
    word itself anywhere in the text, as a phrase may begin or end inside a word; the keyword's other words, and the
    phrase as a whole, are tested for the few keywords that this brings up. Up to ``FEW`` phrases are tested one by one,
    which is cheaper; so are keywords without a word.
    """
    forms: set[str] = set()
    by_form: dict[str, list[str]] = {}
    by_part: dict[str, list[str]] = {}
    tested: list[str] = []  # phrases that are tested in every text
    few = sum(map(len, keywords.values())) <= FEW
    for i, words in enumerate(keywords.values()):
        for j, keyword in enumerate(words):
            number, low = i * _LABEL + j, keyword.lower()
            phrase = f"named_struct('number', {number}, 'phrase', {_text(low)})"
            own = sorted(set(re.findall(r"\w+", low)), key=lambda w: (-len(w), w))
            if few or not own:
                tested.append(phrase)
            else:
                by_part.setdefault(own[0], []).append(phrase)
            if own:
                listed = [same_singular(w) for w in own]
                forms.update(f for some in listed for f in some)
                rest = ", ".join(f"array({', '.join(map(_text, some))})" for some in listed[1:]) or "CAST(NULL AS ARRAY<STRING>)"
                for f in listed[0]:
                    by_form.setdefault(f, []).append(f"named_struct('number', {number}, 'rest', array({rest}))")
    # a part that is found stands for all parts it starts with
    starts = {p: [e for k in range(1, len(p) + 1) for e in by_part.get(p[:k], ())] for p in by_part}
    by_word, by_phrase = "STRUCT<number: INT, rest: ARRAY<ARRAY<STRING>>>", "STRUCT<number: INT, phrase: STRING>"
    some = f"array_distinct(filter(_words, w -> w IN ({', '.join(map(_text, sorted(forms)))})))" if forms else "CAST(array() AS ARRAY<STRING>)"
    inside = F.regexp_extract_all("_lower", F.lit(_any_part(set(by_part))), F.lit(1)) if by_part else F.array().cast("array<string>")
    whole = f"filter({_found('_hits', by_form, by_word)}, k -> forall(k.rest, f -> f IS NULL OR arrays_overlap(f, _hits)))"
    phrases = f"concat({_found('_parts', starts, by_phrase)}, CAST(array({', '.join(tested)}) AS ARRAY<{by_phrase}>))"
    numbers = f"array_distinct(concat(transform({whole}, k -> k.number), transform(filter({phrases}, k -> contains(_lower, k.phrase)), k -> k.number)))"
    staged = df.withColumn("_words", F.split("_lower", _NO_WORD)).withColumn("_hits", F.expr(some))
    return staged.withColumn("_parts", F.array_distinct(inside)).withColumn("_numbers", F.expr(numbers))


def keyword_label(
    df: DataFrame,
    text: str,
    keywords: dict[str, list[str]],
    default: str = NO_MATCH,
    overrides: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Adds label, label_score, label_margin: hits per word of the best label and its lead over the second.

    Ties go to the label named first. A text holding an override phrase gets that label with score 1.
    """
    overrides = {FULL_RUN: FULL_RUN_PHRASES} if overrides is None else overrides
    staged = _find_keywords(df.withColumn("_lower", F.lower(ref(text))), keywords)
    labels = F.transform("_numbers", lambda k: F.floor(k / F.lit(_LABEL)).cast("int"))
    names = F.array(*[F.lit(lab) for lab in keywords]).cast("array<string>")
    count = lambda i: F.size(F.filter("_labels", lambda x: x == i)).alias("hits")
    ranked = F.transform(F.array_distinct("_labels"), lambda i: F.struct(count(i), (-i).alias("place"), F.get(names, i).alias("label")))
    staged = staged.withColumn("_labels", labels).withColumn("_ranked", F.sort_array(ranked, asc=False))
    staged = staged.withColumn("_n", F.regexp_count("_lower", F.lit(_TOKEN)))
    best, second = (F.get("_ranked", F.lit(i)) for i in (0, 1))
    best_hits, second = F.coalesce(best["hits"], F.lit(0)), F.coalesce(second["hits"], F.lit(0))
    per = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    label = F.when(best_hits == 0, F.lit(default)).otherwise(best["label"])
    score, margin = best_hits / per, best_hits / per - second / per
    for name, phrases in reversed(overrides.items()):
        hit = any_of(F.col("_lower"), phrases)
        label = F.when(hit, F.lit(name)).otherwise(label)
        score, margin = F.when(hit, F.lit(1.0)).otherwise(score), F.when(hit, F.lit(1.0)).otherwise(margin)
    known = ref(text).isNotNull()
    return staged.select(
        *[ref(c) for c in df.columns],
        F.when(known, label).alias("label"),
        F.when(known, score).alias("label_score"),
        F.when(known, margin).alias("label_margin"),
    )


@dataclass(frozen=True)
class Bonus:
    """Change of a label's score when the text holds one of the phrases (and of ``also``, and not ``unless``)."""

    label: str
    phrases: tuple[str, ...]
    delta: int
    also: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


# Phrase bonuses. Only the first rule of a label whose phrases occur counts.
BONUSES = (
    Bonus("educational", ("what is", "how does", "explain", "tell me"), 5),
    Bonus("skip_to_modeling", ("skip everything", "bypass all", "skip all"), 5),
    Bonus("preprocessing", ("normalize", "standardize", "scale"), 3),
    Bonus("model_building", ("use this model", "apply model", "existing model"), 5),
    Bonus("no_skip", ("use this model", "use existing", "apply existing", "current model", "existing model"), 10),
    Bonus(
        "action",
        ("what is", "how does", "explain", "tell me", "what are", "different methods", "different techniques",
         "types of", "kinds of"),
        -8,
    ),
    Bonus(
        "educational",
        ("different methods", "different techniques", "types of", "kinds of", "what are different",
         "various methods", "various techniques"),
        8,
    ),
    Bonus(
        "use_existing",
        ("create", "build", "generate"),
        15,
        also=("rank order", "segments", "deciles", "buckets", "table"),
        unless=("new",),
    ),
)
# Words that decide when nothing scored.
QUESTION_WORDS = ("what", "how", "explain", "tell me")
SKIP_WORDS = ("skip", "bypass")


def weighted_label(
    df: DataFrame, text: str, patterns: dict[str, str], bonuses: tuple[Bonus, ...] = BONUSES
) -> DataFrame:
    """Adds label and label_score: 2 per whole-word hit of a word of the description, 1 per part of a word.

    Ties go to the label named first; without any score a question goes to ``educational`` and a wish to skip
    to the first label about skipping, where such labels exist.
    """
    labels = list(patterns)
    lower = F.col("_lower")
    padded = F.concat(F.lit(" "), lower, F.lit(" "))

    def points(words: list[str]) -> Column:
        table = F.array(*[F.lit(w) for w in words]).cast("array<string>")
        one = lambda w: (
            F.when(padded.contains(F.concat(F.lit(" "), w, F.lit(" "))), F.lit(2))
            .when(lower.contains(w), F.lit(1))
            .otherwise(F.lit(0))
        )
        return F.aggregate(F.transform(table, one), F.lit(0), lambda a, b: a + b)

    def extra(label: str) -> Column:
        out = F.lit(0)
        for b in reversed([b for b in bonuses if b.label == label]):
            delta = F.lit(b.delta)
            if b.unless:
                delta = F.when(any_of(lower, b.unless), F.lit(0)).otherwise(delta)
            if b.also:
                delta = F.when(any_of(lower, b.also), delta).otherwise(F.lit(0))
            out = F.when(any_of(lower, b.phrases), delta).otherwise(out)
        return out

    ranked = F.array(
        *[
            F.struct((points(patterns[lab].lower().split()) + extra(lab)).alias("score"), F.lit(-i).alias("place"), F.lit(lab).alias("label"))
            for i, lab in enumerate(labels)
        ]
    )
    best = F.array_max(F.col("_ranked"))
    asked = "educational" if "educational" in labels else labels[0]
    skipping = next((lab for lab in labels if "skip" in lab), labels[0])
    idle = (
        F.when(any_of(lower, QUESTION_WORDS), F.lit(asked))
        .when(any_of(lower, SKIP_WORDS), F.lit(skipping))
        .otherwise(best["label"])
    )
    staged = df.withColumn("_lower", F.lower(ref(text))).withColumn("_ranked", ranked)
    known = ref(text).isNotNull()
    return staged.select(
        *[ref(c) for c in df.columns],
        F.when(known, F.when(best["score"] == 0, idle).otherwise(best["label"])).alias("label"),
        F.when(known, best["score"]).alias("label_score"),
    )


# ---- embeddings -------------------------------------------------------------------------------------


def prototypes(df: DataFrame, vec: str, label: str) -> dict[str, list[float]]:
    """{label: mean vector}. Averaged per label on the cluster; all of them must fit ``PROTOTYPE_BYTES``."""
    known = df.filter(ref(vec).isNotNull() & ref(label).isNotNull())
    size = known.agg(F.max(F.size(ref(vec)))).first()[0] or 0
    most = PROTOTYPE_BYTES // max(8, 8 * size)
    if known.select(ref(label)).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels: these are not prototypes")
    means = [F.avg(F.get(ref(vec), F.lit(i)).cast("double")).alias(f"d{i}") for i in range(size)]
    rows = known.groupBy(ref(label).cast("string").alias("label")).agg(*means).orderBy("label").collect()
    return {r["label"]: [r[f"d{i}"] for i in range(size)] for r in rows}


def _nearest_two():
    """A function that travels with the job: executors need no copy of this package."""

    def nearest(matrix: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the best line, its product, the second product) of every row of x; equal products go to the first line.

        A matrix product finds the candidates; those that could be first or second are computed again one by one, in the same
        order of terms, so that equal lines have equal products.
        """
        place, top, second = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), -np.inf)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            rough = part @ matrix.T
            edge = rough.max(1) if len(matrix) < 2 else np.partition(rough, -2, axis=1)[:, -2]
            line, spot = np.nonzero(rough >= edge[:, None] - 1e-9 * np.maximum(1.0, np.abs(edge))[:, None])
            exact = (part[line] * matrix[spot]).sum(1)
            order = np.lexsort((spot, -exact, line))
            line, spot, exact = line[order], spot[order], exact[order]
            first = np.flatnonzero(np.r_[True, np.diff(line) != 0])
            place[at + line[first]], top[at + line[first]] = spot[first], exact[first]
            if len(matrix) > 1:
                second[at + line[first]] = exact[first + 1]
        return place, top, second

    return nearest


def prototype_label(
    df: DataFrame,
    vec: str,
    prototypes: dict[str, list[float]],
    threshold: float = 0.4,
    margin: float = 0.08,
) -> DataFrame:
    """Adds best_label, best_score, second_score, score_margin, accepted, by cosine similarity.

    Accepted when the best similarity and its lead are both above their thresholds. Ties go to the label named first. A
    vector of length 0 has similarity 0 with everything; one of another number of components, or with a null, has none:
    its label and scores are null. Prototypes are sent as matrices of at most ``TILE_BYTES``; each adds to the best two so far.
    """
    names = list(prototypes)
    lines = np.array([prototypes[n] for n in names], float).reshape(len(names), -1)
    norm = np.sqrt((lines * lines).sum(1))
    lines = lines / np.where(norm > 0, norm, 1.0)[:, None]
    context, nearest = df.sparkSession.sparkContext, _nearest_two()
    step = max(1, TILE_BYTES // max(8, 8 * lines.shape[1]))
    tiles = [(at, context.broadcast(lines[at : at + step])) for at in range(0, len(names), step)]
    held = T.StructType.fromDDL("_place bigint, _top double, _second double")
    x = F.transform(ref(vec), lambda e: e.cast("double"))
    fits = ref(vec).isNotNull() & (F.size(ref(vec)) == lines.shape[1]) & F.forall(ref(vec), lambda e: e.isNotNull())
    out = df.withColumn("_x", F.when(fits, x)).withColumns({f.name: F.lit(None).cast(f.dataType) for f in held})

    def compare(start: int, sent):
        def run(batches):
            import pyarrow as pa

            matrix = sent.value
            for b in batches:
                column = b.column("_x")
                here = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                rows = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(here), -1) if len(here) else np.zeros((0, matrix.shape[1]))
                size = np.sqrt((rows * rows).sum(1))
                found = nearest(matrix, rows / np.where(size > 0, size, 1.0)[:, None])
                place, top, second = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_place", "_top", "_second"))
                known = ~np.isnan(top[here])  # from the tiles before
                old_top, old_second = np.where(known, top[here], -np.inf), np.where(known, second[here], -np.inf)
                ahead = found[1] > old_top
                place = place.astype(float)
                place[here] = np.where(ahead, found[0] + start, place[here])
                top[here] = np.maximum(found[1], old_top)
                second[here] = np.where(ahead, np.maximum(old_top, found[2]), np.maximum(old_second, found[1]))
                gone = np.ones(len(b), bool)
                gone[here] = False
                new = [pa.array(np.where(gone, 0, place).astype(np.int64), mask=gone), pa.array(top, mask=gone), pa.array(second, mask=gone)]
                yield pa.RecordBatch.from_arrays([*b.columns[: -len(new)], *new], names=b.schema.names)

        return run

    for start, sent in tiles:
        out = out.mapInArrow(compare(start, sent), out.schema)
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("_place").cast("int")) if len(names) <= 100 else None
    if label is None:  # many names travel as a table of the size of the prototypes' names, not in the query
        table = df.sparkSession.createDataFrame(list(enumerate(names)), "_at bigint, _label string")
        out = out.join(F.broadcast(table), F.col("_place") == F.col("_at"), "left")
        label = F.col("_label")
    runner_up = F.when(F.col("_second") == F.lit(-math.inf), F.lit(0.0)).otherwise(F.col("_second"))
    lead = F.col("_top") - runner_up
    return out.select(
        *[ref(c) for c in df.columns],
        label.alias("best_label"),
        F.col("_top").alias("best_score"),
        runner_up.alias("second_score"),
        lead.alias("score_margin"),
        F.coalesce((F.col("_top") > threshold) & (lead > margin), F.lit(False)).alias("accepted"),
    )


def thresholds(profile: str, adjust: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """Similarity and margin thresholds of a use case, adjusted and kept within their ranges."""
    s, m = THRESHOLDS.get(profile, THRESHOLDS["intent_classification"])
    s, m = s + adjust[0], m + adjust[1]
    return (
        max(SIMILARITY_RANGE[0], min(SIMILARITY_RANGE[1], s)),
        max(MARGIN_RANGE[0], min(MARGIN_RANGE[1], m)),
    )


def cascade(
    df: DataFrame,
    text: str,
    vec: str,
    prototypes: dict[str, list[float]],
    keywords: dict[str, list[str]],
    profile: str = "intent_classification",
    adjust: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """Adds label and method: the prototype's label when it is accepted, else the keyword label."""
    by_vec = prototype_label(df, vec, prototypes, *thresholds(profile, adjust))
    both = keyword_label(by_vec, text, keywords)
    return both.select(
        *[ref(c) for c in df.columns],
        F.when(F.col("accepted"), F.col("best_label")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("accepted"), "semantic").otherwise("keyword").alias("method"),
    )


def label_quality(df: DataFrame, expected: str, got: str, method: str | None = None) -> DataFrame:
    """(scope, key, n, correct, accuracy, share): overall, per expected label, and per method used."""
    how = ref(method).cast("string") if method else F.lit(None).cast("string")
    cells = df.groupBy(ref(expected).cast("string").alias("e"), how.alias("m")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(ref(expected).cast("string") == ref(got).cast("string"), 1)).alias("correct"),
    )
    scopes = [F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("key"))]
    scopes.append(F.struct(F.lit("label").alias("scope"), F.col("e").alias("key")))
    if method:
        scopes.append(F.struct(F.lit("method").alias("scope"), F.col("m").alias("key")))
    table = (
        cells.select("n", "correct", F.inline(F.array(*scopes)))
        .groupBy("scope", "key")
        .agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    )
    total = F.max(F.when(F.col("scope") == "overall", F.col("n"))).over(Window.partitionBy(F.lit(0)))  # labels only
    return table.select(
        "scope",
        "key",
        "n",
        "correct",
        F.try_divide(F.col("correct").cast("double"), F.col("n").cast("double")).alias("accuracy"),
        F.try_divide(F.col("n").cast("double"), total.cast("double")).alias("share"),
    )
