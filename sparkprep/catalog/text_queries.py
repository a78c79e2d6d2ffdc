"""Labelling texts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from .registry import query, r, rounded, table

# Function words of the four languages in the texts, and a label no text should get.
_KEYWORDS = {
    "english": ["the", "and", "with them", "words"],
    "french": ["dans", "avec", "qui", "les une"],
    "german": ["und", "nicht", "auf den", "eine"],
    "spanish": ["los", "para", "como una", "pero"],
    "other": ["zzzz", "full stop"],
}
# The singular of every keyword word, spelled out.
_SINGULAR = {
    "the": "the", "and": "and", "with": "with", "them": "them", "words": "word", "dans": "dan", "avec": "avec", "qui": "qui",
    "les": "le", "une": "une", "und": "und", "nicht": "nicht", "auf": "auf", "den": "den", "eine": "eine", "los": "lo",
    "para": "para", "como": "como", "una": "una", "pero": "pero", "zzzz": "zzzz", "full": "full", "stop": "stop",
}
_FOLD = r"""CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y'
    WHEN w LIKE '%es' AND length(w) > 3 THEN substr(w, 1, length(w) - 2)
    WHEN w LIKE '%s' AND length(w) > 2 THEN substr(w, 1, length(w) - 1) ELSE w END"""


def _hits(words: list[str]) -> str:
    """Keywords found as a phrase, or with all their singular forms among those of the text."""
    parts = []
    for k in words:
        folded = [_SINGULAR[w] for w in k.split()]
        all_in = " AND ".join(f"list_contains(words, '{w}')" for w in folded)
        parts.append(f"CASE WHEN contains(low, '{k}') OR ({all_in}) THEN 1 ELSE 0 END")
    return " + ".join(parts)


def _labels(origin: str, key: str, extra: str = "") -> str:
    """(key, label, score, margin) of the keyword scoring."""
    n = len(_KEYWORDS)
    hits = ", ".join(f"{_hits(w)} AS h{i}" for i, w in enumerate(_KEYWORDS.values()))
    top = " ".join(f"WHEN h{i} = best THEN '{lab}'" for i, lab in enumerate(_KEYWORDS))
    full = " OR ".join(f"contains(low, '{p}')" for p in text.FULL_RUN_PHRASES)
    return f"""SELECT {key}{extra}, CASE WHEN {full} THEN 'full_pipeline' WHEN best = 0 THEN 'general_query' {top} END AS label,
    CASE WHEN {full} THEN 1.0 ELSE best * 1.0 / greatest(n, 1) END AS score,
    CASE WHEN {full} THEN 1.0 ELSE best * 1.0 / greatest(n, 1) - second * 1.0 / greatest(n, 1) END AS margin FROM
    (SELECT *, greatest({", ".join(f"h{i}" for i in range(n))}) AS best,
     list_sort([{", ".join(f"h{i}" for i in range(n))}], 'DESC')[2] AS second FROM
     (SELECT *, {hits} FROM (SELECT *, lower(text) AS low, len(regexp_extract_all(lower(text), '[^\\s\\p{{Z}}]+')) AS n, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {_FOLD}) AS words
      FROM {origin})))"""


@query(
    "keyword_label",
    f"""SELECT doc_id, label, {r("score", "label_score")}, {r("margin", "label_margin")} FROM ({_labels("documents", "doc_id")})""",
)
def keyword_label(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    return rounded(text.keyword_label(df, "text", _KEYWORDS).drop("text"))


_PATTERNS = {
    "educational": "explain the and of that",
    "skip_to_modeling": "skip und nicht avec",
    "preprocessing": "scale dans para the",
    "action": "los una die der le",
}

def _extra(label: str) -> str:
    """Bonus of a label: the first rule with a matching phrase."""
    out = ""
    for b in (b for b in text.BONUSES if b.label == label):
        out += " WHEN " + " OR ".join(f"contains(low, '{p}')" for p in b.phrases) + f" THEN {b.delta}"
    return f"(CASE{out} ELSE 0 END)" if out else "0"


def _points(label: str) -> str:
    words = _PATTERNS[label].split()
    return (
        " + ".join(
            f"CASE WHEN contains(' ' || low || ' ', ' {w} ') THEN 2 WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words
        )
        + f" + {_extra(label)}"
    )


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@query(
    "weighted_keyword_label",
    f"""SELECT conv_id, turn, CASE WHEN best = 0 AND {_any(text.QUESTION_WORDS)} THEN 'educational'
    WHEN best = 0 AND {_any(text.SKIP_WORDS)} THEN 'skip_to_modeling' {" ".join(f"WHEN p{i} = best THEN '{lab}'" for i, lab in enumerate(_PATTERNS))}
    END AS label, best AS label_score FROM (SELECT *, CAST(greatest({", ".join(f"p{i}" for i in range(len(_PATTERNS)))}) AS INTEGER) AS best
    FROM (SELECT *, {", ".join(f"{_points(lab)} AS p{i}" for i, lab in enumerate(_PATTERNS))}
    FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations)))""",
)
def weighted_keyword_label(spark, folder):
    df = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return text.weighted_label(df, "text", _PATTERNS).drop("text")


# ---- embeddings -------------------------------------------------------------------------------------

_PROTOTYPES = """v AS (SELECT vec_id, label, unnest(generate_series(1, 64)) AS i, unnest(embedding) AS x FROM embeddings),
    p AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM v GROUP BY 1, 2),
    u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM p),
    s AS (SELECT vec_id, u.label, sum(CAST(v.x AS DOUBLE) * u.x) / sqrt(sum(CAST(v.x AS DOUBLE) * v.x)) AS score
          FROM v JOIN u USING (i) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS place,
          lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS second FROM s)"""


@query(
    "nearest_prototype_label",
    f"""WITH {_PROTOTYPES} SELECT vec_id, CAST(label AS VARCHAR) AS best_label, {r("score", "best_score")}, {r("second", "second_score")},
    {r("score - second", "score_margin")}, score > 0.4 AND score - second > 0.08 AS accepted FROM k WHERE place = 1""",
)
def nearest_prototype_label(spark, folder):
    df = table(spark, folder, "embeddings")
    named = text.prototypes(df, "embedding", "label")
    return rounded(text.prototype_label(df.select("vec_id", "embedding"), "embedding", named).drop("embedding"))


def _cascade(spark, folder):
    vectors = table(spark, folder, "embeddings")
    named = text.prototypes(vectors, "embedding", "label")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    both = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return text.cascade(both, "text", "embedding", named, _KEYWORDS, "critical_routing").drop("text", "embedding")


_CASCADE = f"""WITH {_PROTOTYPES}, d AS ({_labels("documents", "doc_id", ", lang")}) SELECT doc_id, lang,
    CASE WHEN score1 > 0.5 AND score1 - second > 0.12 THEN best ELSE label END AS label,
    CASE WHEN score1 > 0.5 AND score1 - second > 0.12 THEN 'semantic' ELSE 'keyword' END AS method
    FROM d LEFT JOIN (SELECT vec_id, CAST(label AS VARCHAR) AS best, score AS score1, second FROM k WHERE place = 1) ON vec_id = doc_id"""


@query("label_cascade", _CASCADE)
def label_cascade(spark, folder):
    return _cascade(spark, folder)


_EXPECTED = "CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE 'spanish' END"
_QUALITY = f"SELECT {_EXPECTED} AS e, label, method FROM ({_CASCADE})"


def _scope(scope: str, key: str) -> str:
    return f"SELECT '{scope}' AS scope, {key} AS \"key\", count(*) AS n, count(CASE WHEN e = label THEN 1 END) AS correct FROM j GROUP BY 2"


@query(
    "label_quality",
    f"""WITH j AS ({_QUALITY}) SELECT scope, "key", n, correct, {r("correct * 1.0 / n", "accuracy")},
    {r("n * 1.0 / (SELECT count(*) FROM j)", "share")} FROM ({_scope("overall", "'all'")} UNION ALL {_scope("label", "e")}
    UNION ALL {_scope("method", "method")})""",
)
def label_quality(spark, folder):
    df = _cascade(spark, folder).withColumn("expected", F.expr(_EXPECTED))
    return rounded(text.label_quality(df, "expected", "label", "method"))
