"""The registered queries of this package: each applies one operator to its whole table.

QUERIES maps names to functions of (spark, sf_dir), ORACLES names to DuckDB SQL with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, exact_search, jaccard, language, mixing, neighbours, packing, pii, quality, resample, toxicity, warc
from .shared import folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    out = mixing.copies(docs, ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (out["copies"] * out["size"]).alias("taken"), "copies")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.payloads(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda rows: rows.where("vec_id % 20 = 0"))


@query
def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"), lambda rows: rows.where("vec_id % 100 = 0"))


ORACLES["op10_exact_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard.join(table(spark, sf_dir, "documents"))
    # class_id names the near-duplicate class; text_class_id the rows with the very same shingles
    return got.select("doc_id", got["group_id"].alias("class_id"), got["class_id"].alias("text_class_id"), got["links"].alias("n_links"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


@query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def _base32(hexed: str) -> str:
    """Base32 of 40 hexadecimal digits: five digits are four signs."""
    value = f"('0x' || substr({hexed}, 5 * g + 1, 5))::BIGINT"
    signs = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value} >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(0, 8), lambda g: {signs}), '')"


ORACLES["op5_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_base32("sha1(payload)")} AS payload_digest,
CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to, true AS intact FROM f
"""

ORACLES["op6_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g FROM
      (SELECT doc_id, t, unnest(range(1, CAST(greatest(len(t) - 4, 1) AS BIGINT) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c = nx.k AND c = ny.k AS same FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE c >= 0.8 * (nx.k + ny.k - c) - 1e-9),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, (SELECT min(y) FROM r WHERE x = doc_id) AS class_id, least(doc_id, coalesce((SELECT min(y) FROM l WHERE x = doc_id AND same), doc_id)) AS text_class_id,
(SELECT count(*) FROM l WHERE x = doc_id) AS n_links FROM w
"""
