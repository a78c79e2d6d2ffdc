"""Mixing, packing, WARC and the vector searches against brute force and round trips."""

import base64
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from sparkprep.llm import exact_search, mixing, neighbours, packing, queries, vectors, warc
from sparkprep.llm.shared import folder

SF = "/root/testdata/sf0.01"


def test_mixing_meets_targets(spark):
    got = queries.op1_mixing(spark, SF).toPandas()
    again = queries.op1_mixing(spark, SF).toPandas()
    key = ["doc_id", "copies"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    assert dict(zip(got["doc_id"], got["size"])) == size
    sizes = {}
    for d, n in size.items():
        sizes[source[d]] = sizes.get(source[d], 0) + n
    names = sorted(sizes)
    target, weight = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free = 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    got["source"] = got["doc_id"].map(source)
    for s, g in got.groupby("source"):
        assert math.isclose(g["target"].iloc[0], target[s], rel_tol=1e-9)
        assert g["source_size"].iloc[0] == sizes[s]
        assert abs(g["taken"].sum() - target[s]) <= g["size"].max()
        assert (g["taken"] <= 2 * g["size"]).all()


def test_mixing_keeps_expectations(spark):
    rows = spark.createDataFrame([(i, "a" if i < 40 else "b", 1 + i % 7) for i in range(80)], "id long, source string, size long")
    total = np.zeros(80)
    for seed in range(12):
        got = mixing.copies(rows, ["id"], leaf_rows=8, fan_in=2, seed=seed).collect()
        for r in got:
            total[r["id"]] += r["copies"]
        want = got[0]["target"]
        own = [r for r in got if r["source"] == got[0]["source"]]
        assert abs(sum(r["copies"] * r["size"] for r in own) - want) <= 7
    assert abs(total.mean() / 12 - 1.5) < 0.15


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", None, 9), (1, "a b c", None, 9), (None, "x y", "s", 9), (3, None, "s", 9), (4, "", "t", 9), (5, "w " * 5000, "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    sizes = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    got = mixing.copies(sizes, ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r["copies"] <= 2 for r in got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(rows)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.copies(sizes.where("false"), ["doc_id"]).count() == 0
    only_empty = mixing.mix(docs.where("doc_id = 4"))
    assert only_empty.count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    got = packing.pack(packing.pieces(spark.read.parquet(f"{SF}/documents.parquet"), with_ids=True)).toPandas()
    model = Tokenizer.from_file(packing.vocabulary_file())
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert set(got["doc_id"]) == set(texts)
    for d, g in got.sort_values("piece").groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in g["ids"]])
        assert ids.tolist() == model.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        assert g["piece"].tolist() == list(range(len(g)))
        assert g["start"].tolist() == np.r_[0, np.cumsum(g["length"])[:-1]].tolist()
        assert (g["length"].iloc[:-1] == 4096).all()
        assert [zlib.crc32(x) for x in g["ids"]] == g["ids_crc32"].tolist()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == np.r_[0, np.cumsum(g["length"])[:-1]].tolist()
        assert g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 4096) + 1


@pytest.mark.parametrize("capacity", [7, 8, 100, 4096])
def test_best_fit_is_best_fit(capacity):
    lengths = np.sort(np.random.default_rng(capacity).integers(1, capacity + 1, 300))[::-1]
    rest = []
    for x in lengths:
        fits = [(r, i) for i, r in enumerate(rest) if r >= x]
        if fits:
            rest[min(fits)[1]] -= x
        else:
            rest.append(capacity - x)
    bins, _ = packing.best_fit(lengths, capacity)
    used = np.bincount(bins, weights=lengths)
    assert sorted(capacity - used) == sorted(rest)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.vocabulary_file()
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read(), limit=5)
    texts = [None, "", "  ", "don't  WE'LL\x1cx\x85y", "<|startoftext|> x <|endoftext|>y", "é ́a Ångström ΣΑΣ İI ẞ", "x" * 9000]
    texts += ["Ärger naïve ª²½µ x\xa0y", "\U0001f468‍\U0001f469 1234567", "a\x00b \x0b\x0c c\rd", "«»¿¡ ×÷ ¤ 'S 's't"]
    want = [np.array(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def test_encoder_learns_many_words_in_one_call():
    with open(packing.vocabulary_file(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    words = ["".join(map(chr, x)) for x in np.random.default_rng(3).integers(224, 246, (4_000, 6))] + ["it's", "_\x1c_", "99", "'", "x" * 300]
    calls = []
    inner, encoder.plain = encoder.plain, type("Counted", (), {"encode_batch_fast": lambda self, t, **k: (calls.append(len(t)), inner.encode_batch_fast(t, **k))[1]})()
    got = encoder.encode(words)
    want = [np.array(encoder.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert got == want and sum(calls) <= 5


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (2, "", 1), (2, "", 1), (3, "word " * 9000, 1)], "doc_id long, text string, length int")
    got = packing.pack(packing.pieces(docs)).toPandas()
    assert sorted(got["length"]) == [1, 1, 1, 809, 4096, 4096]
    assert got["sequence_id"].nunique() == 3
    assert packing.pack(packing.pieces(docs.where("false"))).count() == 0


def _warc_truth(rows):
    first = {}
    for page, html in rows:
        raw = (html or "").encode()
        if page is not None:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        of = first.get(raw)
        revisit = of is not None and of != page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", of if revisit else None, True))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    got = [tuple(r) for r in queries.op5_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()]
    assert sorted(got, key=str) == _warc_truth(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())


def test_warc_odd_rows(spark):
    rows = [
        (1, "http://a/b c\r\nX: y", "WARC/1.1\r\n\r\n\r\n" * 40), (2, None, None), (3, "u", ""), (4, "u", "é€\U0001f600" * 3000),
        (5, "u", "é€\U0001f600" * 3000), (5, "u", "other"), (None, "u", "other"), (7, "u", "0\r\n\r\n"), (8, "u", "y"), (8, "u", "y"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = folder(spark, "warc")
    warc.write(pages, path, segment=500, chunk=64)
    got = warc.payloads(spark, path).toPandas()
    texts = sorted(x.decode() for x in got["payload"] if x is not None)
    assert texts == sorted([*{r[2] or "" for r in rows}, "y"])  # one response for each payload, two for the repeated row
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    found = [tuple(r) for r in warc.payloads(spark, path).select(*cols).collect()]
    assert sorted(found, key=str) == _warc_truth([(p, h) for p, _, h in rows])
    empty = folder(spark, "warc")
    warc.write(pages.where("false"), empty)
    assert warc.payloads(spark, empty).count() == 0


def test_warc_broken_segments(spark):
    schema = warc.FIELDS
    rows = [("a", "response", 1, None, "X", 1, None, None, bytearray(b"ab")), ("a", "continuation", None, None, None, 2, 4, None, bytearray(b"cd"))]
    rows += [("b", "response", 2, None, "X", 1, None, None, bytearray(b"ab")), ("b", "continuation", None, None, None, 3, 4, None, bytearray(b"cd"))]
    rows += [("c", "response", 3, None, "X", 1, None, None, bytearray(b"ab")), ("c", "continuation", None, None, None, 2, 9, None, bytearray(b"cd"))]
    got = {r["record_id"]: r["block"] for r in warc.reassembled(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": b"abcd", "b": None, "c": None}
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.unchunked(b"4\r\nabc\r\n0\r\n\r\n") is None and warc.unchunked(b"zz") is None


def _vectors():
    got = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return np.array([g[0] for g in got]), np.array([g[1] for g in got], float)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_exact_search_odd_rows(spark):
    ids, v = _vectors()
    rows = [(int(i), [float(x) for x in w], 1) for i, w in zip(ids[:120], v[:120])]
    odd = [(200, None, 1), (300, [1.0, None], 1), (400, [float("nan")] * 64, 1), (None, [0.5] * 64, 1), (500, [0.0] * 64, 1), (0, rows[0][1], 1), (601, rows[5][1], 1), (700, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int").repartition(5)
    got = exact_search.search(df, lambda r: r.where("vec_id % 100 = 0"), shard_rows=16, query_rows=2, fan_in=2).collect()
    w = {i: np.floor(1024 * np.array(x)).astype(int) for i, x, _ in rows + [odd[4], odd[6]]}
    for q in (0, 100, 500):
        want = sorted((-int(w[q] @ x), i) for i, x in w.items() if i != q)[:10]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert len(got) == 30
    assert exact_search.search(df.where("false"), lambda r: r).count() == 0
    big = np.array([[2.0**60, 2.0**60], [2.0**60, -(2.0**60)]])
    assert exact_search.products(big, big).tolist() == [[2**63 - 1, 0], [0, 2**63 - 1]]


def _recall(got, ids, v, k):
    hit = total = 0
    for q in sorted({r["query_id"] for r in got}):
        s = v @ v[list(ids).index(q)]
        want = [i for _, i in sorted((-x, i) for x, i in zip(s, ids) if i != q)[:k]]
        found = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        hit, total = hit + len(set(want) & set(found)), total + len(want)
        for i, x in found.items():
            assert math.isclose(x, s[list(ids).index(i)], rel_tol=1e-12, abs_tol=1e-12)
        order = [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert order == sorted(order)
    return hit / total


def test_neighbours_recall(spark):
    ids, v = _vectors()
    got = queries.op8_neighbours(spark, SF).collect()
    assert {r["query_id"] for r in got} == {int(i) for i in ids if i % 20 == 0}
    assert len(got) == 20 * len({r["query_id"] for r in got})
    assert _recall(got, ids, v, 20) >= 0.9


def test_neighbours_of_any_length_and_crowded_buckets(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 10)) * rng.uniform(0.1, 3, (400, 1))
    v[200:330] = v[200]  # one vector many times
    rows = [(i, x.tolist(), 0.5) for i, x in enumerate(v)] + [(1000, [0.0] * 10, 0.5), (1001, None, 0.5), (1002, [float("inf")] * 10, 0.5), (None, [1.0] * 10, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket double").repartition(4)
    got = neighbours.search(df, lambda r: r.where("vec_id % 20 = 0"), k=5, chunk_rows=32).collect()
    assert len(got) == 20 * 5
    assert _recall(got, np.arange(400), v, 5) >= 0.9
    assert neighbours.search(df.where("false"), lambda r: r).count() == 0
    few = neighbours.search(df.where("vec_id < 3"), lambda r: r, k=5).collect()
    assert len(few) == 6
    assert df.where(F.col("vec_id") < 3).count() == 3


def test_neighbours_come_from_the_tables_alone(spark):
    """The sample only prunes: with few probes the lists are the same with and without it."""
    ids, v = _vectors()
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(4)

    def found(**settings):
        got = neighbours.search(df, lambda r: r.where("vec_id % 20 = 0"), k=5, **settings).collect()
        return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), _recall(got, ids, v, 5)

    few = dict(tables=2, recall=0.2)
    (pruned, share), (whole, _), (_, full) = found(**few), found(**few, first_rows=0), found(first_rows=0)
    assert pruned == whole and share < 0.9 <= full


def test_exact_search_spreads_the_tiles_of_one_query_block(spark, monkeypatch):
    ids, v = _vectors()
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(exact_search, "merged", lambda parts, *_: parts)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, x in conf.items():
            spark.conf.set(c, x)
        parts = exact_search.search(df, lambda r: r.where("vec_id % 100 = 0"), shard_rows=16)
        assert parts.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)


def test_mixing_deals_out_a_large_group_of_equal_rows(spark):
    """A third of the rows is one row: its copies are made in several tasks, and none is lost."""
    docs = spark.createDataFrame([(i, "a few words here", "s") for i in range(20_000)], "doc_id long, text string, source string")
    docs = docs.unionByName(docs.select(F.lit(-1).cast("long").alias("doc_id"), "text", "source").limit(10_000))
    got = mixing.mix(docs, weights=(1.0,), share=2.0)
    assert got.count() == 60_000 and got.where("doc_id = -1").count() == 20_000
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert mixing.mix(docs, weights=(1.0,), share=2.0).where("doc_id = -1").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)


def test_lists_of_many_tasks_are_merged(spark):
    """Lists of a thousand tasks for each query: what comes out is the best of all, each vector once."""
    rng = np.random.default_rng(2)
    rows = [(q, t, int(v), float(s)) for q in (1, 2) for t in range(1000) for v, s in zip(rng.integers(0, 400, 4), rng.integers(0, 50, 4))]
    parts = spark.createDataFrame(rows, "query_id long, tile long, vec_id long, score double").repartition(7)
    got = vectors.merged(parts, 20, 1000).collect()
    for q in (1, 2):
        want = sorted({(-s, v) for own, _, v, s in rows if own == q})[:20]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
