"""Importance resampling, alignment of tokenizers and byte-pair coding against plain loops and the libraries."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkprep.llm import alignment, bpe, queries, resample

SF = "/root/testdata/sf0.01"
ODD = list("ab'sS tTlL19²½ÀÿßµªºÆ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　́éée漢字한각ǅİΣσς<>|🙂‍!?.,-_▁") + [
    "<|endoftext|>", "<|startoftext|>", "'ll", "가", "<s>", "<0x41>", "  ", " \n ", "!\x1c!", "▁▁",
]


def odd_texts(n: int, longest: int = 16, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, longest))) for _ in range(n)]


def documents():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


# --- importance resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_grams(text, n_max=1):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def plain_scores(docs, target, n_max=1, buckets=10_000, least=20, percent=10, seed="2024"):
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(at(g) for _, t in docs for g in plain_grams(t, n_max))
    t = Counter(at(g) for x in target for g in plain_grams(x, n_max))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        own = [gain[at(g)] for g in plain_grams(text, n_max)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(own), weight, score, None, len(plain_words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got_scores(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_resample_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents()]
    target = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    assert got_scores(queries.op11_resample(spark, SF)) == plain_scores(docs, target)


def test_resample_longer_runs(spark):
    docs = [(i, t) for i, t in enumerate([*odd_texts(300, 60), "one", "one two", "a b " * 4000])]
    target = ["The cat's 2 hats", "über αβγ αβγ", None, ""]
    options = {"n_max": 3, "buckets": 70_001, "least_words": 2, "percent": 37, "seed": "x"}
    got = resample.scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert got_scores(got) == plain_scores(docs, target, 3, 70_001, 2, 37, "x")


def test_resample_spans():
    patterns = resample.scanners(3)
    for text in odd_texts(500, 30):
        assert sorted(resample.spans(resample.spaced(text.encode()), patterns)) == sorted(g.encode() for g in plain_grams(text, 3))


def test_resample_odd_rows(spark):
    words = "alpha beta gamma delta " * 6
    rows = [(None, words, 5, "r")] * 2 + [(4, None, 5, "r"), (5, "", 5, "r"), (7, words, 1, None)] + [(9, words + "x", 2, "r")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, `row` string")
    target = spark.createDataFrame([("alpha beta",)], "text string")
    got = resample.scores(docs, target, percent=50).collect()
    assert len(got) == 45 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 22))
    drawn = resample.draw(docs, target, percent=50)
    assert drawn.columns == docs.columns and drawn.count() == 21
    assert {tuple(r) for r in drawn.collect()} <= set(rows)
    assert resample.scores(docs.where("false"), target).count() == 0
    nothing = resample.scores(docs, target.where("false")).collect()
    assert len(nothing) == 45


# --- alignment of tokenizers


class Plain:
    """Both tokenizers over whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        sign = {c: i for i, c in enumerate(bpe.byte_signs())}
        self.bytes_a = lambda i: bytes(sign[c] for c in self.a.id_to_token(i))
        piece = self.b.id_to_piece
        self.bytes_b = lambda i: bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        if b"".join(map(self.bytes_a, a)) != raw or b"".join(map(self.bytes_b, b)) != raw:
            return [], []
        return a, b

    def groups(self, text):
        a, b = self.tokens(text)
        ends_a, ends_b = np.cumsum([len(self.bytes_a(i)) for i in a]).tolist(), np.cumsum([len(self.bytes_b(i)) for i in b]).tolist()
        out, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_x, to_y = bisect.bisect_right(ends_a, end), bisect.bisect_right(ends_b, end)
            out.append((a[x:to_x], b[y:to_y]))
            x, y = to_x, to_y
        return a, b, out

    def report(self, docs):
        found = [(key, *self.groups(text)) for key, text in docs]
        count = Counter((x[-1], y[-1]) for *_, groups in found for x, y in groups)
        top = {}
        for (_, b), n in count.items():
            top[b] = max(n, top.get(b, 0))
        rows = []
        for key, a, b, groups in found:
            links = [count[x[-1], y[-1]] for x, y in groups]
            best = sum(count[x[-1], y[-1]] == top[y[-1]] for x, y in groups)
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
            rows.append((key, len(a), len(b), len(groups), len(links), best, sum(links), digest))
        return sorted(rows, key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_alignment_query(spark, plain):
    got = sorted((tuple(r) for r in queries.op12_alignment(spark, SF).collect()), key=str)
    assert got == plain.report([(r["doc_id"], r["text"]) for r in documents()])


def test_alignment_odd_texts(spark, plain, monkeypatch):
    docs = [(i % 900, t) for i, t in enumerate([*odd_texts(2500), *odd_texts(300, 80, 4), None, "", "x", "<s> </s>"])] + [(None, "a a a a a")] * 3
    frame = spark.createDataFrame([(k, t, "n") for k, t in docs], "doc_id long, text string, block string").repartition(3)
    want = plain.report(docs)
    assert any(r[1] == 0 for r in want) and any(r[3] > 5 for r in want)
    assert sorted((tuple(r) for r in alignment.report(frame).collect()), key=str) == want
    # small blocks: postings of one pair in many of them
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 50)
    assert sorted((tuple(r) for r in alignment.report(frame).collect()), key=str) == want


def test_alignment_counts(spark, plain):
    texts = ["the cat the cat", "the dog", "a cat", "the " * 70_000]
    found = alignment.index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_groups=True)
    each = [Counter((x[-1], y[-1]) for x, y in plain.groups(t)[2]) for t in texts]
    got = {(r["a"], r["b"]): (r["n_links"], r["n_docs"]) for r in alignment.pairs(found).collect()}
    assert got == {p: (sum(c[p] for c in each), sum(p in c for c in each)) for p in set().union(*each)}
    groups = {r["doc_id"]: r["groups"] for r in found.docs.collect()}
    assert groups[1] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain.groups("the dog")[2])


def test_alignment_long_text_and_nothing(spark, plain):
    text = "".join(odd_texts(4000, 12, 9)).replace("▁", "") + "x" * 30_000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in alignment.report(frame).collect()] == plain.report([(1, text)])
    assert alignment.report(frame.where("false")).count() == 0
    blank = alignment.report(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in blank) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_bitmaps():
    r = random.Random(5)
    for size in (1, 7, 64, 1000, 1 << 14):
        sets = [sorted(r.sample(range(size), min(size, k))) for k in (1, 3, size // 2 + 1)]
        packed = [alignment.pack(np.array(s), size) for s in sets]
        assert [alignment.members(p).tolist() for p in packed] == sets
        assert [alignment.popcount(p) for p in packed] == [len(s) for s in sets]
        whole = alignment.union(packed, size)
        assert alignment.members(whole).tolist() == sorted(set().union(*sets))


# --- byte-pair coding


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_round_trip(tokenizer, docs):
    rows = []
    for key, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        told = [" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)]
        rows.append((key, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in told)))
    return sorted(rows, key=str)


def test_bpe_query(spark, word_bpe):
    got = sorted((tuple(r) for r in queries.op13_bpe(spark, SF).collect()), key=str)
    assert got == plain_round_trip(word_bpe, [(r["doc_id"], r["text"]) for r in documents()])


def test_bpe_odd_texts(spark, word_bpe):
    docs = [(i % 700, t) for i, t in enumerate([*odd_texts(4000), None, "", " ", "ab" * 40_000, "x " * 40_000])] + [(None, "a")] * 2
    frame = spark.createDataFrame([(k, t, "n", 1) for k, t in docs], "doc_id long, text string, packed string, n_tokens int")
    assert sorted((tuple(r) for r in bpe.round_trip(frame).collect()), key=str) == plain_round_trip(word_bpe, docs)
    assert bpe.round_trip(frame.where("false")).count() == 0


def test_bpe_merges_against_a_plain_loop():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    r = random.Random(8)
    for _ in range(3000):
        symbols = [v.ids[c] for c in (r.choice("aeinorst") for _ in range(r.randint(0, 14)))]
        want = list(symbols)
        while ranked := [(v.merges[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in v.merges]:
            i = min(ranked)[1]
            want[i : i + 2] = [v.merges[want[i], want[i + 1]][1]]
        assert v.merge(list(symbols)) == want


def test_bpe_decodes_given_ids(spark):
    rows = [(1, np.array([320, 49407, 60_000], "<u4").tobytes()), (2, b""), (3, None)]
    got = bpe.decode(spark.createDataFrame([(k, x and bytearray(x)) for k, x in rows], "id long, packed binary"), listed="ids")
    assert [(r["id"], r["decoded"], r["ids"]) for r in got.orderBy("id").collect()] == [(1, "a</w> <|endoftext|>", "320 49407 60000"), (2, "", ""), (3, None, None)]
