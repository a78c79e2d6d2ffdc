"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Wherever a token of A and a token of B end at the same byte, the two are linked. Documents are numbered within blocks, and
every id pair has one list of postings a block: compressed bitmaps of the documents that hold the pair, one for each
binary digit of its number of links there (multiplicity planes). The OR of the planes, popcounted, is the number of
documents; the popcounts of the planes, weighed by their digit, are the number of links. Sums over blocks give the
corpus-wide counts, and the postings carry the pairs' scores back to the documents of their block.

Texts are cut in front of white space, where neither tokenizer lets a token reach across, so that the parts of a text are
encoded once each and remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import byte_signs
from .packing import vocabulary_file
from .shared import folder

CUT = re.compile(r"(?<=\S)(?=[ \t\n])")
DIGITS = 16  # bits of a document's number in its block
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 23


def pack(members: np.ndarray, size: int) -> bytes:
    """A set of numbers below size: a byte 0 and the sorted 16-bit members, or a byte 1 and one bit a number, what is shorter."""
    if 2 * len(members) <= (size + 7) // 8:
        return b"\0" + members.astype("<u2").tobytes()
    bits = np.zeros(size, np.uint8)
    bits[members] = 1
    return b"\1" + np.packbits(bits).tobytes()


def members(bitmap: bytes) -> np.ndarray:
    if bitmap[:1] == b"\0":
        return np.frombuffer(bitmap, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1)))


def popcount(bitmap: bytes) -> int:
    if bitmap[:1] == b"\0":
        return (len(bitmap) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, np.uint8, offset=1)).sum())


def union(bitmaps: list[bytes], size: int) -> bytes:
    """The OR of bitmaps of numbers below size."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    bits = np.zeros((size + 7) // 8, np.uint8)
    for b in bitmaps:
        if b[:1] == b"\1":
            bits |= np.frombuffer(b, np.uint8, offset=1)
        else:
            own = members(b)
            np.bitwise_or.at(bits, own >> 3, np.uint8(128) >> (own & 7).astype(np.uint8))
    return pack(np.flatnonzero(np.unpackbits(bits)), size)


@dataclass(frozen=True)
class Vocabularies:
    """The two models as they travel to the tasks."""

    a: str
    b: bytes

    @classmethod
    def load(cls, a: str | None = None, b: str | None = None) -> Vocabularies:
        """From the paths of a byte-level vocabulary (JSON) and a sentencepiece model with byte fallback, read by the driver.

        The blank that B puts in front of a text is written into the text instead.
        """
        from sentencepiece import sentencepiece_model_pb2

        with open(a or vocabulary_file("byte_bpe_50k.json"), encoding="utf-8") as f:
            stated = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        with open(b or vocabulary_file("piece_bpe_32k.model"), "rb") as f:
            model.ParseFromString(f.read())
        rule = model.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
            raise ValueError("B must leave texts as they are, but for a blank in front")
        rule.add_dummy_prefix = False
        return cls(stated, model.SerializeToString())


class Aligner:
    """Ids and links of the parts of texts, remembered up to a number of parts."""

    def __init__(self, models: Vocabularies, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.limit = limit
        self.a, self.b = Tokenizer.from_str(models.a), sentencepiece.SentencePieceProcessor(model_proto=models.b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte_of = {s: i for i, s in enumerate(byte_signs())}
        self.bytes_a = [bytes(byte_of[c] for c in s) for s in map(self.a.id_to_token, range(self.a.get_vocab_size(False)))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width = len(pieces)
        # no piece reaches over a cut, or else texts are not cut
        self.cut = CUT if not any(re.search("[^▁][▁\t\n]", p) for p in pieces) else None
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.inner_a, self.inner_b = (np.array([f"{i}," for i in range(len(t))], object) for t in (self.bytes_a, self.bytes_b))
        self.last_a = np.array([f"{i}|" for i in range(len(self.bytes_a))], object)
        self.last_b = np.array([f"{i};" for i in range(self.width)], object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((0, 4), np.int64)  # of each part: tokens of A, tokens of B, links, 1 if the bytes differ
        self.first = np.empty(0, np.int64)  # the place of a part's first link
        self.links = np.empty(0, np.int64)  # id of A * width + id of B

    def parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def learn(self, new: list[str]) -> None:
        """Encodes parts and links their tokens, all at once: the bytes of the parts, one after the other, are one line."""
        ids_a = [e.ids for at in range(0, len(new), 10_000) for e in self.a.encode_batch_fast(new[at : at + 10_000], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = [b"".join(map(get_a, x)) == (raw := part.encode()) and b"".join(map(get_b, y)) == raw for part, x, y in zip(new, ids_a, ids_b)]
        counts = np.zeros((len(new), 4), np.int64)
        counts[:, 3] = ~np.array(same, bool)
        ids_a, ids_b = ([x if s else [] for x, s in zip(ids, same)] for ids in (ids_a, ids_b))
        for k, ids in enumerate((ids_a, ids_b)):
            counts[:, k] = np.fromiter(map(len, ids), np.int64, len(ids))
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64, int(counts[:, k].sum())) for k, ids in enumerate((ids_a, ids_b)))
        end_a, end_b = self.length_a[flat_a].cumsum(), self.length_b[flat_b].cumsum()
        meet = np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = end_a.searchsorted(meet), end_b.searchsorted(meet)
        # the last byte of a part is an end of both
        part_of = np.repeat(np.arange(len(new)), counts[:, 0])[at_a]
        counts[:, 2] = np.bincount(part_of, minlength=len(new))
        # tokens in the order of groups, A before B; the last token of a group closes its side
        text_a, text_b = self.inner_a[flat_a], self.inner_b[flat_b]
        text_a[at_a], text_b[at_b] = self.last_a[flat_a[at_a]], self.last_b[flat_b[at_b]]
        group_a, group_b = meet.searchsorted(end_a), meet.searchsorted(end_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = np.concatenate([text_a, text_b])[order].tolist()
        ends = (counts[:, 0] + counts[:, 1]).cumsum().tolist()
        self.groups += ["".join(written[s:e]) for s, e in zip([0, *ends], ends)]
        self.first = np.concatenate([self.first, len(self.links) + counts[:, 2].cumsum() - counts[:, 2]])
        self.links = np.concatenate([self.links, flat_a[at_a] * self.width + flat_b[at_b]])
        self.known |= zip(new, range(len(self.counts), len(self.counts) + len(new)))
        self.counts = np.concatenate([self.counts, counts])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For a few texts: the counts of each, its groups as text, and of all links the pair and the number of the text."""
        if len(self.known) > self.limit:
            self.forget()
        cut = [self.parts(" " + t) if t else [] for t in texts]
        new = list(dict.fromkeys(p for parts in cut for p in parts if p not in self.known))
        if new:
            self.learn(new)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter((self.known[p] for parts in cut for p in parts), np.int64, int(many.sum()))
        owner = np.repeat(np.arange(len(cut)), many)
        counts = np.stack([np.bincount(owner, self.counts[at, k], len(cut)) for k in range(4)], 1).astype(np.int64)
        whole = counts[:, 3] == 0
        counts[~whole] = 0
        groups, start = [], 0
        for n, ok in zip(many.tolist(), whole.tolist()):
            groups.append("".join([self.groups[i] for i in at[start : start + n].tolist()])[:-1] if ok else "")
            start += n
        kept = whole[owner]
        at, owner = at[kept], owner[kept]
        n_links = self.counts[at, 2]
        ends = n_links.cumsum()
        place = np.arange(int(n_links.sum())) + np.repeat(self.first[at] - (ends - n_links), n_links)
        return counts, groups, self.links[place], np.repeat(owner, n_links)


def _postings(keys: np.ndarray, counts: np.ndarray, size: int) -> Iterator[tuple[int, list[bytes], int, int]]:
    """(pair, planes, links, documents) from sorted keys (pair, document) and their numbers of links."""
    pair, doc = keys >> DIGITS, keys & ((1 << DIGITS) - 1)
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        own, many = doc[s:e], counts[s:e]
        top = int(many.max())
        planes = [pack(own, size)] if top == 1 else [pack(own[(many >> k) & 1 == 1], size) for k in range(top.bit_length())]
        yield int(pair[s]), planes, sum(popcount(p) << k for k, p in enumerate(planes)), popcount(union(planes, size))


@dataclass(frozen=True)
class Index:
    """docs: (block, pos, id, n_a, n_b, n_groups, n_links, groups); postings: (block, a, b, planes, links, docs)."""

    docs: DataFrame
    postings: DataFrame


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Vocabularies | None = None, with_groups: bool = False) -> Index:
    """Both tables of the alignment, written to the shared folder in one pass over the documents.

    groups is the text `a1,a2|b1;a3|b2,b3` or, without with_groups, its SHA-256; an empty text where a document has no
    tokens: its text is null or empty, or one of the tokenizers does not give its bytes back. A block holds up to
    BLOCK_DOCS documents or about BLOCK_POSTINGS (document, pair) entries of one task. Rows that repeat are documents of
    their own.
    """
    spark = docs.sparkSession
    models = models or Vocabularies.load()
    sent = spark.sparkContext.broadcast((models.a, models.b))  # two vocabularies, a few MB whatever the data
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    added = "n_a long, n_b long, n_groups long, n_links long, groups string, a int, b int, planes array<binary>, links long, docs long"
    head = [T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("pos", T.IntegerType()), slim.schema["id"]]
    schema = T.StructType([*head, *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        aligner, arrow, id_type = Aligner(Vocabularies(*sent.value)), None, None
        block, pos, keys, many = TaskContext.get().partitionId() << 32, 0, [], []

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, pos
            key = np.concatenate([*keys, np.empty(0, np.int64)])
            order = np.argsort(key, kind="stable")
            found = list(_postings(key[order], np.concatenate([*many, np.empty(0, np.int64)])[order], pos))
            for at in range(0, len(found), 20_000):
                pair, planes, links, own = zip(*found[at : at + 20_000])
                pair, n = np.array(pair, np.int64), len(pair)
                yield rows(
                    n,
                    kind=pa.array(["postings"] * n), block=pa.array([block] * n, pa.int64()), a=pa.array((pair // aligner.width).astype(np.int32)),
                    b=pa.array((pair % aligner.width).astype(np.int32)), planes=pa.array(planes, pa.list_(pa.binary())), links=pa.array(links, pa.int64()),
                    docs=pa.array(own, pa.int64()),
                )
            block, pos = block + 1, 0
            keys.clear(), many.clear()

        for b in batches:
            if arrow is None:
                id_type = b.schema.field("id").type
                arrow = pa.schema([(f.name, id_type if f.name == "id" else _arrow(f.dataType)) for f in schema])
            texts, at = b.column("text"), 0
            while at < b.num_rows:
                room, own, held = min(BLOCK_DOCS - pos, 1_024), [], 0
                while at + len(own) < b.num_rows and len(own) < room and held < 2_000_000:
                    own.append(texts[at + len(own)].as_py())
                    held += len(own[-1] or "")
                counts, groups, pair, doc = aligner.align(own)
                key, n = np.unique((pair << DIGITS) + pos + doc, return_counts=True)
                keys.append(key), many.append(n)
                if not with_groups:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield rows(
                    len(own),
                    kind=pa.array(["docs"] * len(own)), block=pa.array([block] * len(own), pa.int64()), pos=pa.array(range(pos, pos + len(own)), pa.int32()),
                    id=b.column("id").slice(at, len(own)), n_a=pa.array(counts[:, 0]), n_b=pa.array(counts[:, 1]), n_groups=pa.array(counts[:, 2]),
                    n_links=pa.array(counts[:, 2]), groups=pa.array(groups, pa.string()),
                )
                at, pos = at + len(own), pos + len(own)
                if pos >= BLOCK_DOCS or sum(map(len, keys)) >= BLOCK_POSTINGS:
                    yield from flush()
        if pos:
            yield from flush()

    path = folder(spark, "alignment")
    slim.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    docs_rows, posting_rows = (spark.read.schema(schema).parquet(path).where(F.col("kind") == k) for k in ("docs", "postings"))
    return Index(
        docs_rows.select("block", "pos", "id", "n_a", "n_b", "n_groups", "n_links", "groups").withColumnRenamed("id", id_col),
        posting_rows.select("block", "a", "b", "planes", "links", "docs"),
    )


def _arrow(kind: T.DataType) -> pa.DataType:
    plain = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return plain.get(kind.simpleString()) or pa.list_(pa.binary())


def pairs(found: Index) -> DataFrame:
    """(a, b, n_links, n_docs, best): corpus-wide counts of every id pair, and whether no A id is linked to this B id more often."""
    counted = found.postings.groupBy("a", "b").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_docs"))
    # one row an id of B: a vocabulary's size whatever the data
    top = counted.groupBy("b").agg(F.max("n_links").alias("most"))
    return counted.join(F.broadcast(top), "b").select("a", "b", "n_links", "n_docs", (F.col("n_links") == F.col("most")).alias("best"))


def scores(found: Index) -> DataFrame:
    """The docs of an index, with n_best (links whose pair is best) and count_sum (the pairs' link counts over all links).

    A pair's score meets its postings once a block; a block's postings and documents meet in one group of bounded size,
    where every plane adds its digit's share of the score to the documents it names.
    """
    told = pairs(found).select("a", "b", F.col("n_links").alias("score"), "best")
    back = found.postings.select("block", "a", "b", "planes").join(told, ["a", "b"]).select("block", "planes", "score", "best")
    schema = T.StructType([f for f in found.docs.schema if f.name not in ("block", "pos")] + T.StructType.fromDDL("n_best long, count_sum long").fields)

    def give(postings: pa.Table, docs: pa.Table) -> pa.Table:
        n_best, count_sum = np.zeros(1 << DIGITS, np.int64), np.zeros(1 << DIGITS, np.int64)
        for planes, score, best in zip(*(postings.column(c) for c in ("planes", "score", "best"))):
            score, best = score.as_py(), best.as_py()
            for k, plane in enumerate(planes.as_py()):
                own = members(plane)
                count_sum[own] += score << k
                if best:
                    n_best[own] += 1 << k
        at = docs.column("pos").to_numpy()
        return docs.drop_columns(["block", "pos"]).append_column("n_best", pa.array(n_best[at])).append_column("count_sum", pa.array(count_sum[at]))

    return back.groupBy("block").cogroup(found.docs.groupBy("block")).applyInArrow(give, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Vocabularies | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; zeros and '' without tokens.

    An id column named like one of the others is not allowed; other columns are not read.
    """
    got = scores(index(docs, id_col, text_col, models)).withColumnRenamed("groups", "groups_sha256")
    return got.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
