"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become tokens with a public tokenizer; longer ones are cut. Pieces are dealt by a hash into groups of bounded
size. In a group, from the longest piece to the shortest, a segment tree over the remaining capacities finds the
tightest open bin in logarithmic time; a piece that fits nowhere opens a bin. A group is a random sample of all lengths,
so that it packs as tightly as the whole, but for its last bins.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import free, python_columns, stored

BLANK = re.compile(r"[ \t\n\r]+")
# the tokenizer's own word rule, spelled for lower-cased Latin-1 text
LATIN_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t-\r\x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")

# and as the file states it
WORD_RULE = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Places(dict):
    """Word to its place in a list that grows; words met for the first time are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, the same as from the tokenizer over the whole text.

    The tokenizer lower-cases, drops white space and encodes each word on its own, so the ids of words are remembered, up
    to a number of words and of signs. Latin-1 text is cut into words here; any other text, and text that may hold a special
    token, is cut at white space only. A text is a list of places of its words; the ids are gathered from there.
    """

    def __init__(self, model: str, limit: int = 500_000, longest: int = 40):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.signs = Tokenizer.from_str(model), limit, limit * longest
        self.plain, self.ends = None, None
        of = self.tokenizer.model
        suffix = getattr(of, "end_of_word_suffix", None)
        rule = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else None
        if suffix and rule == WORD_RULE and not self.tokenizer.post_processor:
            # words cut here need only their bytes' signs: many go in one text, and each ends in an id with the suffix
            self.plain = Tokenizer(of)
            byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), byte])
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.chunks, self.held = Places(), Places(), 0  # chunks: cut at white space only
        self.ids = {id(k): (np.empty(0, "<u4"), np.zeros(1, np.int64)) for k in (self.words, self.chunks)}

    def _cut(self, text: str) -> tuple[Places, list[str]]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return self.words, LATIN_WORD.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return self.chunks, [r for r in BLANK.split(text) if r]

    def _each(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], "<u4"), np.array([len(ids) for ids in got], np.int64)

    def _together(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) if len(ids) and ids.max() < len(self.ends) else []
        if len(last) != len(new) or last[-1] != len(ids) - 1:
            return self._each(new)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, places: Places) -> None:
        new, places.new = places.new, []
        self.held += sum(map(len, new))
        learn = self._together if self.plain and places is self.words else self._each
        got = [learn(new[at : at + 1_000]) for at in range(0, len(new), 1_000)]
        ids, ends = self.ids[id(places)]
        many = np.concatenate([np.empty(0, np.int64), *(m for _, m in got)])
        self.ids[id(places)] = np.concatenate([ids, *(own for own, _ in got)]), np.concatenate([ends, ends[-1] + np.cumsum(many)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) + len(self.chunks) > self.limit or self.held > self.signs:
            self._forget()
        cut = []
        for t in texts:
            places, words = self._cut(t) if t else (self.words, [])
            cut.append((places, np.fromiter(map(places.__getitem__, words), np.int64, len(words))))
        self._learn(self.words), self._learn(self.chunks)
        out = []
        for places, at in cut:
            ids, ends = self.ids[id(places)]
            start, many = ends[at], ends[at + 1] - ends[at]
            before = np.cumsum(many) - many
            out.append(ids[np.repeat(start - before, many) + np.arange(many.sum())].tobytes())
        return out


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, length: int = 4096, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the tokens of every document and the end id, in pieces of a length.

    A null or empty text is the end id alone. Rows are kept apart even if they share an id.
    """
    with open(vocabulary or vocabulary_file(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, a few MB whatever the data
    end, width = np.array([end_id], "<u4").tobytes(), 4 * length

    def cut():
        encoder = Encoder(sent.value)

        def batch(b):
            at, piece, start, many, crc, ids = [], [], [], [], [], []
            texts = b.column("text").to_pylist()
            encoded = (raw for i in range(0, len(texts), 256) for raw in encoder.encode(texts[i : i + 256]))
            for i, raw in enumerate(encoded):
                raw += end
                for k, a in enumerate(range(0, len(raw), width)):
                    own = raw[a : a + width]
                    at.append(i), piece.append(k), start.append(a // 4), many.append(len(own) // 4), crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
            return at, {"piece": piece, "start": start, "length": many, "ids_crc32": crc, "ids": ids}

        return batch

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    new = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return python_columns(slim, cut, ["id"], new).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of lengths that come in descending order.

    The leaves of the tree are remaining capacities, inner nodes count the open bins below them; the tightest bin for a
    length is the first leaf at or after it with an open bin.
    """
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0

    def change(leaf: int, by: int) -> None:
        at = leaves + leaf
        while at:
            tree[at] += by
            at >>= 1

    for i, need in enumerate(lengths.tolist()):
        at = leaves + need
        while not tree[at]:  # climb to the next subtree on the right
            while at & 1:
                at >>= 1
            if not at:
                break
            at += 1
        if at:
            while at < leaves:  # its leftmost open leaf
                at = 2 * at if tree[2 * at] else 2 * at + 1
            room = at - leaves
            b = open_bins[room].pop()
            change(room, -1)
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        if left:
            open_bins[left].append(b)
            change(left, 1)
    return bins, offsets


def pack(cut: DataFrame, length_col: str = "length", capacity: int = 4096, group_rows: int = 32_768) -> DataFrame:
    """Adds (or replaces) sequence_id and offset for rows with a length between 1 and the capacity; other columns stay.

    Groups have about group_rows rows, dealt by a hash of the row's place in the stored table, so that rows that repeat
    are dealt apart. Rows with null or out-of-range lengths are an error.
    """
    kept = stored(cut.drop("sequence_id", "offset"), "pieces")
    row, group = free(kept, "pack_row"), free(kept, "pack_group")
    n = kept.count()
    groups = max(1, round(n / group_rows))
    rows = kept.withColumn(row, F.monotonically_increasing_id())
    rows = rows.withColumn(group, F.pmod(F.xxhash64(row), F.lit(groups)).cast("long"))

    columns = kept.columns

    def fill(t: pa.Table) -> pa.Table:
        size = t.column(length_col).to_numpy()
        if t.column(length_col).null_count or size.min() < 1 or size.max() > capacity:
            raise ValueError(f"{length_col} must lie between 1 and {capacity}")
        order = np.lexsort((t.column(row).to_numpy(), -size))
        bins, offsets = best_fit(size[order].astype(np.int64), capacity)
        here = t.column(group)[0].as_py()
        t = t.take(pa.array(order)).select(columns)
        return t.append_column("sequence_id", pa.array(bins + (here << 32))).append_column("offset", pa.array(offsets))

    out = kept.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return rows.groupBy(group).applyInArrow(fill, out)
