"""Byte-pair encoding and decoding by a priority queue over a doubly linked list.

A word starts as a list of symbols, each tied to its neighbours on both sides. A heap holds every neighbouring pair that
may be merged, by rank and then by place; the least is taken, its two symbols become one, and the pairs with the new
neighbours go into the heap. An entry whose symbols have changed meanwhile is stale and skipped. Decoding strings the
vocabulary entries of the ids together.

The vocabulary file names the normaliser and the word rule in front of the merges; those run as the file says.
"""

from __future__ import annotations

import json
import os
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import BLANK, LATIN_WORD, vocabulary_file
from .shared import python_columns


def byte_signs() -> list[str]:
    """The sign that stands for each byte: printable Latin-1 for itself, the others, in order, from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, others = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else others))
        others += b not in shown
    return out


class Vocabulary:
    """Ids, merge ranks and added strings of a byte-pair vocabulary file."""

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        stated, library = json.loads(text), Tokenizer.from_str(text)
        model = stated["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("the vocabulary must be plain byte-pair encoding")
        if stated.get("decoder") or stated.get("post_processor"):
            raise ValueError("the vocabulary must have no decoder and no post-processor of its own")
        self.normal, self.words = library.normalizer, library.pre_tokenizer
        self.suffix, self.ids = model.get("end_of_word_suffix") or "", model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.added = {t["content"]: t["id"] for t in stated["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in stated["added_tokens"]):
            raise ValueError("added strings must be matched as they are")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_rule = re.compile("|".join(map(re.escape, longest_first))) if self.added else None
        strings = {i: s for s, i in [*self.ids.items(), *self.added.items()]}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first, of equal ranks the leftmost."""
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        while heap:
            _, at, left, right, new = heappop(heap)
            follower = after[at]
            if symbols[at] != left or follower < 0 or symbols[follower] != right:
                continue  # stale: one of the two has been merged since
            symbols[at], symbols[follower] = new, -1
            after[at] = end = after[follower]
            if end >= 0:
                before[end] = at
                if m := merges.get((new, symbols[end])):
                    heappush(heap, (m[0], at, new, symbols[end], m[1]))
            start = before[at]
            if start >= 0 and (m := merges.get((symbols[start], new))):
                heappush(heap, (m[0], start, symbols[start], new, m[1]))
        return [s for s in symbols if s >= 0]

    def word(self, signs: str) -> list[int]:
        """Ids of a word given by the signs of its bytes; the last one carries the ending. Signs without an id are left out."""
        symbols = [self.ids.get(s, -1) for s in signs[:-1]] + [self.ids.get(signs[-1] + self.suffix, -1)]
        return self.merge([s for s in symbols if s >= 0])


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes. Short words are remembered, up to a number of them."""

    def __init__(self, text: str, limit: int = 300_000, longest: int = 40):
        self.vocabulary, self.limit, self.longest = Vocabulary(text), limit, longest
        self.latin, self.chunks, self.signs = {}, {}, byte_signs()

    def _latin(self, word: str) -> bytes:
        signs = self.signs
        return np.array(self.vocabulary.word("".join([signs[b] for b in word.encode()])), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        v = self.vocabulary
        text = v.normal.normalize_str(chunk) if v.normal else chunk
        cut = v.words.pre_tokenize_str(text) if text else []
        return np.array([i for w, _ in cut if w for i in v.word(w)], "<u4").tobytes()

    def _known(self, words: list[str], known: dict[str, bytes], make) -> bytes:
        if len(known) > self.limit:
            known.clear()
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = make(w)
                if len(w) <= self.longest:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if text.isascii() or _is_latin(text):
            return self._known(LATIN_WORD.findall(text.lower()), self.latin, self._latin)
        return self._known([c for c in BLANK.split(text) if c], self.chunks, self._chunk)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        v = self.vocabulary
        if not v.added_rule:
            return self._plain(text)
        out, at = [], 0
        for m in v.added_rule.finditer(text):
            out += [self._plain(text[at : m.start()]), v.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def _sent(df: DataFrame, vocabulary: str | None):
    with open(vocabulary or vocabulary_file(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, a few MB whatever the data


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, packed): the ids as little-endian unsigned 32-bit numbers, none added at the ends.

    Strings of added tokens in a text are those tokens.
    A null or empty text has no ids. Rows that repeat are rows of their own; a null id is kept. The vocabulary is the path of a
    file of plain byte-pair encoding in JSON, read by the driver. The word rule for Latin-1 text is that of the default
    vocabulary; other vocabularies must share it.
    """
    sent = _sent(docs, vocabulary)

    def make():
        encoder = Encoder(sent.value)

        def batch(b: pa.RecordBatch) -> dict:
            raw = [encoder.encode(t.as_py()) for t in b.column("text")]
            return {"n_tokens": [len(r) // 4 for r in raw], "packed": raw}

        return batch

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return python_columns(slim, make, ["id"], "n_tokens long, packed binary").withColumnRenamed("id", id_col)


def decode(
    coded: DataFrame, packed_col: str = "packed", vocabulary: str | None = None, added: str = "decoded", listed: str | None = None, digest: bool = False
) -> DataFrame:
    """Adds (or replaces) the text of packed ids: their vocabulary strings, a space between two, as the file names no decoder.

    listed names a further column for the ids themselves in decimal, a space between two. With digest both are the SHA-256
    of the text in place of it, so that only one text at a time is held. Null ids give null, no ids the empty text; ids
    outside the vocabulary are left out of the text.
    """
    sent = _sent(coded, vocabulary)
    new = [added] + [listed] * bool(listed)

    def make():
        import hashlib

        strings = Vocabulary(sent.value).strings
        final = (lambda t: hashlib.sha256(t.encode()).hexdigest()) if digest else (lambda t: t)
        texts, digits = np.array([*strings, ""], object), np.array([*map(str, range(len(strings)))], object)

        def batch(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in new}
            for raw in b.column(packed_col):
                if not raw.is_valid:
                    for c in new:
                        out[c].append(None)
                    continue
                ids = np.frombuffer(raw.as_py(), "<u4")
                inside = ids if not len(ids) or ids.max() < len(strings) else ids[ids < len(strings)]
                out[added].append(final(" ".join(texts[inside].tolist())))
                if listed:
                    out[listed].append(final(" ".join(digits[ids].tolist() if len(inside) == len(ids) else map(str, ids.tolist()))))
            return out

        return batch

    keep = [c for c in coded.columns if c not in new]
    return python_columns(coded, make, keep, ", ".join(f"{c} string" for c in new))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids in decimal and of the decoded text, of every row."""
    coded = encode(docs, id_col, text_col, vocabulary)
    text = decode(coded, "packed", vocabulary, "decoded_digest", "listed_digest", digest=True)
    return text.select(F.col(id_col), "n_tokens", F.col("listed_digest").alias("ids_sha256"), F.col("decoded_digest").alias("decoded_sha256"))
