"""n-gram Jaccard join: a MinHash LSH forest with exact verification.

Documents with the same set of word shingles form a class, and a class has a min-hash signature. In each tree of the forest
the signature is a path, and classes that share a prefix of it meet. The longest prefix is matched first; every pair that
meets is verified exactly from the shingles, and the prefix is shortened by one as long as the links found so far are too
few: a link of similarity s is found at a depth with a known chance p(s), so links stand for 1/p(s) links each, and the
search ends when those found are the target share of those they stand for, or at the depth where p is that large even
at the threshold. A pair is verified once: at the longest prefix it shares, in the first tree where it does.

Large meetings are cut into tiles, block against block; a tile holds a bounded number of classes and bytes. Only links that
are found are counted, per class; pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .shared import HashCache, free, mixed, python_columns, stored, word_hashes

TAGS = 64  # one byte of each of so many min-hashes, to compare signatures of classes that meet
BLOCK_BYTES = 32 << 20  # bytes of shingles in a block of a tile, but for a single class above


def shingles(text: str | None, words: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of so many words; of a shorter text the one run it is, of none nothing."""
    h = word_hashes(text, cache)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = mixed(out * np.uint64(0x100000001B3) + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


class Forest:
    """Trees of min-hash paths. depths are the prefixes to match, longest first; the last gives the recall at the threshold."""

    def __init__(self, threshold: float, recall: float, trees: int, longest: int, seed: int):
        self.trees = trees
        shortest = longest
        while shortest > 1 and self.chance(threshold, shortest) < recall:
            shortest -= 1
        self.depths = list(range(longest, shortest - 1, -1))
        rng = np.random.default_rng(seed)
        size = max(TAGS, trees * longest)
        self.factor = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = rng.integers(0, 2**63, size, dtype=np.uint64)

    def chance(self, similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
        """That two classes of a similarity share a prefix of a depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def signature(self, s: np.ndarray) -> tuple[bytes, bytes]:
        """(for each depth, as in depths, and each tree a number that names the prefix; the tags)."""
        low = np.full(len(self.factor), 2**32 - 1, np.uint32)
        for at in range(0, len(s), 256):  # blocks that stay in the cache
            h = (s[at : at + 256, None] * self.factor[None, :] + self.offset[None, :]) >> np.uint64(32)
            np.minimum(low, h.astype(np.uint32).min(0), out=low)
        longest = self.depths[0]
        path = low[: self.trees * longest].reshape(self.trees, longest).astype(np.uint64)
        key, keys = np.arange(1, self.trees + 1, dtype=np.uint64), {}
        for k in range(longest):
            key = mixed(key * np.uint64(0x100000001B3) + path[:, k])
            keys[k + 1] = key.view(np.int64)
        tags = mixed(low[:TAGS].astype(np.uint64)).astype(np.uint8)
        return b"".join(keys[d].tobytes() for d in self.depths), tags.tobytes()

    def pairs(self, keys: np.ndarray, tags: np.ndarray, left: np.ndarray, right: np.ndarray, level: int, tree: int, lowest: float) -> np.ndarray:
        """Which rows on the left and right are to be verified here: this is the longest prefix they share and the first
        tree where they do, and their signatures do not contradict the threshold. keys is (row, depth, tree)."""
        out = np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), 64):
            mine = left[at : at + 64]
            here = (tags[mine][:, None, :] == tags[right][None, :, :]).mean(2) >= lowest
            here &= keys[mine, level, tree][:, None] == keys[right, level, tree][None, :]
            if tree:
                here &= ~(keys[mine, level, :tree][:, None, :] == keys[right, level, :tree][None, :, :]).any(2)
            if level:
                here &= ~(keys[mine, level - 1][:, None, :] == keys[right, level - 1][None, :, :]).any(2)
            out[at : at + 64] = here & (mine[:, None] != right[None, :])
        return out


def _spans(b: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of the runs of equal values of sorted columns in a batch."""
    if not len(b):
        return
    values = [b.column(c).to_numpy() for c in columns]
    edge = np.r_[True, np.any([np.diff(v) != 0 for v in values], 0)]
    at = np.flatnonzero(edge)
    for start, end in zip(at, [*at[1:], len(b)]):
        yield tuple(int(v[start]) for v in values), int(start), int(end)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of the runs over all batches of a sorted partition."""
    key, parts = None, []
    for b in batches:
        for own, start, end in _spans(b, columns):
            if own != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = own
            parts.append(b.slice(start, end - start))
    if parts:
        yield key, pa.Table.from_batches(parts)


def _stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node) for what the links (lines: left, columns: right) connect, one pair per node.

    Ties to the smallest node, so that the same group found in many buckets gives the same few edges.
    """
    parent = {int(x): int(x) for x in [*left, *right]}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(linked)):
        a, b = top(int(left[i])), top(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in parent if top(x) != x]


def _tiles(rows: DataFrame, group: list[str], node: str, size: int) -> DataFrame:
    """Each row once for every tile it belongs to: the groups are cut into blocks, a tile is a pair of blocks.

    rows has the columns many and heavy, the rows and bytes of its group. tile_a and tile_b name the tile, side says which
    of its blocks.
    """
    blocks = F.ceil(F.greatest(F.col("many") / size, F.col("heavy") / BLOCK_BYTES)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node, F.lit(17)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        *[c for c in rows.columns if c not in ("blocks", "block", "other", "many", "heavy")],
        F.least("block", "other").alias("tile_a"), F.greatest("block", "other").alias("tile_b"), (F.col("block") > F.col("other")).cast("int").alias("side"),
    )


def _tile_sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both sides of a tile; a block against itself is both sides."""
    side = t.column("side").to_numpy()
    if t.column("tile_a")[0].as_py() == t.column("tile_b")[0].as_py():
        return np.arange(len(side)), np.arange(len(side))
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 1 << 21) -> np.ndarray:
    """Sizes of the intersections of the sets on the left with those on the right, as products of 0/1 matrices."""
    used = np.unique(np.r_[left, right])
    value, spot = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    line = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    several = np.flatnonzero(np.bincount(spot, minlength=len(value)) > 1)  # what only one set has is in no intersection
    place = np.full(len(value), -1)
    place[several] = np.arange(len(several))
    column = place[spot]
    line, column = line[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    line, column = line[order], column[order]
    a, b = np.searchsorted(used, left), np.searchsorted(used, right)
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(1, width // max(1, len(used)))
    for at in range(0, len(several), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(used), min(step, len(several) - at)), np.float32)
        m[line[lo:hi], column[lo:hi] - at] = 1.0
        out += np.rint(m[a] @ m[b].T).astype(np.int64)
    return out


def _pairwise(sets: list[np.ndarray], mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the masked pairs: one by one where they are few, else by matrix products."""
    lines, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    both = np.zeros(mask.shape, np.int64)
    if mask.sum() <= 2 * (len(lines) + len(columns)):
        for i, j in zip(*np.nonzero(mask)):
            both[i, j] = len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
    else:
        both[np.ix_(lines, columns)] = _common(sets, left[lines], right[columns])
    return both


def marked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    trees: int = 24,
    longest: int = 7,
    block: int = 512,
    seed: int = 6,
) -> DataFrame:
    """(id, text_hash, label, class_id, group_id, links, some) for every row; text_hash is Spark's xxhash64 of the text, 0 for null.

    class_id is the smallest id of the rows with the same shingles, group_id the smallest id of all rows that are connected
    by links (a similarity of at least the threshold), links the number of other rows that are linked with the row itself.
    label names that group whatever its ids are, group_id only as far as no id is repeated or null.
    Words are runs of letters, digits and underscores, lower-cased; a text with fewer than `words` words is one shingle.
    Rows without any word (null, empty, signs only) link with nothing: their class and group are their own id. Rows that
    share an id are rows of their own. Null ids come after all others.
    """
    forest = Forest(threshold, recall, trees, longest, seed)

    def signed():
        cache = HashCache()

        def batch(b):
            name_a, name_b, keys, tags, size = [], [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, words, cache)
                k = len(s)
                key, tag = forest.signature(s) if k else (b"", b"")
                name_a.append(int(np.bitwise_xor.reduce(mixed(s + np.uint64(1))).view(np.int64)) if k else 0)
                name_b.append(int((mixed(s).sum(dtype=np.uint64) + np.uint64(k)).view(np.int64)) if k else 0)
                keys.append(key), tags.append(tag), size.append(8 * k)
            return {"name_a": name_a, "name_b": name_b, "keys": keys, "tags": tags, "bytes": size}

        return batch

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = slim.select("id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")
    signs = stored(python_columns(hashed, signed, ["id", "text_hash"], "name_a long, name_b long, keys binary, tags binary, bytes long"), "signatures")
    some = F.length("tags") > 0
    # one row per class; a class is known by two 64-bit sums over its shingles, its first row is (id, text_hash)
    spot = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    classes = signs.where(some).groupBy("name_a", "name_b").agg(
        F.min(spot).alias("spot"), F.count(F.lit(1)).alias("rows"), F.first("keys").alias("keys"), F.first("tags").alias("tags"), F.first("bytes").alias("bytes")
    )
    classes = classes.withColumn("node", F.xxhash64("name_a", "name_b"))
    classes = stored(classes.select("node", "name_a", "name_b", F.col("spot.id").alias("first_id"), F.col("spot.text_hash").alias("first_hash"), "rows", "keys", "tags", "bytes"), "classes")

    lowest = threshold - 5 * np.sqrt(threshold * (1 - threshold) / TAGS)
    found, known = None, None
    for level in range(len(forest.depths)):
        meetings = _met(classes, forest, level, block, lowest)
        nodes = meetings.select("node").distinct()
        fresh = nodes if known is None else nodes.join(known.select("node"), "node", "left_anti")
        own = _shingled(hashed, classes.join(fresh, "node"), words)
        known = own if known is None else known.unionByName(own)
        here = _verified(meetings.join(known, "node"), forest, level, threshold, lowest)
        found = here if found is None else found.unionByName(here)
        got = found.agg(F.sum("pairs").alias("found"), F.sum(F.element_at("stands", level + 1)).alias("stands")).first()
        if got["found"] and got["found"] >= recall * got["stands"]:
            break
    groups = components(found.where("a <> b").select("a", "b"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("node", "name_a", "name_b", "first_id", "rows").join(groups, "node", "left").join(counts, "node", "left")
    named = stored(named.withColumn("label", F.coalesce("label", "node")), "named")
    heads = named.groupBy("label").agg(F.min("first_id").alias("group_id"))
    named = named.join(heads, "label").select(
        "name_a", "name_b", "label", F.col("first_id").alias("class_id"), "group_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links")
    )
    out = signs.select("id", "text_hash", "name_a", "name_b", some.alias("some")).join(named, ["name_a", "name_b"], "left")
    one = lambda c: F.when(F.col("some"), F.col(c)).otherwise(F.col("id")).alias(c)
    return out.select("id", "text_hash", "label", one("class_id"), one("group_id"), F.when(F.col("some"), F.col("links")).otherwise(F.lit(0)).alias("links"), "some")


def _met(classes: DataFrame, forest: Forest, level: int, block: int, lowest: float) -> DataFrame:
    """(prefix, tree, tile_a, tile_b, side, node) of the classes that have a pair to verify in a tile of a prefix.

    The trees of a depth are sorted by their prefixes: a run of equal ones is a meeting.
    """
    depths, trees = len(forest.depths), forest.trees

    def paths():
        def batch(b):
            own = b.column("keys").to_pylist()
            here = [np.frombuffer(k, np.int64).reshape(depths, trees)[level] for k in own]
            prefix = np.concatenate([np.empty(0, np.int64), *here])
            return np.repeat(np.arange(len(b)), trees), {"prefix": prefix, "tree": np.tile(np.arange(trees, dtype=np.int32), len(b))}

        return batch

    spread = python_columns(classes.select("node", "bytes", "keys"), paths, ["node", "bytes"], "prefix long, tree int")
    shared = spread.groupBy("prefix", "tree").agg(F.count(F.lit(1)).alias("many"), F.sum("bytes").alias("heavy")).where("many > 1")
    members = stored(spread.drop("bytes").join(shared, ["prefix", "tree"]), "members")
    tiles = _tiles(members.join(classes.select("node", "keys", "tags"), "node"), ["prefix", "tree"], "node", block)
    tiles = tiles.repartition("prefix", "tree", "tile_a", "tile_b").sortWithinPartitions("prefix", "tree", "tile_a", "tile_b", "node")

    def met(batches):
        for (prefix, tree, tile_a, tile_b), t in _runs(batches, ["prefix", "tree", "tile_a", "tile_b"]):
            keys, tags = _signatures(t, depths, trees)
            left, right = _tile_sides(t)
            if len(left) and len(right):
                mask = forest.pairs(keys, tags, left, right, level, tree, lowest)
                hit = np.unique(np.r_[left[mask.any(1)], right[mask.any(0)]])
                if len(hit):
                    t, n = t.take(pa.array(hit)), len(hit)
                    names = ["prefix", "tree", "tile_a", "tile_b", "side", "node"]
                    yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in names], names=names)

    return stored(tiles.mapInArrow(met, "prefix long, tree int, tile_a int, tile_b int, side int, node long"), "meetings")


def _signatures(t: pa.Table, depths: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(-1, depths, trees)
    return keys, np.frombuffer(b"".join(t.column("tags").to_pylist()), np.uint8).reshape(-1, TAGS)


def _shingled(hashed: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(node, rows, keys, tags, shingles) of the chosen classes, once more from the text of their first row."""
    chosen = stored(chosen, "chosen")
    # always by a shuffle: the chosen rows grow with the documents
    texts = hashed.join(chosen.hint("merge"), hashed["id"].eqNullSafe(chosen["first_id"]) & (hashed["text_hash"] == chosen["first_hash"]))
    texts = texts.select("node", "rows", "keys", "tags", "text")

    def sets():
        cache, seen = HashCache(), set()

        def batch(b):
            at = []
            for i, node in enumerate(b.column("node").to_pylist()):
                if node not in seen:  # rows that share id and text count once
                    seen.add(node)
                    at.append(i)
            return at, {"shingles": [shingles(t, words, cache).tobytes() for t in b.column("text").take(pa.array(at, pa.int64())).to_pylist()]}

        return batch

    return stored(python_columns(texts, sets, ["node", "rows", "keys", "tags"], "shingles binary"), "shingles")


def _verified(meetings: DataFrame, forest: Forest, level: int, threshold: float, lowest: float) -> DataFrame:
    """(a, b, links, pairs, tested, stands): ties of what is linked, links per class (a = b), and, on one row a tile, how many
    pairs are linked and were tested, and for each depth how many links they stand for."""
    depths, trees = len(forest.depths), forest.trees
    names = ["prefix", "tree", "tile_a", "tile_b"]

    def verify(batches):
        for (_, tree, tile_a, tile_b), t in _runs(batches, names):
            _, once = np.unique(t.column("node").to_numpy(), return_index=True)  # a skewed join may still bring a row twice
            t = t.take(pa.array(once))
            node, rows = t.column("node").to_numpy(), t.column("rows").to_numpy()
            own = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
            left, right = _tile_sides(t)
            if not len(left) or not len(right):
                continue
            mask = forest.pairs(*_signatures(t, depths, trees), left, right, level, tree, lowest)
            size = np.array([len(s) for s in own])
            both = _pairwise(own, mask, left, right)
            whole = size[left][:, None] + size[right][None, :] - both
            linked = mask & (both >= threshold * whole - 1e-9)
            links = np.zeros(len(node), np.int64)
            links[left] += linked @ rows[right]
            twice = 2 if tile_a == tile_b else 1  # a block against itself has every pair twice
            if twice == 1:
                links[right] += linked.T @ rows[left]
            similar = both[linked] / whole[linked]
            stands = [float((1 / forest.chance(similar, d)).sum() / twice) for d in forest.depths]
            edges = _stars(linked, node[left], node[right])
            hit = np.flatnonzero(links)
            a = [int(node[0]), *(e[0] for e in edges), *node[hit].tolist()]
            b = [int(node[0]), *(e[1] for e in edges), *node[hit].tolist()]
            n = [0] * (1 + len(edges)) + links[hit].tolist()
            rest = len(a) - 1
            columns = [a, b, n, [int(linked.sum()) // twice] + [0] * rest, [int(mask.sum()) // twice] + [0] * rest]
            out = [pa.array(x, pa.int64()) for x in columns]
            out.append(pa.array([stands] + [[0.0] * depths] * rest, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "links", "pairs", "tested", "stands"])

    tiles = meetings.repartition(*names).sortWithinPartitions(*names)
    return stored(tiles.mapInArrow(verify, "a long, b long, links long, pairs long, tested long, stands array<double>"), "links")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, class_id, group_id, links) for every row; see marked()."""
    return marked(docs, id_col, text_col, **settings).select(F.col("id").alias(id_col), "class_id", "group_id", "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents with one row of each group left, that with the smallest id, with all columns.

    Rows without any word are in no group and stay. Of rows with equal id and text in a group one is left.
    """
    rows = stored(marked(docs, id_col, text_col, **settings).where("some").select("id", "text_hash", "label"), "groups")
    spot = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    heads = rows.groupBy("label").agg(F.min(spot).alias("head"), F.count(F.lit(1)).alias("many")).where("many > 1")
    own = rows.groupBy("label", "id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).alias("o")
    both = own.join(heads.alias("h"), "label")
    first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))
    both = stored(both.select("id", "text_hash", "rows", first.alias("first")).where("not first or rows > 1"), "spare")
    key, uid, mark = (free(docs, n) for n in ("near_hash", "near_id", "near_text"))
    hashed = docs.withColumn(key, F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0)))

    def same(t: DataFrame):
        return hashed[id_col].eqNullSafe(t[uid]) & (hashed[key] == t[mark])

    spare = both.where("not first").select(F.col("id").alias(uid), F.col("text_hash").alias(mark))
    left = hashed.join(spare.hint("merge"), same(spare), "left_anti")  # by a shuffle: the spare rows grow with the documents
    repeated = both.where("first").select(F.col("id").alias(uid), F.col("text_hash").alias(mark))
    if not repeated.isEmpty():
        one = hashed.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, key])
        left = left.join(repeated, left[id_col].eqNullSafe(repeated[uid]) & (left[key] == repeated[mark]), "left_anti").unionByName(one)
    return left.drop(key)
