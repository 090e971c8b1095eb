"""Near-duplicates of word shingles (operator 7): an inverted join on signature coordinates, then exact confirmation.

1. A pass over the texts gives each document's distinct shingles as 64-bit hashes, their number, a digest of the set, and a MinHash signature of K coordinates.
   Documents with equal sets form one class, named by its smallest doc_id and the digest (so two texts under one doc_id stay two classes); only classes go on.
2. Classes are posted under each coordinate-value pair. Two sets of the wanted similarity agree in at least M of the K coordinates but for a chance of MISS.
   So classes with fewer than M pairs that anyone shares are skipped, and of the others' shared pairs, rarest first, all but the last M - 1 suffice: any two
   classes with M in common meet in one of those.
3. Each posting list's smallest class is its pivot. Collisions of every member with its pivots are counted over all coordinates; pairs with M are confirmed on full sets. So a
   group of any number of near copies takes rows in proportion to its size.
4. What that leaves is counted next: lists whose members aren't all linked yet. In them signatures are compared in dealt blocks; pairs of different components that agree in M
   coordinates leave stars of candidate groups, in which full sets are compared, again in blocks, by exact counts. The components of all links confirmed are the result.

No posting list or group meets in one task: blocks of lists and groups are dealt out in pairs. Documents without words, and null texts, link with nothing. Null doc_ids
take no part. Of rows that repeat a doc_id, those with equal sets are one class; each row is given its own text's component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import possible, stored, unused
from byteloom.llm.components import components

#: Coordinates, their seed, the accepted chance that signatures miss a pair just at the similarity, members of a block of a list, and of a group: so many at
#: most, and about so many shingles.
K, SEED, MISS, BLOCK_LIST, BLOCK_GROUP, BLOCK_SHINGLES = 48, 20, 1e-6, 512, 256, 1 << 19
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64; kept for texts up to 1 MB."""
    global _powers
    if n > len(_powers[0]):
        factors = [np.full(max(n, 4096), p, np.uint64) for p in (_P, _INV)]
        for f in factors:
            f[0] = 1
        made = tuple(np.cumprod(f, dtype=np.uint64) for f in factors)
        if n > 1 << 20:
            return made
        _powers = made
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending. A-Z count as a-z; words are runs of other bytes than blanks and 9 to 13."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    inside = ~_IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers_to(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    w = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    n = min(words, len(w))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = _mix(h * np.uint64(_P) + w[k : len(w) - n + 1 + k])
    if len(w) < words:  # the whole sequence as one, told apart from full shingles
        h = _mix(np.uint64(len(w)) + _chain(w))
    return np.unique(h)


def _chain(w: np.ndarray) -> np.ndarray:
    h = w[:1].copy()
    for x in w[1:]:
        h = _mix(h * np.uint64(_P) + x)
    return h


def coordinates(k: int = K, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([((h * x + y) >> np.uint64(32)).min() for x, y in zip(a, b)], np.uint32)


def least_matches(percent: float, k: int = K, miss: float = MISS) -> int:
    """The most coordinates in which two sets of this similarity agree at least, but for a chance of `miss`, by the binomial distribution's tail."""
    p, tail = percent / 100, 0.0
    for m in range(k):
        tail += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if tail > miss:
            return max(1, m)
    return k


def signatures(docs: DataFrame, words: int, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_digest, sig array<int> (null without words)."""
    a, b = coordinates(k)

    def run(batches):
        for batch in batches:
            n, digests, sigs = [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), words)
                n.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sigs.append(signature(h, a, b).view(np.int32) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "set_digest", "sig"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, sig array<int>")


class _Sets:
    """Union by the smaller name."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = p = up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _stars(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node) of each set that the links make: groups of the same documents leave the same stars, which fall together."""
    sets = _Sets()
    for x, y in zip(left.tolist(), right.tolist()):
        sets.join(x, y)
    return [(x, root) for x in sets.up if (root := sets.root(x)) != x]


def _groups(batches, names: list[str]):
    """Rows of equal values in the named columns, from batches sorted by them: (columns as lists), one group at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = [0, *cut.tolist(), batch.num_rows]
        for at, to in zip(bounds, bounds[1:]):
            key, part = tuple(k[at] for k in keys), batch.slice(at, to - at)
            if held and held[0] == key:
                held[1].append(part)
            else:
                if held:
                    yield pa.Table.from_batches(held[1])
                held = (key, [part])
    if held:
        yield pa.Table.from_batches(held[1])


def _dealt(members: DataFrame, group: str, block, most: float = math.inf) -> DataFrame:
    """Members of groups of two and more, in all pairs of blocks (lo, hi) of each group: every two members meet in one of them. most: shingles that a block holds, about."""
    sizes = stored(members.groupBy(group).agg(F.count("*").alias("__n"), F.sum("n_shingles").alias("__all")).where("__n > 1"), "sizes")
    blocks = F.ceil(F.greatest(F.col("__n") / block, F.col("__all") / F.lit(float(most)))).cast("int")
    sized = members.join(sizes, group).withColumn("__blocks", F.least(F.col("__n").cast("int"), blocks))
    own = sized.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int"))
    paired = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return paired.withColumns({"lo": F.least("blk", "__other"), "hi": F.greatest("blk", "__other")}).drop("__n", "__all", "__blocks", "__other")


def _linked(links: list[tuple[int, int]], names: list) -> pa.RecordBatch:
    x, y = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array([names[i] for i in x], pa.binary()), pa.array([names[i] for i in y], pa.binary())], names=["a", "b"])


def prefixes(classes: DataFrame, need: int) -> DataFrame:
    """(pair, node, n_shingles): the postings that suffice, a stored table. pair: a coordinate and its value."""
    posted = classes.select("node", "n_shingles", F.posexplode("sig").alias("c", "v")).select("node", "n_shingles", (F.col("c").cast("long") * (1 << 32) + F.col("v").cast("long")).alias("pair"))
    shared = stored(posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"), "pairs")
    kept = posted.join(shared, "pair").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.collect_list(F.struct("n", "pair")).alias("pairs")).where(F.size("pairs") >= need)
    return stored(kept.select("node", "n_shingles", F.explode(F.slice(F.array_sort("pairs"), F.lit(1), F.size("pairs") - (need - 1))).alias("p")).select("p.pair", "node", "n_shingles"), "prefix")


def pivot_pairs(prefix: DataFrame, classes: DataFrame, need: int) -> DataFrame:
    """(a, b): members of lists and their lists' smallest class, where they agree in `need` coordinates: a stored table of at most as many rows as postings."""
    pivots = stored(prefix.groupBy("pair").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "pivots")
    met = stored(prefix.join(pivots, "pair").where("node != b").select(F.col("node").alias("a"), "b").distinct(), "met")
    sig = lambda name, as_: classes.select(F.col("node").alias(name), F.col("sig").alias(as_)).hint("merge")
    both = met.join(sig("a", "x"), "a").join(sig("b", "y"), "b")
    agree = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, e: n + e)
    return stored(both.where(agree >= need).select("a", "b"), "candidates")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, h) of the nodes: their shingles' hashes as bytes, from the text of the class's smallest document; a stored table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    wanted = nodes.select("node", _doc("node").alias("doc_id"))

    def sets(batches):
        for b in batches:
            keep, out = [], []
            for i, (t, node) in enumerate(zip(b.column("text"), b.column("node"))):
                h = shingles(t.as_py(), words).tobytes()
                if xxhash.xxh3_128_digest(h) == node.as_py()[8:]:  # another text under the same doc_id isn't meant
                    keep.append(i)
                    out.append(h)
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["node", "h"])

    some, _ = possible(texts, wanted, "doc_id")
    found = wanted.hint("merge").join(some, "doc_id").select("node", "text").mapInArrow(sets, "node binary, h binary")
    return stored(found.groupBy("node").agg(F.first("h").alias("h")), "sets")  # rows that repeat id and text give one set


def _similar(batches, percent: int):
    for t in batches:
        keep = []
        for i, (x, y) in enumerate(zip(t.column("x"), t.column("y"))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([t.column(n).take(pa.array(keep, pa.int64())) for n in ("a", "b")], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity."""
    side = lambda name, as_: sets.select(F.col("node").alias(name), F.col("h").alias(as_)).hint("merge")
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(lambda batches: _similar(batches, percent), "a binary, b binary")


def candidate_links(prefix: DataFrame, classes: DataFrame, roots: DataFrame, need: int, block: int = BLOCK_LIST) -> DataFrame:
    """Stars (a, b) of classes that different components have in common a list with and agree in `need` coordinates; roots: (node, root) of those linked already."""
    placed = prefix.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = stored(placed.groupBy("pair").agg(F.min("root").alias("lo_root"), F.max("root").alias("hi_root")).where("lo_root != hi_root").select("pair"), "mixed")
    left = placed.join(mixed, "pair")
    dealt = _dealt(left, "pair", block).join(classes.select("node", "sig").hint("merge"), "node").repartition("pair", "lo", "hi").sortWithinPartitions("pair", "lo", "hi", "node")

    def run(batches):
        for t in _groups(batches, ["pair", "lo", "hi"]):
            names, blk = t.column("node").to_pylist(), t.column("blk").to_numpy()
            root = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)[1]
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
            same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
            one = np.flatnonzero((blk == blk.min()) | same)
            two = one if same else np.flatnonzero(blk != blk.min())
            i, j = _agreeing(sig[one], sig[two], need, same, root[one], root[two])
            links = _stars(one[i], two[j])
            if links:
                yield _linked(links, names)

    return dealt.select("pair", "lo", "hi", "blk", "node", "root", "sig").mapInArrow(run, "a binary, b binary")


def _agreeing(x: np.ndarray, y: np.ndarray, need: int, same: bool, rx: np.ndarray, ry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of x and of y that agree in `need` columns or more and differ in their roots."""
    if not len(x) or not len(y):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = np.zeros((len(x), len(y)), np.int16)
    for k in range(x.shape[1]):
        n += x[:, k][:, None] == y[:, k][None, :]
    hit = (n >= need) & (rx[:, None] != ry[None, :])
    if same:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def _common(x: list[np.ndarray], y: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many shingles each set of x has in common with each of y."""
    if len(x) * len(y) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in y] for a in x])
    out = np.zeros((len(x), len(y)), np.float64)
    vx, vy = np.concatenate(x), np.concatenate(y)
    rx, ry = np.repeat(np.arange(len(x)), [len(a) for a in x]), np.repeat(np.arange(len(y)), [len(b) for b in y])
    both = np.intersect1d(np.unique(vx), np.unique(vy), assume_unique=True)
    for at in range(0, len(both), columns):
        part = both[at : at + columns]
        m = []
        for v, r, n in ((vx, rx, len(x)), (vy, ry, len(y))):
            c = np.searchsorted(part, v)
            ok = (c < len(part)) & (part[np.minimum(c, len(part) - 1)] == v)
            dense = np.zeros((n, len(part)), np.float32)
            dense[r[ok], c[ok]] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out


def group_links(groups: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK_GROUP) -> DataFrame:
    """Links (a, b) of the similarity between different components, as stars of what is linked within each pair of blocks; groups: (grp, node, root, n_shingles)."""
    dealt = _dealt(groups, "grp", block, BLOCK_SHINGLES).select("grp", "lo", "hi", "blk", "node", "root")
    spread = dealt.join(sets.hint("merge"), "node").repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "node")

    def run(batches):
        for t in _groups(batches, ["grp", "lo", "hi"]):
            names, blk = t.column("node").to_pylist(), t.column("blk").to_numpy()
            root = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)[1]
            h = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("h").combine_chunks()]
            same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
            one = np.flatnonzero((blk == blk.min()) | same)
            two = one if same else np.flatnonzero(blk != blk.min())
            if not len(two):
                continue
            both = _common([h[i] for i in one], [h[i] for i in two])
            size = np.array([len(x) for x in h])
            hit = (100 * both >= percent * (size[one][:, None] + size[two][None, :] - both)) & (root[one][:, None] != root[two][None, :])
            i, j = np.nonzero(np.triu(hit, 1) if same else hit)
            links = _stars(one[i], two[j])
            if links:
                yield _linked(links, names)

    return spread.select("grp", "lo", "hi", "blk", "node", "root", "h").mapInArrow(run, "a binary, b binary")


_TOP = -(1 << 63)


def _node(doc_id, digest):
    """A class's name: 24 bytes in the order of doc_id, then of the digest."""
    return F.concat(F.unhex(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(_TOP))), 16, "0")), digest)


def _doc(node):
    """The doc_id in a class's name."""
    return F.conv(F.hex(F.substring(F.col(node), 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_TOP))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs; links have a similarity of `percent` hundredths or more."""
    need = least_matches(percent, k)
    seen = stored(signatures(docs, words, k), "signatures")
    full = seen.where("n_shingles > 0 and doc_id is not null")
    reps = stored(full.groupBy("set_digest").agg(F.min("doc_id").alias("rep")), "reps")
    placed = stored(full.join(reps, "set_digest").select("doc_id", "rep", "n_shingles", _node(F.col("rep"), F.col("set_digest")).alias("node"), F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "placed")
    classes = stored(placed.where("doc_id = rep").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    prefix = prefixes(classes, need)
    pairs = pivot_pairs(prefix, classes, need)
    near = stored(confirmed(pairs, shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words), percent), "near")
    roots = components(near)
    groups = components(candidate_links(prefix, classes, roots, need))
    grouped = groups.select("node", F.col("root").alias("grp")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(classes.select("node", "n_shingles"), "node")
    grouped = stored(grouped.select("grp", "node", "root", "n_shingles"), "groups")
    more = stored(group_links(grouped, shingle_sets(docs, grouped.select("node"), words), percent), "more")
    linked = roots if more.isEmpty() else components(near.unionByName(more))
    found = placed.join(linked, "node", "left").select("doc_id", "n_shingles", F.coalesce(_doc("root"), F.col("rep")).alias("component_id"))
    alone = seen.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component that with the smallest doc_id, once if id and text are repeated; rows without a doc_id stay."""
    kept = stored(near_duplicates(docs, words, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct(), "kept")
    known = docs.where("doc_id is not null").join(kept, docs["doc_id"].cast("long") == kept["__kept"], "left_semi")
    tag = unused(docs, "tag")
    once = known.withColumn(tag, F.xxhash64("text")).dropDuplicates(["doc_id", tag]).drop(tag)
    return once.unionByName(docs.where("doc_id is null"))
