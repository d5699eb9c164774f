"""SimHash near-dedup (operator 2): components of close fingerprints.

Method: a Gray-order hierarchical index.  Distinct fingerprints are sorted by
Gray rank, so neighbours share most bits; every run of ``FANOUT`` nodes gets a
parent that holds the bits on which all of them agree as a masked pattern, and
the children keep only what their parent does not say.  A join of the index
with itself walks down pairs of nodes, adds up the bits on which their patterns
must differ, and drops a whole pair of groups once that passes the radius.

Distribution: two fingerprints within ``radius`` bits agree on one of
``radius + 1`` blocks, so each fingerprint goes to that many keys (block number
and value), and one index is built over the keys of a partition, each key a root.
A key with more than ``KEY_ROWS`` fingerprints is split again by the same
argument over the bits its key does not fix, until each key is small or fixes so
many bits that it cannot be large.  Nothing is capped: the splits lose no pair.
Each partition returns a spanning forest of its links, and the components of
all forests come from rounds of star contraction over stored edge tables.

Defined results: a null text has no words; a text without words has fingerprint
zero, linked like any other; fewer than ``shingle`` words make one shingle;
repeated rows are kept; a null doc_id is kept and is a component's id only if
the component has no other id; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, text_bytes

SHINGLE, RADIUS, SEED = 3, 3, 42
FANOUT = 8
#: A key with more fingerprints than this is split; rows a partition's index is planned to hold.
KEY_ROWS, PARTITION_ROWS = 4_000, 40_000
#: Node pairs looked at together, which bounds the join's memory.
FRONTIER = 400_000


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text: the bits set in over half of their hashes."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[span:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry`` and ``fingerprint`` (long: the 64 bits, two's complement) of each row of ``docs``."""

    def run(texts: list[bytes | None]) -> list[np.ndarray]:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs.select(F.col("doc_id").cast("long"), *carry, "text"), ["doc_id", *carry], lambda: run, {"fingerprint": "long"}, text_bytes())


# --- the index and its self-join --------------------------------------------


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected Gray sequence (prefix xor from the top bit)."""
    f = f.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(shift)
    return f


class Level:
    """Nodes of one height: first child, number of children, shared mask and pattern, and what the parent adds."""

    def __init__(self, first: np.ndarray, count: np.ndarray, ones: np.ndarray, zeros: np.ndarray, root: np.ndarray):
        self.first, self.count, self.ones, self.zeros, self.root = first, count, ones, zeros, root
        self.mask, self.pattern = ones | zeros, ones  # bits on which all below agree, and their values
        self.own = self.mask  # bits that this node says and its parent does not


def build(keys: np.ndarray, f: np.ndarray) -> list[Level]:
    """Levels from the leaves up, for rows sorted by (key, Gray rank); the last has one node per key."""
    n = len(f)
    root = np.cumsum(np.r_[False, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    levels = [Level(np.arange(n), np.ones(n, np.int64), f, ~f, root)]
    while len(levels[-1].root) > (levels[-1].root[-1] + 1 if n else 0):
        low = levels[-1]
        begin = np.flatnonzero(np.r_[True, low.root[1:] != low.root[:-1]])
        inside = np.arange(len(low.root)) - np.repeat(begin, np.diff(np.r_[begin, len(low.root)]))
        first = np.flatnonzero(inside % FANOUT == 0)
        count = np.diff(np.r_[first, len(low.root)])
        up = Level(first, count, np.bitwise_and.reduceat(low.ones, first), np.bitwise_and.reduceat(low.zeros, first), low.root[first])
        low.own = low.mask & ~np.repeat(up.mask, count)
        levels.append(up)
    return levels


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def self_join(keys: np.ndarray, f: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that span every component of rows with equal key within ``radius`` bits.

    Rows are sorted by (key, Gray rank) with no equal rows.  Pairs of nodes are
    walked top down with the differences added up so far: one node's shared
    bits against the other's.  A pair is dropped when they pass the radius, and
    also when both of its groups are known to lie in one component already.
    """
    levels = build(keys, f)
    n = len(f)
    parent = np.arange(n)
    left, right = [], []
    spread = [np.bitwise_count(~lv.mask).astype(np.int64) for lv in levels]
    first_leaf = [np.arange(n)]
    leaf_count = [np.ones(n, np.int64)]
    for lv in levels[1:]:
        first_leaf.append(first_leaf[-1][lv.first])
        leaf_count.append(np.add.reduceat(leaf_count[-1], lv.first))

    def link(a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of each a and b, keeping the pairs that joined two."""
        while len(a):
            ra, rb = find(parent, a), find(parent, b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, once = np.unique(high, return_index=True)
            parent[high[once]] = low[once]
            left.append(a[once])
            right.append(b[once])

    def whole(height: int) -> np.ndarray:
        """For each node its component if all its leaves share one, else -1 - node."""
        parent[:] = roots = find(parent, np.arange(n))
        at = first_leaf[height]
        low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
        return np.where(low == high, low, -1 - np.arange(len(at)))

    # groups whose members cannot differ by more than the radius are one component at once
    for height in range(len(levels) - 1, 0, -1):
        tight = np.flatnonzero(spread[height] <= radius)
        if len(tight):
            size = leaf_count[height][tight] - 1
            base = np.repeat(first_leaf[height][tight], size)
            step = np.arange(len(base)) - np.repeat(np.cumsum(size) - size, size)
            link(base + step, base + step + 1)

    top = len(levels) - 1
    every = np.arange(len(levels[top].root)) if n else np.zeros(0, np.int64)
    stack = [(top, x := every[i : i + FRONTIER], x, np.zeros(len(x), np.int64)) for i in range(0, len(every), FRONTIER)]
    while stack:
        height, a, b, so_far = stack.pop()
        part = whole(height)
        alike = (part[a] == part[b]) & (part[a] >= 0)
        a, b, so_far = a[~alike], b[~alike], so_far[~alike]
        if not len(a):
            continue
        low = levels[height - 1]
        lv = levels[height]
        na, nb = lv.count[a], lv.count[b]
        total = na * nb
        for lo in _lots(total, FRONTIER):
            rows = np.arange(lo[0], lo[1])
            reps = total[rows]
            pick = np.repeat(rows, reps)
            k = np.arange(len(pick)) - np.repeat(np.cumsum(reps) - reps, reps)
            x = lv.first[a[pick]] + k // nb[pick]
            y = lv.first[b[pick]] + k % nb[pick]
            keep = (x < y) | ((x == y) if height > 1 else False)
            x, y = x[keep], y[keep]
            unseen = (low.own[x] & low.mask[y]) | (low.mask[x] & low.own[y])
            differ = so_far[pick[keep]] + np.bitwise_count((low.pattern[x] ^ low.pattern[y]) & unseen)
            near = differ <= radius
            x, y, differ = x[near], y[near], differ[near]
            if height == 1:
                link(x, y)
            elif len(x):
                stack.append((height - 1, x, y, differ))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _lots(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, stop
        at = stop


# --- distribution -----------------------------------------------------------


def block_masks(depth: int, radius: int = RADIUS) -> list[int]:
    """For each path of block choices down to ``depth``, the bits its keys fix.

    A path's last step fixes one of ``radius + 1`` blocks of the bits that its
    earlier steps left free.
    """
    parts = radius + 1
    if depth == 0:
        return [0]
    out = []
    for fixed in block_masks(depth - 1, radius):
        free = [bit for bit in range(64) if not fixed >> bit & 1]
        for k in range(parts):
            out.append(fixed | sum(1 << bit for bit in free[len(free) * k // parts : len(free) * (k + 1) // parts]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deepest(key_rows: int, radius: int = RADIUS) -> int:
    """The depth at which every key leaves so few bits free that it holds ``key_rows`` at most."""
    depth = 1
    while max(64 - m.bit_count() for m in block_masks(depth, radius)) > max(1, key_rows).bit_length() - 1 and depth < 6:
        depth += 1
    return depth


def keyed(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Rows (path, key, fingerprint): each close pair of fingerprints shares some (path, key)."""
    parts = radius + 1
    cold, rows, last = None, fps.select("fingerprint", F.lit(0).alias("path")), deepest(key_rows, radius)
    for depth in range(1, last + 1):
        masks = F.array(*[F.lit(_signed(m)) for m in block_masks(depth, radius)])
        step = F.explode(F.array(*[F.lit(k) for k in range(parts)])).alias("step")
        rows = rows.select("fingerprint", "path", step).select("fingerprint", (F.col("path") * parts + F.col("step")).alias("path"))
        rows = rows.withColumn("key", F.col("fingerprint").bitwiseAND(F.get(masks, F.col("path"))))
        rows = rows.select(F.lit(depth).alias("depth"), "path", "key", "fingerprint")
        large = None
        if depth < last:
            large = scratch.keep(rows.groupBy("path", "key").count().filter(F.col("count") > key_rows).select("path", "key"))
        if large is None or large.isEmpty():
            return rows if cold is None else cold.unionByName(rows)
        small = rows.join(large, ["path", "key"], "left_anti")
        cold = small if cold is None else cold.unionByName(small)
        rows = scratch.keep(rows.join(large, ["path", "key"], "left_semi").select("fingerprint", "path"))
    return cold


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, key_rows: int = KEY_ROWS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Pairs (hi, lo) of distinct fingerprints within ``radius`` that span every component."""
    rows = scratch.keep(keyed(fps, scratch, radius, key_rows))
    n = max(1, -(-rows.count() // partition_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lots = [b for b in batches if len(b)]
        if not lots:
            return
        path, key, f = (np.concatenate([b[c].to_numpy() for b in lots]) for c in ("group", "key", "fingerprint"))
        f = f.view(np.uint64)
        order = np.lexsort((gray_rank(f), key, path))
        path, key, f = path[order], key[order], f[order]
        owner = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
        a, b = self_join(owner, f, radius)
        a, b = f[a].view(np.int64), f[b].view(np.int64)
        yield pd.DataFrame({"hi": np.maximum(a, b), "lo": np.minimum(a, b)})

    group = (F.col("depth").cast("long") * (1 << 20) + F.col("path")).alias("group")
    dealt = rows.select(group, "key", "fingerprint").repartition(n, "group", "key")
    return dealt.mapInPandas(run, "hi long, lo long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (hi > lo), by alternating star contraction.

    Each round hangs a node's larger neighbours on the smallest node near it,
    then all of its smaller ones; a round that changes nothing has found the
    stars.  Rounds are stored, minima are summed before they are shuffled, and
    the joins have one row per node on the minima's side, so AQE may split a
    node with many neighbours.
    """
    e = scratch.keep(edges)
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        mark = now
        near = e.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(e.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        least = near.groupBy("node").agg(F.min("other").alias("m")).select(F.col("node").alias("lo"), F.least("node", "m").alias("m"))
        wide = e.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
        least = wide.groupBy("hi").agg(F.min("lo").alias("m"))
        tight = wide.join(least, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        done, e = e, scratch.keep(tight.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        scratch.drop(done)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the component) per document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, shingle))
    fps = scratch.keep(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    found = components(links(fps, scratch, radius, key_rows), scratch)
    linked = fps.join(found, fps.fingerprint == found.node).select("fingerprint", "first", "root")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(smallest, "root").select("fingerprint", "least")
    owner = scratch.keep(
        fps.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id"))
    )
    return marked.join(owner, "fingerprint").select("doc_id", hex16("fingerprint").alias("fingerprint"), "component_id")


def hex16(column: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null last), then text hash.

    A row is known by its id and the hash of its text, so neither clashing nor
    null ids decide what is a copy.  Of repeated rows one is left; the repeats
    are combined before the texts are shuffled, so their number does not matter.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    digest = F.xxhash64("text").alias("__digest")
    marked = scratch.keep(fingerprints(docs.select("doc_id", "text", digest), shingle, ("__digest",)))
    row = F.struct(F.col("doc_id").isNull().alias("__no_id"), F.coalesce("doc_id", F.lit(0)).alias("__id"), "__digest")
    fps = scratch.keep(marked.groupBy("fingerprint").agg(F.min(row).alias("first")))
    found = components(links(fps.select("fingerprint"), scratch, radius, key_rows), scratch)
    rooted = fps.join(found, fps.fingerprint == found.node, "left")
    first = rooted.groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("first").alias("first")).select("first.*")

    key = ["__no_id", "__id", "__digest"]
    doc_id = F.col("doc_id").cast("long")
    others = F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    whole = docs.select(
        doc_id.isNull().alias("__no_id"), F.coalesce(doc_id, F.lit(0)).alias("__id"), digest,
        F.xxhash64(F.to_json(others)).alias("__tie"), F.struct(*docs.columns).alias("__row"),
    )
    single = whole.groupBy(*key).agg(F.min_by("__row", "__tie").alias("__row"))
    return single.join(scratch.keep(first), key, "left_semi").select("__row.*")
