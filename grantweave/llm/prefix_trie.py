"""Conversation prefix trie (operator 12): what conversations have in common from their first turn on.

Method: vertical bitmaps.  Conversations are cut into shards of neighbouring
ids.  A shard indexes (position, turn) to the bitset of its conversations that
have that turn there; from the root down, depth first, a parent's bitset
intersected with the postings of the next position gives each child, whose
popcount is its number of conversations and whose members without a further turn
are its end list.

Only digests of turns are shuffled, never texts.  A prefix is known by the chain
of its turns' digests (128 bits), so the shards' nodes meet under one key, with a
row per shard at most: a first turn or a whole conversation that a third of all
conversations share is summed in every shard before.  What needs a node's whole
subtree is split so that shards can add it up alone: a node's conversations are
the sum over shards, and each node of the trie counts itself and as a leaf in the
one shard that holds its smallest member.  Sums over subtrees are then differences
of running sums in depth-first order, without a pass per depth.  End lists are hashed
in a stream, in the order of shards, so no list is held whole.

Defined results: turns are in order of their number (null first); those that
share one follow the digest of role and text, and repeated rows are all turns; a
null role or text is empty; rows without a conv_id belong to no conversation; a
conversation that loses all its turns ends at the root; ids may be negative
(``%`` keeps the sign, as in SQL) and any long; an empty table has no root;
extra columns are not read.  The nodes of one conversation, about 0.6 kB a
turn, are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Ids of a block share its first one's head; the head is up to ``HEADS - 1`` turns long.
BLOCK, HEADS = 20, 4
#: A shard is closed at this many conversations or turns.
SHARD_CONVERSATIONS, SHARD_TURNS = 4_096, 200_000
ROOT = bytes(16)
_NODE = "shard long, ord int, last int, key binary, parent binary, depth long, conv_id long, n long, words long, ends binary"
_NODE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def turn_rows(turns: DataFrame) -> DataFrame:
    """head (the id that a conversation's block starts with), c, h, turn, digest and words of every turn."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    out = turns.select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).filter(F.col("c").isNotNull())
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    return out.select((F.col("c") - F.col("c") % BLOCK).alias("head"), "c", h.alias("h"), "turn", "digest", "words")


class Shard:
    """Conversations of neighbouring ids, each a list of (digest, words)."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.turns: list[list[tuple[bytes, int]]] = []
        self.size = 0

    def add(self, block: list[tuple[int, int, list[tuple[bytes, int]]]], head: int) -> None:
        """The conversations (id, h, own turns) of one block, rebuilt with its head's first turns."""
        first = next((own for c, _, own in block if c == head), [])
        for c, h, own in block:
            self.ids.append(c)
            self.turns.append(first[:h] + own[h:])
            self.size += len(self.turns[-1])

    def nodes(self) -> list[tuple]:
        """A row (``_NODE``) per node of this shard's trie, in depth-first order."""
        ids, turns = np.array(self.ids, "<i8"), self.turns
        postings: list[dict[bytes, int]] = []
        ends: dict[int, int] = {}
        for i, own in enumerate(turns):
            bit = 1 << i
            while len(postings) < len(own):
                postings.append({})
            for at, (digest, _) in zip(postings, own):
                at[digest] = at.get(digest, 0) | bit
            ends[len(own)] = ends.get(len(own), 0) | bit
        rows: list[list] = []
        above: list[int] = []
        wait = [((1 << len(ids)) - 1, 0, -1, ROOT, 0)]
        while wait:
            members, depth, up, key, words = wait.pop()
            done = members & ends.get(depth, 0)
            here = len(rows)
            first = (members & -members).bit_length() - 1
            listed = ids[_ones(done)].tobytes() if done else None
            rows.append([self.ids[0], here, here, key, rows[up][3] if up >= 0 else None, depth, self.ids[first], members.bit_count(), words, listed])
            above.append(up)
            rest = members ^ done
            while rest:
                digest, said = turns[(rest & -rest).bit_length() - 1][depth]
                child = members & postings[depth][digest]
                rest &= ~child
                wait.append((child, depth + 1, here, hashlib.blake2b(key + digest, digest_size=16).digest(), said))
        for here in range(len(rows) - 1, 0, -1):
            up = rows[above[here]]
            up[2] = max(up[2], rows[here][2])
        return rows


def _ones(bits: int) -> np.ndarray:
    """Positions of the bits that are set."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def shard_nodes(turns: DataFrame, conversations: int, most_turns: int) -> DataFrame:
    """The nodes of every shard's trie, a shard known by its first conversation's id."""

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _NODE_TYPES)], [x.split()[0] for x in _NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, at = Shard(), [], None

        def shards(full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if shard.ids and (full or len(shard.ids) >= conversations or shard.size >= most_turns):
                rows = shard.nodes()
                shard = Shard()
                for k in range(0, len(rows), 50_000):
                    yield batch(rows[k : k + 50_000])

        for b in batches:
            for head, c, h, digest, words in zip(*(b.column(x).to_pylist() for x in ("head", "c", "h", "digest", "words"))):
                if head != at:
                    if block:
                        shard.add(block, at)
                        yield from shards(False)
                    block, at = [], head
                if not block or block[-1][0] != c:
                    block.append((c, h, []))
                block[-1][2].append((digest, words))
        if block:
            shard.add(block, at)
        yield from shards(True)

    order = [F.asc("head"), F.asc("c"), F.asc_nulls_first("turn"), F.asc("digest")]
    return turns.repartitionByRange("head").sortWithinPartitions(*order).drop("turn").mapInArrow(run, _NODE)


def _end_hashes(nodes: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes where conversations end: their lists hashed one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            keys, out = [], []
            for key, listed in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
                if key != at:
                    if state is not None:
                        keys.append(at)
                        out.append(state.hexdigest())
                    at, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, np.frombuffer(listed, "<i8").tolist())).encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    ended = nodes.filter(F.col("ends").isNotNull()).select("key", "shard", "ends")
    return ended.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(run, "key binary, ends_sha256 string")


def _subtrees(part: pd.DataFrame) -> pd.DataFrame:
    """What one shard adds to the subtree sums of its nodes."""
    part = part.sort_values("ord")
    saved = (part["n"] - part["own"]) * part["words"]
    out = {"key": part["key"]}
    for name, x in (("saved", saved), ("leaves", part["leaf"])):
        running = np.concatenate(([0], np.cumsum(x.to_numpy(np.int64))))
        out[name] = running[part["last"].to_numpy() + 1] - running[part["ord"].to_numpy()]
    return pd.DataFrame(out)


def prefix_trie(turns: DataFrame, conversations: int = SHARD_CONVERSATIONS, most_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(turns.sparkSession, "prefix_trie")
    parts = scratch.keep(shard_nodes(turn_rows(turns), conversations, most_turns))
    nodes = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("shard").alias("owner"), F.sum("n").alias("n_convs"),
        F.first("parent").alias("parent"), F.first("depth").alias("depth"),
    )
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    counted = parts.select("key", "shard", "ord", "last", "n", "words").join(nodes.select("key", "owner", "n_children"), "key")
    own = F.col("shard") == F.col("owner")
    counted = counted.select("key", "shard", "ord", "last", "n", "words", own.cast("long").alias("own"), (own & (F.col("n_children") == 0)).cast("long").alias("leaf"))
    sums = counted.groupBy("shard").applyInPandas(_subtrees, "key binary, saved long, leaves long")
    sums = sums.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256().hexdigest())
    return (
        nodes.join(above, "parent", "left").join(sums, "key").join(_end_hashes(parts), "key", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    )


# CRC-32 by its polynomial, a bit at a time, over the digits of an id.
_CRC_BIT = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
SQL = f"""
WITH RECURSIVE steps AS (
  SELECT b AS x, b, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT {_CRC_BIT.format(x="x")}, b, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(x ORDER BY b) AS t FROM steps WHERE k = 8
), said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, CAST(xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
                   lambda s, d: xor(s >> 8, t[CAST(xor(s & 255, d) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {HEADS} AS BIGINT) AS h
  FROM (SELECT DISTINCT c FROM said), crc
), rebuilt AS (
  SELECT convs.c, said.nth, role, text FROM convs JOIN said ON said.c = convs.c - convs.c % {BLOCK} AND nth <= h
  UNION ALL SELECT convs.c, said.nth, role, text FROM convs JOIN said ON said.c = convs.c AND nth > h
), numbered AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY nth) AS d, CAST(strlen(role) AS VARCHAR) || ':' || role || text AS said, text FROM rebuilt
), prefixes AS (
  SELECT c, d, list(sha256(said)) OVER (PARTITION BY c ORDER BY d) AS path, text FROM numbered
  UNION ALL SELECT c, 0, [], '' FROM convs
), lengths AS (
  SELECT c, max(d) AS d FROM prefixes GROUP BY c
), nodes AS (
  SELECT path, p.d AS d, min(p.c) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words,
         sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (l.d = p.d), '')) AS ends_sha256
  FROM prefixes p JOIN lengths l USING (c) GROUP BY path, p.d
), kids AS (
  SELECT path[:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), marked AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), subtrees AS (
  SELECT path[:up] AS path, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM marked) GROUP BY 1
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM marked m JOIN subtrees s USING (path) LEFT JOIN nodes p ON m.d > 0 AND p.path = m.path[:m.d - 1]
"""
