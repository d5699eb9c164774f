import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from grantweave.llm import prefix_trie
from grantweave.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(turns):
    """Every node with all its members, from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(head, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        gain = (len(m) - 1) * (len(WORD.findall(path[-1][1])) if path else 0)
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += gain
    return sorted(
        (m[0], len(p), -1 if not p else members[p[:-1]][0], len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in names) for r in df.collect())


def test_query_against_every_member(spark, small):
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(QUERIES["op12_prefix_trie"](spark, small)) == plain(turns)


def edge_turns():
    out = [(c, t, "user" if t % 2 else "assistant", f"say {t} {'x y' * (c % 3 == 0 and t > 1)}") for c in range(0, 90) for t in range(c % 5)]
    out += [(c, None, None, None) for c in (100, 101, 119)] + [(None, 1, "user", "no id"), (100, 3, "a", "b"), (100, 3, "a", "b"), (101, 3, "b", "a"), (101, 3, "a", "b")]
    out += [(c, 1, "12", "3") for c in (-45, -25, -19, -1, 9_007_199_254_740_993, 9_223_372_036_854_775_807)] + [(-40, 1, "1", "23"), (-40, 2, "é", "日本 語\x00 x")]
    out += [(777_003, t, "u", "long " * (t % 3)) for t in range(60)] + [(777_000, 0, "u", "z" * 50_000)]
    return out


@pytest.mark.parametrize("limits", [(4_096, 200_000), (1, 10), (7, 20)])
def test_edge_rows(spark, limits):
    """Nulls, ties, repeats, absent heads, negative and large ids, clashing names; shards of any size give the same."""
    turns = edge_turns()
    df = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit("clash") for c in ("key", "shard", "depth", "n", "head", "h", "words")}).repartition(5)
    assert rows(prefix_trie.prefix_trie(df, *limits)) == plain(turns)


def test_a_third_share_one_conversation(spark):
    turns = [(c, t, "user", f"same {t}" if c % 3 == 0 else f"{c} {t}") for c in range(600) for t in range(6)]
    df = spark.createDataFrame(turns, TURNS).repartition(4)
    parts = prefix_trie.shard_nodes(prefix_trie.turn_rows(df), 50, 10_000).groupBy("key").count().agg(F.max("count")).first()[0]
    assert parts <= 600 // 50 + 8  # rows of the hottest node: one per shard
    assert rows(prefix_trie.prefix_trie(df, 50, 10_000)) == plain(turns)


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
