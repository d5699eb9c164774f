import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grantweave.llm import simhash_dedup as sd
from grantweave.llm.common import Scratch
from grantweave.llm.queries import QUERIES


def plain_fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    """Smallest row reachable from each row."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


def clustered(n, seed, spread=4):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 12, dtype=np.uint64)
    out = centres[rng.integers(0, 12, n)].copy()
    for _ in range(spread):
        out ^= np.uint64(1) << rng.integers(0, 20, n, dtype=np.uint64)
    return np.unique(out)


def test_query_against_brute_force(spark, small, documents):
    rows = {r.doc_id: r for r in QUERIES["op2_simhash_dedup"](spark, small).collect()}
    fps = [plain_fingerprint(t) for t in documents.text]
    roots = plain_components(fps)
    for i, doc in enumerate(documents.doc_id):
        assert rows[doc].fingerprint == f"{fps[i]:016x}"
        assert rows[doc].component_id == documents.doc_id[roots[i]]


def test_edge_rows(edge):
    rows = sd.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (2, 3, 6) for r in by[i]} == {2}  # no words: fingerprint zero
    assert by[2][0].fingerprint == "0" * 16
    assert len(by[5]) == 2 and {r.component_id for r in by[5]} == {1}
    assert len(by[None]) == 1


def test_empty(empty):
    assert sd.near_duplicates(empty).collect() == []
    assert sd.one_of_each(empty).collect() == []


def test_one_of_each(edge):
    rows = sorted(((r.doc_id, r.text) for r in edge.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    want = [doc for i, (doc, _) in enumerate(rows) if doc is None or roots[i] == i]
    kept = sd.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str) and len(want) < len(rows)


def test_one_of_each_with_clashing_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{w}{i * i}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta"))
    assert plain_components([plain_fingerprint(t) for t in (a, b, c, d)]) == [0, 1, 2, 3]
    rows = [(1, a), (1, b), (2, b), (2, b), (3, c), (None, c), (None, d), (None, d), (None, d)]
    for given in (rows, rows[::-1]):
        kept = sd.one_of_each(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (3, c), (None, d)], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_self_join_spans_the_components(seed):
    f = clustered(700, seed)
    f = f[np.argsort(sd.gray_rank(f))]
    a, b = sd.self_join(np.zeros(len(f), np.int64), f)
    assert (np.bitwise_count(f[a] ^ f[b]) <= 3).all() and len(a) < len(f)
    parent = list(range(len(f)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(f))] == plain_components(f)


@pytest.mark.parametrize("key_rows", [8, 100_000])
def test_split_keys_lose_no_link(spark, key_rows):
    f = np.concatenate([clustered(600, 5), np.random.default_rng(9).integers(0, 1 << 62, 200, dtype=np.uint64)])
    f = np.unique(f)
    fps = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint long")
    scratch = Scratch(spark, "test")
    found = sd.components(sd.links(fps, scratch, key_rows=key_rows, partition_rows=200), scratch)
    label = {r.node: r.root for r in found.collect()}
    signed = f.view(np.int64).tolist()
    groups = {}
    for x, root in zip(signed, plain_components(f)):
        groups.setdefault(root, set()).add(label.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    scratch = Scratch(spark, "test")
    edges = spark.range(1, 300).select(F.col("id").alias("hi"), (F.col("id") - 1).alias("lo"))
    assert {tuple(r) for r in sd.components(edges, scratch).collect()} == {(i, 0) for i in range(300)}


def test_every_key_of_the_last_depth_is_small():
    assert max(64 - m.bit_count() for m in sd.block_masks(sd.deepest(sd.KEY_ROWS))) <= 12
