import struct
import zlib
from collections import Counter

import pytest
import xxhash

from grantweave.llm import sharding
from grantweave.llm.queries import QUERIES


def check_law(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < shards
        assert r.grown_shard in (r.shard, shards)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_query(spark, small, documents):
    rows = QUERIES["op3_sharding"](spark, small).collect()
    texts = dict(zip(documents.doc_id, documents.text))
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
    check_law(rows, 24)
    assert any(r.grown_shard == 24 for r in rows)


@pytest.mark.parametrize("bucket_bytes", [20_000, 1 << 30])
def test_edge_rows_keep_their_columns(edge, bucket_bytes):
    out = sharding.write_shards(edge, shards=3, bucket_bytes=bucket_bytes)
    rows = out.collect()
    check_law(rows, 3)
    kept = [c for c in edge.columns if c.lower() not in sharding.RESULT]
    assert out.columns == [*kept, "shard", "slot", "grown_shard"]
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in edge.collect())


def highest_bid(doc_id, shards, seed=sharding.SEED):
    """Rendezvous hashing by hand: XXH64 of the seed, the shard and the id, one after the other."""

    def bid(shard):
        h = 42
        for raw in (struct.pack("<i", seed), struct.pack("<i", shard), *([] if doc_id is None else [struct.pack("<q", doc_id)])):
            h = xxhash.xxh64_intdigest(raw, h)
        return h - (1 << 64) if h >> 63 else h

    return max(range(shards), key=lambda i: (bid(i), i))


def test_shards_against_hashing_by_hand(spark, small, edge):
    for r in QUERIES["op3_sharding"](spark, small).collect():
        assert (r.shard, r.grown_shard) == (highest_bid(r.doc_id, 24), highest_bid(r.doc_id, 25))
    for r in sharding.write_shards(edge, shards=5).collect():
        assert (r.shard, r.grown_shard) == (highest_bid(r.doc_id, 5), highest_bid(r.doc_id, 6))


def test_columns_of_any_type(spark, edge):
    odd = edge.selectExpr("*", "map('k', doc_id) m", "array(struct(map(1, text) a)) nested", "cast(null as interval day to second) gap")
    rows = sharding.write_shards(odd, shards=3, bucket_bytes=20_000).collect()
    check_law(rows, 3)
    assert Counter((r.doc_id, r.m["k"], r.nested[0].a[1]) for r in rows) == Counter((r.doc_id, r.doc_id, r.text) for r in edge.collect())


def test_a_task_holds_one_bucket(spark, small):
    """Records are shuffled once, each bucket to a task of its own."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    out = sharding.write_shards(docs, shards=4, bucket_bytes=60_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    per = out.groupBy("shard").agg({"slot": "count"}).collect()
    assert len(per) == 4 and sum(r["count(slot)"] for r in per) == docs.count()


def test_growth_is_what_one_more_shard_gives(edge):
    few = {(r.doc_id, r.text): r for r in sharding.write_shards(edge, shards=3).collect()}
    more = {(r.doc_id, r.text): r for r in sharding.write_shards(edge, shards=4).collect()}
    assert all(few[k].grown_shard == more[k].shard for k in few)


def test_repeated_records_spread_over_buckets(spark):
    docs = spark.range(0, 400, 1, 4).selectExpr("cast(7 as bigint) doc_id", "repeat('a', 100) text").repartition(4)
    from grantweave.llm.common import Scratch

    stored = Scratch(spark, "test").keep(docs)
    out = sharding.write_shards(stored, shards=2, bucket_bytes=2_000).collect()
    assert sorted(r.slot for r in out) == list(range(400))


def test_order_is_mixed(spark, small, documents):
    rows = sorted(QUERIES["op3_sharding"](spark, small).collect(), key=lambda r: (r.shard, r.slot))
    ups = [a.doc_id < b.doc_id for a, b in zip(rows, rows[1:]) if a.shard == b.shard]
    assert 0.3 < sum(ups) / len(ups) < 0.7


def test_empty(empty):
    assert sharding.write_shards(empty).collect() == []
