"""Sharding (operator 3): a two-pass external shuffle into training shards.

Pass one scatters whole records: rendezvous hashing of doc_id names the shard
(the highest of one seeded hash per shard wins, so one more shard only takes
rows into itself), and a seeded hash of the record spreads a shard over
memory-sized buckets, one per task.  Pass two holds that bucket, permutes it with
Fisher-Yates (Spark's ``shuffle``) and writes it.  A record's slot is its place
in its bucket after the records of the shard's earlier buckets.

The law is ``key``: doc_id and the shard count decide the shard.  The bucket
hash also takes the record's place in its input, so repeated records, even a
third of all rows, spread over a shard's buckets; the input therefore has to be
a stored table (or a plan that repeats itself), as every stage's input here is.
Shards follow from ids alone; slots also from how the input is split and from
``bucket_bytes``, so another split deals another, equally uniform order.

Defined results: a null text counts no bytes; a null doc_id hashes like any
value; an empty table yields no rows; repeated rows are all kept; columns named
as the operator's own (``RESULT``, in any case) are replaced by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SHARDS, SEED = 24, 20240229
#: Bytes of text a bucket is planned to hold: what a task holds, and at 100 TB some 1.6 million tasks.
BUCKET_BYTES = 64 << 20
ROW_BYTES = 8
#: Up to so many buckets (some 50 bytes each, so 5 MB) their starts are broadcast; their number is known before the join.
BROADCAST_BUCKETS = 100_000
RESULT = ("shard", "slot", "grown_shard", "bucket", "place")


def record_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of ``key`` is the highest."""
    bids = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("bid"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.array_max(F.array(*bids))["shard"] if shards > 1 else F.lit(0)


def write_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with shard, slot and grown_shard, read from the shards written to the shared folder."""
    payload = [c for c in docs.columns if c.lower() not in RESULT]
    total = docs.agg(F.sum(record_bytes())).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    key = F.col("doc_id")
    came = docs.select(*payload, rendezvous(key, shards, seed).alias("shard"), F.monotonically_increasing_id().alias("__came"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), key, "__came"), F.lit(buckets)).cast("int")
    sent = came.select(F.struct(*payload).alias("record"), (F.col("shard") * F.lit(buckets) + bucket).cast("int").alias("__task"), "__came")
    # sorted by where a record came from, of any column type, so a task that is run again deals the same order
    sent = sent.repartitionById(shards * buckets, "__task").sortWithinPartitions("__task", "__came")
    held = sent.groupBy("__task").agg(F.collect_list("record").alias("held"))
    dealt = held.select("__task", F.posexplode(F.shuffle("held", seed)).alias("place", "record"))
    own = [F.col("record")[c].alias(c) for c in payload]
    dealt = dealt.select(F.expr(f"cast(__task % {buckets} as int)").alias("bucket"), "place", *own, F.expr(f"cast(__task div {buckets} as int)").alias("shard"))
    written = Scratch(docs.sparkSession, "shards").keep(dealt, "shard")

    sizes = written.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    if shards * buckets <= BROADCAST_BUCKETS:  # else Catalyst chooses, and may shuffle the records once more
        starts = F.broadcast(starts)
    return written.join(starts, ["shard", "bucket"]).select(
        *payload, "shard", (F.col("start") + F.col("place")).alias("slot"), rendezvous(key, shards + 1, seed).alias("grown_shard")
    )
