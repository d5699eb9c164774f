"""Document fingerprints (operator 6): weighted SimHash and permuted block tables.

Every word is a term; its 64-bit hash votes on each bit with the word's length
as weight, so rare long words outweigh the short ones that all texts share, and
a word counts as often as it occurs.  A fingerprint bit is set if the votes for
it pass half of all.  Votes of bit i and bit i+32 share one long: a text's
weights add up to at most its length in characters, below 2**31, so the lanes
never touch and 32 sums give all 64 votes.

Neighbours: of ``blocks`` blocks, fingerprints within ``radius`` bits agree on
all but ``radius``.  One table per choice of that many blocks lists fingerprints by
these, put first by a permutation; candidates share the leading bits and are
compared whole.  A pair is taken only from the first table that shows it, so no
distinct is needed.  The more fingerprints, the more blocks, so that the leading bits
stay as many as it takes to keep a key's fingerprints few (``blocks_for``).

Defined results: a null text counts as empty; a text without words has
fingerprint zero; equal texts have equal fingerprints; documents are ordered by
doc_id (null first), ties by a hash of the text; the document after the last is
the first, so a single document is its own next one; an empty table yields no
rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SEPARATORS = r"[\x20\x09-\x0D]+"
RADIUS = 3
LANES = 32
LANE_MASK = (1 << 32) | 1
#: Ranges of ids cut at quantiles, and rows that a window over neighbours is planned to hold.
RANGES, WINDOW_ROWS = 64, 2048
#: Up to so many windows (some 50 bytes each, so 5 MB) their first rows' ids are broadcast; their number is known before the join.
BROADCAST_WINDOWS = 100_000
#: Fingerprints that share a table's leading bits by chance, at most, on average.
KEY_ROWS = 1_024
#: Ids divisible by this are the search queries.
QUERY_STEP = 50


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (unique per row) and the ``fingerprint`` of ``text``."""
    words = rows.select(*keys, F.explode_outer(F.split(F.lower(text), SEPARATORS)).alias("word"))
    weight = F.coalesce(F.char_length("word"), F.lit(0)).cast("long")
    votes = words.select(*keys, F.xxhash64("word").alias("h"), weight.alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANE_MASK)) * F.col("w")).alias(f"v{i}") for i in range(LANES)]
    summed = votes.groupBy(*keys).agg(F.sum("w").alias("total"), *lanes)
    bits = F.lit(0).cast("long")
    for i in range(LANES):
        for bit, ones in ((i, F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + LANES, F.shiftrightunsigned(f"v{i}", 32))):
            bits = bits.bitwiseOR(F.when(2 * ones > F.col("total"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, bits.alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    return (64 - F.bit_count(F.col(a).bitwiseXOR(F.col(b)))) / F.lit(64.0)


def _windows(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with ``range`` and ``bucket``, ascending ranges of doc_id of about WINDOW_ROWS rows each, and a bound on their number.

    Ranges of equal row counts come from quantiles; inside a range, buckets are
    equally wide.
    """
    fractions = F.array(*[F.lit(i / RANGES) for i in range(RANGES + 1)])
    n, total, cuts = docs.agg(F.count("doc_id"), F.count("*"), F.percentile_approx("doc_id", fractions, F.lit(20 * RANGES))).first()
    cuts = sorted(set(cuts or [0]))
    lows, per_range = cuts[:-1] or cuts, max(1, -(-n // (RANGES * WINDOW_ROWS)))
    widths = [max(1, -(-(b - a) // per_range)) for a, b in zip(cuts, cuts[1:])] or [1]
    low_array, width_array = F.array(*[F.lit(x).cast("long") for x in lows]), F.array(*[F.lit(x).cast("long") for x in widths])
    nth = F.greatest(F.size(F.filter(low_array, lambda x: x <= F.col("doc_id"))), F.lit(1))
    ranged = docs.withColumn("range", nth)
    inside = F.expr("(doc_id - __low) div __width")
    ranged = ranged.withColumn("__low", F.element_at(low_array, F.col("range"))).withColumn("__width", F.element_at(width_array, F.col("range")))
    # rows without an id come first, in ranges of their text's hash, as that is their order
    parts = max(1, -(-(total - n) // WINDOW_ROWS))
    unnamed = F.expr(f"cast({parts - 1} - least({parts - 1}, floor((9223372036854775807 - cast(h as decimal(20,0))) / {-(-(1 << 64) // parts)})) as long)")
    bucket = F.coalesce(F.col("range") * F.lit(1 << 32) + inside, F.lit(-(1 << 62)) + unnamed)
    return ranged.withColumn("bucket", bucket).withColumn("range", F.coalesce("range", F.lit(0))).drop("__low", "__width"), (per_range + 1) * (len(lows) + 1) + parts


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, nth, guest, doc_id, text, next_text: every document with the text of the next one.

    A bucket also gets the first document of the next bucket as a guest, so a
    window over a bucket sees every neighbour and texts are shuffled once.
    """
    rows, most = _windows(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")))
    firsts = rows.groupBy("range", "bucket").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    # the bucket before each: in its range, or the last of the range before (of which there are RANGES + 1 at most), or the last of all
    ends = firsts.groupBy("range").agg(F.max("bucket").alias("bucket"))
    order = Window.orderBy("range")
    ends = ends.select("range", F.lag("bucket").over(order).alias("before"), F.last("bucket").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("last"))
    hosts = firsts.withColumn("host", F.lag("bucket").over(Window.partitionBy("range").orderBy("bucket"))).join(F.broadcast(ends), "range")
    hosts = hosts.select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("hash"), F.coalesce("host", "before", "last").alias("host"))
    if most <= BROADCAST_WINDOWS:  # else Catalyst chooses, and may shuffle the texts once more
        hosts = F.broadcast(hosts)
    guests = rows.join(hosts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash")))
    guests = guests.select(F.col("host").alias("bucket"), "doc_id", "text", "h").dropDuplicates(["bucket"])
    both = rows.select("bucket", "doc_id", "text", "h", F.lit(0).alias("guest")).unionByName(guests.withColumn("guest", F.lit(1)))
    along = Window.partitionBy("bucket").orderBy("guest", "doc_id", "h")
    return both.select("bucket", F.row_number().over(along).alias("nth"), "guest", "doc_id", "text", F.lead("text").over(along).alias("next_text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likenesses.

    The edited text has the last quarter of the characters replaced by as many
    first characters of the next document.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.when(F.col("guest") == 0, F.concat(F.expr("substring(text, 1, __n - __q)"), F.expr("substring(coalesce(next_text, ''), 1, __q)")))
    rows = with_next(docs).withColumn("__n", n).withColumn("__q", quarter).withColumn("edited", edited)
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["bucket", "nth", "guest", "doc_id", "n_chars", "edited_sha256"]
    texts = F.array(F.struct(F.lit(0).alias("of"), F.col("text").alias("body")), F.struct(F.lit(1).alias("of"), F.col("edited").alias("body")))
    texts = rows.select(*keys, F.explode(texts).alias("t")).select(*keys, F.col("t.of").alias("of"), F.col("t.body").alias("body"))
    marks = simhash(texts.filter((F.col("of") == 0) | (F.col("guest") == 0)), [*keys, "of"], "body")
    pairs = marks.groupBy(*keys).agg(
        F.max(F.when(F.col("of") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("of") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    along = Window.partitionBy("bucket").orderBy("nth")
    pairs = pairs.withColumn("next_fingerprint", F.lead("fingerprint").over(along)).filter("guest = 0")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def blocks_for(n: int, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> int:
    """The least number of blocks whose tables' leading bits part ``n`` fingerprints into keys of ``key_rows``."""
    blocks = radius + 1
    while (64 * (blocks - radius) // blocks) < min(40, max(0, (n // key_rows)).bit_length()):
        blocks += 1
    return blocks


def _tables(radius: int, blocks: int) -> list[tuple[tuple[int, ...], int]]:
    """Every choice of blocks that a table leads with, and the mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [(chosen, sum(bits[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]


def block_table(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``fps`` once per table: ``blk``, the table's number, and ``lead``, the fingerprint's bits of its blocks."""
    tables = _tables(radius, blocks or radius + 1)
    leads = [F.struct(F.lit(i).alias("blk"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("lead")) for i, (_, mask) in enumerate(tables)]
    return fps.withColumn("__b", F.explode(F.array(*leads))).select(*fps.columns, "__b.blk", "__b.lead")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Pairs (fingerprint, found, distance) of distinct ``queries`` and distinct ``index`` fingerprints."""
    left = block_table(queries.select("fingerprint"), radius, blocks)
    right = block_table(index.select("fingerprint"), radius, blocks).withColumnRenamed("fingerprint", "found")
    pairs = left.join(right, ["blk", "lead"]).withColumn("__x", F.col("fingerprint").bitwiseXOR(F.col("found")))
    first = F.lit(-1)
    for i, (_, mask) in reversed(list(enumerate(_tables(radius, blocks or radius + 1)))):
        first = F.when(F.col("__x").bitwiseAND(F.lit(_signed(mask))) == 0, F.lit(i)).otherwise(first)
    pairs = pairs.filter((F.bit_count("__x") <= radius) & (first == F.col("blk")))
    return pairs.select("fingerprint", "found", F.bit_count("__x").alias("distance"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, step: int = QUERY_STEP) -> DataFrame:
    """``edited_fingerprints`` plus ``n_within``: for ids divisible by ``step``, how many
    documents (itself included) have a fingerprint within ``radius`` bits; null for the rest."""
    marks = Scratch(docs.sparkSession, "fingerprints").keep(edited_fingerprints(docs))
    known = marks.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = marks.filter(F.pmod("doc_id", F.lit(step)) == 0).select("fingerprint").distinct()
    found = within_radius(asked, known, radius, blocks_for(known.count(), radius)).join(known.withColumnRenamed("fingerprint", "found"), "found")
    counts = found.groupBy("fingerprint").agg(F.sum("n").alias("n_within"))
    queries = F.coalesce(F.pmod("doc_id", F.lit(step)) == 0, F.lit(False))
    answered = marks.filter(queries).join(counts, "fingerprint")
    return marks.filter(~queries).withColumn("n_within", F.lit(None).cast("long")).unionByName(answered)
