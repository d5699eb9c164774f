"""Benchmark decontamination (operator 13): verbatim benchmark passages in training texts.

Method: training suffix arrays.  Each task numbers the words of its documents and
sorts all suffixes of up to ``SHARD_WORDS`` words of them into a suffix array:
by their first three words, packed into one integer, then by prefix doubling
among suffixes that are still equal, as far as the longest test item reaches.
Every suffix of every benchmark item is binary-searched in that array, which
yields the longest verbatim match of the suffix with its place, and as ranges all
occurrences of its first ``WINDOW`` words.  Documents with an occurrence go.

Nothing is shuffled: documents stay where they are read.  The benchmark comes to
the tasks in blocks of ``BLOCK_BYTES`` at most, which is what is broadcast, held
by a worker and read by the driver at a time, however large the benchmark is; all
blocks are searched in the same suffix arrays.  A document longer than a shard is
cut into overlapping pieces, of which the hit spans are united.

Defined results: words are runs of letters, digits and characters beyond ASCII,
A-Z lowered; a null or wordless text has none, is hit by nothing and hits nothing;
an item shorter than a window is one window; a window in several items counts for
each; items that share an id count once, a null item id is left out of the lists
of ids, though its windows hit; repeated documents are each reported; an empty
benchmark hits nothing; an empty table yields no rows; columns named as the
result's are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_worker, small_batches

WINDOW = 10
SHARD_WORDS, BLOCK_BYTES = 1_000_000, 16 << 20
#: Bytes of a text that are cut into words together.
CUT = 1 << 20
#: Bits of a word's number: three numbers make one sort key.
BITS = 21
ABSENT = (1 << BITS) - 1
#: Digits, letters and all bytes of longer characters stay, A-Z lowered; every other byte becomes a blank.
WORD_BYTES = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Numbers(dict):
    """Numbers words from 1 in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n

    def of(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, cut piece by piece."""
        plain, at, parts = text.translate(WORD_BYTES), 0, []
        while at < len(plain):
            stop = plain.find(b" ", at + CUT) if at + CUT < len(plain) else -1
            piece = plain[at:stop].split() if stop >= 0 else plain[at:].split()
            parts.append(np.fromiter(map(self.__getitem__, piece), np.int64, len(piece)))
            at = stop + 1 if stop >= 0 else len(plain)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class SuffixArray:
    """Suffixes of ``ids`` (0 between texts) in order of their first ``depth`` words at least."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids = np.append(ids, (0, 0, 0))
        n = len(ids)
        at = np.flatnonzero(ids)
        key = (self.ids[at] << (2 * BITS)) | (self.ids[at + 1] << BITS) | self.ids[at + 2]
        order = np.argsort(key, kind="stable")
        self.suffix, self.key = at[order], key[order]
        new = np.r_[True, self.key[1:] != self.key[:-1]][: len(at)]
        group = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
        rank = np.zeros(n + 1, np.int64)  # 1 + first place of the suffixes that are equal so far; 0 between texts
        rank[self.suffix] = group + 1
        last = np.append(new[1:], True)[: len(at)]
        open_ = np.flatnonzero(~(new & last))  # places whose suffix equals a neighbour's
        step = 3
        while step < depth and len(open_):
            where = self.suffix[open_]
            sort = (rank[where] << 32) | rank[np.minimum(where + step, n)]
            order = np.argsort(sort, kind="stable")
            sort, where = sort[order], where[order]
            self.suffix[open_] = where
            new = np.r_[True, sort[1:] != sort[:-1]]
            group = np.maximum.accumulate(np.where(new, open_, 0))
            rank[where] = group + 1
            open_ = open_[~(new & np.append(new[1:], True))]
            step *= 2

    def _bound(self, low: np.ndarray, high: np.ndarray, offset: int, word: np.ndarray, after: bool) -> np.ndarray:
        """The first place in [low, high) whose word at ``offset`` is not below ``word`` (``after``: is above it)."""
        low, high = low.copy(), high.copy()
        while len(going := np.flatnonzero(low < high)):
            middle = (low[going] + high[going]) >> 1
            found = self.ids[self.suffix[middle] + offset]
            below = found <= word[going] if after else found < word[going]
            low[going] = np.where(below, middle + 1, low[going])
            high[going] = np.where(below, high[going], middle)
        return low

    def search(self, query: np.ndarray, start: np.ndarray, length: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the suffixes ``query[start : start + length]``: longest match, its place, and the range that has ``window`` words."""
        n = len(start)
        padded = np.append(query, (ABSENT,) * 3)
        best, place = np.zeros(n, np.int64), np.full(n, -1)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.suffix))
        from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
        going, prefix, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(going := going[length[going] > depth]):
            word = padded[start[going] + depth]
            if depth < 3:
                shift = (2 - depth) * BITS
                prefix[going] = (prefix[going] << BITS) | word
                low[going] = np.searchsorted(self.key, prefix[going] << shift)
                high[going] = np.searchsorted(self.key, (prefix[going] << shift) | ((1 << shift) - 1), side="right")
            else:
                below = self._bound(low[going], high[going], depth, word, False)
                high[going] = self._bound(below, high[going], depth, word, True)
                low[going] = below
            going = going[low[going] < high[going]]
            depth += 1
            best[going], place[going] = depth, self.suffix[low[going]]
            full = going[window[going] == depth]
            from_[full], to[full] = low[full], high[full]
        return best, place, from_, to


class Block:
    """A part of the benchmark: its words, every suffix of its items, and its distinct windows with their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        numbers = Numbers()
        texts = [numbers.of(text) for _, text in items]
        self.names = [name for name, _ in items]
        self.words = list(numbers)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.query = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        self.start = np.arange(len(self.query))
        self.item = np.repeat(np.arange(len(texts)), sizes)
        self.offset = self.start - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.length = np.repeat(sizes, sizes) - self.offset
        # of each suffix the words of the window it starts, of each distinct window one suffix and all items
        self.window = np.where(self.length >= window, window, np.where(self.offset == 0, self.length, 0))
        seen: dict[bytes, int] = {}
        self.kind = np.full(len(self.query), -1)
        owners: list[set[int]] = []
        for s in np.flatnonzero(self.window).tolist():
            kind = seen.setdefault(self.query[s : s + self.window[s]].tobytes(), len(seen))
            if kind == len(owners):
                owners.append(set())
                self.kind[s] = kind
            owners[kind].add(int(self.item[s]))
        self.owners = [np.array(sorted(o)) for o in owners]

    def numbered(self, numbers: Numbers, renumber: np.ndarray | None) -> np.ndarray:
        """The query's words by a shard's numbers."""
        known = np.fromiter((numbers.get(w, -1) for w in self.words), np.int64, len(self.words))
        if renumber is not None:
            at = np.minimum(np.searchsorted(renumber, known), len(renumber) - 1)
            known = np.where(renumber[at] == known, at, -1)
        return np.append(0, np.where(known < 0, ABSENT, known))[self.query]


class Benchmark:
    """The blocks of a benchmark as broadcasts; a worker holds one of them at a time."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        self.window, self.key = window, uuid.uuid4().hex
        self.blocks: list[Any] = []
        self.longest = 0
        spark = benchmark.sparkSession
        wait: list[tuple[str | None, bytes]] = []
        size = 0
        for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
            if row.text is None:
                continue
            text = bytes(row.text)
            self.longest = max(self.longest, len(words(text)))
            wait.append((row.item_id, text))
            size += len(text)
            if size >= block_bytes:
                self.blocks.append(spark.sparkContext.broadcast(wait))
                wait, size = [], 0
        if wait:
            self.blocks.append(spark.sparkContext.broadcast(wait))

    def __iter__(self) -> Iterator[Block]:
        if len(self.blocks) == 1:
            yield per_worker(("decontaminate", self.key), lambda: Block(self.blocks[0].value, self.window))
            return
        for b in self.blocks:
            yield Block(b.value, self.window)
            b.__dict__.pop("_value", None)  # read again for the next shard


def _shards(texts: list[np.ndarray], overlap: int, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, from, to) of all texts, in lots of about ``most`` words; pieces of one text overlap."""
    lot, size = [], 0
    for doc, ids in enumerate(texts):
        at = 0
        while at < len(ids):
            to = min(len(ids), at + most)
            lot.append((doc, at, to))
            size += to - at
            if size >= most:
                yield lot
                lot, size = [], 0
            if to == len(ids):
                break
            at = to - overlap
    if lot:
        yield lot


class Found:
    """One shard against one block: hit spans and items by document, and each suffix's longest match."""

    def __init__(self, texts: list[np.ndarray], lot: list[tuple[int, int, int]], numbers: Numbers, longest: int):
        begin = np.cumsum([0, *(to - at + 1 for _, at, to in lot)])
        ids = np.zeros(begin[-1], np.int64)
        for start, (doc, at, to) in zip(begin.tolist(), lot):
            ids[start : start + to - at] = texts[doc][at:to]
        self.renumber = None
        if len(numbers) >= ABSENT:  # more numbers than fit a key: this shard's own
            self.renumber = np.unique(np.append(0, ids))
            ids = np.searchsorted(self.renumber, ids)
        self.begin, self.lot, self.numbers = begin, lot, numbers
        self.array = SuffixArray(ids, longest)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word there of places in the shard."""
        piece = np.searchsorted(self.begin, at, side="right") - 1
        lot = np.array(self.lot)
        return lot[piece, 0], at - self.begin[piece] + lot[piece, 1]

    def search(self, block: Block) -> tuple[np.ndarray, ...]:
        return self.array.search(block.numbered(self.numbers, self.renumber), block.start, block.length, block.window)

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Documents, starts and ends of the hit spans, and pairs (document, item)."""
        _, _, low, high = self.search(block)
        hit = np.flatnonzero((high > low) & (block.kind >= 0))
        change = np.zeros(self.begin[-1] + 1, np.int64)
        pairs: set[tuple[int, int]] = set()
        for s in hit.tolist():
            at = self.array.suffix[low[s] : high[s]]
            np.add.at(change, at, 1)
            np.add.at(change, at + block.window[s], -1)
            docs = np.unique(self.place(at)[0])
            for item in block.owners[block.kind[s]].tolist():
                pairs.update((d, item) for d in docs.tolist())
        edge = np.diff(np.r_[0, (np.cumsum(change) > 0).astype(np.int8), 0])
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc, first = self.place(start)
        return doc, first, first + end - start, sorted(pairs)


def _united(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray], Numbers]]:
    """Batches whose documents have about ``most`` words together, their texts as numbers."""
    held, texts, numbers, size = [], [], Numbers(), 0
    for b in small_batches(batches, 64):
        held.append(b)
        for text in b.column("__text"):
            texts.append(numbers.of(text.as_buffer().to_pybytes() if text.is_valid else b""))
            size += len(texts[-1])
        if size >= most:
            yield held, texts, numbers
            held, texts, numbers, size = [], [], Numbers(), 0
    if held:
        yield held, texts, numbers


ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, contaminated boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` (by default all columns) of each document, with n_words, n_hit, items (ids, sorted), spans (of hit words) and contaminated."""
    tests = Benchmark(benchmark, window, block_bytes)
    added = T.StructType.fromDDL(ADDED)
    taken = {f.name.lower() for f in added}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    schema = T.StructType([*(docs.schema[c] for c in carry), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts, numbers in _lots(batches, shard_words):
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            for lot in _shards(texts, window - 1, shard_words):
                shard = Found(texts, lot, numbers, tests.longest)
                for block in tests:
                    doc, start, end, pairs = shard.hits(block)
                    for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
                        spans[d].append((a, b))
                    for d, item in pairs:
                        if block.names[item] is not None:
                            items[d].add(block.names[item])
            at = 0
            for b in held:
                part = range(at, at + b.num_rows)
                at += b.num_rows
                united = [_united(spans[d]) for d in part]
                hit = [sum(s["end"] - s["start"] for s in x) for x in united]
                new = [
                    pa.array([len(texts[d]) for d in part], pa.int64()), pa.array(hit, pa.int64()),
                    pa.array([sorted(items[d]) for d in part], pa.list_(pa.string())), pa.array(united, _SPANS), pa.array([n > 0 for n in hit]),
                ]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *new], schema.names)

    return docs.select(*carry, F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that no benchmark window occurs in, with their own columns."""
    kept = docs.select("text", F.struct(*docs.columns).alias("__row"))
    return scan(kept, benchmark, ["__row"], window).filter(~F.col("contaminated")).select("__row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, length, item_start, doc_id, doc_start: each item's longest verbatim match, and one place where it stands.

    Items without a word in any document are left out.  Pieces of a document
    longer than a shard overlap by the longest item, so no match is cut; an item
    of over half a shard may be.
    """
    tests = Benchmark(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts, numbers in _lots(batches, shard_words):
            doc_ids = [x for b in held for x in b.column("doc_id").to_pylist()]
            for lot in _shards(texts, min(max(window, tests.longest), shard_words // 2) - 1, shard_words):
                shard = Found(texts, lot, numbers, tests.longest)
                for block in tests:
                    length, place, _, _ = shard.search(block)
                    order = np.lexsort((-length, block.item))
                    order = order[length[order] > 0]
                    top = order[np.r_[True, block.item[order][1:] != block.item[order][:-1]][: len(order)]]
                    doc, at = shard.place(place[top])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.names[i] for i in block.item[top]], pa.string()), pa.array(length[top]), pa.array(block.offset[top]),
                         pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(at)],
                        ["item_id", "length", "item_start", "doc_id", "doc_start"],
                    )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("__text"))
    found = source.mapInArrow(run, "item_id string, length long, item_start long, doc_id long, doc_start long")
    best = F.min(F.struct((-F.col("length")).alias("short"), "doc_id", "item_start", "doc_start")).alias("best")
    out = found.groupBy("item_id").agg(best)
    return out.select("item_id", (-F.col("best.short")).alias("length"), "best.item_start", "best.doc_id", "best.doc_start")


def items_digest(items: str = "items") -> Column:
    """Lowercase SHA-256 of the sorted, comma-joined ids."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc, i, n, array_to_string(w[i : i + n - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT doc, i, n, item FROM places JOIN windows USING (n, said)
), hit AS (
  SELECT doc, count(DISTINCT place) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc
), listed AS (
  SELECT doc, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc) LEFT JOIN listed USING (doc)
"""
