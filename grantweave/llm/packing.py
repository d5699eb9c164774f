"""Packing (operator 1): documents into fixed-length token sequences.

First-fit decreasing over a tournament tree of bin capacities, run
independently in randomised groups of pieces.  A document's ids (end id
included) are cut every ``max_len`` ids; a whole piece fills a sequence by
itself, the remainders are packed.  Groups hold about ``GROUP_PIECES`` pieces
whatever the input size, so no task holds more than a few groups, and the
share of a group's last, partly filled bins stays small.

Defined results: a null text counts as empty and yields the end id alone; an
empty table yields no rows; repeated rows are packed once per row; a null
doc_id is carried through; columns other than doc_id and text are not read, so
extra columns may have any name.  Text of any length is encoded whole: it is
looked up word by word, and the tokenizer only ever sees unseen words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_worker, small_batches

MAX_LEN = 2048
END_ID = 1
GROUP_PIECES = 8192
#: Words a worker remembers before it starts afresh, which bounds its memory.
WORD_CACHE = 500_000
ENCODE_CHARS = 1_000_000
#: A run of these after letters is a token string of its own (an apostrophe may not be).
TAIL = ".,;:!?#$%&*()[]|<>-_=+/\\\"@^~`{}"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of texts for a tokenizer whose tokens never cross white space.

    A blank or line feed only separates tokens, so a text's ids are its
    blank-separated parts' ids in turn, and each distinct part is encoded once.
    Letters are told apart from what follows them and their case is dropped, so
    a capital or a closing full stop needs no new look at the tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # a special token's string in a text is that token, in its own case only
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters: the tokenizer marks where each of them ends."""
        for at in range(0, len(words), 1000):
            lot = words[at : at + 1000]
            ids = self._ids(" ".join(lot))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(lot):
                raw, lower = ids.tobytes(), 0
                for word, upper in zip(lot, (4 * cuts).tolist()):
                    self.known[word] = raw[lower:upper]
                    lower = upper
            else:  # lower-casing made more of a word than letters
                for word in lot:
                    self.known[word] = self._ids(word).tobytes()

    def _learn(self, parts: set[str]) -> None:
        known, letters, others, split = self.known, set(), set(), []
        for part in parts:
            low = part.lower()
            if self.mark in low and any(s in low for s in self.special):
                others.add(part)
                continue
            stem = low if part.isascii() else part
            bare = stem.rstrip(TAIL)
            if bare != stem and bare.isalpha() and bare[-1].lower().isalpha():
                split.append((part, bare, stem[len(bare) :]))
                stem = bare
            elif stem != part:
                split.append((part, stem, ""))
            if stem not in known:
                (letters if stem.isalpha() else others).add(stem)
        others.update(tail for _, _, tail in split)
        self._learn_words(list(letters))
        for stem in others.difference(known):
            known[stem] = self._ids(stem).tobytes()
        for part, stem, tail in split:
            known[part] = known[stem] + known[tail]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        lot: list[list[str]] = []
        size = 0
        for text in texts:
            lot.append(text.replace("\n", " ").split(" "))
            size += len(text)
            if size > ENCODE_CHARS:
                yield from self._look_up(lot)
                lot, size = [], 0
        yield from self._look_up(lot)

    def _look_up(self, lot: list[list[str]]) -> list[bytes]:
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        unseen = set().union(*lot).difference(self.known)
        if unseen:
            self._learn(unseen)
        return [b"".join(map(self.known.__getitem__, parts)) for parts in lot]


def _encoder(tokenizer_file: str, end_id: int) -> Callable[[pa.RecordBatch], Iterator[bytes]]:
    encoder = per_worker(("words", tokenizer_file), lambda: WordEncoder(tokenizer_file))
    end = np.array([end_id], "<u4").tobytes()
    return lambda b: (ids + end for ids in encoder.encode([t or "" for t in b.column("text").to_pylist()]))


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit ids with the end id, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_file, end_id)
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(encode(b)), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def pieces(docs: DataFrame, tokenizer_file: str, max_len: int = MAX_LEN, end_id: int = END_ID, seed: int = 0) -> DataFrame:
    """Every document's pieces of at most ``max_len`` ids, with a random salt per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer_file, end_id)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in small_batches(batches):
            rows = []
            for doc, ids in enumerate(encode(b)):
                n = len(ids) // 4
                for at in range(0, n, max_len):
                    part = ids[4 * at : 4 * (at + max_len)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            doc, *rest = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5))
            salt = pa.array(rng.integers(0, 1 << 62, len(rows)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(doc), *rest, salt], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (descending order), by a tournament tree.

    Leaf i holds bin i's free room and each inner node the larger child's, so
    the first bin with room for a piece is found by one walk from the root.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(pieces_table: DataFrame, n_groups: int, max_len: int = MAX_LEN) -> DataFrame:
    """Place stored pieces into sequences, group by group.

    ``pieces_table`` must be a stored table (its salts decide the groups and
    have to survive a retry).
    """

    def place(key: tuple, t: pa.Table) -> pa.Table:
        length, salt, start = (t.column(c).to_numpy() for c in ("length", "salt", "start"))
        t = t.take(np.lexsort((start, salt, -length)))
        sizes = t.column("length").to_numpy()
        whole = int((sizes == max_len).sum())  # each fills its bin
        bins, offsets = first_fit_decreasing(sizes[whole:], max_len)
        sequence = (key[0].as_py() << 32) + np.concatenate([np.arange(whole), whole + bins])
        t = t.drop_columns(["salt", "grp"]).append_column("sequence_id", pa.array(sequence))
        return t.append_column("offset", pa.array(np.concatenate([np.zeros(whole, np.int64), offsets])))

    grouped = pieces_table.withColumn("grp", F.pmod(F.col("salt"), F.lit(n_groups)))
    return grouped.groupBy("grp").applyInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer_file: str, max_len: int = MAX_LEN, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Encode, cut, and pack: one row per piece with its sequence and offset."""
    stored = Scratch(docs.sparkSession, "packing").keep(pieces(docs, tokenizer_file, max_len, end_id))
    n = stored.count()
    return pack(stored, max(1, round(n / group_pieces)), max_len)


def sequences(placed: DataFrame, docs: DataFrame, tokenizer_file: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, input_ids and the doc_ids of its pieces.

    One sequence holds at most ``max_len`` ids, so gathering its pieces is
    bounded.  doc_id must be unique here, as ids are joined back by it.
    """
    ids = encode_documents(docs, tokenizer_file, end_id)
    cut = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    piece = F.struct("offset", "doc_id", "length", cut.alias("ids"))
    rows = placed.join(ids, "doc_id").groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int64) for p in b.p]
            yield pd.DataFrame({"sequence_id": b.sequence_id, "input_ids": ids, "doc_ids": [[x["doc_id"] for x in p] for p in b.p], "lengths": [[x["length"] for x in p] for p in b.p]})

    return rows.mapInPandas(unpack, "sequence_id long, input_ids array<long>, doc_ids array<long>, lengths array<long>")
