"""SentencePiece encoding and decoding (operator 5), for BPE models with byte fallback.

Vectorised merge rounds: the distinct new words of a lot of texts lie in one
flat symbol array.  A round looks up the rank of every neighbouring pair, takes
per word the smallest rank (one segmented minimum), merges the pairs of that
rank from the left wherever they do not overlap, in all words at once, and closes
the gaps; a word without a known pair leaves the array.  The library merges one
pair at a time, of the smallest rank and leftmost.  That is the same as long as no
merge makes a pair of a smaller rank; where one does, the word's round ends with
that merge.  So ids are equal to the library's, and a word's rounds grow with the
ranks that it has, not with its length.  Words end before a blank and wherever two
neighbouring characters occur together in no piece, as no merge can cross there.

Defined results: a null text counts as empty and has the end id alone; decoding
null or empty ids gives an empty text; repeated rows are kept; an empty table
yields no rows; of the input only doc_id and the text (or ids) are read.
Characters without a piece become their bytes' pieces; bytes that form no
character decode to U+FFFD each, as in the library.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, small_batches

BLANK = "▁"
NEVER = np.int64(1) << 62
#: Characters that are looked up together; words kept.
LOT_CHARS, WORD_CACHE = 1_000_000, 400_000


class IntTable:
    """Places of distinct non-negative integers in a list, looked up by whole arrays (open addressing)."""

    def __init__(self, keys: list[int]):
        self.keys = np.array([*keys, -2], np.int64)  # the last stands for none
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, len(keys), np.int32)
        for place, slot in enumerate(self._slot(self.keys[:-1]).tolist()):
            while self.slots[slot] != len(keys):
                slot = (slot + 1) & self.mask
            self.slots[slot] = place

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key (of any, where it is missing) and whether it is there."""
        slot = self._slot(keys)
        at = self.slots[slot]
        there = self.keys[at] == keys
        rest = np.flatnonzero(~there & (at != len(self.keys) - 1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            at[rest] = self.slots[slot[rest]]
            there[rest] = self.keys[at[rest]] == keys[rest]
            rest = rest[~there[rest] & (at[rest] != len(self.keys) - 1)]
        return at, there


class PieceModel:
    """Vocabulary and merge table of a BPE model with identity normalisation and a dummy prefix."""

    def __init__(self, model_file: str):
        import sentencepiece

        codecs.register_error("one_mark_each", _one_mark_each)
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        symbols = {names[i]: i for i in plain}
        for c in sorted({c for piece in symbols for c in piece} - symbols.keys()):  # these can only be merged away
            symbols[c] = size + len(symbols)
        self.base = 1 << 17  # symbols below it are pieces or parts of pieces, beyond it other characters
        order = {score: rank for rank, score in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        together: set[int] = set()
        for i in plain:
            piece = names[i]
            rank = order[sp.get_score(i)]
            for k in range(1, len(piece)):
                together.add(ord(piece[k - 1]) << 21 | ord(piece[k]))
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (rank, i)
        self.size = size
        self.lines_apart = not any("\n" in piece for piece in symbols)  # then a line feed stands between words
        order_of = sorted(pairs)
        self.pairs = IntTable(order_of)
        self.pair_rank = np.array([*(pairs[k][0] for k in order_of), 0], np.int64)
        self.pair_piece = np.array([*(pairs[k][1] for k in order_of), 0], np.int32)
        self.together = IntTable(sorted(together))
        self.symbol_of = self.base + np.arange(0x110000)  # characters that are no part of a piece
        self.point_of = {i: ord(s) for s, i in symbols.items() if len(s) == 1}
        for i, point in self.point_of.items():
            self.symbol_of[point] = i
        self.symbol_of[ord(" ")] = self.symbol_of[ord(BLANK)]
        self.surface = [names[i].replace(BLANK, " ").encode() for i in range(size)]
        self.surface[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_id.tolist()):
            self.surface[i] = bytes([b])
        self.blank_first = {i for i in plain if names[i].startswith(BLANK)}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.known: dict[str, bytes] = {}

    # --- encoding ---

    def words(self, text: str) -> list[str]:
        """The text's words, each with the blanks before it (a blank stands for its mark)."""
        if not text:
            return []
        text = text.replace(BLANK, " ")
        if "  " in text or " \n" in text or not self.lines_apart or text[0] == " " or text[-1] == " ":
            return re.findall(" +[^ ]*", " " + text)
        out: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(first if out else " " + first)
            out += [" " + p for p in rest]
            out.append("\n")
        return out[:-1]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pair table of each pair of symbols, and whether it is there."""
        return self.pairs.find(np.where((left < self.base) & (right < self.base), left * self.base + right, -1))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``NEVER`` where it is none."""
        at, known = self._look_up(left, right)
        return np.where(known, self.pair_rank[at], NEVER)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of every word and their word numbers, in order; ``word`` ascends."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            at, known = self._look_up(symbols[:-1], symbols[1:])
            known &= word[:-1] == word[1:]
            rank = np.full(len(symbols), NEVER)
            where = np.flatnonzero(known)
            rank[where] = self.pair_rank[at[where]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            place = where[rank[where] == np.repeat(best, sizes)[where]]
            place = self._from_the_left(symbols, word, place, at, best, sizes)
            piece = self.pair_piece[at[place]]
            finished = np.repeat(over, sizes)
            done.append((symbols[finished], word[finished]))
            symbols[place] = piece
            keep = ~finished
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _from_the_left(self, symbols: np.ndarray, word: np.ndarray, place: np.ndarray, at: np.ndarray, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of the places of their words' smallest rank, those that are merged now.

        Overlapping ones are taken from the left, every other of a run.  A word
        with several merges stops after the first that makes a smaller rank with
        the symbol before it (merged already, if it is the last merge's) or after it.
        """
        run = np.r_[True, np.diff(place) != 1][: len(place)]
        first = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0)) if len(place) else place
        place = place[(np.arange(len(place)) - first) % 2 == 0]
        again = np.flatnonzero(word[place[1:]] == word[place[:-1]])
        if not len(again):
            return place
        several = np.zeros(len(place), bool)
        several[again] = several[again + 1] = True
        some = place[several]
        rank = np.repeat(best, sizes)[some]
        piece = self.pair_piece[at[some]].astype(symbols.dtype)
        before, after = some - 1, some + 2
        joins = np.r_[False, (some[1:] == some[:-1] + 2) & (word[some[1:]] == word[some[:-1]])]
        left = np.where(joins, np.r_[piece[:1], piece[:-1]], symbols[np.maximum(before, 0)])
        has_left = (before >= 0) & (word[np.maximum(before, 0)] == word[some])
        right = np.minimum(after, len(symbols) - 1)
        has_right = (after < len(symbols)) & (word[right] == word[some])
        lower = (has_left & (self._ranks(left, piece) <= rank)) | (has_right & (self._ranks(piece, symbols[right]) <= rank))
        if not lower.any():
            return place
        # in each word, what follows the first such merge waits
        begin = np.flatnonzero(np.r_[True, word[some[1:]] != word[some[:-1]]])
        stopped = np.cumsum(np.r_[0, lower[:-1]])
        stopped = stopped - np.repeat(stopped[begin], np.diff(np.r_[begin, len(some)]))
        # a merge that ends the word before must not stop this one
        late = np.zeros(len(place), bool)
        late[np.flatnonzero(several)] = stopped > 0
        return place[~late]

    def _learn(self, words: list[str]) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbols = self.symbol_of[points]
        points[points == ord(" ")] = ord(BLANK)
        _, joined = self.together.find(points[:-1] << 21 | points[1:])
        cut = np.r_[True, (owner[1:] != owner[:-1]) | ~joined]
        run = np.cumsum(cut) - 1
        symbols, run = self.merge(symbols, run)
        owner = owner[np.flatnonzero(cut)][run]
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        raw = symbols.astype("<i4").tobytes()
        odd = np.flatnonzero(np.add.reduceat((symbols >= self.size).astype(np.int64), cuts[:-1]) if len(words) else [])
        for i, w in enumerate(words):
            self.known[w] = raw[4 * cuts[i] : 4 * cuts[i + 1]]
        for i in odd.tolist():  # characters without a piece
            self.known[words[i]] = self._with_bytes(symbols[cuts[i] : cuts[i + 1]].tolist())

    def _with_bytes(self, symbols: list[int]) -> bytes:
        ids: list[int] = []
        for s in symbols:
            if s < self.size:
                ids.append(s)
            else:
                point = s - self.base if s >= self.base else self.point_of[s]
                ids.extend(self.byte_id[list(chr(point).encode())].tolist())
        return np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, without an end id, as little-endian 32-bit integers."""
        lot: list[list[str]] = []
        size = 0
        for text in texts:
            lot.append(self.words(text))
            size += len(text)
            if size > LOT_CHARS:
                yield from self._encode_lot(lot)
                lot, size = [], 0
        yield from self._encode_lot(lot)

    def _encode_lot(self, lot: list[list[str]]) -> list[bytes]:
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        unseen = list(set().union(*lot).difference(self.known))
        if unseen:
            self._learn(unseen)
        return [b"".join(map(self.known.__getitem__, words)) for words in lot]

    # --- decoding ---

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; the dummy prefix's blank goes."""
        while ids and ids[-1] in self.silent:
            ids = ids[:-1]
        runs = [ids] if ids else []
        if not self.silent.isdisjoint(ids):  # a control id within also ends a run of bytes
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
            runs = [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:]) if b > a + 1]
        texts = [b"".join(map(self.surface.__getitem__, r)) for r in runs]
        if runs and runs[0][0] in self.blank_first:
            texts[0] = texts[0][1:]
        return "".join(codecs.decode(t, "utf-8", "one_mark_each") for t in texts)


def _one_mark_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def _model(model_file: str) -> PieceModel:
    return per_worker(("pieces", model_file), lambda: PieceModel(model_file))


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the ``ids`` of its text, with the model's end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_file)
        end = np.array([model.end], "<i4").tobytes()
        for b in small_batches(batches):
            parts = [ids + end for ids in model.encode([t or "" for t in b.column("text").to_pylist()])]
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the ``text`` that its ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_file)
        for b in small_batches(batches):
            texts = pa.array([model.decode(i.as_py() or []) for i in b.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
