"""Quality classifier (operator 4): a factorisation machine over a text's features.

Features of a text: hashed words (log counts, scaled to length one), hashed word
shapes (which characters a word is made of, in order, runs collapsed), structure
statistics, each cut into bins, and as metadata the binned length of the text.
A label, lang, source or doc_id never is one.  Every feature has a weight and a
low-rank vector; a pair's interaction is the product of its vectors, and all
pairs together cost linear time, as

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

Features are computed where the documents lie.  The machine is fitted in one
task, on at most ``MAX_TRAIN`` labelled documents outside the held-out fold (those
with the smallest hash of their id), so that task and the model are bounded
whatever the input size; then every whole text is scored in one pass.

Defined results: a null text counts as empty and is scored like any; a document
labelled more than once is trained on with its mean label; null labels and ids
train nothing; without labels every score is 0.5; repeated rows are each scored;
an empty table yields no rows.  Columns named as the result's are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, per_worker

WORD_BITS, SHAPE_BITS, RANK = 14, 10, 8
EDGES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
LENGTH_EDGES = (0, 50, 100, 200, 500, 1_000, 2_000, 5_000, 20_000)
STATS = 9
SHAPES = 1 << WORD_BITS
BINS = SHAPES + (1 << SHAPE_BITS)
SIZE = BINS + (STATS + 1) * (len(LENGTH_EDGES) + 1)
#: Documents the machine is fitted on at most, and the score from which a document passes.
MAX_TRAIN, PASS = 16_000, 0.7
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.05, 1e-5
WORD_CACHE = 200_000
#: Characters that structure statistics count.
SYMBOLS, CLOSERS = "#*$%&|<>{}[]=_^~\\@", ".!?:;\"'"
_SHAPE = tuple((re.compile(p), s) for p, s in ((r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[^\W\d_A]+", "a"), (r"\d+", "9"), (r"([^\w])\1+", r"\1")))


class Featuriser:
    """Indices and values of a text's features."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        if word.isalpha() and (word.islower() or word.istitle()):
            shape = "a" if word.islower() else "Aa" if len(word) > 1 else "A"
        else:
            shape = word
            for pattern, put in _SHAPE:
                shape = pattern.sub(put, shape)
        code = zlib.crc32(word.lower().encode()) & (SHAPES - 1), SHAPES + (zlib.crc32(shape[:12].encode()) & ((1 << SHAPE_BITS) - 1))
        self.known[word] = code
        return code

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        counts = Counter(text.split())
        known, n_words = self.known, max(1, counts.total())
        codes = np.array([known.get(w) or self._word(w) for w in counts], np.int64).reshape(-1, 2)
        times = np.fromiter(counts.values(), np.float64, len(counts))
        parts, values = [], []
        for column in (0, 1):
            index, inverse = np.unique(codes[:, column], return_inverse=True)
            value = np.log1p(np.bincount(inverse, times, len(index)))
            parts.append(index)
            values.append(value / max(1e-9, float(np.sqrt((value * value).sum()))))
        lines = [s for line in text.split("\n") if (s := line.strip())]
        n, n_lines = max(1, len(text)), max(1, len(lines))
        letters = sum(1 for c in counts if c[:1].isupper())
        stats = (
            sum(map(text.count, SYMBOLS)) / n,
            sum(t for w, t in counts.items() if len(w) > 1 and w.isupper()) / n_words,
            letters / max(1, len(counts)),
            1 - len(counts) / n_words,
            max(counts.values(), default=0) / n_words,
            1 - len(set(lines)) / n_lines if lines else 0.0,
            sum(line[-1] in CLOSERS for line in lines) / n_lines,
            text.count("!") / n_words,
            min(1.0, sum(map(len, counts)) / max(1, len(counts)) / 20),
        )
        bins = np.searchsorted(EDGES, stats, side="right")
        bins = np.append(bins, np.searchsorted(LENGTH_EDGES, len(text), side="right"))
        parts.append(BINS + np.arange(STATS + 1) * (len(LENGTH_EDGES) + 1) + bins)
        values.append(np.full(STATS + 1, 0.3))
        return np.concatenate(parts).astype(np.int32), np.concatenate(values).astype(np.float32)


class FactorisationMachine:
    """bias, weights and vectors; scores in linear time, fitted by AdaGrad on the log loss."""

    def __init__(self, bias: float = 0.0, weight: np.ndarray | None = None, vector: np.ndarray | None = None):
        self.bias = bias
        self.weight = np.zeros(SIZE) if weight is None else weight
        self.vector = np.random.default_rng(7).normal(0, 0.02, (SIZE, RANK)) if vector is None else vector

    def _forward(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        parts = self.vector[index] * value[:, None]
        sums = np.add.reduceat(parts, starts)
        pairs = 0.5 * (sums * sums - np.add.reduceat(parts * parts, starts)).sum(1)
        return parts, sums, self.bias + np.add.reduceat(self.weight[index] * value, starts) + pairs

    def score(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not features:
            return np.zeros(0)
        index, value, starts = _flat(features)
        return 1 / (1 + np.exp(-np.clip(self._forward(index, value, starts)[2], -30, 30)))

    def fit(self, features: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> FactorisationMachine:
        rng = np.random.default_rng(11)
        seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(features))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                index, value, starts = _flat([features[r] for r in rows])
                parts, sums, raw = self._forward(index, value, starts)
                slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]
                row = np.repeat(np.arange(len(rows)), np.diff(np.r_[starts, len(index)]))
                step = slope[row] * value
                touched, inverse = np.unique(index, return_inverse=True)
                g = np.bincount(inverse, step, len(touched)) + DECAY * self.weight[touched]
                seen_w[touched] += g * g
                self.weight[touched] -= RATE * g / np.sqrt(seen_w[touched])
                pull = step[:, None] * (sums[row] - parts)
                g = np.stack([np.bincount(inverse, pull[:, f], len(touched)) for f in range(RANK)], 1) + DECAY * self.vector[touched]
                seen_v[touched] += g * g
                self.vector[touched] -= RATE * g / np.sqrt(seen_v[touched])
                seen_b += slope.sum() ** 2
                self.bias -= RATE * slope.sum() / np.sqrt(seen_b)
        return self


def _flat(features: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index = np.concatenate([f[0] for f in features])
    value = np.concatenate([f[1] for f in features]).astype(np.float64)
    return index, value, np.cumsum([0, *(len(f[0]) for f in features[:-1])])


def one_text(found: DataFrame) -> DataFrame:
    """doc_id, label and text of one row per doc_id, the one with the smallest text hash; repeats are combined before the shuffle."""
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fit on at most ``max_train`` documents of the training folds that have a quality label, each once however often it repeats."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double")).dropna().filter(~held_out())
    marked = marked.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # max_train slim rows
    texts = one_text(found)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = per_worker("quality features", Featuriser)
        for b in batches:
            found = [features(t or "") for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "label": b.label, "index": [f[0] for f in found], "value": [f[1] for f in found]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lots = [b for b in batches if len(b)]
        if lots:
            rows = pd.concat(lots).sort_values(["doc_id", "label"], kind="stable")
            model = FactorisationMachine().fit(list(zip(rows["index"], rows["value"])), rows.label.to_numpy())
            yield pd.DataFrame({"bias": [model.bias], "weight": [model.weight.tobytes()], "vector": [model.vector.tobytes()]})

    rows = texts.mapInPandas(featurise, "doc_id long, label double, index array<int>, value array<float>")
    fitted = rows.repartition(1).mapInPandas(fit, "bias double, weight binary, vector binary").collect()  # one row of bounded size
    if not fitted:
        return FactorisationMachine(vector=np.zeros((SIZE, RANK)))
    bias, weight, vector = fitted[0]
    return FactorisationMachine(bias, np.frombuffer(weight).copy(), np.frombuffer(vector).reshape(SIZE, RANK).copy())


def score(docs: DataFrame, model: FactorisationMachine, carry: list[str], name: str = "score") -> DataFrame:
    """Columns ``carry`` of ``docs`` and the score of its text as column ``name``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight.astype(np.float32), model.vector.astype(np.float32)))

    def make():
        features, machine = per_worker("quality features", Featuriser), FactorisationMachine(*sent.value)

        def run(texts: list[str | None]) -> list[np.ndarray]:
            lots = [machine.score([features(t or "") for t in texts[at : at + 256]]) for at in range(0, len(texts), 256)]
            return [np.concatenate([np.zeros(0), *lots])]

        return run

    return map_texts(docs, carry, make, {name: "double"})
