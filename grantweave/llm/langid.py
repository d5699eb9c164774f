"""Language ID (operator 7): nearest of several centroids per language.

A text is the TF-IDF vector, scaled to length one, of its hashed letter n-grams
(one to three characters of the lower-cased text, anything but letters read as a
blank).  Document frequencies cover every training document.  Each language's
vectors are clustered into ``CLUSTERS`` centroids by spherical k-means, on at
most about ``PER_LANGUAGE`` documents of it (those whose hashed id falls below a
share of the hash range; a repeated row counts once), so one task holds one bounded sample.  A text gets the
language of the centroid with the largest cosine.  ``rejected`` says that it lies
further from that centroid than nearly all of the centroid's own documents.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any training document every text is ``und``; a text none of whose n-grams
was seen gets the most frequent language with score 0; repeated rows are each
predicted; an empty table yields no rows.  Only doc_id, text and, for training,
lang are read.  A long text is counted in parts of ``PART`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, per_worker

GRAM_BITS, MAX_GRAM = 12, 3
SIZE = 1 << GRAM_BITS
PER_LANGUAGE, CLUSTERS, ROUNDS = 1_500, 4, 12
#: Share of a centroid's own documents that lie within its radius.
WITHIN = 0.995
PART = 1 << 20
UNDETERMINED = "und"
_BLANK = 32


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray | None:
    """Counts of a text's hashed n-grams; None without a letter."""
    letters = per_worker("letters", _letters)
    counts, any_letter = np.zeros(SIZE), False
    last = np.full(MAX_GRAM - 1, _BLANK, np.uint32)  # a text begins and ends with a blank
    for at in range(0, len(text), PART):
        codes = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "replace"), "<u4")
        seen = letters[codes]
        any_letter = any_letter or bool(seen.any())
        codes = np.concatenate([last, np.where(seen, codes, _BLANK)])
        if at + PART >= len(text):
            codes = np.append(codes, np.uint32(_BLANK))
        last = codes[-(MAX_GRAM - 1) :]
        mixed = codes[MAX_GRAM - 1 :].astype(np.uint32)
        blank = mixed == _BLANK
        for n in range(1, MAX_GRAM + 1):
            if n > 1:
                mixed = mixed * np.uint32(31_337) + codes[MAX_GRAM - n : len(codes) - n + 1]
            hashed = (mixed * np.uint32(2_654_435_769) + np.uint32(n * 7_919)) >> np.uint32(32 - GRAM_BITS)
            counts += np.bincount(hashed[~blank] if n == 1 else hashed, minlength=SIZE)
    return counts if any_letter else None


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length (or zero) and whether each text has a letter."""
    out, found = np.zeros((len(texts), SIZE), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        counts = grams(text)
        if counts is not None:
            found[i] = True
            v = np.log1p(counts) * idf
            out[i] = v / max(1e-9, np.sqrt(v @ v))
    return out, found


def spherical_means(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` unit centroids, started far apart, of unit rows."""
    start = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        start.append(x[np.argmin(np.max(x @ np.stack(start).T, axis=1))])
    c = np.stack(start)
    for _ in range(rounds):
        c /= np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))
        nearest = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[nearest == j].mean(0) if (nearest == j).any() else c[j] for j in range(len(c))])
    return (c / np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))).astype(np.float32)


class CentroidModel:
    """idf, centroids with their languages and radii, and the most frequent language."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], radius: np.ndarray, fallback: str):
        self.idf, self.centroids, self.languages, self.radius, self.fallback = idf, centroids, languages, radius, fallback

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool | None]]:
        x, found = vectors([t or "" for t in texts], self.idf)
        if not len(self.languages):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        near = x @ self.centroids.T
        best = near.argmax(1)
        cosine = np.clip(near[np.arange(len(x)), best], 0, 1).astype(float) * found
        names = [self.languages[b] if s > 0 else self.fallback for b, s in zip(best, cosine)]
        far = (1 - cosine > self.radius[best]).tolist()
        return [n if f else UNDETERMINED for n, f in zip(names, found)], cosine, [r if f else None for r, f in zip(far, found)]


def sampled(rows: DataFrame, per_language: int) -> tuple[dict[str, int], DataFrame]:
    """Rows per language, and lang and text of about ``per_language`` distinct (doc_id, text) rows of each."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    slim = rows.groupBy("lang", "doc_id", "h").agg(F.count("*").alias("n"))  # share and sample refer to the same rows
    counted = slim.groupBy("lang").agg(F.count("*"), F.sum("n")).collect()  # one row per language
    share = F.coalesce(*[F.when(F.col("lang") == r[0], F.lit(per_language / r[1])) for r in counted], F.lit(0.0))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return {r[0]: r[2] for r in counted}, rows.filter(place < share).dropDuplicates(["lang", "doc_id", "h"]).select("lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> CentroidModel:
    """Fit on the documents outside the held-out fold that have a language and a letter."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            for text in b.text:
                counts = grams(text)
                if counts is not None:
                    total += counts > 0
                    n += 1
        yield pd.DataFrame({"gram": np.r_[np.flatnonzero(total), -1], "df": np.r_[total[total > 0], n]})

    summed = rows.select("text").mapInPandas(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    df, n = np.zeros(SIZE), 0
    for gram, count in summed.collect():  # one row per hashed n-gram at most
        if gram < 0:
            n = count
        else:
            df[gram] = count
    idf = np.log((1 + n) / (1 + df)) + 1

    counts, sample = sampled(rows, per_language)
    if not counts:
        return CentroidModel(idf, np.zeros((0, SIZE), np.float32), [], np.zeros(0), UNDETERMINED)

    def cluster(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x, found = vectors(sorted(b.text), idf)
        x = x[found]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        c = spherical_means(x)
        near = x @ c.T
        nearest = near.argmax(1)
        away = [1 - near[nearest == j, j] for j in range(len(c))]
        radius = [float(np.quantile(a, WITHIN)) if len(a) else 0.0 for a in away]
        return pd.DataFrame({"lang": key[0], "centroid": [v.tobytes() for v in c], "radius": radius})

    fitted = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, radius double")
    fitted = sorted(fitted.collect(), key=lambda r: (r[0], r[2], r[1]))  # CLUSTERS rows per language
    c = np.stack([np.frombuffer(r[1], np.float32) for r in fitted]) if fitted else np.zeros((0, SIZE), np.float32)
    return CentroidModel(idf, c, [r[0] for r in fitted], np.array([r[2] for r in fitted]), max(sorted(counts), key=counts.get))


def predict(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected per document."""
    sent = docs.sparkSession.sparkContext.broadcast(model.__dict__)  # SIZE numbers per centroid

    def make():
        own = CentroidModel(**sent.value)

        def run(texts: list[str | None]) -> list[list]:
            lots = [own.predict(texts[at : at + 256]) for at in range(0, len(texts), 256)]
            return [[x for lot in lots for x in lot[k]] for k in range(3)]

        return run

    return map_texts(docs, ["doc_id"], make, {"lang_pred": "string", "score": "double", "rejected": "boolean"})
