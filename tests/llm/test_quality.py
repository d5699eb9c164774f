import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grantweave.llm import quality
from grantweave.llm.queries import QUERIES


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    features = [(rng.choice(quality.SIZE, n, replace=False), rng.normal(size=n) / n) for n in (2, 5, 9)]
    for (index, value), got in zip(features, m.score(features)):
        raw = m.bias + sum(m.weight[i] * x for i, x in zip(index, value))
        raw += sum(m.vector[index[a]] @ m.vector[index[b]] * value[a] * value[b] for a in range(len(index)) for b in range(a))
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


def test_fit_learns_a_pair():
    """Two features together, neither alone: only an interaction tells the classes apart."""
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 2, (2000, 2))
    features = [(np.array([a, 2 + b], np.int32), np.ones(2, np.float32)) for a, b in pairs]
    label = (pairs[:, 0] == pairs[:, 1]).astype(float)
    got = quality.FactorisationMachine().fit(features * 6, np.tile(label, 6)).score(features)
    assert ((got > 0.5) == label).mean() > 0.95


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op4_quality"](spark, sf).collect()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    held = [(rows[d], q) for d, q in zip(labels.doc_id, labels.quality) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95


def test_scores_do_not_see_forbidden_columns_or_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()}
    b = {r.doc_id: r.score for r in quality.score(changed, quality.train(changed, flipped), ["doc_id"]).collect()}
    assert a == b


def test_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    model = quality.train(edge, labels)
    out = quality.score(edge, model, edge.columns)
    assert sorted(out.columns) == sorted(edge.columns)
    rows = out.collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1  # null counts as empty
    assert any(r.doc_id == 9_007_199_254_740_993 for r in rows)
    assert quality.score(empty, model, ["doc_id"]).collect() == []
    none = quality.train(edge, labels.filter("false"))
    assert {r.score for r in quality.score(edge, none, ["doc_id"]).collect()} == {0.5}


def test_a_repeated_labelled_document_is_trained_on_once(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    taught = docs.join(labels.filter(~quality.held_out()).select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").limit(1)
    hot = taught.crossJoin(spark.range(300).select(F.lit(1).alias("x"))).select(*docs.columns)
    a, b = quality.train(docs, labels), quality.train(docs.unionByName(hot), labels)
    assert hot.count() == 300 and a.bias == b.bias and np.array_equal(a.weight, b.weight) and np.array_equal(a.vector, b.vector)


def plain_features(text):
    """Index -> value of a text's features, one after the other."""

    def shape(word):
        if word.isalpha() and word.islower():
            return "a"
        if word.isalpha() and word.istitle():
            return "Aa" if len(word) > 1 else "A"
        for pattern, put in (("[A-ZÀ-ÖØ-Þ]+", "A"), (r"[^\W\d_A]+", "a"), (r"\d+", "9"), (r"([^\w])\1+", r"\1")):
            word = re.sub(pattern, put, word)
        return word[:12]

    out = {}
    words = text.split()
    for code in (
        lambda w: zlib.crc32(w.lower().encode()) % (1 << quality.WORD_BITS),
        lambda w: quality.SHAPES + zlib.crc32(shape(w).encode()) % (1 << quality.SHAPE_BITS),
    ):
        times = Counter(code(w) for w in words)
        size = math.sqrt(sum(math.log1p(n) ** 2 for n in times.values())) or 1.0
        out |= {i: math.log1p(n) / size for i, n in times.items()}
    kinds, n_words, n = Counter(words), max(1, len(words)), max(1, len(text))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    stats = [
        sum(c in quality.SYMBOLS for c in text) / n,
        sum(len(w) > 1 and w.isupper() for w in words) / n_words,
        sum(w[0].isupper() for w in kinds) / max(1, len(kinds)),
        1 - len(kinds) / n_words,
        max(kinds.values(), default=0) / n_words,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(x[-1] in quality.CLOSERS for x in lines) / max(1, len(lines)),
        text.count("!") / n_words,
        min(1.0, sum(map(len, kinds)) / max(1, len(kinds)) / 20),
    ]
    width = len(quality.LENGTH_EDGES) + 1
    for k, x in enumerate(stats):
        out[quality.BINS + k * width + sum(x >= e for e in quality.EDGES)] = 0.3
    out[quality.BINS + len(stats) * width + sum(len(text) >= e for e in quality.LENGTH_EDGES)] = 0.3
    return out


def test_features_by_hand(documents):
    texts = ["", " \n", "A", "Hello WORLD hello!! 42 a1-B2 ### ünï Éa", "x\nx\n\ny!", *[t for t in documents.text[:60] if t]]
    make = quality.Featuriser()
    for text in texts:
        index, value = make(text)
        assert len(set(index.tolist())) == len(index)
        assert dict(zip(index.tolist(), value.tolist())) == pytest.approx(plain_features(text), abs=1e-5)


def test_one_step_of_the_fit_by_hand(monkeypatch):
    """AdaGrad on the log loss: each parameter's gradient from differences of the loss itself."""
    monkeypatch.setattr(quality, "EPOCHS", 1)
    features = [(np.array([0, 2, 5], np.int32), np.array([0.5, 1.0, 0.25], np.float32)), (np.array([2, 3], np.int32), np.array([0.75, 0.5], np.float32))]
    label = np.array([1.0, 0.0])
    start = lambda: quality.FactorisationMachine(0.1, np.arange(quality.SIZE) * 0.01, np.random.default_rng(5).normal(0, 0.3, (quality.SIZE, quality.RANK)))

    def loss(m):
        p = m.score(features)
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).sum()

    def slope(move):
        up, down = start(), start()
        move(up, 1e-5)
        move(down, -1e-5)
        return (loss(up) - loss(down)) / 2e-5

    fitted, before = start().fit(features, label), start()
    for i in (0, 2, 3, 5):
        g = slope(lambda m, d: m.weight.__setitem__(i, m.weight[i] + d)) + quality.DECAY * before.weight[i]
        assert fitted.weight[i] == pytest.approx(before.weight[i] - quality.RATE * g / np.sqrt(1e-6 + g * g), abs=1e-4)
        for f in range(quality.RANK):
            g = slope(lambda m, d: m.vector.__setitem__((i, f), m.vector[i, f] + d)) + quality.DECAY * before.vector[i, f]
            assert fitted.vector[i, f] == pytest.approx(before.vector[i, f] - quality.RATE * g / np.sqrt(1e-6 + g * g), abs=1e-3)
    assert fitted.weight[1] == before.weight[1]
