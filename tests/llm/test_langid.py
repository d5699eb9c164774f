import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantweave.llm import langid
from grantweave.llm.queries import QUERIES


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_langid"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_rows_teach_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(other)
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids) and np.array_equal(a.idf, b.idf)


def test_edge_rows(edge, empty):
    model = langid.train(edge)
    rows = langid.predict(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r.doc_id in (2, 3, 6):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, None)
        else:
            assert r.lang_pred == "en" and 0 <= r.score <= 1
    assert langid.predict(empty, model).collect() == []
    untaught = langid.train(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(edge, untaught).collect()} == {"und"}


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "Straße über alles, " * 40
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "PART", 37)
    assert np.array_equal(langid.grams(text), whole)
    assert langid.grams("12 --- 34") is None


def test_far_texts_are_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(1, "щука жила в реке " * 20), (2, docs.first().text)], "doc_id long, text string")
    out = {r.doc_id: r.rejected for r in langid.predict(odd, langid.train(docs)).collect()}
    assert out == {1: True, 2: False}


def test_repeated_rows_count_once_in_the_sample(spark):
    docs = spark.range(60).selectExpr("id doc_id", "concat('text ', id) text", "if(id < 20, 'aa', 'bb') lang")
    _, plain = langid.sampled(docs, 10)
    plain = sorted(map(tuple, plain.collect()))
    assert {lang for lang, _ in plain} == {"aa", "bb"} and len(plain) < 60
    taken = {text for _, text in plain}
    for inside in (True, False):  # a row of the rare language that is in the sample, and one that is not
        hot = next(f"text {i}" for i in range(20) if (f"text {i}" in taken) == inside)
        many = docs.filter(F.col("text") == hot).crossJoin(spark.range(3000).select(F.lit(1).alias("x"))).drop("x")
        counts, sample = langid.sampled(docs.unionByName(many), 10)
        assert counts == {"aa": 3020, "bb": 40}
        assert sorted(map(tuple, sample.collect())) == plain


def plain_grams(text):
    """Hashed 1- to 3-grams of letters, one after the other."""
    codes = [32, 32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32]
    counts = [0] * langid.SIZE
    for i in range(2, len(codes)):
        mixed = 0
        for n in range(1, langid.MAX_GRAM + 1):
            mixed = (mixed * 31_337 + codes[i - n + 1]) % 2**32 if n > 1 else codes[i]
            if n > 1 or codes[i] != 32:
                counts[((mixed * 2_654_435_769 + n * 7_919) % 2**32) >> (32 - langid.GRAM_BITS)] += 1
    return counts


def plain_vector(text, idf):
    v = [math.log1p(n) * w for n, w in zip(plain_grams(text), idf)]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


def test_model_against_plain_tf_idf_and_cosine(spark, small, documents):
    """Document frequencies over every training text, unit TF-IDF vectors, the nearest centroid and its radius, by hand."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs)
    taught = [t for i, t, lang in zip(documents.doc_id, documents.text, documents.lang) if zlib.crc32(str(i).encode()) % 4 != 2 and lang and t and any(map(str.isalpha, t))]
    df = [0] * langid.SIZE
    for text in taught:
        for g, n in enumerate(plain_grams(text)):
            df[g] += n > 0
    idf = [math.log((1 + len(taught)) / (1 + n)) + 1 for n in df]
    assert np.allclose(model.idf, idf)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and max(map(model.languages.count, model.languages)) <= langid.CLUSTERS
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text in list(zip(documents.doc_id, documents.text))[:40]:
        near = [sum(a * b for a, b in zip(plain_vector(text, idf), c)) for c in model.centroids.tolist()]
        best = max(range(len(near)), key=near.__getitem__)
        assert rows[i].score == pytest.approx(near[best], abs=1e-4) and rows[i].lang_pred == model.languages[best]
        if abs(1 - near[best] - model.radius[best]) > 1e-4:
            assert rows[i].rejected == (1 - near[best] > model.radius[best])


def test_spherical_means_step_by_step():
    rng = np.random.default_rng(4)
    x = rng.random((60, 6)) ** 4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit = lambda v: v / np.linalg.norm(v)
    centres = [x.mean(0)]
    while len(centres) < 3:
        centres.append(min(x, key=lambda v: max(v @ c for c in centres)))
    for _ in range(5):
        own = [[] for _ in centres]
        centres = [unit(c) for c in centres]
        for v in x:
            own[max(range(len(centres)), key=lambda j: v @ centres[j])].append(v)
        centres = [np.mean(vs, axis=0) if vs else c for vs, c in zip(own, centres)]
    assert np.allclose(langid.spherical_means(x, 3, 5), [unit(c) for c in centres], atol=1e-6)
