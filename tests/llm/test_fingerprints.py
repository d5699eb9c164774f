import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from grantweave.llm import fingerprints as fp
from grantweave.llm.queries import QUERIES


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    votes = [0] * 64
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for bit in range(64):
            votes[bit] += len(w) if h >> bit & 1 else -len(w)
    return sum(1 << bit for bit in range(64) if votes[bit] > 0)


def like(a, b):
    return 1 - (a ^ b).bit_count() / 64


def check(rows, ordered):
    marks = [plain(t) for _, t in ordered]
    assert len(rows) == len(ordered)
    for i, (doc, text) in enumerate(ordered):
        j = (i + 1) % len(ordered)
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + ordered[j][1][:quarter]
        r = rows[i]
        assert (r.doc_id, r.n_chars) == (doc, len(text))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        assert (own, other) == (marks[i], plain(edited))
        assert r.near_edited == like(own, other) and r.near_next == like(own, marks[j])
        if doc is not None and doc % fp.QUERY_STEP == 0:
            assert r.n_within == sum((own ^ m).bit_count() <= fp.RADIUS for m in marks)
        else:
            assert r.n_within is None


def test_query_against_brute_force(spark, small, documents):
    rows = sorted(QUERIES["op6_fingerprints"](spark, small).collect(), key=lambda r: r.doc_id)
    check(rows, list(zip(documents.doc_id, documents.text)))


def test_many_windows(spark, small, documents, monkeypatch):
    monkeypatch.setattr(fp, "WINDOW_ROWS", 3)
    monkeypatch.setattr(fp, "RANGES", 5)
    rows = sorted(QUERIES["op6_fingerprints"](spark, small).collect(), key=lambda r: r.doc_id)
    check(rows, list(zip(documents.doc_id, documents.text)))


def test_edge_rows(edge):
    out = fp.document_fingerprints(edge).collect()
    assert len(out) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect()}
    for r in out:
        text = texts[r.doc_id] or ""
        assert r.n_chars == len(text) and r.fingerprint & (1 << 64) - 1 == plain(text)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in out if r.doc_id in (1, 5)}) == 1


def test_single_document_and_empty(spark, empty):
    one = spark.createDataFrame([(5, "one two three four")], "doc_id long, text string")
    (r,) = fp.document_fingerprints(one).collect()
    assert r.near_next == 1.0
    assert fp.document_fingerprints(empty).collect() == []


def test_radius_search_finds_everything(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    f = base[rng.integers(0, 30, 500)]
    for _ in range(5):
        f = f ^ np.where(rng.random(500) < 0.6, np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64), np.uint64(0))
    f = np.unique(f)
    index = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint long")
    for radius, blocks in ((0, None), (2, None), (3, None), (6, None), (3, 5), (3, 6), (2, 5)):
        found = fp.within_radius(index.filter(F.pmod("fingerprint", F.lit(5)) == 0), index, radius, blocks).collect()
        got = sorted((r.fingerprint, r.found, r.distance) for r in found)
        signed = f.view(np.int64).tolist()
        want = sorted((a, b, d) for a in signed if a % 5 == 0 for b in signed if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= radius)
        assert got == want


def test_more_fingerprints_get_longer_keys():
    for n in (10, 10**6, 10**8, 10**9, 10**10, 10**11):
        blocks = fp.blocks_for(n)
        lead = 64 * (blocks - fp.RADIUS) // blocks
        assert n >> lead <= fp.KEY_ROWS and len(fp._tables(fp.RADIUS, blocks)) <= 20


def test_rows_without_id_are_spread(spark, monkeypatch):
    """Null ids come first, by their text's hash, and no window holds them all."""
    monkeypatch.setattr(fp, "WINDOW_ROWS", 20)
    texts = [f"text number {i} of many " * (i % 3 + 1) for i in range(400)]
    docs = spark.createDataFrame([(None if i < 300 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = fp.with_next(docs)
    per = rows.filter("guest = 0 and doc_id is null").groupBy("bucket").count().collect()
    assert len(per) >= 12 and max(r["count"] for r in per) < 60 and sum(r["count"] for r in per) == 300
    after = {r.text: r.next_text for r in rows.filter("guest = 0").collect()}
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    ordered = sorted(texts[:300], key=signed) + texts[300:]
    assert after == {t: ordered[(i + 1) % 400] for i, t in enumerate(ordered)}
