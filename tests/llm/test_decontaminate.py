import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantweave.llm import decontaminate as d
from grantweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, n_hit long"


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(texts, items, window=d.WINDOW):
    """n_words, hit word places and sorted items of each text, window by window."""
    windows = {}
    for i, text in items:
        w = split(text)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + window]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for text in texts:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                own = windows.get(tuple(w[at : at + n]))
                if own:
                    hit.update(range(at, at + n))
                    found |= own
        out.append((len(w), hit, sorted(str(i) for i in found if i is not None)))
    return out


def rows(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, {x for s in r.spans for x in range(s.start, s.end)}, r.n_hit, r.items, r.contaminated) for r in df.collect())


def wanted(ids, texts, items, window=d.WINDOW):
    return sorted((i is not None, i or 0, n, hit, len(hit), found, bool(hit)) for i, (n, hit, found) in zip(ids, plain(texts, items, window)))


def test_query_against_every_window(spark, small, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    expect = sorted((i, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)) for i, (n, hit, found) in zip(documents.doc_id, plain(documents.text, items)))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op13_decontamination"](spark, small).collect())
    assert got == expect and any(x[-1] for x in got) and not all(x[-1] for x in got)


TEXT = " ".join(f"w{i}" for i in range(40))
BENCH = [
    (1, TEXT, 0), (2, "w5 w6 W7", 0), (10, "w5 w6 w7", 0), (2, "Straße über é", 0), (None, "w20 w21 w22 w23", 0), (3, None, 0), (4, " .,;", 0), (5, "lone", 0),
    (6, "a a a a a a a a a a a a", 0), (7, "the quick brown fox jumps over the lazy dog and then it rests by the river", 0), (8, TEXT, 0),
]


@pytest.mark.parametrize("limits", [(d.SHARD_WORDS, d.BLOCK_BYTES), (100, 60), (40, d.BLOCK_BYTES)])
def test_edge_rows(spark, edge, limits):
    """Nulls, odd and long texts, repeats, clashing names; shards and blocks of any size give the same."""
    more = [(100, TEXT), (101, TEXT[:60] + " x " + TEXT[60:]), (101, "w5 w6 w7"), (102, "STRASSE Straße.ÜBER-é straße über é"), (103, "a " * 300 + "lone"), (104, TEXT * 9), (105, "w5 w6 w7 " * 60)]
    df = edge.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    df = df.withColumns({c: F.lit("clash") for c in ("n_words", "Items", "spans")}).repartition(3)
    both = [(r.doc_id, r.text) for r in df.collect()]
    bench = spark.createDataFrame(BENCH, ITEMS)
    out = d.scan(df, bench, None, d.WINDOW, *limits)
    assert rows(out) == wanted(*zip(*both), [b[:2] for b in BENCH])
    assert "bucket" in out.columns and "Items" not in out.columns
    assert rows(d.scan(df, bench, ["doc_id"], 4, *limits)) == wanted(*zip(*both), [b[:2] for b in BENCH], 4)


def test_clean_removes_documents_with_hits(spark, edge):
    bench = spark.createDataFrame(BENCH, ITEMS)
    kept = d.clean(edge, bench)
    expect = [r for r in edge.collect() if not plain([r.text], [b[:2] for b in BENCH])[0][1]]
    assert kept.columns == edge.columns and sorted(map(str, kept.collect())) == sorted(map(str, expect))


@pytest.mark.parametrize("limits", [(d.SHARD_WORDS, d.BLOCK_BYTES), (300, 100)])
def test_longest_matches(spark, limits):
    docs = [(1, "q " * 20 + " ".join(f"w{i}" for i in range(3, 31)) + " z"), (2, "w5 w6 w7 w5"), (3, None), (4, TEXT[:30]), (5, "é über"), (6, "y " * 700 + TEXT)]
    bench = [(1, TEXT), (2, "w6 w7 w5 w6"), (3, "nothing here"), (4, "Straße über é")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.item_id: r for r in d.longest_matches(df, spark.createDataFrame(bench, "item_id long, text string"), d.WINDOW, *limits).collect()}
    said = {i: split(t) for i, t in docs}
    runs = {tuple(w[a : a + n]) for w in said.values() for n in range(1, 41) for a in range(len(w) - n + 1)}
    for i, t in bench:
        w = split(t)
        best = max([n for n in range(1, len(w) + 1) for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in runs], default=0)
        r = got.get(str(i))
        assert (r.length if r else 0) == best
        if r:
            assert said[r.doc_id][r.doc_start : r.doc_start + r.length] == w[r.item_start : r.item_start + r.length]


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(3)
    for size, kinds in ((0, 1), (1, 1), (200, 2), (500, 5), (300, 1)):
        ids = rng.integers(0, kinds + 1, size)
        sa = d.SuffixArray(ids, 64)
        upto = lambda s: (ids[s : s + 64].tolist() + [0])[: (ids[s : s + 64].tolist() + [0]).index(0)]
        order = [upto(s) for s in sa.suffix]
        assert order == sorted(order) and sorted(sa.suffix) == np.flatnonzero(ids).tolist()


def test_more_words_than_numbers(spark, monkeypatch):
    """Shards with words beyond the range of a key's numbers are numbered anew."""
    numbers = d.Numbers()
    monkeypatch.setattr(d, "ABSENT", 50)
    texts = [numbers.of(" ".join(f"w{i}" for i in range(a, a + 30)).encode()) for a in (0, 60, 20)]
    block = d.Block([("x", b" ".join(b"w%d" % i for i in range(65, 80))), ("y", b"w50 w51")], 10)
    hit = {}
    for lot in d._shards(texts, 9, 30):
        doc, start, end, pairs = d.Found(texts, lot, numbers, 15).hits(block)
        hit.update({int(k): (int(a), int(b)) for k, a, b in zip(doc, start, end)})
        assert {p[1] for p in pairs} <= {0}
    assert hit == {1: (5, 20)}


def test_empty(spark, edge, empty):
    bench = spark.createDataFrame(BENCH, ITEMS)
    assert d.scan(empty, bench).collect() == []
    assert not any(r.contaminated for r in d.scan(edge, spark.createDataFrame([], ITEMS)).collect())
    assert d.longest_matches(empty, bench).collect() == []
