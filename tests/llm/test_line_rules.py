import random
import re
from collections import Counter

import pytest

from grantweave.llm import line_rules as lr
from grantweave.llm.queries import QUERIES


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_query_against_brute_force(spark, small, documents):
    rows = {r.doc_id: r for r in QUERIES["op9_line_rules"](spark, small).collect()}
    assert len(rows) == len(documents)
    for doc, text in zip(documents.doc_id, documents.text):
        r = rows[doc]
        assert tuple(r[c] for c in (*lr.BASE, "base_failed")) == base(text)
        assert not (r.base_failed and r.kept)


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_line_rules"](spark, sf).collect() if not r.base_failed and r.doc_id in quality]
    assert all(r.kept for r in rows if quality[r.doc_id] == 1)
    junk = [r for r in rows if quality[r.doc_id] == 0]
    assert sum(r.kept for r in junk) / len(junk) < 0.1


@pytest.mark.parametrize("seed", range(6))
def test_repeated_words(seed):
    rnd = random.Random(seed)
    words = [rnd.choice("abc" if seed % 2 else "abcdefgh") for _ in range(rnd.randrange(200))]
    if seed > 2:
        words = words[:30] * 3 + ["z"] + words[5:25]
    assert lr.repeated_words(words) == base(" ".join(words))[4]


@pytest.mark.parametrize(
    "line, rule",
    [
        ("A plain line of words that ends well.", None),
        ("### $$$ %%% &&&", "symbols"),
        ("Home | News | Sport | Contact", "navigation"),
        ("BUY NOW! GO! GO! THIS IS IT!", "shouting"),
        ("Please read our Privacy Policy first.", "boilerplate"),
        ("the the the the and and and and", "stutter"),
        ("Home About Contact Login Register", "navigation"),
        ("Read more »", "navigation"),
        ("Share on Facebook Tweet this", "navigation"),
        ("Contact us", "navigation"),
        ("Log in", "navigation"),
        ("[Next page]", "navigation"),
        ("The home page of our news.", None),
        ("Home is where the heart is", None),
        ("We read the news at home and reply by email on the next page of it", None),
        ("Copyright 2024 Example Inc", "boilerplate"),
        ("(c) 1999 the authors", "boilerplate"),
        ("A copyright of old, from 1999.", None),
        ("The story of a fox that ...", "teaser"),
        ("It went on and on and on, and then it trailed off…", None),
        (" ".join(f"key{i}" for i in range(70)), "run-on"),
        (" ".join(f"key{i}" for i in range(70)) + ".", None),
    ],
)
def test_rules(line, rule):
    assert lr.failing(line, line.split()) == rule


def test_edge_rows(edge, empty):
    out = lr.measure(edge).collect()
    assert len(out) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect()}
    for r in out:
        assert tuple(r[c] for c in (*lr.BASE, "base_failed")) == base(texts[r.doc_id])
    assert not any(r.kept for r in out if r.doc_id in (2, 3, 6))
    assert lr.measure(empty).collect() == [] and lr.clean(empty).collect() == []


def test_cleaning_removes_lines_and_keeps_columns(spark, edge):
    good = [" ".join(f"word{k}x{i}" for i in range(20)) + "." for k in range(4)]
    text = "\n".join([good[0], "Home | News | Sport | Contact", good[1], "Brief.", "Brief.", "", good[2]])
    docs = spark.createDataFrame([(1, text, len(text), "a"), (2, "x", 1, "b"), (None, text, None, None)], "doc_id long, text string, n_chars long, kept string")
    rows = sorted(lr.clean(docs).collect(), key=str)
    want = "\n".join([good[0], good[1], "Brief.", "", good[2]])
    assert [tuple(r) for r in rows] == [(1, want, len(want), "a"), (None, want, len(want), None)]
    assert lr.clean(edge).columns == edge.columns
