import re

import pytest

from grantweave.llm import licenses
from grantweave.llm.queries import QUERIES


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words_of(text)
    at = [(i, label) for i in range(len(w)) for phrase, label in licenses.PHRASES if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def verified(text):
    """Labels and best share over every place a template could begin at."""
    w, labels, best = words_of(text), set(), 0.0
    for label, notice, phrases in licenses.TEMPLATES:
        t = notice.split()
        must = {next(i for i in range(len(t)) if t[i : i + len(p.split())] == p.split()) + k for p in phrases for k in range(len(p.split()))}
        for begin in range(-len(t), len(w)):
            there = {i for i in range(len(t)) if 0 <= begin + i < len(w) and w[begin + i] == t[i]}
            if must <= there:
                labels.add(label)
                best = max(best, len(there) / len(t))
    return labels, best


def check(rows, texts):
    for r in rows:
        text = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        labels, best = verified(text)
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(",")))
        assert r.score == pytest.approx(best)


def test_query_against_brute_force(spark, documents, small):
    rows = QUERIES["op10_licenses"](spark, small).collect()
    assert len(rows) == len(documents)
    check(rows, dict(zip(documents.doc_id, documents.text)))
    assert any(r.labels for r in rows)


def test_edge_rows(edge, empty):
    rows = licenses.scan(edge).collect()
    assert len(rows) == edge.count()
    check(rows, {r.doc_id: r.text for r in edge.collect()})
    assert licenses.scan(empty).collect() == []


def test_notices_inside_texts(spark):
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    texts = {i: f"Some words before it.\n{n.title()}, and some words after it." for i, n in enumerate(notices)}
    texts[100] = "MIT LICENSE mit-license Apache\nLicense; general public  license! mit licensed"
    texts[101] = " ".join(notices)
    texts[102] = "the license of the software is granted to any person free of charge"
    texts[103] = "mİt license ſ " * 3
    texts[104] = "license"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = licenses.scan(df).collect()
    by = {r.doc_id: r for r in rows}
    check(rows, texts)
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in by[i].labels.split(",") and by[i].score == 1.0
    assert by[100].n_base == 4 and by[100].base_labels == "apache,gpl,mit"
    assert set(by[101].labels.split(",")) == {label for label, _, _ in licenses.TEMPLATES}
    assert by[102].labels == "" and by[102].score == 0.0


def test_rare_words_decide_candidates(spark):
    """The anchors follow the corpus: words that are common there are not looked up."""
    n = 50
    common = spark.range(n).selectExpr("id doc_id", "if(id % 2 = 0, 'license for mit people', 'apache version') text")
    count, df = licenses.frequencies(common)
    assert (count, df["license"], df["apache"]) == (n, n // 2, n // 2)
    idf = {w: -df.get(w, 0) for _, notice, _ in licenses.TEMPLATES for w in notice.split()}
    chosen = licenses.anchors(idf)
    assert {w for w, _ in chosen[2]} == {"2", "0"} and all(len(own) == licenses.ANCHORS for own in chosen)
    for own, (_, notice, phrases) in zip(chosen, licenses.TEMPLATES):
        must = licenses._mandatory(notice, phrases)
        assert {i for _, i in own} <= set(must) and all(notice.split()[i] == w for w, i in own)
    # whichever words are the anchors, the results are those of every place
    texts = {i: notice for i, (_, notice, _) in enumerate(licenses.TEMPLATES)}
    texts |= {100 + i: " ".join(notice.split()[: len(notice.split()) // 2]) for i, (_, notice, _) in enumerate(licenses.TEMPLATES)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for mix in (docs, docs.unionByName(common.selectExpr("doc_id + 1000 doc_id", "text"))):
        rows = [r for r in licenses.scan(mix).collect() if r.doc_id in texts]
        check(rows, texts)


def test_every_phrase_needs_a_word():
    words = licenses.needed()
    phrases = [p for p, _ in licenses.PHRASES] + [p for _, _, ps in licenses.TEMPLATES for p in ps]
    assert all(any(w in x for w in words for x in p.split()) for p in phrases)


def test_a_long_text_takes_linear_time(spark):
    """200,000 words with a licence word in every third place, scanned in seconds."""
    import time

    text = "the license permission " * 66_000 + "released under the mit license " * 500
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    licenses.scan(df.limit(0)).collect()
    began = time.time()
    row = licenses.scan(df).first()
    assert time.time() - began < 30
    assert (row.n_words, row.n_base, row.labels, row.score) == (200_500, 500, "mit", 1.0)
