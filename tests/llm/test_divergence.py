import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grantweave.llm import divergence
from grantweave.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=divergence.TOP, min_docs=divergence.MIN_DOCS, scale=divergence.SCALE):
    """Every row of the result, from (text, lang, source), term by term."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        share = {}
        for key, counts in [*((k, c) for k, c in groups.items() if k[0] == lang), ((lang,), sum((c for k, c in groups.items() if k[0] == lang), Counter()))]:
            total = sum(counts[t] for t in kept) + len(kept)
            share[key] = {t: 1 + scale * (counts[t] + 1) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for key in [k for k in share if len(k) == 2]:
            p = share[key]
            pairs = [(sum(f(p[t], q[t]) for t in kept), o[1]) for o, q in share.items() if len(o) == 2 and o != key]
            terms = [(f(p[t], share[lang,][t]), t) for t in kept if groups[key][t] and p[t] > share[lang,][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((*key, part, item, value, rank))
    return out


def rows_of(df):
    found = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(set(found)) == len(found)
    return set(found)


def test_query_against_every_term(spark, small, documents):
    assert rows_of(QUERIES["op11_divergence"](spark, small)) == plain(list(zip(documents.text, documents.lang, documents.source)))


@pytest.mark.parametrize("held", [divergence.HELD_TERMS, 5])
def test_edge_rows(spark, edge, held, monkeypatch):
    """Nulls, odd texts, repeats and clashing names; sums handed on after few rows and many give the same."""
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    monkeypatch.setattr(divergence, "HELD_PAIRS", held)
    rows = [(r.text, r.lang, r.source) for r in edge.collect()]
    extra = [("Kelvin K stays, STRASSE ß é\x85É\x00a_b a-b 12", None, "s" + str(i % 4)) for i in range(12)]
    extra += [("a a b c " * i, "xx", ["", "p", "q", None][i % 4]) for i in range(9)] + [("", "yy", "lone"), (None, "yy", "other"), ("x", "zz", "one")]
    more = spark.createDataFrame(extra, "text string, lang string, source string")
    df = edge.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("clash") for c in ("term", "item", "value", "p", "count")}).repartition(3)
    assert rows_of(divergence.source_divergence(df)) == plain([*rows, *extra])
    assert rows_of(divergence.source_divergence(df, top=2, min_docs=1, scale=1000)) == plain([*rows, *extra], 2, 1, 1000)


def test_shares_are_exact_at_any_size(spark):
    cases = [(0, 1), (5, 7), (9_223_372_034, 9_223_372_040), (9_223_372_036, 9_223_372_037), (4 * 10**18, 5 * 10**18), (10**12, 3 * 10**12 + 1)]
    got = spark.createDataFrame(cases, "c long, t long").select("c", "t", divergence.share("c", "t").alias("p")).collect()
    assert {(r.c, r.t): r.p for r in got} == {(c, t): 1 + 10**9 * (c + 1) // t for c, t in cases}


def test_empty(spark, empty):
    assert divergence.source_divergence(empty).collect() == []
