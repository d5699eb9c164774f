import numpy as np

import __spark_entry__
import corpus_pipeline
from grantweave.llm import line_rules, quality
from grantweave.llm.queries import SQL

from .test_packing import check
from .test_simhash_dedup import plain_components, plain_fingerprint


def test_run_against_a_plain_version(spark, small, documents):
    from tokenizers import Tokenizer

    from grantweave.llm.queries import tokenizer_path

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model, features = quality.train(docs, labels), quality.Featuriser()
    kept = []
    for doc, text in zip(documents.doc_id, documents.text):
        if model.score([features(text)])[0] >= quality.PASS:
            *_, ok, text = line_rules.judge(text)
            if ok:
                kept.append((doc, text))
    roots = plain_components([plain_fingerprint(t) for _, t in kept])
    kept = [x for i, x in enumerate(kept) if roots[i] == i]
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {doc: t.encode(text, add_special_tokens=False).ids + [1] for doc, text in kept}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == set(ids) and 0 < len(ids) < len(documents)
    check(rows, ids)


def test_stages_on_edge_rows(spark, edge, empty, small):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, small).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, small).collect() == []


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(SQL) <= set(names) and "op8_chat" in __spark_entry__.oracle_sql()


def test_scores_are_stable(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.train(docs, labels), quality.train(docs.repartition(3), labels)
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.vector, b.vector)
