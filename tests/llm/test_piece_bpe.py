import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from grantweave.llm import piece_bpe
from grantweave.llm.queries import QUERIES, tokenizer_path

from .conftest import edge_rows

ODD = [
    "", " ", "  ", "a  b", " a", "a ", "a \nb", "\t\n x", "▁▁x y", "a\x00b", "<s> </s> <unk> <0x41>", "ß\r\nq", "日本語テキスト😀 😀😀",
    "aaaaaaaaaaaaaaaa" * 99, "x" * 5000, "\n\n\n\n  \n", "    def f(x):\n        return x", "=" * 3000, "the" * 900, "é x́ ﬁ",
]


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_the_library(spark, small, documents, library):
    rows = {r.doc_id: r for r in QUERIES["op5_piece_bpe"](spark, small).collect()}
    assert len(rows) == len(documents)
    for doc, text in zip(documents.doc_id, documents.text):
        ids = library.encode(text, add_eos=True)
        assert (rows[doc].n_tokens, rows[doc].ids_sha256, rows[doc].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


def test_odd_and_random_texts(model, library):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("abcdeinrst é\n ▁日.<0x>'😀-=") for _ in range(rnd.randrange(150))) for _ in range(500)]
    for text, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text)


def test_long_words_merge_many_places_a_round(model, library):
    """Words of many thousand symbols without a blank: equal to the library's, in rounds far fewer than symbols."""
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("theanrioes") for _ in range(6_000)), "ab" * 5_000, "abab" * 700 + "ba" * 900, "aaab" * 1_500, "the" * 3_000 + "then" * 500]
    texts += ["".join(rnd.choice("ab") for _ in range(n)) for n in range(2, 60)] + ["".join(rnd.choice("theans") for _ in range(300)) for _ in range(60)]
    for text in texts:
        model.known.clear()
        assert np.frombuffer(next(iter(model.encode([text]))), "<i4").tolist() == library.encode(text)
    symbols = model.symbol_of[np.frombuffer(texts[0].encode("utf-32-le"), "<u4").astype(np.int64)]
    calls = []
    model._from_the_left, kept = (lambda *a: calls.append(1) or kept(*a)), model._from_the_left
    try:
        model.merge(symbols, np.zeros(len(symbols), np.int64))
    finally:
        del model._from_the_left
    assert len(calls) < len(texts[0]) / 4


def test_decoding_any_ids(model, library):
    rnd = random.Random(7)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randrange(259), rnd.randrange(32000), 28705, 2, 1, 0]) for _ in range(rnd.randrange(12))]
        assert model.decode(ids) == library.decode(ids)


def test_edge_rows(edge, library):
    file = tokenizer_path("piece_bpe_32k.model")
    out = piece_bpe.decode(piece_bpe.encode(edge, file), file).collect()
    texts = {r[0]: r[1] or "" for r in edge_rows()}
    assert len(out) == len(edge_rows())
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id], add_eos=True) and r.text == library.decode(r.ids)


def test_empty(empty):
    file = tokenizer_path("piece_bpe_32k.model")
    assert piece_bpe.decode(piece_bpe.encode(empty, file), file).collect() == []
