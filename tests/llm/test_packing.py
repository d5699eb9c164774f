import random
import zlib

import numpy as np
import pytest

from grantweave.llm import packing
from grantweave.llm.queries import QUERIES, tokenizer_path

from .conftest import edge_rows


@pytest.fixture(scope="module")
def file():
    return tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference(file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(rows, ids_of):
    """Pieces tile their documents, and sequences are gapless and short enough."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, own in by_doc.items():
        ids = np.array(ids_of[doc], "<u4")
        copies = len(own) // len({r.start for r in own})
        spans = sorted((r.start, r.length) for r in own)
        assert spans == sorted(copies * sorted(set(spans)))
        at = 0
        for start, length in sorted(set(spans)):
            assert start == at
            at += length
        assert at == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.MAX_LEN


def test_special_strings_are_the_librarys(file, reference):
    """Special tokens' strings, whole, broken and in other cases, among other text."""
    rnd = random.Random(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", "end", "Start.", "é", " ", "\n", "\t", "don't", "42", "...", "İ"]
    texts = ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|>b", "A<|ENDOFTEXT|>b"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(1_500)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in packing.WordEncoder(file).encode(texts)]
    assert got == [reference(t)[:-1] for t in texts]
    assert any(49407 in ids for ids in got)


def test_query_against_the_library(spark, small, documents, reference):
    rows = QUERIES["op1_packing"](spark, small).collect()
    check(rows, {i: reference(t) for i, t in zip(documents.doc_id, documents.text)})
    full = sum(r.length for r in rows)
    used = len({r.sequence_id for r in rows}) * packing.MAX_LEN
    assert full / used > 0.98


def test_edge_rows(edge, file, reference):
    rows = packing.pack_documents(edge, file).collect()
    check(rows, {r[0]: reference(r[1]) for r in edge_rows()})
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert any(r.doc_id == 9_007_199_254_740_993 for r in rows)


def test_empty(empty, file):
    assert packing.pack_documents(empty, file).collect() == []


def test_groups_are_independent_and_small_groups_work(edge, file, reference):
    rows = packing.pack_documents(edge, file, group_pieces=4).collect()
    check(rows, {r[0]: reference(r[1]) for r in edge_rows()})


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_decreasing_is_the_plain_one(seed):
    sizes = np.sort(np.random.default_rng(seed).integers(1, 50, 300))[::-1]
    bins, offsets = packing.first_fit_decreasing(sizes, 49)
    room = []
    for i, s in enumerate(sizes):
        b = next((k for k, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(49)
        assert (bins[i], offsets[i]) == (b, 49 - room[b])
        room[b] -= s


def test_word_encoder_on_odd_texts(file, reference):
    encoder = packing.WordEncoder(file)
    texts = ["a\x1cb  c d\te f's it's", "İ. É, Σ. ı' x.. ...", "don't. we'll!! 12.5 ###", " x y", "the the. The"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text)[:-1]


def test_sequences_hold_the_ids(spark, small, documents, file, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 40")
    placed = packing.pack_documents(docs, file)
    by_id = {i: reference(t) for i, t in zip(documents.doc_id, documents.text)}
    pieces = {(r.sequence_id, r.offset): r for r in placed.collect()}
    for s in packing.sequences(placed, docs, file).collect():
        at = 0
        for doc, n in zip(s.doc_ids, s.lengths):
            r = pieces.pop((s.sequence_id, at))
            assert s.input_ids[at : at + n] == by_id[doc][r.start : r.start + n]
            at += n
        assert at == len(s.input_ids)
    assert not pieces
