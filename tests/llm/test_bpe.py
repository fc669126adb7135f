import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quern.llm import bpe
from quern.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tables():
    m = bpe.merges(PATH)
    return m, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.ranks, special_tokens={})


def encoded(m, texts):
    slot, doc = m.slots(texts)
    ids, item = m.words.expand(slot)
    owner = doc[item]
    return [ids[owner == i].tolist() for i in range(len(texts))]


def test_equals_library(tables):
    m, lib = tables
    r = random.Random(3)
    pool = ["'", "'s", "'re", "'ll", "'ve", " ", "  ", "\n", "\t", "a", "Z", "é", "'t", "x'd", "1", "²", "中", "\xa0", "!", "-", "😀", "́", "'S", "l", "e", "r", "<|endoftext|>"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(16))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x250), r.randrange(0x3000), r.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(600)]
    texts += ["a" * 511, "the" * 170, "中文" * 80, "thererere" * 300, "x" * 4000, ""]
    for lo in range(0, len(texts), 400):
        assert encoded(m, texts[lo : lo + 400]) == [lib.encode_ordinary(t) for t in texts[lo : lo + 400]]


def test_vocabulary_is_bounded(tables):
    _, lib = tables
    m = bpe.Merges(PATH)
    m.words.most = 50
    texts = [f"word{i} other{i * 7} the and" for i in range(200)]
    for lo in range(0, 200, 10):
        assert encoded(m, texts[lo : lo + 10]) == [lib.encode_ordinary(t) for t in texts[lo : lo + 10]]
        assert len(m.words.hashes) <= 80


def test_forms_follow_a_vocabulary_that_starts_anew(tables):
    _, lib = tables
    m = bpe.Merges(PATH)
    m.words.most = 50
    for texts in (["first words here"], [" ".join(f"w{i}x{i * 7}" for i in range(60))], ["some second words"], ["third text", "é 中文"], [" ".join(f"{i}a" for i in range(90))]):
        slot, doc = m.slots(texts)
        for i, t in enumerate(texts):
            mine = slot[doc == i].tolist()
            assert b"".join(m.plain[j] for j in mine).decode() == t
            assert b" ".join(m.text[j] for j in mine).decode() == " ".join(map(str, lib.encode_ordinary(t)))


def test_round_trip_and_columns(frame, odd, tables):
    _, lib = tables
    docs = frame(odd)
    want = sorted((repr(i), len(ids := lib.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd)
    got = bpe.round_trip(docs, PATH).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.ids == lib.encode_ordinary(r.text or "") and r.score == "score" for r in back)
    assert bpe.round_trip(frame([]), PATH).count() == 0


def test_a_clash_of_hashes_is_noticed(tables, monkeypatch):
    """With hashes of four bits words take each other's encodings, and such texts are encoded again."""
    _, lib = tables
    m, inner = bpe.Merges(PATH), bpe.TextBatch.hash_spans
    monkeypatch.setattr(bpe.TextBatch, "hash_spans", lambda self, s, e: inner(self, s, e) & np.uint64(15))
    texts = ["the river bends away from old mills", "a second text, with other words in it 123", "", "third: words é"]
    counts, shown, decoded = m.round_trip(texts)
    assert [x.decode() for x in decoded] == texts
    assert [x.decode() for x in shown] == [" ".join(map(str, lib.encode_ordinary(t))) for t in texts] and counts.tolist() == [len(lib.encode_ordinary(t)) for t in texts]


def test_documents_of_many_decoding_queries(tables, monkeypatch):
    monkeypatch.setattr(bpe, "_DECODE_ROWS", 5)
    texts = ["the river bends away from old mills again and again", "", "a", "one two three four five six"]
    assert [x.decode() for x in tables[0].round_trip(texts)[2]] == texts
