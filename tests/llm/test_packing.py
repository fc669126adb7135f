import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing as K
from quern.llm.queries import vocabulary

JSON = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def held_together(rows):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= K.CAPACITY
    return len(places)


def test_pieces(frame, odd, library):
    rows = [*odd, (60, "a <|endoftext|> b"), (61, " the" * 2047), (62, " the" * 2048)]
    got = K.pack(frame(rows), JSON, public_tokenizers.PATTERN).collect()
    held_together(got)
    text = dict((i, t) for i, t in rows if i is not None)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in text.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted({(p.piece, p.start, p.length, p.ids_crc32) for p in by[i]})
        assert sum(p[2] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in pieces)
        assert len(pieces) == 1 or (len(ids) > K.CAPACITY and all(p[2] == K.CAPACITY for p in pieces[1:]))
    assert len(by[5]) == 2 * len({p.piece for p in by[5]}) and len(by[None]) == 2
    assert K.pack(frame([]), JSON, public_tokenizers.PATTERN).count() == 0


def test_tree_merges_underfull_bins(frame):
    r = random.Random(1)
    rows = [(i, " the" * (r.randrange(1, 1500) - 1)) for i in range(160)]
    got = K.pack(frame(rows, partitions=20), JSON, public_tokenizers.PATTERN).collect()
    total = sum(x.length for x in got)
    apart = sum(-(-sum(x.length for x in got if x.sequence_id >> 32 == p) // K.CAPACITY) for p in {x.sequence_id >> 32 for x in got})
    assert held_together(got) <= max(apart, -(-total // K.CAPACITY)) + 6


def test_halves_meet_across_tasks(frame):
    got = K.pack(frame([(i, " the" * 600) for i in range(24)], partitions=24), JSON, public_tokenizers.PATTERN).collect()
    assert held_together(got) == 8  # three to a sequence, though each task had one


def test_added_tokens_of_the_registered_query(spark, tmp_path):
    from quern.llm.queries import op3_packing

    plain = Tokenizer.from_file(JSON)
    r = random.Random(5)
    pool = ["<|endoftext|>", "<|endoftext|", "a", " ", "  ", "\n", "'s", "é", "1", ">"]
    rows = [(0, "a <|endoftext|> b"), (1, "<|endoftext|>"), *((i, "".join(r.choice(pool) for _ in range(r.randrange(12)))) for i in range(2, 400))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {p.doc_id: p for p in op3_packing(spark, str(tmp_path)).collect()}
    assert plain.encode(rows[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, t in rows:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), t


def test_groups_of_the_tree_are_bounded(frame, monkeypatch):
    """Many tasks with many underfull bins each: no node sees more than FAN_IN squared, and little room is lost."""
    import pandas as pd

    inner, most = K._level, K.FAN_IN**2

    def level(capacity):
        run = inner(capacity)

        def counted(group: pd.DataFrame) -> pd.DataFrame:
            assert len(group) <= most
            return run(group)

        return counted

    monkeypatch.setattr(K, "_level", level)
    r = random.Random(3)
    rows = [(i, " the" * r.choice([r.randrange(1100, 1900), r.randrange(20, 600)])) for i in range(900)]
    got = K.pack(frame(rows, partitions=70), JSON, public_tokenizers.PATTERN).collect()
    assert len(got) == 900
    apart = len({x.sequence_id for x in got})
    assert held_together(got) == apart
    half = sum(sum(x.length for x in got if x.sequence_id == s) <= K.CAPACITY // 2 for s in {x.sequence_id for x in got})
    assert half <= 1


def test_sequences_against_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    got = K.pack(docs, JSON, public_tokenizers.PATTERN, added=True).collect()
    assert held_together(got) <= 1.002 * sum(x.length for x in got) / K.CAPACITY
