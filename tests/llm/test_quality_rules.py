import re
from collections import Counter

from quern.llm import quality_rules as Q
from quern.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def plain(t):
    """The base counts of the contract, word by word."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_counts(frame, odd):
    rows = [*odd, (20, "a a a a"), (21, "x\nx \nx\n\n\nx"), (22, "#*$ %&|<> \x0b\x0c\x85 ok"), (23, "\x00\x1f b")]
    got = Q.fertility(frame(rows), MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        n = plain(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
        assert r.score == "score"  # columns that do not clash stay


def test_fertility_by_library(frame):
    import math

    import sentencepiece

    text = "Ein Test über 中文 und 😀😀 Wörter"
    r = Q.fertility(frame([(1, text)]), MODEL).first()
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [i for w in text.split() for i in m.encode(w)]
    assert r.n_tokens == len(ids) and abs(r.byte_share - sum(map(m.is_byte, ids)) / len(ids)) < 1e-12
    c = Counter(ids).values()
    assert abs(r.token_entropy + sum(x / len(ids) * math.log2(x / len(ids)) for x in c)) < 1e-9


PROSE = "The committee considered several proposals before the meeting ended and asked that every member write down which of them seemed most likely to help people who live near the river, where last spring the water rose higher than anyone could remember and many houses had to be left for some days until roads were open again to all."


def test_verdicts(frame):
    prose = PROSE
    noise = " ".join(chr(0x1F600 + i) for i in range(60))
    junk = " ".join(w + "###" for w in prose.split())
    kept = {r.doc_id: r.kept for r in Q.fertility(frame([(1, prose), (2, noise), (3, junk)]), MODEL).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_empty_table(frame):
    assert Q.fertility(frame([]), MODEL).count() == 0


def test_bands_alone_tell_junk(spark):
    """Of the labelled texts that pass the base rules the bands reject nearly all bad ones and keep nearly all good ones."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    got = [r for r in Q.fertility(docs, MODEL).select("quality", "base_failed", "kept").collect() if not r.base_failed]
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert len(bad) > 20 and sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.98 * len(good)


def test_verdict_by_a_plain_version(frame):
    import base64
    import math
    import random

    import public_tokenizers
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}
    tokens = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(7)
    words = "the river and morning people of window garden letter silver market winter committee proposal quarter nothing between über Straße 中文 данные ### *** $$$ %% | xqzzk 😀".split()
    rows = []
    for i in range(60):
        some = r.sample(words, r.randrange(2, len(words)))
        rows.append((i, " ".join(r.choice(some) + r.choice(["", str(r.randrange(99))]) for _ in range(r.randrange(40, 400)))))
    rows += [(100 + i, " ".join(r.sample(PROSE.split(), 52) + r.choices(words, k=i))) for i in range(0, 60, 4)]
    got = {x.doc_id: x for x in Q.fertility(frame(rows), MODEL).collect()}
    seen = set()
    for i, t in rows:
        w = t.split()
        ids = [x for y in w for x in tokens.encode_ordinary(" " + y)]
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
        p = [x for y in w for x in pieces.encode(y)]
        band, x = Q.BANDS["en"], min(math.log2(len(ids)), 11.5)
        a, b, c = band.curve
        ok = band.chars_per_token[0] <= sum(map(len, w)) / len(ids) <= band.chars_per_token[1] and sum(map(pieces.is_byte, p)) / len(p) <= band.max_byte_share and (len(ids) < band.min_tokens or a + b * x + c * x * x - band.deficit <= entropy <= band.max_entropy)
        assert abs(got[i].multi_entropy - entropy) < 1e-9 and got[i].kept == (ok and not got[i].base_failed)
        seen.add((ok, got[i].base_failed))
    assert len(seen) >= 3
