"""Quality rules by tokeniser fertility.

Public vocabularies encode every distinct word of a batch: one of pieces with byte fallback, one of byte-level
tokens for many languages. Per document the first gives the share of byte-fallback tokens, the second
characters per token and the entropy of its tokens in bits; both sets of measures are returned. Bands for
each language, or else for the script of most letters, reject documents outside them. As entropy grows with the
number of tokens, its band is the distance below what texts of the language reach with so many tokens.

Defined results: null and empty texts have no words and fail the base rule; a text of any length is
read whole; repeated rows are judged alike, and nothing depends on other rows, so there are no ties; an empty
table gives an empty table; columns of the input that clash with the measures are replaced by them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import TextBatch, Vocabulary, alone, combine, kept, repeated, text_slices

#: Bases of the fixed contract: fewer words fail, and so does a larger percentage of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Encodings of distinct words that a worker remembers; name of the vocabulary for many languages.
KNOWN_WORDS, RANKS = 200_000, "byte_bpe_multi_50k.tiktoken"


@dataclass(frozen=True)
class Band:
    """Accepted values: characters per token, byte-fallback share, and token entropy, which for n tokens, l = log2 n, may
    fall short of the curve a + b l + c l^2 by deficit; entropy only binds from min_tokens tokens on."""

    chars_per_token: tuple[float, float]
    max_byte_share: float
    curve: tuple[float, float, float]
    deficit: float
    max_entropy: float = 13.0
    min_tokens: int = 64


#: Bands by language code, then by script, then the one for anything else. Curves are least squares over texts of
#: good quality; the deficits and least characters per token leave out about one in 200 of them.
BANDS: dict[str, Band] = {
    "en": Band((2.07, 6.5), 0.05, (1.206, 0.940, -0.038), 0.29),
    "de": Band((2.15, 6.5), 0.05, (1.780, 0.824, -0.033), 0.25),
    "fr": Band((1.83, 6.5), 0.05, (2.054, 0.768, -0.031), 0.28),
    "es": Band((1.90, 6.5), 0.05, (1.488, 0.878, -0.036), 0.32),
    "latin": Band((1.5, 7.0), 0.10, (1.206, 0.878, -0.036), 0.60),
    "cyrillic": Band((1.0, 7.0), 0.20, (1.206, 0.878, -0.036), 1.20),
    "other": Band((0.25, 7.0), 0.95, (1.206, 0.878, -0.036), 2.50),
}
#: The curves bend down from here on, where they are carried on level.
_LEVEL = 11.5


def _script_table() -> np.ndarray:
    """Script by the first byte of a code point: 1 Latin, 2 Cyrillic, 3 any other letter, 0 none."""
    kind = np.zeros(256, np.uint8)
    kind[65:91] = kind[97:123] = 1
    kind[0xC3:0xCA] = 1
    kind[0xD0:0xD4] = 2
    kind[0xCD:0xD0] = kind[0xD4:0xF0] = 3
    return kind


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
_SCRIPT = _script_table()


@kept
def _pieces(path: str) -> tuple[Vocabulary, np.ndarray]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())], bool)

    def encode(words: list[bytes]) -> list[list[int]]:
        return model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)

    return Vocabulary(encode, KNOWN_WORDS), fallback


@kept
def _tokens(path: str) -> Vocabulary:
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    model = tiktoken.Encoding("tokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(lambda words: [model.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words], KNOWN_WORDS)


def _spread(vocabulary: Vocabulary, hashes: np.ndarray, doc: np.ndarray, n: int, span, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, token entropy in bits and number of marked tokens of each text, from its words."""
    ids, item = vocabulary.expand(vocabulary.rows(hashes, span))
    owner = doc[item]
    tokens = np.bincount(owner, minlength=n)
    special = np.bincount(owner[marked[ids]], minlength=n) if marked is not None else np.zeros(n, np.int64)
    key = np.sort(owner.astype(np.int64) << 20 | ids)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.concatenate((first, [len(key)])))
    logs = np.bincount(key[first] >> 20, weights=count * np.log2(count), minlength=n)
    some = np.maximum(tokens, 1)
    return tokens, np.abs(np.where(tokens > 0, np.log2(some) - logs / some, 0.0)), special


def measure(texts: list[str | None], pieces: Vocabulary, fallback: np.ndarray, tokens: Vocabulary) -> dict[str, np.ndarray]:
    """The base counts and the fertility measures of each text."""
    b = TextBatch(texts)
    start, end, doc = b.words()
    hashes = b.hash_spans(start, end)
    n_words = np.bincount(doc, minlength=b.n)
    in_word = _HEAD[b.bytes] & ~np.isin(b.bytes, (9, 10, 11, 12, 13, 32))
    word_chars = b.per_text(in_word)

    covered = np.zeros(len(doc) + 2, bool)
    if len(doc) >= 3:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        again = whole[repeated(doc[whole], combine(hashes, 3)[whole])]
        for i in range(3):
            covered[again + i] = True
    n_repeat = np.bincount(doc[covered[: len(doc)]], minlength=b.n)

    ls, le, ld = b.lines()
    worded = np.zeros(len(ls), bool)
    worded[np.searchsorted(ls, start, "right") - 1] = True
    ls, le, ld = ls[worded], le[worded], ld[worded]
    lh = b.hash_spans(ls, le)
    order = np.lexsort((lh, ld))
    same = (ld[order][1:] == ld[order][:-1]) & (lh[order][1:] == lh[order][:-1])
    n_dup = np.bincount(ld[order][1:][same], minlength=b.n)

    span = lambda i: b.span_bytes(int(start[i]), int(end[i]))
    n_pieces, piece_entropy, bytes_ = _spread(pieces, hashes, doc, b.n, span, fallback)
    n_multi, entropy, _ = _spread(tokens, hashes, doc, b.n, span)

    kinds = np.stack([b.per_text(_SCRIPT[b.bytes] == k) for k in (1, 2, 3)])
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": b.per_text(_SYMBOL[b.bytes]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "n_tokens": n_pieces, "chars_per_token": word_chars / np.maximum(n_pieces, 1), "byte_share": bytes_ / np.maximum(n_pieces, 1), "token_entropy": piece_entropy,
        "n_multi": n_multi, "multi_chars_per_token": word_chars / np.maximum(n_multi, 1), "multi_entropy": entropy,
        "script": np.array(["latin", "cyrillic", "other"])[kinds.argmax(0)],
    }


_TYPES = {**dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_multi"), "long"), **dict.fromkeys(("chars_per_token", "byte_share", "token_entropy", "multi_chars_per_token", "multi_entropy"), "double"), "script": "string"}


def fertility(docs: DataFrame, model_path: str, text: str = "text", bands: dict[str, Band] | None = None, ranks_path: str | None = None) -> DataFrame:
    """docs with the measures, base_failed and kept; no shuffle. ranks_path: the byte-level vocabulary for many
    languages, or else the file RANKS beside the other.

    The band is that of the column lang where docs has one and the code is known, else the script's.
    """
    bands = bands or BANDS
    ranks_path = ranks_path or os.path.join(os.path.dirname(model_path), RANKS)
    new = [*_TYPES, "base_failed", "kept"]
    plain = docs.drop(*new)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), *(f"{k} {v}" for k, v in _TYPES.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_pieces, _tokens)
        (pieces, fallback), tokens = _pieces(model_path), _tokens(ranks_path)
        for batch in batches:
            for lo, texts in text_slices(batch.column(batch.schema.get_field_index(text))):
                got = measure(texts, pieces, fallback, tokens)
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[k]) for k in _TYPES)], names=[*part.schema.names, *_TYPES])

    found = plain.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))

    def inside(band: Band):
        x = F.least(F.log2(F.greatest("n_multi", F.lit(1))), F.lit(_LEVEL))
        a, b, c = band.curve
        entropy = (F.col("multi_entropy").between(a + b * x + c * x * x - band.deficit, F.lit(band.max_entropy))) | (F.col("n_multi") < band.min_tokens)
        return F.col("multi_chars_per_token").between(*band.chars_per_token) & (F.col("byte_share") <= band.max_byte_share) & entropy

    script = F.when(F.col("script") == "latin", inside(bands["latin"])).when(F.col("script") == "cyrillic", inside(bands["cyrillic"])).otherwise(inside(bands["other"]))
    verdict = script
    if "lang" in plain.columns:
        for code in sorted(k for k in bands if len(k) == 2):
            verdict = F.when(F.col("lang") == code, inside(bands[code])).otherwise(verdict)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)
