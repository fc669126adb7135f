"""Byte-level BPE in DuckDB recursive queries, one connection per task.

A batch of texts is cut into pretokens by character classes; its distinct new pretokens become rows
(word, position, token). A recursive query joins neighbouring rows with the merge table, takes each word's
leftmost pair of least rank, contracts it, and stops when no word has a pair left; only words that still changed
have rows in a round, and each word's last round is its encoding. Documents are put together from their
pretokens by position; an ordered aggregation over the token rows of whole documents decodes them again.

The cutting follows the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` of byte-level vocabularies.

Defined results: null and empty texts have no ids; there are no special tokens, so their strings are
ordinary text; pretokens of more than LONG bytes, for which a contraction a round would take quadratic work,
are contracted in the same order from a heap; repeated rows are encoded alike; pairs that tie in rank go from the
left; an empty table gives an empty table; columns of the input named as a result (ids, decoded) are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import TextBatch, Vocabulary, alone, kept, slices

#: Bytes of the longest pretoken that the recursive query contracts.
LONG = 512
#: Token rows that one query may produce over all its rounds, and that one may decode.
_QUERY_ROWS, _DECODE_ROWS = 3_000_000, 500_000
_POSITIONS = (1 << 30) - 1

# A row's code is its token's length and id: length << 16 | id. A pair's order x is
# rank << 46 | position << 16 | left length << 8 | new length.
_CONTRACT = f"""
WITH RECURSIVE tokens(round, word, pos, code) AS (
  SELECT 0, word, pos, code FROM letters
  UNION ALL
  (WITH best AS (
     SELECT l.word, min(m.x + (l.pos << 16)) AS x
     FROM tokens l JOIN tokens r ON r.pos = l.pos + (l.code >> 16)
     JOIN merges m ON m.pair = (l.code << 24) + r.code
     GROUP BY l.word)
   SELECT t.round + 1, t.word, t.pos, CASE WHEN t.pos = (x >> 16) & {_POSITIONS} THEN ((x & 255) << 16) + (x >> 46) ELSE t.code END
   FROM tokens t JOIN best USING (word)
   WHERE t.pos <> ((x >> 16) & {_POSITIONS}) + ((x >> 8) & 255)))
, last AS (SELECT word, max(round) AS round FROM tokens GROUP BY word)
SELECT word, code & 65535 AS id FROM tokens JOIN last USING (word, round) ORDER BY word, pos
"""
_DECODE = "SELECT word, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocab USING (id) GROUP BY word ORDER BY word"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: 1 letter, 2 number, 3 white space, 0 other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m[0]]] = kind
    return out


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, TextBatch]:
    """Start and end byte in the batch, and text index, of every pretoken in order."""
    b = TextBatch(texts)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, b
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    head = np.zeros(n + 1, bool)
    head[(np.cumsum(size) - size)[size > 0]] = True
    head[n] = True
    kind = classes()[cp]
    run = head.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    starts = run.copy()
    # white space: what stands before a word goes with it if it is a blank, and is a token of its own if not
    edge = np.flatnonzero(run)
    first, end = edge[:-1], edge[1:]
    gap = (kind[first] == 3) & ~head[end]
    first, end = first[gap], end[gap]
    blank = cp[end - 1] == 32
    starts[end - 1] = True
    starts[end[blank]] = False
    # contractions: an apostrophe alone between a start and letters
    at = np.flatnonzero((cp[:-2] == 39) & starts[: n - 2] & run[: n - 2] & run[1 : n - 1] & ~head[1 : n - 1]) if n > 2 else np.empty(0, np.int64)
    if n > 1 and cp[n - 2] == 39 and starts[n - 2] and run[n - 1] and not head[n - 1]:
        at = np.append(at, n - 2)
    one = cp[at + 1]
    two = np.where(at + 2 < n, cp[np.minimum(at + 2, n - 1)], 0)
    two = np.where(run[np.minimum(at + 2, n)], 0, two)
    pairs = np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(pairs, 3, 0))
    at, length = at[length > 0], length[length > 0]
    starts[at + 1] = False
    after = at + length
    inside = after < n
    after = after[inside]
    starts[after[~run[after]]] = True
    place = np.flatnonzero(starts)
    offset = np.concatenate(([0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), dtype=np.int64)))
    doc = np.searchsorted(np.cumsum(size), place[:-1], "right")
    return offset[place[:-1]] + doc + 1, offset[place[1:]] + doc + 1, doc, b


class Merges:
    """The merge table of a rank file in DuckDB, and the queries over it."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        code = lambda t: len(t) << 16 | self.ranks[t]
        pairs, order = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = token[:i], token[i:]
                if left in self.ranks and right in self.ranks:
                    pairs.append(code(left) << 24 | code(right))
                    order.append(rank << 46 | i << 8 | len(token))
        self.letter = np.array([code(bytes([i])) for i in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("given", pa.table({"pair": pa.array(pairs, pa.int64()), "x": pa.array(order, pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.words = Vocabulary(self.encode, 600_000)
        self.text: list[bytes] = []
        self.generation = self.words.generation

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word number and id of every token, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        self.db.register("letters", pa.table({"word": word, "pos": np.arange(len(data)) + word, "code": self.letter[data]}))
        got = self.db.sql(_CONTRACT).to_arrow_table()
        return got.column(0).to_numpy(), got.column(1).to_numpy()

    def by_heap(self, word: bytes) -> list[int]:
        """The same contractions for one long word: leftmost pair of least rank first."""
        n = len(word)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop or not alive[j]:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := self.ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := self.ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))) - set(short):
            out[i] = self.by_heap(words[i])
        for lo, hi in slices([len(words[i]) ** 2 // 2 + 8 for i in short], _QUERY_ROWS):
            word, ids = self.contract([words[i] for i in short[lo:hi]])
            cut = np.searchsorted(word, np.arange(1, hi - lo))
            for i, part in zip(short[lo:hi], np.split(ids, cut), strict=True):
                out[i] = part.tolist()
        return out

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation."""
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        if not size.sum():
            return [b""] * len(lists)
        word = np.repeat(np.arange(len(lists)), size)
        self.db.register("ids", pa.table({"word": word, "pos": np.arange(len(word)), "id": np.concatenate(lists).astype(np.int64)}))
        got = self.db.sql(_DECODE).to_arrow_table()
        out = [b""] * len(lists)
        for w, h in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            out[w] = bytes.fromhex(h)
        return out

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary slot of every pretoken, and its text; decimal forms follow the slots."""
        start, end, doc, b = pretokens(texts)
        slot = self.words.rows(b.hash_spans(start, end), lambda i: b.span_bytes(int(start[i]), int(end[i])))
        bounds, ids = self.words.bounds, self.words.ids
        if self.generation != self.words.generation:
            self.text, self.generation = [], self.words.generation
        fresh = [ids[bounds[i] : bounds[i + 1]] for i in range(len(self.text), len(bounds) - 1)]
        for lo in range(0, len(fresh), 100_000):
            self.text += [b" ".join(b"%d" % x for x in y.tolist()) for y in fresh[lo : lo + 100_000]]
        return slot, doc


    @property
    def plain(self) -> list[bytes]:
        """Decoded bytes of every slot."""
        bounds = self.words.bounds
        return self.decode([self.words.ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    def round_trip(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Number of ids, decimal ids joined by a blank, and the bytes that the ids decode to, of each text.

        A text whose decoded bytes are not its own, which takes two pretokens of equal 64-bit hashes, is encoded again
        pretoken by pretoken.
        """
        slot, doc = self.slots(texts)
        ids, _ = self.words.expand(slot)
        counts = np.bincount(doc, weights=self.words.sizes()[slot], minlength=len(texts)).astype(np.int64)
        end = np.cumsum(counts)
        # pieces of documents: a bounded number of tokens in each query
        pieces = [(i, at, min(at + _DECODE_ROWS, int(end[i]))) for i in range(len(texts)) for at in range(int(end[i] - counts[i]), int(end[i]), _DECODE_ROWS)]
        plain: list[list[bytes]] = [[] for _ in texts]
        for x, y in slices([b - a for _, a, b in pieces], _DECODE_ROWS):
            for (i, _, _), raw in zip(pieces[x:y], self.decode([ids[a:b] for _, a, b in pieces[x:y]]), strict=True):
                plain[i].append(raw)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        listed = slot.tolist()
        shown = [b" ".join([self.text[j] for j in listed[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        decoded = [b"".join(x) for x in plain]
        for i, t in enumerate(texts):
            if decoded[i] != t.encode("utf-8", "surrogatepass"):
                start, stop, _, b = pretokens([t])
                again = [x for y in self.encode([b.span_bytes(int(u), int(v)) for u, v in zip(start, stop, strict=True)]) for x in y]
                counts[i], shown[i], decoded[i] = len(again), b" ".join(b"%d" % x for x in again), b"".join(self.decode([np.array(again)]))
        return counts, shown, decoded


@kept
def merges(path: str) -> Merges:
    return Merges(path)


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) of the text; no shuffle."""
    plain = docs.drop("ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(merges)
        m = merges(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for lo, hi in slices([len(t) + 64 for t in texts]):
                slot, doc = m.slots(texts[lo:hi])
                ids, item = m.words.expand(slot)
                ends = np.cumsum(np.bincount(doc[item], minlength=hi - lo)) if len(item) else np.zeros(hi - lo, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, lists], names=[*batch.schema.names, "ids"])

    return plain.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded (binary): the bytes of each array of ids."""
    plain = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(ranks_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            sizes = [len(x) if x.is_valid else 0 for x in lists]
            for lo, hi in slices(sizes, 1 << 19):
                part = [np.asarray(x.values) if x.is_valid else np.empty(0, np.int64) for x in lists.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(m.decode(part), pa.binary())], names=[*batch.schema.names, "decoded"])

    return plain.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(merges)
        m = merges(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices([len(t) + 64 for t in texts]):
                counts, shown, decoded = m.round_trip(texts[lo:hi])
                sha = lambda items: pa.array([hashlib.sha256(x).hexdigest() for x in items])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), sha(shown), sha(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
