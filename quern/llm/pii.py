"""Information-theoretic sanitisation.

Patterns find entities (e-mail, IP address, card, phone). Removing them is not enough when words beside them
still tell which one it was, so corpus co-occurrence estimates what each word discloses:
PMI(entity; term) = ln(n(e, t) * N / (n(e) * n(t))) over documents, where n(e, t) counts documents with the
term within a window of the entity. Its share of the entity's information ln(N / n(e)) is the disclosure;
terms beyond one threshold are generalised to their class, beyond a higher one removed, in every document
that holds the entity, wherever they stand in it: the window is for the estimate alone. A second pass over the
texts with entities finds the places; a bitmap of fixed size keeps most terms that disclose nothing out of it.

Terms are runs of MIN_TERM bytes or more of ASCII letters and digits or of characters beyond ASCII, A-Z in lower
case. A pair must be seen in SUPPORT documents: from one alone nothing tells chance from disclosure. Positions are
code points, ends exclusive.

Defined results: null and empty texts have no spans; texts of any length are read whole; rows that repeat id
and text get the same spans and count as one document each; a term needs two documents of support; an
entity in all documents has no information and nothing discloses it; a term that discloses several entities of a
document is removed if one of them asks for it; spans that start together are ordered by kind; an empty table gives
an empty table. Columns of the input other than key and text are not read by detect and stay as they are in sanitise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import TextBatch, alone, slices
from quern.llm.common import checkpointed, free, row_hash, written

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
#: Words on either side of an entity; documents a term and an entity must share; thresholds of disclosure.
REACH, SUPPORT, GENERALISE, REMOVE = 10, 2, 0.75, 0.9
#: Bytes of the shortest term: shorter ones, mostly particles and single letters, are never candidates.
MIN_TERM = 3
#: Bits of the filter of disclosing terms, by the low bits of their hashes.
FILTER_BITS = 1 << 25

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run is tried at its start only, since all its starts fail or match alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run of local characters before it, and the domain after."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all entities, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def entity_key(kind: int, value: str) -> int:
    """A 64-bit hash of the entity: e-mail without regard to case, numbers by their digits."""
    plain = value.lower() if kind < 2 else "".join(c for c in value if c.isdigit())
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text index and hash of each term of a lower-cased batch, in bytes."""
    start, end = b._spans(~_TERM[b.bytes])
    long_enough = end - start >= MIN_TERM
    start, end = start[long_enough], end[long_enough]
    return start, end, np.searchsorted(b.start, start, "right") - 1, b.hash_spans(start, end).view(np.int64)


def text_form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = "array<struct<start: int, kind: int, end: int>>"
_FOUND = f"doc_id long, _a long, _b long, _row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {_SPAN}, entities array<long>, pairs array<struct<e: long, t: long>>, text string"


def _free_terms(texts: list[str], base: list[list[tuple[int, int, int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and hash of the terms of each text that touch none of its spans (start, kind, end), in code points."""
    b = TextBatch(texts, lower=True)
    heads = np.concatenate(([0], np.cumsum((b.bytes & 0xC0) != 0x80)))
    first, last, doc, hashes = terms(b)
    bounds = np.searchsorted(doc, np.arange(b.n + 1))
    for i, spans in enumerate(base):
        lo, hi = bounds[i], bounds[i + 1]
        start, end = heads[first[lo:hi]] - heads[b.start[i]], heads[last[lo:hi]] - heads[b.start[i]]
        merged: list[list[int]] = []
        for s, _, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        m = np.array(merged)
        after = np.searchsorted(m[:, 0], end, "left") - 1
        free = (after < 0) | (m[np.maximum(after, 0), 1] <= start)
        yield start[free], end[free], hashes[lo:hi][free]


def _context(start: np.ndarray, end: np.ndarray, h: np.ndarray, spans, keys: list[int]) -> list[tuple[int, int]]:
    """(entity, term) pairs of a text by the window around each entity."""
    pairs = set()
    for (s, _, e), key in zip(spans, keys, strict=True):
        left, right = np.searchsorted(end, s, "right"), np.searchsorted(start, e, "left")
        near = np.concatenate((h[max(0, left - REACH) : left], h[right : right + REACH]))
        pairs.update((key, t) for t in near.tolist())
    return sorted(pairs)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    alone()
    row = TaskContext.get().partitionId() << 40
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    pair = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64())]))
    for batch in batches:
        all_texts = batch.column(1).to_pylist()
        for lo, hi in slices([len(t or "") + 64 for t in all_texts]):
            texts = [t or "" for t in all_texts[lo:hi]]
            base = [base_spans(t) for t in texts]
            keys: list[list[int]] = [[entity_key(k, t[s:e]) for s, k, e in spans] if spans else [] for t, spans in zip(texts, base, strict=True)]
            pairs: list[list] = [[] for _ in texts]
            private = [i for i, s in enumerate(base) if s]
            if private:
                for i, found in zip(private, _free_terms([texts[i] for i in private], [base[i] for i in private]), strict=True):
                    pairs[i] = _context(*found, base[i], keys[i])
            counts = [[sum(k == kind for _, k, _ in spans) if spans else 0 for spans in base] for kind in range(4)]
            digests = [hashlib.sha256(text_form(s).encode()).hexdigest() for s in base]
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            as_struct = lambda names, data: [[dict(zip(names, x, strict=True)) for x in y] for y in data]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(lo, hi - lo) for c in (0, 2, 3)), pa.array(rows), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests),
                    pa.array(as_struct(("start", "kind", "end"), base), span), pa.array([sorted(set(k)) for k in keys], pa.list_(pa.int64())),
                    pa.array(as_struct(("e", "t"), pairs), pair), pa.array([t if s else None for t, s in zip(texts, base, strict=True)], pa.string()),
                ],
                names=["doc_id", "_a", "_b", "_row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "pairs", "text"],
            )


def _places(found: DataFrame, disclosing: DataFrame) -> DataFrame:
    """_row, t, start, end: all places of terms in texts with entities, of disclosing terms and by chance of others
    that share the bits of their hashes."""
    low = F.col("t").bitwiseAND(FILTER_BITS - 1)
    words = disclosing.select(F.shiftright(low, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(t & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toPandas()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = found.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, all_texts, spans = (c.to_pylist() for c in batch.columns)
            for lo, hi in slices([len(t) + 64 for t in all_texts]):
                base = [[(s["start"], s["kind"], s["end"]) for s in x] for x in spans[lo:hi]]
                for row, (start, end, h) in zip(rows[lo:hi], _free_terms(all_texts[lo:hi], base), strict=True):
                    bit = h.view(np.uint64) & np.uint64(FILTER_BITS - 1)
                    hit = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), row)), pa.array(h[hit]), pa.array(start[hit].astype(np.int32)), pa.array(end[hit].astype(np.int32))], names=["_row", "t", "start", "end"])

    return found.where("text is not null").select("_row", "text", "base").mapInArrow(run, "_row long, t long, start int, end int")


def term_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, df): in how many rows of docs each term occurs; combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            h, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            uniq, inverse = np.unique(h, return_inverse=True)
            return uniq, np.bincount(inverse, weights=c).astype(np.int64)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                _, _, doc, h = terms(TextBatch(texts[lo:hi], lower=True))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                uniq, count = np.unique(h[once], return_counts=True)
                held.append((uniq, count))
                waiting += len(uniq)
                if waiting > 4_000_000:
                    held = [combined()]
                    waiting = len(held[0][0])
                    if waiting > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["t", "c"])
                        held, waiting = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in combined()], names=["t", "c"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "t long, c long")
    return counts.groupBy("t").agg(F.sum("c").alias("df"))


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, _a, _b (hashes of id and text), counts, base_sha256 and spans
    (array of start, kind, end): base spans, and those of disclosing terms."""
    a, b = row_hash(key, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), a.alias("_a"), b.alias("_b"))
    found = written(rows.mapInArrow(_detect, _FOUND))
    total = found.count()
    each = found.select("_row", F.explode("pairs").alias("p")).select("_row", "p.e", "p.t")
    shared = each.groupBy("e", "t").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    entity = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("ne")).where(F.col("ne") >= SUPPORT)
    information = F.log(F.lit(float(max(total, 1))) / F.col("ne"))
    pmi = F.log(F.col("n") * float(max(total, 1)) / (F.col("ne") * F.col("df")))
    judged = shared.join(entity, "e").join(term_frequencies(rows), "t").where(F.col("ne") < total).withColumn("share", pmi / information)
    disclosing = checkpointed(judged.where(F.col("share") >= GENERALISE).select("e", "t", F.when(F.col("share") >= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("generalised")).alias("kind")))
    # by the term first: a term discloses few entities, but an entity in many rows may have as many terms
    holds = found.select("_row", F.explode("entities").alias("e"))
    near = _places(found, disclosing).join(disclosing, "t").join(holds, ["_row", "e"], "left_semi")
    place = near.groupBy("_row", "start", "end").agg(F.max("kind").alias("kind"))
    more = place.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    joined = found.drop("entities", "pairs", "text").join(more, "_row", "left")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))).drop("more", "base", "_row")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, and all spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    form = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(form, ",").alias("spans"))


def replacement(kind: int, value: str) -> str:
    if KINDS[kind] == "removed":
        return ""
    if KINDS[kind] == "generalised":
        return "[NUMBER]" if value.isdigit() else "[WORD]"
    return f"[{KINDS[kind].upper()}]"


def _rewrite(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(0).to_pylist()
            spans = batch.column(1)
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                text, parts, at = out[i] or "", [], 0
                for s in spans[int(i)].as_py():
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], replacement(s["kind"], text[s["start"] : s["end"]])]
                    at = max(at, s["end"])
                out[i] = "".join([*parts, text[at:]])
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.string())], names=[*batch.schema.names[2:], name])

    return run


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with every span of the text replaced by its kind, generalised or removed."""
    k, a, b, spans, old, new = free(docs, "_k", "_a", "_b", "_spans", "_old", "_new")
    found = detect(docs, text, key).where(F.size("spans") > 0).groupBy("doc_id", "_a", "_b").agg(F.first("spans")).toDF(k, a, b, spans)
    first, second = row_hash(key, text)
    keyed = docs.withColumns({a: first, b: second})
    same = keyed[key].eqNullSafe(found[k]) & (keyed[a] == found[a]) & (keyed[b] == found[b])
    joined = keyed.join(found, same, "left").select(keyed[text].alias(old), spans, *(keyed[c] for c in docs.columns if c != text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), f"`{new}` string"])
    return joined.mapInArrow(_rewrite(new), schema).withColumnRenamed(new, text).select(*docs.columns)
