"""Best-fit packing by hierarchical residuals.

Every task tokenises its documents, cuts the long ones and packs the pieces best-fit, largest first, a
bounded window at a time; nearly full bins leave at once, the others stay open until the task ends. The
underfull bins then climb a tree: at each level the bins of FAN_IN neighbours meet as items of their
fill and are packed best-fit again, until the root. Two bins over half full never fit together, and a
node leaves at most one bin of half or less (best-fit would have joined two), so its neighbours bring
FAN_IN - 1 of these at most, and it sends that one and its FAN_IN - 1 emptiest others; the rest leave the tree.
No group of any level has more than FAN_IN squared rows, however many tasks and documents there are.

With added the file's added tokens, where a text holds them, are their ids, as in the library's encode; else
they are spelled out, as in the library with encode_special_tokens.

Defined results: null and empty texts are the end id alone; a text of any length is cut into full pieces
of which the first may be shorter; repeated rows are packed one by one; pieces of equal length are packed in
the order of the rows, bins of equal fill by their numbers; an empty table gives no pieces; other columns of the
input than key and text are not read, so that none can clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.arrays import alone, kept
from quern.llm.common import checkpointed, written

CAPACITY, END_ID = 2048, 0
#: Bins with less room than this leave at once; pieces that a task packs together; tasks that meet in a node.
NEARLY, WINDOW, FAN_IN = 8, 100_000, 8


class BestFit:
    """Open bins by the room they have; the fullest bin that still takes an item is one bit scan away."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def open(self, bin_: int, room: int) -> None:
        self.by_room[room].append(bin_)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (bin, its room) with the least sufficient room."""
        fits = self.mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        return bin_, room


@kept
def encoder(vocabulary_json: str, pattern: str):
    """The byte-level BPE of a tokenizers JSON file and its added tokens, run by tiktoken, which gives the same ids faster."""
    import tiktoken

    with open(vocabulary_json, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec["added_tokens"]:
        if any(t[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {t['content']!r} has flags that are not supported")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one if they fit, else full ones after a first that may be shorter."""
    first = len(ids) % capacity or capacity
    if len(ids) <= capacity:
        return [(0, len(ids))]
    return [(0, first), *((s, capacity) for s in range(first, len(ids), capacity))]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _local(vocabulary_json: str, pattern: str, capacity: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(encoder)
        enc = encoder(vocabulary_json, pattern)
        to_array, allowed = getattr(enc, "encode_to_numpy", enc.encode), "all" if added else set()
        base, made = TaskContext.get().partitionId() << 32, 0
        bins: dict[int, list[tuple]] = {}
        fit = BestFit(capacity)

        def rows(done: list[int]) -> pa.RecordBatch:
            out: list[tuple] = []
            for b in done:
                at, fill = 0, sum(p[3] for p in bins[b])
                for p in bins.pop(b):
                    out.append((*p, base + b, at, fill))
                    at += p[3]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 8, _PIECES, strict=True)], schema=_PIECES)

        def pack(pieces: list[tuple]) -> list[int]:
            nonlocal made
            full = []
            for p in sorted(pieces, key=lambda p: -p[3]):
                b, room = fit.take(p[3]) or (None, capacity)
                if b is None:
                    b, made = made, made + 1
                    bins[b] = []
                bins[b].append(p)
                if room - p[3] < NEARLY:
                    full.append(b)
                else:
                    fit.open(b, room - p[3])
            return full

        waiting: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = to_array(text, allowed_special=allowed, disallowed_special=())
                ids = np.append(np.asarray(ids, "<u4"), np.uint32(END_ID)).astype("<u4")
                for i, (start, length) in enumerate(cut(ids, capacity)):
                    waiting.append((doc_id, i, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            if len(waiting) >= WINDOW:
                yield rows(pack(waiting))
                waiting = []
        yield rows(pack(waiting))
        yield rows(list(bins))

    return run


_TREE_SQL = "node long, bin long, fill long, moved array<struct<bin: long, shift: long>>, up boolean"


def _level(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Bins of a node as items: each goes into the fullest bin that takes it whole. The emptiest climb on."""
        fit, out = BestFit(capacity), []
        for row in group.sort_values(["fill", "bin"], ascending=[False, True]).itertuples(index=False):
            got = fit.take(row.fill)
            if got is None:
                out.append([row.node, row.bin, row.fill, list(row.moved), True])
                fit.open(len(out) - 1, capacity - row.fill)
                continue
            i, room = got
            target, own = out[i], capacity - room
            target[3] = [*target[3], {"bin": row.bin, "shift": own}, *({"bin": m["bin"], "shift": m["shift"] + own} for m in row.moved)]
            target[2] = own + row.fill
            fit.open(i, room - row.fill)
        out.sort(key=lambda r: (r[2], r[1]))
        for i, r in enumerate(out):
            r[4] = i < FAN_IN and r[2] <= capacity - NEARLY
        return pd.DataFrame(out, columns=["node", "bin", "fill", "moved", "up"])

    return run


def pack(docs: DataFrame, vocabulary_json: str, pattern: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of each piece."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = checkpointed(rows.mapInArrow(_local(vocabulary_json, pattern, capacity, added), _PIECES_SQL))
    under = pieces.where((F.col("offset") == 0) & (F.col("fill") <= capacity - NEARLY))
    top = under.agg(F.max(F.shiftright("bin", 32))).first()[0]
    place = F.row_number().over(Window.partitionBy("node").orderBy("fill", "bin"))
    ranked = under.select(F.shiftright("bin", 32).alias("node"), "bin", "fill").withColumn("place", place).where(F.col("place") <= FAN_IN)
    climbing = ranked.select("node", "bin", "fill", F.array().cast("array<struct<bin: long, shift: long>>").alias("moved"))
    settled = []
    while top:  # node numbers from 0 to top
        top //= FAN_IN
        met = checkpointed(climbing.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("node").applyInPandas(_level(capacity), _TREE_SQL))
        settled.append(met.where(~F.col("up") if top else F.lit(True)).where(F.size("moved") > 0).select(F.col("bin").alias("target"), F.inline("moved")))
        climbing = met.where("up").drop("up")
    if not settled:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    # written, so that Spark knows the size when it plans the join: a bin of every task at most has moved
    moved = written(reduce(DataFrame.union, settled).select("target", "bin", "shift"))
    out = pieces.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("target", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))
