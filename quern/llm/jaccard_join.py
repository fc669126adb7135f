"""N-gram Jaccard self-join by vertical partitioning.

Texts become sets of five-word shingles; two texts link when 100 * |A & B| >= 75 * |A | B|. The steps:

1. Tasks send each distinct set's shingles once, in batches, to fragments of the shingle hash space. A
   fragment counts how many entries each shingle has and answers the batches of those that have several; what
   a set's own copies in other tasks add to the counts is known by its id and taken off, so that shingles of
   a single distinct set only count towards set sizes from then on.
2. Frequency octave, then hash, is the global n-gram order. Each set keeps its shared shingles in it; a
   set whose shared shingles are too few for any link is done.
3. The rarest shingles of the others, so many that linked sets share one, propose candidates. Under each
   shingle the set with the fewest shingles of its own is the hub: every set is first held against the hub
   with which it shares most. Then sets that share a shingle and still lie in different components are
   compared in blocks of bounded size by size, position and a parity sketch of their shared shingles; only
   pairs that can still link leave a block.
4. Overlaps are counted vertically: the global order is cut at pivots, each fragment of a candidate pair is
   intersected by itself, and the partial overlaps are summed per pair.

Links inside a component that is already known are not tested again, so a group of n near copies takes
about n tests, not n squared, and no link between components is lost.

Defined results: null and empty texts, and texts without words, have empty sets and stand alone; texts of
fewer than five words have their whole word sequence as the only shingle; equal sets, repeated rows among
them, form one class; null ids get the smallest id of their component, or null; an empty table gives an
empty table; ties between hubs go by the set id and never change the components; columns of the input other
than key and text are not read. Set ids and shingles are 64-bit hashes, compared in full.

A task that is run again must make the same batches: docs should come from files, not straight from a shuffle
whose rows may change places. Entries of a batch that was made otherwise are noticed and raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import TextBatch, alone, combine, mix, slices
from quern.llm.common import checkpointed, free, row_hash, shuffle_partitions, written

WORDS = 5
#: Similarity threshold in percent.
PERCENT = 75
#: Fragments per shuffle partition while counting, at most so many in all, and vertical fragments while intersecting.
SPREAD, MOST_FRAGMENTS, VERTICAL = 8, 1 << 16, 4
#: Shingles, sets and remembered set ids that a task holds at most before it sends a batch or forgets.
TOGETHER, SETS, REMEMBERED = 1_000_000, 60_000, 500_000
#: Sets of a shingle that meet in one block, and bits of a set's parity sketch.
BLOCK, SKETCH = 2048, 1024
_DOC, _PACK, _SETS = 0, 1, 2
_OTHERWISE = "a batch was made again with other sets: write docs to files first"


def shingle_sets(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, distinct shingle hash) by text and hash, and the set size of each text."""
    b = TextBatch(texts, lower=True)
    start, end, doc = b.words()
    words = b.hash_spans(start, end)
    found, owner = [], []
    if len(doc) >= k:
        at = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1])
        found.append(combine(words, k)[at])
        owner.append(doc[at])
    count = np.bincount(doc, minlength=b.n)
    first = np.cumsum(count) - count
    for few in range(1, k):
        at = first[count == few]
        if len(at):
            found.append(combine(words, few)[at])
            owner.append(doc[at])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(b.n, np.int64)
    h, d = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint32 if b.n > 65535 else np.uint16), kind="stable")]
    h, d = h[order], d[order]
    keep = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    h, d = h[keep], d[keep]
    return d, h, np.bincount(d, minlength=b.n)


def set_ids(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each set as a whole; 0 for empty sets."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64)))
    end = np.cumsum(size)
    ids = mix((total[end] - total[end - size]) ^ size.astype(np.uint64))
    return np.where(size > 0, ids, np.uint64(0)).view(np.int64)


_MOVED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
_MOVED_SQL = "part int, kind int, id long, node long, n long, data binary"


def _rows(size: int, **given) -> pa.RecordBatch:
    made = []
    for f in _MOVED:
        x = given.get(f.name)
        made.append(pa.nulls(size, f.type) if x is None else pa.array(np.full(size, x), f.type) if np.isscalar(x) else pa.array(x, f.type))
    return pa.RecordBatch.from_arrays(made, schema=_MOVED)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned numbers, least first, each byte place by itself, which compresses better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _number(buf, count: int, width: int, at: int) -> np.ndarray:
    """The numbers that _planes made."""
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(buf, np.uint8, count * width, at).reshape(width, count).T
    return out.view("<u8").ravel()


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """(kind, value, rows) of each run of rows with the same kind and value of the column by, in their order; rows
    of documents in runs as they come."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, key = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("kind", by))
        key = np.where(kind == _DOC, 0, key)
        edges = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(kind)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            now = (int(kind[lo]), int(key[lo]))
            if held and now != at:
                yield *at, held
                held = []
            at = now
            if at[0] == _DOC:
                yield *at, [batch.slice(lo, hi - lo)]
            else:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield *at, held


def _batches(bits: int, parts: int, k: int):
    """Rows per document; per batch of sets its shingles by fragment, and its sets by their ids."""

    def flush(batch: int, nodes, sizes, owner, h) -> Iterator[pa.RecordBatch]:
        nodes, sizes, owner, h = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(owner), np.concatenate(h)
        name = int((np.bitwise_xor.reduce(mix(nodes.view(np.uint64))) ^ mix(np.array([batch], np.uint64))[0]).view(np.int64))
        frag = (h >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.argsort(frag, kind="stable")  # by owner within a fragment
        cut = np.searchsorted(frag[order], np.arange((1 << bits) + 1, dtype=np.uint64))
        h, owner = h[order], owner[order]
        some = np.flatnonzero(np.diff(cut))
        for lo, hi in slices([int(cut[f + 1] - cut[f]) * 9 for f in some], 4 << 20):
            data = [_planes(h[cut[f] : cut[f + 1]], 7) + _planes(owner[cut[f] : cut[f + 1]], 2) for f in some[lo:hi]]
            yield _rows(hi - lo, part=some[lo:hi], kind=_PACK, id=name, data=data)
        to = (nodes.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        data = [nodes[order[cut[p] : cut[p + 1]]].tobytes() + _planes(order[cut[p] : cut[p + 1]], 2) + _planes(sizes[order[cut[p] : cut[p + 1]]], 4) for p in some]
        yield _rows(len(some), part=some, kind=_SETS, id=name, data=data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        alone()
        seen: set[int] = set()
        name, rows = TaskContext.get().partitionId() << 32, 0
        held: tuple[list, list, list, list] = ([], [], [], [])
        base = waiting = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                doc, h, size = shingle_sets(texts[lo:hi], k)
                node = set_ids(doc, h, size)
                yield _rows(hi - lo, part=((name >> 32) + rows + np.arange(hi - lo)) % (1 << 30), kind=_DOC, id=ids.slice(lo, hi - lo).cast(pa.int64()), node=node, n=size)
                rows += hi - lo
                fresh = np.zeros(len(node), bool)
                for i in np.flatnonzero(size):  # a set that this task has sent is not sent again
                    if node[i] not in seen:
                        seen.add(int(node[i]))
                        fresh[i] = True
                if len(seen) > REMEMBERED:
                    seen = set()
                if not fresh.any():
                    continue
                if base and (base + fresh.sum() > SETS or waiting > TOGETHER):
                    yield from flush(name, *held)
                    name, held, base, waiting = name + 1, ([], [], [], []), 0, 0
                place = np.cumsum(fresh) - 1 + base
                mine = fresh[doc]
                for part, x in zip(held, (node[fresh], size[fresh], place[doc[mine]], h[mine]), strict=True):
                    part.append(x)
                base += int(fresh.sum())
                waiting += int(mine.sum())
        if base:
            yield from flush(name, *held)

    return run


def _counted(bits: int):
    """Per fragment: to each batch its entries of shingles that have several, with their number. Per set id: to
    each of its batches how many have it, the first; to the others that another one keeps it (0)."""

    def shingles(fragment: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, owners = [], [], []
        for batch in rows:
            for name, raw in zip(batch.column(2).to_pylist(), batch.column(5), strict=True):
                buf = raw.as_buffer()
                count = len(buf) // 9
                keys.append(_number(buf, count, 7, 0))
                owners.append(_number(buf, count, 2, 7 * count).astype(np.uint32))
                names.append((name, count))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        which = np.repeat(np.arange(len(names), dtype=np.uint32), [c for _, c in names])
        del keys, owners
        order = np.argsort(key)
        sorted_ = key[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        df = np.diff(np.concatenate((first, [len(sorted_)])))
        times = np.empty(len(key), np.int64)
        times[order] = np.repeat(df, df)
        some = np.flatnonzero(times > 1)
        cut = np.searchsorted(which[some], np.arange(len(names) + 1))
        full = np.flatnonzero(np.diff(cut))
        for lo, hi in slices([int(cut[i + 1] - cut[i]) * 13 for i in full], 4 << 20):
            data = [b"".join((_planes(key[x := some[cut[i] : cut[i + 1]]], 7), _planes(owner[x], 2), _planes(np.minimum(times[x], (1 << 32) - 1), 4))) for i in full[lo:hi]]
            ids = np.array([names[i][0] for i in full[lo:hi]])
            yield _rows(hi - lo, part=ids.astype(np.int32) & 0x3FFFFFFF, kind=_PACK, id=ids, node=fragment, data=data)

    def sets(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, nodes, places, sizes = [], [], [], []
        for batch in rows:
            for name, raw in zip(batch.column(2).to_pylist(), batch.column(5), strict=True):
                buf = raw.as_buffer()
                count = len(buf) // 14
                nodes.append(np.frombuffer(buf, "<i8", count))
                places.append(_number(buf, count, 2, 8 * count))
                sizes.append(_number(buf, count, 4, 10 * count))
                names.append(np.full(count, name))
        name, node, place, size = (np.concatenate(x) for x in (names, nodes, places, sizes))
        order = np.lexsort((place, name, node))
        first = np.flatnonzero(np.concatenate(([True], node[order][1:] != node[order][:-1])))
        copies = np.zeros(len(node), np.int64)
        copies[order[first]] = np.diff(np.concatenate((first, [len(node)])))
        order = np.argsort(name, kind="stable")
        edge = np.concatenate((np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1]))), [len(name)]))
        for lo, hi in slices(np.diff(edge).tolist(), 200_000):
            picks = [order[edge[i] : edge[i + 1]] for i in range(lo, hi)]
            ids = np.array([name[x[0]] for x in picks])
            yield _rows(hi - lo, part=ids.astype(np.int32) & 0x3FFFFFFF, kind=_SETS, id=ids, data=[b"".join((node[x].tobytes(), _planes(place[x], 2), _planes(size[x], 4), _planes(copies[x], 4))) for x in picks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part, rows in _groups(batches, "part"):
            yield from rows if kind == _DOC else shingles(part, rows) if kind == _PACK else sets(rows)

    return run


def _need(n, percent: int):
    """Smallest overlap with a set of the same size or less for which a set of n can link."""
    return -(-percent * n // 100)


def _ordered(bits: int, percent: int):
    """Per batch: its sets with shared shingles enough, each with these in order: hashes, then octaves."""

    def lists(packs: list[pa.RecordBatch], sets: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 1 + max(int(_number(raw.as_buffer(), (c := len(raw.as_buffer()) // 18), 2, 8 * c).max()) for b in sets for raw in b.column(5))
        node, size, copies = np.zeros(top, np.int64), np.zeros(top, np.int64), np.full(top, -1, np.int64)
        for raw in (raw for b in sets for raw in b.column(5)):
            buf = raw.as_buffer()
            count = len(buf) // 18
            at = _number(buf, count, 2, 8 * count).astype(np.int64)
            node[at], size[at], copies[at] = np.frombuffer(buf, "<i8", count), _number(buf, count, 4, 10 * count), _number(buf, count, 4, 14 * count)
        own, hash_, octave = [], [], []
        for b in packs:
            for fragment, raw in zip(b.column(3).to_pylist(), b.column(5), strict=True):
                buf = raw.as_buffer()
                count = len(buf) // 13
                o, df = _number(buf, count, 2, 7 * count).astype(np.int64), _number(buf, count, 4, 9 * count).astype(np.int64)
                if o.max() >= top or copies[o].min() < 0:
                    raise ValueError(_OTHERWISE)
                shared = (copies[o] > 0) & (df > copies[o])
                own.append(o[shared])
                hash_.append(_number(buf, count, 7, 0)[shared] | np.uint64(fragment >> bits - 8 << 56))
                octave.append(np.log2(df[shared]).astype(np.uint8))
        if not own:
            return
        o, h, oct_ = np.concatenate(own), np.concatenate(hash_), np.concatenate(octave)
        order = np.lexsort((h, oct_, o))
        h, oct_ = h[order], oct_[order]
        count = np.bincount(o, minlength=top)
        end = np.cumsum(count)
        able = np.flatnonzero((count > 0) & (count >= _need(size, percent)))
        for lo, hi in slices([int(count[i]) * 9 for i in able], 4 << 20):
            chosen = able[lo:hi]
            yield _rows(hi - lo, kind=_SETS, node=node[chosen], n=size[chosen], data=[h[end[i] - count[i] : end[i]].tobytes() + oct_[end[i] - count[i] : end[i]].tobytes() for i in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: tuple[int, list] | None = None  # entries come before the sets of their batch
        for kind, name, rows in _groups(batches, "id"):
            if packs and (kind, name) != (_SETS, packs[0]):
                raise ValueError(_OTHERWISE)
            if kind == _DOC:
                yield from rows
            elif kind == _PACK:
                packs = (name, rows)
            elif packs:
                yield from lists(packs[1], rows)
                packs = None
        if packs:
            raise ValueError(_OTHERWISE)

    return run


def _list(raw) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and octaves of a set's shared shingles."""
    buf = raw.as_buffer()
    count = len(buf) // 9
    return np.frombuffer(buf, "<u8", count), np.frombuffer(buf, np.uint8, count, 8 * count)


def _prefixes(percent: int):
    """(shingle, set, size, position in the set's global order, shingles it shares with none) of the rarest shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = [_list(x)[0] for x in batch.column(2)]
            count = np.array([len(x) for x in lists], np.int64)
            take = np.maximum(count - _need(n, percent) + 1, 0)
            for lo, hi in slices([int(x) * 32 for x in take], 8 << 20):
                t = take[lo:hi]
                offset = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[:m] for x, m in zip(lists[lo:hi], t, strict=True)]).view(np.int64)), pa.array(np.repeat(node[lo:hi], t)), pa.array(np.repeat(n[lo:hi], t)), pa.array(np.repeat((n - count)[lo:hi], t) + offset), pa.array(np.repeat((n - count)[lo:hi], t))],
                    names=["v", "node", "n", "pos", "own"],
                )

    return run


def _cut(pivots: list[int]):
    """Vertical fragments (node, f, seg) of each set's ordered shingles."""
    at = np.array(pivots, np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lists = batch.column(0).to_pylist(), [_list(x) for x in batch.column(1)]
            for lo, hi in slices([x.nbytes for x, _ in lists], 2 << 20):
                cuts = [(node, f, piece.tobytes()) for node, (x, o) in zip(nodes[lo:hi], lists[lo:hi], strict=True) for f, piece in enumerate(np.split(x, np.searchsorted(_coarse(x, o), at))) if len(piece)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*cuts, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["node", "f", "seg"])

    return run


def _coarse(h: np.ndarray, octave: np.ndarray) -> np.ndarray:
    """Octave and top byte of the hash, ascending in the global order."""
    return octave.astype(np.uint16) << np.uint16(8) | (h >> np.uint64(56)).astype(np.uint16)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of each fragment pair."""
    for batch in batches:
        out = np.empty(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            both = np.concatenate((np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")))
            both.sort()
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=["a", "b", "na", "nb", "part"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch) of each set: bit i tells whether an odd number of its shared shingles fall on it."""
    for batch in batches:
        made = []
        for raw in batch.column(1):
            odd = np.bincount((mix(_list(raw)[0]) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
            made.append(np.packbits(odd.astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "sketch"])


def _met(percent: int, sketched: bool):
    """Sets of a block under a shingle, rows sorted by block (v, bx, by); role 0 is held against role 1. With sketches:
    (a, b, na, nb) of the pairs of different components that can still link. Without: the rows of the sets that have
    such a partner as far as sizes and positions tell.

    Left sets are those outside the component of the shingle's hub; two of them meet once, by their ids.
    """

    def pairs(x: dict, y: dict) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and y of the pairs that pass."""
        nx, ny = x["n"][:, None], y["n"][None, :]
        ok = (x["comp"][:, None] != y["comp"][None, :]) & (~y["left"][None, :] | (x["node"][:, None] > y["node"][None, :]))
        ok &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        ok &= (100 + percent) * np.minimum(nx - x["pos"][:, None], ny - y["pos"][None, :]) >= percent * (nx + ny)
        i, j = np.nonzero(ok)
        if sketched and len(i):
            keep = []
            for lo in range(0, len(i), 100_000):
                p, q = i[lo : lo + 100_000], j[lo : lo + 100_000]
                apart = np.bitwise_count(x["sketch"][p] ^ y["sketch"][q]).sum(1, dtype=np.int64)
                most = (x["n"][p] - x["own"][p] + y["n"][q] - y["own"][q] - apart) // 2
                keep.append((100 + percent) * most >= percent * (x["n"][p] + y["n"][q]))
            good = np.concatenate(keep)
            i, j = i[good], j[good]
        return i, j

    names = ("left", "node", "n", "pos", "own", "comp")

    def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        col = {c: table.column(c).to_numpy(zero_copy_only=False) for c in names}
        if sketched:
            col["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(len(table), -1)
        role = table.column("role").to_numpy(zero_copy_only=False)
        x, y = ({c: a[role == r] for c, a in col.items()} for r in (0, 1))
        v = table.column("v")[0].as_py()
        hit_x, hit_y = np.zeros(len(x["n"]), bool), np.zeros(len(y["n"]), bool)
        for lo in range(0, len(x["n"]), 512):  # a bounded matrix at a time
            part = {c: a[lo : lo + 512] for c, a in x.items()}
            i, j = pairs(part, y)
            if not sketched:
                hit_x[lo + i] = True
                hit_y[j] = True
            elif len(i):
                flip = part["node"][i] < y["node"][j]
                a, b = np.where(flip, y["node"][j], part["node"][i]), np.where(flip, part["node"][i], y["node"][j])
                na, nb = np.where(flip, y["n"][j], part["n"][i]), np.where(flip, part["n"][i], y["n"][j])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, na, nb)], names=["a", "b", "na", "nb"])
        if not sketched and (hit_x.any() or hit_y.any()):
            both = [np.concatenate((x[c][hit_x], y[c][hit_y])) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both[0]), v)), *map(pa.array, both)], names=["v", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(k[lo] for k in keys)
                if at is not None and now != at:
                    yield from block(held)
                    held = []
                at = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from block(held)

    return run


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each of the pairs of columns of each row; unlike a union it leaves the partitions as they are."""
    return df.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))))


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each component, by alternating large-star and small-star steps.

    A hub is joined, never gathered; the loop ends when a round leaves the edges as they were.
    """
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = print_of(edges)
    while before[0]:
        both = _each(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(_each(large.join(least, "u"), ("v", "m"), ("u", "m")).where("u != v").distinct())
        after = print_of(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")


@dataclass
class Join:
    """documents: doc_id, node, n_shingles; labels: node, comp of sets linked to another set, whose component has
    the name of one of its sets; links: a, b, overlap, the tested pairs that link, which span every component."""

    documents: DataFrame
    labels: DataFrame
    links: DataFrame


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> Join:
    """Small intermediate tables are written, not only checkpointed, so that Spark knows their sizes when it plans."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bits = max(8, (min(SPREAD * parts, MOST_FRAGMENTS) - 1).bit_length())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = rows.mapInArrow(_batches(bits, parts, words), _MOVED_SQL).repartition(parts, "part").sortWithinPartitions("kind", "part")
    dealt = sent.mapInArrow(_counted(bits), _MOVED_SQL).repartition(parts, "part").sortWithinPartitions(F.col("kind") > _DOC, "id", "kind")
    kept = checkpointed(dealt.mapInArrow(_ordered(bits, percent), _MOVED_SQL))
    documents = kept.where(F.col("kind") == _DOC).select(F.col("id").alias("doc_id"), "node", F.col("n").alias("n_shingles"))
    sets = kept.where(F.col("kind") == _SETS).select("node", "n", "data")

    pivots = _pivots(sets)
    segs = sets.select("node", "data").mapInArrow(_cut(pivots), "node long, f int, seg binary")
    prefix = checkpointed(sets.mapInArrow(_prefixes(percent), "v long, node long, n long, pos long, own long"))

    def linked(pairs: DataFrame) -> DataFrame:
        one = pairs.join(segs.select(F.col("node").alias("a"), "f", F.col("seg").alias("seg_a")), "a")
        two = one.join(segs.select(F.col("node").alias("b"), "f", F.col("seg").alias("seg_b")), ["b", "f"])
        parts = two.select("a", "b", "na", "nb", "seg_a", "seg_b").mapInArrow(_overlap, "a long, b long, na long, nb long, part long")
        total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
        return written(total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b", "overlap"))

    similar = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    # the set with the fewest shingles of its own is the likeliest middle of a group; ties go by the set id
    rank = F.least("own", F.lit((1 << 22) - 1)) * (1 << 40) + F.col("node").bitwiseAND((1 << 40) - 1)
    ranked = prefix.withColumn("rank", rank)
    hub = ranked.groupBy("v").agg(*(F.min_by(c, "rank").alias(o) for c, o in (("node", "hub"), ("n", "nb"), ("pos", "pb"))), F.min("rank").alias("top"), F.count("*").alias("g")).where("g > 1").drop("g")
    # written: a join with the aggregate itself would hold each shingle's sets in the task that made it, and
    # could not be split under a hot shingle
    hub = written(hub)
    # what both can still share from these places on must reach the overlap that links them
    enough = lambda na, pa_, nb, pb: (100 + percent) * (F.least(na - pa_, nb - pb)) >= percent * (na + nb)
    star = ranked.join(hub, "v").where("rank > top").where(similar(F.col("n"), F.col("nb")))
    star = star.groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.min("n").alias("na"), F.min("nb").alias("nb"), F.min("pos").alias("pa"), F.min("pb").alias("pb"), F.count("*").alias("k"))
    star = star.where(enough(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"))).select("a", "b", "na", "nb", "k")
    # kept, as ties may fall otherwise when it is made again
    best = written(star.groupBy("a").agg(F.max_by("b", "k").alias("b"), F.max_by("na", "k").alias("na"), F.max_by("nb", "k").alias("nb")))
    links = linked(best)
    labels = _roots(links.select(F.col("a").alias("node"), F.col("b").alias("comp")))

    def label(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(col), F.col("comp").alias("_c")), col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")

    placed = label(ranked, "node", "comp")
    # the hub's component is most often the largest under a shingle; any would do
    mixed = written(placed.groupBy("v").agg(F.min_by("comp", "rank").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v", "most"))
    open_ = placed.join(mixed, "v").select("v", (F.col("comp") != F.col("most")).alias("left"), "node", "n", "pos", "own", "comp")

    def met(rows: DataFrame, sketched: bool, schema: str) -> DataFrame:
        """Rows dealt into blocks: those outside the hub's component against all, each side in shares of BLOCK."""
        rows = checkpointed(rows)
        shares = written(rows.groupBy("v").agg(F.ceil(F.sum(F.col("left").cast("int")) / BLOCK).cast("int").alias("nx"), F.ceil(F.count("*") / BLOCK).cast("int").alias("ny")))
        share = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        block = lambda role, bx, by: F.struct(F.lit(role).alias("role"), bx.alias("bx"), by.alias("by"))
        first = F.when(F.col("left"), F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda j: block(0, share("nx"), j)))
        second = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda i: block(1, i, share("ny")))
        both = F.concat(F.coalesce(first, F.array().cast("array<struct<role: int, bx: int, by: int>>")), second)
        more = ["sketch"] if sketched else []
        dealt = rows.join(shares, "v").select("v", F.inline(both), "left", "node", "n", "pos", "own", "comp", *more)
        dealt = dealt.select("v", "bx", "by", "role", "left", "node", "n", "pos", "own", "comp", *more)
        return dealt.repartition(parts, "v", "bx", "by").sortWithinPartitions("v", "bx", "by").mapInArrow(_met(percent, sketched), schema)

    able = written(met(open_, False, "v long, left boolean, node long, n long, pos long, own long, comp long").distinct())
    sketches = sets.select("node", "data").mapInArrow(_sketches, "node long, sketch binary")
    pair = met(able.join(sketches, "node"), True, "a long, b long, na long, nb long")
    tested = best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = written(pair.distinct().join(tested, ["a", "b"], "left_anti"))
    if pairs.isEmpty():
        return Join(documents, labels, links)
    more = linked(pairs)
    bridges = label(label(more, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = written(connected(bridges))
    moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    return Join(documents, written(moved.union(merged.select("node", "comp"))), links.union(more))


def _roots(parents: DataFrame) -> DataFrame:
    """(node, comp): the end of each node's chain of parents, found by doubling. Parents have a lower rank than
    their nodes, so there are no rings."""
    out = parents
    while True:
        up = out.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        if out.join(up, "comp", "left_semi").isEmpty():
            return out
        out = written(out.join(up, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")))


def _pivots(sets: DataFrame) -> list[int]:
    """Cuts of the global order that share the entries of all sets evenly, from counts by octave and top byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 14, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(_coarse(*_list(raw)), minlength=1 << 14)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["top", "c"])

    counts = sets.select("data").mapInArrow(run, "top long, c long").groupBy("top").agg(F.sum("c").alias("c")).orderBy("top").collect()
    if not counts:
        return []
    running = np.cumsum([r["c"] for r in counts])
    return [int(counts[int(np.searchsorted(running, running[-1] * i / VERTICAL))]["top"]) + 1 for i in range(1, VERTICAL)]


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach, the document's own included."""
    found = join(docs, text, key, words, percent)
    placed = found.documents.join(found.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("doc_id", "n_shingles", "comp")
    # written, so that the join back can be split under a hot component
    least = written(placed.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    some = placed.where("n_shingles > 0").join(least, "comp").select("doc_id", "n_shingles", "component_id")
    return some.union(placed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, one for each component of linked texts: that of the smallest key (null last), of the smallest
    hash where a key has several texts. Rows that repeat key and text are one; empty sets all stay."""
    a, b = free(docs, "_a", "_b")
    first, second = row_hash(key, text)
    keyed = docs.withColumns({a: first, b: second})
    found = join(keyed, text, a, words, percent)
    rows = keyed.select(F.col(a).alias("doc_id"), F.col(b).alias("_other"), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key")).alias("_at")).distinct()
    # copies meet in these aggregates, combined in their tasks before, and not in the joins
    placed = found.documents.distinct().join(found.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = rows.join(placed, "doc_id")
    best = known.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("_at", "doc_id", "_other")).alias("best")).select("best.doc_id", "best._other")
    chosen = best.union(known.where("n_shingles = 0").select("doc_id", "_other")).select(F.col("doc_id").alias(a), F.col("_other").alias(b))
    return keyed.dropDuplicates([a, b]).join(chosen, [a, b], "left_semi").select(*docs.columns)


#: The components in DuckDB SQL over a view `docs` with columns doc_id (unique) and text.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reached.doc_id, either.b FROM reached JOIN either ON either.a = reached.r)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, coalesce(min(r), d.doc_id) AS component_id
FROM words d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached USING (doc_id) GROUP BY d.doc_id
"""
