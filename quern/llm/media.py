"""Media columns in progressive JPEG.

Images are binary columns. A reader collects the scans of a progressive JPEG - spectral selection and
successive approximation alike - into coefficient arrays, undoes the quantisation and the cosine transform in
numpy, widens subsampled chroma and gives full-resolution RGB tensors. Huffman decoding runs in lockstep over
all restart intervals of all images of a batch that share a scan layout, so its loops are over the symbols of
one interval and its arrays as wide as the batch.

The writer stores bytes losslessly in the format's own unit: each byte less 128 is a coefficient of an 8 x 8
block, 192 bytes a unit of three full-resolution components, quantised by 1. Its script sends DC by one bit
less and then that bit, the first five AC coefficients likewise, and the others in one band.

Defined results: null and empty texts are one padded unit of blanks; equal texts give equal files; a file
that is no progressive JPEG, or is cut short, raises ValueError, and so does a payload of more blocks than the format's
65535 pixels of height hold; repeated rows are stored alike, and nothing depends on other rows, so there are no ties;
an empty table gives an empty table; columns of the input named as a result are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import slices

UNIT = 192
#: Widest row of blocks; bytes of payload that are coded together.
ACROSS, CHUNK = 1024, 1 << 20
#: Zigzag order of the format: natural place of each coefficient, diagonal by diagonal.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: The writer's scans: components, first and last coefficient, high and low bit.
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 5, 1, 0) for c in range(3)),
]
_DC, _AC = 0x00, 0x10


def _tables() -> dict[int, list[tuple[int, int]]]:
    """The writer's Huffman tables as (length, symbol): DC sizes by 4 bits; AC values without a run of zeros
    by 4 bits, every other symbol of the format by 9."""
    short = list(range(1, 9))
    rest = [s for s in range(256) if s not in short and (s & 15) <= 10]
    return {_DC: [(4, s) for s in range(12)], _AC: [(4, s) for s in short] + [(9, s) for s in rest]}


def _codes(table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and length by symbol."""
    code, last, codes, lengths = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for length, symbol in table:
        code <<= length - last
        codes[symbol], lengths[symbol], last = code, length, length
        code += 1
    return codes, lengths


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(maxsize=1)
def _prelude() -> bytes:
    """Quantisation, Huffman tables and restart interval of 1, the same in all files."""
    out = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    for kind, table in _tables().items():
        counts = bytes(sum(length == n for length, _ in table) for n in range(1, 17))
        out += _segment(0xC4, bytes([kind]) + counts + bytes(s for _, s in table))
    return out + _segment(0xDD, (1).to_bytes(2, "big"))


def _bits(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes to bytes, each row ended by 1 bits to a whole byte; bytes and their number per row."""
    total = lengths.sum(1)
    pad = -total % 8
    values = np.column_stack([values, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)]).ravel()
    lengths = np.column_stack([lengths, pad]).ravel()
    end = np.cumsum(lengths)
    begin = end - lengths
    word, free = begin >> 6, 64 - (begin & 63) - lengths
    over = free < 0
    high = np.where(over, values >> np.minimum(-free, 63).clip(0).astype(np.uint64), values << free.clip(0, 63).astype(np.uint64))
    out = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] = np.add.reduceat(high, first)
    out[word[over] + 1] += values[over] << (64 + free[over]).astype(np.uint64)
    size = (total + 7) >> 3
    return out.byteswap().view(np.uint8)[: int(size.sum())], size


def _marked(data: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Stuffed bytes with restart markers between the rows of an image; where each image ends."""
    image = np.searchsorted(first, np.arange(len(size)), "right") - 1
    place = np.arange(len(size)) - first[image]
    before = np.arange(len(size)) - image
    full = data == 0xFF
    at = np.arange(len(data)) + np.cumsum(full) - full + 2 * np.repeat(before, size)
    stop = np.cumsum(size)
    out = np.zeros(len(data) + int(full.sum()) + 2 * int(before[-1]), np.uint8)
    out[at] = data
    last = at[stop - 1] + 1 + full[stop - 1]
    more = np.flatnonzero(place > 0)
    out[last[more - 1]] = 0xFF
    out[last[more - 1] + 1] = 0xD0 + (place[more] - 1) % 8
    return out.tobytes(), last[np.concatenate((first[1:], [len(size)])) - 1]


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and the bits that follow it."""
    size = np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _first_ac(v: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a band of each block: runs of zeros, values, and the end of the block."""
    rows, width = v.shape
    some = v != 0
    place = np.where(some, np.arange(width), -1)
    before = np.maximum.accumulate(np.column_stack([np.full(rows, -1), place[:, :-1]]), 1)
    run = np.arange(width) - before - 1
    size, bits = _magnitude(v)
    symbol = np.where(some, (run & 15) << 4 | size, 0)
    value = codes[symbol] << size.astype(np.uint64) | bits
    length = lengths[symbol] + size
    long_ = some & (run > 15)
    if long_.any():
        skip, one = codes[0xF0], int(lengths[0xF0])
        for n in range(1, 4):
            now = some & (run >> 4 >= n)
            value[now] |= skip << length[now].astype(np.uint64)
            length[now] += one
    value[~some], length[~some] = 0, 0
    ended = place.max(1) < width - 1
    return np.column_stack([value, np.where(ended, codes[0], np.uint64(0))]), np.column_stack([length, np.where(ended, lengths[0], 0)])


def _refined_ac(v: np.ndarray, low: int, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one more bit of a band: new values with their runs, and correction bits for the others."""
    rows, width = v.shape
    size = np.abs(v) >> low
    values, used = np.zeros((rows, width + 1), np.uint64), np.zeros((rows, width + 1), np.int64)
    run, held, count = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.int64)
    for k in range(width):
        old, new = size[:, k] > 1, size[:, k] == 1
        held = np.where(old, held << np.uint64(1) | (size[:, k] & 1).astype(np.uint64), held)
        count = count + old
        symbol = run << 4 | 1
        sign = (v[:, k] > 0).astype(np.uint64)
        values[:, k] = np.where(new, (codes[symbol] << np.uint64(1) | sign) << count.astype(np.uint64) | held, np.uint64(0))
        used[:, k] = np.where(new, lengths[symbol] + 1 + count, 0)
        run = np.where(new, 0, run + (size[:, k] == 0))
        held, count = np.where(new, np.uint64(0), held), np.where(new, 0, count)
    left = (run > 0) | (count > 0)
    values[:, width] = np.where(left, codes[0] << count.astype(np.uint64) | held, np.uint64(0))
    used[:, width] = np.where(left, lengths[0] + count, 0)
    return values, used


def write(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose length must be a positive multiple of UNIT."""
    if any(not p or len(p) % UNIT for p in payloads):
        raise ValueError(f"a payload must be a positive multiple of {UNIT} bytes")
    units = np.array([len(p) // UNIT for p in payloads])
    wide = np.minimum(units, ACROSS)
    high = -(-units // wide)
    if high.max(initial=0) > 8191:
        raise ValueError("a payload exceeds the largest image of the format")
    stored = wide * high
    parts = [p + bytes([128]) * int((s - u) * UNIT) for p, u, s in zip(payloads, units, stored, strict=True)]
    coefs = (np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) - 128).reshape(-1, 3, 64).astype(np.int64)
    first = np.cumsum(stored) - stored
    tables = {k: _codes(t) for k, t in _tables().items()}
    pieces: list[list[bytes]] = [
        [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _prelude(), _segment(0xC2, bytes([8]) + int(h * 8).to_bytes(2, "big") + int(w * 8).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))]
        for p, w, h in zip(payloads, wide, high, strict=True)
    ]
    for comps, start, stop, ah, al in SCRIPT:
        if start == 0 and ah == 0:
            size, bits = _magnitude(coefs[:, :, 0] >> al)
            codes, lengths = tables[_DC]
            got = codes[size] << size.astype(np.uint64) | bits, lengths[size] + size
        elif start == 0:
            got = (coefs[:, :, 0] >> al & 1).astype(np.uint64), np.ones((len(coefs), 3), np.int64)
        elif ah == 0:
            band = coefs[:, comps[0], start : stop + 1]
            got = _first_ac(np.sign(band) * (np.abs(band) >> al), *tables[_AC])
        else:
            got = _refined_ac(coefs[:, comps[0], start : stop + 1], al, *tables[_AC])
        data, ends = _marked(*_bits(*got), first)
        head = _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([start, stop, ah << 4 | al]))
        for piece, a, b in zip(pieces, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            piece += [head, data[a:b]]
    return [b"".join([*piece, b"\xff\xd9"]) for piece in pieces]


@dataclass
class Image:
    width: int
    height: int
    #: Per component: horizontal and vertical sampling, blocks across and down with padding, first coefficient row.
    sampling: list[tuple[int, int]]
    blocks: list[tuple[int, int]]
    rows: list[int]
    quant: list[np.ndarray]
    comment: bytes = b""
    scans: list = field(default_factory=list)


@lru_cache(maxsize=64)
def _lookup(spec: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16-bit prefix; 0 where no code fits."""
    counts, symbols = spec[:16], spec[16:]
    out, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _parse(data: bytes, at: list[int], base: int) -> Image:
    """The frame and scans of one file; at: places of all markers that are not restarts, base: of the file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, quant, huff, interval, comment = None, {}, {}, 0, b""
    ids: dict[int, int] = {}
    skip = 2
    for i, place in enumerate(at):
        if place < skip:
            continue  # inside a segment that was read
        marker = data[place + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[place + 2 : place + 4], "big")
        body = data[place + 4 : place + 2 + size]
        skip = place + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            height, width, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            specs = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)]
            ids = {s[0]: c for c, s in enumerate(specs)}
            hm, vm = max(s[1] for s in specs), max(s[2] for s in specs)
            mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
            image = Image(width, height, [(s[1], s[2]) for s in specs], [(mx * s[1], my * s[2]) for s in specs], [], [s[3] for s in specs])
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"not a progressive JPEG: frame marker {marker:02x}")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before its frame")
            n = body[0]
            comps = [ids[body[1 + 2 * c]] for c in range(n)]
            trees = [body[2 + 2 * c] for c in range(n)]
            start, stop, approx = body[1 + 2 * n : 4 + 2 * n]
            later = next((p for p in itertools.islice(at, i + 1, None) if p >= skip), None)
            if later is None:
                raise ValueError("a scan that does not end")
            tables = tuple(huff.get(t >> 4 if start == 0 else 0x10 | t & 15, b"") for t in trees)
            image.scans.append((tuple(comps), start, stop, approx >> 4, approx & 15, tables, interval, base + skip, base + later))
    if image is None or not image.scans:
        raise ValueError("no frame or scans")
    image.quant = [quant[q] for q in image.quant]
    image.comment = comment
    return image


class _Reader:
    """Bit positions of many restart intervals, read in lockstep."""

    def __init__(self, windows: np.ndarray, pos: np.ndarray):
        self.windows, self.pos = windows, pos

    def window(self, who) -> np.ndarray:
        """The 57 bits or more from each position on, at the top of a word."""
        p = self.pos[who]
        return self.windows[p >> 3] << (p & 7).astype(np.uint64)

    def bits(self, who, n: np.ndarray) -> np.ndarray:
        w = self.window(who)
        self.pos[who] += n
        return ((w >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)

    def symbol(self, who, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, its code's length, and the window."""
        w = self.window(who)
        e = table[(w >> np.uint64(48)).astype(np.int64)]
        if not e.all():
            raise ValueError("a code that is in no table")
        return e & 255, e >> 8, w

    def value(self, who, w: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The signed value of size bits after the code; moves beyond both."""
        raw = (((w << length.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        self.pos[who] += length + size
        return np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)


def _decode_scan(reader: _Reader, coefs: np.ndarray, rows: np.ndarray, comp: list[int], n: np.ndarray, start: int, stop: int, ah: int, al: int, tables: list[np.ndarray]) -> None:
    """rows: coefficient row by interval and block, comp: the scan's component by block of a unit, n: blocks by interval."""
    flat = coefs.reshape(-1)
    size = len(rows)
    eob = np.zeros(size, np.int64)
    pred = np.zeros((size, len(tables)), np.int64)
    for b in range(rows.shape[1]):
        here = np.flatnonzero(n > b)
        row = rows[here, b] * 64
        c = comp[b % len(comp)]
        if start == 0 and ah == 0:
            s, length, w = reader.symbol(here, tables[c])
            pred[here, c] += np.where(s > 0, reader.value(here, w, length, s), 0)
            flat[row] = pred[here, c] << al
        elif start == 0:
            flat[row] |= (reader.bits(here, np.ones(len(here), np.int64)) << al).astype(flat.dtype)
        elif ah == 0:
            going = eob[here] == 0
            eob[here[~going]] -= 1
            here, row = here[going], row[going]
            k = np.full(len(here), start)
            while len(here):
                rs, length, w = reader.symbol(here, tables[0])
                s, r = rs & 15, rs >> 4
                v = reader.value(here, w, length, s)
                valued = s > 0
                if valued.all():
                    k += r
                    if k.max() > 63:
                        raise ValueError("a run beyond the block")
                    flat[row + k] = v << al
                    k += 1
                else:
                    k = k + np.where(valued | (r == 15), r, 0)
                    if k.max() > 63:
                        raise ValueError("a run beyond the block")
                    flat[(row + k)[valued]] = v[valued] << al
                    k += 1
                    ends = ~valued & (r < 15)
                    if ends.any():
                        eob[here[ends]] = (1 << r[ends]) - 1 + reader.bits(here[ends], r[ends])
                        k[ends] = 64
                if k.max() > stop:
                    on = k <= stop
                    here, row, k = here[on], row[on], k[on]
        else:
            m = len(here)
            ended, need = eob[here] > 0, eob[here] == 0
            run, new = np.zeros(m, np.int64), np.zeros(m, np.int64)
            for k in range(start, stop + 1):
                if need.any():
                    at = np.flatnonzero(need)
                    rs, length, _ = reader.symbol(here[at], tables[0])
                    reader.pos[here[at]] += length
                    s, r = rs & 15, rs >> 4
                    signed = at[s > 0]
                    new[at] = 0
                    if len(signed):
                        new[signed] = np.where(reader.bits(here[signed], np.ones(len(signed), np.int64)) > 0, 1 << al, -(1 << al))
                    run[at] = r
                    ends = (s == 0) & (r < 15)
                    if ends.any():
                        e = at[ends]
                        eob[here[e]] = (1 << r[ends]) + reader.bits(here[e], r[ends])
                        ended[e] = True
                    need[at] = False
                v = flat[row + k].astype(np.int64)
                old = np.flatnonzero(v)
                if len(old):
                    bit = reader.bits(here[old], np.ones(len(old), np.int64))
                    fresh = (bit > 0) & ((np.abs(v[old]) >> al & 1) == 0)
                    flat[row[old] + k] = v[old] + np.where(fresh, np.sign(v[old]) << al, 0)
                zero = (v == 0) & ~ended
                placed = np.flatnonzero(zero & (run == 0))
                flat[row[placed] + k] = new[placed]
                need[placed] = True
                run -= zero & (run > 0)
            eob[here[ended]] -= 1


@lru_cache(maxsize=4096)
def _layout(width: int, height: int, sampling: tuple, blocks: tuple, comps: tuple[int, ...]) -> tuple[np.ndarray, list[int]]:
    """Coefficient rows of a scan from the image's first on, by unit and block of a unit, and the scan's component
    by block of a unit."""
    sizes = [across * down for across, down in blocks]
    rows = np.cumsum(sizes) - sizes
    if len(comps) == 1:
        c = comps[0]
        h, v = sampling[c]
        hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
        across, down = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        return (rows[c] + np.arange(down)[:, None] * blocks[c][0] + np.arange(across)).reshape(-1, 1), [0]
    units_x, units_y = blocks[comps[0]][0] // sampling[comps[0]][0], blocks[comps[0]][1] // sampling[comps[0]][1]
    unit = np.arange(units_x * units_y)
    out, owner = [], []
    for i, c in enumerate(comps):
        h, v = sampling[c]
        for y in range(v):
            for x in range(h):
                out.append(rows[c] + (unit // units_x * v + y) * blocks[c][0] + unit % units_x * h + x)
                owner.append(i)
    return np.column_stack(out), owner


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images of progressive JPEG files and their quantised coefficients, one zigzag row per block."""
    joined = b"".join(files)
    x = np.frombuffer(joined, np.uint8)
    base = np.cumsum([0, *map(len, files)])
    mark = np.flatnonzero((x[:-1] == 0xFF) & (x[1:] != 0) & (x[1:] != 0xFF))
    restart = (x[mark + 1] & 0xF8) == 0xD0
    restarts, others = mark[restart], mark[~restart]
    cut = np.searchsorted(others, base)
    images, rows = [], 0
    groups: dict[tuple, list[tuple[Image, tuple]]] = defaultdict(list)
    for i, f in enumerate(files):
        image = _parse(f, (others[cut[i] : cut[i + 1]] - base[i]).tolist(), int(base[i]))
        for across, down in image.blocks:
            image.rows.append(rows)
            rows += across * down
        for order, scan in enumerate(image.scans):
            layout = tuple(image.sampling[c] for c in scan[0]) if len(scan[0]) > 1 else ()
            groups[(order, *scan[:7], layout)].append((image, scan))
        images.append(image)
    stuffed = np.zeros(len(x) + 16, bool)
    stuffed[1 : len(x)] = (x[1:] == 0) & (x[:-1] == 0xFF)
    kept = np.concatenate((x, np.zeros(16, np.uint8)))[~stuffed]
    moved = np.concatenate(([0], np.cumsum(~stuffed)))
    windows = np.ndarray((len(kept) - 7,), ">u8", kept.tobytes(), 0, (1,)).astype(np.uint64)
    coefs = np.zeros((rows, 64), np.int16)
    for key in sorted(groups, key=lambda k: k[0]):
        members = groups[key]
        (_, comps, start, stop, ah, al, tables, interval, _), found = key, [_layout(image.width, image.height, tuple(image.sampling), tuple(image.blocks), key[1]) for image, _ in members]
        owner = found[0][1]
        begin, last = (np.array([scan[j] for _, scan in members]) for j in (7, 8))
        lo, hi = np.searchsorted(restarts, begin), np.searchsorted(restarts, last)
        units = np.array([len(r) for r, _ in found])
        per = np.where(interval > 0, interval, units)
        parts = -(-units // per)
        if (hi - lo != parts - 1).any():
            raise ValueError("a scan with too few or too many restart intervals")
        image_of = np.repeat(np.arange(len(members)), parts)
        nth = np.arange(len(image_of)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.where(nth == 0, begin[image_of], 0)
        later = np.flatnonzero(nth)
        at[later] = restarts[lo[image_of[later]] + nth[later] - 1] + 2
        all_rows = np.concatenate([r for r, _ in found]) + np.repeat([image.rows[0] for image, _ in members], units)[:, None]
        offset = (np.cumsum(units) - units)[image_of] + nth * per[image_of]
        count = np.minimum(per[image_of], units[image_of] - nth * per[image_of])
        unit = np.minimum(offset[:, None] + np.arange(count.max()), len(all_rows) - 1)
        blocks = all_rows[unit].reshape(len(at), -1)
        reader = _Reader(windows, moved[at] * 8)
        _decode_scan(reader, coefs, blocks, owner, count * len(owner), start, stop, ah, al, [_lookup(t) if t else np.zeros(1 << 16, np.int64) for t in tables])
    return images, coefs


_SCALE = 13


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """Inverse transform of a zigzag row to 64 samples, in whole multiples of 2^-13 so that sums are exact."""
    u = np.arange(8)
    one = np.where(u[:, None] == 0, np.sqrt(1 / 8), np.sqrt(1 / 4)) * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    whole = np.einsum("ux,vy->vuyx", one, one).reshape(64, 64)
    return np.round(whole[ZIGZAG] * (1 << _SCALE))


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples (n, 64) of quantised blocks."""
    exact = (coefs * quant).astype(np.float64) @ _cosines()
    return np.clip((exact.astype(np.int64) + (1 << _SCALE - 1) >> _SCALE) + 128, 0, 255)


def _to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    half = 1 << 15
    r, g, b = y + (91881 * cr + half >> 16), y - (22554 * cb + 46802 * cr + half >> 16), y + (116130 * cb + half >> 16)
    return np.clip(np.stack([r, g, b], -1), 0, 255).astype(np.uint8)


def rgb(image: Image, coefs: np.ndarray) -> np.ndarray:
    """The tensor (height, width, 3); chroma of fewer samples is repeated to full resolution."""
    hm, vm = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
    planes = []
    for (h, v), (across, down), row, quant in zip(image.sampling, image.blocks, image.rows, image.quant, strict=True):
        plane = samples(coefs[row : row + across * down], quant).reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)
        planes.append(plane.repeat(vm // v, 0).repeat(hm // h, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    return _to_rgb(*planes[:3])


def payload(image: Image, coefs: np.ndarray) -> bytes:
    """The bytes that write() stored."""
    n = int(image.comment.removeprefix(b"payload "))
    blocks = [coefs[r : r + image.blocks[c][0] * image.blocks[c][1]] for c, r in enumerate(image.rows)]
    return (np.stack(blocks, 1) + 128).astype(np.uint8).tobytes()[:n]


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text but with n_bytes and media, a progressive JPEG of its padded bytes; no shuffle."""
    plain = docs.drop("n_bytes", "media")
    keep = [f for f in plain.schema if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_bytes long", "media binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for lo, hi in slices([len(t) + UNIT for t in raw], CHUNK):
                part = raw[lo:hi]
                files = write([t + b" " * (UNIT if not t else -len(t) % UNIT) for t in part])
                rest = batch.slice(lo, hi - lo).select([f.name for f in keep])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(map(len, part), pa.int64()), pa.array(files, pa.binary())], names=[*rest.schema.names, "n_bytes", "media"])

    return plain.mapInArrow(run, schema)


_LOADED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def load(media: DataFrame, tensors: bool = False) -> DataFrame:
    """media with what its files hold: the payload's measures, the file's, and a feature: the size of the image
    and the mean of each channel; with tensors also height, width and rgb (uint8, row by row)."""
    plain = media.drop(*(x.split()[0] for x in _LOADED.split(", ")), "height", "width", "rgb")
    keep = [f for f in plain.schema if f.name != "media" or tensors]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), _LOADED, *(["height int, width int, rgb binary"] if tensors else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(batch.schema.get_field_index("media")).to_pylist()
            for lo, hi in slices([len(f) for f in files], CHUNK):
                part = files[lo:hi]
                images, coefs = read(part)
                cols: list[list] = [[] for _ in range(9)]
                for f, image in zip(part, images, strict=True):
                    held, tensor = payload(image, coefs), rgb(image, coefs)
                    mean = tensor.reshape(-1, 3).sum(0, dtype=np.int64) / (image.width * image.height)
                    row = (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]), len(f), hashlib.sha256(f).hexdigest(), f"{image.width}x{image.height}:" + ",".join(f"{x:.4f}" for x in mean), image.height, image.width, tensor.tobytes() if tensors else None)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                rest = batch.slice(lo, hi - lo).select([f.name for f in keep])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()][: 9 if tensors else 6]
                names = [*(x.split()[0] for x in _LOADED.split(", ")), "height", "width", "rgb"][: len(kinds)]
                yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*rest.schema.names, *names])

    return plain.mapInArrow(run, schema)


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of its text, written as an image and read back."""
    return load(store(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))))
