import random
import zlib

import numpy as np
import pytest

from quern.llm import media as M


def test_round_trip():
    r = np.random.default_rng(0)
    payloads = [r.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 7, 1024, 1025, 2500)]
    payloads += [bytes([128]) * 192, bytes([0]) * 384, bytes([255]) * 192, bytes([129, 127]) * 96, r.choice([128, 128, 128, 128, 129, 0, 255], 192 * 60).astype(np.uint8).tobytes()]
    files = M.write(payloads)
    images, coefs = M.read(files)
    assert [M.payload(i, coefs) for i in images] == payloads
    alone = [M.read([f]) for f in files]
    assert [M.payload(i[0], c) for i, c in alone] == payloads


def test_restart_markers_are_optional():
    """The scans of a file, put in a stream of bits without restarts, decode to the same coefficients."""
    r = np.random.default_rng(1)
    payload = r.choice([100, 128, 128, 128, 130], 192 * 9).astype(np.uint8).tobytes()
    v = (np.frombuffer(payload, np.uint8).astype(np.int64) - 128).reshape(-1, 3, 64)
    tables = {k: M._codes(t) for k, t in M._tables().items()}
    out = [b"\xff\xd8", M._segment(0xFE, b"payload %d" % len(payload)), M._prelude(), M._segment(0xDD, b"\0\0"), M._segment(0xC2, bytes([8, 0, 8, 0, 72, 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    for c in range(3):
        codes, lengths = tables[M._DC]
        dc = np.diff(v[:, c, 0], prepend=0)
        size, bits = M._magnitude(dc)
        scans = [(codes[size] << size.astype(np.uint64) | bits, lengths[size] + size, 0, 0), (*(x.reshape(1, -1) for x in M._first_ac(v[:, c, 1:], *tables[M._AC])), 1, 63)]
        for values, used, start, stop in scans:
            data, _ = M._bits(values.reshape(1, -1), used.reshape(1, -1))
            body, _ = M._marked(data, np.array([len(data)]), np.array([0]))
            out += [M._segment(0xDA, bytes([1, c + 1, 0, start, stop, 0])), body]
    images, coefs = M.read([b"".join([*out, b"\xff\xd9"])])
    assert M.payload(images[0], coefs) == payload


def subsampled(luma: np.ndarray, chroma: list[int]) -> bytes:
    """A 4:2:0 file of 16 x 16 samples: four flat luma blocks and two flat chroma blocks, one interleaved DC scan."""
    codes, lengths = M._codes(M._tables()[M._DC])
    steps = [*np.diff(luma, prepend=0), *chroma]
    size, bits = M._magnitude(np.array([steps]))
    data, _ = M._bits(codes[size] << size.astype(np.uint64) | bits, lengths[size] + size)
    body, _ = M._marked(data, np.array([len(data)]), np.array([0]))
    frame = M._segment(0xC2, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return b"".join([b"\xff\xd8", M._prelude(), M._segment(0xDD, b"\0\0"), frame, M._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])), body, b"\xff\xd9"])


def test_chroma_is_widened():
    images, coefs = M.read([subsampled(np.array([80, -80, 160, 0]), [40, -40])])
    tensor = M.rgb(images[0], coefs)
    assert tensor.shape == (16, 16, 3)
    y = np.repeat(np.repeat(np.array([[138, 118], [148, 128]]), 8, 0), 8, 1)
    want = np.stack([y + 1.402 * -5, y - 0.344136 * 5 - 0.714136 * -5, y + 1.772 * 5], -1)
    assert np.abs(tensor - want).max() <= 1


def test_transform_equals_definition():
    r = np.random.default_rng(2)
    block = r.integers(-60, 60, 64)
    natural = np.zeros(64)
    natural[M.ZIGZAG] = block
    f = natural.reshape(8, 8)
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    want = np.array([[sum(c(u) * c(v) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    got = M.samples(block[None].astype(np.int16), np.ones(64, np.int64)).reshape(8, 8)
    assert np.abs(got - np.clip(np.round(want) + 128, 0, 255)).max() <= 1


@pytest.mark.parametrize("bad", [b"", b"GIF89a", b"\xff\xd8\xff\xd9", M.write([b"x" * 192])[0][:400]])
def test_bad_files(bad):
    with pytest.raises(ValueError):
        M.read([bad])


def test_query_rows(frame, odd):
    rows = [r for r in odd if r[0] != 4] + [(70, "z" * 300_000)]
    got = M.load(M.store(frame(rows)), tensors=True).collect()
    assert len(got) == len(rows)
    text = dict((i, t) for i, t in rows if i is not None)
    same = {}
    for r in got:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            padded = raw + b" " * (192 if not raw else -len(raw) % 192)
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
            assert len(r.rgb) == 3 * r.height * r.width and r.score == "score"
            assert same.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert M.load(M.store(frame([]))).count() == 0
    r = random.Random(0)
    assert r


class Bits:
    """Bits of entropy-coded bytes, one by one; stuffed zeros are left out."""

    def __init__(self, data):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0

    def one(self):
        byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 255
        self.at += 1
        return byte >> 7 - (self.at - 1) % 8 & 1

    def some(self, n):
        v = 0
        for _ in range(n):
            v = v * 2 + self.one()
        return v

    def value(self, n):
        v = self.some(n)
        return v if n == 0 or v >> n - 1 else v - (1 << n) + 1

    def symbol(self, table):
        code = 1
        while code not in table:
            code = code * 2 + self.one()
        return table[code]


def plain_read(data):
    """Coefficients in zigzag order of each component of a progressive file without subsampling, bit by bit."""
    at, tables, every, comps, out = 2, {}, 0, [], {}
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9:
            return out
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            while body:
                code, table, k = 2, {}, 17
                for n in range(16):
                    for _ in range(body[1 + n]):
                        table[code] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                tables[body[0]], body = table, body[k:]
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            blocks = -(-high // 8) * -(-wide // 8)
            comps = [body[6 + 3 * i] for i in range(body[5])]
            out = {c: np.zeros((blocks, 64), int) for c in comps}
        elif marker == 0xDA:
            n = body[0]
            which = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            start, stop, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            pieces, from_ = [], at
            while True:
                at = data.index(b"\xff", at)
                if data[at + 1] == 0:
                    at += 2
                elif 0xD0 <= data[at + 1] <= 0xD7:
                    pieces.append(data[from_:at])
                    at = from_ = at + 2
                else:
                    pieces.append(data[from_:at])
                    break
            for p, piece in enumerate(pieces):
                b, last, run = Bits(piece), dict.fromkeys(comps, 0), 0
                for i in range(p * every, min((p + 1) * every, blocks)) if every else range(blocks):
                    for c, t in which:
                        x = out[c][i]
                        if start == 0 and not ah:
                            last[c] += b.value(b.symbol(tables[t >> 4]))
                            x[0] = last[c] << al
                        elif start == 0:
                            x[0] |= b.one() << al
                        else:
                            run = plain_ac(b, x, start, stop, ah, al, tables[0x10 | t & 15], run)


def plain_ac(b, x, start, stop, ah, al, table, run):
    k, step = start, 1 << al

    def correct(k):
        if b.one() and not abs(x[k]) & step:
            x[k] += step if x[k] > 0 else -step

    while k <= stop and not run:
        s = b.symbol(table)
        zeros, size = s >> 4, s & 15
        if size == 0 and zeros < 15:
            run = (1 << zeros) + b.some(zeros)
            break
        new = b.value(size) * step if size else 0
        while k <= stop:
            if x[k] and ah:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                x[k] = new
                k += 1
                break
            k += 1
    if run:
        if ah:
            for j in range(k, stop + 1):
                if x[j]:
                    correct(j)
        run -= 1
    return run


def plain_write(blocks, script):
    """A file of one component, (start, stop, ah, al) scan by scan, with runs of ended blocks and without restarts."""
    dc, ac = {s: (s, 4) for s in range(12)}, {s: (s, 9) for s in range(255)}
    spec = lambda kind, table, n: M._segment(0xC4, bytes([kind]) + bytes(len(table) if i == n else 0 for i in range(1, 17)) + bytes(table))
    out = [b"\xff\xd8", M._segment(0xDB, bytes([0]) + bytes([1]) * 64), spec(0, dc, 4), spec(16, ac, 9), M._segment(0xC2, bytes([8, 0, 8]) + (8 * len(blocks)).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))]
    for start, stop, ah, al in script:
        bits = []
        put = lambda v, n: bits.extend(v >> n - 1 - i & 1 for i in range(n))  # noqa: B023, E731
        last, run, late = 0, 0, []

        def number(v):
            n = abs(v).bit_length()
            return n, v if v > 0 else v + (1 << n) - 1

        def end():
            nonlocal run, late
            if run:
                n = run.bit_length() - 1
                put(*ac[n << 4])
                put(run - (1 << n), n)
                bits.extend(late)
            run, late = 0, []

        for x in blocks:
            if start == 0:
                if ah:
                    put(int(x[0]) >> al & 1, 1)
                else:
                    now = int(x[0]) >> al
                    n, v = number(now - last)
                    put(*dc[n])
                    put(v, n)
                    last = now
                continue
            size = [abs(int(v)) >> al for v in x]
            newest = max([k for k in range(start, stop + 1) if (size[k] == 1 if ah else size[k])], default=0)
            zeros, corrections = 0, []
            for k in range(start, stop + 1):
                if not size[k]:
                    zeros += 1
                    continue
                while zeros > 15 and k <= newest:
                    end()
                    put(*ac[0xF0])
                    bits.extend(corrections)
                    zeros, corrections = zeros - 16, []
                if ah and size[k] > 1:
                    corrections.append(size[k] & 1)
                    continue
                end()
                n, v = number(size[k] if x[k] > 0 else -size[k])
                put(*ac[zeros << 4 | n])
                put(v, n)
                bits.extend(corrections)
                zeros, corrections = 0, []
            if zeros or corrections:
                run, late = run + 1, late + corrections
        end()
        bits += [1] * (-len(bits) % 8)
        data = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
        out += [M._segment(0xDA, bytes([1, 1, 0, start, stop, ah << 4 | al])), data]
    return b"".join([*out, b"\xff\xd9"])


SCRIPTS = [
    [(0, 0, 0, 0), (1, 63, 0, 0)],
    [(0, 0, 0, 1), (1, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)],
    [(0, 0, 0, 2), (1, 5, 0, 1), (0, 0, 2, 1), (6, 63, 0, 3), (6, 63, 3, 2), (1, 5, 1, 0), (6, 63, 2, 1), (6, 63, 1, 0), (0, 0, 1, 0)],
]


@pytest.mark.parametrize("script", SCRIPTS)
def test_files_of_a_plain_writer(script):
    """Runs of ended blocks, long runs of zeros and several refinements, in scripts that the writer does not use."""
    r = np.random.default_rng(len(script))
    files, want = [], []
    for density in (0.02, 0.1, 0.5, 1.0):
        blocks = np.where(r.random((23, 64)) < density, r.integers(-120, 121, (23, 64)), 0)
        blocks[5:12, 1:] = 0
        files.append(plain_write(blocks, script))
        want.append(blocks)
    for f, blocks in zip(files, want, strict=True):
        assert (plain_read(f)[1] == blocks).all()
    images, coefs = M.read(files)
    for image, blocks in zip(images, want, strict=True):
        assert (coefs[image.rows[0] : image.rows[0] + len(blocks)] == blocks).all()


def test_the_writer_by_a_plain_reader():
    r = np.random.default_rng(8)
    for payload in (r.integers(0, 256, 192 * 5, dtype=np.uint8).tobytes(), b"Some text, as it is stored. " * 20 + b" " * 16):
        payload += b" " * (-len(payload) % 192)
        found = plain_read(M.write([payload])[0])
        assert (np.stack([found[c] for c in (1, 2, 3)], 1) + 128).astype(np.uint8).tobytes()[: len(payload)] == payload
