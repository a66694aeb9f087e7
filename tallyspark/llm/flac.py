"""Media columns: FLAC streams written and read in numpy (operator 8).

The writer makes mono 8-bit streams with fixed-size blocks.  Each block takes the cheapest of a
constant, verbatim, fixed-predictor or one-tap linear-predictor subframe with a Rice-coded residual.
STREAMINFO carries the MD5 of the samples, a SEEKTABLE one point (first sample, byte offset, number
of samples) for every block, each header a CRC-8 and each frame a CRC-16.

The reader finds blocks by their seek points, verifies every checksum and the MD5, and decodes the
Rice codes of many blocks in lockstep: one step reads one code of every block.  ``read_block`` gives
one block's samples from its seek point alone.

Both work on at most ``PIECE`` bytes at a time, of one text or of several, so a long text costs its
own size a few times and no more; streams of over ``MOST_POINTS`` blocks take longer blocks, as a seek
table has room for no more points.  Of two equally cheap subframe kinds the first is taken.

Nulls and odd input: a null or empty text is one row of 192 spaces; a null key is a value like any
other; equal texts give equal streams whatever else is in the batch; a damaged stream raises
``ValueError``; equal rows are separate rows; other columns, whatever their names, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, utf8_column

BLOCK = 1152
UNIT = 192
RATE = 8000
#: Payload bytes that are coded at a time; bounds a task's memory.
PIECE = 1 << 20
#: Seek points of a table, whose length has 24 bits, and the blocks of longer streams.
MOST_POINTS = 900_000
LONG_BLOCK = 16 * BLOCK
_LPC_SHIFT, _LPC_BITS = 6, 8
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
_FIXED = {0: (0, 0), 1: (1, 0), 2: (2, -1)}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8 = bytes(_crc_table(0x07, 8).tolist())


class _Crc16:
    """CRC-16 (0x8005) of many frames at once: each byte's share depends on its distance to the end."""

    def __init__(self):
        self.base = _crc_table(0x8005, 16)
        self.shares = self.base[None, :]

    def __call__(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        need = int(size.max(initial=1))
        if len(self.shares) < need:
            rows = [self.shares[-1]]
            for _ in range(need - len(self.shares)):
                t = rows[-1]
                rows.append((t << np.uint16(8)) ^ self.base[t >> np.uint16(8)])
            self.shares = np.concatenate([self.shares, np.array(rows[1:], np.uint16)])
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.arange(int(size.sum())) + np.repeat(start - first, size)
        left = np.repeat(start + size - 1, size) - at
        return np.bitwise_xor.reduceat(self.shares[left, raw[at]], first)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room >>= 1
    return bytes([((0xFF00 >> (len(tail) + 1)) & 0xFF) | n, *reversed(tail)])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    if b < 0x80:
        return b, at + 1
    more = 0
    while b & (0x40 >> more):
        more += 1
    n = b & (0x3F >> more)
    for x in data[at + 1 : at + 1 + more]:
        n = n << 6 | (x & 0x3F)
    return n, at + 1 + more


def block_size(size: int) -> int:
    return BLOCK if size <= BLOCK * MOST_POINTS else LONG_BLOCK


def _header(number: int, n: int) -> bytes:
    code, extra = (3, b"") if n == BLOCK else (7, struct.pack(">H", n - 1))
    h = bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1]) + _number(number) + extra
    return h + bytes([_crc8(h)])


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _tokens(x: np.ndarray):
    """How to write blocks ``x`` (frames, n): (rows with a Rice-coded residual, their fields as
    (value, bits, zeros before), rows that are constant); the other rows are verbatim."""
    f, n = x.shape
    r1 = np.diff(x, axis=1, prepend=0)
    a = np.einsum("ij,ij->i", x[:, 1:], x[:, :-1])
    e = np.maximum(np.einsum("ij,ij->i", x, x), 1)
    coef = np.clip((a.astype(np.int64) << _LPC_SHIFT) // e, -127, 127).astype(np.int32)
    rl = x.copy()
    rl[:, 1:] -= (coef[:, None] * x[:, :-1]) >> _LPC_SHIFT
    kinds = [(_fold(x), 0, 8), (_fold(r1), 1, 9), (_fold(np.diff(r1, axis=1, prepend=0)), 2, 10), (_fold(rl), 1, 32)]
    cost, ks = [], []
    for u, order, kind in kinds:
        total = u[:, order:].sum(1, dtype=np.int64)
        m = n - order
        k = np.zeros(f, np.int64)
        for j in range(1, 15):
            k[total > (m << j) * 0.75] = j
        ks.append(k)
        cost.append(8 * order + 10 + m * (k + 1) + (total >> k) + (17 if kind >= 32 else 0))
    cost, ks = np.array(cost), np.array(ks)
    pick = cost.argmin(0)
    constant = (x == x[:, :1]).all(1)
    rice = np.flatnonzero(~constant & (cost[pick, np.arange(f)] < 8 * n))
    pick = pick[rice]
    g = len(rice)
    k = ks[pick, rice].astype(np.int32)[:, None]
    order, kind = np.array([o for _, o, _ in kinds])[pick], np.array([t for _, _, t in kinds])[pick]
    u = np.empty((g, n), np.int32)
    for j, (v, _, _) in enumerate(kinds):
        u[pick == j] = v[rice[pick == j]]
    value, bits, zeros = (np.zeros((g, 6 + n), np.int32) for _ in range(3))
    value[:, 6:], bits[:, 6:], zeros[:, 6:] = (1 << k) | (u & ((1 << k) - 1)), k + 1, u >> k
    for w in range(2):
        late = order > w
        bits[late, 6 + w] = zeros[late, 6 + w] = value[late, 6 + w] = 0
        value[late, 1 + w], bits[late, 1 + w] = x[rice[late], w] & 255, 8
    value[:, 0], bits[:, 0] = kind << 1, 8
    lpc = pick == 3
    value[lpc, 3], bits[lpc, 3] = (_LPC_BITS - 1) << 5 | _LPC_SHIFT, 9
    value[lpc, 4], bits[lpc, 4] = coef[rice[lpc]] & 255, _LPC_BITS
    value[:, 5], bits[:, 5] = k[:, 0], 10
    return rice, (value, bits, zeros), constant


_crc16 = None


def _crc():
    global _crc16
    _crc16 = _crc16 or _Crc16()
    return _crc16


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload; a payload is unsigned 8-bit samples."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    group, held = [], 0

    def code() -> None:
        for (d, _, _, _), (data, own) in zip(group, _coded([g[1:] for g in group]), strict=True):
            frames[d].append(data)
            sizes[d].append(own)
        group.clear()

    for d, p in enumerate(payloads):
        block = block_size(len(p))
        step = max(PIECE // block, 1) * block
        for a in range(0, len(p), step):
            if held + min(step, len(p) - a) > PIECE and group:
                code()
                held = 0
            group.append((d, memoryview(p)[a : a + step], a // block, block))
            held += min(step, len(p) - a)
    if group:
        code()
    return [_stream(p, f, np.concatenate(s) if s else np.zeros(0, np.int64)) for p, f, s in zip(payloads, frames, sizes, strict=True)]


def _stream(payload: bytes, frames: list[bytes], own: np.ndarray) -> bytes:
    """The file: marker, STREAMINFO, SEEKTABLE, frames of ``own`` bytes each."""
    block, md5 = block_size(len(payload)), hashlib.md5()
    for a in range(0, len(payload), PIECE):
        md5.update((np.frombuffer(payload, np.uint8, min(PIECE, len(payload) - a), a) ^ 0x80).tobytes())
    info = struct.pack(">HH", block, block) + int(own.min(initial=0)).to_bytes(3, "big") + int(own.max(initial=0)).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5.digest()
    points = np.zeros(len(own), _POINT)
    points["sample"] = np.arange(len(own)) * block
    points["offset"] = np.cumsum(own) - own
    points["n"] = np.minimum(block, len(payload) - np.arange(len(own)) * block)
    seek = points.tobytes()
    return b"".join([b"fLaC", b"\x00\x00\x00\x22", info, b"\x83" + len(seek).to_bytes(3, "big"), seek, *frames])


def _coded(chunks: list[tuple[memoryview, int, int]]) -> list[tuple[bytes, np.ndarray]]:
    """(frames, their sizes) of each chunk: samples, the number of its first block, samples of a block."""
    sizes = np.array([len(c) for c, _, _ in chunks], np.int64)
    blocks = np.array([b for _, _, b in chunks], np.int64)
    counts = -(-sizes // blocks)
    raw = np.frombuffer(b"".join(c for c, _, _ in chunks), np.uint8)
    owner = np.repeat(np.arange(len(chunks)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    inside = np.arange(len(owner)) - first[owner]
    number = inside + np.array([k for _, k, _ in chunks], np.int64)[owner]
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))[owner] + inside * blocks[owner]
    n = np.minimum(blocks[owner], sizes[owner] - inside * blocks[owner])
    heads = [_header(i, m) for i, m in zip(number.tolist(), n.tolist(), strict=True)]
    coded, plain = [], []
    body = n + 1
    for m in np.unique(n).tolist():
        rows = np.flatnonzero(n == m)
        x = raw[begin[rows][:, None] + np.arange(m)].astype(np.int32) - 128
        rice, (value, bits, zeros), constant = _tokens(x)
        end = np.cumsum(bits + zeros, axis=1, dtype=np.int32)
        body[rows[constant]] = 2
        body[rows[rice]] = (end[:, -1] + 7) >> 3
        coded.append((rows[rice], value, bits, end))
        verbatim = np.ones(len(rows), bool)
        verbatim[rice] = verbatim[constant] = False
        plain.append((rows[constant], None))
        plain.append((rows[verbatim], (x[verbatim] & 255).astype(np.uint8)))
    h = np.array([len(x) for x in heads], np.int64)
    size = h + body + 2
    at = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    total = int(size.sum())
    flat = np.zeros(total, np.uint8)
    values, lasts = [], []
    for rows, value, bits, end in coded:
        some = bits > 0
        lasts.append((end.astype(np.int64) + (((at + h)[rows] + 2) * 8 - 1)[:, None])[some])
        values.append(value[some])
    if values:
        last, v = np.concatenate(lasts), np.concatenate(values)
        v <<= (7 - (last & 7)).astype(np.int32)
        byte = last >> 3
        for back in range(3):
            flat += np.bincount(byte - back, weights=(v >> (8 * back)) & 255, minlength=total + 2)[2:].astype(np.uint8)
    for rows, x in plain:
        if x is None:
            flat[(at + h)[rows] + 1] = raw[begin[rows]] ^ 0x80
        else:
            flat[(at + h)[rows]] = 2
            flat[((at + h)[rows] + 1)[:, None] + np.arange(x.shape[1])] = x
    for i, x in zip(at.tolist(), heads, strict=True):
        flat[i : i + len(x)] = np.frombuffer(x, np.uint8)
    if len(at):
        crc = _crc()(flat, at, size - 2)
        flat[at + size - 2], flat[at + size - 1] = crc >> 8, crc & 255
    data, out = flat.tobytes(), []
    for k, c in zip(first.tolist(), counts.tolist(), strict=True):
        own = size[k : k + c]
        out.append((data[int(at[k]) : int(at[k] + own.sum())], own))
    return out


def seek_points(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, seek points, where the frames begin) of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, total, md5 = 4, False, None, 0, b""
    while not last:
        kind, last, size = stream[at] & 0x7F, bool(stream[at] & 0x80), int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            total, md5 = packed & ((1 << 36) - 1), block[18:34]
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("only mono 8-bit streams are read")
        elif kind == 3:
            points = np.frombuffer(block, _POINT)
        at += 4 + size
    if points is None:
        raise ValueError("the stream has no seek table")
    return total, md5, points, at


def _decoded(data: bytes, start: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples of frames in the order of ``data``, one after another, after their checksums have been verified."""
    a = int(start[0])
    data = bytes(data[a : int(ends[-1])]) + bytes(8)
    raw, start, ends = np.frombuffer(data, np.uint8), start - a, ends - a
    found = _crc()(raw, start, ends - start - 2)
    if (found != (raw[ends - 2].astype(np.uint16) << 8 | raw[ends - 1])).any():
        raise ValueError("a frame's CRC-16 does not match")
    x = _frames(data, raw, start, n)
    return x.T[np.arange(x.shape[0]) < n[:, None]].astype(np.int8)


def _bounds(stream: bytes, points: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = points["offset"].astype(np.int64) + at
    return start, np.append(start[1:], len(stream)), points["n"].astype(np.int64)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads, after all checksums have been verified."""
    whole = []
    for s in streams:
        total, md5, points, at = seek_points(s)
        whole.append((s, total, md5, _bounds(s, points, at)))
    out: list[bytes] = []
    # Short streams are read together, a long one piece by piece.
    for i, j in slices(np.array([w[1] for w in whole]), PIECE):
        if j - i > 1:
            base = np.concatenate(([0], np.cumsum([len(w[0]) for w in whole[i:j]])))
            joined = b"".join(w[0] for w in whole[i:j])
            spans = [[v + (b if k < 2 else 0) for k, v in enumerate(w[3])] for w, b in zip(whole[i:j], base.tolist(), strict=False)]
            start, ends, n = (np.concatenate(x) for x in zip(*spans, strict=True))
            samples = _decoded(joined, start, ends, n) if len(start) else np.zeros(0, np.int8)
            cuts = np.cumsum([0, *[int(w[3][2].sum()) for w in whole[i:j]]])
            parts = [[samples[a:b]] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        else:
            s, _, _, (start, ends, n) = whole[i]
            step = max(PIECE // max(int(n.max(initial=1)), 1), 1)
            parts = [(_decoded(s, start[k : k + step], ends[k : k + step], n[k : k + step]) for k in range(0, len(start), step))]
        for (_, total, md5, _), pieces in zip(whole[i:j], parts, strict=True):
            digest, own = hashlib.md5(), []
            for x in pieces:
                digest.update(x.tobytes())
                own.append((x.view(np.uint8) ^ 0x80).tobytes())
            if sum(map(len, own)) != total or digest.digest() != md5:
                raise ValueError("the samples do not match STREAMINFO")
            out.append(b"".join(own))
    return out


def read_block(stream: bytes, sample: int) -> tuple[int, bytes]:
    """(first sample, unsigned samples) of the block that holds ``sample``, found by the seek table alone."""
    _, _, points, at = seek_points(stream)
    start, ends, n = _bounds(stream, points, at)
    k = int(np.searchsorted(points["sample"].astype(np.int64), sample, "right")) - 1
    x = _decoded(stream, start[k : k + 1], ends[k : k + 1], n[k : k + 1])
    return int(points["sample"][k]), (x.view(np.uint8) ^ 0x80).tobytes()


def _bits(data: bytes, at: int, k: int) -> int:
    end = at + k
    return (int.from_bytes(data[at >> 3 : (end + 7) >> 3], "big") >> (-end & 7)) & ((1 << k) - 1)


def _signed(v: int, k: int) -> int:
    return v - (1 << k) if v >> (k - 1) else v


def _frames(data: bytes, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples (longest block, frames) of all frames."""
    f, most = len(start), int(n.max())
    x = np.zeros((most, f), np.int32)
    bit, k, first, shift, c1, c2 = (np.zeros(f, np.int64) for _ in range(6))
    rice = np.zeros(f, bool)
    for i, (a, m) in enumerate(zip(start.tolist(), n.tolist(), strict=True)):
        _, h = _read_number(data, a + 4)
        code = data[a + 2] >> 4
        h += {6: 1, 7: 2}.get(code, 0)
        if data[a] != 0xFF or data[a + 1] != 0xF8 or _crc8(data[a:h]) != data[h]:
            raise ValueError("a frame header's CRC-8 does not match")
        b, kind = (h + 2) * 8, data[h + 1] >> 1
        if kind == 0:
            x[:m, i] = _signed(data[h + 2], 8)
            continue
        if kind == 1:
            x[:m, i] = raw[h + 2 : h + 2 + m].view(np.int8)
            continue
        order = kind & 7 if kind < 32 else (kind & 31) + 1
        if order > 2:
            raise ValueError("predictors of more than two taps are not read")
        for w in range(order):
            x[w, i] = _signed(data[h + 2 + w], 8)
        b += 8 * order
        if kind >= 32:
            width, shift[i] = _bits(data, b, 4) + 1, _bits(data, b + 4, 5)
            taps = [_signed(_bits(data, b + 9 + width * j, width), width) for j in range(order)] + [0, 0]
            c1[i], c2[i] = taps[:2]
            b += 9 + width * order
        else:
            c1[i], c2[i] = _FIXED[order]
        if _bits(data, b, 6):
            raise ValueError("only one Rice partition with four-bit parameters is read")
        rice[i], bit[i], k[i], first[i] = True, b + 10, _bits(data, b + 6, 4), order
    rows = np.flatnonzero(rice)
    rows = rows[np.argsort(-n[rows], kind="stable")]
    bit, k, first, shift, c1, c2, m = (v[rows] for v in (bit, k, first, shift, c1, c2, n))
    words = np.zeros(len(raw) - 4, np.uint32)
    for j in range(4):
        words |= raw[j : j + len(words)].astype(np.uint32) << np.uint32(24 - 8 * j)
    zeros = _leading()
    alive = np.searchsorted(-m, -np.arange(most), side="left")
    z = np.zeros((most + 2, len(rows)), np.int64)
    z[:2] = 0
    warm = x[:2, rows] if most > 1 else np.zeros((2, len(rows)), np.int32)
    simple = (first == 0).all()
    for t in range(most):
        g = int(alive[t])
        p, kk = bit[:g], k[:g]
        w = (words[p >> 3] << (p & 7).astype(np.uint32)).astype(np.int64) & 0xFFFFFFFF
        q = zeros[w >> 16].astype(np.int64)
        r = (w >> (31 - q - kk)) & ((1 << kk) - 1)
        odd = q + kk > 23
        length = q + kk + 1
        if odd.any():
            for i in np.flatnonzero(odd).tolist():
                a = int(p[i])
                while not _bits(data, a, 1):
                    a += 1
                q[i], r[i] = a - int(p[i]), _bits(data, a + 1, int(kk[i])) if kk[i] else 0
                length[i] = q[i] + kk[i] + 1
        u = q << kk | r
        v = (u >> 1) ^ -(u & 1)
        if t < 2 and not simple:
            held = first[:g] > t
            length[held] = 0
            v = np.where(held, warm[t, :g], v + ((c1[:g] * z[t + 1, :g] + c2[:g] * z[t, :g]) >> shift[:g]))
        else:
            v = v + ((c1[:g] * z[t + 1, :g] + c2[:g] * z[t, :g]) >> shift[:g])
        bit[:g] += length
        z[t + 2, :g] = v
    x[:, rows] = z[2:]
    return x


_lz = None


def _leading() -> np.ndarray:
    """Leading zeros of every 16-bit number; 32 marks zero, which takes the slow path."""
    global _lz
    if _lz is None:
        v = np.arange(1, 1 << 16)
        _lz = np.concatenate(([32], 15 - np.floor(np.log2(v)).astype(np.int64)))
    return _lz


def padded(b: bytes) -> bytes:
    """``b`` with spaces to a positive multiple of ``UNIT``."""
    return b + b" " * ((-len(b)) % UNIT or (0 if b else UNIT))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(length unpadded, padded bytes)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), padded(b)


def feature(payload: bytes) -> str:
    """Energy, sign changes and peak of the samples, in integers."""
    energy = turns = peak = 0
    for a in range(0, len(payload), PIECE):
        b = max(a - 1, 0)  # one sample over, for the sign change between pieces
        s = (np.frombuffer(payload, np.uint8, min(PIECE + a - b, len(payload) - b), b) ^ 0x80).view(np.int8).astype(np.int64)
        turns += int(((s[1:] ^ s[:-1]) < 0).sum())
        s = s[a - b :]
        energy, peak = energy + int((s * s).sum()), max(peak, int(np.abs(s).max()))
    return f"energy={energy};turns={turns};peak={peak}"


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text", media: bool = False) -> DataFrame:
    """Write each text as a FLAC stream, read the stream back and describe what was read.

    ``n_blocks`` and ``seek_sha256`` describe the PCM blocks: their number, and a digest of their lines
    ``first sample,byte offset,samples``.  With ``media`` the stream and the blocks themselves follow."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            raw, off = utf8_column(b.column(1))
            n = np.diff(off)
            for i, j in slices(n, PIECE):
                pads = [padded(raw[off[r] : off[r + 1]].tobytes()) for r in range(i, j)]
                streams = encode(pads)
                back = decode(streams)
                points = [seek_points(s)[2] for s in streams]
                lines = ["\n".join(f"{x['sample']},{x['offset']},{x['n']}" for x in p) for p in points]
                cols = {
                    "n_bytes": pa.array(n[i:j], pa.int64()),
                    "payload_bytes": pa.array([len(p) for p in back], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                    "media_bytes": pa.array([len(s) for s in streams], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                    "feature": pa.array([feature(p) for p in back]),
                    "n_blocks": pa.array([len(p) for p in points], pa.int64()),
                    "seek_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]),
                }
                if media:
                    cols["media"] = pa.array(streams, pa.binary())
                    blocks = [[{"first_sample": int(x["sample"]), "offset": int(x["offset"]), "pcm": p[int(x["sample"]) : int(x["sample"]) + int(x["n"])]} for x in q] for p, q in zip(back, points, strict=True)]
                    cols["blocks"] = pa.array(blocks, pa.list_(pa.struct([("first_sample", pa.int64()), ("offset", pa.int64()), ("pcm", pa.binary())])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols.values()], [key, *cols])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, seek_sha256 string"
    if media:
        schema += ", media binary, blocks array<struct<first_sample:bigint,offset:bigint,pcm:binary>>"
    return docs.select(key, text).mapInArrow(run, schema)


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
