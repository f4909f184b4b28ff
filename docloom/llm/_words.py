"""Words and rolling hashes of Arrow string columns, vectorised with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; words never cross rows.
Hashes are 64-bit: a polynomial over random byte values (odd base, so prefix sums give the hash of
any range), then a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two xor-shift-multiply rounds."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, _BLOCK + 1)
        both = []
        for b in (_BASE, _INV):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _pow, _inv = both
    return _pow, _inv


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, so that fewer words are held at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and row offsets (one more than rows); null counts as empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if len(arr) and arr.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data, off


def prefix(b: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums c with hash of b[i:j] = mix((c[j] - c[i]) * inverse_power[i]); b: bytes, or hashes of words."""
    p, _ = powers(len(b) + 1)
    c = np.empty(len(b) + 1, np.uint64)
    c[0] = 0
    np.cumsum((b if b.dtype == np.uint64 else (_LOWER if lower else _TABLE)[b]) * p[: len(b)], out=c[1:])
    return c


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the index of each row's first word (one more than rows)."""
    starts, ends, hashes = [], [], []
    pos, stop_all = int(off[0]), int(off[-1])
    while pos < stop_all:
        stop = min(pos + _BLOCK, stop_all)
        if stop < stop_all:
            stop = _cut(data, off, pos, stop)
        b = data[pos:stop]
        sep = (b == 32) | (b - np.uint8(9) < 5)  # SEP[b], which takes six times as long
        inner = off[np.searchsorted(off, pos, "right") : np.searchsorted(off, stop, "left")] - pos
        before = np.empty(len(b), bool)
        before[0] = True
        before[1:] = sep[:-1]
        before[inner] = True
        after = np.empty(len(b), bool)
        after[-1] = True
        after[:-1] = sep[1:]
        after[inner - 1] = True
        s, e = np.flatnonzero(before & ~sep), np.flatnonzero(after & ~sep) + 1
        c = prefix(b, lower)
        _, inv = powers(len(b) + 1)
        hashes.append(mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64)))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = stop
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    s = cat(starts, np.int64)
    return s, cat(ends, np.int64), cat(hashes, np.uint64), np.searchsorted(s, off)


def _cut(data: np.ndarray, off: np.ndarray, pos: int, stop: int) -> int:
    """A place near stop where no word is divided."""
    row = int(off[np.searchsorted(off, stop, "right") - 1])
    at = stop
    while at > max(pos, row):  # the last one is mostly near
        at, to = max(pos, row, at - 4096), at
        back = np.flatnonzero(SEP[data[at:to]])
        if len(back):
            return at + int(back[-1]) + 1
    if row > pos:
        return row
    end = int(off[np.searchsorted(off, stop, "left")])
    while stop < end:
        ahead = np.flatnonzero(SEP[data[stop : min(stop + _BLOCK, end)]])
        if len(ahead):
            return stop + int(ahead[0])
        stop = min(stop + _BLOCK, end)
    return end


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items of h (rows not regarded)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    acc = h[:m].copy()
    for k in range(1, n):
        acc = acc * np.uint64(0xC6A4A7935BD1E995) + h[k : k + m]
    return mix(acc)


def pack(a: np.ndarray) -> bytes:
    """A numeric array, bytes transposed and compressed."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(b: bytes) -> np.ndarray:
    t = np.dtype(bytes(b[:4]).decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(t.itemsize, -1).T).reshape(-1).view(t) if len(raw) else np.zeros(0, t)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted 64-bit array as differences."""
    return pack(np.diff(a, prepend=a[:1] * 0))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def bundle(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)


def unbundle(b: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(b[: 8 * n], "<u8")
    ends = 8 * n + np.cumsum(sizes)
    return [b[int(e - s) : int(e)] for s, e in zip(sizes, ends, strict=True)]


def small(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in the least width that holds them."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_all(*arrays: np.ndarray) -> bytes:
    """Numeric arrays in one compressed frame, the bytes of each transposed."""
    head = b"".join(a.dtype.str.encode() + len(a).to_bytes(5, "little") for a in arrays)
    planes = ((np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize), k) for a in arrays if len(a) for k in range(a.itemsize))
    raw = b"".join(x[:, k].tobytes() for x, k in planes)
    return zstandard.ZstdCompressor(level=3).compress(bytes([len(arrays)]) + head + raw)


def unpack_all(b: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(b)
    out, at = [], 1 + 8 * data[0]
    for k in range(data[0]):
        h = data[1 + 8 * k : 9 + 8 * k]
        t, n = np.dtype(h[:3].decode()), int.from_bytes(h[3:], "little")
        raw = np.empty((n, t.itemsize), np.uint8)
        for i in range(t.itemsize):
            raw[:, i] = np.frombuffer(data, np.uint8, n, at)
            at += n
        out.append(raw.reshape(-1).view(t))
    return out
