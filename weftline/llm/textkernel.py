"""Vectorised text kernels over Arrow string buffers: words, their hashes, and hashes of windows of words.

All work is on UTF-8 bytes in slices of bounded size, so that memory does not follow the length of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text whose temporary arrays are held at once.
SLICE = 1 << 20
#: Words of up to so many times eight bytes are hashed together.
LANES = 16
#: What is left of eight bytes of which the first 0 to 8 count.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the constants of SplitMix64)."""
    x = (x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))).astype(np.uint64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_class(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Words are runs of anything but ASCII white space.
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of lower-case letters, digits and all beyond ASCII.
ALNUM = byte_class(bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122)))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string array; a null has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if off is None or len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def ranges(offs: np.ndarray, most: int = SLICE, rows: int = 1000) -> Iterator[tuple[int, int]]:
    """Cuts rows into ranges of at most ``most`` bytes and ``rows`` rows, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row number of each word; offs[0] is 0. No word crosses a row."""
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, z
    w = inside[data]
    first = offs[:-1][offs[:-1] < n]
    joins = np.empty(n, bool)  # this byte continues the word of the byte before
    joins[0] = False
    np.logical_and(w[1:], w[:-1], out=joins[1:])
    joins[first] = False
    starts = np.flatnonzero(w & ~joins)
    goes = np.empty(n, bool)
    goes[:-1] = joins[1:]
    goes[-1] = False
    ends = np.flatnonzero(w & ~goes) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


class Hasher:
    """Hashes of byte ranges and of windows of words.

    Words are read eight bytes at a time, and two registers that finalisers stir keep 128 bits from one step to the next, so
    no pattern of letters makes words meet, as patterns do in sums of powers. Longer words go to xxhash as they are."""

    def __init__(self, seed: int = 1) -> None:
        self.seed = seed
        self.step = U(int(np.random.default_rng(seed).integers(1, 2**63)) * 2 + 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, a, n = np.empty(len(starts), np.uint64), 0, len(starts)
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, side="right")))
            out[a:b] = self._lanes(data, starts[a:b], ends[a:b])
            a = b
        return out

    def _lanes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        x = mix(size.astype(np.uint64), self.seed)
        y = mix(x, 3)
        long = np.flatnonzero(size > LANES * 8)
        brief = size <= LANES * 8
        if len(long) < len(size):
            lo = int(starts[brief][0])
            raw = np.zeros(int(ends[brief][-1]) - lo + 8, np.uint8) if not len(long) else None
            if raw is None:  # the long ones' bytes are left out
                got = gather(starts[brief], size[brief])
                raw = np.zeros(len(got) + 8, np.uint8)
                raw[:-8] = data[got]
                at = np.cumsum(size[brief]) - size[brief]
            else:
                raw[:-8] = data[lo : lo + len(raw) - 8]
                at = starts - lo
            lanes = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
            todo, left = np.flatnonzero(brief), size[brief]
            for j in range(LANES):
                go = left > 0
                if not go.all():
                    todo, at, left = todo[go], at[go], left[go]
                if not len(todo):
                    break
                lane = lanes[at] & MASKS[np.minimum(left, 8)]
                u = mix(x[todo] ^ lane, 2 * j + 101)
                y[todo] = mix(y[todo] + u * U(0x9FB21C651E98DF25) + lane, 2 * j + 102)
                x[todo] = u
                at, left = at + 8, left - 8
        out = mix(x ^ (y << U(32) | y >> U(32)), 5)
        for i in long.tolist():
            out[i] = U(xxhash.xxh3_64_intdigest(memoryview(data[starts[i] : ends[i]]), self.seed))
        return out

    def windows(self, h: np.ndarray, k: int) -> np.ndarray:
        """The hash of each k consecutive word hashes."""
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        acc = h[:n].copy()
        for j in range(1, k):
            acc *= self.step
            acc += h[j : j + n]
        return mix(acc, self.seed + 1)


def gather(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... first[i] + counts[i] - 1 for each i in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array of the given row lengths."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), values)


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
