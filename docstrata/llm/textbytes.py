"""Vectorised views of text columns as UTF-8 bytes: words, and polynomial hashes of byte ranges.

Word separators are the ASCII bytes 0x20 and 0x09-0x0D. They never occur inside a multi-byte UTF-8 character,
so words found on bytes are the words found on characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows (one more than rows). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def zipped(column: pa.Array) -> pa.Array:
    """Each text compressed, behind its number of bytes; null stays null."""
    codec = pa.Codec("zstd", compression_level=1)
    raw = (x.as_buffer() if x.is_valid else None for x in column)
    return pa.array([None if x is None else x.size.to_bytes(4, "little") + codec.compress(x, asbytes=True) for x in raw], pa.binary())


def unzipped(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """As text_bytes, of texts that ``zipped`` compressed."""
    codec, out, sizes = pa.Codec("zstd"), [], []
    for x in column:
        raw = x.as_buffer() if x.is_valid else b""
        sizes.append(int.from_bytes(bytes(raw[:4]), "little"))
        if sizes[-1]:
            out.append(codec.decompress(raw[4:], sizes[-1], asbytes=True))
    return np.frombuffer(b"".join(out), np.uint8), np.append(0, np.cumsum(np.array(sizes, np.int64)))


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per row the number of the first word (one more than rows).

    ``outside`` says of each byte value whether it separates words.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~outside[data]
    starts_here = inside[1:] & ~inside[:-1]
    ends_here = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    split = cuts[inside[cuts] & inside[cuts + 1]]
    starts_here[split] = ends_here[split] = True
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: np.uint64, n: int) -> np.ndarray:
    found = _powers.get(str(base))
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        found = np.multiply.accumulate(steps)
        if n <= 1 << 23:  # longer ones are for one very long row and are not kept
            _powers[str(base)] = found
    return found[:n]


class RangeHash:
    """Polynomial (Rabin-Karp) hashes modulo 2^64 of any ranges of one array of values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_UNBASE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    h = RangeHash(_VALUE[data])(starts, ends)
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """hash_bytes of every range of ``gram`` bytes."""
    h = RangeHash(_VALUE[data])
    n = len(data) - gram + 1
    return mixed((h.sums[gram:] - h.sums[:n]) * h.back[:n] + np.uint64(gram * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ (np.uint32(0xEDB88320) * (t & 1))
    return t


_CRC = _crc_table()


def crc32_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, together: int = 64) -> np.ndarray:
    """The crc32 of each byte range: up to ``together`` bytes for all ranges at once, longer ones one by one."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, longest = starts[order], sizes[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(min(together, int(longest[0]) if len(longest) else 0)):
        n = int(np.searchsorted(-longest, -j, "left"))  # ranges of more than j bytes
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + j]) & 255] ^ (crc[:n] >> 8)
    crc = ~crc
    for k in range(int(np.searchsorted(-longest, -together, "left"))):
        crc[k] = zlib.crc32(data[at[k] : at[k] + longest[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in order, by sorting: much faster than a hash table for many keys."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges source[start : start + length], one after the other."""
    total = int(lengths.sum())
    if not total:
        return source[:0]
    begins = np.cumsum(lengths) - lengths
    return source[np.arange(total) + np.repeat(starts - begins, lengths)]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and row offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
