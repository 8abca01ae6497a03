"""Vectorised hashing of words and byte strings inside a task.

All functions work on the bytes of many texts at once: `data` holds the texts
back to back and `offsets` where each begins, the last entry being the end. A
word is a maximal run of bytes other than blank and 0x09 to 0x0D. Hashes are
64-bit and depend on the content only, so they agree in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _inverse(odd: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    found = 1
    for _ in range(7):
        found = found * (2 - odd * found) % 2**64
    return found


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < size:
        for name, base in (("up", _BASE), ("down", _inverse(_BASE))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of `h` over the whole value."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with up to `limit` bytes of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _cuts(data: np.ndarray, offsets: np.ndarray, limit: int, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `limit` bytes that split no word."""
    at, end = 0, len(data)
    while at < end:
        upto = min(at + limit, end)
        while upto < end:
            ahead = data[upto : upto + limit]
            gap = np.flatnonzero(breaks[ahead])
            text_end = offsets[np.searchsorted(offsets, upto, "left")]
            stop = min(upto + int(gap[0]) if len(gap) else upto + len(ahead), int(text_end))
            found = len(gap) > 0 or stop == text_end
            upto = stop
            if found:
                break
        yield at, upto
        at = upto


def words_of(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and text number of every word; `breaks` tells which bytes stand between words."""
    starts, ends, hashes = [], [], []
    for low, high in _cuts(data, offsets, BLOCK_BYTES, breaks):
        part = data[low:high]
        ink = ~breaks[part]
        opens, closes = ink.copy(), ink.copy()
        opens[1:] &= ~ink[:-1]
        closes[:-1] &= ~ink[1:]
        inner = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high, "left")] - low
        opens[inner] = ink[inner]
        closes[inner - 1] = ink[inner - 1]
        first = np.flatnonzero(opens)
        last = np.flatnonzero(closes) + 1
        up, down = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * down[first]))
        starts.append(first + low)
        ends.append(last + low)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    begin = np.concatenate(starts)
    return begin, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(offsets, begin, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive entries."""
    count = max(len(hashes) - size + 1, 0)
    grams = np.zeros(count, np.uint64)
    for at in range(size):
        grams *= _STEP
        grams += hashes[at : at + count]
    return mixed(grams)


def byte_grams(part: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive bytes."""
    count = len(part) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(part))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
    return mixed((sums[size:] - sums[:count]) * down[:count])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values."""
    reach, low = 1, values
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per entry of `counts`, from that many consecutive values."""
    size = values.dtype.itemsize
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * size, out=ends[1:])
    if ends[-1] > 2**31 - 1:
        raise ValueError("a batch of packed rows exceeds 2 GB")
    return pa.Array.from_buffers(
        pa.binary(),
        len(counts),
        [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())],
    )
