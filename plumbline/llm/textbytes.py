"""Small vectorised helpers over the UTF-8 bytes of Arrow string batches.

They work on slices of a few megabytes, so a task's memory does not depend on the size of its
partition, only on its longest single text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: The separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, factor, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads polynomial hashes evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers buf[:i]."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each buf[start:end]."""
    _, down = powers(len(running))
    return (running[end] - running[start]) * down[start]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, row count, bytes, offsets) over a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi - lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(lowered: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, which never crosses a text, and the first word of each text."""
    n = len(lowered)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~separator[lowered]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed by eights; the rest of longer words goes through BLAKE2.
_BY_EIGHTS = 64


def word_hashes(lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time, mixed one after another, so no polynomial identity makes two words alike."""
    size = end - start
    out = mix(size.astype(np.uint64) * _BASE)
    padded = np.concatenate([lowered, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(lowered) + 1,), "<u8", padded.data, 0, (1,))
    live = np.flatnonzero(size > 0)
    for at in range(0, _BY_EIGHTS, 8):
        if not len(live):
            return out
        left = size[live] - at
        out[live] = mix((out[live] ^ (eight[start[live] + at] & _HEAD[np.minimum(left, 8)])) * _BASE)
        live = live[left > 8]
    for i in live:
        rest = hashlib.blake2b(lowered[start[i] + _BY_EIGHTS : end[i]].tobytes(), digest_size=8)
        out[i] = out[i] ^ np.uint64(int.from_bytes(rest.digest(), "little"))
    return out


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and position within the row for each of the counted items."""
    counts = np.asarray(counts, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
