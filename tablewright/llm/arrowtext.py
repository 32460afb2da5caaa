"""Words and shingles of Arrow text columns, by numpy over the UTF-8 buffers.

Helpers of the operators in this package that read whole texts in
``mapInArrow`` tasks. A batch is walked in slices of about ``SLICE`` bytes
(a longer text is a slice of its own), so the arrays of a task stay a small
multiple of one slice whatever the batch holds. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte as it is.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_MASK = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 8)] + [2**64 - 1], dtype=np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection, so equal stays equal)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls are empty."""
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    width = np.int64 if str(column.type).startswith("large") else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off.astype(np.int64), body


def slices(column: pa.Array, limit: int = SLICE, lower: bool = True):
    """Yield ``(first row, end row, bytes, offsets into them)`` of about
    ``limit`` bytes each, lower-cased A-Z unless ``lower`` is false."""
    off, body = raw(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        part = body[off[at]:off[end]]
        yield at, end, LOWER[part] if lower else part, off[at:end + 1] - off[at]
        at = end


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray):
    """``(starts, ends, first)``: byte spans of all words, and the index of
    each row's first word (one entry more than rows). No word crosses rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[buf]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = off[:-1][np.diff(off) > 0]
    opens[full] = inside[full]
    last = off[1:][np.diff(off) > 0] - 1
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, off)


def eights(buf: np.ndarray) -> np.ndarray:
    """For each byte position, it and the seven after it as one integer."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a step."""
    view, size = eights(buf), ends - starts
    h = mix(size.astype(np.uint64) * _GOLDEN ^ (view[starts] & _MASK[np.minimum(size, 8)]))
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest):
        left = np.minimum(size[rest] - done, 8)
        h[rest] = mix(h[rest] * _GOLDEN + (view[starts[rest] + done] & _MASK[left]))
        done += 8
        rest = rest[size[rest] > done]
    return h


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (rows not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _GOLDEN + words[j:n + j]
    return mix(h)


def seed(h: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-th derived hash of 64-bit hashes."""
    return mix(h + np.uint64((n * 0xD1B54A32D192ED03) % 2**64))
