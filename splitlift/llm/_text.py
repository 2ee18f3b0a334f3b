"""Words and their 64-bit hashes for a batch of texts, as numpy arrays.

Helpers for the Arrow stages: a text column of a record batch is one byte buffer
with offsets, so words of all its texts are found and hashed at once. White
space is 0x20 and 0x09-0x0D, lower-casing touches A-Z only; both are bytes in
UTF-8, so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 2 << 20  # text handled at once; a longer text is handled alone

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so its powers never vanish


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base (kept per worker, grown on demand)."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, U(_BASE)))])
    return _powers[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text: (rows, bytes, offsets)."""
    if not batch.num_rows:
        return
    raw, offs = buffers(batch.column(batch.schema.get_field_index(text_col)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield (batch.slice(first, last - first), raw[offs[first]:offs[last]],
               offs[first:last + 1] - offs[first])
        first = last


class Words:
    """Words of some texts: ``row`` (text of each word), ``start``, ``end`` (bytes),
    ``first`` (index of each text's first word; one more entry at the end)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False,
                 space: np.ndarray = _SPACE):
        self.raw = _LOWER[raw] if lower else raw
        n = len(offsets) - 1
        gap = np.ones(len(raw) + 1, bool)
        gap[:-1] = space[raw]
        begins = ~gap[:-1]
        begins[1:] &= gap[:-2]
        inner = offsets[1:-1]
        inner = inner[inner < len(raw)]  # a text's first byte starts a word too
        begins[inner] = ~gap[:-1][inner]
        ends = ~gap[:-1] & gap[1:]
        cuts = offsets[1:]
        cuts = cuts[cuts > 0] - 1
        ends[cuts] = ~gap[:-1][cuts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.raw, self.start, self.end)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans (non-empty): a polynomial of the bytes, mixed."""
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    heads = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(int(size.sum())) - np.repeat(heads, size)
    value = _BYTE[raw[within + np.repeat(start, size)]] * powers(int(size.max()))[within]
    return mix(np.add.reduceat(value, heads) + size.astype(U))


def gram_hashes(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` consecutive words of one text, and the index of
    the first word of each run."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    p = powers(k)
    total = words[:m] * p[0]
    for j in range(1, k):
        total = total + words[j:j + m] * p[j]
    inside = np.flatnonzero(row[:m] == row[k - 1:])
    return mix(total[inside] + U(k)), inside
