"""Words of Arrow text columns, found and hashed with numpy: helpers that run inside tasks.

Delimiters are ASCII, so words are found on the UTF-8 bytes. A word's hash is a polynomial over its
bytes modulo 2**64 with random byte values, then mixed; a window's hash is one over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are hashed in blocks of about this many bytes, which bounds the work arrays.
BLOCK = 1 << 20


def _byte_table(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words that end at white space: all but x09-x0D and x20.
PLAIN = _byte_table(set(range(256)) - {9, 10, 11, 12, 13, 32})
#: Bytes of alphanumeric words of lower-cased text: digits, a-z and all beyond ASCII.
ALNUM = _byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])
#: Lower-cases A-Z, keeps the rest.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER, np.uint8)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, BLOCK)
_DOWN = _powers(_INVERSE, BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """Finisher that spreads every input bit over the output."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Texts:
    """The words of some consecutive texts: byte positions, and for each text its range of words.

    Nulls count as empty texts. ``starts[i]:ends[i]`` of ``data`` is word i; the words of text t are
    ``first[t]`` up to ``first[t + 1]``.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        if len(texts):
            at = np.frombuffer(offsets, width)[texts.offset:texts.offset + len(texts) + 1]
            at = at.astype(np.int64)
        else:
            at = np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        raw = raw[at[0]:at[-1]]
        self.data = _LOWER[raw] if lower else raw
        self.at = at - at[0]
        inside = kind[self.data]
        n = len(inside)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            edge = self.at[(self.at > 0) & (self.at < n)]
            before[edge] = False
            after[edge - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.at)

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + BLOCK, "right")))
            high = self.ends[j - 1]
            size = int(high - low)
            up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(_BASE, size), _powers(_INVERSE, size))
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(_VALUES[self.data[low:high]] * up[:size], out=total[1:])
            s, e = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = (total[e] - total[s]) * down[s]
            i = j
        return mix(out)

    def window_hashes(self, k: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all windows of ``k`` consecutive words of one text."""
        h = self.hashes() if words is None else words
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = h[:n].copy()
        for j in range(1, k):
            total *= U64(_BASE)
            total += h[j:j + n]
        last = np.repeat(self.first[1:], self.counts)[:n]
        start = np.flatnonzero(np.arange(n) + k <= last)
        return start, mix(total[start])

    def text(self, t: int) -> bytes:
        return self.data[self.at[t]:self.at[t + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in pieces of at most ``limit`` bytes of ``column``; a longer text is a piece."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(column).fill_null("").cast(pa.large_string())
    at = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + n + 1]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def job_settings(spark) -> None:
    """Fewer rows in each Arrow batch, since a row here is a whole document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
