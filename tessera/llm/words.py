"""Vectorised words of Arrow text columns.

Texts arrive as Arrow string arrays, whose UTF-8 bytes lie side by side. Words end at ASCII blanks only, so words, lines
and n-grams are found on the bytes with numpy, for many documents at once and whole texts of any length. Hashes are 64-bit
polynomials of the bytes, finished by a mixing step; they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer single text is handled by itself), and of words hashed at once.
CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 18

U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(GOLDEN)) | U(1)


BYTE_VALUE = constants(256, 1)
PLACE = constants(64, 2)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    up, down = np.full(n, BASE, U), np.full(n, BASE_INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; the spans are in order and don't overlap."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SEGMENT_BYTES, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        size = 1 << max(18, (high - low).bit_length())
        up, down = powers(size) if size <= SEGMENT_BYTES * 2 else powers.__wrapped__(size)
        total = np.zeros(high - low + 1, U)
        np.cumsum(BYTE_VALUE[data[low:high]] * up[: high - low], out=total[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(GOLDEN))
        a = b
    return out


class Texts:
    """Texts of one chunk: ``data`` bytes, ``offsets`` of each text, words with their ``starts``, ``ends`` and ``hashes``.

    ``first[i]:first[i + 1]`` are the words of text i. A null text is empty.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        _, where, body = column.buffers()
        self.offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(body, np.uint8)[self.offsets[0] : self.offsets[-1]] if body is not None else np.empty(0, np.uint8)
        self.offsets = self.offsets - self.offsets[0]
        self.data = LOWER[data] if lower else data
        inside = IS_WORD[self.data]
        cut = self.offsets[1:-1]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[cut[cut < len(inside)]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of n words inside one text, in order."""
        return grams(self.hashes, self.first, n)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first word) of every run of n hashes that lies inside one text."""
    if len(hashes) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts)[: len(hashes) - n + 1] - np.arange(len(hashes) - n + 1)
    at = np.flatnonzero(left >= n)
    total = np.zeros(len(at), U)
    for k in range(n):
        total += hashes[at + k] * PLACE[k]
    return mix(total + U(n)), at


def chunks(batch: pa.RecordBatch, column: str | int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most ``size`` bytes of text in a column, or one row."""
    if not batch.num_rows:
        return
    lengths = batch.column(column).cast(pa.large_binary())
    ends = np.cumsum(np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def unique_per_text(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, ordered by owner and hash."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], owner[keep]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.astype(U, copy=False).view(np.int64)
