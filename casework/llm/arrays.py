"""Words, hashes and lines of many texts at once, as numpy arrays inside a task.

A block of texts is one run of bytes with offsets, so the cost is per byte and not per row. All
hashes are 64 bits, computed modulo 2**64, and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20  # texts worked on together; a longer text is a block of its own
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that powers can be undone
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _table(n: int, base: int = _BASE, inverse: int = _INVERSE) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse."""
    for b in (base, inverse):
        if len(_powers.get(b, ())) < n:
            steps = np.full(max(n, BLOCK_BYTES) + 1, b, np.uint64)
            steps[0] = 1
            _powers[b] = np.cumprod(steps)
    return [_powers[base], _powers[inverse]]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the inclusive ranges."""
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


class Block:
    """Some texts: ``data`` are their bytes, text i lies at ``at[i]:at[i + 1]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first = data, at, first

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self, inside: np.ndarray, fold: np.ndarray = SAME) -> "Words":
        return Words(self, inside, fold)


class Words:
    """Runs of the bytes in ``inside``; ``of[i]:of[i + 1]`` are the words of text i.

    ``inside`` holds a flag per value of a byte, or if ``masked`` one per byte of the block.
    """

    def __init__(self, block: Block, inside: np.ndarray, fold: np.ndarray, masked: bool = False):
        data, at = block.data, block.at
        is_in = inside if masked else inside[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = is_in[:-1], is_in[1:]
        edges = at[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(is_in & ~before)
        self.end = np.flatnonzero(is_in & ~after) + 1
        self.of = np.searchsorted(self.start, at)
        powers, inverse = _table(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that run past their text are garbage."""
        return runs(self.hash, k)


class Prefix:
    """Hashes of any stretch of the bytes in constant time."""

    def __init__(self, data: np.ndarray, base: int = _BASE, inverse: int = _INVERSE):
        powers, self.inverse = _table(len(data) + 1, base, inverse)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each item on, in order; the last k - 1 items have none."""
    n = max(0, len(hashes) - k + 1)
    out, step = np.full(n, k, np.uint64), np.uint64(_STEP)
    for j in range(k):
        out = out * step + hashes[j : j + n]
    return mix(out)


def sequence(hashes: np.ndarray) -> int:
    """Hash of a whole sequence of any length."""
    powers = _table(len(hashes) + 1)[0]
    total = (hashes * powers[: len(hashes)]).sum(dtype=np.uint64) if len(hashes) else np.uint64(0)
    return mix(np.array([total + np.uint64(len(hashes))], np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def blocks(texts: pa.Array) -> Iterator[Block]:
    """Texts in blocks of bounded bytes; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(at, at[low] + BLOCK_BYTES, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield Block(data[at[low] : at[high]], at[low : high + 1] - at[low], low)
        low = high


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per row."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))
