"""Words of whole texts and their hashes, for one Arrow batch at a time.

A batch's texts lie in one byte buffer. Words are found by a table over byte values, so texts are
never decoded, and all of it is vector arithmetic. Work goes in pieces of about a megabyte; a longer
text is a piece of its own. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 16
PIECE = 1 << 20


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to words; the ranges are those that do not."""
    inside = np.ones(256, bool)
    for low, high in ranges:
        inside[low : high + 1] = False
    return inside


NOT_SPACE = table((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base, and of its inverse, modulo 2^64."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(n + 1, base, U64)
        factors[0] = 1
        both.append(np.cumprod(factors, dtype=U64))
    return both[0], both[1]


class Piece(NamedTuple):
    rows: pa.RecordBatch
    data: np.ndarray
    bounds: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 places where its texts begin and end."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), bounds - bounds[:1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE) -> Iterator[Piece]:
    """The batch in runs of rows whose texts have about ``most`` bytes, at least one row each."""
    if not batch.num_rows:
        return
    data, bounds = texts(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield Piece(
            batch.slice(row, end - row),
            data[bounds[row] : bounds[end]],
            bounds[row : end + 1] - bounds[row],
        )
        row = end


class Words(NamedTuple):
    """Where words start and end, and the number of the first word of each text (n + 1 numbers)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(none, none, np.zeros(len(bounds), np.int64))
    within = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = edge[:-1].copy()
    starts[1:] |= ~within[:-1]
    ends = edge[1:].copy()
    ends[:-1] |= ~within[1:]
    starts = np.flatnonzero(starts & within)
    return Words(starts, np.flatnonzero(ends & within) + 1, np.searchsorted(starts, bounds))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, from its bytes alone; blocks bound the memory."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        end = max(int(np.searchsorted(ends, base + BLOCK, "right")), at + 1)
        size = int(ends[end - 1] - base)
        up, down = powers(BLOCK) if size <= BLOCK else powers.__wrapped__(size)
        sums = np.zeros(size + 1, U64)
        np.cumsum(_BYTES[data[base : base + size]] * up[:size], out=sums[1:])
        low, high = starts[at:end] - base, ends[at:end] - base
        out[at:end] = (sums[high] - sums[low]) * down[low] + (high - low).astype(U64)
        at = end
    return mix(out)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words that begin at each word; the last k - 1 hold no full run."""

    def joined(left, n, right, m):
        out = left * U64(pow(BASE, m, 1 << 64))
        out[: max(len(out) - n, 0)] += right[n:]
        return out

    whole, n, part, m = None, 0, hashes, 1
    while k:
        if k & 1:
            whole, n = (part.copy(), m) if whole is None else (joined(whole, n, part, m), n + m)
        k >>= 1
        if k:
            part, m = joined(part, m, part, m), 2 * m
    return mix(whole + U64(n))


def fits(first: np.ndarray, k: int) -> np.ndarray:
    """For each word, whether k words from there on stay within its text."""
    return np.arange(first[-1]) + k <= np.repeat(first[1:], np.diff(first))


def owners(first: np.ndarray) -> np.ndarray:
    """The text's number for each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of a value over the words of each text."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
