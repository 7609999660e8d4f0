"""Words, lines and chunks of a whole Arrow column at once, as NumPy arrays over its bytes.

A column of texts is cut into slices of a few megabytes (one text at least), so
memory does not grow with the batch. Hashes have 64 bits: a polynomial over
random byte values, modulo 2**64, with a final mix. Equal pieces always have
equal hashes; two different ones meet by chance only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
HASH_SLICE_BYTES = 200_000  # where each byte or word gets hashes: some thirty megabytes of them at a time

_random = np.random.default_rng(20240607)
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a text column, ``most`` bytes or one text each; a missing text is empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Text:
    """The bytes of some texts; ``offsets`` has where each one starts, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        self.rows = len(offsets) - 1
        self._prefix: np.ndarray | None = None

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are ``inside``; runs end with their text."""
        n = len(self.data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each piece from a start to an end."""
        n = len(self.data)
        up, down = _powers_to(n + 1)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[self.data] * up[:n], out=self._prefix[1:])
        sums = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``size`` words of one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _BASE + hashes[i : i + n]
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return at, mix(total[at])


def per_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that also tell the rows apart."""
    return mix(hashes ^ (rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    return contains(twice, keys)


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``size`` from one of the starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:-1]) > 0


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(values.view(np.int64), pa.int64())
