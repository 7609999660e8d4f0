"""Encode texts chunk by chunk, each different chunk once per worker.

A chunk is a run of white space and the run of other bytes after it. The caller
says which bytes count as white space, so that no token spans two chunks: the ids of a text are those of its chunks in a row.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

import numpy as np

from larder.llm import kernel

KNOWN_CHUNKS = 1_500_000  # a worker that has this many starts anew; results do not depend on it


# Letters that tokenizers may count as white space too.
_WIDE_SPACES = [c.encode() for c in map(chr, [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029,
                                              0x202F, 0x205F, 0x3000, 0xFEFF])]
_WIDE_ENDS = np.zeros(256, bool)
_WIDE_ENDS[[c[-1] for c in _WIDE_SPACES]] = True


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of a pool, one after the other."""
    before = np.cumsum(lengths) - lengths
    return pool[np.arange(lengths.sum()) - np.repeat(before, lengths) + np.repeat(starts, lengths)]


def spans(text: kernel.Text, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks; ``breaks`` flags the bytes that are white space here."""
    n = len(text.data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = breaks[text.data]
    begins = np.zeros(n + 1, bool)
    begins[1:n] = space[1:] & ~space[:-1]
    at = np.flatnonzero(begins)
    at = at[_WIDE_ENDS[text.data[at - 1]]]
    for wide in _WIDE_SPACES:  # no chunk begins right after one
        last = text.data[at - 1] == wide[-1]
        for back in range(2, len(wide) + 1):
            last &= text.data[np.maximum(at - back, 0)] == wide[-back]
        if last.any():
            begins[at[last]] = False
    begins[text.offsets] = True
    begins[n] = False
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether all pieces of ``a`` are those of ``b``, eight bytes at a time; both have eight spare bytes at their ends."""
    a_words, b_words = (np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (a, b))
    left, step = np.arange(len(sizes)), 0
    while len(left) and step < 256:
        size = np.minimum(sizes[left] - step, 8).astype(np.uint64)
        unused = (np.uint64(8) - size) * np.uint64(8)
        if ((a_words[a_at[left] + step] ^ b_words[b_at[left] + step]) << unused).any():
            return False
        step += 8
        left = left[sizes[left] > step]
    return all(np.array_equal(a[a_at[k] : a_at[k] + sizes[k]], b[b_at[k] : b_at[k] + sizes[k]]) for k in left)


_learned: weakref.WeakSet[Memory] = weakref.WeakSet()  # by this worker


def forget() -> None:
    """Give back what this worker has learned: Spark lets it do other work next, for which the chunks would only take room."""
    for memory in _learned:
        memory.clear()


class Memory:
    """The ids of the chunks seen so far, by hash; the bytes of a chunk are compared with those it was learned from."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], breaks: np.ndarray = kernel.SPACE, most: int = KNOWN_CHUNKS) -> None:
        self.encode = encode
        self.breaks = breaks
        self.most = most
        self.clear()
        _learned.add(self)

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.ids_at, self.ids_many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes_at, self.bytes_many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pools = {"ids": np.zeros(1 << 16, np.int32), "bytes": np.zeros(1 << 18, np.uint8)}
        self.used = {"ids": 0, "bytes": 0}

    def _append(self, pool: str, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where each of the pieces begins in the pool."""
        used, old = self.used[pool], self.pools[pool]
        if used + len(values) + 8 > len(old):  # some bytes to spare at the end
            self.pools[pool] = old = np.concatenate([old, np.zeros(max(len(values) + 8, len(old)), old.dtype)])
        old[used : used + len(values)] = values
        self.used[pool] = used + len(values)
        return used + np.cumsum(lengths) - lengths

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        ids = self.encode([p.decode() for p in pieces])
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids_at = self._append("ids", np.fromiter((x for one in ids for x in one), np.int32, many.sum()), many)
        bytes_at = self._append("bytes", np.frombuffer(b"".join(pieces), np.uint8), sizes)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.ids_at, self.ids_many = np.insert(self.ids_at, at, ids_at), np.insert(self.ids_many, at, many)
        self.bytes_at, self.bytes_many = np.insert(self.bytes_at, at, bytes_at), np.insert(self.bytes_many, at, sizes)

    def ids(self, text: kernel.Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        starts, ends = spans(text, self.breaks)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(text.rows, np.int64)
        keys, first, place = np.unique(text.hashes(starts, ends), return_index=True, return_inverse=True)
        new = ~kernel.contains(self.keys, keys)
        if new.any() and len(self.keys) + new.sum() > self.most:
            self.clear()
            new[:] = True
        if new.any():
            raw = text.data.tobytes()
            self.learn(keys[new], [raw[starts[k] : ends[k]] for k in first[new]])
        at = np.searchsorted(self.keys, keys)[place]
        sizes = self.bytes_many[at]
        spare = np.concatenate([text.data, np.zeros(8, np.uint8)])
        if not (np.array_equal(sizes, ends - starts) and same_bytes(spare, starts, self.pools["bytes"], self.bytes_at[at], sizes)):
            return self._plain(text, starts, ends)
        lengths = self.ids_many[at]
        counts = np.bincount(text.row_of(starts), lengths, text.rows).astype(np.int64)
        return gather(self.pools["ids"], self.ids_at[at], lengths), counts

    def _plain(self, text: kernel.Text, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, for texts in which two chunks share one."""
        raw = text.data.tobytes()
        pieces = [raw[s:e] for s, e in zip(starts, ends)]
        different = list(dict.fromkeys(pieces))
        known = dict(zip(different, self.encode([p.decode() for p in different])))
        counts = np.bincount(text.row_of(starts), [len(known[p]) for p in pieces], text.rows).astype(np.int64)
        return np.fromiter((x for p in pieces for x in known[p]), np.int32, counts.sum()), counts
