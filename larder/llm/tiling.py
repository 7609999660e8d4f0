"""Benchmark decontamination by greedy string tiling.

A document and a test item are sequences of words. Runs of ``MIN_TILE`` equal
words are the seeds; from them the longest matches are marked first, no word
twice, until none of that length is left. The share of the item's words that
end up marked is its coverage. Order does not matter, so a passage that was cut
up and reordered is found.

The items go out in blocks of a fixed size and every document is held against
each block, so the benchmark may be of any size. Of an item only those seeds are
looked up without which the threshold could not be reached, rarest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chunks, kernel
from larder.llm.common import query, read

MIN_TILE = 4  # words; shorter items are one tile
COVERAGE = 0.5  # share of an item's words from which a document counts as contaminated
BLOCK_BYTES = 4_000_000  # text of the items that go out at once

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[0x80:] = True

_FOUND = "array<struct<item_id:{kind},coverage:double>>"


def _words(text: kernel.Text) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = text.spans(_WORD[text.data])
    return text.hashes(starts, ends), text.row_of(starts)


def tile(item: np.ndarray, document: np.ndarray, minimum: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(start in the item, start in the document, length) of the tiles of two sequences of word hashes.

    Longest first; ties by place in the item, then in the document. Karp-Rabin
    hashes of ``minimum`` words give the seeds, runs of seeds on a diagonal the matches.
    """
    minimum = min(minimum, len(item))
    if minimum == 0 or len(document) < minimum:
        return []
    _, mine = kernel.windows(item, np.zeros(len(item), np.int64), minimum)
    _, other = kernel.windows(document, np.zeros(len(document), np.int64), minimum)
    order = np.argsort(mine, kind="stable")
    lo, hi = np.searchsorted(mine[order], other, "left"), np.searchsorted(mine[order], other, "right")
    many = hi - lo
    j = np.repeat(np.arange(len(other)), many)
    i = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    taken_i, taken_j = np.zeros(len(item) + 1, np.int64), np.zeros(len(document) + 1, np.int64)
    tiles: list[tuple[int, int, int]] = []
    while True:
        free_i, free_j = np.cumsum(taken_i) - taken_i, np.cumsum(taken_j) - taken_j
        free = (free_i[i + minimum] == free_i[i]) & (free_j[j + minimum] == free_j[j])
        i, j = i[free], j[free]
        if not len(i):
            return tiles
        begins = np.ones(len(i), bool)
        begins[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(i))) + minimum - 1
        longest = length.max()
        best = first[length == longest]
        for k in best[np.lexsort((j[best], i[best]))]:
            a, b = i[k], j[k]
            if not taken_i[a : a + longest].any() and not taken_j[b : b + longest].any():
                taken_i[a : a + longest] = taken_j[b : b + longest] = 1
                tiles.append((int(a), int(b), int(longest)))


class Block:
    """Some items and the seeds that are looked up for them."""

    def __init__(self, items: list[tuple], minimum: int, coverage: float) -> None:
        column = pa.array([t or "" for _, t in items], pa.string())
        self.items: list[tuple] = []
        seeds: list[tuple[np.ndarray, np.ndarray, int]] = []
        for at, end, data, offsets in kernel.slices(column):
            hashes, rows = _words(kernel.Text(data, offsets, lower=True))
            for row in range(end - at):
                mine = hashes[np.searchsorted(rows, row) : np.searchsorted(rows, row + 1)]
                size = min(minimum, len(mine))
                if size:
                    places, keys = kernel.windows(mine, np.zeros(len(mine), np.int64), size)
                    seeds.append((places, keys, size))
                    self.items.append((items[at + row][0], mine))
        known, counts = np.unique(np.concatenate([np.unique(k) for _, k, _ in seeds]), return_counts=True) if seeds else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        probes: dict[int, list[tuple[np.ndarray, int]]] = {}
        for number, (places, keys, size) in enumerate(seeds):
            n = len(self.items[number][1])
            own, at = np.unique(keys, return_inverse=True)
            by_key, ends = places[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at))
            left = np.zeros(n, bool)
            asked = own
            often = np.argsort(-counts[np.searchsorted(known, own)], kind="stable")
            for done, k in enumerate(often):  # the most frequent seeds go, from all their places, while they alone could not reach the threshold
                for place in by_key[ends[k - 1] if k else 0 : ends[k]]:
                    left[place : place + size] = True
                if left.sum() >= coverage * n:
                    asked = own[np.sort(often[done:])]
                    break
            probes.setdefault(size, []).append((asked, number))
        self.probes = {}
        for size, found in probes.items():
            keys = np.concatenate([k for k, _ in found])
            numbers = np.repeat([n for _, n in found], [len(k) for k, _ in found])
            order = np.argsort(keys, kind="stable")
            self.probes[size] = keys[order], numbers[order]

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) that share a seed that was looked up."""
        pairs = [np.zeros((0, 2), np.int64)]
        for size, (keys, numbers) in self.probes.items():
            at, found = kernel.windows(hashes, rows, size)
            hit = kernel.contains(keys, found)
            at, found = at[hit], found[hit]
            lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            many = hi - lo
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            pairs.append(np.unique(np.stack([np.repeat(rows[at], many), numbers[place]], axis=1), axis=0))
        return [(int(r), int(n)) for r, n in np.unique(np.concatenate(pairs), axis=0)]


def _tiled(block: Broadcast, minimum: int, coverage: float, kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    found_type = to_arrow_type(_parse_datatype_string(_FOUND.format(kind=kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.forget()
        items: Block = block.value
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("_found", "_words")]
            for at, end, data, offsets in kernel.slices(batch["_text"], kernel.HASH_SLICE_BYTES):
                hashes, rows = _words(kernel.Text(data, offsets, lower=True))
                bounds = np.searchsorted(rows, np.arange(end - at + 1))
                found = [x or [] for x in batch["_found"][at:end].to_pylist()]
                for row, number in items.candidates(hashes, rows):
                    key, words = items.items[number]
                    share = sum(x[2] for x in tile(words, hashes[bounds[row] : bounds[row + 1]], minimum)) / len(words)
                    if share >= coverage:
                        found[row] = [*found[row], {"item_id": key, "coverage": share}]
                yield pa.RecordBatch.from_arrays(
                    [batch[n][at:end] for n in names] + [pa.array(found, found_type), pa.array(np.diff(bounds))],
                    [*names, "_found", "_words"])

    return run


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, minimum: int = MIN_TILE, coverage: float = COVERAGE,
    keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``documents(text)``, or their columns in ``keep``, with ``n_words``, ``items`` found, best ``coverage`` and ``contaminated``.

    Words are runs of letters and digits, A-Z in lower case. ``items`` lists
    the items that reach the threshold, largest coverage first; ``coverage`` is
    0 where there are none. A missing or empty text has no words and is never
    contaminated, nor do items without words match anything; items shorter than
    a tile must occur as a whole. Repeated items are listed each. Columns with
    the name of a result are replaced by it; no rows give no rows.
    """
    names = documents.columns if keep is None else keep
    rows = _judged(documents, benchmark, names, minimum, coverage, block_bytes)
    best = F.sort_array(F.transform("_found", lambda x: F.struct(x["coverage"].alias("coverage"), x["item_id"].alias("item_id"))), asc=False)
    made = {
        "n_words": F.col("_words"),
        "items": F.transform(best, lambda x: F.struct(x["item_id"].alias("item_id"), x["coverage"].alias("coverage"))),
        "coverage": F.coalesce(F.array_max(F.col("_found.coverage")), F.lit(0.0)),
        "contaminated": F.coalesce(F.size("_found") > 0, F.lit(False)),
    }
    return rows.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(names) if c not in made],
                       *[c.alias(n) for n, c in made.items()])


def uncontaminated(documents: DataFrame, benchmark: DataFrame, minimum: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item, with their own columns alone."""
    names = documents.columns
    rows = _judged(documents, benchmark, names, minimum, coverage, BLOCK_BYTES)
    clean = rows.filter(F.coalesce(F.size("_found"), F.lit(0)) <= 0)
    return clean.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(names)])


def _judged(documents: DataFrame, benchmark: DataFrame, names: list[str], minimum: int, coverage: float, block_bytes: int) -> DataFrame:
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = documents.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(names)],
                            F.col("text").alias("_text"), F.lit(None).cast(_FOUND.format(kind=kind)).alias("_found"),
                            F.lit(0).cast("long").alias("_words"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // block_bytes) or 1
    part = F.pmod(F.xxhash64("text"), F.lit(count))
    for k in range(count):
        items = [tuple(r) for r in benchmark.filter(part == k).select("item_id", "text").toLocalIterator()]
        block = documents.sparkSession.sparkContext.broadcast(Block(items, minimum, coverage))
        rows = rows.mapInArrow(_tiled(block, minimum, coverage, kind), rows.schema)
    return rows


@query("op7_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", F.col("items.item_id").alias("item_ids"), F.round("coverage", 6).alias("coverage"), "contaminated")
