"""Token ids as raw binary shards with a minimal perfect hash index.

``shard-00012.ids`` holds the ids of its documents, nothing else: little-endian
16-bit numbers if the vocabulary allows, else 32-bit. ``shard-00012.index``
holds, for each document, where its ids begin, and a minimal perfect hash from
keys to documents with a fingerprint per slot, so a key is found (or refused)
in constant time. Shards are ranges of keys in ascending order; the manifest
(one row per shard) has the range and the size of each.

Files are written under another name and then moved, so a task that runs again
leaves the same files.
"""

from __future__ import annotations

import functools
import io
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import chunks, kernel
from larder.llm.common import query, read, shared_folder
from larder.session import cut_lineage

END_ID = 0  # appended to each document
_SPREAD = 2  # bits of a level of the hash per key that is left
_MANIFEST = "shard int, first_key long, last_key long, n_docs long, n_tokens long, width int"


class PerfectHash:
    """Gives n different keys the numbers 0 to n-1, in levels of bits.

    A key sits in the first level where no other key has its place; its number
    is the count of set bits before it.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.rank = np.cumsum(bits) - 1

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (kernel.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = _SPREAD * len(keys) + 8
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 (or any number) for a key that is not in it."""
        found, before = np.full(len(keys), -1), 0
        for level, bits in enumerate(self.levels):
            left = np.flatnonzero(found < 0)
            place = self._place(keys[left], level, len(bits))
            hit = bits[place]
            found[left[hit]] = self.rank[before + place[hit]]
            before += len(bits)
        return found


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (kernel.mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, missing: int, ends: np.ndarray, width: int) -> bytes:
    """The index of documents in key order; the first ``missing`` ones have no key. ``ends``: ids up to each."""
    own = keys.view(np.uint64)
    different, first = np.unique(own, return_index=True)
    order = np.argsort(first)
    different, first = different[order], first[order] + missing
    table = PerfectHash.of(different)
    slots = table.numbers(different)
    prints, docs = np.zeros(len(different), np.uint32), np.zeros(len(different), np.int64)
    prints[slots], docs[slots] = _fingerprints(different), first
    out = io.BytesIO()
    np.savez(out, prints=prints, docs=docs, ends=ends, keys=keys, missing=missing, width=width, sizes=np.array([len(x) for x in table.levels], np.int64),
             bits=np.packbits(np.concatenate(table.levels)) if table.levels else np.zeros(0, np.uint8))
    return out.getvalue()


class Shard:
    """A shard's files, open for reading."""

    def __init__(self, folder: str, number: int) -> None:
        files, path = pa.fs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{path}/{_name(number)}.index") as f:
            found = np.load(io.BytesIO(f.read()))
            self.prints, self.docs, self.ends, self.keys = (found[n] for n in ("prints", "docs", "ends", "keys"))
            self.missing, self.width = int(found["missing"]), int(found["width"])
            bits = np.unpackbits(found["bits"]).astype(bool)
            self.table = PerfectHash(np.split(bits[: found["sizes"].sum()], np.cumsum(found["sizes"])[:-1]) if len(found["sizes"]) else [])
        self.payload = files.open_input_file(f"{path}/{_name(number)}.ids")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of the (first) document with each key, -1 if there is none."""
        if not len(self.docs):
            return np.full(len(keys), -1)
        own = keys.astype(np.int64).view(np.uint64)
        slots = self.table.numbers(own)
        known = (slots >= 0) & (self.prints[slots] == _fingerprints(own))
        return np.where(known, self.docs[slots], -1)

    def start(self, doc: int) -> int:
        return int(self.ends[doc - 1]) if doc else 0

    def ids(self, doc: int) -> np.ndarray:
        begin, end = self.start(doc), int(self.ends[doc])
        raw = self.payload.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _name(number: int) -> str:
    return f"shard-{number:05d}"


@functools.lru_cache(maxsize=2)
def _memory(path: str) -> tuple[chunks.Memory, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return chunks.Memory(encode), 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4


def _write(folder: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, width = _memory(path)
        files, place = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        keys, counts, missing = [], [], 0
        new = f"{place}/{_name(number)}.{attempt}"
        with files.open_output_stream(f"{new}.ids") as out:
            for batch in batches:
                missing += batch["doc_id"].null_count
                keys.append(batch["doc_id"].drop_null().to_numpy())
                for at, end, data, offsets in kernel.slices(batch["text"]):
                    ids, many = memory.ids(kernel.Text(data, offsets))
                    ends = np.cumsum(many)
                    out.write(np.insert(ids, ends, END_ID).astype(f"<u{width}").tobytes())
                    counts.append(many + 1)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if not len(counts):
            files.delete_file(f"{new}.ids")
            return
        keys = np.concatenate(keys).astype(np.int64)
        with files.open_output_stream(f"{new}.index") as out:
            out.write(index_bytes(keys, missing, np.cumsum(counts), width))
        for kind in ("ids", "index"):
            files.move(f"{new}.{kind}", f"{place}/{_name(number)}.{kind}")
        row = {"shard": [number], "first_key": [int(keys[0]) if len(keys) else None], "last_key": [int(keys[-1]) if len(keys) else None],
               "n_docs": [len(counts)], "n_tokens": [int(counts.sum())], "width": [width]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([
            ("shard", pa.int32()), *[(n, pa.int64()) for n in ("first_key", "last_key", "n_docs", "n_tokens")], ("width", pa.int32())]))

    return run


def write_shards(documents: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the ids of ``documents(doc_id, text)`` below a new ``folder`` that all executors share; the manifest.

    Shards are ranges of ids. Rows without an id come first and can be read in
    order only, not by key. Rows with one id are ordered by a hash of their
    text, and the key finds the first. A missing or empty text has the end id
    alone. Other columns are ignored. No rows write no shard.
    """
    text = F.xxhash64("text")
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", text).sortWithinPartitions("doc_id", text)
    return cut_lineage(ordered.mapInArrow(_write(folder, path), _MANIFEST))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before in zip(batch["shard"].to_pylist(), batch["before"].to_pylist()):
                shard = Shard(folder, number)
                n = len(shard.ends)
                place = np.arange(n)
                # Every key goes through the hash; those after the first of a repeated key follow it.
                found = shard.find(shard.keys)
                first = np.append(True, shard.keys[1:] != shard.keys[:-1]) if len(shard.keys) else np.zeros(0, bool)
                if not (found[first] == place[shard.missing :][first]).all():
                    raise ValueError(f"index and ids of shard {number} do not fit")
                keys = pa.array([None] * shard.missing + shard.keys.tolist(), pa.int64())
                for at in range(0, n, 5_000):
                    docs = range(at, min(at + 5_000, n))
                    ids = [shard.ids(d) for d in docs]
                    yield pa.RecordBatch.from_arrays([
                        keys[at : docs.stop], pa.array([before + shard.start(d) for d in docs], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files through the index."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("before"))  # a row per shard
    spread = placed.repartition(manifest.count() or 1, "shard")
    return spread.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _lookup(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, Shard] = {}
        for batch in batches:
            out = []
            for key, number in zip(batch["doc_id"].to_pylist(), batch["shard"].to_pylist()):
                if number not in shards:
                    shards = {number: Shard(folder, number)}
                doc = int(shards[number].find(np.array([key]))[0])
                out.append(None if doc < 0 else shards[number].ids(doc).tolist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def lookup(manifest: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) for each of ``keys(doc_id)``; NULL ids for a key that no shard has."""
    ranges = [(r["last_key"], r["shard"]) for r in manifest.filter("last_key is not null").orderBy("shard").collect()]  # a row per shard
    if not ranges:
        return keys.select("doc_id", F.lit(None).cast("array<long>").alias("ids"))
    bounds = F.array(*[F.lit(b).cast("long") for b, _ in ranges[:-1]]) if len(ranges) > 1 else F.array().cast("array<long>")
    at = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    shard = F.element_at(F.array(*[F.lit(s) for _, s in ranges]), at + 1)
    placed = keys.select("doc_id").filter("doc_id is not null").withColumn("shard", shard)
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_lookup(folder), "doc_id long, ids array<long>")


def default_tokenizer() -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_token_shards")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_folder(spark)
    place = place if "://" in place else f"file://{place}" if not place.startswith("file:") else "file://" + place[5:]
    return read_shards(write_shards(read(spark, folder, "documents"), default_tokenizer(), place), place)
