"""Removes byte strings that occur earlier in the corpus, a hundred bytes or longer.

Every window of ``LENGTH`` bytes is looked up by the smallest hash of the shorter
runs in it (its anchor). Two equal windows have the same anchor at the same
place, so only windows whose anchor occurs twice can be repeats:

1. anchors are counted; those that occur once go;
2. for the others, the bytes that any window of an anchor covers (its context)
   are compared as a whole: of equal contexts all but the first are repeats;
3. only where an anchor has different contexts are these compared byte by byte:
   the first of each is sent to its anchor, and a small index over them sorts
   their windows by content, so that equal ones form runs. A run keeps its first
   place; the others are marked, neighbours as one span.

Anchors with very many places take another way, in which each step is a grouping
with partial aggregation, so no task gathers all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import kernel
from larder.llm.common import query, read, stored

LENGTH = 100
HOT_PLACES = 100_000  # places of one anchor that may meet in one task
INDEX_BYTES = 1_000_000  # contexts that are indexed at once, and besides those of one anchor
RUN = 24  # bytes of the runs whose smallest hash is the anchor
SIEVE = 1 << 20  # places of the filter that goes out to find the documents concerned


def _window_anchors(text: kernel.Text, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, place of its anchor, hashes of all runs); ties by the first place."""
    n = len(text.data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(n - run + 1)
    hashes = text.hashes(starts, starts + run)
    # High half of the hash, then the place: the smallest is the same wherever a window stands.
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    wide, width = length - run + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    ends = text.offsets[1:]
    left = np.repeat(ends, np.diff(text.offsets))[: len(least)] - np.arange(len(least))
    windows = np.flatnonzero(left >= length)
    return windows, (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def _groups(windows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows with one anchor."""
    if not len(windows):
        return windows, windows, windows
    new = np.append(True, anchors[1:] != anchors[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    return anchors[first], windows[first], windows[last]


def _anchors(length: int, run: int, contexts: bool):
    """(anchor) of each place, or (anchor, context, doc_id, place) too; a place is packed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in kernel.slices(batch["text"], kernel.HASH_SLICE_BYTES):
                text = kernel.Text(data, offsets)
                windows, anchors, hashes = _window_anchors(text, length, run)
                place, first, last = _groups(windows, anchors)
                keys = kernel.signed(hashes[place])
                if not contexts:
                    yield pa.RecordBatch.from_arrays([keys], ["anchor"])
                    continue
                rows = text.row_of(place)
                since_first, since_last = place - first, place - last  # windows begin at their anchor or before it
                shape = (since_first * (4 * length) + since_last).astype(np.uint64)
                whole = kernel.mix(text.hashes(first, last + length) ^ (shape * np.uint64(0x9E3779B97F4A7C15)))
                packed = ((place - text.offsets[rows]) << 32) | (since_first << 16) | since_last
                yield pa.RecordBatch.from_arrays(
                    [keys, kernel.signed(whole), batch["doc_id"][at:end].take(pa.array(rows)), pa.array(packed)], ["anchor", "context", "doc_id", "place"])

    return go


def _unpacked(rows: DataFrame) -> DataFrame:
    """First and last window of a place, as ``a`` and ``b``."""
    at = F.shiftright("place", 32)
    return rows.withColumn("a", (at - F.shiftright("place", 16).bitwiseAND(0xFFFF)).cast("int")).withColumn(
        "b", (at - F.col("place").bitwiseAND(0xFFFF)).cast("int"))


def _contexts(length: int):
    """(anchor, doc_id, start, bytes) of the contexts that come with each text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in enumerate(batch["text"].cast(pa.binary())):
                data = raw.as_py() or b""
                spans = [s for s in batch["spans"][row].as_py() if s["b"] + length <= len(data)]  # repeated ids may come with another text
                yield pa.RecordBatch.from_arrays([
                    pa.array([s["anchor"] for s in spans], pa.int64()), batch["doc_id"][row : row + 1].take(pa.array(np.zeros(len(spans), np.int64))),
                    pa.array([s["a"] for s in spans], pa.int32()), pa.array([data[s["a"] : s["b"] + length] for s in spans], pa.binary()),
                ], ["anchor", "doc_id", "start", "bytes"])

    return go


def _window_hashes(pieces: pa.Array, length: int) -> np.ndarray:
    """Hashes of the windows of all pieces in order, made for small slices."""
    made = [np.zeros(0, np.uint64)]
    for _, _, data, offsets in kernel.slices(pieces, kernel.HASH_SLICE_BYTES):
        text = kernel.Text(data, offsets)
        many = np.maximum(np.diff(offsets) - length + 1, 0)
        begins = np.repeat(offsets[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        made.append(text.hashes(begins, begins + length))
    return np.concatenate(made)


def _indexed(docs: np.ndarray, starts: np.ndarray, pieces: pa.Array, length: int) -> pa.RecordBatch:
    """(doc_id, a, b) of the stretches of the pieces that repeat an earlier one."""
    order = np.lexsort((starts, docs))
    docs, starts, pieces = docs[order], starts[order], pieces.take(pa.array(order))
    many = np.maximum(np.diff(np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]) - length + 1, 0)
    windows = _window_hashes(pieces, length)
    rows = np.repeat(np.arange(len(pieces), dtype=np.int32), many)
    at = np.arange(len(rows), dtype=np.int32) - np.repeat((np.cumsum(many) - many).astype(np.int32), many)
    if ((docs[1:] == docs[:-1]) & (starts[1:] < starts[:-1] + many[:-1])).any():  # rows with one id and different texts
        order = np.lexsort((starts[rows] + at, docs[rows], windows))
    else:  # pieces of a document share no window, so their windows are in order of place
        order = np.argsort(windows, kind="stable")
    ranked = windows[order]  # runs of equal windows, each from its first place on
    later = np.zeros(len(order), bool)
    later[order[1:][ranked[1:] == ranked[:-1]]] = True
    rows, at = rows[later], at[later]
    new = np.append(True, (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1))[: len(rows)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows))[: len(first)] - 1
    out = [docs[rows[first]], (starts[rows[first]] + at[first]).astype(np.int32), (starts[rows[last]] + at[last] + length).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc_id", "a", "b"])


def _index(length: int):
    """Index the contexts of whole anchors, about a megabyte at a time; rows come in order of their anchor."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b["bytes"].nbytes for b in held) < INDEX_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchors = table["anchor"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
            if cut:
                yield from _one(table.slice(0, cut), length)
                held = table.slice(cut).to_batches()
        if held:
            yield from _one(pa.Table.from_batches(held), length)

    return go


def _one(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    if table.num_rows:
        table = table.combine_chunks()
        yield _indexed(table["doc_id"].to_numpy(), table["start"].to_numpy().astype(np.int64), table["bytes"].chunk(0), length)


def _windows(length: int):
    """(window, doc_id, start) of all windows in the spans that come with each text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in kernel.slices(batch["text"], kernel.HASH_SLICE_BYTES):
                text = kernel.Text(data, offsets)
                out = []
                for row in range(end - at):
                    spans = np.array(batch["spans"][at + row].as_py(), np.int64).reshape(-1, 2) + offsets[row]
                    starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in spans]))
                    starts = starts[starts + length <= offsets[row + 1]]  # repeated ids may come with another text
                    out.append((np.full(len(starts), row), starts))
                rows, starts = np.concatenate([r for r, _ in out]), np.concatenate([s for _, s in out])
                yield pa.RecordBatch.from_arrays([
                    kernel.signed(text.hashes(starts, starts + length)), batch["doc_id"][at:end].take(pa.array(rows)),
                    pa.array((starts - offsets[rows]).astype(np.int32))], ["window", "doc_id", "start"])

    return go


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the spans that come with it."""
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for raw, spans in zip(batch["text"].cast(pa.binary()), batch["spans"]):
            data = raw.as_py() or b""
            gone = np.zeros(len(data) + 2, bool)
            for a, b in spans.as_py() or []:
                gone[a + 1 : min(b, len(data)) + 1] = True
            kept = np.frombuffer(data, np.uint8)[~gone[1:-1]].tobytes()
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        made = [pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
        yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *made], [*names, "n_removed", "n_spans", "kept_sha256"])


def _sieve(bits: Broadcast):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.value[batch["_place"].to_numpy()]))

    return go


def _concerned(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that are in ``wanted``, and a few more: what a filter of fixed size lets through."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).cast("int")
    bits = np.zeros(SIEVE, bool)
    bits[wanted.select(place.alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)] = True  # at most SIEVE numbers
    rows = documents.filter("doc_id is not null").select("doc_id", "text", place.alias("_place"))
    return rows.mapInArrow(_sieve(documents.sparkSession.sparkContext.broadcast(bits)), rows.schema).drop("_place")


def repeat_spans(documents: DataFrame, length: int = LENGTH, run: int = RUN, hot_places: int = HOT_PLACES) -> DataFrame:
    """(doc_id, spans): the bytes of each document that repeat, as (start, end) of stretches of windows; spans may overlap."""
    rows = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = stored(rows.select("text").mapInArrow(_anchors(length, run, False), "anchor long").groupBy("anchor").count().filter("count > 1"))
    places = rows.mapInArrow(_anchors(length, run, True), "anchor long, context long, doc_id long, place long")
    key = F.struct("doc_id", "place")
    own, all_of = Window.partitionBy("anchor", "context"), Window.partitionBy("anchor")
    few, many = _parted(places, often, hot_places)
    met = few.withColumn("first", F.min(key).over(own) == key).withColumn(
        "various", F.min("context").over(all_of) != F.max("context").over(all_of))
    found = stored(_unpacked(met.filter("not first or various").select("anchor", "doc_id", "place", "first")).drop("place"))
    spans = [found.filter("not first").select("doc_id", "a", (F.col("b") + length).cast("int").alias("b"))]
    gathered = stored(found.filter("first").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "a", "b")).alias("spans")))
    contexts = _concerned(rows, gathered).join(gathered, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        _contexts(length), "anchor long, doc_id long, start int, bytes binary")
    spans.append(contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index(length), "doc_id long, a int, b int"))
    if many is not None:
        spans += _hot_spans(rows, many, length)
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    return every.groupBy("doc_id").agg(F.collect_list(F.array("a", "b")).alias("spans"))


def _parted(places: DataFrame, often: DataFrame, hot_places: int) -> tuple[DataFrame, DataFrame | None]:
    """The places of the anchors of ``often(anchor, count)``: of those with few places, and of those with very many.

    Each of the latter has more than ``hot_places`` places, so there are few of
    them: they go out to the tasks, and neither side shuffles the other's places.
    """
    few, hot = (often.filter(x).select("anchor") for x in (F.col("count") <= hot_places, F.col("count") > hot_places))
    if hot.isEmpty():
        return places.join(few, "anchor"), None
    return places.join(F.broadcast(hot), "anchor", "left_anti").join(few, "anchor"), places.join(F.broadcast(hot), "anchor")


def _hot_spans(rows: DataFrame, places: DataFrame, length: int) -> list[DataFrame]:
    """Steps 2 and 3 without gathering the places of an anchor: window by window, with partial aggregation."""
    met = stored(places)
    key = F.struct("doc_id", "place")
    firsts = met.groupBy("anchor", "context").agg(F.min(key).alias("first"))
    later = _unpacked(met.join(firsts, ["anchor", "context"]).filter(key != F.col("first")).select("doc_id", "place"))
    various = firsts.groupBy("anchor").agg(F.min("context").alias("lo"), F.max("context").alias("hi")).filter("lo < hi").select("anchor")
    kept = _unpacked(firsts.join(various, "anchor").select("first.doc_id", "first.place"))
    gathered = stored(kept.groupBy("doc_id").agg(F.collect_list(F.array("a", "b")).alias("spans")))
    windows = stored(_concerned(rows, gathered).join(gathered, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        _windows(length), "window long, doc_id long, start int"))
    place = F.struct("doc_id", "start")
    runs = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("window", "first")
    repeats = windows.join(runs, "window").filter(place != F.col("first"))
    return [later.select("doc_id", "a", (F.col("b") + length).cast("int").alias("b")),
            repeats.select("doc_id", F.col("start").alias("a"), (F.col("start") + length).cast("int").alias("b"))]


def without_repeats(documents: DataFrame, length: int = LENGTH, run: int = RUN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``documents(doc_id, text)``.

    Ids are whole numbers. A byte is removed if a string of ``length`` bytes that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same one. Texts
    shorter than that, empty or missing ones lose nothing. A row without an id
    is left as it is and takes part in nothing. Rows with one id are one
    document: equal ones lose the same bytes. Other columns do not matter.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.coalesce("text", F.lit(""))
    spans = stored(repeat_spans(documents, length, run))
    cut = _concerned(documents, spans).join(spans, "doc_id").select("doc_id", F.xxhash64("text").alias("_text"), "text", "spans").mapInArrow(
        _cut, "doc_id long, _text long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "_text"])
    whole = documents.select("doc_id", F.xxhash64("text").alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    joined = whole.join(cut, ["doc_id", "_text"], "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


@query("op9_repeats")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(read(spark, folder, "documents"))
