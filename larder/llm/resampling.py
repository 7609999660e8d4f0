"""Importance resampling towards a target: hashed word runs, exact bucket totals, one draw without replacement.

Features of a text are its runs of one to ``n`` words; a feature's bucket is the
CRC of its bytes modulo the number of buckets. Frequent words (the head) are
looked up together with their CRC, frequent pairs together with their bucket;
what is not in the head takes the CRC of its own bytes. A longer run goes on
from the CRC of the run before it: by shift tables where the next word is in
the head, byte by byte where it is not. All ways give the same number, so the
head changes the speed only, and every feature of every text is counted.

The draw adds Gumbel noise from a hash of the id to each log weight and takes
the largest, which draws without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import kernel
from larder.llm.common import query, read, stored
from larder.plans.places import add_places

BUCKETS = 10_000
HEAD_WORDS = 4_096  # frequent words that are broadcast with their CRC; results do not depend on it
HEAD_PAIRS = 4_096  # frequent pairs that are broadcast with their bucket; results do not depend on it
HEAD_BYTES = 64  # a longer word is never in the head
LEAST_WORDS = 20  # of a document that can be drawn
SEED = "2024"

_WORD = np.zeros(256, bool)  # bytes of words, after lower-casing
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_POLYNOMIAL), value >> 1)
    return value


_TABLE = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _shift_tables() -> np.ndarray:
    """What a CRC becomes behind 0 to HEAD_BYTES + 1 zero bytes, for each of its four bytes by themselves."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).astype(np.uint32)
    out = [state]
    for _ in range(HEAD_BYTES + 1):
        state = _TABLE[state & 0xFF] ^ (state >> np.uint32(8))
        out.append(state)
    return np.stack(out)


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each CRC moved past ``count`` more bytes; with the CRC of those bytes xor-ed in it is that of both."""
    out = _SHIFT[count, 0, crc & 0xFF]
    for k in (1, 2, 3):
        out = out ^ _SHIFT[count, k, (crc >> np.uint32(8 * k)) & 0xFF]
    return out


def crc_from(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC of each piece of ``data``, going on from an earlier CRC (0 at first)."""
    out = crc.astype(np.uint32)
    lengths = ends - starts
    for k in np.flatnonzero(lengths > HEAD_BYTES):
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(out[k]))
    short = np.flatnonzero(lengths <= HEAD_BYTES)
    order = short[np.argsort(-lengths[short], kind="stable")]
    state, at, left = out[order] ^ _ONES, starts[order], lengths[order]
    for step in range(int(left[0]) if len(left) else 0):
        many = int(np.searchsorted(-left, -step, "left"))  # those with more bytes than this
        state[:many] = _TABLE[(state[:many] ^ data[at[:many] + step]) & 0xFF] ^ (state[:many] >> np.uint32(8))
    out[order] = state ^ _ONES
    return out


class Words:
    """The words of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.text = kernel.Text(data, offsets, lower=True)
        inside = _WORD[self.text.data]
        self.starts, self.ends = self.text.spans(inside)
        self.rows = self.text.row_of(self.starts)
        self.counts = np.bincount(self.rows, minlength=self.text.rows)
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        letters = self.text.data[inside]
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])

    def runs(self, size: int) -> np.ndarray:
        """The first words of all runs of ``size`` words within one text."""
        many = len(self.rows) - size + 1
        return np.flatnonzero(self.rows[:many] == self.rows[size - 1 :]) if many > 0 else np.zeros(0, np.int64)


class Head:
    """Frequent words with their CRC and frequent pairs of them with theirs, to look features up by."""

    def __init__(self, words: list[bytes], pairs: list[bytes]) -> None:
        self.words = words
        self.crcs = np.array([zlib.crc32(w) for w in words] or [0], np.uint32)
        self.spaced = np.array([zlib.crc32(b" " + w) for w in words] or [0], np.uint32)
        self.lengths = np.array([len(w) + 1 for w in words] or [0], np.int64)
        place = {w: i for i, w in enumerate(words)}
        known = sorted((place[a] * len(words) + place[b], zlib.crc32(p)) for p in pairs for a, b in [p.split(b" ")] if a in place and b in place)
        self.pairs = np.array([k for k, _ in known], np.int64)
        self.pair_crcs = np.array([c for _, c in known], np.uint32)

    def place(self, words: pa.Array) -> np.ndarray:
        """Which head word each word is, -1 for none."""
        if not self.words:
            return np.full(len(words), -1)
        found = pc.index_in(words, value_set=pa.array(self.words, pa.large_binary()))
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def crcs_of(self, own: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, CRCs) of all runs of one word, of two words and so on."""
        head = self.place(own.words)
        crc = self.crcs[head]
        tail = np.flatnonzero(head < 0)
        crc[tail] = crc_from(np.zeros(len(tail), np.uint32), own.text.data, own.starts[tail], own.ends[tail])
        yield np.arange(len(crc)), crc
        for size in range(2, longest + 1):
            at = own.runs(size)
            last = at + size - 1
            done = np.zeros(len(at), bool)
            longer = np.zeros(len(at), np.uint32)
            if size == 2 and len(self.pairs):
                keys = np.where((head[at] >= 0) & (head[last] >= 0), head[at] * len(self.words) + head[last], -1)
                where = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                done = self.pairs[where] == keys
                longer[done] = self.pair_crcs[where[done]]
            by_shift = ~done & (head[last] >= 0)
            word = head[last[by_shift]]
            longer[by_shift] = shifted(crc[at[by_shift]], self.lengths[word]) ^ self.spaced[word]
            rest = np.flatnonzero(~done & ~by_shift)
            spaces = crc_from(crc[at[rest]], np.frombuffer(b" ", np.uint8), np.zeros(len(rest), np.int64), np.ones(len(rest), np.int64))
            longer[rest] = crc_from(spaces, own.text.data, own.starts[last[rest]], own.ends[last[rest]])
            crc = np.zeros(len(own.rows), np.uint32)
            crc[at] = longer
            yield at, longer


def _frequent(size: int, most: int):
    """The frequent runs of one or two words of every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch["text"]):
                own = Words(data, offsets)
                at = own.runs(size)
                at = at[(own.ends - own.starts)[at] + (own.ends - own.starts)[at + size - 1] <= HEAD_BYTES]
                found = own.words.take(at)
                if size == 2:
                    found = pc.binary_join_element_wise(found, own.words.take(at + 1), pa.scalar(b" ", pa.large_binary()))
                counts = pc.value_counts(found)
                words, many = counts.field("values"), counts.field("counts").to_numpy()
                top = np.flatnonzero(many > 1)
                top = top[np.argsort(-many[top], kind="stable")[:most]]
                yield pa.RecordBatch.from_arrays([words.take(top).cast(pa.binary()), pa.array(many[top])], ["feature", "n"])

    return run


def learn_head(documents: DataFrame, longest: int = 1, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """Frequent words, and pairs if runs are longer than a word; every slice of the texts sends its most frequent ones."""
    text = documents.select("text")

    def top(size: int, most: int) -> list[bytes]:
        found = text.mapInArrow(_frequent(size, most), "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        return [bytes(r["feature"]) for r in found.orderBy(F.desc("n"), "feature").limit(most).collect()]  # a bounded list

    return Head(top(1, words) if words else [], top(2, pairs) if pairs and longest > 1 else [])


def _totals(sent: Broadcast, longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch["text"]):
                for _, crc in sent.value.crcs_of(Words(data, offsets), longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def bucket_totals(documents: DataFrame, head: Head, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends its sums; the driver holds one number a bucket."""
    sent = documents.sparkSession.sparkContext.broadcast(head)
    sums = documents.select("text").mapInArrow(_totals(sent, longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in sums.collect():  # a row per bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a log weight, in thousandths, rounded down."""
    size = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def _weights(sent: Broadcast, longest: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = sent.value
        for batch in batches:
            for at, end, data, offsets in kernel.slices(batch["_text"]):
                own = Words(data, offsets)
                many, weight = np.zeros(own.text.rows, np.int64), np.zeros(own.text.rows, np.int64)
                for first, crc in head.crcs_of(own, longest):
                    rows = own.rows[first]
                    many += np.bincount(rows, minlength=own.text.rows)
                    np.add.at(weight, rows, gain[crc % np.uint32(len(gain))])
                yield pa.RecordBatch.from_arrays([batch[n][at:end] for n in names] + [pa.array(x, pa.int64()) for x in (own.counts, many, weight)],
                                                 [*names, "n_words", "n_features", "weight"])

    return run


def add_weights(documents: DataFrame, head: Head, gain: np.ndarray, keep: list[str], longest: int = 1) -> DataFrame:
    """The columns in ``keep`` with ``n_words``, ``n_features`` and the log ``weight`` (thousandths) of each text."""
    sent = documents.sparkSession.sparkContext.broadcast((head, gain))  # bounded by the head and the buckets
    rows = documents.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_weights(sent, longest, keep), ", ".join([*kinds, "n_words long", "n_features long", "weight long"]))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id (a missing id is an empty text)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    seed: str = SEED, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``documents(doc_id, text)``.

    ``target(text)`` says what the draw leans towards. Of the documents with
    enough words, ``percent`` in a hundred (rounded down) with the highest scores are drawn and
    ranked from 1; ties go to the smaller id, then to a hash of the row; the others' rank is NULL. A missing
    or empty text has no features and weight 0. Rows with one id have the same
    noise. A missing id has the noise of an empty one and comes last among ties. Empty tables
    hold no features: every gain comes from the other side alone. Extra columns are ignored.
    """
    head = learn_head(documents, longest, head_words, head_pairs)
    gain = gains(bucket_totals(documents, head, longest, buckets), bucket_totals(target, head, longest, buckets))
    weighed = add_weights(documents, head, gain, ["doc_id"], longest)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    ranked = add_places(scored, [], [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    rank = F.when(enough & (F.col("place") <= drawn), F.col("place"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


@query("op12_resampling")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
