"""Quality rules: distance of a document's histograms from those of its language.

Every document gets two histograms: classes of characters, and the most common
words of its language (with one bin for all others). Each is compared with that
of the whole language by the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1). Texts that are too short to tell are not judged by
it, nor are texts of a language with too little text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import chunks, kernel
from larder.llm.common import query, read, stored
from larder.plans.joins import fits
from larder.session import cut_lineage

COMMON_WORDS = 64  # words of a language's histogram, besides the bin for all others
LANGUAGES_SENT = 2_000  # languages up to which the references (1 KB each) are broadcast
# Distances from which a document is rejected, and the sizes from which they are looked at.
CLASS_DISTANCE = 0.33
WORD_DISTANCE = 0.50
MIN_CHARS = 200
MIN_WORDS = 100  # with 65 bins, a text of 100 words is about 0.3 away by chance alone
MIN_REFERENCE_WORDS = 1_000
MIN_BASE_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Character classes by first byte: small letters, capitals, digits, space, other letters, marks of a sentence, symbols.
CLASSES = 7
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[kernel.SPACE] = 3
_CLASS[0x80:] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _class_counts(text: kernel.Text) -> np.ndarray:
    first = (text.data & 0xC0) != 0x80
    rows = np.repeat(np.arange(text.rows), np.diff(text.offsets))[first]
    return np.bincount(rows * CLASSES + _CLASS[text.data[first]], minlength=text.rows * CLASSES).reshape(-1, CLASSES)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of one task: word counts as kind 0, class counts as kind 1."""
    chunks.forget()
    words: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    classes: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch["lang"].fill_null("").to_pylist(), object)
        for at, end, data, offsets in kernel.slices(batch["text"], kernel.HASH_SLICE_BYTES):
            raw, low = kernel.Text(data, offsets), kernel.Text(data, offsets, lower=True)
            starts, ends = low.words()
            hashes, rows, counts = low.hashes(starts, ends), low.row_of(starts), _class_counts(raw)
            own = langs[at:end]
            for lang in set(own):
                mine = own == lang
                classes[lang] = classes.get(lang, 0) + counts[mine].sum(0)
                found = hashes[mine[rows]]
                pile = words.setdefault(lang, [])
                pile.append(_summed(found, np.ones(len(found))))
                if len(pile) > 16:
                    pile[:] = [_summed(np.concatenate([k for k, _ in pile]), np.concatenate([n for _, n in pile]))]
    for lang, pile in words.items():
        keys, counts = _summed(np.concatenate([k for k, _ in pile]), np.concatenate([n for _, n in pile]))
        for kind, k, n in ((0, keys.view(np.int64), counts), (1, np.arange(CLASSES), classes[lang])):
            for i in range(0, len(k), 50_000):
                part = len(k[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * part, pa.string()), pa.array(np.full(part, kind, np.int32)),
                    pa.array(k[i : i + part].astype(np.int64)), pa.array(n[i : i + part].astype(np.int64)),
                ], ["lang", "kind", "key", "n"])


def language_references(documents: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """One row per language: its common words (hashes), their shares, the shares of classes, its words in all.

    Counted over every document. A missing language is the language ''.
    """
    counted = stored(
        documents.select("lang", "text")
        .mapInArrow(_language_counts, "lang string, kind int, key long, n long")
        .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    words = counted.filter("kind = 0")
    top = words.withColumn("place", place).filter(F.col("place") <= common)
    sums = words.groupBy("lang").agg(F.sum("n").alias("total"))
    classes = (
        counted.filter("kind = 1").withColumn("all", total).groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("key", (F.col("n") / F.col("all")).alias("share")))).alias("c"))
        .select("lang", F.col("c.share").alias("class_shares"))
    )
    return cut_lineage(
        top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("w"))
        .join(sums, "lang").join(classes, "lang")
        .select("lang", F.col("w.key").alias("word_keys"),
                F.transform("w", lambda w: w["n"] / F.col("total")).alias("word_shares"), "class_shares", "total")
    )


def _distance(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the shares."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(shares > 0, shares * np.log2(shares / m), 0).sum(1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


def _measure(text: kernel.Text) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    starts, ends = text.words()
    rows = text.row_of(starts)
    keys = kernel.per_row(text.hashes(starts, ends), rows)
    at, found = kernel.windows(keys, rows, 8)
    twice = kernel.covered(at[kernel.repeated(found)], 8, len(starts))
    first = (text.data & 0xC0) != 0x80
    line_starts, line_ends = text.spans(text.data != 10)
    has_word = np.zeros(len(line_starts), bool)
    has_word[np.searchsorted(line_starts, starts, "right") - 1] = True
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_rows = text.row_of(line_starts)
    _, unique = np.unique(kernel.per_row(text.hashes(line_starts, line_ends), line_rows), return_index=True)
    count = lambda r: np.bincount(r, minlength=text.rows)
    return {
        "n_words": count(rows), "word_chars": text.sums(first & ~kernel.SPACE[text.data]),
        "n_symbols": text.sums(_SYMBOL[text.data]), "n_dup_lines": count(line_rows) - count(line_rows[unique]),
        "n_repeat_words": count(rows[twice]),
    }, rows, first


def _judge(kept: dict[str, str]):
    """The rows with what is measured and judged; ``kept`` has the columns that go along, by the name they get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.forget()
        for batch in batches:
            langs = np.array(batch["lang"].fill_null("").to_pylist(), object)
            lists = {n: batch[n] for n in ("word_keys", "word_shares", "class_shares")}
            totals = batch["total"].fill_null(0).to_numpy(zero_copy_only=False)
            for at, end, data, offsets in kernel.slices(batch["text"], kernel.HASH_SLICE_BYTES):
                raw, low = kernel.Text(data, offsets), kernel.Text(data, offsets, lower=True)
                out, rows, first = _measure(raw)
                starts, ends = low.words()
                hashes, classes = low.hashes(starts, ends), _class_counts(raw)
                word_far, class_far = np.full(raw.rows, np.nan), np.full(raw.rows, np.nan)
                own = langs[at:end]
                for lang in set(own):
                    mine = own == lang
                    one = at + int(np.argmax(mine))
                    if totals[one] < MIN_REFERENCE_WORDS:
                        continue
                    keys = np.array(lists["word_keys"][one].as_py(), np.int64).view(np.uint64)
                    shares = np.array(lists["word_shares"][one].as_py())
                    order = np.argsort(keys)
                    keys, shares = keys[order], np.append(shares[order], 1 - shares.sum())
                    picked = mine[rows]
                    place = np.minimum(np.searchsorted(keys, hashes[picked]), len(keys) - 1)
                    place = np.where(keys[place] == hashes[picked], place, len(keys))
                    number = np.cumsum(mine) - 1
                    counts = np.bincount(number[rows[picked]] * len(shares) + place, minlength=mine.sum() * len(shares))
                    word_far[mine] = _distance(counts.reshape(-1, len(shares)), shares)
                    class_far[mine] = _distance(classes[mine], np.array(lists["class_shares"][one].as_py()))
                word_far[out["n_words"] < MIN_WORDS] = np.nan
                class_far[raw.sums(first) < MIN_CHARS] = np.nan
                far = {"word_distance": word_far, "class_distance": class_far}
                yield pa.RecordBatch.from_arrays(
                    [batch[n][at:end] for n in kept.values()]
                    + [pa.array(v.astype(np.int64)) for v in out.values()]
                    + [pa.array(v, pa.float64(), from_pandas=True) for v in far.values()],
                    [*kept, *out, *far],
                )

    return run


def quality_rules(
    documents: DataFrame, references: DataFrame | None = None,
    class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE, keep: list[str] | None = None,
) -> DataFrame:
    """All columns of ``documents`` (``text``, ``lang``), or those in ``keep``, with counts, distances, ``base_failed`` and ``kept``.

    A missing text counts as empty, a missing language as one of its own. Empty
    and very short texts fail the base rule (under 20 words); a distance is NULL
    where it is not judged. Columns of the table that have the name of a result
    are replaced by it. Repeated rows stay and are judged alike; no rows give no rows.
    """
    names = documents.columns if keep is None else keep
    result = _judged(documents, names, references, class_distance, word_distance)
    made = result.columns[len(names):]
    return result.select(*[F.col(f"_keep_{i}").alias(n) for i, n in enumerate(names) if n not in made], *made)


def passing(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns alone."""
    names = documents.columns
    result = _judged(documents, names, None, CLASS_DISTANCE, WORD_DISTANCE).filter("kept")
    return result.select(*[F.col(f"_keep_{i}").alias(n) for i, n in enumerate(names)])


def _judged(documents: DataFrame, names: list[str], references: DataFrame | None, class_distance: float, word_distance: float) -> DataFrame:
    references = language_references(documents) if references is None else references
    columns = {f"_keep_{i}": n for i, n in enumerate(names)}
    rows = documents.select(  # the texts go to the workers once, kept or not
        *[F.col(f"`{n}`").alias(k) for k, n in columns.items() if n != "text"], "text", F.coalesce("lang", F.lit("")).alias("lang"))
    small = F.broadcast(references) if fits(references, LANGUAGES_SENT) else references
    joined = rows.join(small, "lang", "left")
    kinds = [f"{k} {documents.schema[n].dataType.simpleString()}" for k, n in columns.items()]
    judged = joined.mapInArrow(_judge({k: "text" if n == "text" else k for k, n in columns.items()}), ", ".join([*kinds, _BASE, "word_distance double, class_distance double"]))
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    near = (F.coalesce(F.col("class_distance") <= class_distance, F.lit(True))
            & F.coalesce(F.col("word_distance") <= word_distance, F.lit(True)))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(read(spark, folder, "documents"), keep=["doc_id"])
