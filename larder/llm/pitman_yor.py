"""Scores texts with a hierarchical Pitman-Yor language model.

Four kinds of restaurants:

* one for each word of the training texts, and for the beginning, as a context;
  its dishes are the words that follow, and the end of a text. Their customers
  are a Spark table of all observed pairs;
* one for each class of contexts: the most frequent words by themselves, all
  other words, the beginning. Its customers are the tables of its contexts; its
  dishes are the frequent words, the class of other words, and the end;
* the shared parent of the classes, whose customers are their tables, over an
  even base;
* the restaurant of the other words, which shares out their class; its dishes
  are all words of the training texts and, for unseen ones, an even base.

How many words are frequent is a parameter, so the classes have a fixed size and
are seated on the driver; the contexts grow with the texts and are seated in
tasks, those of frequent words in several rooms. Customers are seated anew in
every sweep (Gibbs sampling) with the last state above them. The probabilities
of the classes are averaged over sweeps, then the tables of the contexts below
these averages; a pair that was not observed has its class's probability, times
what its context leaves to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import kernel
from larder.llm.common import fold, query, read, stored

HELD_OUT_FOLD = 1
MODEL_WORDS = 1_000  # words that are a class of their own; the classes have about the square of it in numbers
SENT_WORDS = 100_000  # words whose counts go out to all tasks (3 MB); those of all others are joined
SENT_PAIRS = 200_000  # pairs that go out too (3 MB)
DISCOUNT, STRENGTH = 0.75, 1.0
SWEEPS, BURN_IN = 6, 2
ROOMS = 128  # that a frequent context is seated in
PASSES = 2  # over a context in a sweep, as it starts from one table a dish
EXACT_SEATS = 16  # customers of a dish seated one by one; after them in blocks that double

# Places in the model after its words: the class of all others, the end; as a context the beginning has the end's place.



def seat(counts: np.ndarray, pull: np.ndarray, rng: np.random.Generator, discount: float = DISCOUNT) -> np.ndarray:
    """Tables of each dish after its customers have come in one by one.

    ``pull`` is what draws a customer of a dish to a new table (strength and
    tables of the restaurant, times the parent's probability); the dish's own
    tables draw with customers less discounts. Beyond the first few customers,
    those of a block are seated with one probability.
    """
    tables = np.minimum(counts, 1).astype(np.float64)
    seated, size = 1, 1
    while True:
        left = np.flatnonzero(counts > seated)
        if not len(left):
            return tables.astype(np.int64)
        block = np.minimum(counts[left] - seated, size).astype(np.int64)
        own = np.maximum(seated + (block - 1) / 2 - discount * tables[left], 0)
        chance = pull[left] / np.maximum(pull[left] + own, 1e-300)
        tables[left] += rng.binomial(block, np.clip(chance, 0, 1))
        seated += size
        if seated >= EXACT_SEATS:
            size = seated


def _classes(known: np.ndarray, hashes: np.ndarray, words: int) -> np.ndarray:
    """The place of each word in the model; ``known`` has its hashes in order of place."""
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], hashes), max(len(known) - 1, 0))
    return np.where(known[order][at] == hashes, order[at], words) if len(known) else np.full(len(hashes), words)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of one task; the end of a text is not among them."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for _, _, data, offsets in kernel.slices(batch["text"]):
            text = kernel.Text(data, offsets, lower=True)
            own, many = np.unique(text.hashes(*text.words()), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, many]), len(keys)).astype(np.int64)
    for i in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_arrays([kernel.signed(keys[i : i + 50_000]), pa.array(counts[i : i + 50_000])], ["word", "n"])


def _class_of(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The class of contexts or dishes; the beginning and the end have hash 0."""
    return np.where(hashes == 0, len(known) + 1, _classes(known, hashes, len(known)))


def _pairs(text: kernel.Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of the context, hash of the dish) of all tokens, ends included, in order."""
    starts, ends = text.words()
    hashes, rows = text.hashes(starts, ends), text.row_of(starts)
    at = np.searchsorted(rows, np.arange(text.rows), "right")  # each text's end comes after its words
    rows = np.insert(rows, at, np.arange(text.rows))
    hashes = np.insert(hashes, at, 0)
    return rows, np.append(np.uint64(0), hashes[:-1]), hashes


def _pair_keys(context: np.ndarray, dish: np.ndarray) -> np.ndarray:
    return kernel.mix(kernel.mix(context) + dish)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, dish, n) of slices of the texts."""
    for batch in batches:
        for _, _, data, offsets in kernel.slices(batch["text"]):
            _, context, dish = _pairs(kernel.Text(data, offsets, lower=True))
            _, first, many = np.unique(_pair_keys(context, dish), return_index=True, return_counts=True)
            for i in range(0, len(first), 50_000):
                own = first[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([kernel.signed(context[own]), kernel.signed(dish[own]), pa.array(many[i : i + 50_000])], ["context", "dish", "n"])


class _Seated:
    """The rooms of a batch with their customers seated ``turns`` times; tables are the average."""

    def __init__(self, batch: pa.RecordBatch, known: np.ndarray, classes: np.ndarray, hot_tables: np.ndarray, turn: int, turns: int) -> None:
        self.context = batch["context"].to_numpy().view(np.uint64)
        self.kind = _class_of(known, self.context)
        self.hot = self.kind != len(known)
        self.customers = batch["customers"].to_numpy()
        self.room = np.repeat(np.arange(len(self.context)), pc.list_value_length(batch["dishes"]).to_numpy(zero_copy_only=False))
        self.dish, self.counts, share = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("dishes", "counts", "shares"))
        self.dish = self.dish.view(np.uint64)
        self.dish_kind = _class_of(known, self.dish)
        self.parent = classes[self.kind[self.room], self.dish_kind] * share
        again = np.flatnonzero(self.counts > 1)  # a single customer always has one table
        rng = np.random.default_rng([turn, len(self.dish), int(kernel.mix(self.context[:1])[0] >> np.uint64(1)) if len(self.context) else 0])
        tables, total = np.ones(len(self.dish)), np.zeros(len(self.dish))
        for k in range(PASSES - 1 + turns):
            if len(again):
                pull = (STRENGTH + DISCOUNT * self.all_tables(tables, hot_tables)[self.room[again]]) * self.parent[again]
                tables[again] = seat(self.counts[again], pull, rng)
            if k >= PASSES - 1:
                total += tables
        self.tables = total / turns

    def all_tables(self, tables: np.ndarray, hot_tables: np.ndarray) -> np.ndarray:
        """Tables of each room's whole context; those of a context with several rooms are known from before."""
        return np.where(self.hot, hot_tables[self.kind], np.bincount(self.room, tables, minlength=len(self.context)))


def _sweep(sent: Broadcast, turn: int, turns: int = 1):
    """(cell, n): the tables that the contexts send to each dish of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes, hot_tables = sent.value
        width = len(known) + 2
        sums = np.zeros(width * width)
        for batch in batches:
            seated = _Seated(batch, known, classes, hot_tables, turn, turns)
            sums += np.bincount(seated.kind[seated.room] * width + seated.dish_kind, seated.tables, minlength=width * width)
        cells = np.flatnonzero(sums)
        for i in range(0, len(cells), 50_000):
            own = cells[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[own])], ["cell", "n"])

    return run


def _gains(sent: Broadcast, turn: int, turns: int, all_tables: np.ndarray):
    """What a pair gains over its class (is_pair), and what the contexts of other words leave to their class; log10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes, hot_tables = sent.value
        for batch in batches:
            seated = _Seated(batch, known, classes, hot_tables, turn, turns)
            left = STRENGTH + DISCOUNT * seated.all_tables(seated.tables, all_tables)
            gain = np.log10(1 + (seated.counts - DISCOUNT * seated.tables) / (left[seated.room] * seated.parent))
            rest = np.log10(left / (STRENGTH + seated.customers))[~seated.hot]
            keys = np.append(_pair_keys(seated.context[seated.room], seated.dish), seated.context[~seated.hot])
            is_pair = np.arange(len(keys)) < len(gain)
            many, value = np.append(seated.counts, seated.customers[~seated.hot]), np.append(gain, rest)
            for i in range(0, len(keys), 50_000):
                own = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(is_pair[own]), kernel.signed(keys[own]), pa.array(many[own]), pa.array(value[own])], ["is_pair", "key", "n", "value"])

    return run


def _seat_others(strength: float, base: float):
    """Average tables of each of the other words over as many sweeps as are averaged for contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch["word"].to_numpy(), batch["n"].to_numpy()
            tables = np.zeros(len(counts))
            for turn in range(SWEEPS - BURN_IN):
                # By size and hash, so a word is seated alike in whatever task and order it comes.
                draw = kernel.mix(words.view(np.uint64) + np.uint64(turn * 0x9E3779B9))
                order = np.argsort(draw)
                rng = np.random.default_rng([turn, len(counts), int(draw[order[0]] >> np.uint64(1)) if len(draw) else 0])
                own = np.zeros(len(counts))
                own[order] = seat(counts[order], np.full(len(counts), strength * base), rng)
                tables += own
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(tables / (SWEEPS - BURN_IN))], ["word", "n", "tables"])

    return run


@dataclass(frozen=True)
class Model:
    """All that scoring needs. ``known`` and ``table`` have a fixed size; ``words`` and ``pairs`` have a row per word and pair."""

    known: np.ndarray  # hashes of the frequent words
    table: np.ndarray  # log10 of the averaged probabilities, by class of context and of dish
    words: DataFrame  # (word, n, tables, back) of all training words; tables is missing for frequent ones; back: log10 of what a context leaves
    pairs: DataFrame  # (pair, n, gain) of all observed pairs; gain: log10 of the pair's probability over that of its class after back
    back_of_beginning: float
    tokens: int  # training tokens, ends included
    different: int  # different ones, the end included
    ends: int
    other_total: int  # customers and tables of the restaurant of other words
    other_tables: float


def _share(different: int, total: int, tables: float) -> Column:
    """The probability of an other word in its class."""
    strength = STRENGTH + DISCOUNT * tables
    return (F.greatest(F.col("n") - DISCOUNT * F.col("tables"), F.lit(0.0)) + strength / (different + 1)) / F.lit(STRENGTH + total)


def train(texts: DataFrame, model_words: int = MODEL_WORDS) -> Model:
    """Count the words and pairs of ``texts(text)`` and seat them; texts are counted whole and all of them."""
    spark = texts.sparkSession
    counts = stored(texts.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    ends = texts.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, different = (sums["n"] or 0) + ends, sums["v"] + (1 if ends else 0)
    top = counts.orderBy(F.desc("n"), "word").limit(model_words).collect()  # a parameter of the model
    known = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    width = len(known) + 2
    rare = counts.join(F.broadcast(spark.createDataFrame([(r["word"],) for r in top], "word long")), "word", "left_anti")
    strength = STRENGTH + DISCOUNT * max(different - len(known), 0)
    words = stored(rare.mapInArrow(_seat_others(strength, 1 / (different + 1)), "word long, n long, tables double"))
    others = words.agg(F.sum("n").alias("n"), F.sum("tables").alias("t")).first()
    other_total, other_tables = others["n"] or 0, others["t"] or 0.0

    rooms = stored(_rooms(texts, top, words.select(F.col("word").alias("_dish"), _share(different, other_total, other_tables).alias("share"))))
    hot_tables, hot_customers = np.zeros(width), np.zeros(width)
    frequent = spark.createDataFrame([(int(r["word"]), k) for k, r in enumerate(top)] + [(0, width - 1)], "context long, kind int")
    of_hot = rooms.join(F.broadcast(frequent), "context").groupBy("kind").agg(F.sum(F.size("dishes")).alias("t"), F.sum("customers").alias("n"))
    for r in of_hot.collect():  # a row per frequent word
        hot_tables[r["kind"]], hot_customers[r["kind"]] = r["t"], r["n"]

    def swept(classes: np.ndarray, turn: int, turns: int = 1) -> tuple[Broadcast, np.ndarray]:
        sent = spark.sparkContext.broadcast((known, classes, hot_tables))
        cells = rooms.mapInArrow(_sweep(sent, turn, turns), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # of the classes
        customers = np.zeros(width * width)
        customers[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
        return sent, customers.reshape(width, width)

    parent = np.full(width, 1 / width)
    classes, averages, before = np.tile(parent, (width, 1)), np.zeros((width, width)), None
    for turn in range(SWEEPS):
        sent, customers = swept(classes, turn)
        sent.unpersist()
        hot_tables, customers = customers.sum(1), np.rint(customers).astype(np.int64)
        before = np.count_nonzero(customers, axis=1) if before is None else before
        rng = np.random.default_rng([turn, 7])
        tables = seat(customers.ravel(), np.outer(STRENGTH + DISCOUNT * before, parent).ravel(), rng).reshape(width, width)
        before, sent_up = tables.sum(1), tables.sum(0)
        top_tables = seat(sent_up, np.full(width, (STRENGTH + DISCOUNT * max(np.count_nonzero(sent_up), 1)) / width), rng)
        parent = (np.maximum(sent_up - DISCOUNT * top_tables, 0) + (STRENGTH + DISCOUNT * top_tables.sum()) / width) / (STRENGTH + sent_up.sum())
        classes = (customers - DISCOUNT * tables + np.outer(STRENGTH + DISCOUNT * before, parent)) / (STRENGTH + customers.sum(1))[:, None]
        if turn >= BURN_IN:
            averages += classes / (SWEEPS - BURN_IN)
    # Seated twice alike: the first time shows all tables of the contexts that have several rooms.
    sent, customers = swept(averages, SWEEPS, SWEEPS - BURN_IN)
    all_tables = customers.sum(1)
    made = stored(rooms.mapInArrow(_gains(sent, SWEEPS, SWEEPS - BURN_IN, all_tables), "is_pair boolean, key long, n long, value double"))
    back = np.log10((STRENGTH + DISCOUNT * all_tables) / (STRENGTH + hot_customers))
    backs = made.filter("not is_pair").select(F.col("key").alias("word"), F.col("value").alias("back"))
    frequent = spark.createDataFrame([(r["word"], r["n"], None, float(back[k])) for k, r in enumerate(top)], "word long, n long, tables double, back double")
    return Model(known, np.log10(averages), words.join(backs, "word", "left").union(frequent), made.filter("is_pair").select(F.col("key").alias("pair"), "n", F.col("value").alias("gain")),
                 float(back[-1]), tokens, different, ends, other_total, other_tables)


def _rooms(texts: DataFrame, top: list, shares: DataFrame) -> DataFrame:
    """(context, room, customers, dishes, counts, shares): all observed pairs by context, those of frequent contexts in several rooms."""
    spark = texts.sparkSession
    own = F.broadcast(spark.createDataFrame([(int(r["word"]), True) for r in top] + [(0, True)], "own long, is_own boolean"))
    pairs = texts.select("text").mapInArrow(_count_pairs, "context long, dish long, n long").groupBy("context", "dish").agg(F.sum("n").alias("n"))
    flagged = pairs.join(own, F.col("dish") == F.col("own"), "left").select("context", "dish", "n", F.col("is_own").alias("often"))
    flagged = flagged.join(own, F.col("context") == F.col("own"), "left").select(
        "context", "dish", "n", "often", F.when(F.col("is_own"), F.pmod(F.xxhash64("dish"), F.lit(ROOMS))).otherwise(0).cast("int").alias("room"))
    # Frequent dishes are no other words and need no share; a hash of the pair keeps them from meeting in one task.
    keyed = flagged.withColumn("_dish", F.when(F.col("often"), F.xxhash64("context", "dish")).otherwise(F.col("dish")))
    shared = keyed.join(shares, "_dish", "left").select(
        "context", "room", "n", F.struct("dish", "n", F.when(F.col("often"), 1.0).otherwise(F.col("share")).alias("share")).alias("x"))
    return shared.groupBy("context", "room").agg(F.sum("n").alias("customers"), F.sort_array(F.collect_list("x")).alias("x")).select(
        "context", "room", "customers", F.col("x.dish").alias("dishes"), F.col("x.n").alias("counts"), F.col("x.share").alias("shares"))


def _listed(keys: np.ndarray, rows: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """The different keys of each text and how many times they are there."""
    _, first, many = np.unique(kernel.per_row(keys, rows), return_index=True, return_counts=True)
    order = np.argsort(rows[first], kind="stable")
    bounds = pa.array(np.searchsorted(rows[first][order], np.arange(texts + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(bounds, kernel.signed(keys[first][order])), pa.ListArray.from_arrays(bounds, pa.array(many[order].astype(np.int32))))


def _score(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, keys, bases, shares, pairs, gains, base_of_end, back_of_beginning = sent.value
        for batch in batches:
            for at, end, data, offsets in kernel.slices(batch["text"]):
                text = kernel.Text(data, offsets, lower=True)
                rows, context, hashes = _pairs(text)
                is_end = hashes == 0
                place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                sent_here = (keys[place] == hashes) & ~is_end if len(keys) else np.zeros(len(hashes), bool)
                base = np.where(is_end, base_of_end, 0.0)
                base[sent_here] = bases[place[sent_here]]
                score = table[_class_of(known, context), _class_of(known, hashes)]
                score[is_end] += back_of_beginning  # a text has one beginning and one end
                score[sent_here] += shares[place[sent_here]]
                own = _pair_keys(context, hashes)
                found = kernel.contains(pairs, own)
                score[found] += gains[np.searchsorted(pairs, own[found])]
                rest = ~sent_here & ~is_end
                count = lambda w=None: np.bincount(rows, w, minlength=text.rows)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"][at:end], batch["_key"][at:end], pa.array(count()), pa.array(count((sent_here | is_end).astype(float)).astype(np.int64)),
                    pa.array(count(base)), pa.array(count(score)), *_listed(hashes[rest], rows[rest], text.rows), *_listed(own[~found], rows[~found], text.rows),
                ], ["doc_id", "_key", "n_tokens", "n_known", "base_score", "score", "words", "times", "pairs", "pair_times"])

    return run


def score(documents: DataFrame, model: Model, sent_words: int = SENT_WORDS, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents(doc_id, text)``.

    Scores are log10 probabilities of the whole text with its end. A missing or
    empty text is its end alone. Repeated rows get equal scores; other columns
    do not matter; no rows give no rows. If nothing was trained on, every token
    has the even base's probability.
    """
    spark = documents.sparkSession
    total = model.tokens + 0.5 * (model.different + 1)
    strength = STRENGTH + DISCOUNT * model.other_tables
    base = F.log10((F.col("n") + 0.5) / F.lit(total))
    # A word's share in its class, if it is not one by itself, and what it leaves to the class of the next word.
    share = F.when(F.col("tables").isNull(), 0.0).otherwise(F.log10(_share(model.different, model.other_total, model.other_tables))) + F.col("back")
    valued = model.words.select("word", base.alias("base"), share.alias("share"), "n")
    top = valued.orderBy(F.desc("n"), "word").limit(sent_words).select("word", "base", "share").toPandas()  # bounded by the parameter
    top = top.sort_values("word", key=lambda w: w.to_numpy().view(np.uint64))
    pairs = model.pairs.orderBy(F.desc("n"), "pair").limit(sent_pairs).select("pair", "gain").toPandas()  # bounded by the parameter
    pairs = pairs.sort_values("pair", key=lambda w: w.to_numpy().view(np.uint64))
    base_of_end = float(np.log10((model.ends + 0.5) / total))
    sent = spark.sparkContext.broadcast((
        model.known, model.table, top["word"].to_numpy(np.int64).view(np.uint64), top["base"].to_numpy(), top["share"].to_numpy(),
        pairs["pair"].to_numpy(np.int64).view(np.uint64), pairs["gain"].to_numpy(), base_of_end, model.back_of_beginning))
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    seen = stored(rows.mapInArrow(_score(sent), f"doc_id {kind}, _key long, n_tokens long, n_known long, base_score double, score double, "
                                                 "words array<long>, times array<int>, pairs array<long>, pair_times array<int>"))
    # Words and pairs that did not go out: joined with their values, then summed per text. Equal rows share a key, so sums are per copy.
    copies = seen.groupBy("_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rest = seen.filter("size(words) > 0").select("_key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("_key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    unseen_base, unseen_share = np.log10(0.5 / total), np.log10(strength / (model.different + 1) / (STRENGTH + model.other_total))
    found = rest.join(valued, "word", "left").select(
        "_key", (F.col("times") * F.coalesce("base", F.lit(float(unseen_base)))).alias("base"),
        (F.col("times") * F.coalesce("share", F.lit(float(unseen_share)))).alias("share"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"))
    paired = seen.filter("size(pairs) > 0").select("_key", F.explode(F.arrays_zip("pairs", "pair_times")).alias("x")).select("_key", F.col("x.pairs").alias("pair"), F.col("x.pair_times").alias("times"))
    gained = paired.join(model.pairs, "pair").select("_key", F.lit(0.0).alias("base"), (F.col("times") * F.col("gain")).alias("share"), F.lit(0).alias("known"))
    sums = found.union(gained).groupBy("_key").agg(*[F.sum(c).alias(f"_{c}") for c in ("base", "share", "known")]).join(copies, "_key", "left")
    one = F.coalesce("copies", F.lit(1))
    added = lambda name: F.coalesce(F.col(f"_{name}") / one, F.lit(0.0))
    joined = seen.drop("words", "times", "pairs", "pair_times").join(sums, "_key", "left")
    return joined.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "n_tokens",
        (F.col("n_known") + added("known")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + added("base")).alias("base_score"), (F.col("score") + added("share")).alias("score"))


@query("op6_pitman_yor")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return score(documents, train(documents.filter(fold(F.col("doc_id")) != HELD_OUT_FOLD)))
