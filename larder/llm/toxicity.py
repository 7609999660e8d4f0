"""Toxicity by a weighted finite-state grammar over clauses.

Four small transducers read the words of a clause: insults and threats give
weight, a negation before them and reported speech take some away, a person who
is meant adds some. They are composed into one machine. A document is scored by
its clauses, not by single words: the heaviest clause, the sum of all, and how
many there are; a logistic fit on labelled rows turns that into a probability.

Which words insult is learned from labelled rows too, as their log odds. The
words of the other transducers are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import kernel
from larder.llm.common import drawn, fold, logistic, probability, query, read
from larder.session import cut_lineage

SAMPLE_LABELS = 40_000  # labelled rows that words and weights are learned from
LEXICON_WORDS = 400  # insulting words at most
LEAST_DOCUMENTS = 5  # with a word, for it to be learned
LEAST_Z = 4.0  # its log odds in standard errors
THREAT_WEIGHT = 2.0
HELD_OUT_FOLD = 0

# Fixed words of the other transducers: English, German, French, Spanish.
THREATS = "kill hurt destroy attack beat shoot stab burn die töten umbringen schlagen tuer frapper mourir matar golpear morir".split()
TARGETS = "you your you're he she they him her them this these du dich ihr euch tu toi vous usted ustedes tú ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't nobody without nicht kein keine nie sans jamais pas nunca sin".split()
REPORTS = "said says say called quoted reported wrote claims allegedly sagte sagt schrieb dit disait dijo dice escribió".split()

SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n"]] = True
_OPENS = np.zeros(256, bool)  # breaks that what is reported goes on after, right behind the report word
_OPENS[[ord(c) for c in ",:"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_LETTER[ord("'")] = True


class Transducer:
    """States, and for each state and symbol the next state and a factor; a factor for each state a clause ends in."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, float]], last: dict[int, float] | None = None) -> None:
        self.arcs = arcs
        self.last = last or {}

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, 1.0))

    def end(self, state) -> float:
        return self.last.get(state, 1.0)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that runs both side by side and multiplies their factors."""
    arcs, last, todo, seen = {}, {}, [(0, 0)], {(0, 0): 0}
    while todo:
        pair = todo.pop()
        last[seen[pair]] = a.end(pair[0]) * b.end(pair[1])
        for symbol in SYMBOLS:
            (x, f), (y, g) = a.step(pair[0], symbol), b.step(pair[1], symbol)
            if (x, y) not in seen:
                seen[x, y] = len(seen)
                todo.append((x, y))
            arcs[seen[pair], symbol] = seen[x, y], f * g
    return Transducer(arcs, last)


def _negation() -> Transducer:
    """A negation takes 70 % off what comes within three words after it."""
    arcs: dict = {(0, "negation"): (3, 1.0)}
    for left in (1, 2, 3):
        for symbol in SYMBOLS:
            arcs[left, symbol] = (left - 1, 0.3 if symbol in ("insult", "threat") else 1.0)
        arcs[left, "negation"] = (3, 1.0)
    return Transducer(arcs)


def _report() -> Transducer:
    """What is reported counts half up to the end of the clause; a report word right before ',' or ':' is read again after it."""
    arcs: dict = {(0, "report"): (1, 1.0)}
    for symbol in ("insult", "threat"):
        arcs[1, symbol] = (1, 0.5)
    return Transducer(arcs)


def _target() -> Transducer:
    """A clause that means somebody counts a quarter more."""
    return Transducer({(0, "target"): (1, 1.0)}, {1: 1.25})


def _threat() -> Transducer:
    """A threat counts in full only if the clause names whom it means before it."""
    return Transducer({(0, "target"): (1, 1.0), (0, "threat"): (0, 0.25)})


def grammar() -> Transducer:
    return compose(compose(_negation(), _report()), compose(_target(), _threat()))


def clause_score(machine: Transducer, symbols: list[str], weights: list[float]) -> float:
    """The weight of one clause."""
    state, total = 0, 0.0
    for symbol, weight in zip(symbols, weights):
        state, factor = machine.step(state, symbol)
        total += weight * factor
    return total * machine.end(state)


def _hashes(words: list[str]) -> np.ndarray:
    for _, _, data, offsets in kernel.slices(pa.array(words, pa.string())):
        return kernel.Text(data, offsets, lower=True).hashes(offsets[:-1], offsets[1:])
    return np.zeros(0, np.uint64)


class Lexicon:
    """Hashes of all words that matter, with their symbol and weight."""

    def __init__(self, insults: list[tuple[int, float]]) -> None:
        table: dict[int, tuple[str, float]] = {}
        fixed = (("target", TARGETS, 0.0), ("negation", NEGATIONS, 0.0), ("report", REPORTS, 0.0), ("threat", THREATS, THREAT_WEIGHT))
        for symbol, words, weight in fixed:
            table |= {int(h): (symbol, weight) for h in _hashes(words)}
        table |= {h: ("insult", w) for h, w in insults}
        self.keys = np.array(sorted(table), np.uint64)
        self.symbols = [table[int(k)][0] for k in self.keys]
        self.weights = np.array([table[int(k)][1] for k in self.keys])
        self.machine = grammar()


def _tokens(text: kernel.Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and clause of each word, and whether a single ',' or ':' parts it from the word before."""
    starts, ends = text.spans(_LETTER[text.data])
    breaks = np.cumsum(_BREAK[text.data])
    rows = text.row_of(starts)
    clauses = breaks[starts] + rows if len(starts) else np.zeros(0, np.int64)
    opens = np.cumsum(_OPENS[text.data])[starts] if len(starts) else clauses
    opened = np.zeros(len(starts), bool)
    opened[1:] = (np.diff(rows) == 0) & (np.diff(clauses) == 1) & (np.diff(opens) == 1)
    return text.hashes(starts, ends), rows, clauses, opened


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bad, good): in how many documents of each label a word is, per task."""
    keys, bad, good = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for batch in batches:
        toxic = np.array(batch["toxic"].to_pylist(), np.int64)
        for at, end, data, offsets in kernel.slices(batch["text"]):
            hashes, rows, _, _ = _tokens(kernel.Text(data, offsets, lower=True))
            _, first = np.unique(kernel.per_row(hashes, rows), return_index=True)
            label = toxic[at:end][rows[first]]
            all_keys = np.concatenate([keys, hashes[first]])
            bad, good = np.concatenate([bad, label]), np.concatenate([good, 1 - label])
            keys, place = np.unique(all_keys, return_inverse=True)
            bad, good = np.bincount(place, bad, len(keys)), np.bincount(place, good, len(keys))
    for i in range(0, len(keys), 50_000):
        part = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays(
            [kernel.signed(keys[part]), pa.array(bad[part].astype(np.int64)), pa.array(good[part].astype(np.int64))], ["key", "bad", "good"])


def learn_lexicon(labelled: DataFrame) -> list[tuple[int, float]]:
    """(hash, log odds) of the words that mark ``labelled(text, toxic)``; a bounded list."""
    totals = labelled.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not totals["bad"] or not totals["good"]:
        return []
    counts = labelled.select("text", "toxic").mapInArrow(_count_words, "key long, bad long, good long").groupBy("key").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") + F.col("good") >= LEAST_DOCUMENTS)
    without = lambda name: F.lit(float(totals[name])) - F.col(name) + 0.5
    odds = F.log((F.col("bad") + 0.5) / without("bad")) - F.log((F.col("good") + 0.5) / without("good"))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / without("bad") + 1 / (F.col("good") + 0.5) + 1 / without("good"))
    found = counts.select("key", odds.alias("odds"), (odds / error).alias("z")).filter(F.col("z") >= LEAST_Z)
    return [(r["key"] % 2**64, r["odds"]) for r in found.orderBy(F.desc("z"), "key").limit(LEXICON_WORDS).collect()]


def _features(lexicon: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lexicon = lexicon.value
        heavy = np.append(known.weights > 0, False)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_text"]
            for at, end, data, offsets in kernel.slices(batch["_text"]):
                hashes, rows, clauses, opened = _tokens(kernel.Text(data, offsets, lower=True))
                place = np.minimum(np.searchsorted(known.keys, hashes), len(known.keys) - 1)
                place = np.where(known.keys[place] == hashes, place, -1)
                top, total, many = np.zeros(end - at), np.zeros(end - at), np.zeros(end - at)
                for clause in np.unique(clauses[heavy[place]]):
                    lo, hi = np.searchsorted(clauses, clause, "left"), np.searchsorted(clauses, clause, "right")
                    goes_on = opened[lo] and place[lo - 1] >= 0 and known.symbols[place[lo - 1]] == "report"
                    own = place[lo - 1 if goes_on else lo : hi]
                    score = clause_score(known.machine, ["other" if k < 0 else known.symbols[k] for k in own],
                                         [0.0 if k < 0 else known.weights[k] for k in own])
                    row = rows[lo]
                    top[row], total[row], many[row] = max(top[row], score), total[row] + score, many[row] + 1
                words = np.bincount(rows, minlength=end - at)
                made = [top, np.log1p(total), np.log1p(many), total / np.sqrt(words + 20), (top > 0).astype(float)]
                yield pa.RecordBatch.from_arrays([batch[n][at:end] for n in names] + [pa.array(x) for x in made],
                                                 [*names, *[f"_f{i}" for i in range(len(made))]])

    return run


FEATURES = [f"_f{i}" for i in range(5)]


def features(documents: DataFrame, lexicon: list[tuple[int, float]], keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with what the grammar finds in ``text``."""
    sent = documents.sparkSession.sparkContext.broadcast(Lexicon(lexicon))  # a bounded list
    rows = documents.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_features(sent), ", ".join([*kinds, *[f"{f} double" for f in FEATURES]]))


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents(doc_id, text)``.

    ``labels(doc_id, toxic)`` is learned from only where the id is not in the
    held-out fold. A missing or empty text has no clauses and gets the share of
    toxic rows among texts without any. Without labels of both kinds, every
    score is 0. Repeated labels of one id count once, as toxic if any is.
    Repeated documents get a row each; other columns do not matter.
    """
    learned = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    chosen = cut_lineage(drawn(learned.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), sample, "doc_id"))
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about ``sample`` rows
    lexicon = learn_lexicon(labelled)
    held_out = (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out")
    if not lexicon:
        return documents.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    seen = features(labelled, lexicon, ["toxic"]).toPandas()
    weights = logistic(seen[FEATURES].to_numpy(), seen["toxic"].to_numpy(float))
    scored = features(documents, lexicon, ["doc_id"]).withColumn("score", probability(weights, [F.col(f) for f in FEATURES]))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))
