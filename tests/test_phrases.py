"""Phrase tables against replacing one phrase after the other."""

import random
import re

from pyspark.sql import functions as F

from larder.functions import text as X
from larder.plans.phrases import add_phrases, keyed_phrases, phrases_found

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 6))) for _ in range(4_000)]


def some_words(most):
    return " ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, most)))


def replaced(spark, texts, table):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("m", X.mark_words(F.col("text")))
    phrases = spark.createDataFrame(table, "place int, old string, new string")
    held = add_phrases(df, keyed_phrases(phrases), "m", "p")
    return {r["id"]: r["out"] for r in held.select("id", X.unmark(X.swap_phrases(F.col("m"), F.col("p"))).alias("out")).collect()}


def one_by_one(text, table):
    text = X.marked(text)
    for _, old, new in sorted(table):
        if re.search(r"\w", old):
            text = text.replace(X.marked(old), X.marked(new or ""))
    return re.sub(f"[{X.WORD_START}{X.WORD_END}]", "", text)


def test_fifty_thousand_phrases(spark):
    # One in fifty brings in words that other phrases have.
    table = [(i, some_words(5), some_words(3) if i % 50 == 0 else f"new{i} word" if i % 3 else "") for i in range(50_000)]
    texts = [some_words(12) for _ in range(60)] + ["", "zzz", texts_end := "a, b-c"] + [texts_end]
    assert replaced(spark, texts, table) == {i: one_by_one(t, table) for i, t in enumerate(texts)}


def test_replacements_that_complete_others(spark):
    table = [(5, "c d", "e f"), (1, "a", "b"), (2, "b x", "c"), (3, "c y", "c d"), (7, "e f", "done"), (0, "done", "never"), (9, "-", "?"), (8, "q", None)]
    texts = ["a x y", "a x y z", "b", "x a", "done a", "q - q", None]
    got = replaced(spark, [t or "" for t in texts], table)
    assert got == {i: one_by_one(t or "", table) for i, t in enumerate(texts)}
    assert got[0] == "done" and got[4] == "never b"


def test_found_phrases_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "gluten free and vegan"), (2, "vegans"), (3, "vegan vegan"), (3, "vegan vegan")], "id int, text string")
    df = df.withColumn("m", X.mark_words(F.col("text")))
    phrases = spark.createDataFrame([(2, "vegan", "V"), (1, "gluten free", "G"), (3, "free and", "V")], "place int, old string, new string")
    got = phrases_found(df, "m", phrases, "tags").select("id", "tags").collect()
    assert sorted((r["id"], r["tags"]) for r in got) == [(1, ["G", "V"]), (2, []), (3, ["V"]), (3, ["V"])]
    assert {tuple(r["tags"]) for r in phrases_found(df, "m", phrases.limit(0), "tags").collect()} == {()}
    assert phrases_found(df.limit(0), "m", phrases, "tags").collect() == []
