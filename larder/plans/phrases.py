"""Phrase tables of any size, as DataFrames.

A literal list in the plan is folded over every text and grows with the table.
Here a text first finds the phrases that can ever occur in it, by a join on
each phrase's rarest word, and only those are folded over it, in the order of the table. A replacement may
complete a later phrase, so the words that found phrases bring in are looked up
too, until no text finds any more. The result is that of the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.operators.annotate import normal_spacing, normal_words
from larder.plans.joins import checked_join
from larder.session import cut_lineage

FOUND = "array<struct<place:bigint,old:string,new:string>>"


def words_of(marked_text: Column) -> Column:
    """The different words of a marked text."""
    return F.array_distinct(X.tokens(marked_text, f"{X.WORD_START}[^{X.WORD_END}]*{X.WORD_END}"))


def keyed_phrases(phrases: DataFrame) -> DataFrame:
    """(place, old, new, words, key) of ``phrases(place, old, new)``: marked, and the word that the fewest phrases have.

    ``place`` orders the table. Phrases without a word are left out: as whole phrases they occur nowhere. NULL in ``new`` is nothing.
    """
    marked = phrases.select(F.col("place").cast("long").alias("place"), X.mark_words(F.col("old")).alias("old"),
                            X.mark_words(F.coalesce("new", F.lit(""))).alias("new"))
    marked = cut_lineage(marked.withColumn("words", words_of(F.col("old"))).filter(F.size("words") > 0))
    counts = marked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    spread = marked.select("place", F.explode("words").alias("word")).join(counts, "word")
    keys = spread.groupBy("place").agg(F.min_by("word", F.struct("n", "word")).alias("key"))
    return cut_lineage(marked.join(keys, "place"))


def add_phrases(texts: DataFrame, keyed: DataFrame, marked_text: str, into: str) -> DataFrame:
    """Add the phrases that can occur in each row's marked text, in table order, as ``into``.

    ``keyed`` comes from :func:`keyed_phrases`. A row without any has an empty list; the number of rounds is that of replacements that complete one another.
    """
    rows = cut_lineage(texts.withColumn("_id", F.xxhash64(marked_text)))
    # Rows with one text are looked up once; the text itself tells equal hashes apart.
    state = rows.select("_id", F.col(marked_text).alias("_text")).distinct()
    state = cut_lineage(state.select("_id", "_text", words_of(F.col("_text")).alias("_words"), words_of(F.col("_text")).alias("_new"), F.array().cast(FOUND).alias("_found")))
    done = []
    while True:
        asked = state.select("_id", "_text", "_words", F.explode("_new").alias("key"))
        # A phrase whose key is there may lack a word that only comes in later: it waits.
        met = checked_join(asked, keyed, ["key"], ["_id"]).select("_id", "_text", "_words", F.struct("place", "old", "new", "words").alias("p"))
        waiting = met.groupBy("_id", "_text").agg(F.collect_list("p").alias("_met"))
        grown = state.join(waiting, ["_id", "_text"], "left")
        pending = F.coalesce("_met", F.array().cast("array<struct<place:bigint,old:string,new:string,words:array<string>>>"))
        if "_pending" in state.columns:
            pending = F.concat("_pending", pending)
        lacks = lambda p: F.size(F.array_except(p["words"], F.col("_words")))
        grown = grown.withColumn("_waiting", pending)
        # New names in each step: a name that is given again would be read inside the functions of the same step.
        grown = grown.withColumns({"_fit": F.filter("_waiting", lambda p: lacks(p) == 0), "_left": F.filter("_waiting", lambda p: lacks(p) > 0)})
        grown = grown.withColumn("_brought", F.array_except(F.flatten(F.transform("_fit", lambda p: words_of(p["new"]))), F.col("_words")))
        hits = F.transform("_fit", lambda p: F.struct(p["place"], p["old"], p["new"]))
        grown = grown.select("_id", "_text", F.concat("_words", "_brought").alias("_words"), F.col("_brought").alias("_new"),
                             F.concat("_found", hits).alias("_found"), F.col("_left").alias("_pending"))
        grown = cut_lineage(grown)
        done.append(grown.filter(F.size("_new") == 0))
        state = grown.filter(F.size("_new") > 0)
        if state.isEmpty():
            break
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    listed = whole.select("_id", F.col("_text").alias(marked_text), F.array_sort("_found").alias(into))
    return checked_join(rows, listed, ["_id", marked_text], ["_id"]).drop("_id", "_part")


def normalize_by_table(texts: DataFrame, text: str, phrases: DataFrame, into: str) -> DataFrame:
    """Add the normal form of a text column, with phrases replaced by a table and not by the built-in lists."""
    marked = texts.withColumn("_marked", normal_words(F.coalesce(F.col(text), F.lit(""))))
    held = add_phrases(marked, keyed_phrases(phrases), "_marked", "_phrases")
    return held.withColumn(into, normal_spacing(X.swap_phrases(F.col("_marked"), F.col("_phrases")))).drop("_marked", "_phrases")


def phrases_found(texts: DataFrame, marked_text: str, phrases: DataFrame, into: str) -> DataFrame:
    """Add ``new`` of all phrases that occur in the marked text as whole words, different ones in table order."""
    plain = keyed_phrases(phrases.withColumn("kind", F.col("new")).withColumn("new", F.lit("")))
    kinds = phrases.select(F.col("place").cast("long").alias("place"), F.col("new").alias("_kind"))
    held = add_phrases(texts, cut_lineage(plain.join(kinds, "place").withColumn("new", F.col("_kind")).drop("_kind")), marked_text, "_phrases")
    found = F.filter("_phrases", lambda p: F.contains(F.col(marked_text), p["old"]))
    return held.withColumn(into, F.array_distinct(F.transform(found, lambda p: p["new"]))).drop("_phrases")
