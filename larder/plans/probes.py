"""What intents are looked up by: the text that the fewest products offer, by counted frequencies.

An intent can be looked up by any text that all its products must contain: a
piece of its category, a word, a dietary label. The statistics table holds how
many products offer each tag and word of the catalog. A text's load is the sum
over the terms that contain it, so it is known before any product is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.functions.text import strings, strip, tokens
from larder.plans.joins import checked_join, fits, spread_join, substring_pairs
from larder.session import cut_lineage

PROBE = ["kind", "pattern"]
ROW = ["_row", "_row2"]


def add_row_key(products: DataFrame) -> DataFrame:
    """Add 128 bits of hash over all columns that can be hashed: rows without a code are told apart, equal rows share a key."""
    columns = [f.name for f in products.schema.fields if "map" not in f.dataType.simpleString()]
    return products.withColumns({"_row": F.xxhash64(*columns), "_row2": F.xxhash64(F.lit(1), *columns)})


def probe_texts() -> Column:
    """All texts an intent can be looked up by, as (kind, pattern); with none, the one that every product offers."""
    named = lambda kind, texts: F.transform(texts, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))
    known = F.array_intersect("dietary_tags", strings(tables.LABEL_PATTERNS))
    tags = F.filter(F.transform(F.split(F.coalesce("wanted", F.lit("")), ","), strip), lambda p: p != "")
    words = F.flatten(F.transform("keywords", lambda k: tokens(k, "[a-z0-9]+")))
    found = F.array_distinct(F.concat(named("tag", tags), named("word", words), named("diet", known)))
    return F.when(F.size(found) > 0, found).otherwise(named("any", F.array(F.lit(""))))


def product_terms(kinds: list[str]) -> Column:
    """What a product offers to the probes of these kinds, as (kind, term)."""
    lists = {
        "tag": F.array_distinct(F.transform("category_terms", F.lower)),
        "word": F.array_distinct(tokens(F.lower("combined_text"), "[a-z0-9]+")),
        "diet": F.col("diets"),
        "any": F.array(F.lit("")),
    }

    def named(kind: str) -> Column:
        return F.transform(lists[kind], lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    return F.concat(*map(named, kinds))


def term_counts(products: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, term, n): how many products offer each term. Counts are merged inside each task, also those of a term in every row."""
    return products.select(F.explode(product_terms(kinds)).alias("t")).groupBy("t.kind", "t.term").agg(F.count(F.lit(1)).alias("n"))


def choose_probes(products: DataFrame, texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The probe of each ``key`` in the stored ``texts(key, kind, pattern)``, with its load; the bridge to terms; the kinds in use.

    The load is the number of (product, term) pairs that contain the text, the least of which wins; equal ones go by
    kind and text. The bridge holds (kind, term, pattern) of all texts that were asked for. A text that no product
    offers has load 0: its key is served by nothing, and the bridge has no row for it.
    """
    patterns = texts.select(*PROBE).distinct()
    kinds = sorted(row["kind"] for row in patterns.select("kind").distinct().collect())  # at most four
    if not kinds:
        return texts.select(key, *PROBE, F.lit(0).cast("long").alias("load")), patterns.withColumn("term", F.col("pattern")), []
    counts = cut_lineage(term_counts(products, kinds))
    bridge = patterns.filter(~F.col("kind").isin("tag", "word")).withColumn("term", F.col("pattern"))
    searched = [k for k in kinds if k in ("tag", "word")]
    if searched:
        vocabulary = counts.filter(F.col("kind").isin(searched)).select("kind", "term")
        bridge = bridge.unionByName(substring_pairs(vocabulary, patterns.filter(F.col("kind").isin(searched))))
    bridge = cut_lineage(bridge.join(counts, ["kind", "term"]))
    loads = patterns.join(bridge.groupBy(*PROBE).agg(F.sum("n").alias("load")), PROBE, "left")
    loads = loads.withColumn("load", F.coalesce("load", F.lit(0).cast("long")))
    probe = F.struct("load", *PROBE)
    chosen = checked_join(texts, loads, PROBE, [key]).groupBy(key).agg(F.min(probe).alias("_least")).select(key, "_least.*")
    return chosen, bridge.select("kind", "term", "pattern"), kinds


def offers_for(products: DataFrame, bridge: DataFrame, probed: DataFrame, kinds: list[str]) -> DataFrame:
    """Products (with :func:`add_row_key`) and every probe text of ``probed(kind, pattern)`` they contain, each pair once.

    ``bridge(kind, term, pattern)`` says which terms contain which texts.
    """
    bridge = bridge.join(probed.select(*PROBE).distinct(), PROBE, "left_semi")
    if fits(bridge):
        # Map-side: the row meets its probe texts without a shuffle. A probe text
        # found in two terms of one product counts at the first of them.
        rows = products.withColumn("_terms", product_terms(kinds)).select("*", F.posexplode("_terms").alias("_at", "_own"))
        rows = rows.withColumns({"kind": F.col("_own.kind"), "term": F.col("_own.term")})
        found = rows.join(F.broadcast(bridge), ["kind", "term"])
        earlier = F.exists(
            F.slice("_terms", F.lit(1), F.col("_at")),
            lambda t: (t["kind"] == F.col("kind")) & F.contains(t["term"], F.col("pattern")),
        )
        return found.filter(~earlier).drop("_terms", "_at", "_own", "term")
    # Otherwise only keys and terms are shuffled before the rows are fetched.
    slim = products.select(*ROW, F.explode(product_terms(kinds)).alias("t")).select(*ROW, "t.*")
    found = spread_join(slim, bridge, ["kind", "term"], ROW).select(*ROW, *PROBE).distinct()
    return products.join(found, ROW)
