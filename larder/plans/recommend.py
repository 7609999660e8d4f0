"""Better products of the same category, for the whole catalog or for a query log.

The order of recommendations depends on the recommended product alone. So a
category's pool is ranked once and only its best few rows meet the category's
products: no product is ever paired with its whole category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import tables
from larder.functions.text import strip
from larder.operators.insights import add_insights
from larder.operators.predicates import text_tokens
from larder.operators.quality import add_quality
from larder.operators.recommend import improvements
from larder.plans.joins import checked_join, spread_join
from larder.plans.search import add_search_key, complete_intents, reading, search_intents, search_mentions
from larder.session import cut_lineage

COMPARED = ["code", "name", "quality", "nutriscore", "nova_group", "additives_count",
            *[n for n, _ in tables.LESS_IS_BETTER + tables.MORE_IS_BETTER]]


def first_category() -> Column:
    """First display category of a product, NULL without any."""
    return F.nullif(F.try_element_at(F.col("categories"), F.lit(1)), F.lit(""))


def reference_products(products: DataFrame, targets: DataFrame) -> DataFrame:
    """The first product in candidate order that mentions all words of ``target``.

    ``targets(target)`` holds distinct texts. Neither the country nor the name
    filter applies.
    """
    words = F.array_distinct(text_tokens(F.col("target")))
    return search_mentions(products, targets.withColumn("words", words).filter(F.size("words") > 0), "target")


def category_pools(products: DataFrame, pools: DataFrame, limit: int = tables.CATEGORY_POOL_ROWS) -> DataFrame:
    """Candidates of each pool. ``pools`` have ``category`` and/or ``search_terms``."""
    return search_intents(products, pools, limit=limit, relaxed=False)


def best_of_pools(candidates: DataFrame, keep: int = tables.RECOMMENDED_ROWS) -> DataFrame:
    """The rows of a pool that can be among the ``keep`` best for any reference.

    A reference leaves out the rows with its own code, so ``keep`` rows plus as
    many as share one code are enough. A pool has 250 rows at most.
    """
    best = Window.partitionBy("intent_id").orderBy(F.col("quality").desc(), F.col("candidate_rank").asc())
    copies = F.count(F.lit(1)).over(Window.partitionBy("intent_id", "code"))
    most = F.max("_copies").over(Window.partitionBy("intent_id"))
    ranked = add_quality(candidates).withColumn("_copies", copies)
    ranked = ranked.withColumns({"pool_place": F.row_number().over(best), "_most": most})
    return ranked.filter(F.col("pool_place") <= keep + F.col("_most")).drop("_copies", "_most")


def pool_lists(best: DataFrame) -> DataFrame:
    """The rows of :func:`best_of_pools` as one ordered list per pool (250 entries at most)."""
    entry = F.struct(*[c for c in best.columns if c != "intent_id"])
    lists = best.groupBy("intent_id").agg(F.collect_list(entry).alias("pool"))
    return lists.withColumn("pool", F.array_sort("pool", lambda a, b: a["pool_place"] - b["pool_place"]))


def pick_recommendations(pairs: DataFrame, keep: int = tables.RECOMMENDED_ROWS) -> DataFrame:
    """From (reference, pool list) rows the best entries per reference, with what they do better.

    The list is in rank order already, so picking is done in the row, without a shuffle.
    """
    chosen = F.slice(
        F.filter("pool", lambda p: (p["code"] != F.col("ref_code"))
                 & (p["quality"] > F.col("ref_quality") * tables.MIN_GAIN)),
        1, keep)
    own = [c for c in pairs.columns if c not in ("pool", "intent_id", "_part")]
    rows = pairs.withColumn("_chosen", chosen).select(*own, F.posexplode("_chosen").alias("_at", "_product"))
    picked = rows.select(*own, (F.col("_at") + 1).alias("rank"), "_product.*")
    return add_insights(picked).withColumn("improvements", improvements())


def _as_reference(products: DataFrame) -> list[Column]:
    return [F.col(c).alias(f"ref_{c}") for c in COMPARED]


def recommend_all(products: DataFrame, keep: int = tables.RECOMMENDED_ROWS) -> DataFrame:
    """Recommendations for every product of the catalog that has a category."""
    scored = add_quality(products).withColumn("ref_category", first_category())
    references = scored.filter(F.col("ref_category").isNotNull()).select("ref_category", *_as_reference(scored))
    pools = references.select(F.col("ref_category").alias("category")).distinct()
    lists = pool_lists(best_of_pools(category_pools(products, pools), keep))
    heads = add_search_key(pools).select(F.col("category").alias("ref_category"), "intent_id").join(lists, "intent_id")
    pairs = checked_join(references, heads, ["ref_category"], ["ref_code"])
    return pick_recommendations(pairs, keep)


def compare_queries(products: DataFrame, queries: DataFrame, keep: int = tables.RECOMMENDED_ROWS) -> DataFrame:
    """Recommendations for queries that compare ("healthier alternative to X").

    ``queries`` carry ``text``, ``comparison_product`` and intent columns. Their
    reference product's first category makes the pool; without one the query's
    category does, and without that its search terms do.
    """
    own = reading(queries)
    asked = cut_lineage(complete_intents(queries).filter(F.coalesce("comparison_product", F.lit("")) != "").select(
        *own, strip(F.col("comparison_product")).alias("target"),
        F.col("category").alias("own_category"), F.col("search_terms").alias("own_terms"),
    ))
    references = cut_lineage(reference_products(products, asked.select("target").distinct()))
    scored = add_quality(references).withColumn("ref_category", first_category())
    known = asked.join(scored.select("target", "ref_category", *_as_reference(scored)), "target")
    pooled = known.withColumn("category", F.coalesce("ref_category", F.nullif("own_category", F.lit(""))))
    terms = F.when(F.col("category").isNull(), F.col("own_terms")).otherwise(F.array().cast("array<string>"))
    pooled = add_search_key(pooled.withColumn("search_terms", terms)).select(
        *own, "target", "category", "search_terms", "intent_id", *[f"ref_{c}" for c in COMPARED]
    )
    pools = pooled.select("category", "search_terms").distinct()
    lists = pool_lists(best_of_pools(category_pools(products, pools), keep))
    pairs = spread_join(pooled.drop("category", "search_terms"), lists, ["intent_id"], ["text"])
    return pick_recommendations(pairs, keep)
