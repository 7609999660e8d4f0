"""Search a whole table of intents against a whole catalog.

A query asks for products whose text contains its category, words and labels
and whose nutrients lie within its bounds, in one product order with two
switches. That is planned as joins, not as one query after the other:

1. Intents are deduplicated; each gets one *probe*, the text it needs that the
   fewest products offer (:mod:`larder.plans.probes`).
2. The catalog's distinct tags or words are matched to the distinct probe texts
   by substring. Products and intents then meet in an
   equi-join on the probe, and the full predicates are checked on each pair.
3. Most intents find enough among the first products of their probe. So the
   first ``HEAD_ROWS`` products per probe, in result order, are tried first.
   Whoever is not served completely by them goes against all its products: at
   once if the counted loads are small, else by blocks whose
   amounts its bounds allow, best block first (:mod:`larder.plans.blocks`).

Relaxation costs no further run: bounds of all levels are tested on a pair, the
lowest level that passes is kept, and an intent keeps its lowest level only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import tables
from larder.operators.intents import add_relaxations
from larder.operators.ordering import ORDERED_BY, candidate_order, first_rows, nutrition_heuristic
from larder.operators.predicates import (
    CONSTRAINT_TYPE, has_diets, keyword_list, known_diets, loosest_limits, mentions_all, passes_bounds,
    present_nutrients, within_limits, without_ingredients,
)
from larder.plans import blocks
from larder.plans.joins import checked_join, spread_join
from larder.plans.probes import PROBE, ROW, add_row_key, choose_probes, offers_for, probe_texts
from larder.session import cut_lineage

HEAD_ROWS = 1000  # Spark itself cuts groups of as many rows down before the shuffle

INTENT_COLUMNS = {
    "category": "string",
    "category_tag": "string",
    "nutrient_constraints": f"array<{CONSTRAINT_TYPE}>",
    "dietary_tags": "array<string>",
    "search_terms": "array<string>",
    "ranking_preferences": "array<string>",
    "excluded_ingredients": "array<string>",
}
INTENTS_PER_PART = 50  # intents of one probe that try its head in one task
PAIRS_AT_ONCE = 2_000_000  # counted pairs of intents and products up to which an index of blocks is not worth building


def complete_intents(intents: DataFrame) -> DataFrame:
    """Fill in absent or NULL intent columns, so that a ready-made table may give only some."""
    filled = {}
    for name, kind in INTENT_COLUMNS.items():
        value = F.col(name).cast(kind) if name in intents.columns else F.lit(None).cast(kind)
        filled[name] = F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value
    return intents.withColumns(filled)


def reading(queries: DataFrame) -> list[str]:
    """The columns that tell queries apart: the text, and its translation if it was read with one."""
    return ["text"] + [c for c in ("translation",) if c in queries.columns]


def add_search_key(intents: DataFrame) -> DataFrame:
    """Add ``intent_id`` and the columns searching works with.

    Intents that cannot differ in their candidates share an id.
    """
    staged = complete_intents(intents).withColumns({
        "wanted": F.lower(F.coalesce(F.nullif("category_tag", F.lit("")), F.nullif("category", F.lit("")))),
        "keywords": keyword_list(F.col("search_terms")),
        "kids": F.array_contains("ranking_preferences", "kids"),
        "strict": F.array_contains("ranking_preferences", "healthy")
        | (F.size("nutrient_constraints") > 0) | (F.size("dietary_tags") > 0),
    })
    parts = ["wanted", "keywords", "kids", "strict", "nutrient_constraints", "dietary_tags", "excluded_ingredients"]
    return staged.withColumn("intent_id", F.sha2(F.to_json(F.struct(*parts)), 256))


def _order() -> list[Column]:
    return candidate_order(F.col("kids"), F.col("strict"))


def _level(relaxed: bool) -> Column:
    """Lowest relaxation level at which the pair passes its bounds, NULL for none."""
    level = F.when(passes_bounds(F.col("bounds")[0]), F.lit(0))
    if relaxed:
        # Without bounds there is nothing to relax and level 0 has passed already.
        for step in range(1, tables.RELAX_PASSES + 1):
            level = level.when(passes_bounds(F.col("bounds")[step]), F.lit(step))
    return level


def _matches(pairs: DataFrame, relaxed: bool) -> DataFrame:
    """Pairs that pass every predicate, with their level. Cheap tests come first."""
    text_tests = (
        (F.col("wanted").isNull() | F.contains(F.col("low_category"), F.col("wanted")))
        & has_diets(F.col("dietary_tags"), F.col("diets"), F.col("low_label"))
        & mentions_all(F.col("keywords"), F.col("low_combined"))
        & without_ingredients(F.col("excluded_ingredients"), F.col("low_ingredients"))
    )
    likely = pairs.filter(within_limits()).filter(text_tests)
    return likely.withColumn("level", _level(relaxed)).filter(F.col("level").isNotNull())


def _catalog(products: DataFrame) -> DataFrame:
    """Products with what the pair tests look at, prepared once per product."""
    return add_row_key(products).withColumns({
        "diets": known_diets(),
        "present": present_nutrients(),
        "low_category": F.lower("category_filter_text"),
        "low_label": F.lower("label_text"),
        "low_combined": F.lower("combined_text"),
        "low_ingredients": F.lower("ingredient_filter_text"),
    })


def _best(matches: DataFrame, limit: int, spread: list[str]) -> DataFrame:
    """First rows per intent at the intent's lowest level.

    ``spread`` names columns that are the same for all rows of an intent and by
    which the rows are distributed already.
    """
    group = [*spread, "intent_id"]
    ranked = first_rows(matches, group, [F.col("level").asc(), *_order()], limit, "candidate_rank")
    lowest = F.min("level").over(Window.partitionBy(*group))
    return ranked.withColumn("_lowest", lowest).filter(F.col("level") == F.col("_lowest")).drop("_lowest")


def search_intents(
    products: DataFrame,
    intents: DataFrame,
    limit: int = tables.CANDIDATE_ROWS,
    relaxed: bool = True,
    listed_only: bool = True,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """Candidates of every intent: ``intent_id, level, candidate_rank`` and the product columns.

    ``products`` come from ``normalize_products``; ``intents`` carry some or all
    of ``INTENT_COLUMNS``. Join the result back with :func:`add_search_key`.
    """
    product_columns = products.columns
    catalog = _catalog(products.filter("is_listed") if listed_only else products)
    columns = [
        "intent_id", "wanted", "keywords", "kids", "strict", "dietary_tags", "excluded_ingredients", "bounds", "caps", "floors",
    ]
    keyed_intents = add_search_key(intents).dropDuplicates(["intent_id"])
    levels = add_relaxations(keyed_intents).withColumns(loosest_limits(F.col("bounds")))
    keyed = cut_lineage(levels.select(*columns, probe_texts().alias("_probes")))
    texts = keyed.select("intent_id", F.explode("_probes").alias("p")).select("intent_id", "p.*")
    chosen, bridge, kinds = choose_probes(catalog, texts, "intent_id")
    wanted = cut_lineage(keyed.drop("_probes").join(chosen, "intent_id"))
    result_columns = ["intent_id", "level", "candidate_rank", *product_columns]
    if not kinds:
        nothing = catalog.limit(0).withColumns({
            "intent_id": F.lit(""), "level": F.lit(0), "candidate_rank": F.lit(0)})
        return nothing.select(*result_columns)
    offers = offers_for(catalog, bridge, wanted, kinds)

    # First try: the head of every probe, in each order that is asked for.
    heads = [*PROBE, "kids", "strict"]
    size = max(head_rows, limit)
    orders = wanted.select(*heads).distinct()
    slim = checked_join(offers.select(*PROBE, *ROW, *ORDERED_BY, "code"), orders, PROBE, ROW).drop("_part")
    places = cut_lineage(first_rows(slim, heads, _order(), size, "_place").select(*heads, *ROW, "_place"))
    # The wide rows are fetched for the heads only; equal rows share a key and come along together.
    head = catalog.join(places.select(*heads, *ROW).distinct(), ROW)
    # Many intents may share a probe, so here the intents are the side to split.
    pairs = spread_join(wanted, head, heads, ["intent_id"], INTENTS_PER_PART, heavy=True)
    tried = cut_lineage(
        _best(_matches(pairs, relaxed), limit, [*heads, "_part"]).select(*result_columns)
    )

    # Whoever got a full list at level 0 has its answer, and so has everyone whose
    # probe has no products beyond the head.
    longer = places.filter(F.col("_place") == size).select(*heads)
    served = tried.filter((F.col("level") == 0) & (F.col("candidate_rank") == limit)).select("intent_id")
    rest = cut_lineage(wanted.join(longer, heads, "left_semi").join(served, "intent_id", "left_anti"))
    if rest.isEmpty():
        return tried
    if rest.agg(F.sum("load")).first()[0] <= PAIRS_AT_ONCE:
        pairs = checked_join(offers, rest, PROBE, ROW)
        full = _best(_matches(pairs, relaxed), limit, []).select(*result_columns)
    else:
        full = _by_blocks(catalog, offers, rest, limit, relaxed).select(*result_columns)
    return tried.join(rest.select("intent_id"), "intent_id", "left_anti").select(*result_columns).unionByName(full)


def _by_blocks(catalog: DataFrame, offers: DataFrame, rest: DataFrame, limit: int, relaxed: bool) -> DataFrame:
    """Candidates of intents that visit the blocks of their probe in rounds."""
    offered = offers.join(rest.select(*PROBE).distinct(), PROBE, "left_semi")
    indexed = blocks.index_offers(offered, blocks.bounded_nutrients(rest))
    visits = blocks.plan_visits(indexed, rest)
    found, going, done, size = None, rest.select("intent_id"), 0, blocks.FIRST_BLOCKS
    while True:
        now = visits.filter((F.col("turn") > done) & (F.col("turn") <= done + size)).join(going, "intent_id", "left_semi")
        # Stored, as both joins below count the loads of what they are given before they join it.
        likely = cut_lineage(blocks.visited_pairs(indexed, now))
        # The wide rows are fetched for pairs within the limits only.
        fetched = spread_join(likely, catalog, ROW, ["intent_id"]).drop("_part")
        asked = spread_join(fetched, rest, ["intent_id"], ROW).drop("_part")
        matched = _matches(asked, relaxed)
        every = matched if found is None else matched.unionByName(found.drop("candidate_rank"))
        found = cut_lineage(_best(every, limit, []))
        done, size = done + size, size * blocks.GROWTH
        going = cut_lineage(blocks.still_open(found, visits, limit, done))
        if going.isEmpty():
            return found


def level_summary(intents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per intent: the level that found something (NULL for none), candidate count and log columns."""
    found = candidates.groupBy("intent_id").agg(
        F.first("level").alias("level"), F.count(F.lit(1)).alias("candidate_rows")
    )
    return add_relaxations(add_search_key(intents)).join(found, "intent_id", "left").withColumn(
        "candidate_rows", F.coalesce("candidate_rows", F.lit(0).cast("bigint"))
    )


def search_mentions(products: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The first product in plain candidate order that mentions all ``words`` of each key.

    A key is looked up by its rarest word. One product per key: the smallest order key wins, and every task merges its
    rows before the shuffle, so hot words cost one row per key and task.
    """
    product_columns = products.columns
    catalog = add_row_key(products)
    kept = cut_lineage(asked.select(key, "words"))
    texts = kept.select(key, F.lit("word").alias("kind"), F.explode("words").alias("pattern"))
    chosen, bridge, kinds = choose_probes(catalog, texts, key)
    if not kinds:
        return catalog.limit(0).withColumn(key, F.lit(None).cast(asked.schema[key].dataType)).select(key, *product_columns)
    probed = cut_lineage(kept.join(chosen, key))
    pairs = checked_join(offers_for(catalog, bridge, probed, kinds), probed, PROBE, ROW)
    matched = pairs.filter(mentions_all(F.col("words"), F.lower("combined_text")))
    place = F.struct(
        (-F.col("grade_points")).alias("grade"), (-F.col("nova_points")).alias("nova"),
        (-nutrition_heuristic()).alias("nutrition"), (-F.coalesce("unique_scans_n", F.lit(0))).alias("scans"),
        F.col("name_text"), F.col("code"),
    )
    first = matched.groupBy(key).agg(F.min_by(F.struct(*product_columns), place).alias("product"))
    return first.select(key, "product.*")
