"""Answer a whole query log: annotate, search, rank, explain, and fan out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.operators.annotate import annotate_queries
from larder.operators.intents import (
    add_relaxations, applied_filters, extract_constraints, interpreted_query, map_categories, ranking_rationale, relaxation_log,
)
from larder.operators.ordering import first_rows
from larder.operators.scoring import prepare_products, product_card, score_candidates, score_order
from larder.plans.joins import evenly, spread_join
from larder.plans.recommend import compare_queries
from larder.plans.search import add_search_key, complete_intents, level_summary, reading, search_intents
from larder.plans.vectors import Vectors, add_vectors
from larder.session import cut_lineage

TEXTS_PER_PART = 500  # texts of one intent scored in one task (50 candidates each)


def read_queries(log: DataFrame, tags: dict[str, str] | DataFrame | None = None, translation: str | None = None) -> DataFrame:
    """One row per different text of the log, with its intent and category tag.

    With ``translation`` (a column of the log) a text is read once per translation,
    which the column ``translation`` of the result holds. Distinct texts first: repeated phrases are merged inside each task, so a
    phrase that makes up a third of the log costs one row per task. The result is
    written once: it is read several times, and a filter on a parsed column must
    not be pushed through the whole parser.
    """
    asked = log.select("text", *([F.col(translation).alias("translation")] if translation else []))
    texts = evenly(asked.distinct(), *asked.columns)
    read = map_categories(extract_constraints(annotate_queries(texts, "text", "translation" if translation else None)), tags)
    return cut_lineage(read.withColumn("raw_text", F.col("text")))


def rank_candidates(
    candidates: DataFrame, queries: DataFrame, max_results: int = tables.RESULT_ROWS, semantic: bool = True, vectors: Vectors | None = None
) -> DataFrame:
    """Score every candidate for every text of its intent; the best per text, ranked.

    The bounds used are those of the level the candidates were found at. With
    ``vectors``, a text and a product that both have one are compared by them, all others by their words.
    """
    products = prepare_products(candidates)
    asked, given = level_columns(queries), [None, None]
    if vectors is not None:
        asked, products = add_vectors(asked, products, vectors)
        given = ["query_vector", "product_vector"]
    pairs = spread_join(asked, products, ["intent_id"], ["text"], TEXTS_PER_PART, heavy=True)
    pairs = pairs.withColumn("nutrient_constraints", F.get("bounds", F.col("level")))
    scored = score_candidates(pairs, *given, semantic=semantic).drop("query_vector", "product_vector")
    return first_rows(scored, ["intent_id", "_part", *reading(queries)], score_order(), max_results)


def level_columns(queries: DataFrame) -> DataFrame:
    """Queries with ``intent_id``, ``bounds`` per level and their other intent columns."""
    return add_relaxations(add_search_key(queries)).select(
        "intent_id", *reading(queries), "raw_text", "category", "bounds", "dietary_tags", "search_terms", "ranking_preferences"
    )


def answer_rows(queries: DataFrame, candidates: DataFrame, max_results: int = tables.RESULT_ROWS) -> DataFrame:
    """One row per text: what was searched for in the end, and how it went."""
    summed = level_summary(queries, candidates).withColumn(
        "final_constraints", F.get("bounds", F.coalesce("level", F.lit(tables.RELAX_PASSES)))
    )
    category, bounds, dietary, terms, without = (
        F.col(c) for c in ("category", "final_constraints", "dietary_tags", "search_terms", "excluded_ingredients"))
    has_text = (F.size(terms) > 0) | (F.size(dietary) > 0) | (F.coalesce(category, F.lit("")) != "")
    healthy = F.array_contains("ranking_preferences", "healthy")
    return summed.select(
        *reading(queries), "language", "normalized_text", "category", "category_tag", "level", "final_constraints",
        interpreted_query(category, bounds, dietary, terms, without, F.col("language")).alias("interpreted"),
        applied_filters(category, bounds, dietary, without).alias("applied_filters"),
        relaxation_log(F.col("level"), has_text).alias("relaxation_log"),
        ranking_rationale(category, bounds, dietary, without, healthy).alias("rationale"),
        "candidate_rows",
        F.least("candidate_rows", F.lit(max_results)).cast("bigint").alias("result_rows"),
    )


@dataclass(frozen=True)
class Answers:
    """Results keyed by text. Fan out to a log with :func:`for_log` where needed."""

    queries: DataFrame
    candidates: DataFrame
    ranked: DataFrame
    answers: DataFrame


def answer_intents(
    products: DataFrame, queries: DataFrame, max_results: int = tables.RESULT_ROWS, semantic: bool = True, vectors: Vectors | None = None
) -> Answers:
    """Search, relax, rank and explain for a ready-made table of queries with intents."""
    complete = complete_intents(queries)
    for name in ("language", "normalized_text"):
        if name not in complete.columns:
            complete = complete.withColumn(name, F.lit(None).cast("string"))
    if "raw_text" not in complete.columns:
        complete = complete.withColumn("raw_text", F.col("text"))
    candidates = cut_lineage(search_intents(products, complete))
    return Answers(
        queries=complete,
        candidates=candidates,
        ranked=rank_candidates(candidates, complete, max_results, semantic, vectors),
        answers=answer_rows(complete, candidates, max_results),
    )


def answer_log(
    products: DataFrame,
    log: DataFrame,
    tags: dict[str, str] | DataFrame | None = None,
    max_results: int = tables.RESULT_ROWS,
    translation: str | None = None,
    semantic: bool = True,
    vectors: Vectors | None = None,
) -> Answers:
    """The whole search job for a log; phrases that compare are left to :func:`answer_whole_log`."""
    read = read_queries(log, tags, translation)
    return answer_intents(products, read.filter(~_compares()), max_results, semantic, vectors)


@dataclass(frozen=True)
class WholeLog:
    """Both branches of a log, and ``rows``: its texts, which ``branch`` answered each, and how many results it has."""

    searched: Answers
    compared: DataFrame
    rows: DataFrame


def _compares() -> Column:
    return F.coalesce("comparison_product", F.lit("")) != ""


def answer_read(
    products: DataFrame, queries: DataFrame, max_results: int = tables.RESULT_ROWS, semantic: bool = True, vectors: Vectors | None = None
) -> WholeLog:
    """Search for the queries that search and compare for those that compare; each has a row in ``rows``, also without results."""
    complete = complete_intents(queries)
    comparing = complete.filter(_compares())
    searched = answer_intents(products, complete.filter(~_compares()), max_results, semantic, vectors)
    compared = compare_queries(products, comparing)
    own = reading(queries)
    # Queries without results come along as rows that count nothing; grouping also matches missing translations.
    counted = compared.select(*own, F.lit(1).alias("n")).unionByName(comparing.select(*own, F.lit(0).alias("n")))
    rows = searched.answers.select(*own, F.lit("search").alias("branch"), "result_rows").unionByName(
        counted.groupBy(*own).agg(F.sum("n").alias("result_rows")).select(*own, F.lit("compare").alias("branch"), "result_rows"))
    return WholeLog(searched, compared, rows)


def answer_whole_log(
    products: DataFrame,
    log: DataFrame,
    tags: dict[str, str] | DataFrame | None = None,
    max_results: int = tables.RESULT_ROWS,
    translation: str | None = None,
    semantic: bool = True,
    vectors: Vectors | None = None,
) -> WholeLog:
    """The whole job for a log: texts are read once, then searched for or compared."""
    return answer_read(products, read_queries(log, tags, translation), max_results, semantic, vectors)


def for_log(log: DataFrame, per_text: DataFrame, translation: str | None = None) -> DataFrame:
    """Rows keyed by text, for every query of the log with that text; a missing text is a text of its own.

    Rows of texts that were read with a translation need the log's column of it.
    """
    if ("translation" in per_text.columns) != (translation is not None):
        raise ValueError("give the log's column of translations if, and only if, the texts were read with it")

    def key(*names: str) -> list[Column]:
        return [c for i, n in enumerate(names) for c in (F.coalesce(n, F.lit("")).alias(f"_key{i}"), F.col(n).isNull().alias(f"_missing{i}"))]

    asked = log.select("query_id", *key("text", *([translation] if translation else [])))
    keyed = per_text.drop("_part").select("*", *key(*reading(per_text)))
    keys = [c for c in asked.columns if c != "query_id"]
    return spread_join(asked, keyed, keys, ["query_id"]).drop("_part", *keys)


def cards(ranked: DataFrame) -> DataFrame:
    """The ranked results as flat cards."""
    card = product_card()
    return ranked.select(*reading(ranked), "rank", "score", *[c.alias(n) for n, c in card.items()], "explanations")
