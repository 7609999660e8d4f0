"""From a parsed phrase to executable search constraints, and their relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.functions.numbers import number_text, round3
from larder.functions.text import literal_map, strings, strip
from larder.operators.predicates import CONSTRAINT_TYPE
from larder.plans.joins import checked_join
from larder.session import cut_lineage

LIST_FIELDS = ["dietary_tags", "search_terms", "ranking_preferences", "excluded_ingredients"]


def extract_constraints(intents: DataFrame) -> DataFrame:
    """Drop repeated list entries, keeping the first of each."""
    return intents.withColumns({name: F.array_distinct(F.col(name)) for name in LIST_FIELDS})


def category_tag(category: Column, tags: dict[str, str]) -> Column:
    """The tag of a category: itself, its singular, else a tag spelled from the word."""
    word = F.lower(strip(category))
    singular = F.when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    spelled = F.concat(F.lit("en:"), F.replace(word, F.lit(" "), F.lit("-")))
    known = literal_map(tags)
    found = F.coalesce(F.try_element_at(known, word), F.try_element_at(known, singular), spelled)
    return F.when(F.coalesce(category, F.lit("")) != "", found)


def map_categories(intents: DataFrame, tags: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Add ``category_tag``.

    ``tags`` is a literal table in the plan, or a table of any size with columns
    ``word`` and ``tag``: the different categories are joined with it, so what is joined back has
    a row per category. Words are compared in lower case; of repeated ones the smallest tag counts.
    """
    if isinstance(tags, DataFrame):
        return _joined_tags(intents, tags)
    return intents.withColumn(
        "category_tag", category_tag(F.col("category"), tables.CATEGORY_TAGS if tags is None else tags)
    )


def _joined_tags(intents: DataFrame, tags: DataFrame) -> DataFrame:
    known = tags.filter("word is not null and tag is not null").groupBy(F.lower(strip(F.col("word"))).alias("_word")).agg(F.min("tag").alias("_known"))
    # Stored first: Spark pushes a filter on a parsed column through the whole parser, and down to the rows its texts come from.
    own = cut_lineage(intents.withColumn("_id", F.monotonically_increasing_id()))
    asked = own.select("category").filter(F.coalesce("category", F.lit("")) != "").distinct()
    word = F.lower(strip(F.col("category")))
    singular = F.when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    ways = asked.select("category", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), w.alias("_word")) for i, w in enumerate((word, singular))])).alias("w"))
    found = ways.select("category", "w.way", "w._word").join(known, "_word").groupBy("category").agg(F.min_by("_known", "way").alias("_found"))
    spelled = F.concat(F.lit("en:"), F.replace(word, F.lit(" "), F.lit("-")))
    every = asked.join(found, "category", "left").select("category", F.coalesce("_found", spelled).alias("category_tag"))
    joined = checked_join(own, cut_lineage(every), ["category"], ["_id"]).drop("_part")
    rest = own.filter(F.coalesce("category", F.lit("")) == "").withColumn("category_tag", F.lit(None).cast("string"))
    return joined.unionByName(rest).select(*intents.columns, "category_tag")


def remove_category(intents: DataFrame) -> DataFrame:
    """Drop the category of every intent and say so in ``category_log``."""
    name, tag = F.coalesce("category", F.lit("")), F.coalesce("category_tag", F.lit(""))
    details = F.concat_ws(
        ", ",
        F.when(name != "", F.concat(F.lit("category="), name)),
        F.when(tag != "", F.concat(F.lit("tag="), tag)),
    )
    note = F.when(
        (name != "") | (tag != ""),
        F.array(F.concat(F.lit("category constraint removed ("), details, F.lit(")"))),
    ).otherwise(strings([]))
    cleared = {n: F.lit(None).cast("string") for n in ("category", "category_tag")}
    return intents.withColumn("category_log", note).withColumns(cleared)


# ---- descriptions ---------------------------------------------------------


def _nutrient_key(nutrient: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(tables.NUTRIENT_NAMES), nutrient), F.replace(nutrient, F.lit("_100g"), F.lit(""))
    )


def interpreted_bounds(constraints: Column) -> Column:
    """Bounds as a map such as ``{calories_max: 300.0}``; a later bound replaces an earlier one."""
    named = F.transform(
        F.filter(constraints, lambda c: c["operator"].isin("<", "<=", ">", ">=")),
        lambda c: F.struct(
            F.concat(_nutrient_key(c["nutrient"]),
                     F.when(c["operator"].startswith(">"), F.lit("_min")).otherwise(F.lit("_max"))).alias("name"),
            c["value"].alias("value"),
        ),
    )
    names = F.array_distinct(F.transform(named, lambda e: e["name"]))
    last = lambda n: F.element_at(F.filter(named, lambda e: e["name"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def interpreted_query(
    category: Column, constraints: Column, tags: Column, keywords: Column, excluded: Column, language: Column
) -> Column:
    """How a phrase was understood, as a struct; empty parts are NULL."""
    filled = lambda items: F.when(F.size(items) > 0, items)
    return F.struct(
        category.alias("category"),
        interpreted_bounds(constraints).alias("bounds"),
        F.transform(tags, lambda t: F.replace(t, F.lit("-"), F.lit("_"))).alias("flags"),
        keywords.alias("keywords"),
        filled(excluded).alias("exclude_ingredients"),
        F.coalesce(language, F.lit("en")).alias("language"),
    )


def applied_filters(category: Column, constraints: Column, tags: Column, excluded: Column) -> Column:
    """The filters as short texts."""
    label = lambda c: F.replace(
        F.coalesce(F.try_element_at(literal_map(tables.NUTRIENT_NAMES), c["nutrient"]), c["nutrient"]),
        F.lit("_"), F.lit(" "))
    unit = lambda c: F.when(c["nutrient"] == "energy_kcal_100g", F.lit("kcal")).otherwise(F.lit("g"))
    named = F.when(
        F.coalesce(category, F.lit("")) != "", F.array(F.concat(F.lit("category: "), category))
    ).otherwise(strings([]))
    bounds = F.transform(
        constraints,
        lambda c: F.concat(label(c), F.lit(" "), c["operator"], F.lit(" "), number_text(c["value"]), unit(c)),
    )
    without = F.transform(excluded, lambda i: F.concat(F.lit("exclude ingredient: "), i))
    return F.concat(named, bounds, tags, without)


def ranking_rationale(
    category: Column, constraints: Column, tags: Column, excluded: Column, prefers_healthy: Column
) -> Column:
    """What the ranking looked at."""
    label = lambda c: F.initcap(
        F.replace(F.replace(c["nutrient"], F.lit("_100g"), F.lit("")), F.lit("_"), F.lit(" ")))
    direction = lambda c: F.when(c["operator"].startswith("<"), F.lit("Low ")).otherwise(F.lit("High "))
    general = strings(["High protein", "Low sugar", "Low sodium", "Lower calories"])
    levels = (
        F.when(F.size(constraints) > 0, F.transform(constraints, lambda c: F.concat(direction(c), label(c))))
        .when(prefers_healthy, general).otherwise(strings([]))
    )
    has_category = F.when(F.coalesce(category, F.lit("")) != "", F.lit("Category relevance"))
    has_tags = F.when(F.size(tags) > 0, F.lit("Dietary label match"))
    without = F.transform(F.slice(excluded, 1, 2), lambda i: F.concat(F.lit("No "), i))
    return F.concat(
        strings(["Best Nutri-Score"]), levels, F.array_compact(F.array(has_category, has_tags)), without
    )


# ---- relaxation -----------------------------------------------------------


def relaxed_value(constraint: Column) -> Column:
    """One step looser: calories +50, other caps +15 %, protein and fiber -2, other floors -10 %."""
    value, nutrient, operator = constraint["value"], constraint["nutrient"], constraint["operator"]
    floor = F.when(nutrient.isin(tables.MORE_IS_ASKED), value - 2.0).otherwise(value * 0.9)
    cap = F.when(nutrient == "energy_kcal_100g", value + 50.0).otherwise(value * 1.15)
    return (
        F.when(operator.isin(">", ">="), round3(F.greatest(F.lit(0.0), floor)))
        .when(operator.isin("<", "<="), round3(cap)).otherwise(value)
    )


def relax(constraints: Column) -> Column:
    """All bounds one step looser."""
    return F.transform(
        constraints,
        lambda c: F.struct(
            c["nutrient"].alias("nutrient"), c["operator"].alias("operator"),
            relaxed_value(c).alias("value"), c["unit"].alias("unit"),
        ),
    )


def relax_log(before: Column, after: Column) -> Column:
    """One line per bound that changed."""
    changed = F.filter(
        F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a["value"].alias("value"))),
        lambda e: e["b"]["value"] != e["value"],
    )
    return F.transform(
        changed,
        lambda e: F.concat(
            F.replace(e["b"]["nutrient"], F.lit("_100g"), F.lit("")), F.lit(" "), e["b"]["operator"],
            F.lit(" changed from "), number_text(e["b"]["value"]), F.lit(" to "), number_text(e["value"]),
        ),
    )


def add_relaxations(intents: DataFrame) -> DataFrame:
    """Add ``bounds`` (constraints at levels 0, 1, 2) and ``step_logs`` (changes of steps 1, 2)."""
    current = F.coalesce("nutrient_constraints", F.array().cast(f"array<{CONSTRAINT_TYPE}>"))
    staged = intents.withColumn("_level0", current)
    staged = staged.withColumn("_level1", relax(F.col("_level0")))
    staged = staged.withColumn("_level2", relax(F.col("_level1")))
    levels = [F.col(f"_level{i}") for i in range(tables.RELAX_PASSES + 1)]
    return staged.withColumns({
        "bounds": F.array(*levels),
        "step_logs": F.array(*[relax_log(a, b) for a, b in zip(levels, levels[1:])]),
    }).drop("_level0", "_level1", "_level2")


def relaxation_log(level: Column, has_text_filters: Column) -> Column:
    """Log of the steps taken; NULL level means nothing was found at any level.

    Needs the ``step_logs`` and ``bounds`` of :func:`add_relaxations`.
    """
    steps = F.col("step_logs")
    taken = F.coalesce(level, F.lit(tables.RELAX_PASSES))
    lines = F.flatten(F.slice(steps, F.lit(1), taken))
    note = F.when(level.isNull() & has_text_filters, strings([tables.PRESERVED_NOTE])).otherwise(strings([]))
    return F.concat(lines, note)
