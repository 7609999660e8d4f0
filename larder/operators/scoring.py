"""Score and explain products for queries, on rows that hold both.

Such a row has the columns of a normalised product with quality and insights,
and of a query: ``raw_text, category, nutrient_constraints, dietary_tags,
search_terms, ranking_preferences``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.functions.numbers import higher_is_better, lower_is_better, number_text
from larder.functions.text import literal_map, strip, tokens
from larder.operators.insights import add_insights
from larder.operators.predicates import folded_labels, has_label, satisfies
from larder.operators.quality import add_quality

ALNUM = "[a-z0-9]+"


def product_text() -> Column:
    """Name, brands, categories and ingredients, the filled ones joined by spaces."""
    parts = [F.col("name"), F.col("brands"), F.array_join("categories", " "), F.col("ingredients_text")]
    return F.concat_ws(" ", *[F.nullif(strip(p), F.lit("")) for p in parts])


def prepare_products(products: DataFrame) -> DataFrame:
    """Everything scoring needs of a product alone, once per product."""
    texts = {
        "product_tokens": F.array_distinct(tokens(F.lower(product_text()), ALNUM)),
        "folded_labels": folded_labels(F.col("labels")),
        "category_words": F.lower(F.array_join("categories", " ")),
        "search_text": F.lower(
            F.concat_ws(" ", "name", "brands", F.array_join("categories", " "), "ingredients_text")
        ),
    }
    return add_insights(add_quality(products)).withColumns(texts)


# ---- similarity -----------------------------------------------------------


def lexical_similarity(text: Column, product_tokens: Column) -> Column:
    """Share of common words among all words of the query text and the product."""
    words = F.array_distinct(tokens(F.lower(text), ALNUM))
    common = F.size(F.array_intersect(words, product_tokens))
    union = F.size(words) + F.size(product_tokens) - common
    return F.when((F.size(words) == 0) | (F.size(product_tokens) == 0), F.lit(0.0)).otherwise(
        common.cast("double") / union
    )


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors, moved to 0..1; NULL if one is missing."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    product = lambda a, b: total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = F.sqrt(product(left, left) * product(right, right))
    cosine = F.when(norms > 0, product(left, right) / norms).when(norms == 0, F.lit(0.0))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1.0) / 2.0))
    # greatest and least skip NULLs, so a missing vector has to be named.
    return F.when(cosine.isNotNull(), moved)


def similarity(
    text: Column, product_tokens: Column, query_vector: Column | None = None,
    product_vector: Column | None = None, enabled: bool = True,
) -> Column:
    """Vectors where both are given, words otherwise, 0 when switched off."""
    if not enabled:
        return F.lit(0.0)
    lexical = lexical_similarity(text, product_tokens)
    if query_vector is None or product_vector is None:
        return lexical
    return F.coalesce(cosine_similarity(query_vector, product_vector), lexical)


# ---- parts of the score ---------------------------------------------------


def _asks(preference: str) -> Column:
    return F.array_contains("ranking_preferences", preference)


def in_query_category() -> Column:
    wanted = F.nullif("category", F.lit(""))
    return F.coalesce(F.exists("categories", lambda c: F.contains(F.lower(c), wanted)), F.lit(False))


def matched_tags() -> Column:
    return F.filter("dietary_tags", lambda t: has_label(F.col("folded_labels"), t))


def matched_terms() -> Column:
    return F.filter("search_terms", lambda t: F.contains(F.col("search_text"), F.lower(t)))


def satisfied_constraints() -> Column:
    return F.filter("nutrient_constraints", lambda c: F.coalesce(satisfies(c), F.lit(False)))


def headroom(constraint: Column) -> Column:
    """Up to 2.5 points for being well inside a bound."""
    amount = F.try_element_at(F.col("nutrients"), constraint["nutrient"])
    base = F.greatest(F.abs(constraint["value"]), F.lit(1.0))
    margin = (
        F.when(constraint["operator"].startswith("<"), F.greatest(F.lit(0.0), constraint["value"] - amount))
        .when(constraint["operator"].startswith(">"), F.greatest(F.lit(0.0), amount - constraint["value"]))
        .otherwise(F.lit(0.0))
    )
    return F.least(F.lit(2.5), (margin / base) * 2.5)


def constraint_bonus() -> Column:
    return F.aggregate(satisfied_constraints(), F.lit(0.0), lambda acc, c: acc + 5.0 + headroom(c))


def violation_penalty() -> Column:
    broken = F.filter("nutrient_constraints", lambda c: ~F.coalesce(satisfies(c), F.lit(True)))
    return F.size(broken) * F.lit(15.0)


def sugar_penalty() -> Column:
    sweet = F.lit(False)
    for word in tables.SWEET_CATEGORIES:
        sweet = sweet | F.contains("category_words", F.lit(word))
    sugars = F.col("sugars_100g")
    return F.when(~sweet & (sugars > 15.0), F.least(F.lit(10.0), (sugars - 15.0) * 0.4)).otherwise(F.lit(0.0))


def calorie_penalty() -> Column:
    caps = F.filter(
        "nutrient_constraints", lambda c: (c["nutrient"] == "energy_kcal_100g") & c["operator"].isin("<", "<=")
    )
    cap = F.array_min(F.transform(caps, lambda c: c["value"]))
    kcal = F.col("energy_kcal_100g")
    return F.when(kcal > cap, F.least(F.lit(20.0), (kcal - cap) * 0.05)).otherwise(F.lit(0.0))


def healthy_ramps() -> Column:
    """Five bounded bonuses on top of the nutrient quality."""
    bonus = F.col("nutrient_quality") * 3.0
    for name, good, cutoff, most in tables.HEALTHY_LOW_RAMPS:
        bonus += lower_is_better(F.col(name), good, cutoff, most)
    for name, least, target, most in tables.HEALTHY_HIGH_RAMPS:
        bonus += higher_is_better(F.col(name), least, target, most)
    return bonus


def healthy_bonus() -> Column:
    level = F.coalesce(F.try_element_at(literal_map(tables.CLASS_BONUS), F.col("health_class")), F.lit(0.0))
    return F.when(_asks("healthy"), level + healthy_ramps()).otherwise(F.lit(0.0))


def kids_bonus() -> Column:
    return F.when(_asks("kids"), lower_is_better(F.col("sugars_100g"), *tables.KIDS_SUGAR_RAMP)).otherwise(F.lit(0.0))


def grade_bonus() -> Column:
    return F.coalesce(F.try_element_at(literal_map(tables.GRADE_BONUS), F.col("nutriscore")), F.lit(0.0))


def score_parts() -> dict[str, Column]:
    """All parts but the similarity, with their sign."""
    return {
        "quality_part": F.col("quality") * 8.0,
        "grade_bonus": grade_bonus(),
        "category_bonus": F.when(in_query_category(), F.lit(8.0)).otherwise(F.lit(0.0)),
        "dietary_bonus": F.size(matched_tags()) * F.lit(6.0),
        "constraint_bonus": constraint_bonus(),
        "violation_penalty": -violation_penalty(),
        "sugar_penalty": -sugar_penalty(),
        "calorie_penalty": -calorie_penalty(),
        "healthy_bonus": healthy_bonus(),
        "kids_bonus": kids_bonus(),
        "term_bonus": F.size(matched_terms()) * F.lit(0.5),
    }


def explanations() -> Column:
    """Up to four different reasons, else the product's summary."""
    category = F.when(in_query_category(), F.concat(F.lit("Matches category '"), F.col("category"), F.lit("'")))
    tags = F.transform(matched_tags(), lambda t: F.concat(F.lit("Matches "), t, F.lit(" label")))
    label = lambda c: F.initcap(
        F.replace(F.replace(c["nutrient"], F.lit("_100g"), F.lit("")), F.lit("_"), F.lit(" ")))
    bounds = F.transform(
        satisfied_constraints(),
        lambda c: F.concat(
            label(c), F.lit(" "), number_text(F.try_element_at(F.col("nutrients"), c["nutrient"])),
            F.lit(" satisfies "), c["operator"], F.lit(" "), number_text(c["value"]), F.lit(" "), c["unit"],
            F.lit("/100g"),
        ),
    )
    grade = F.when(
        _asks("healthy") & F.col("nutriscore").isin(tables.GRADES),
        F.concat(F.lit("Nutri-Score "), F.upper("nutriscore"), F.lit(" supports healthy preference")),
    )
    sugar = F.when(
        _asks("kids") & F.col("sugars_100g").isNotNull(),
        F.concat(F.lit("Sugar level "), number_text(F.col("sugars_100g")),
                 F.lit(" g/100g is suitable for kid-focused ranking")),
    )
    terms = F.transform(matched_terms(), lambda t: F.concat(F.lit("Matches search term '"), t, F.lit("'")))
    reasons = F.concat(
        F.array_compact(F.array(category)), tags, bounds, F.array_compact(F.array(grade, sugar)), terms
    )
    return F.when(F.size(reasons) > 0, F.slice(F.array_distinct(reasons), 1, 4)).otherwise(F.array("summary"))


def score_candidates(
    pairs: DataFrame, query_vector: str | None = None, product_vector: str | None = None, semantic: bool = True
) -> DataFrame:
    """Add similarity, the parts of the score, the score and the explanations. No shuffle.

    ``pairs`` hold products from :func:`prepare_products` and query columns.
    """
    vectors = [F.col(v) if v else None for v in (query_vector, product_vector)]
    parts = score_parts()
    staged = pairs.withColumns({
        "similarity": similarity(F.col("raw_text"), F.col("product_tokens"), *vectors, enabled=semantic),
        **parts,
        "explanations": explanations(),
    })
    quality, *others = parts
    score = F.col(quality) + F.col("similarity") * 40.0
    for part in others:
        score = score + F.col(part)
    return staged.withColumn("score", score)


def score_order() -> list[Column]:
    """Best score first; equal scores (to 9 places) keep the candidate order."""
    return [F.round("score", 9).desc(), F.col("candidate_rank").asc()]


def product_card() -> dict[str, Column]:
    """The flat form of a result."""
    return {
        "card_name": F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown Product")),
        "card_brand": F.col("brands"),
        "card_image": F.col("image_url"),
        "card_grade": F.col("nutriscore"),
        "card_category": F.coalesce(F.try_element_at(F.col("categories"), F.lit(1)), F.lit("")),
        "card_summary": F.coalesce(F.try_element_at(F.col("explanations"), F.lit(1)), F.col("summary")),
        "card_url": F.col("product_url"),
        "card_barcode": F.col("code"),
    }


