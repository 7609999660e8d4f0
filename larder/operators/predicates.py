"""Search predicates over normalised products.

Each takes plain values (one query, so numeric bounds reach the Parquet scan)
or columns (a table of intents joined to products). Text is compared in lower
case; accents are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.functions.text import fold_accents, literal_map, strings, tokens
from larder.operators.ordering import candidate_order, page_limit

CONSTRAINT_TYPE = "struct<nutrient:string,operator:string,value:double,unit:string>"
KCAL = "energy_kcal_100g"


@dataclass(frozen=True)
class Bound:
    nutrient: str
    operator: str
    value: float
    unit: str = "g"


@dataclass(frozen=True)
class Query:
    """One ready-made search."""

    category: str | None = None
    category_tag: str | None = None
    bounds: list[Bound] = field(default_factory=list)
    dietary_tags: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    preferences: list[str] = field(default_factory=list)
    max_results: int = tables.RESULT_ROWS


# ---- one query, plain values ---------------------------------------------


def has_name() -> Column:
    return F.trim("name_text") != ""


def in_category(wanted: str) -> Column:
    """The category text contains the wanted tag or word."""
    return F.contains(F.lower("category_filter_text"), F.lit(wanted.lower()))


def has_dietary_label(tag: str) -> Column:
    label = F.lower("label_text")
    patterns = tables.LABEL_PATTERNS.get(tag, [tag.lower()])
    return reduce(lambda a, b: a | b, [F.contains(label, F.lit(p)) for p in patterns])


def nutrient_bound(bound: Bound, allow_missing: bool = False) -> Column:
    """The bound itself; an upper calorie bound also asks for more than 0."""
    amount, limit = F.col(bound.nutrient), F.lit(float(bound.value))
    test = {
        "<=": amount <= limit, "<": amount < limit, ">=": amount >= limit, ">": amount > limit, "==": amount == limit,
    }[bound.operator]
    if bound.nutrient == KCAL and bound.operator.startswith("<"):
        test = test & (amount > 0)
    return test | amount.isNull() if allow_missing else test


def exclusion_forms(ingredient: str) -> list[str]:
    plain = ingredient.strip().lower()
    return list(dict.fromkeys([plain, plain.replace(" ", "-")])) if plain else []


def without_ingredient(ingredient: str) -> Column:
    text = F.lower("ingredient_filter_text")
    forms = exclusion_forms(ingredient)
    return reduce(lambda a, b: a & b, [~F.contains(text, F.lit(f)) for f in forms], F.lit(True))


def used_keywords(words: list[str]) -> list[str]:
    kept = [w.strip().lower() for w in words if len(w.strip()) >= tables.KEYWORD_MIN_LENGTH]
    return list(dict.fromkeys(kept))[: tables.KEYWORDS_USED]


def mentions(word: str) -> Column:
    """The word occurs in name, brand, categories or ingredients (all in the combined text)."""
    return F.contains(F.lower("combined_text"), F.lit(word))


def query_filter(products: DataFrame, query: Query, allow_missing: bool = False) -> DataFrame:
    """All predicates of one query. Bounds on nutrients the table lacks are dropped."""
    tests = [F.col("is_listed")]
    known = set(products.columns)
    tests += [nutrient_bound(b, allow_missing) for b in query.bounds if b.nutrient in known]
    wanted = query.category_tag or query.category
    if wanted:
        tests.append(in_category(wanted))
    tests += [has_dietary_label(tag) for tag in query.dietary_tags]
    tests += [without_ingredient(i) for i in query.excluded]
    tests += [mentions(word) for word in used_keywords(query.keywords)]
    return products.filter(reduce(lambda a, b: a & b, tests))


def search_one(
    products: DataFrame, query: Query, limit: int | None = None, allow_missing: bool = False
) -> DataFrame:
    """Filtered, ordered and limited candidates of one query."""
    strict = "healthy" in query.preferences or bool(query.bounds) or bool(query.dietary_tags)
    order = candidate_order("kids" in query.preferences, strict)
    rows = page_limit(limit, query.max_results)
    return query_filter(products, query, allow_missing).orderBy(*order).limit(rows)


# ---- per row, columns ----------------------------------------------------


def _amount(constraint: Column) -> Column:
    return F.try_element_at(F.col("nutrients"), constraint["nutrient"])


def satisfies(constraint: Column) -> Column:
    """True or False for a present amount, NULL for a missing one."""
    amount, bound, operator = _amount(constraint), constraint["value"], constraint["operator"]
    return (
        F.when(amount.isNull(), F.lit(None).cast("boolean"))
        .when(operator == ">=", amount >= bound).when(operator == "<=", amount <= bound)
        .when(operator == ">", amount > bound).when(operator == "<", amount < bound)
        .when(operator == "==", F.abs(amount - bound) <= 1e-6)
        .otherwise(F.lit(True))
    )


def passes_constraints(constraints: Column, allow_missing: bool = False) -> Column:
    """Row check of a constraint list; a missing amount fails unless allowed."""
    return F.forall(constraints, lambda c: F.coalesce(satisfies(c), F.lit(allow_missing)))


def passes_bounds(constraints: Column) -> Column:
    """Search form of the check: the calorie guard applies, equality is exact, absent columns do not count."""

    def test(c: Column) -> Column:
        guard = (c["nutrient"] != KCAL) | ~c["operator"].isin("<", "<=") | (_amount(c) > 0)
        known = F.array_contains(F.map_keys("nutrients"), c["nutrient"])
        exact = (c["operator"] != "==") | (_amount(c) == c["value"])
        return ~known | F.coalesce(satisfies(c) & guard & exact, F.lit(False))

    return F.forall(constraints, test)


def known_diets() -> Column:
    """The dietary tags whose patterns the label text contains."""
    label = F.lower("label_text")
    return F.array_compact(
        F.array(*[
            F.when(reduce(lambda a, b: a | b, [F.contains(label, F.lit(p)) for p in patterns]), F.lit(tag))
            for tag, patterns in tables.LABEL_PATTERNS.items()
        ])
    )


def has_diets(tags: Column, diets: Column, label: Column) -> Column:
    """Every tag is among the product's diets, or (unknown tags) in its lower-case label text."""
    known = strings(tables.LABEL_PATTERNS)
    return F.forall(
        tags,
        lambda t: F.array_contains(diets, t)
        | (~F.array_contains(known, t) & F.contains(label, F.lower(t))),
    )


def without_ingredients(ingredients: Column, text: Column) -> Column:
    """No ingredient occurs in the lower-case text, spaced or hyphenated."""

    def absent(i: Column) -> Column:
        plain = F.lower(F.trim(i))
        hyphened = F.replace(plain, F.lit(" "), F.lit("-"))
        return (plain == "") | ~(F.contains(text, plain) | F.contains(text, hyphened))

    return F.forall(ingredients, absent)


def keyword_list(words: Column) -> Column:
    """The first three different words of three or more letters."""
    cleaned = F.transform(words, lambda w: F.lower(F.trim(w)))
    kept = F.filter(cleaned, lambda w: F.length(w) >= tables.KEYWORD_MIN_LENGTH)
    return F.slice(F.array_distinct(kept), 1, tables.KEYWORDS_USED)


def mentions_all(words: Column, text: Column) -> Column:
    """All words occur in the lower-case text."""
    return F.forall(words, lambda w: F.contains(text, w))


def loosest_limits(bounds: Column) -> dict[str, Column]:
    """Per nutrient the highest cap and the lowest floor over all relaxation levels.

    No product outside these limits passes any level, and they are plain numbers:
    a join can test them in compiled code before the lists are looked at.
    """
    every = F.flatten(bounds)

    def limit(name: str, sign: str) -> Column:
        own = F.filter(every, lambda c: (c["nutrient"] == name) & c["operator"].startswith(sign))
        values = F.transform(own, lambda c: c["value"])
        return F.array_max(values) if sign == "<" else F.array_min(values)

    return {
        "caps": F.array(*[limit(n, "<") for n in tables.NUTRIENTS]),
        "floors": F.array(*[limit(n, ">") for n in tables.NUTRIENTS]),
    }


def present_nutrients() -> Column:
    """Which nutrient columns the product table has, in the order of the table."""
    return F.array(*[F.array_contains(F.map_keys("nutrients"), n) for n in tables.NUTRIENTS])


def within_limits() -> Column:
    """The test for ``caps``, ``floors`` and the product's ``present`` flags."""
    tests = []
    for i, name in enumerate(tables.NUTRIENTS):
        absent, amount = ~F.get("present", F.lit(i)), F.col(name)
        cap, floor = F.get("caps", F.lit(i)), F.get("floors", F.lit(i))
        tests.append(absent | cap.isNull() | F.coalesce(amount <= cap, F.lit(False)))
        tests.append(absent | floor.isNull() | F.coalesce(amount >= floor, F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def text_tokens(text: Column) -> Column:
    """Letter and digit runs of a free text, for matching a reference product."""
    return tokens(F.lower(text), "[a-z0-9]+")


def folded_labels(labels: Column) -> Column:
    return fold_accents(F.lower(F.array_join(labels, " ")))


def has_label(folded: Column, tag: Column) -> Column:
    """Accent-free label test on :func:`folded_labels` text."""
    wanted = fold_accents(F.lower(F.trim(tag)))
    synonyms = F.coalesce(F.try_element_at(literal_map(tables.LABEL_SYNONYMS), wanted), F.array(wanted))
    return F.exists(synonyms, lambda s: F.contains(folded, s))


def lookup(products: DataFrame, codes: DataFrame) -> DataFrame:
    """The products whose ``code`` is among the given ones."""
    return products.join(codes.select("code").distinct(), "code", "left_semi")
