"""Read search phrases: language, normal form, and structured intent.

Everything is one narrow pass of built-in expressions per row. Phrase tables
are literal lists folded over a text whose words carry marks, so a "whole
phrase" test or replacement is a plain substring operation instead of one
regular expression per phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.functions import text as X
from larder.operators.predicates import CONSTRAINT_TYPE

UNITS = {n: ("kcal" if n == "energy_kcal_100g" else "g") for n in tables.NUTRIENTS}
NUTRIENT_OF_WORD = dict(tables.NUTRIENT_WORDS)
CATEGORY_OF_WORD = dict(tables.CATEGORY_WORDS)

# The phrases deleted from a text once a category is known, longest first.
PHRASES_OF_CATEGORY = {
    category: [X.marked(w) for w in X.longest_first(w for w, c in tables.CATEGORY_WORDS if c == category)]
    for category in dict.fromkeys(CATEGORY_OF_WORD.values())
}
DELETED_PHRASES = [
    X.marked(word)
    for table in (tables.DIETARY_WORDS, tables.PREFERENCE_WORDS, tables.NUTRIENT_WORDS)
    for word, _ in X.longest_first(table)
]


# ---- normal form ----------------------------------------------------------


def detect_language(text: Column) -> Column:
    """``fr`` with an accent or two different French words, else ``en``."""
    lowered = F.lower(text)
    folded = X.fold_accents(lowered)
    hints = F.size(F.array_intersect(X.tokens(folded, "[a-zA-Z]+"), X.strings(tables.FRENCH_HINTS)))
    return F.when((hints >= 2) | (folded != lowered), F.lit("fr")).otherwise(F.lit("en"))


def normal_words(text: Column) -> Column:
    """Lower case without accents, single spaces, words marked."""
    return X.mark_words(X.collapse(X.fold_accents(F.lower(text))))


def normal_spacing(marked_text: Column) -> Column:
    """The last step of the normal form: marks and hyphens go, spaces are single and never before a comma."""
    spaced = F.replace(F.replace(X.unmark(marked_text), F.lit("-"), F.lit(" ")), F.lit(" ,"), F.lit(","))
    return X.collapse(spaced)


def normalize_text(text: Column, language: Column) -> Column:
    """Lower case without accents, French phrases in English, single spaces."""
    typos = X.swaps(tables.TYPOS)
    french = X.swaps(tables.TYPOS + X.longest_first(tables.FRENCH_PHRASES) + tables.FRENCH_NUMERIC_PHRASES)
    return normal_spacing(X.swap_phrases(normal_words(text), F.when(language == "fr", french).otherwise(typos)))


def preprocess(queries: DataFrame, text: str = "text", translation: str | None = None) -> DataFrame:
    """Add ``language``, ``normalized_text`` and ``rule_text``.

    ``translation`` names an optional column of English translations; French
    rows that have one are read from it, and ``rule_text`` keeps the rule form.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    staged = queries.withColumn("language", detect_language(raw))
    staged = staged.withColumn("rule_text", normalize_text(raw, F.col("language")))
    if translation is None:
        return staged.withColumn("normalized_text", F.col("rule_text"))
    translated = (F.col("language") == "fr") & (F.coalesce(F.col(translation), F.lit("")) != "")
    return staged.withColumn(
        "normalized_text",
        F.when(translated, normalize_text(F.col(translation), F.lit("en"))).otherwise(F.col("rule_text")),
    )


# ---- parts of an intent ---------------------------------------------------


def comparison_target(text: Column) -> Column:
    """What is to be replaced; the first pattern that matches decides."""
    found = [F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in tables.COMPARISON_PATTERNS]
    return X.strip(F.coalesce(*found))


def excluded_ingredients(text: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.rlike(text, F.lit(f"(?i){p}")), F.lit(name)) for p, name in tables.EXCLUSION_PATTERNS])
    )


def category_of(marked_text: Column, excluded: Column) -> Column:
    """Category of the right-most category word, the longest where several start together.

    Excluded ingredients are blanked first. The greedy prefix of the pattern
    finds the right-most start, the order of the alternatives the longest word.
    """
    phrases = F.transform(excluded, lambda i: F.try_element_at(
        X.literal_map({name: X.marked(name) for _, name in tables.EXCLUSION_PATTERNS}), i))
    words = "|".join(X.marked(w) for w, _ in X.longest_first(tables.CATEGORY_WORDS))
    word = X.unmark(F.regexp_extract(X.drop_phrases(marked_text, phrases), f"(?s)^.*({words})", 1))
    return F.try_element_at(X.literal_map(CATEGORY_OF_WORD), word)


def _found(rows: list[dict], kind: str, marked_text: Column) -> Column:
    """Rows of a phrase table whose ``phrase`` occurs as whole words."""
    marked = [row | {"phrase": X.marked(row["phrase"])} for row in rows]
    return F.filter(X.literal(marked, f"array<struct<{kind}>>"), lambda r: F.contains(marked_text, r["phrase"]))


def one_plant_tag(tags: Column) -> Column:
    """Vegan implies vegetarian: keep the stricter tag."""
    return F.when(F.array_contains(tags, "vegan"), F.array_remove(tags, "vegetarian")).otherwise(tags)


def dietary_tags(marked_text: Column) -> Column:
    rows = [{"phrase": word, "tag": tag} for word, tag in tables.DIETARY_WORDS]
    found = F.transform(_found(rows, "phrase:string,tag:string", marked_text), lambda r: r["tag"])
    return one_plant_tag(F.array_distinct(found))


def ranking_preferences(text: Column) -> Column:
    rows = [{"phrase": word, "kind": kind} for word, kind in tables.PREFERENCE_WORDS]
    literal = X.literal(rows, "array<struct<phrase:string,kind:string>>")
    found = F.filter(literal, lambda r: F.contains(text, r["phrase"]))
    return F.array_distinct(F.transform(found, lambda r: r["kind"]))


# ---- nutrient bounds ------------------------------------------------------


def _constraint(nutrient: Column, operator: Column, value: Column) -> Column:
    return F.struct(
        nutrient.alias("nutrient"), operator.alias("operator"), value.alias("value"),
        F.when(nutrient == "energy_kcal_100g", F.lit("kcal")).otherwise(F.lit("g")).alias("unit"),
    )


def _no_constraints() -> Column:
    return F.array().cast(f"array<{CONSTRAINT_TYPE}>")


def _groups(text: Column, pattern: str, *groups: int) -> Column:
    """All matches of a pattern as structs of the chosen groups (g1, g2, ...)."""
    columns = [F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(g)) for g in groups]
    names = [f"g{i + 1}" for i in range(len(groups))]
    zipped = F.arrays_zip(*columns)
    # A NULL-free list of structs with our own field names.
    return zipped.cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")


def _nutrient_of(word: Column) -> Column:
    return F.try_element_at(X.literal_map(NUTRIENT_OF_WORD), F.lower(word))


def directed_bounds(text: Column, first_unit: Column) -> Column:
    """Bounds with a direction word; the text's first unit decides about milligrams."""
    divisor = F.when(first_unit == "mg", F.lit(1000.0)).otherwise(F.lit(1.0))

    def family(pattern: str, operator: str, amount: int, word: int) -> Column:
        build = lambda m: _constraint(
            _nutrient_of(m["g2"]), F.lit(operator), m["g1"].cast("double") / divisor)
        return F.transform(_groups(text, pattern, amount, word), build)

    return F.concat(*[family(*row) for row in tables.DIRECTED_BOUND_PATTERNS])


def bare_bounds(text: Column, directed: Column) -> Column:
    """Bounds without a direction word, for nutrients that have no directed bound."""

    def build(m: Column) -> Column:
        nutrient = _nutrient_of(m["g3"])
        operator = F.when(nutrient.isin(tables.MORE_IS_ASKED), F.lit(">=")).otherwise(F.lit("<="))
        divisor = F.when(F.lower(m["g2"]) == "mg", F.lit(1000.0)).otherwise(F.lit(1.0))
        return _constraint(nutrient, operator, m["g1"].cast("double") / divisor)

    found = F.transform(_groups(text, tables.BARE_BOUND_PATTERN, 1, 2, 3), build)
    return F.filter(found, lambda c: ~F.exists(directed, lambda d: d["nutrient"] == c["nutrient"]))


def calorie_bounds(text: Column, strict: bool = False) -> Column:
    """Every "300 calories" caps the calories, whatever words stand around it.

    ``strict`` leaves out amounts right after a word that asks for more.
    """
    pattern = tables.BARE_CALORIE_PATTERN
    if strict:
        pattern = r"(?<!over )(?<!above )(?<!than )(?<!least )(?<![\d.])" + pattern
    return F.transform(
        _groups(text, pattern, 1),
        lambda m: _constraint(F.lit("energy_kcal_100g"), F.lit("<="), m["g1"].cast("double")),
    )


def zero_sugar_bound(text: Column) -> Column:
    bound = _constraint(F.lit("sugars_100g"), F.lit("<="), F.lit(tables.ZERO_SUGAR_BOUND))
    return F.when(F.rlike(text, F.lit(f"(?i){tables.ZERO_SUGAR_PATTERN}")), F.array(bound)).otherwise(_no_constraints())


def quality_bounds(marked_text: Column, numeric: Column) -> Column:
    """Bounds of "high", "low" and "less", for nutrients without a numeric bound."""
    bound_of = {(d, n): (op, value) for d, n, op, value in tables.QUALITY_BOUNDS}
    rows = [
        {"phrase": f"{d} {word}", "nutrient": nutrient} | dict(zip(("operator", "value"), bound_of[d, nutrient]))
        for d in dict.fromkeys(d for d, *_ in tables.QUALITY_BOUNDS)
        for word, nutrient in tables.NUTRIENT_WORDS
        if (d, nutrient) in bound_of
    ]
    found = _found(rows, "phrase:string,nutrient:string,operator:string,value:double", marked_text)
    free = F.filter(found, lambda r: ~F.exists(numeric, lambda c: c["nutrient"] == r["nutrient"]))
    return F.transform(free, lambda r: _constraint(r["nutrient"], r["operator"], r["value"]))


def diet_bound(text: Column) -> Column:
    bound = _constraint(F.lit("sodium_100g"), F.lit("<="), F.lit(tables.LOW_SODIUM_DIET_BOUND))
    asked = F.contains(text, F.lit(tables.LOW_SODIUM_DIETS[0])) | F.contains(text, F.lit(tables.LOW_SODIUM_DIETS[1]))
    return F.when(asked, F.array(bound)).otherwise(_no_constraints())


def strictest(constraints: Column) -> Column:
    """One bound per nutrient and operator, the strictest, in first-seen order."""
    key = lambda c: F.struct(c["nutrient"].alias("nutrient"), c["operator"].alias("operator"))
    keys = F.array_distinct(F.transform(constraints, key))

    def best(k: Column) -> Column:
        same = F.filter(constraints, lambda c: key(c) == k)
        values = F.transform(same, lambda c: c["value"])
        value = F.when(k["operator"].startswith("<"), F.array_min(values)).otherwise(F.array_max(values))
        unit = F.element_at(same, 1)["unit"]
        return F.struct(
            k["nutrient"].alias("nutrient"), k["operator"].alias("operator"), value.alias("value"), unit.alias("unit")
        )

    return F.transform(keys, best)


# ---- search terms ---------------------------------------------------------


def search_terms(marked_text: Column, category: Column, excluded: Column, target: Column) -> Column:
    """Words left over once everything understood is blanked, then the target's words."""
    forms = {
        name: [X.marked(p) for p in dict.fromkeys([name, name.replace(" ", "-"), *name.split()])]
        for _, name in tables.EXCLUSION_PATTERNS
    }
    own = F.coalesce(F.try_element_at(X.literal_map(PHRASES_OF_CATEGORY), category), X.strings([]))
    excluded_forms = F.flatten(F.transform(excluded, lambda i: F.try_element_at(X.literal_map(forms), i)))
    blanked = X.drop_phrases(marked_text, F.concat(own, X.strings(DELETED_PHRASES), excluded_forms))
    words = F.array_except(X.tokens(blanked, "[a-z][a-z]+"), X.strings(tables.STOP_WORDS + tables.UNIT_TOKENS))
    target_words = X.tokens(F.lower(F.coalesce(target, F.lit(""))), "[a-z]+")
    return F.array_distinct(F.concat(words, target_words))


# ---- whole phrases --------------------------------------------------------

INTENT_FIELDS = [
    "category", "nutrient_constraints", "dietary_tags", "search_terms", "ranking_preferences",
    "comparison_product", "excluded_ingredients",
]


def parse(queries: DataFrame, text: str, into: str = "intent", strict_bare_kcal: bool = False) -> DataFrame:
    """Add a struct column with the intent read from ``text``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    temporary = [f"_{into}_{n}" for n in (
        "spaced", "marked", "unit", "target", "excluded", "directed", "numeric", "category", "tags",
        "preferences", "constraints")]
    spaced, marked, unit, target, excluded, directed, numeric, category, tags, preferences, constraints = temporary
    staged = queries.withColumn(spaced, F.replace(F.lower(raw), F.lit("-"), F.lit(" ")))
    staged = staged.withColumns({
        marked: X.mark_words(F.col(spaced)),
        unit: F.regexp_extract(F.lower(raw), tables.UNIT_PATTERN, 1),
        target: comparison_target(raw),
        excluded: excluded_ingredients(F.lower(raw)),
    })
    staged = staged.withColumns({
        directed: directed_bounds(raw, F.col(unit)),
        category: category_of(F.col(marked), F.col(excluded)),
        tags: dietary_tags(F.col(marked)),
        preferences: ranking_preferences(F.col(spaced)),
    })
    staged = staged.withColumn(numeric, F.concat(
        F.col(directed), bare_bounds(raw, F.col(directed)), calorie_bounds(raw, strict_bare_kcal), zero_sugar_bound(raw)
    ))
    staged = staged.withColumn(constraints, F.concat(
        F.col(numeric), quality_bounds(F.col(marked), F.col(numeric)), diet_bound(F.col(spaced))
    ))
    terms = search_terms(F.col(marked), F.col(category), F.col(excluded), F.col(target))
    parts = [
        F.col(category), strictest(F.col(constraints)), F.col(tags), terms, F.col(preferences),
        F.col(target), F.col(excluded),
    ]
    return staged.withColumn(
        into, F.struct(*[p.alias(n) for p, n in zip(parts, INTENT_FIELDS)])
    ).drop(*temporary)


def merge_intents(first: Column, second: Column) -> Column:
    """Both readings of one phrase: gaps filled, lists united, strictest bounds.

    Exclusions come from the first reading only.
    """
    both = lambda name: F.concat(first[name], second[name])
    return F.struct(
        F.coalesce(first["category"], second["category"]).alias("category"),
        strictest(both("nutrient_constraints")).alias("nutrient_constraints"),
        one_plant_tag(F.array_distinct(both("dietary_tags"))).alias("dietary_tags"),
        F.array_distinct(both("search_terms")).alias("search_terms"),
        F.array_distinct(both("ranking_preferences")).alias("ranking_preferences"),
        F.coalesce(F.nullif(first["comparison_product"], F.lit("")), second["comparison_product"])
        .alias("comparison_product"),
        first["excluded_ingredients"].alias("excluded_ingredients"),
    )


def signal_score(intent: Column) -> Column:
    """How much a reading understood."""
    return (
        F.when(intent["category"].isNotNull(), F.lit(2)).otherwise(F.lit(0))
        + F.size(intent["dietary_tags"]) * 2
        + F.size(intent["nutrient_constraints"]) * 3
        + F.size(intent["ranking_preferences"])
    )


def annotate_queries(
    queries: DataFrame, text: str = "text", translation: str | None = None, strict_bare_kcal: bool = False
) -> DataFrame:
    """Add language, normal form and the intent's fields to a query log. No shuffle.

    Store the result before filtering or joining on its columns: Spark would push
    such a condition, with the parser written out in it, down to the log.
    """
    staged = parse(preprocess(queries, text, translation), "normalized_text", "_first", strict_bare_kcal)
    if translation is None:
        # Both readings would be the same, and merging a reading with itself changes nothing.
        fields = F.col("_first")
        return staged.select(
            "*", *[fields[n].alias(n) for n in INTENT_FIELDS], signal_score(fields).alias("signal_score")
        ).drop("_first", "rule_text")
    staged = parse(staged, "rule_text", "_second", strict_bare_kcal)
    french = F.col("language") == "fr"
    richer = french & (signal_score(F.col("_second")) > signal_score(F.col("_first")))
    merged = F.when(french, merge_intents(F.col("_first"), F.col("_second"))).otherwise(F.col("_first"))
    staged = staged.withColumns({
        "_merged": merged,
        "signal_score": signal_score(F.col("_first")),
        "normalized_text": F.when(richer, F.col("rule_text")).otherwise(F.col("normalized_text")),
    })
    return staged.select(
        "*", *[F.col("_merged")[n].alias(n) for n in INTENT_FIELDS]
    ).drop("_first", "_second", "_merged", "rule_text")
