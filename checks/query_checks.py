"""Checks on the query log: normal form, intents, descriptions, relaxation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as o
from checks.registry import check, listed, whole
from larder import tables as t
from larder.functions.numbers import number_text
from larder.functions import text as X
from larder.functions.text import fold_accents
from larder.operators import annotate as A
from larder.operators import intents as I
from larder.plans.answers import read_queries
from larder.plans.joins import evenly
from larder.plans.phrases import normalize_by_table, phrases_found
from larder.sources import fixtures

LOG = o.with_(o.QUERY_LOG)
PRE = o.with_(o.QUERY_LOG, o.PREPROCESSED)
PARSED = o.with_(o.PARSED)


def texts(spark, folder):
    """The different texts of the whole log."""
    return evenly(fixtures.query_log(spark, folder).select("text").distinct(), "text")


def parsed(spark, folder):
    return A.annotate_queries(texts(spark, folder))


def bounds_text(constraints):
    return F.array_join(
        F.transform(constraints, lambda c: F.concat(c["nutrient"], c["operator"], number_text(c["value"]))), "|")


# ---- normal form -----------------------------------------------------------


@check("E1_fold_accents", LOG + "SELECT text, strip_accents(text) AS folded FROM texts")
def folded(spark, folder):
    return texts(spark, folder).select("text", fold_accents(F.col("text")).alias("folded"))


@check("E2_language", LOG + f"SELECT text, {o.LANGUAGE} AS language FROM texts")
def language(spark, folder):
    return texts(spark, folder).select("text", A.detect_language(F.col("text")).alias("language"))


def _normal(name: str, language: str) -> None:
    @check(name, LOG + f"SELECT text, {o.normalized_sql('text', o.lit(language))} AS normalized FROM texts")
    def query(spark, folder):
        return texts(spark, folder).select("text", A.normalize_text(F.col("text"), F.lit(language)).alias("normalized"))


_normal("E3_normalize_plain", "en")
_normal("E4_french_phrases", "fr")


def french_table(spark):
    """The built-in French replacements as a table."""
    pairs = t.TYPOS + X.longest_first(t.FRENCH_PHRASES) + t.FRENCH_NUMERIC_PHRASES
    return spark.createDataFrame([(i, old, new) for i, (old, new) in enumerate(pairs)], "place int, old string, new string")


@check("E4_phrase_table", LOG + f"SELECT text, {o.normalized_sql('text', o.lit('fr'))} AS normalized FROM texts")
def phrase_table(spark, folder):
    return normalize_by_table(texts(spark, folder), "text", french_table(spark), "normalized").select("text", "normalized")


@check("E5_french_numbers", LOG + f"""
SELECT text, {o.normalized_sql("replace(text, 'under', 'plus de')", "'fr'")} AS normalized FROM texts""")
def french_numbers(spark, folder):
    raw = F.replace("text", F.lit("under"), F.lit("plus de"))
    return texts(spark, folder).select("text", A.normalize_text(raw, F.lit("fr")).alias("normalized"))


@check("E6_spacing", LOG + f"""
SELECT text, {o.normalized_sql("replace(text, ' ', ' -  ,')", "'en'")} AS normalized FROM texts""")
def spacing(spark, folder):
    raw = F.replace("text", F.lit(" "), F.lit(" -  ,"))
    return texts(spark, folder).select("text", A.normalize_text(raw, F.lit("en")).alias("normalized"))


TRANSLATED = "CASE WHEN len(text) % 2 = 0 THEN 'Organic ' || text || ' under 5g  Sugar' ELSE '' END"
TRANSLATED_SPARK = "IF(length(text) % 2 = 0, 'Organic ' || text || ' under 5g  Sugar', '')"


@check("E7_preprocess", PRE + f"""
SELECT text, language, CASE WHEN language = 'fr' AND len(text) % 2 = 0
  THEN {o.normalized_sql(TRANSLATED, "'en'")} ELSE normalized END AS normalized FROM preprocessed""")
def preprocessed(spark, folder):
    log = texts(spark, folder).withColumn("english", F.expr(TRANSLATED_SPARK))
    return A.preprocess(log, "text", "english").select("text", "language", F.col("normalized_text").alias("normalized"))


# ---- intents ---------------------------------------------------------------


def _part(name: str, sql: str, *columns) -> None:
    @check(name, PARSED + f"SELECT text, {sql} FROM parsed")
    def query(spark, folder):
        return parsed(spark, folder).select("text", *[c() for c in columns])


_part("E8_comparison_target", "comparison", lambda: F.col("comparison_product").alias("comparison"))
_part("E9_exclusions", f"{o.joined('excluded')} AS excluded", lambda: listed("excluded_ingredients", "excluded"))
_part("E10_category", "category", lambda: F.col("category"))
_part("E11_dietary_tags", f"{o.joined('tags')} AS tags", lambda: listed("dietary_tags", "tags"))
_part("E19_strictest_bounds", f"{o.bounds_text('cons')} AS bounds",
      lambda: bounds_text("nutrient_constraints").alias("bounds"))
_part("E20_preferences", f"{o.joined('preferences')} AS preferences",
      lambda: listed("ranking_preferences", "preferences"))
_part("E21_search_terms", f"{o.joined('terms')} AS terms", lambda: listed("search_terms", "terms"))
_part("E22_annotate",
      f"language, normalized, category, comparison, {o.joined('tags')} AS tags, {o.joined('terms')} AS terms, "
      f"{o.joined('preferences')} AS preferences, {o.joined('excluded')} AS excluded, {o.bounds_text('cons')} AS bounds",
      lambda: F.col("language"), lambda: F.col("normalized_text").alias("normalized"), lambda: F.col("category"),
      lambda: F.col("comparison_product").alias("comparison"), lambda: listed("dietary_tags", "tags"),
      lambda: listed("search_terms", "terms"), lambda: listed("ranking_preferences", "preferences"),
      lambda: listed("excluded_ingredients", "excluded"), lambda: bounds_text("nutrient_constraints").alias("bounds"))
SIGNAL = "(CASE WHEN category IS NULL THEN 0 ELSE 2 END + 2 * len(tags) + 3 * len(cons) + len(preferences))"
_part("E24_signal_score", f"CAST({SIGNAL} AS BIGINT) AS signal_score", lambda: whole("signal_score"))


@check("E11_tags_by_table", PARSED + f"SELECT text, {o.joined('tags')} AS tags FROM parsed")
def tags_by_table(spark, folder):
    phrases = spark.createDataFrame([(i, w, tag) for i, (w, tag) in enumerate(t.DIETARY_WORDS)], "place int, old string, new string")
    marked = A.preprocess(texts(spark, folder)).select("text", X.mark_words(F.col("normalized_text")).alias("marked"))
    found = phrases_found(marked, "marked", phrases, "tags")
    return found.select("text", listed(A.one_plant_tag(F.col("tags")), "tags"))


def _bounds(name: str, sql: str, build) -> None:
    """One source of bounds, on the normal form of every text."""

    @check(name, PARSED + f"SELECT text, {o.bounds_text(sql)} AS bounds FROM p4")
    def query(spark, folder):
        rows = A.preprocess(texts(spark, folder)).withColumn("raw", F.col("normalized_text"))
        unit = F.regexp_extract("raw", t.UNIT_PATTERN, 1)
        rows = rows.withColumn("directed", A.directed_bounds(F.col("raw"), unit))
        rows = rows.withColumn("words", A.X.mark_words(F.replace("raw", F.lit("-"), F.lit(" "))))
        return rows.select("text", bounds_text(build()).alias("bounds"))


def _only(condition: str) -> str:
    return f"list_filter(numeric_bounds, lambda c: {condition})"


_bounds("E12_directed_bounds", "directed", lambda: F.col("directed"))
_bounds("E13_bare_bounds", "list_filter(numeric_bounds[len(directed) + 1:], "
        "lambda c: c.n <> 'energy_kcal_100g' AND NOT (c.n = 'sugars_100g' AND c.v = 0.5))",
        lambda: F.filter(A.bare_bounds(F.col("raw"), F.col("directed")), lambda c: c["nutrient"] != "energy_kcal_100g"))
_bounds("E14_calorie_bounds", f"list_transform(regexp_extract_all(normalized, {o.lit(t.BARE_CALORIE_PATTERN)}, 1), "
        "lambda a: {'n': 'energy_kcal_100g', 'o': '<=', 'v': CAST(a AS DOUBLE)})",
        lambda: A.calorie_bounds(F.col("raw")))
_bounds("E15_zero_sugar", f"CASE WHEN regexp_matches(normalized, {o.lit(t.ZERO_SUGAR_PATTERN)}) "
        "THEN [{'n': 'sugars_100g', 'o': '<=', 'v': 0.5}] ELSE [] END",
        lambda: A.zero_sugar_bound(F.col("raw")))
_bounds("E17_quality_bounds", "list_filter(all_bounds[len(numeric_bounds) + 1:], lambda c: c.v <> 0.12)",
        lambda: A.quality_bounds(F.col("words"), F.concat(
            "directed", A.bare_bounds(F.col("raw"), F.col("directed")), A.calorie_bounds(F.col("raw")),
            A.zero_sugar_bound(F.col("raw")))))
_bounds("E18_low_sodium_diet", "list_filter(all_bounds, lambda c: c.v = 0.12)", lambda: A.diet_bound(F.col("raw")))


@check("E16_units", LOG + """
SELECT text, CAST(len(text) AS DOUBLE) / 1000 AS spaced, CAST(len(text) AS DOUBLE) AS glued,
  CAST(len(text) AS DOUBLE) / 1000 AS bare FROM texts""")
def units(spark, folder):
    rows = texts(spark, folder).select(
        "text",
        F.format_string("under %d mg sodium", F.length("text")).alias("a"),
        F.format_string("under %dmg sodium", F.length("text")).alias("b"),
        F.format_string("%dmg sodium", F.length("text")).alias("c"))
    for column in ("a", "b", "c"):
        rows = A.parse(rows, column, f"i_{column}")
    value = lambda c: F.get(F.col(f"i_{c}.nutrient_constraints"), F.lit(0))["value"]
    return rows.select("text", value("a").alias("spaced"), value("b").alias("glued"), value("c").alias("bare"))


MERGED = f"""{o.QUERY_LOG},
{o.PREPROCESSED},
first_texts AS (SELECT text, language, CASE WHEN language = 'fr' AND len(text) % 2 = 0
  THEN {o.normalized_sql(TRANSLATED, "'en'")} ELSE normalized END AS normalized FROM preprocessed),
{o.parse_ctes('first_texts', 'a_')},
{o.parse_ctes('preprocessed', 'b_')},
united AS (SELECT a.text, a.language, a.excluded, a.normalized AS first_text, b.normalized AS second_text,
  coalesce(a.category, b.category) AS category, coalesce(a.comparison, b.comparison) AS comparison,
  list_concat(a.tags, b.tags) AS tags, list_concat(a.preferences, b.preferences) AS preferences,
  list_concat(a.terms, b.terms) AS terms, list_concat(a.cons, b.cons) AS cons
  FROM a_parsed a JOIN b_parsed b ON a.text = b.text)"""


@check("E23_merge_readings", o.with_(MERGED) + f"""
SELECT text, category, comparison, {o.joined('excluded')} AS excluded,
  {o.joined(f"list_filter({o.first_seen('tags')}, lambda x: x <> 'vegetarian' OR NOT list_contains(tags, 'vegan'))")} AS tags,
  {o.joined(o.first_seen('preferences'))} AS preferences, {o.joined(o.first_seen('terms'))} AS terms,
  {o.bounds_text(o.strictest_sql('cons'))} AS bounds FROM united""")
def merge_readings(spark, folder):
    log = texts(spark, folder).withColumn("english", F.expr(TRANSLATED_SPARK))
    return A.annotate_queries(log, "text", "english").select(
        "text", "category", F.col("comparison_product").alias("comparison"), listed("excluded_ingredients", "excluded"),
        listed("dietary_tags", "tags"), listed("ranking_preferences", "preferences"), listed("search_terms", "terms"),
        bounds_text("nutrient_constraints").alias("bounds"))


@check("E25_extract", PARSED + f"""
SELECT text, {o.joined('tags')} AS tags, {o.joined('terms')} AS terms, {o.joined('preferences')} AS preferences,
  {o.joined('excluded')} AS excluded FROM parsed""")
def extract(spark, folder):
    doubled = parsed(spark, folder).withColumns({n: F.concat(n, n) for n in I.LIST_FIELDS})
    return I.extract_constraints(doubled).select(
        "text", listed("dietary_tags", "tags"), listed("search_terms", "terms"),
        listed("ranking_preferences", "preferences"), listed("excluded_ingredients", "excluded"))


def tag_sql(tags: dict[str, str], category: str = "category") -> str:
    single = f"CASE WHEN {category} LIKE '%s' THEN {category}[1:-2] ELSE {category} END"
    return (f"CASE WHEN {category} IS NOT NULL THEN coalesce({o.case_map(category, tags)}, {o.case_map(single, tags)}, "
            f"'en:' || replace({category}, ' ', '-')) END")


@check("E26_category_tags", PARSED + f"""
SELECT text, {tag_sql(t.CATEGORY_TAGS)} AS category_tag, {tag_sql(fixtures.FIXTURE_TAGS)} AS own_tag FROM parsed""")
def category_tags(spark, folder):
    rows = parsed(spark, folder)
    own = I.map_categories(rows, fixtures.FIXTURE_TAGS).withColumnRenamed("category_tag", "own_tag")
    return I.map_categories(own).select("text", "category_tag", "own_tag")


@check("E26_tags_by_join", PARSED + f"SELECT text, {tag_sql(fixtures.FIXTURE_TAGS)} AS category_tag FROM parsed")
def tags_by_join(spark, folder):
    tags = spark.createDataFrame([*fixtures.FIXTURE_TAGS.items(), ("SNACKS", "zz:later"), (None, "x"), ("x", None)], "word string, tag string")
    return I.map_categories(parsed(spark, folder), tags).select("text", "category_tag")


def mapped(spark, folder):
    """The log's texts as searchable constraints."""
    return read_queries(fixtures.query_log(spark, folder), fixtures.FIXTURE_TAGS)


SHORT = o.case_map("c.n", t.NUTRIENT_NAMES)


@check("E27_interpreted", PARSED + f"""
SELECT text, category, language, array_to_string(list_sort(list_transform(cons, lambda c: {SHORT}
  || CASE WHEN c.o LIKE '>%' THEN '_min' ELSE '_max' END || '=' || printf('%g', c.v))), '|') AS bounds,
  replace({o.joined('tags')}, '-', '_') AS flags, {o.joined('terms')} AS keywords,
  CASE WHEN len(excluded) > 0 THEN {o.joined('excluded')} END AS exclude_ingredients FROM parsed""")
def interpreted(spark, folder):
    shown = I.interpreted_query(*[F.col(c) for c in (
        "category", "nutrient_constraints", "dietary_tags", "search_terms", "excluded_ingredients", "language")])
    rows = mapped(spark, folder).select("text", shown.alias("q"))
    bounds = F.array_sort(F.transform(
        F.map_entries("q.bounds"), lambda e: F.concat(e["key"], F.lit("="), number_text(e["value"]))))
    return rows.select(
        "text", "q.category", "q.language", listed(bounds, "bounds"), listed("q.flags", "flags"),
        listed("q.keywords", "keywords"), listed("q.exclude_ingredients", "exclude_ingredients"))


FILTERS_SQL = f"""list_concat(CASE WHEN category IS NULL THEN [] ELSE ['category: ' || category] END,
  list_transform(cons, lambda c: replace({SHORT}, '_', ' ') || ' ' || c.o || ' ' || printf('%g', c.v)
    || CASE WHEN c.n = 'energy_kcal_100g' THEN 'kcal' ELSE 'g' END),
  tags, list_transform(excluded, lambda x: 'exclude ingredient: ' || x))"""


@check("E28_applied_filters", PARSED + f"SELECT text, {o.joined(FILTERS_SQL)} AS filters FROM parsed")
def filters(spark, folder):
    shown = I.applied_filters(*[F.col(c) for c in (
        "category", "nutrient_constraints", "dietary_tags", "excluded_ingredients")])
    return mapped(spark, folder).select("text", listed(shown, "filters"))


# ---- relaxation and rationale ----------------------------------------------


def relax_sql(bounds: str) -> str:
    floor = (f"CASE WHEN c.n IN {o.in_list(t.MORE_IS_ASKED)} THEN c.v - 2.0 ELSE c.v * CAST(0.9 AS DOUBLE) END")
    cap = "CASE WHEN c.n = 'energy_kcal_100g' THEN c.v + 50.0 ELSE c.v * CAST(1.15 AS DOUBLE) END"
    # printf rounds the exact binary value, ties to even.
    return (f"list_transform({bounds}, lambda c: {{'n': c.n, 'o': c.o, 'v': CAST(printf('%.3f', CASE WHEN c.o LIKE '>%' "
            f"THEN greatest(CAST(0 AS DOUBLE), {floor}) ELSE {cap} END) AS DOUBLE)}})")


LEVELS = f"""step1 AS MATERIALIZED (SELECT *, cons AS cons0, {relax_sql('cons')} AS cons1 FROM parsed),
levels AS MATERIALIZED (SELECT *, {relax_sql('cons1')} AS cons2 FROM step1)"""


def log_sql(before: str, after: str) -> str:
    return (f"list_transform(list_filter(list_zip({before}, {after}), lambda z: z[1].v <> z[2].v), "
            "lambda z: replace(z[1].n, '_100g', '') || ' ' || z[1].o || ' changed from ' || printf('%g', z[1].v) "
            "|| ' to ' || printf('%g', z[2].v))")


@check("F4_relax", o.with_(o.PARSED, LEVELS) + f"""
SELECT text, {o.bounds_text('cons1')} AS bounds1, {o.bounds_text('cons2')} AS bounds2,
  {o.joined(log_sql('cons0', 'cons1'))} AS log1, {o.joined(log_sql('cons1', 'cons2'))} AS log2 FROM levels""")
def relax(spark, folder):
    rows = I.add_relaxations(mapped(spark, folder))
    return rows.select(
        "text", bounds_text(F.get("bounds", F.lit(1))).alias("bounds1"), bounds_text(F.get("bounds", F.lit(2))).alias("bounds2"),
        listed(F.get("step_logs", F.lit(0)), "log1"), listed(F.get("step_logs", F.lit(1)), "log2"))


@check("F6_remove_category", PARSED + f"""
SELECT text, CAST(NULL AS VARCHAR) AS category, CASE WHEN category IS NULL THEN '' ELSE
  'category constraint removed (category=' || category || ', tag=' || {tag_sql(fixtures.FIXTURE_TAGS)} || ')' END AS log
FROM parsed""")
def remove_category(spark, folder):
    return I.remove_category(mapped(spark, folder)).select("text", "category", listed("category_log", "log"))


def rationale_sql(cons: str) -> str:
    title = o.case_map("c.n", {
        n: " ".join(w.capitalize() for w in n.replace("_100g", "").split("_")) for n in t.NUTRIENTS})
    return f"""list_concat(['Best Nutri-Score'], CASE WHEN len({cons}) > 0 THEN list_transform({cons},
    lambda c: CASE WHEN c.o LIKE '<%' THEN 'Low ' ELSE 'High ' END || {title})
  WHEN list_contains(preferences, 'healthy') THEN ['High protein', 'Low sugar', 'Low sodium', 'Lower calories'] ELSE [] END,
  CASE WHEN category IS NULL THEN [] ELSE ['Category relevance'] END,
  CASE WHEN len(tags) > 0 THEN ['Dietary label match'] ELSE [] END,
  list_transform(excluded[1:2], lambda x: 'No ' || x))"""


@check("G20_rationale", PARSED + f"SELECT text, {o.joined(rationale_sql('cons'))} AS rationale FROM parsed")
def rationale(spark, folder):
    shown = I.ranking_rationale(
        *[F.col(c) for c in ("category", "nutrient_constraints", "dietary_tags", "excluded_ingredients")],
        F.array_contains("ranking_preferences", "healthy"))
    return mapped(spark, folder).select("text", listed(shown, "rationale"))


