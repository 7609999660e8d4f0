"""Checks on searching, scoring, answers, recommendations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as o
from checks.query_checks import FILTERS_SQL, LEVELS, bounds_text, log_sql, mapped, rationale_sql, relax_sql, tag_sql
from checks.product_checks import improvements_sql
from checks.registry import check, listed, products, rounded, stored_products, whole
from larder import tables as t
from larder.operators import scoring as S
from larder.operators.predicates import CONSTRAINT_TYPE
from larder.plans.answers import answer_intents, answer_log, answer_read, answer_whole_log, cards, for_log, read_queries
from larder.plans.recommend import category_pools, compare_queries, recommend_all, reference_products
from larder.plans.search import add_search_key, search_intents
from larder.plans.vectors import Vectors, nearest
from larder.sources import fixtures

# ---- SQL: search by nested loop ---------------------------------------------


def amount_sql(nutrient: str) -> str:
    return "CASE " + nutrient + " " + " ".join(f"WHEN '{n}' THEN {n}" for n in t.NUTRIENTS) + " END"


def holds_sql(guarded: bool) -> str:
    """Test of one constraint ``c`` on the row's amounts."""
    a = amount_sql("c.n")
    guard = f" AND (c.n <> 'energy_kcal_100g' OR {a} > 0)" if guarded else ""
    equal = f"{a} = c.v" if guarded else f"abs({a} - c.v) <= 1e-6"
    return (f"coalesce(CASE c.o WHEN '<=' THEN {a} <= c.v{guard} WHEN '<' THEN {a} < c.v{guard} WHEN '>=' THEN {a} >= c.v "
            f"WHEN '>' THEN {a} > c.v WHEN '==' THEN {equal} END, FALSE)")


def passes_sql(cons: str) -> str:
    present = "c.n NOT IN ('carbohydrates_100g', 'salt_100g')"  # columns the catalog lacks
    return f"len(list_filter({cons}, lambda c: {present} AND NOT {holds_sql(True)})) = 0"


LABEL_PATTERN = o.case_map("x", {k: "|".join(v) for k, v in t.LABEL_PATTERNS.items()}, "x")
KEYWORDS = f"list_filter(terms, lambda x: len(x) >= {t.KEYWORD_MIN_LENGTH})[1:{t.KEYWORDS_USED}]"
TEXT_TESTS = f"""is_listed AND (wanted IS NULL OR contains(category_filter_text, lower(wanted)))
  AND len(list_filter(tags, lambda x: NOT regexp_matches(lower(label_text), {LABEL_PATTERN}))) = 0
  AND len(list_filter({KEYWORDS}, lambda x: NOT contains(lower(combined_text), x))) = 0
  AND len(list_filter(excluded, lambda x: contains(lower(ingredient_filter_text), x)
    OR contains(lower(ingredient_filter_text), replace(x, ' ', '-')))) = 0"""


def search_sql(source: str, limit: int, relaxed: bool = True, key: str = "text") -> str:
    """CTE ``found``: candidates of the intents in ``source``, by nested loop.

    ``source`` has wanted, tags, terms, excluded, preferences, cons0 (and cons1, cons2).
    """
    level = f"CASE WHEN {passes_sql('cons0')} THEN 0"
    if relaxed:
        level += f" WHEN {passes_sql('cons1')} THEN 1 WHEN {passes_sql('cons2')} THEN 2"
    order = o.order_sql(
        "list_contains(preferences, 'kids')",
        "(list_contains(preferences, 'healthy') OR len(cons0) > 0 OR len(tags) > 0)")
    return f"""hits AS (SELECT * FROM (SELECT *, {level} END AS level FROM {source}, quality WHERE {TEXT_TESTS})
  WHERE level IS NOT NULL),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS candidate_rank
  FROM (SELECT *, min(level) OVER (PARTITION BY {key}) AS lowest FROM hits) WHERE level = lowest)
  WHERE candidate_rank <= {limit})"""


SEARCHES = f"""{o.CATALOG},
{o.PROD},
{o.QUALITY},
{o.PARSED},
{LEVELS},
asked AS MATERIALIZED (SELECT *, {tag_sql(fixtures.FIXTURE_TAGS)} AS wanted FROM levels WHERE coalesce(comparison, '') = '')"""


def searches(spark, folder):
    return mapped(spark, folder).filter(F.coalesce("comparison_product", F.lit("")) == "")


def by_text(queries, candidates):
    return add_search_key(queries).select("text", "intent_id").join(candidates, "intent_id")


@check("F1_search", o.with_(SEARCHES, search_sql("asked", t.CANDIDATE_ROWS, relaxed=False)) + """
SELECT text, code, candidate_rank FROM found""")
def search(spark, folder):
    asked = searches(spark, folder)
    found = search_intents(stored_products(spark, folder), asked, relaxed=False)
    return by_text(asked, found).select("text", "code", whole("candidate_rank"))


@check("F5_relaxation_ladder", o.with_(SEARCHES, search_sql("asked", t.CANDIDATE_ROWS)) + """
SELECT text, code, CAST(level AS BIGINT) AS level, candidate_rank FROM found""")
def ladder(spark, folder):
    asked = searches(spark, folder)
    found = search_intents(stored_products(spark, folder), asked)
    return by_text(asked, found).select("text", "code", whole("level"), whole("candidate_rank"))


@check("F5_ladder_beyond_heads", o.with_(SEARCHES, search_sql("asked", 5)) + """
SELECT text, code, CAST(level AS BIGINT) AS level, candidate_rank FROM found""")
def ladder_beyond_heads(spark, folder):
    asked = searches(spark, folder)
    found = search_intents(stored_products(spark, folder), asked, limit=5, head_rows=10)
    return by_text(asked, found).select("text", "code", whole("level"), whole("candidate_rank"))


# ---- searches from ready-made intents ---------------------------------------

# One intent per type and first word of the catalog's names, without a taxonomy.
WORD_INTENTS = """SELECT DISTINCT lower(p_type) || ' / ' || split_part(p_name, ' ', 1) AS text, lower(p_type) AS category,
  split_part(p_name, ' ', 1) AS word FROM part"""
NO_LIST = "CAST([] AS VARCHAR[])"
NO_CONS = "CAST([] AS STRUCT(n VARCHAR, o VARCHAR, v DOUBLE)[])"


@check("F2_search_without_taxonomy", o.with_(o.CATALOG, o.PROD, o.QUALITY, f"""asked AS (
SELECT text, category AS wanted, [word] AS terms, {NO_LIST} AS tags, {NO_LIST} AS excluded, {NO_LIST} AS preferences,
  {NO_CONS} AS cons0 FROM ({WORD_INTENTS}))""", search_sql("asked", t.RESULT_ROWS * t.POOL_FACTOR, relaxed=False)) + """
SELECT text, code, candidate_rank FROM found""")
def search_without_taxonomy(spark, folder):
    stored = stored_products(spark, folder)
    asked = spark.sql(WORD_INTENTS).withColumn("search_terms", F.array("word"))
    found = search_intents(stored, asked, limit=t.RESULT_ROWS * t.POOL_FACTOR, relaxed=False)
    return by_text(asked, found).select("text", "code", whole("candidate_rank"))


# One intent per brand with bounds that often need relaxing.
BRAND_ROWS = """SELECT DISTINCT lower(p_brand) AS brand, CAST(length(p_brand) AS DOUBLE) AS size FROM part"""


@check("F3_ready_made_intents", o.with_(o.CATALOG, o.PROD, o.QUALITY, f"""brands AS ({BRAND_ROWS}),
start AS (SELECT brand AS text, CAST(NULL AS VARCHAR) AS wanted, [brand] AS terms, ['organic'] AS tags,
  ['large'] AS excluded, ['kids'] AS preferences,
  [{{'n': 'energy_kcal_100g', 'o': '<=', 'v': size * 3}}, {{'n': 'proteins_100g', 'o': '>=', 'v': size * 2.5}}] AS cons0
  FROM brands),
step AS (SELECT *, {relax_sql('cons0')} AS cons1 FROM start),
asked AS (SELECT *, {relax_sql('cons1')} AS cons2 FROM step)""", search_sql("asked", t.CANDIDATE_ROWS)) + """
SELECT text, code, CAST(level AS BIGINT) AS level, candidate_rank FROM found""")
def ready_made_intents(spark, folder):
    stored = stored_products(spark, folder)
    bound = lambda n, op, v, unit: F.struct(
        F.lit(n).alias("nutrient"), F.lit(op).alias("operator"), v.alias("value"), F.lit(unit).alias("unit"))
    asked = spark.sql(BRAND_ROWS).select(
        F.col("brand").alias("text"), F.array("brand").alias("search_terms"),
        F.array(F.lit("organic")).alias("dietary_tags"), F.array(F.lit("large")).alias("excluded_ingredients"),
        F.array(F.lit("kids")).alias("ranking_preferences"),
        F.array(bound("energy_kcal_100g", "<=", F.col("size") * 3, "kcal"),
                bound("proteins_100g", ">=", F.col("size") * 2.5, "g")).alias("nutrient_constraints"))
    answers = answer_intents(stored, asked)
    return by_text(answers.queries, answers.candidates).select("text", "code", whole("level"), whole("candidate_rank"))


# ---- scores on given pairs ---------------------------------------------------

# One given intent per product type, so that every product is scored.
GIVEN = [
    ("economy", "Healthy vegan ECONOMY snacks for kids", [("proteins_100g", ">=", 10.0), ("energy_kcal_100g", "<=", 300.0)],
     ["vegan", "organic"], ["red", "anvil"], ["healthy", "kids"]),
    ("small", "small brand 2 ring", [("sugars_100g", "<=", 5.0), ("fat_100g", "==", 14.0)], ["gluten-free"], ["ring"], []),
    ("medium", "nothing in common", [], [], [], ["healthy"]),
    ("promo", "promo", [("energy_kcal_100g", "<", 250.0), ("energy_kcal_100g", "<=", 400.0), ("sodium_100g", ">", 0.3)],
     ["kosher"], ["brand", "goods"], ["kids"]),
    ("standard", "", [("salt_100g", "<=", 1.0), ("fiber_100g", ">=", 6.0)], ["vegetarian", "halal"], [], ["healthy"]),
    ("large", "large blue bolt, large red rod", [("saturated_fat_100g", "<=", 2.0)], [], ["large"], []),
]


def unit_of(nutrient: str) -> str:
    return "kcal" if nutrient == "energy_kcal_100g" else "g"


def _given_sql() -> str:
    rows = []
    for category, text, cons, tags, terms, preferences in GIVEN:
        bounds = ", ".join(
            f"{{'n': {o.lit(n)}, 'o': {o.lit(op)}, 'v': CAST({v} AS DOUBLE), 'u': '{unit_of(n)}'}}" for n, op, v in cons)
        rows.append(
            f"SELECT {o.lit(category)} AS category, {o.lit(text)} AS raw_text, "
            f"CAST([{bounds}] AS STRUCT(n VARCHAR, o VARCHAR, v DOUBLE, u VARCHAR)[]) AS cons, "
            f"CAST({o.strs(tags)} AS VARCHAR[]) AS tags, CAST({o.strs(terms)} AS VARCHAR[]) AS terms, "
            f"CAST({o.strs(preferences)} AS VARCHAR[]) AS preferences")
    return "given AS (" + " UNION ALL ".join(rows) + "),\npairs AS (SELECT * FROM insight JOIN given ON category = categories[1])"


def score_sql(pairs: str) -> str:
    """CTE ``scored`` from pairs of insight rows and cons, tags, terms, preferences, category, raw_text."""
    tokens = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
    words, own = tokens.format("raw_text"), tokens.format(
        "concat_ws(' ', name, brands, array_to_string(categories, ' '), ingredients_text)")
    synonyms = o.case_map("x", {k: "|".join(v) for k, v in t.LABEL_SYNONYMS.items()}, "x")
    haystack = "lower(name || ' ' || brands || ' ' || array_to_string(categories, ' ') || ' ' || ingredients_text)"
    a = amount_sql("c.n")
    room = (f"least(2.5, CASE WHEN c.o LIKE '<%' THEN greatest(0, c.v - {a}) WHEN c.o LIKE '>%' THEN greatest(0, {a} - c.v) "
            "ELSE 0 END / greatest(abs(c.v), 1) * 2.5)")
    caps = "list_filter(cons, lambda c: c.n = 'energy_kcal_100g' AND c.o LIKE '<%')"
    cap = f"list_min(list_transform({caps}, lambda c: c.v))"
    ramps = " + ".join(
        [f"({o.ramp_down(n, *r)})" for n, *r in t.HEALTHY_LOW_RAMPS]
        + [f"({o.ramp_up(n, *r)})" for n, *r in t.HEALTHY_HIGH_RAMPS])
    title = o.case_map("c.n", {n: " ".join(w.capitalize() for w in n.replace("_100g", "").split("_")) for n in t.NUTRIENTS})
    sweet = " OR ".join(f"contains(lower(array_to_string(categories, ' ')), '{w}')" for w in t.SWEET_CATEGORIES)
    return f"""s1 AS (SELECT *, {words} AS words, {own} AS own_words,
  list_filter(tags, lambda x: regexp_matches(strip_accents(lower(array_to_string(labels, ' '))), {synonyms})) AS ok_tags,
  list_filter(terms, lambda x: contains({haystack}, x)) AS ok_terms,
  list_filter(cons, lambda c: {holds_sql(False)}) AS ok_cons,
  list_filter(cons, lambda c: {a} IS NOT NULL AND NOT {holds_sql(False)}) AS broken,
  category IS NOT NULL AND len(list_filter(categories, lambda x: contains(lower(x), category))) > 0 AS in_category
  FROM {pairs}),
s2 AS (SELECT *, CASE WHEN len(words) = 0 OR len(own_words) = 0 THEN 0.0 ELSE
    CAST(len(list_intersect(words, own_words)) AS DOUBLE) / (len(words) + len(own_words) - len(list_intersect(words, own_words)))
    END AS similarity,
  CAST({o.case_map('nutriscore', t.GRADE_BONUS, '0')} AS DOUBLE) AS grade_bonus,
  CASE WHEN in_category THEN 8.0 ELSE 0.0 END AS category_bonus,
  len(ok_tags) * 6.0 AS dietary_bonus,
  coalesce(list_sum(list_transform(ok_cons, lambda c: 5 + {room})), 0) AS constraint_bonus,
  len(broken) * -15.0 AS violation_penalty,
  CASE WHEN NOT ({sweet}) AND sugars_100g > 15 THEN -least(10, (sugars_100g - 15) * 0.4) ELSE 0 END AS sugar_penalty,
  CASE WHEN energy_kcal_100g > {cap} THEN -least(20, (energy_kcal_100g - {cap}) * 0.05) ELSE 0 END AS calorie_penalty,
  nutrient_quality * 3 + {ramps} AS ramps,
  CASE WHEN list_contains(preferences, 'kids') THEN {o.ramp_down('sugars_100g', *t.KIDS_SUGAR_RAMP)} ELSE 0.0 END AS kids_bonus,
  len(ok_terms) * 0.5 AS term_bonus, list_concat(
    CASE WHEN in_category THEN ['Matches category ''' || category || ''''] ELSE [] END,
    list_transform(ok_tags, lambda x: 'Matches ' || x || ' label'),
    list_transform(ok_cons, lambda c: {title} || ' ' || printf('%g', {a}) || ' satisfies ' || c.o || ' ' || printf('%g', c.v)
      || ' ' || CASE WHEN c.n = 'energy_kcal_100g' THEN 'kcal' ELSE 'g' END || '/100g'),
    CASE WHEN list_contains(preferences, 'healthy') AND nutriscore IN ('a', 'b', 'c', 'd', 'e')
      THEN ['Nutri-Score ' || upper(nutriscore) || ' supports healthy preference'] ELSE [] END,
    CASE WHEN list_contains(preferences, 'kids') AND sugars_100g IS NOT NULL
      THEN ['Sugar level ' || printf('%g', sugars_100g) || ' g/100g is suitable for kid-focused ranking'] ELSE [] END,
    list_transform(ok_terms, lambda x: 'Matches search term ''' || x || '''')) AS reasons
  FROM s1),
s3 AS (SELECT *, CASE WHEN list_contains(preferences, 'healthy')
    THEN CAST({o.case_map('health_class', t.CLASS_BONUS, '0')} AS DOUBLE) + ramps ELSE 0 END AS healthy_bonus,
  CASE WHEN len(reasons) > 0 THEN ({o.first_seen('reasons')})[1:4] ELSE [summary] END AS explanations FROM s2),
scored AS (SELECT *, CAST(quality * 8 + similarity * 40 + grade_bonus + category_bonus + dietary_bonus + constraint_bonus
  + violation_penalty + sugar_penalty + calorie_penalty + healthy_bonus + kids_bonus + term_bonus AS DOUBLE) AS score FROM s3)"""


GIVEN_SCORED = o.with_(o.CATALOG, o.PROD, o.QUALITY, o.INSIGHT, _given_sql(), score_sql("pairs"))


def given_pairs(spark, folder):
    """Every product with the given intent of its type."""
    rows = [
        (category, text, [(n, op, v, unit_of(n)) for n, op, v in cons], tags, terms, preferences)
        for category, text, cons, tags, terms, preferences in GIVEN]
    given = spark.createDataFrame(
        rows, f"category string, raw_text string, nutrient_constraints array<{CONSTRAINT_TYPE}>, "
              "dietary_tags array<string>, search_terms array<string>, ranking_preferences array<string>")
    prepared = S.prepare_products(products(spark, folder))
    return prepared.join(F.broadcast(given), F.col("category") == F.get("categories", F.lit(0)))  # six rows


def _scored(name: str, sql: str, *columns) -> None:
    @check(name, GIVEN_SCORED + f"SELECT code, {sql} FROM scored")
    def query(spark, folder):
        return S.score_candidates(given_pairs(spark, folder)).select("code", *[c() for c in columns])


def _part(name: str, part: str) -> None:
    _scored(name, f"round(CAST({part} AS DOUBLE), 6) AS {part}", lambda: rounded(part))


_part("G2_lexical_similarity", "similarity")
_part("G7_grade_bonus", "grade_bonus")
_part("G8_category_bonus", "category_bonus")
_part("G9_dietary_bonus", "dietary_bonus")
_part("G10_constraint_bonus", "constraint_bonus")
_part("G11_violation_penalty", "violation_penalty")
_part("G12_sugar_penalty", "sugar_penalty")
_part("G13_calorie_penalty", "calorie_penalty")
_part("G14_healthy_bonus", "healthy_bonus")
_scored("G17_kids_and_terms", "round(CAST(kids_bonus AS DOUBLE), 6) AS kids_bonus, "
        "round(CAST(term_bonus AS DOUBLE), 6) AS term_bonus", lambda: rounded("kids_bonus"), lambda: rounded("term_bonus"))
_part("G18_score", "score")
_scored("G19_explanations", f"{o.joined('explanations')} AS explanations", lambda: listed("explanations", "explanations"))


def cosine_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


# The nearest rows of every hundredth vector among all others.
NEAREST = f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_vec ORDER BY round(cosine, 9) DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_vec, q.label AS query_label, c.vec_id, {cosine_sql('q.embedding', 'c.embedding')} AS cosine
    FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 10)"""
MOVED = "greatest(0, least(1, (cosine + 1) / 2))"


def nearest_vectors(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = vectors.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    return vectors, nearest(vectors.selectExpr("vec_id AS id", "embedding AS vector"), asked)


@check("G3_vector_similarity", f"WITH {NEAREST} SELECT query_vec, vec_id, rank, round({MOVED}, 6) AS similarity FROM near")
def vector_similarity(spark, folder):
    _, near = nearest_vectors(spark, folder)
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2))
    return near.select(F.col("query_id").alias("query_vec"), F.col("id").alias("vec_id"), whole("rank"), F.round(moved, 6).alias("similarity"))


@check("G4_similarity_choice", f"""WITH {NEAREST} SELECT query_vec, vec_id, CAST(0 AS DOUBLE) AS off,
  CASE WHEN vec_id % 3 = 0 THEN CAST(CASE WHEN query_label = vec_id % 10 THEN 1.0 ELSE 0.333333 END AS DOUBLE)
  ELSE round({MOVED}, 6) END AS similarity FROM near""")
def similarity_choice(spark, folder):
    vectors, near = nearest_vectors(spark, folder)
    asked = vectors.selectExpr("vec_id AS query_id", "embedding AS query_vector", "concat('label ', label) AS text")
    offered = vectors.selectExpr("vec_id AS id", "IF(vec_id % 3 = 0, NULL, embedding) AS product_vector", "array('label', CAST(vec_id % 10 AS STRING)) AS tokens")
    rows = near.join(asked, "query_id").join(offered, "id")
    chosen = S.similarity(F.col("text"), F.col("tokens"), F.col("query_vector"), F.col("product_vector"))
    off = S.similarity(F.col("text"), F.col("tokens"), enabled=False)
    return rows.select(F.col("query_id").alias("query_vec"), F.col("id").alias("vec_id"), off.alias("off"), F.round(chosen, 6).alias("similarity"))


# ---- answers -----------------------------------------------------------------

ANSWERS = f"""{SEARCHES},
{o.INSIGHT},
{search_sql('asked', t.CANDIDATE_ROWS)},
answered AS (SELECT i.*, f.text, f.text AS raw_text, f.category, f.tags, f.terms, f.preferences, f.level, f.candidate_rank,
  CASE f.level WHEN 0 THEN cons0 WHEN 1 THEN cons1 ELSE cons2 END AS cons FROM found f JOIN insight i ON f.code = i.code),
{score_sql('answered')},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, candidate_rank) AS rank
  FROM scored) WHERE rank <= {{rows}})"""


def answers_of(spark, folder, **options):
    log = fixtures.query_log(spark, folder)
    return answer_log(stored_products(spark, folder), log, fixtures.FIXTURE_TAGS, **options)


@check("D6_pool_then_top", o.with_(ANSWERS.replace("{rows}", str(3))) + """
SELECT text, code, rank, candidate_rank FROM ranked""")
def pool_then_top(spark, folder):
    ranked = answers_of(spark, folder, max_results=3).ranked
    return ranked.select("text", "code", whole("rank"), whole("candidate_rank"))


@check("D7_rank_by_score", o.with_(ANSWERS.replace("{rows}", str(t.RESULT_ROWS))) + """
SELECT text, code, rank, round(score, 6) AS score FROM ranked""")
def rank_by_score(spark, folder):
    return answers_of(spark, folder).ranked.select("text", "code", whole("rank"), rounded("score"))


# Vectors for two thirds of the products and four fifths of the texts.
PRODUCT_VECTORS = "SELECT CAST(p_partkey AS VARCHAR(20)) AS code, embedding AS vector FROM part JOIN embeddings ON vec_id = p_partkey % 500 WHERE p_partkey % 3 <> 0"
TEXT_VECTORS = "SELECT DISTINCT text, embedding AS vector FROM query_log JOIN embeddings ON vec_id = length(text) * 7 % 500 WHERE length(text) % 5 <> 0"
BY_WORDS = score_sql("answered").split(" AS similarity")[0].rpartition("s2 AS (SELECT *, ")[2]


@check("F9_answers_with_vectors", o.with_(ANSWERS.replace(score_sql("answered"), f"""text_vectors AS ({TEXT_VECTORS}),
product_vectors AS ({PRODUCT_VECTORS}),
given AS (SELECT a.*, t.vector AS query_vector, p.vector AS product_vector FROM answered a
  LEFT JOIN text_vectors t ON a.text = t.text LEFT JOIN product_vectors p ON a.code = p.code),
""" + score_sql("given").replace(BY_WORDS, f"""CASE WHEN query_vector IS NOT NULL AND product_vector IS NOT NULL
    THEN greatest(0, least(1, ({cosine_sql('query_vector', 'product_vector')} + 1) / 2)) ELSE {BY_WORDS} END""")).replace("{rows}", str(t.RESULT_ROWS))) + """
SELECT text, code, rank, round(score, 6) AS score, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM ranked""")
def answers_with_vectors(spark, folder):
    stored, log = stored_products(spark, folder), fixtures.query_log(spark, folder)
    log.createOrReplaceTempView("query_log")
    spark.read.parquet(f"{folder}/embeddings.parquet").createOrReplaceTempView("embeddings")
    given = Vectors(spark.sql(TEXT_VECTORS), spark.sql(PRODUCT_VECTORS))
    ranked = answer_log(stored, log, fixtures.FIXTURE_TAGS, vectors=given).ranked
    return ranked.select("text", "code", whole("rank"), rounded("score"), rounded("similarity"))


@check("B16_cards", o.with_(ANSWERS.replace("{rows}", str(t.RESULT_ROWS))) + f"""
SELECT text, rank, name AS card_name, brands AS card_brand, '' AS card_image, nutriscore AS card_grade,
  categories[1] AS card_category, explanations[1] AS card_summary,
  'https://ca.catalog.example/product/' || code || '/' || replace(name, ' ', '-') AS card_url, code AS card_barcode,
  {o.joined('explanations')} AS explanations FROM ranked""")
def result_cards(spark, folder):
    shown = cards(answers_of(spark, folder).ranked).drop("score")
    return shown.withColumns({"rank": whole("rank"), "explanations": F.array_join("explanations", "|")})


HAS_TEXT = "(len(terms) > 0 OR len(tags) > 0 OR category IS NOT NULL)"


def _final(expression: str) -> str:
    return expression.replace("cons,", "final_cons,").replace("(cons", "(final_cons")


@check("F9_answer_rows", o.with_(
    SEARCHES, search_sql("asked", t.CANDIDATE_ROWS),
    "summed AS MATERIALIZED (SELECT text, min(level) AS level, count(*) AS candidate_rows FROM found GROUP BY text)",
    """final AS MATERIALIZED (SELECT a.*, s.level, coalesce(s.candidate_rows, 0) AS candidate_rows,
  CASE s.level WHEN 0 THEN cons0 WHEN 1 THEN cons1 ELSE cons2 END AS final_cons FROM asked a LEFT JOIN summed s ON a.text = s.text)""",
) + f"""
SELECT text, CAST(level AS BIGINT) AS level, {o.joined(_final(FILTERS_SQL))} AS filters, {o.bounds_text('final_cons')} AS bounds,
  {o.joined(f'''list_concat(CASE WHEN level = 0 THEN [] ELSE {log_sql('cons0', 'cons1')} END,
    CASE WHEN level <= 1 THEN [] ELSE {log_sql('cons1', 'cons2')} END,
    CASE WHEN level IS NULL AND {HAS_TEXT} THEN [{o.lit(t.PRESERVED_NOTE)}] ELSE [] END)''')} AS log,
  {o.joined(rationale_sql('final_cons'))} AS rationale, candidate_rows,
  least(candidate_rows, {t.RESULT_ROWS}) AS result_rows FROM final""")
def answer_table(spark, folder):
    rows = answers_of(spark, folder).answers
    return rows.select(
        "text", whole("level"), listed("applied_filters", "filters"), bounds_text("final_constraints").alias("bounds"),
        listed("relaxation_log", "log"), listed("rationale", "rationale"), "candidate_rows", "result_rows")


@check("F9_answer_results", o.with_(ANSWERS.replace("{rows}", str(t.RESULT_ROWS))) + f"""
SELECT query_id, rank, code, name, health_class, round(score, 6) AS score, {o.joined('explanations')} AS explanations
FROM query_log JOIN ranked ON query_log.text = ranked.text""")
def answer_results(spark, folder):
    log = fixtures.query_log(spark, folder)
    ranked = answers_of(spark, folder).ranked.select(
        "text", whole("rank"), "code", "name", "health_class", rounded("score"), listed("explanations", "explanations"))
    return for_log(log, ranked).drop("text")


# ---- recommendations -----------------------------------------------------------

POOLS = f"""pools AS (SELECT * FROM (SELECT first.category, q.*, row_number() OVER (PARTITION BY first.category
    ORDER BY {o.order_sql(alias='q.')}) AS pool_rank
  FROM (SELECT DISTINCT categories[1] AS category FROM prod) first
  JOIN quality q ON q.is_listed AND contains(q.category_filter_text, lower(first.category))) WHERE pool_rank <= {{rows}})"""


@check("F7_category_pool", o.with_(o.CATALOG, o.PROD, o.QUALITY, POOLS.replace("{rows}", str(t.CATEGORY_POOL_ROWS))) + """
SELECT category, code, pool_rank FROM pools""")
def category_pool(spark, folder):
    stored = stored_products(spark, folder)
    pools = stored.select(F.get("categories", F.lit(0)).alias("category")).distinct()
    found = category_pools(stored, pools)
    keyed = add_search_key(pools).select("category", "intent_id")
    return keyed.join(found, "intent_id").select("category", "code", whole("candidate_rank", "pool_rank"))


RECOMMENDED = o.with_(
    o.CATALOG, o.PROD, o.QUALITY, o.INSIGHT, POOLS.replace("{rows}", str(t.CATEGORY_POOL_ROWS)),
    f"""recommended AS (SELECT * FROM (SELECT r.code AS ref_code, p.code, p.quality AS quality,
    {improvements_sql('r.', 'p.')} AS improvements,
    row_number() OVER (PARTITION BY r.code ORDER BY p.quality DESC, p.pool_rank) AS rank
  FROM quality r JOIN pools p ON r.categories[1] = p.category AND p.code <> r.code AND p.quality > r.quality * 1.05)
  WHERE rank <= {t.RECOMMENDED_ROWS})""")


def _recommended(name: str, sql: str, *columns) -> None:
    @check(name, RECOMMENDED + f"SELECT x.ref_code, x.code, {sql} FROM recommended x JOIN insight i ON x.code = i.code")
    def query(spark, folder):
        return recommend_all(stored_products(spark, folder)).select("ref_code", "code", *[c() for c in columns])


_recommended("D8_top_recommendations", "rank", lambda: whole("rank"))
_recommended("H7_recommend", f"rank, round(x.quality, 6) AS quality, {o.joined('improvements')} AS improvements, health_class",
             lambda: whole("rank"), lambda: rounded("quality"), lambda: listed("improvements", "improvements"),
             lambda: F.col("health_class"))


def mentions_sql(words: str, text: str = "combined_text") -> str:
    return f"len(list_filter({words}, lambda w: NOT contains(lower({text}), w))) = 0"


@check("C15_reference_product", o.with_(o.CATALOG, o.PROD, f"""targets AS (
SELECT DISTINCT p_name || ' ' || p_brand AS target, regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+') AS words
FROM part)""") + f"""
SELECT target, code FROM (SELECT target, code, row_number() OVER (PARTITION BY target ORDER BY {o.order_sql()}) AS place
  FROM targets JOIN prod ON {mentions_sql('words')}) WHERE place = 1""")
def reference_product(spark, folder):
    stored = stored_products(spark, folder)
    targets = spark.read.parquet(f"{folder}/part.parquet").select(
        F.concat_ws(" ", "p_name", "p_brand").alias("target")).distinct()
    return reference_products(stored, targets).select("target", "code")


@check("F8_compare", o.with_(
    o.CATALOG, o.PROD, o.QUALITY, o.PARSED, POOLS.replace("{rows}", str(t.CATEGORY_POOL_ROWS)),
    f"""refs AS (SELECT * FROM (SELECT a.text, q.*, row_number() OVER (PARTITION BY a.text ORDER BY {o.order_sql(alias='q.')}) AS place
  FROM (SELECT text, regexp_extract_all(lower(comparison), '[a-z0-9]+') AS words FROM parsed WHERE comparison <> '') a
  JOIN quality q ON {mentions_sql('words', 'q.combined_text')}) WHERE place = 1)""") + f"""
SELECT text, ref_code, code, rank, {o.joined('improvements')} AS improvements FROM (
  SELECT r.text, r.code AS ref_code, p.code, {improvements_sql('r.', 'p.')} AS improvements,
    row_number() OVER (PARTITION BY r.text ORDER BY p.quality DESC, p.pool_rank) AS rank
  FROM refs r JOIN pools p ON r.categories[1] = p.category AND p.code <> r.code AND p.quality > r.quality * 1.05)
WHERE rank <= {t.RECOMMENDED_ROWS}""")
def compare(spark, folder):
    read = read_queries(fixtures.query_log(spark, folder), fixtures.FIXTURE_TAGS)
    return compare_queries(stored_products(spark, folder), read).select(
        "text", "ref_code", "code", whole("rank"), listed("improvements", "improvements"))


# ---- the whole log: both branches, missing texts, translations ------------------

# French phrases with one of two translations, with an empty one, or without; and rows without a text.
ENGLISH = """CASE WHEN text LIKE 'collations%' AND query_id % 3 = 0 THEN 'vegan snacks'
  WHEN text LIKE 'collations%' AND query_id % 3 = 1 THEN 'healthier alternative to red ring' WHEN text LIKE 'biscuits%' THEN '' END"""
WHOLE_LOG = f"""SELECT query_id, text, {ENGLISH} AS english FROM query_log
UNION ALL SELECT -1000 AS query_id, CAST(NULL AS VARCHAR(10)) AS text, CAST(NULL AS VARCHAR(10)) AS english
UNION ALL SELECT -1001 AS query_id, CAST(NULL AS VARCHAR(10)) AS text, 'cookies' AS english"""
READINGS = f"""{o.PHRASES},
query_log AS ({fixtures.QUERY_LOG_SQL} UNION ALL SELECT query_id, text FROM phrases),
log AS ({WHOLE_LOG}),
texts AS (SELECT DISTINCT text, english FROM log),
rule_texts AS MATERIALIZED (SELECT *, {o.normalized_sql("coalesce(text, '')", 'language')} AS normalized
  FROM (SELECT *, coalesce({o.LANGUAGE}, 'en') AS language FROM texts)),
first_texts AS MATERIALIZED (SELECT text, english, language, CASE WHEN language = 'fr' AND coalesce(english, '') <> ''
  THEN {o.normalized_sql('english', "'en'")} ELSE normalized END AS normalized FROM rule_texts)"""
# Both readings of a text united: gaps filled, lists joined, strictest bounds.
UNITED = f"""united AS (SELECT a.text, a.english, a.excluded, coalesce(a.category, b.category) AS category,
  coalesce(nullif(a.comparison, ''), b.comparison) AS comparison, list_concat(a.tags, b.tags) AS all_tags,
  list_concat(a.preferences, b.preferences) AS all_preferences, list_concat(a.terms, b.terms) AS all_terms, list_concat(a.cons, b.cons) AS all_cons
  FROM a_parsed a JOIN b_parsed b ON a.text IS NOT DISTINCT FROM b.text AND a.english IS NOT DISTINCT FROM b.english),
parsed AS MATERIALIZED (SELECT text, english, excluded, category, comparison,
  list_filter({o.first_seen('all_tags')}, lambda x: x <> 'vegetarian' OR NOT list_contains(all_tags, 'vegan')) AS tags,
  {o.first_seen('all_preferences')} AS preferences, {o.first_seen('all_terms')} AS terms, {o.strictest_sql('all_cons')} AS cons FROM united)"""
READ = o.with_(
    o.CATALOG, o.PROD, o.QUALITY, READINGS, o.parse_ctes('first_texts', 'a_'), o.parse_ctes('rule_texts', 'b_'), UNITED, LEVELS,
    f"asked AS MATERIALIZED (SELECT *, {tag_sql(fixtures.FIXTURE_TAGS)} AS wanted FROM levels WHERE coalesce(comparison, '') = '')",
    search_sql("asked", t.CANDIDATE_ROWS, key="text, english"), POOLS.replace("{rows}", str(t.CATEGORY_POOL_ROWS)),
    f"""refs AS (SELECT * FROM (SELECT a.text, a.english, q.*, row_number() OVER (PARTITION BY a.text, a.english ORDER BY {o.order_sql(alias='q.')}) AS place
  FROM (SELECT text, english, regexp_extract_all(lower(comparison), '[a-z0-9]+') AS words FROM parsed WHERE comparison <> '') a
  JOIN quality q ON {mentions_sql('words', 'q.combined_text')}) WHERE place = 1)""",
    f"""rows AS (SELECT a.text, a.english, 'search' AS branch, least(coalesce(n, 0), {t.RESULT_ROWS}) AS result_rows FROM asked a
  LEFT JOIN (SELECT text, english, count(*) AS n FROM found GROUP BY text, english) f ON a.text IS NOT DISTINCT FROM f.text AND a.english IS NOT DISTINCT FROM f.english
UNION ALL SELECT a.text, a.english, 'compare', least(coalesce(n, 0), {t.RECOMMENDED_ROWS}) FROM parsed a
  LEFT JOIN (SELECT r.text, r.english, count(*) AS n FROM refs r JOIN pools p ON r.categories[1] = p.category AND p.code <> r.code AND p.quality > r.quality * 1.05
    GROUP BY r.text, r.english) f ON a.text IS NOT DISTINCT FROM f.text AND a.english IS NOT DISTINCT FROM f.english WHERE a.comparison <> '')""")


@check("F9_whole_log", READ + """
SELECT query_id, branch, result_rows FROM log JOIN rows ON log.text IS NOT DISTINCT FROM rows.text AND log.english IS NOT DISTINCT FROM rows.english""")
def whole_log(spark, folder):
    stored = stored_products(spark, folder)
    fixtures.query_log(spark, folder).createOrReplaceTempView("query_log")
    log = spark.sql(WHOLE_LOG)
    whole = answer_whole_log(stored, log, fixtures.FIXTURE_TAGS, translation="english")
    return for_log(log, whole.rows, "english").select("query_id", "branch", F.col("result_rows").cast("long").alias("result_rows"))


# Ready-made intents of both branches: every product's name is asked for by its words or compared with.
@check("F3_ready_made_both", o.with_(
    o.CATALOG, o.PROD, o.QUALITY, POOLS.replace("{rows}", str(t.CATEGORY_POOL_ROWS)), f"""names AS (SELECT DISTINCT p_name AS text FROM part),
asked AS (SELECT text, CAST(NULL AS VARCHAR) AS wanted, [split_part(text, ' ', 1), split_part(text, ' ', 2)] AS terms, {NO_LIST} AS tags, {NO_LIST} AS excluded,
  {NO_LIST} AS preferences, {NO_CONS} AS cons0 FROM names WHERE length(text) % 2 = 0)""", search_sql("asked", t.CANDIDATE_ROWS, relaxed=False),
    f"""refs AS (SELECT * FROM (SELECT a.text, q.*, row_number() OVER (PARTITION BY a.text ORDER BY {o.order_sql(alias='q.')}) AS place
  FROM (SELECT text, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM names WHERE length(text) % 2 = 1) a
  JOIN quality q ON {mentions_sql('words', 'q.combined_text')}) WHERE place = 1)""") + f"""
SELECT a.text, 'search' AS branch, least(count(code), {t.RESULT_ROWS}) AS result_rows FROM asked a LEFT JOIN found ON a.text = found.text GROUP BY a.text
UNION ALL SELECT n.text, 'compare', least(count(p.code), {t.RECOMMENDED_ROWS}) FROM names n LEFT JOIN refs r ON n.text = r.text
  LEFT JOIN pools p ON r.categories[1] = p.category AND p.code <> r.code AND p.quality > r.quality * 1.05 WHERE length(n.text) % 2 = 1 GROUP BY n.text""")
def ready_made_both(spark, folder):
    names = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_name").alias("text")).distinct()
    compares = F.length("text") % 2 == 1
    asked = names.select("text", F.when(compares, F.col("text")).alias("comparison_product"),
                         F.when(~compares, F.slice(F.split("text", " "), 1, 2)).alias("search_terms"))
    whole = answer_read(stored_products(spark, folder), asked)
    return whole.rows.select("text", "branch", F.col("result_rows").cast("long").alias("result_rows"))
