"""Product catalog and query log derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.plans.joins import evenly

# Phrases in both languages that must mean the same, and parser edge cases.
PHRASES = [
    "high protein vegan snacks under 300 calories",
    "collations veganes riches en proteines sous 300 calories",
    "low sodium cereal", "cereales faibles en sodium",
    "gluten free cookies", "biscuits sans gluten",
    "organic yogurt", "yogourt biologique",
    "low sugar snacks", "collations faibles en sucre",
    "high fibre cereal", "cereales riches en fibres",
    "vegan snacks", "collations vegetaliennes",
    "low fat snacks", "collations faibles en gras",
    "cereal without palm oil", "cereales sans huile de palme",
    "vegetarian pasta under 400 calories", "pates vegetariennes sous 400 calories",
    "dairy free chocolate", "chocolat sans lait",
    "snack bars suitable for a low sodium diet",
    "barres de collation adaptes a un regime pauvre en sodium",
    "snack under 200 calories", "cereal with over 10g protein", "maximum 0.5g sodium per 100g",
    "over 15g protein high protein bar", "healthier alternative to red ring", "instead of peanut butter",
    "healthier alternative to large anvil brand 9", "instead of hot gear brand 3.", "replace small gizmo",
    "replace blue bolt with something better, please", "zero sugar drink",
    "low sugar snacks with no added sugar", "give a snack which has no palm oil", "0 sugar choclates",
    "snacks avec au moins 7g de proteines", "moins de 390 calories et au moins 7g de proteines",
    "protein 12 g or more and sugar 5 g or less", "under 200 mg sodium crackers", "10g protein 300 calories",
    "vegan vegetarian plant-based olive oil", "healthiest kid-friendly ready meals under 10 sugar",
    "vegan snacks under 5 calories", "cereals under 10 calories over 24g protein", "cookies with over 26g protein",
    "low sugar gluten free yogurt over 11g fiber", "kosher under 1 calories", "organic red", "low fat brand",
    "red widget for kids", "  Healthy   Organic CEREALS,  low saturated fat ", "over 300 calories", "",
]

CATALOG_SQL = """
WITH scans AS (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT CAST(p_partkey AS VARCHAR(20)) AS code, p_name AS product_name, p_brand AS brands,
  lower(p_type) || ', goods' AS categories, 'en:' || lower(p_type) AS categories_tags,
  CASE p_partkey % 5 WHEN 0 THEN 'Vegan, Organic' WHEN 1 THEN 'Gluten free' WHEN 2 THEN 'Kosher, vegetarian'
    WHEN 3 THEN '' ELSE NULL END AS labels,
  replace(p_name, ' ', ', ') AS ingredients_text,
  CASE WHEN p_partkey % 3 = 0 THEN 'en:france' ELSE 'en:canada' END AS countries_tags,
  CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' WHEN 4 THEN 'e'
    ELSE 'unknown' END AS nutriscore_grade,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS nova_group,
  CAST(p_partkey % 12 AS INT) AS additives_n,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS proteins_100g,
  CAST(p_partkey * 13 % 500 AS DOUBLE) / 10 AS sugars_100g,
  CAST(p_partkey * 37 % 700 AS DOUBLE) AS energy_kcal_100g,
  CAST(p_partkey * 7 % 400 AS DOUBLE) / 10 AS fat_100g,
  CAST(p_partkey * 5 % 150 AS DOUBLE) / 10 AS saturated_fat_100g,
  CAST(p_partkey * 11 % 200 AS DOUBLE) / 100 AS sodium_100g,
  CAST(p_partkey * 3 % 120 AS DOUBLE) / 10 AS fiber_100g,
  COALESCE(n, 0) AS unique_scans_n
FROM part LEFT JOIN scans ON l_partkey = p_partkey
"""

QUERY_LOG_SQL = """
SELECT event_id AS query_id, CASE event_type
 WHEN 'click' THEN 'high protein vegan snacks under ' || CAST(100 + event_id % 400 AS VARCHAR(10)) || ' calories'
 WHEN 'view' THEN 'collations veganes riches en proteines avec moins de '
   || CAST(100 + event_id % 400 AS VARCHAR(10)) || ' calories'
 WHEN 'purchase' THEN 'gluten free cookies with no palm oil'
 WHEN 'signup' THEN 'healthier alternative to red ring'
 ELSE 'céréales faibles en sucre pour enfants' END AS text
FROM events
"""

# Sends the parsed food categories to the six product types of the test tables.
FIXTURE_TAGS = {"snacks": "en:economy", "cookies": "en:small", "cereals": "en:medium", "dairy": "en:promo"}


def _views(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Products, one per part.

    The parts are few bytes, so a file of them is read by a task or two: they are dealt out before the work on their texts.
    """
    _views(spark, folder, "part", "lineitem")
    evenly(spark.table("part"), "p_partkey").createOrReplaceTempView("dealt_part")
    return spark.sql(CATALOG_SQL.replace("FROM part ", "FROM dealt_part "))


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, text) for i, text in enumerate(PHRASES)], "query_id bigint, text string")


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """Search phrases, one per event, and the fixed phrases with negative ids."""
    _views(spark, folder, "events")
    return spark.sql(QUERY_LOG_SQL).unionByName(phrases(spark))
