"""Checks on the catalog: sources, normalisation, predicates, order, quality, insights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import oracle as o
from checks.registry import check, listed, products, rounded, whole
from larder import tables as t
from larder.functions import values as V
from larder.operators import ordering, predicates as P
from larder.operators.insights import add_insights
from larder.operators.predicates import Bound, Query, search_one
from larder.operators.quality import add_quality
from larder.operators.recommend import improvements
from larder.operators.scoring import product_text
from larder.plans.places import add_places
from larder.plans.recommend import COMPARED
from larder.session import cut_lineage
from larder.sources import curate as C
from larder.sources import fixtures
from larder.sources.schema import search_projection

CAT = o.with_(o.CATALOG)
PROD = o.with_(o.CATALOG, o.PROD)
INSIGHT = o.with_(o.CATALOG, o.PROD, o.QUALITY, o.INSIGHT)
NUMBERS = ["proteins_100g", "sugars_100g", "energy_kcal_100g", "fat_100g", "saturated_fat_100g", "sodium_100g",
           "fiber_100g"]


def catalog(spark, folder):
    return fixtures.catalog(spark, folder)


# ---- A: sources and curation ----------------------------------------------


@check("A1_scan", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def scan(spark, folder):
    C.read_products(spark, f"{folder}/part.parquet", "products")
    return spark.sql("SELECT p_partkey, p_name, p_brand, p_type FROM products")


@check("A2_resolve_field", CAT + """
SELECT code, product_name, labels, CAST(NULL AS VARCHAR) AS image_url, unique_scans_n FROM catalog""")
def resolve_field(spark, folder):
    renamed = catalog(spark, folder).selectExpr(
        "code AS id", "product_name AS product_name_fr", "labels AS labels_tags", "unique_scans_n")
    return search_projection(renamed).select("code", "product_name", "labels", "image_url", "unique_scans_n")


@check("A3_nutrient_prefers_struct", CAT + """
SELECT code, proteins_100g, energy_kcal_100g, saturated_fat_100g, fiber_100g FROM catalog""")
def nutrient_prefers_struct(spark, folder):
    mixed = catalog(spark, folder).selectExpr(
        "code", "named_struct('proteins_100g', proteins_100g, 'fiber_100g', fiber_100g) AS nutriments",
        "-1.0D AS proteins_100g", "energy_kcal_100g AS `energy-kcal_100g`",
        "saturated_fat_100g AS `saturated-fat_100g`", "-1.0D AS fibre_100g")
    return search_projection(mixed).select(
        "code", "proteins_100g", "energy_kcal_100g", "saturated_fat_100g", "fiber_100g")


@check("A4_nutrient_prefers_flat", CAT + """
SELECT code, proteins_100g, energy_kcal_100g, fiber_100g, sodium_100g FROM catalog""")
def nutrient_prefers_flat(spark, folder):
    mixed = catalog(spark, folder).selectExpr(
        "code", "proteins_100g", "energy_kcal_100g AS `energy-kcal_100g`", "fiber_100g AS fibre_100g",
        "named_struct('proteins_100g', -1.0D, 'sodium_100g', sodium_100g) AS nutriments")
    return C.lean_projection(mixed).select(
        "code", "proteins_100g", "energy_kcal_100g", "fiber_100g", "sodium_100g")


@check("A5_nutrient_from_list", CAT + """
SELECT code, greatest(proteins_100g, sodium_100g) AS proteins_100g, energy_kcal_100g, sodium_100g,
  CAST(NULL AS DOUBLE) AS fat_100g FROM catalog""")
def nutrient_from_list(spark, folder):
    entry = "named_struct('name', '{0}', '100g', {1}, 'value', {2})"
    entries = ", ".join([
        entry.format("Proteins", "CAST(proteins_100g AS STRING)", "'-5'"),
        entry.format("protein", "CAST(IF(proteins_100g IS NULL, NULL, sodium_100g) AS STRING)",
                     "CAST(sodium_100g AS STRING)"),
        entry.format("energy-kcal", "'n/a'", "CAST(energy_kcal_100g AS STRING)"),
        entry.format("sodium", "CAST(sodium_100g AS STRING)", "CAST(NULL AS STRING)"),
    ]).replace("'-5'", "CAST(proteins_100g - 1 AS STRING)")
    raw = catalog(spark, folder).selectExpr("code", f"array({entries}) AS nutriments")
    return C.lean_projection(raw).select("code", "proteins_100g", "energy_kcal_100g", "sodium_100g", "fat_100g")


LEAN_SQL = ", ".join(
    c if c in ("code", "product_name", "brands", "categories", "categories_tags", "labels", "ingredients_text",
               "nutriscore_grade", "countries_tags", *NUMBERS)
    else f"labels AS {c}" if c == "labels_tags"
    else f"CAST({c} AS BIGINT) AS {c}" if c in ("nova_group", "additives_n", "unique_scans_n")
    else f"CAST(NULL AS {'DOUBLE' if c in t.NUTRIENTS else 'VARCHAR'}) AS {c}"
    for c in t.LEAN_COLUMNS)


def lean(df):
    """Lean columns in comparable types."""
    return df.select(*[
        whole(c) if c in ("nova_group", "additives_n", "unique_scans_n")
        else F.array_join(c, ", ").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c)
        for c in t.LEAN_COLUMNS])


@check("A6_curate", CAT + f"""
SELECT {LEAN_SQL} FROM catalog WHERE countries_tags ILIKE '%en:canada%' ORDER BY code LIMIT 1000""")
def curate(spark, folder):
    return lean(C.curate(catalog(spark, folder), limit=1000))


@check("A6_curate_all", CAT + f"""
SELECT {LEAN_SQL} FROM catalog WHERE countries_tags ILIKE '%en:canada%'""")
def curate_all(spark, folder):
    return lean(C.curate(catalog(spark, folder)))


@check("A7_lean_projection", CAT + f"SELECT {LEAN_SQL} FROM catalog")
def lean_projection(spark, folder):
    return lean(C.lean_projection(catalog(spark, folder)))


@check("A8_country_record", CAT + """
SELECT code, CAST(countries_tags = 'en:canada' AS BIGINT) AS in_list,
  CAST(CAST(code AS BIGINT) % 4 = 0 OR countries_tags = 'en:canada' AS BIGINT) AS in_text FROM catalog""")
def country_record(spark, folder):
    df = catalog(spark, folder).selectExpr(
        "code", "array(upper(countries_tags), 'en:canada-east') AS tag_list",
        "IF(CAST(code AS BIGINT) % 4 = 0, 'Made in CANADA', countries_tags) AS tag_text")
    test = lambda c: C.is_country_record(F.col(c), df.schema[c].dataType)
    return df.select("code", whole(test("tag_list"), "in_list"), whole(test("tag_text"), "in_text"))


@check("A9_parquet_sink", CAT + """
SELECT code, product_name, countries_tags, energy_kcal_100g FROM catalog""")
def parquet_sink(spark, folder):
    path = sink_folder(spark)
    kept = C.lean_projection(catalog(spark, folder)).select(
        "code", "product_name", "countries_tags", "energy_kcal_100g")
    C.write_products(kept, path, mode="overwrite", partition_by="countries_tags")
    return C.read_products(spark, path, view=None).select(
        "code", "product_name", "countries_tags", "energy_kcal_100g")


def sink_folder(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    import uuid

    cut_lineage(spark.range(1))  # makes sure the folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4().hex}"


@check("A10_table_health", CAT + "SELECT count(*) AS row_count FROM catalog")
def table_health(spark, folder):
    return C.table_health(catalog(spark, folder))


# ---- B: normalisation ------------------------------------------------------


@check("B1_search_projection", CAT + f"""
SELECT code, product_name, brands, categories, labels, ingredients_text, nutriscore_grade,
  CAST(nova_group AS BIGINT) AS nova_group, CAST(NULL AS VARCHAR) AS ecoscore_grade, CAST(NULL AS VARCHAR) AS image_url,
  CAST(NULL AS VARCHAR) AS url, CAST(additives_n AS BIGINT) AS additives_n, unique_scans_n, {', '.join(NUMBERS)},
  CAST(NULL AS DOUBLE) AS carbohydrates_100g, CAST(NULL AS DOUBLE) AS salt_100g FROM catalog""")
def search_columns(spark, folder):
    df = search_projection(catalog(spark, folder)).drop("images", "ingredients_tags", "additives_tags")
    return df.select(*[whole(c) if c in ("nova_group", "additives_n") else F.col(c) for c in df.columns])


@check("B2_list_value", CAT + f"""
SELECT code, {o.joined(o.comma_list('labels'))} AS from_text, replace(ingredients_text, ', ', '|') AS from_array,
  brands || '|' || product_name AS from_written FROM catalog""")
def list_value(spark, folder):
    df = catalog(spark, folder).selectExpr(
        "code", "concat('  ', labels, ' ,, ') AS as_text",
        "array('en:' || split(product_name, ' ')[0], NULL, 'fr:' || split(product_name, ' ')[1]) AS as_array",
        "concat('[\\'en:', brands, '\\', \"', product_name, '\"]') AS as_written")
    value = lambda c: V.list_value(F.col(c), df.schema[c].dataType)
    return df.select("code", listed(value("as_text"), "from_text"), listed(value("as_array"), "from_array"),
                     listed(value("as_written"), "from_written"))


@check("B3_text_value", CAT + """
SELECT code, product_name AS from_text, product_name AS from_entries, brands AS from_struct,
  product_name AS from_written, brands AS from_written_dict FROM catalog""")
def text_value(spark, folder):
    df = catalog(spark, folder).selectExpr(
        "code", "concat(' ', product_name, '\\t') AS as_text",
        "array(named_struct('lang', 'main', 'text', 'autre'), NULL, named_struct('lang', 'fr', 'text', 'nom'), "
        "named_struct('lang', 'en', 'text', product_name || ' ')) AS as_entries",
        "named_struct('lang', CAST(NULL AS STRING), 'text', ' ', 'other', brands) AS as_struct",
        "concat('[{\\'lang\\': \\'fr\\', \\'text\\': \\'nom\\'}, {\\'lang\\': \\'en\\', \\'text\\': \\'', product_name, "
        "'\\'}]') AS as_written",
        "concat('{\\'lang\\': None, \\'text\\': \\'', brands, '\\'}') AS as_written_dict")
    value = lambda c: V.text_value(F.col(c), df.schema[c].dataType)
    return df.select("code", *[value(f"as_{n}").alias(f"from_{n}") for n in (
        "text", "entries", "struct", "written", "written_dict")])


# Escapes, an apostrophe, texts side by side, a list in a tuple, a last comma; and texts that are no literal.
ESCAPED = {
    "escaped": r"""concat('[{\'lang\': \'en\', \'text\': \'L\\\'huile ', product_name, ' \\x41\\u00e9\'}, ]')""",
    "beside": r"""concat('[None, {"lang": \'fr\', "text": "nom"}, {\'lang\': "main", \'text\': "', brands, '" \' end\'}]')""",
    "plain": r"""concat('[None, 12, True, \'', brands, ', x\']')""",
    "broken": r"""concat('[{\'text\': \'', brands, '\']')""",
    "bare": r"""concat('[', brands, ']')""",
}


@check("B3_escaped_literals", CAT + """
SELECT code, 'L\'\'huile ' || product_name || ' Aé' AS escaped, brands || ' end' AS beside, brands || ', x' AS plain,
  '[{\'\'text\'\': \'\'' || brands || '\'\']' AS broken, '[' || brands || ']' AS bare FROM catalog""")
def escaped_literals(spark, folder):
    df = catalog(spark, folder).selectExpr("code", *[f"{sql} AS {name}" for name, sql in ESCAPED.items()])
    return df.select("code", *[V.text_value(F.col(n), T.StringType()).alias(n) for n in ESCAPED])


@check("B4_grade_value", PROD + "SELECT code, nutriscore FROM prod")
def grade_value(spark, folder):
    df = catalog(spark, folder)
    return df.select("code", V.grade_value(F.concat(F.lit(" "), "nutriscore_grade"), T.StringType()).alias("nutriscore"))


@check("B5_nutrient_map", CAT + """
SELECT code, coalesce('energy-kcal_100g=' || CAST(CAST(energy_kcal_100g AS BIGINT) AS VARCHAR)
  || '|energy_kcal_100g=' || CAST(CAST(energy_kcal_100g AS BIGINT) AS VARCHAR)
  || '|fiber_100g=' || CAST(CAST(floor(fiber_100g) AS BIGINT) AS VARCHAR)
  || '|fibre_100g=' || CAST(CAST(floor(fiber_100g) AS BIGINT) AS VARCHAR), '') AS nutrients FROM catalog""")
def nutrient_map(spark, folder):
    df = catalog(spark, folder).selectExpr(
        "code", "map('energy-kcal_100g', CAST(energy_kcal_100g AS STRING), 'fibre_100g', "
                "CAST(floor(fiber_100g) AS STRING), 'salt_100g', 'n/a', 'sodium_100g', CAST(NULL AS STRING)) AS raw")
    entries = F.transform(
        F.array_sort(F.map_entries(V.nutrient_map(F.col("raw")))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string")))
    return df.select("code", listed(entries, "nutrients"))


@check("B6_nutrient_lookup", CAT + """
SELECT code, fiber_100g AS fiber, energy_kcal_100g AS energy, CAST(NULL AS DOUBLE) AS salt FROM catalog""")
def nutrient_lookup(spark, folder):
    raw = F.create_map(F.lit("fibre_100g"), F.col("fiber_100g"), F.lit("energy-kcal_100g"), F.col("energy_kcal_100g"))
    return catalog(spark, folder).select("code", *[
        V.nutrient_amount(raw, F.lit(n)).alias(a)
        for a, n in (("fiber", "fiber_100g"), ("energy", "energy_kcal_100g"), ("salt", "salt_100g"))])


@check("B7_nova_group", CAT + """
SELECT code, CASE WHEN CAST(code AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(nova_group AS BIGINT) END AS nova_group
FROM catalog""")
def nova_group(spark, folder):
    raw = catalog(spark, folder).selectExpr(
        "code", "product_name", "IF(CAST(code AS BIGINT) % 3 = 0, 'not known', CAST(nova_group AS STRING)) AS nova_group")
    from larder.operators.normalize import normalize_products

    return normalize_products(raw).select("code", whole("nova_group"))


@check("B8_additives", CAT + """
SELECT code, 'E' || (100 + CAST(code AS BIGINT) % 900) || '|E621' AS additives,
  CASE WHEN additives_n = 0 THEN 2 ELSE CAST(additives_n AS BIGINT) END AS additives_count FROM catalog""")
def additives(spark, folder):
    from larder.operators.normalize import normalize_products

    raw = catalog(spark, folder).selectExpr(
        "code", "product_name", "additives_n",
        "array('en:e' || CAST(100 + CAST(code AS BIGINT) % 900 AS STRING), NULL, 'EN:E621') AS additives_tags")
    return normalize_products(raw).select("code", listed("additives", "additives"), whole("additives_count"))


SLUG_SQL = ("array_to_string(regexp_extract_all(lower(strip_accents('Crème ' || product_name || ' & ' || brands)), "
            "'[a-z0-9]+')[1:16], '-')")


def accented_name():
    return F.concat(F.lit("Crème "), "product_name", F.lit(" & "), "brands")


@check("B9_slug", CAT + f"SELECT code, {SLUG_SQL} AS slug FROM catalog")
def slug(spark, folder):
    return catalog(spark, folder).select("code", V.slug(accented_name()).alias("slug"))


@check("B10_page_url", CAT + f"""
SELECT code, 'https://ca.catalog.example/product/' || code || '/' || {SLUG_SQL} AS named,
  'https://ca.catalog.example/product/' || code AS bare, '' AS nothing FROM catalog""")
def page_url(spark, folder):
    site = V.Site()
    return catalog(spark, folder).select(
        "code", V.page_url(F.col("code"), accented_name(), site).alias("named"),
        V.page_url(F.col("code"), F.lit("!!"), site).alias("bare"),
        V.page_url(F.lit(""), F.col("product_name"), site).alias("nothing"))


@check("B11_product_url", CAT + """
SELECT code, CASE CAST(code AS BIGINT) % 4
  WHEN 0 THEN 'https://ca.catalog.example/p/' || code || '?lang=fr#top'
  WHEN 1 THEN 'https://ca.catalog.example/product/' || code
  ELSE 'https://ca.catalog.example/product/' || code || '/' || replace(product_name, ' ', '-') END AS url
FROM catalog""")
def product_url(spark, folder):
    raw = catalog(spark, folder).withColumn("raw", F.expr(
        "CASE CAST(code AS BIGINT) % 4 WHEN 0 THEN 'http://world.catalog.example/p/' || code || '?lang=fr#top' "
        "WHEN 1 THEN 'https://catalog.example' WHEN 2 THEN 'https://shop.other.example/x y/' || code ELSE '' END"))
    return raw.select("code", V.product_url(F.col("raw"), F.col("code"), F.col("product_name"), V.Site()).alias("url"))


def _path_sql(width: int) -> str:
    text = f"lpad(code, {width}, '0')"
    cuts = list(range(0, width, 3))
    while width - cuts[-1] < 2:
        cuts.pop()
    parts = [f"{text}[{a + 1}:{b}]" for a, b in zip(cuts, cuts[1:] + [width])]
    return " || '/' || ".join(parts)


@check("B12_barcode_path", CAT + f"""
SELECT code, lpad(code, 8, '0') AS short, {_path_sql(9)} AS nine, {_path_sql(11)} AS eleven,
  {_path_sql(12)} AS twelve, {_path_sql(13)} AS thirteen, 'x' || code AS other FROM catalog""")
def barcode_path(spark, folder):
    padded = lambda n: V.barcode_path(F.lpad("code", n, "0"))
    return catalog(spark, folder).select(
        "code", padded(8).alias("short"), padded(9).alias("nine"), padded(11).alias("eleven"),
        padded(12).alias("twelve"), padded(13).alias("thirteen"),
        V.barcode_path(F.concat(F.lit("x"), "code")).alias("other"))


@check("B13_image_url", CAT + f"""
SELECT code, CASE WHEN CAST(code AS BIGINT) % 3 = 0 THEN 'https://pictures.example/' || code
  ELSE 'https://images.catalog.example/images/products/' || {_path_sql(13)} || '/front_fr.4.400.jpg' END AS from_list,
  'https://images.catalog.example/images/products/' || {_path_sql(13)} || '/front.200.jpg' AS from_written
FROM catalog""")
def image_url(spark, folder):
    df = catalog(spark, folder).select(
        "code", F.lpad("code", 13, "0").alias("barcode"),
        F.when(F.col("code").cast("bigint") % 3 == 0, F.concat(F.lit("https://pictures.example/"), "code")).alias("direct"),
        F.expr("array(named_struct('key', '1', 'rev', 1, 'sizes', map('100', 1)), "
               "named_struct('key', 'front_fr', 'rev', 4, 'sizes', map('100', 1, '400', 2)))").alias("images"),
        F.lit("[{'key': 'front', 'rev': None, 'sizes': {'100': {'h': 1}, '200': {'h': 2}}}]").alias("written"))
    written = F.col("written")
    return df.select(
        "code",
        V.image_url(F.col("direct"), F.col("images"), df.schema["images"].dataType, F.col("barcode"), V.Site())
        .alias("from_list"),
        V.image_url(F.lit(None).cast("string"), written, T.StringType(), F.col("barcode"), V.Site()).alias("from_written"))


@check("B14_normalize", PROD + f"""
SELECT code, name, brands, {o.joined('categories')} AS categories, {o.joined('labels')} AS labels, ingredients_text,
  nutriscore, CAST(nova_group AS BIGINT) AS nova_group, CAST(additives_count AS BIGINT) AS additives_count,
  {', '.join(NUMBERS)}, CAST(NULL AS DOUBLE) AS salt_100g, unique_scans_n, '' AS image_url,
  'https://ca.catalog.example/product/' || code || '/' || replace(name, ' ', '-') AS product_url FROM prod""")
def normalize(spark, folder):
    return products(spark, folder).select(
        "code", "name", "brands", listed("categories", "categories"), listed("labels", "labels"), "ingredients_text",
        "nutriscore", whole("nova_group"), whole("additives_count"), *NUMBERS, "salt_100g", "unique_scans_n",
        "image_url", "product_url")


@check("B15_filter_texts", PROD + """
SELECT code, combined_text, label_text, ingredient_filter_text, category_filter_text FROM prod""")
def filter_texts(spark, folder):
    return products(spark, folder).select(
        "code", "combined_text", "label_text", "ingredient_filter_text", "category_filter_text")


# ---- C: predicates ---------------------------------------------------------


def _filter(name: str, condition: str, predicate) -> None:
    @check(name, PROD + f"SELECT code FROM prod WHERE {condition}")
    def query(spark, folder):
        return products(spark, folder).filter(predicate()).select("code")


_filter("C3_category_tag", "contains(category_filter_text, 'en:s')", lambda: P.in_category("EN:s"))
_filter("C4_category_word", "contains(category_filter_text, 'economy')", lambda: P.in_category("economy"))
_filter("C5_dietary", "(label_text ILIKE '%vegan%' OR label_text ILIKE '%plant-based%') AND "
        "(label_text ILIKE '%organic%' OR label_text ILIKE '%bio%')",
        lambda: P.has_dietary_label("vegan") & P.has_dietary_label("organic"))
_filter("C6_nutrient_bound", "proteins_100g >= 12 AND sodium_100g < 1.25",
        lambda: P.nutrient_bound(Bound("proteins_100g", ">=", 12)) & P.nutrient_bound(Bound("sodium_100g", "<", 1.25)))
_filter("C7_calorie_guard", "energy_kcal_100g <= 350 AND energy_kcal_100g > 0",
        lambda: P.nutrient_bound(Bound("energy_kcal_100g", "<=", 350)))
_filter("C8_allow_missing", "proteins_100g >= 12 OR proteins_100g IS NULL",
        lambda: P.nutrient_bound(Bound("proteins_100g", ">=", 12), allow_missing=True))
_filter("C9_exclusion", "NOT contains(ingredient_filter_text, 'anvil') AND NOT contains(ingredient_filter_text, 'red, r')",
        lambda: P.without_ingredient("Anvil") & P.without_ingredient("red, r"))
_filter("C10_keywords", "contains(lower(combined_text), 'red') AND contains(lower(combined_text), 'brand#1')",
        lambda: P.mentions("red") & P.mentions("brand#1"))


@check("C1_name_present", CAT + "SELECT code FROM catalog WHERE CAST(code AS BIGINT) % 3 = 1")
def name_present(spark, folder):
    from larder.operators.normalize import normalize_products

    blanked = catalog(spark, folder).withColumn("product_name", F.expr(
        "CASE CAST(code AS BIGINT) % 3 WHEN 0 THEN '   ' WHEN 1 THEN product_name END"))
    return normalize_products(blanked).filter(P.has_name()).select("code")


@check("C2_country", CAT + "SELECT code FROM catalog WHERE countries_tags ILIKE '%en:canada%'")
def country(spark, folder):
    df = catalog(spark, folder).withColumn("tags", F.array(F.upper("countries_tags"), F.lit("en:other")))
    return df.filter(C.in_country(F.col("tags"), df.schema["tags"].dataType)).select("code")


FULL_QUERY = Query(
    category_tag="en:economy", bounds=[Bound("proteins_100g", ">=", 10), Bound("energy_kcal_100g", "<=", 400, "kcal"),
                                       Bound("salt_100g", "<=", 1)],
    dietary_tags=["vegan"], excluded=["anvil"], keywords=["brand", "r"], preferences=["healthy"])


@check("C11_search_one", PROD + f"""
SELECT code, name, energy_kcal_100g FROM prod WHERE is_listed AND contains(category_filter_text, 'en:economy')
  AND contains(lower(label_text), 'vegan') AND proteins_100g >= 10 AND energy_kcal_100g <= 400 AND energy_kcal_100g > 0
  AND salt_missing AND NOT contains(ingredient_filter_text, 'anvil') AND contains(lower(combined_text), 'brand')
ORDER BY {o.order_sql(strict='TRUE')} LIMIT 50""".replace("salt_missing", "TRUE"))
def search_full(spark, folder):
    # The catalog has no salt column, so that bound is dropped.
    df = products(spark, folder).drop("salt_100g")
    return search_one(df, FULL_QUERY, limit=50).select("code", "name", "energy_kcal_100g")


ROW_CONSTRAINTS = [("proteins_100g", ">", 5.0), ("sugars_100g", "<", 40.0), ("fat_100g", "==", 14.0)]


@check("C12_row_constraints", PROD + """
SELECT code, CAST(coalesce(proteins_100g > 5, FALSE) AND coalesce(sugars_100g < 40, FALSE) AS BIGINT) AS strict_check,
  CAST(coalesce(proteins_100g > 5, TRUE) AND coalesce(sugars_100g < 40, TRUE) AS BIGINT) AS lenient_check,
  CAST(abs(fat_100g - 14.0) <= 1e-6 AS BIGINT) AS equal_check FROM prod""")
def row_constraints(spark, folder):
    rows = lambda items: F.array(*[
        F.struct(F.lit(n).alias("nutrient"), F.lit(op).alias("operator"), F.lit(v).alias("value"), F.lit("g").alias("unit"))
        for n, op, v in items])
    pair, equal = rows(ROW_CONSTRAINTS[:2]), rows(ROW_CONSTRAINTS[2:])
    return products(spark, folder).select(
        "code", whole(P.passes_constraints(pair), "strict_check"),
        whole(P.passes_constraints(pair, allow_missing=True), "lenient_check"),
        whole(P.passes_constraints(equal), "equal_check"))


@check("C13_has_label", PROD + """
SELECT code, CAST(contains(lower(label_text), 'vegan') AS BIGINT) AS vegan,
  CAST(contains(lower(label_text), 'gluten free') AS BIGINT) AS gluten_free,
  CAST(contains(lower(label_text), 'kosher') AS BIGINT) AS kosher, CAST(1 AS BIGINT) AS accented FROM prod""")
def has_label(spark, folder):
    folded = P.folded_labels(F.col("labels"))
    accented = P.folded_labels(F.concat("labels", F.array(F.lit("Végétalien"))))
    return products(spark, folder).select(
        "code", *[whole(P.has_label(folded, F.lit(tag)), name) for name, tag in (
            ("vegan", "Vegan"), ("gluten_free", "gluten-free"), ("kosher", "kosher"))],
        whole(P.has_label(accented, F.lit("vegan")), "accented"))


@check("C14_lookup", PROD + """
SELECT code, name FROM prod WHERE CAST(code AS BIGINT) IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)""")
def lookup(spark, folder):
    codes = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_quantity >= 45").select(
        F.col("l_partkey").cast("string").alias("code"))
    return P.lookup(products(spark, folder), codes).select("code", "name")


# ---- D: order and limits ---------------------------------------------------


def _per_brand(name: str, kids: bool, strict: bool) -> None:
    order = o.order_sql(str(kids).upper(), str(strict).upper())

    @check(name, PROD + f"SELECT brands, code, row_number() OVER (PARTITION BY brands ORDER BY {order}) AS place FROM prod")
    def query(spark, folder):
        slim = products(spark, folder).select("brands", "code", *ordering.ORDERED_BY)
        return add_places(slim, ["brands"], ordering.candidate_order(kids, strict)).select("brands", "code", "place")


_per_brand("D1_candidate_order", False, False)
_per_brand("D3_kids_order", True, False)
_per_brand("D4_strict_order", False, True)


@check("D5_limit_per_group", PROD + f"""
SELECT brands, code, place FROM (
  SELECT brands, code, row_number() OVER (PARTITION BY brands ORDER BY {o.order_sql("TRUE", "TRUE")}) AS place FROM prod)
WHERE place <= {ordering.page_limit(None, None)}""")
def limit_per_group(spark, folder):
    rows = ordering.first_rows(products(spark, folder), ["brands"], ordering.candidate_order(True, True), ordering.page_limit(None, None), "place")
    return rows.select("brands", "code", whole("place"))


@check("D2_nutrition_heuristic", PROD + "SELECT code, round(CAST(heuristic AS DOUBLE), 6) AS heuristic FROM prod")
def nutrition_heuristic(spark, folder):
    return products(spark, folder).select("code", rounded(ordering.nutrition_heuristic(), "heuristic"))


# ---- G, H: product scores and insights --------------------------------------


@check("G1_product_text", PROD + """
SELECT code, concat_ws(' ', name, brands, array_to_string(categories, ' '), ingredients_text) AS product_text FROM prod""")
def text_of_product(spark, folder):
    return products(spark, folder).select("code", product_text().alias("product_text"))


@check("G5_quality", INSIGHT + "SELECT code, round(quality, 6) AS quality FROM insight")
def quality(spark, folder):
    return add_quality(products(spark, folder)).select("code", rounded("quality"))


@check("G6_nutrient_quality", INSIGHT + "SELECT code, round(nutrient_quality, 6) AS nutrient_quality FROM insight")
def nutrient_quality(spark, folder):
    return add_quality(products(spark, folder)).select("code", rounded("nutrient_quality"))


def _ramps(name: str, sql: str, column) -> None:
    @check(name, PROD + f"SELECT code, round(CAST({sql} AS DOUBLE), 6) AS bonus FROM prod")
    def query(spark, folder):
        return products(spark, folder).select("code", rounded(column(), "bonus"))


def _low_ramp():
    from larder.functions.numbers import lower_is_better

    return lower_is_better(F.col("sugars_100g"), 5.0, 22.5, 2.5)


def _high_ramp():
    from larder.functions.numbers import higher_is_better

    return higher_is_better(F.col("proteins_100g"), 5.0, 15.0, 2.5)


_ramps("G15_lower_is_better", o.ramp_down("sugars_100g", 5.0, 22.5, 2.5), _low_ramp)
_ramps("G16_higher_is_better", o.ramp_up("proteins_100g", 5.0, 15.0, 2.5), _high_ramp)


def _insight(name: str, sql: str, *columns) -> None:
    @check(name, INSIGHT + f"SELECT code, {sql} FROM insight")
    def query(spark, folder):
        return add_insights(products(spark, folder)).select("code", *[c() for c in columns])


_insight("H1_health_score", "CAST(health_score AS BIGINT) AS health_score", lambda: whole("health_score"))
_insight("H2_health_class", "health_class", lambda: F.col("health_class"))
_insight("H3_risks", f"{o.joined('risks')} AS risks", lambda: listed("risk_indicators", "risks"))
_insight("H4_positives", f"{o.joined('positives')} AS positives", lambda: listed("positive_indicators", "positives"))
_insight("H5_summary", "summary", lambda: F.col("summary"))


def improvements_sql(ref: str, other: str) -> str:
    def points(alias):
        return f"coalesce({o.case_map(alias + 'nutriscore', t.GRADE_QUALITY)}, 0)"

    lines = [
        f"CASE WHEN {points(other)} > {points(ref)} THEN 'Better Nutri-Score (' || upper({other}nutriscore) || ' vs ' "
        f"|| upper(coalesce({ref}nutriscore, '?')) || ')' END"]
    for n, label in t.LESS_IS_BETTER:
        share = f"({ref}{n} - {other}{n}) / {ref}{n} * 100"
        lines.append(f"CASE WHEN {ref}{n} > 0 AND {other}{n} <> 0 AND {share} >= 20 "
                     f"THEN printf('%.0f', {share}) || '% less {label}' END")
    for n, label in t.MORE_IS_BETTER:
        share = f"({other}{n} - {ref}{n}) / {ref}{n} * 100"
        lines.append(
            f"CASE WHEN {other}{n} <> 0 AND ({ref}{n} IS NULL OR {other}{n} > {ref}{n} * 1.20) THEN CASE WHEN {ref}{n} > 0 "
            f"THEN printf('%.0f', {share}) || '% more {label}' ELSE 'Higher {label}' END END")
    lines.append(f"CASE WHEN {other}nova_group < {ref}nova_group THEN 'Less processed (NOVA ' || {other}nova_group "
                 f"|| ' vs ' || {ref}nova_group || ')' END")
    lines.append(f"CASE WHEN {other}additives_count < {ref}additives_count THEN "
                 f"({ref}additives_count - {other}additives_count) || ' fewer additive(s)' END")
    return f"list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL)"


@check("H6_improvements", INSIGHT + f"""
SELECT r.code AS ref_code, c.code, {o.joined(improvements_sql('r.', 'c.'))} AS improvements
FROM insight r JOIN insight c ON CAST(r.code AS BIGINT) + 1 = CAST(c.code AS BIGINT)""")
def improvement_lists(spark, folder):
    scored = add_quality(products(spark, folder))
    refs = scored.select(*[F.col(c).alias(f"ref_{c}") for c in COMPARED])
    pairs = refs.join(scored, F.expr("CAST(ref_code AS BIGINT) + 1 = CAST(code AS BIGINT)"))
    return pairs.select("ref_code", "code", listed(improvements(), "improvements"))
