"""Turn a loosely typed product table into the typed table every other job uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import tables
from larder.functions import values as V
from larder.operators.ordering import grade_points, nova_points
from larder.sources.curate import in_country, tag_text
from larder.sources.schema import field, field_column, nutrient


def _text(df: DataFrame, name: str) -> Column:
    """Filter text of a field: the raw value as text, '' for NULL or absent."""
    value, kind = field(df, name, tables.SEARCH_FIELDS)
    return F.coalesce(tag_text(value, kind), F.lit(""))


def filter_texts(df: DataFrame) -> dict[str, Column]:
    """The texts the search predicates look into."""
    name, brands, categories, ingredients = (
        _text(df, f) for f in ("product_name", "brands", "categories", "ingredients_text")
    )
    return {
        "name_text": name,
        "combined_text": F.concat_ws(" ", name, brands, categories, ingredients),
        "label_text": _text(df, "labels"),
        "ingredient_filter_text": F.concat_ws(" ", ingredients, _text(df, "ingredients_tags")),
        "category_filter_text": _text(df, "categories_tags"),
    }


def category_terms(df: DataFrame) -> Column:
    """The separate tags behind ``category_filter_text``."""
    value, kind = field(df, "categories_tags", tables.SEARCH_FIELDS)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.filter(value.cast("array<string>"), lambda t: t.isNotNull()), V.empty_list())
    return F.coalesce(F.split(value.cast("string"), ", "), V.empty_list())


# Fields of normalised products that are texts.
TEXT_FIELDS = ["product_name", "brands", "nutriscore_grade", "ecoscore_grade", "ingredients_text", "image_url", "url"]


def normalize_products(df: DataFrame, site: V.Site = V.Site(), country: str = tables.COUNTRY_TAG) -> DataFrame:
    """One narrow pass over the table: no shuffle, no Python.

    Besides the product's own columns it carries what searching needs: the
    filter texts, the country test, and order points taken from the raw values.
    """

    def get(name: str) -> tuple[Column, T.DataType]:
        return field(df, name, tables.SEARCH_FIELDS)

    # All plain texts are read by one expression over a list of them: the plan holds it once, not once per column.
    plain = [n for n in TEXT_FIELDS if isinstance(get(n)[1], T.StringType)]
    texts = F.transform(F.array(*[get(n)[0] for n in plain]), lambda value: V.text_value(value, T.StringType()))

    def text(name: str) -> Column:
        return F.get("_texts", F.lit(plain.index(name))) if name in plain else V.text_value(*get(name))

    code = F.coalesce(get("code")[0].cast("string"), F.lit(""))
    name = F.coalesce(text("product_name"), F.lit("Unknown"))
    additives = V.additive_codes(*get("additives_tags"))
    counted = get("additives_n")[0].try_cast("int")
    amounts = {n: c.try_cast("double") for n in tables.NUTRIENTS if (c := nutrient(df, n)) is not None}
    country_value, country_kind = get("countries_tags")
    has_country = field_column(df, "countries_tags", tables.SEARCH_FIELDS) is not None
    raw_grade = tag_text(*get("nutriscore_grade"))
    raw_nova, nova_kind = get("nova_group")
    if isinstance(nova_kind, T.StringType):  # a text counts only if it is a whole number
        raw_nova = F.when(F.trim(raw_nova).rlike(r"^[+-]?[0-9]+$"), F.trim(raw_nova))

    staged = (df.withColumn("_texts", texts) if plain else df).select(
        code.alias("code"),
        name.alias("name"),
        F.coalesce(text("brands"), F.lit("")).alias("brands"),
        V.list_value(*get("categories")).alias("categories"),
        V.list_value(*get("labels")).alias("labels"),
        V.list_value(*get("ingredients_tags")).alias("ingredients_tags"),
        additives.alias("additives"),
        counted.alias("_counted"),
        *[amounts.get(n, F.lit(None).cast("double")).alias(n) for n in tables.NUTRIENTS],
        V.grade_of(text("nutriscore_grade")).alias("nutriscore"),
        V.grade_of(text("ecoscore_grade")).alias("ecoscore"),
        raw_nova.try_cast("double").cast("int").alias("nova_group"),
        F.coalesce(text("ingredients_text"), F.lit("")).alias("ingredients_text"),
        text("image_url").alias("_image"),
        get("images")[0].alias("_images"),
        text("url").alias("_url"),
        get("unique_scans_n")[0].cast("bigint").alias("unique_scans_n"),
        *[joined.alias(n) for n, joined in filter_texts(df).items()],
        category_terms(df).alias("category_terms"),
        (in_country(country_value, country_kind, country) if has_country else F.lit(True)).alias("in_country"),
        grade_points(raw_grade).alias("grade_points"),
        nova_points(raw_nova.try_cast("double")).alias("nova_points"),
    )
    images_kind = get("images")[1]
    derived = {
        "additives_count": F.coalesce(F.nullif(F.col("_counted"), F.lit(0)), F.size("additives")),
        "image_url": V.image_url(F.col("_image"), F.col("_images"), images_kind, F.col("code"), site),
        "product_url": V.product_url(
            F.coalesce("_url", F.lit("")), F.col("code"), F.col("name"), site
        ),
        "nutrients": F.create_map(*[x for n in amounts for x in (F.lit(n), F.col(n))])
        if amounts else F.create_map().cast("map<string,double>"),
        # A table without a name column has no name filter.
        "is_listed": F.coalesce("in_country", F.lit(False))
        & ((F.trim("name_text") != "") if field_column(df, "product_name", tables.SEARCH_FIELDS) else F.lit(True)),
    }
    return staged.withColumns(derived).drop("_counted", "_image", "_images", "_url", "in_country")
