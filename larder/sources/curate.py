"""Read product tables, curate raw dumps into the lean search table, write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import tables
from larder.sources.schema import field, nutrient


def read_products(spark: SparkSession, path: str, view: str | None = "products") -> DataFrame:
    """Read a product table and name it as a view."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def tag_text(value: Column, kind: T.DataType) -> Column:
    """Searchable text of a tag column: arrays are joined, NULL stays NULL."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(value.cast("array<string>"), ", ")
    return value.cast("string")


def in_country(value: Column, kind: T.DataType, tag: str = tables.COUNTRY_TAG) -> Column:
    """Country filter: the tag occurs in the column's text, in any case."""
    if isinstance(kind, T.ArrayType):
        return F.exists(value, lambda t: F.contains(F.lower(t), F.lit(tag.lower())))
    return F.contains(F.lower(value.cast("string")), F.lit(tag.lower()))


def is_country_record(
    value: Column, kind: T.DataType, tag: str = tables.COUNTRY_TAG, word: str = tables.COUNTRY_WORD
) -> Column:
    """Record-wise country test: whole elements of a list; tag or country word in a text."""
    wanted = tag.lower()
    if isinstance(kind, T.ArrayType):
        matched = F.exists(value, lambda t: F.lower(t) == wanted)
    else:
        text = F.lower(value.cast("string"))
        matched = F.contains(text, F.lit(wanted)) | F.contains(text, F.lit(word))
    return F.coalesce(matched, F.lit(False))


def lean_projection(df: DataFrame, all_columns: bool = False) -> DataFrame:
    """The lean search columns, NULL where the source has none; or every column."""
    if all_columns:
        return df
    chosen = []
    for name in tables.LEAN_COLUMNS:
        if name in tables.NUTRIENTS:
            found = nutrient(df, name, prefer="flat")
            value = F.lit(None).cast("double") if found is None else found
        else:
            value = field(df, name, tables.CURATION_FIELDS)[0]
        chosen.append(value.alias(name))
    return df.select(*chosen)


def curate(
    df: DataFrame,
    country: str = tables.COUNTRY_TAG,
    limit: int | None = None,
    all_columns: bool = False,
    exact_elements: bool = False,
) -> DataFrame:
    """Keep one country's products in lean form; all of them, or ``limit`` in code order if asked for.

    Products without a code come last; equal codes go by a hash of the row. The order makes the cut repeatable.
    """
    value, kind = field(df, "countries_tags", {"countries_tags": ["countries_tags"]})
    test = is_country_record if exact_elements else in_country
    kept = df.filter(test(value, kind, country))
    if limit is not None:
        code, _ = field(df, "code", tables.CURATION_FIELDS)
        row = F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if "map" not in f.dataType.simpleString()])
        kept = kept.orderBy(code.asc_nulls_last(), row).limit(limit)
    return lean_projection(kept, all_columns)


def write_products(df: DataFrame, path: str, mode: str = "error", partition_by: str | None = None) -> None:
    """Write a product table as Parquet, optionally split by a column for pruning."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def table_health(df: DataFrame) -> DataFrame:
    """Row count of a product table."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))
