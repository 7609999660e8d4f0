"""Work that is heavy per row: done once per row, in many tasks, and after texts are made distinct."""

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.values import Site, image_url
from larder.operators.intents import map_categories
from larder.plans.joins import spread_join
from larder.sources import fixtures


def test_parts_of_one_file_are_dealt_out(spark, tmp_path):
    parts = [(i, f"red ring {i}", "Brand#1", "PROMO", 5) for i in range(400)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, date(2024, 1, 1))], "l_partkey bigint, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    texts = fixtures.catalog(spark, str(tmp_path)).select("product_name", F.spark_partition_id().alias("task"))
    assert texts.select("task").distinct().count() == 4
    assert texts.count() == 400


def test_a_written_image_list_is_read_once(spark):
    row = spark.range(1).select(F.lit("[{'key': 'front', 'rev': 3, 'sizes': {'200': {}}}]").alias("images"), F.lit("0001234567890").alias("code"))
    found = row.select(image_url(F.lit(None).cast("string"), F.col("images"), T.StringType(), F.col("code"), Site()).alias("url"))
    assert found.first()["url"].endswith("/front.3.200.jpg")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json(ArrayType(StructType") == 1


def test_categories_are_stored_before_they_are_filtered(spark):
    seen = spark.sparkContext.accumulator(0)

    def word(text):
        seen.add(1)
        return text or None

    texts = spark.createDataFrame([("snacks",)] * 500 + [("",)] * 500, "text string").distinct()
    parsed = texts.withColumn("category", F.udf(word, "string")("text"))
    tags = spark.createDataFrame([("snack", "en:small")], "word string, tag string")
    rows = map_categories(parsed, tags).collect()
    assert {(r["text"], r["category_tag"]) for r in rows} == {("snacks", "en:small"), ("", None)}
    assert seen.value == 2


def test_heavy_joins_stay_spread(spark):
    asked = spark.range(1000).selectExpr("id % 40 AS block", "id AS intent_id")
    held = spark.range(400).selectExpr("id % 40 AS block", "id AS row")
    joined = spread_join(asked, held, ["block"], ["intent_id"], 10, heavy=True)
    assert len(joined.collect()) == 10_000
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()  # no side of few bytes is broadcast
