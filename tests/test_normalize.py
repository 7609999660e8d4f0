from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators.normalize import normalize_products
from larder.operators.predicates import folded_labels, has_label
from larder.sources.curate import curate


def one(df):
    return normalize_products(df).collect()[0]


def test_unknown_grades_are_null(spark):
    row = one(spark.createDataFrame([("42", "Mystery", "unknown", "not-applicable")],
                                    "code string, product_name string, nutriscore_grade string, ecoscore_grade string"))
    assert (row.nutriscore, row.ecoscore) == (None, None)
    assert row.additives_count == 0 and row.nutrients == {}


def test_localized_names_prefer_english(spark):
    schema = "code string, product_name array<struct<lang:string,text:string>>"
    names = [("main", "Flocons avoine"), ("en", "Oat Flakes"), ("fr", "Flocons d'avoine")]
    assert one(spark.createDataFrame([("9", names)], schema)).name == "Oat Flakes"
    assert one(spark.createDataFrame([("9", [("de", "Hafer"), ("fr", " Avoine ")])], schema)).name == "Avoine"
    assert one(spark.createDataFrame([("9", None)], schema)).name == "Unknown"


def test_image_from_list(spark):
    schema = "code string, product_name string, images array<struct<key:string,rev:int,sizes:map<string,int>>>"
    row = one(spark.createDataFrame(
        [("0000101209159", "T", [("front_fr", 4, {"100": 1, "200": 1, "400": 1})])], schema))
    assert row.image_url.endswith("/000/010/120/9159/front_fr.4.400.jpg")


def test_urls(spark):
    site = V.Site()
    rows = [
        ("3017", "Nut Spread", "https://world.catalog.example/product/3017/nut", "https://ca.catalog.example/product/3017/nut"),
        ("3017", "Nut Spread", "https://world.catalog.example/a?b?#", "https://ca.catalog.example/a?b?"),
        ("3017", "Nut Spread", "", "https://ca.catalog.example/product/3017/nut-spread"),
        ("0068", "Tortilla chips", "https://shop.other.example/x/21_EA", "https://ca.catalog.example/product/0068/tortilla-chips"),
        ("", "No code", "", ""),
    ]
    df = spark.createDataFrame(rows, "code string, name string, raw string, want string")
    url = V.product_url(F.col("raw"), F.col("code"), F.col("name"), site)
    for row in df.select("want", url.alias("got")).collect():
        assert row.got == row.want


def test_french_labels_count(spark):
    df = spark.createDataFrame([(["Végétalien", "Biologique"],)], "labels array<string>")
    folded = folded_labels(F.col("labels"))
    row = df.select(has_label(folded, F.lit("vegan")), has_label(folded, F.lit("organic")),
                    has_label(folded, F.lit("kosher"))).collect()[0]
    assert tuple(row) == (True, True, False)


def test_nutrients_from_struct_and_hyphens(spark):
    df = spark.createDataFrame(
        [("1", "A", (6.3, 56.3), 530.0)],
        "code string, product_name string, nutriments struct<proteins_100g:double,sugars_100g:double>, "
        "`energy-kcal_100g` double")
    row = one(df)
    assert (row.proteins_100g, row.sugars_100g, row.energy_kcal_100g, row.fat_100g) == (6.3, 56.3, 530.0, None)
    assert sorted(row.nutrients) == ["energy_kcal_100g", "proteins_100g", "sugars_100g"]


def test_curation_keeps_every_row_unless_asked(spark):
    raw = spark.createDataFrame([("2", "en:canada"), (None, "en:canada"), ("1", "en:canada"), ("3", "en:france")], "code string, countries_tags string")
    assert {r["code"] for r in curate(raw).collect()} == {"1", "2", None}
    assert [r["code"] for r in curate(raw, limit=3).collect()] == ["1", "2", None]
    assert [r["code"] for r in curate(raw, limit=2).collect()] == ["1", "2"]


def test_processing_group_as_text_must_be_a_whole_number(spark):
    raw = spark.createDataFrame([("1", "3"), ("2", "3.0"), ("3", " 4 "), ("4", "x")], "code string, nova_group string")
    assert {r["code"]: r["nova_group"] for r in normalize_products(raw).collect()} == {"1": 3, "2": None, "3": 4, "4": None}


def test_a_cut_among_equal_codes_is_repeatable(spark):
    rows = [(None if i % 2 else "7", f"p{i}", "en:canada") for i in range(40)]
    make = lambda order: spark.createDataFrame([rows[i] for i in order], "code string, product_name string, countries_tags string").repartition(3)
    cut = lambda df: sorted(r["product_name"] for r in curate(df, limit=25).collect())
    assert cut(make(range(40))) == cut(make(reversed(range(40)))) and len(cut(make(range(40)))) == 25
