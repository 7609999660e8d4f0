import pytest

from larder.operators.annotate import annotate_queries
from larder.sources.fixtures import PHRASES

PAIRS = list(zip(PHRASES[0:24:2], PHRASES[1:24:2]))


@pytest.fixture(scope="module")
def read(spark):
    extra = ["snack under 200 calories", "Show me cookies", "zero sugar or low carbs sans sucre"]
    texts = list(dict.fromkeys(PHRASES + extra))
    rows = annotate_queries(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    return {r.text: r for r in rows}


def bounds(row):
    return {(c.nutrient, c.operator): c.value for c in row.nutrient_constraints}


@pytest.mark.parametrize("english, french", PAIRS)
def test_both_languages_mean_the_same(read, english, french):
    a, b = read[english], read[french]
    if english.startswith("snack bars"):
        assert bounds(a) == bounds(b)
    else:
        assert (a.category, a.dietary_tags, bounds(a)) == (b.category, b.dietary_tags, bounds(b))


@pytest.mark.parametrize("text, expected", [
    ("snack under 200 calories", {("energy_kcal_100g", "<="): 200.0}),
    ("cereal with over 10g protein", {("proteins_100g", ">="): 10.0}),
    ("maximum 0.5g sodium per 100g", {("sodium_100g", "<="): 0.5}),
    ("over 15g protein high protein bar", {("proteins_100g", ">="): 15.0}),
    ("zero sugar drink", {("sugars_100g", "<="): 0.5}),
    ("over 300 calories", {("energy_kcal_100g", ">="): 300.0, ("energy_kcal_100g", "<="): 300.0}),
    ("under 200 mg sodium crackers", {("sodium_100g", "<="): 0.2}),
    ("", {}),
])
def test_bounds(read, text, expected):
    assert bounds(read[text]) == expected


def test_exclusions_and_targets(read):
    assert read["give a snack which has no palm oil"].excluded_ingredients == ["palm oil"]
    assert read["give a snack which has no palm oil"].search_terms == []
    assert read["low sugar snacks with no added sugar"].excluded_ingredients == ["added sugar"]
    assert read["instead of peanut butter"].comparison_product == "peanut butter"
    assert read["replace blue bolt with something better, please"].comparison_product == "blue bolt"
    assert read["vegan vegetarian plant-based olive oil"].category == "oils"
    assert read["vegan vegetarian plant-based olive oil"].dietary_tags == ["vegan"]


def test_translation_is_merged_with_the_rules(spark):
    df = spark.createDataFrame(
        [("céréales sans huile de palme", "cereal under 5 g sugar"), ("céréales", None), ("snacks", "cookies")],
        "text string, english string")
    rows = {r.text: r for r in annotate_queries(df, "text", "english").collect()}
    merged = rows["céréales sans huile de palme"]
    assert merged.category == "cereals" and merged.excluded_ingredients == []
    assert bounds(merged) == {("sugars_100g", "<="): 5.0}
    assert rows["céréales"].normalized_text == "cereals"
    assert rows["snacks"].category == "snacks"
