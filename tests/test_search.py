"""Search against a plain loop in Python, on tables that are hard on purpose."""

import random

import pytest
from pyspark.sql import functions as F

import larder.plans.joins as joins
from larder import tables as t
from larder.operators.normalize import normalize_products
from larder.plans import blocks, probes, search
from larder.plans.answers import answer_log, answer_read, answer_whole_log, for_log
from larder.plans.joins import fits, spread_join, substring_pairs
from larder.plans.recommend import recommend_all

RNG = random.Random(11)
TAGS = ["en:chips", "en:chips-and-crisps", "en:salty-snacks", "en:cookies", "en:dairies"]


@pytest.fixture(scope="module")
def products(spark):
    rows = []
    for i in range(240):
        tags = RNG.sample(TAGS, 2) if i % 3 else ["en:chips"]  # one tag holds more than a third
        amount = lambda top: None if RNG.random() < 0.1 else round(RNG.random() * top, 1)
        rows.append((
            f"{i:04d}", RNG.choice(["red rice", "blue redcurrant", "oat mix", " "]), "b", ", ".join(tags), tags,
            RNG.choice(["Vegan", "organic, kosher", None]), RNG.choice(["palm-oil", "soy", "salt"]), RNG.choice("abcdx"),
            RNG.choice([1, 2, 3, 4, None]), amount(30), amount(40), amount(600), RNG.randrange(5)))
    df = spark.createDataFrame(rows, (
        "code string, product_name string, brands string, categories string, categories_tags array<string>, labels string, "
        "ingredients_text string, nutriscore_grade string, nova_group int, proteins_100g double, sugars_100g double, "
        "energy_kcal_100g double, unique_scans_n bigint"))
    return normalize_products(df).cache()


@pytest.fixture(scope="module")
def intents(spark):
    rows = []
    for i in range(60):
        bounds = RNG.sample([("energy_kcal_100g", "<=", RNG.choice([1.0, 40.0, 300.0]), "kcal"),
                             ("proteins_100g", ">=", RNG.choice([5.0, 28.0, 31.0]), "g"),
                             ("sugars_100g", "<", 8.0, "g"), ("salt_100g", "<=", 1.0, "g")], RNG.randrange(4))
        rows.append((f"q{i}", RNG.choice([None, "en:chips", "en:c", "cookies", "s"]), bounds,
                     RNG.choice([[], [], ["vegan"], ["kosher", "organic"], ["organic, k"]]),
                     RNG.choice([[], [], ["red"], ["rice", "ox"]]), RNG.choice([[], ["kids"], ["healthy"]]),
                     RNG.choice([[], ["palm oil"]])))
    return spark.createDataFrame(rows, "text string, category string, nutrient_constraints array<struct<nutrient:string,"
                                       "operator:string,value:double,unit:string>>, dietary_tags array<string>, "
                                       "search_terms array<string>, ranking_preferences array<string>, "
                                       "excluded_ingredients array<string>").cache()


def relaxed(bounds):
    def step(n, op, v):
        if op.startswith(">"):
            return round(max(0.0, v - 2 if n in t.MORE_IS_ASKED else v * 0.9), 3)
        return round(v + 50 if n == "energy_kcal_100g" else v * 1.15, 3)
    return [(n, op, step(n, op, v)) for n, op, v in bounds]


def expected(products, intents, limit):
    """All candidates by a nested loop over the collected fixture."""
    rows, found = [p for p in products.collect() if p.is_listed], {}
    for q in intents.collect():
        def text_ok(p, q=q):
            return ((not q.category or q.category in p.category_filter_text.lower())
                    and all(any(x in p.label_text.lower() for x in t.LABEL_PATTERNS.get(d, [d])) for d in q.dietary_tags)
                    and all(w in p.combined_text.lower() for w in [w for w in q.search_terms if len(w) >= 3][:3])
                    and not any(x in p.ingredient_filter_text.lower() for e in q.excluded_ingredients
                                for x in (e, e.replace(" ", "-"))))
        bounds = [(c.nutrient, c.operator, c.value) for c in q.nutrient_constraints]
        strict = "healthy" in q.ranking_preferences or bool(bounds) or bool(q.dietary_tags)
        for level in range(3):
            def bounds_ok(p, bounds=bounds):
                for n, op, v in bounds:
                    if n not in p.nutrients:
                        continue
                    a = p.nutrients[n]
                    if a is None or not {"<=": a <= v, "<": a < v, ">=": a >= v}[op]:
                        return False
                    if n == "energy_kcal_100g" and op == "<=" and a <= 0:
                        return False
                return True
            hits = [p for p in rows if text_ok(p) and bounds_ok(p)]
            if hits:
                zero = lambda x, d=0: d if x is None else x
                def key(p, q=q):
                    kcal = p.energy_kcal_100g
                    value = (min(zero(p.proteins_100g), 25) * 0.6 - min(zero(p.sugars_100g), 30) * 0.35
                             + (0 if kcal is None else 2 if kcal <= 250 else 1 if kcal <= 400 else 0))
                    return (-p.grade_points, -p.nova_points, -round(value, 9),
                            zero(p.sugars_100g, 9999) if "kids" in q.ranking_preferences else 0,
                            (-zero(p.proteins_100g), zero(p.sugars_100g, 9999)) if strict else (),
                            -p.unique_scans_n, p.name_text, p.code)
                found[q.text] = [(level, p.code) for p in sorted(hits, key=key)[:limit]]
                break
            bounds = relaxed(bounds)
    return found


def answers(products, intents, limit, **options):
    found = search.search_intents(products, intents, limit=limit, **options)
    keyed = search.add_search_key(intents).select("text", "intent_id").join(found, "intent_id")
    result = {}
    for r in keyed.orderBy("text", "candidate_rank").select("text", "level", "code").collect():
        result.setdefault(r.text, []).append((r.level, r.code))
    return result


def test_search_equals_a_nested_loop(products, intents):
    want = expected(products, intents, 7)
    assert len(want) > 20 and {level for rows in want.values() for level, _ in rows} == {0, 1, 2}
    assert answers(products, intents, 7) == want


def test_search_beyond_the_heads(products, intents):
    assert answers(products, intents, 7, head_rows=8) == expected(products, intents, 7)


def test_search_without_broadcasts_and_with_split_keys(products, intents, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "ROWS_PER_PART", 10)
    monkeypatch.setattr(probes, "fits", lambda df: False)
    monkeypatch.setattr(joins, "fits", lambda df: False)
    assert answers(products, intents, 7, head_rows=8) == expected(products, intents, 7)


def test_spread_join_splits_hot_keys(spark):
    big = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (2, "d")], "k int, v string")
    split = spread_join(big, small, ["k"], ["id"], rows_per_part=50)
    assert split.select("_part").distinct().count() > 5
    plain = big.join(small, "k")
    assert sorted(split.select("k", "id", "v").collect()) == sorted(plain.select("k", "id", "v").collect())


def test_substring_pairs_equal_contains(spark):
    words = ["".join(RNG.choice("abc") for _ in range(RNG.randrange(1, 7))) for _ in range(120)]
    terms = spark.createDataFrame([("x", w) for w in set(words)], "kind string, term string")
    wanted = spark.createDataFrame([("x", w[:4]) for w in {w[:4] for w in words}], "kind string, pattern string")
    got = {tuple(r)[1:] for r in substring_pairs(terms, wanted).collect()}
    assert got == {(a, b) for a in set(words) for b in {w[:4] for w in words} if b in a}


def test_relaxing_never_drops_words_tags_or_category(spark):
    rows = [("20", "Classic Butter Cookies", "cookies", ["en:cookies"], "c", 6.0, 20.0),
            ("21", "Plain Milk", "milk", ["en:milk"], "b", None, 5.0)]
    df = spark.createDataFrame(rows, "code string, product_name string, categories string, categories_tags array<string>, "
                                     "nutriscore_grade string, proteins_100g double, sugars_100g double")
    texts = ["gluten free cookies", "cookies xyznonexistent", "cookies with over 9g protein", "high protein milk"]
    log = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    result = answer_log(normalize_products(df), log, {"milk": "en:milk"})
    rows = {r.text: r for r in result.answers.collect()}
    assert rows["gluten free cookies"].candidate_rows == 0
    assert rows["gluten free cookies"].relaxation_log == [t.PRESERVED_NOTE]
    assert rows["cookies xyznonexistent"].candidate_rows == 0
    assert rows["cookies with over 9g protein"].level == 2
    assert rows["cookies with over 9g protein"].relaxation_log == [
        "proteins >= changed from 9 to 7", "proteins >= changed from 7 to 5"]
    assert rows["high protein milk"].candidate_rows == 0  # a missing amount never passes
    assert [r.code for r in result.ranked.collect()] == ["20"]


def test_recommendations_leave_out_copies_of_the_reference(products):
    doubled = products.unionByName(products.limit(40)).cache()
    scored = recommend_all(doubled).select("ref_code", "code", "quality", "ref_quality", "rank").collect()
    assert scored and all(r.code != r.ref_code and r.quality > r.ref_quality * 1.05 for r in scored)
    assert all(1 <= r["rank"] <= 5 for r in scored)


def test_a_missing_text_is_answered_for_its_queries(spark):
    log = spark.createDataFrame([(1, None), (2, "tea"), (3, None), (4, "")], "query_id long, text string")
    per_text = spark.createDataFrame([(None, "x"), ("tea", "y")], "text string, found string")
    assert {(r["query_id"], r["text"], r["found"]) for r in for_log(log, per_text).collect()} == {(1, None, "x"), (2, "tea", "y"), (3, None, "x")}


@pytest.fixture(scope="module")
def cookies(spark):
    rows = [("20", "Classic Butter Cookies", "cookies", ["en:cookies"], "e", 6.0, 20.0),
            ("21", "Plain Milk", "milk", ["en:milk"], "b", 3.0, 5.0),
            ("22", "Oat Cookies", "cookies", ["en:cookies"], "a", 9.0, 2.0)]
    return normalize_products(spark.createDataFrame(
        rows, "code string, product_name string, categories string, categories_tags array<string>, "
              "nutriscore_grade string, proteins_100g double, sugars_100g double")).cache()


def test_a_whole_log_has_each_query_once(spark, cookies):
    french = "biscuits sans gluten ni lait"
    log = spark.createDataFrame(
        [(1, None, None), (2, "milk", None), (3, "milk", "milk"), (4, "healthier alternative to classic butter cookies", None),
         (5, "healthier alternative to xyznonexistent", None), (6, french, "cookies"), (7, french, "milk"), (8, french, "cookies")],
        "query_id long, text string, english string")
    whole = answer_whole_log(cookies, log, {"milk": "en:milk", "cookies": "en:cookies"}, translation="english")
    rows = {r["query_id"]: (r["branch"], r["result_rows"]) for r in for_log(log, whole.rows, "english").collect()}
    assert for_log(log, whole.rows, "english").count() == 8 and sorted(rows) == list(range(1, 9))
    assert {k for k, v in rows.items() if v[0] == "compare"} == {4, 5}
    assert rows[4] == ("compare", 1) and rows[5] == ("compare", 0)
    assert [(r["ref_code"], r["code"]) for r in whole.compared.collect()] == [("20", "22")]
    ranked = for_log(log, whole.searched.ranked, "english").select("query_id", "rank").collect()
    assert len(ranked) == len(set(ranked))  # two translations of a text do not double its results
    with pytest.raises(ValueError):
        for_log(log, whole.rows)


def test_ready_made_comparisons_are_compared(spark, cookies):
    asked = spark.createDataFrame([("a", "classic butter cookies", []), ("b", None, ["oat"])],
                                  "text string, comparison_product string, search_terms array<string>")
    whole = answer_read(cookies, asked)
    assert {(r["text"], r["branch"], r["result_rows"]) for r in whole.rows.collect()} == {("a", "compare", 1), ("b", "search", 1)}


def test_fits_counts_rows_and_bytes(spark):
    few = spark.range(3).withColumn("x", F.repeat(F.lit("ab"), 100))
    assert fits(few) and not fits(few, rows=2) and not fits(few, size=300)


@pytest.fixture
def tested(monkeypatch):
    """How many pairs of intents and products each full test saw."""
    seen, matches = [], search._matches

    def counted(pairs, relaxed):
        seen.append(pairs.count())
        return matches(pairs, relaxed)

    monkeypatch.setattr(search, "_matches", counted)
    return seen


def test_search_by_blocks(products, intents, monkeypatch):
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 0)
    for size, first in ((8, 1), (500, 4)):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        monkeypatch.setattr(blocks, "FIRST_BLOCKS", first)
        assert answers(products, intents, 7, head_rows=8) == expected(products, intents, 7)


def hot_catalog(spark, count=4_000):
    """All products share a category and a long word; one in forty has a short rare one."""
    rows = spark.range(count).selectExpr(
        "CASE WHEN id % 7 = 0 THEN '' ELSE lpad(id, 6, '0') END AS code", "IF(id % 40 = 3, 'everlasting oat', 'everlasting bar') AS product_name",
        "'snack' AS categories", "array('en:snacks') AS categories_tags", "substring('abcde', 1 + CAST(id % 5 AS INT), 1) AS nutriscore_grade",
        "CAST(1 + id % 4 AS INT) AS nova_group", "CAST((id * 7919) % 600 AS DOUBLE) AS energy_kcal_100g",
        "CAST((id * 104729) % 40 AS DOUBLE) AS proteins_100g", "CAST(1 + id AS BIGINT) AS unique_scans_n")
    return normalize_products(rows).cache()


BOUNDS = "array<struct<nutrient:string,operator:string,value:double,unit:string>>"


def test_tight_bounds_in_a_hot_category_read_few_blocks(spark, monkeypatch, tested):
    hot = hot_catalog(spark)
    tight = [("energy_kcal_100g", "<=", 20.0, "kcal"), ("proteins_100g", ">=", 35.0, "g")]
    asked = spark.createDataFrame([("tight", "snacks", tight), ("all", None, tight)], f"text string, category string, nutrient_constraints {BOUNDS}")
    asked = asked.withColumn("nutrient_constraints", F.expr("transform(nutrient_constraints, c -> c)"))
    plain = answers(hot, asked, 7, head_rows=20)
    all_pairs = max(tested)
    assert all_pairs == 8_000  # both intents against every product
    tested.clear()
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 0)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 50)
    assert answers(hot, asked, 7, head_rows=20) == plain and plain
    visits = []
    planned = blocks.plan_visits
    monkeypatch.setattr(blocks, "plan_visits", lambda *a: visits.append(v := planned(*a)) or v)
    answers(hot, asked, 7, head_rows=20)
    assert visits[0].count() * 50 < all_pairs / 2  # rows of the blocks that may hold something
    assert sum(tested[1:]) < all_pairs / 10  # pairs that the full tests see, heads aside


def test_wide_bounds_stop_when_no_better_block_is_left(spark, monkeypatch, tested):
    hot = hot_catalog(spark)
    asked = spark.createDataFrame([("w", "snacks", [("proteins_100g", ">=", 1.0, "g")], ["bar"])],
                                  f"text string, category string, nutrient_constraints {BOUNDS}, search_terms array<string>")
    plain = answers(hot, asked, 7, head_rows=7)
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 0)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 50)
    tested.clear()
    assert answers(hot, asked, 7, head_rows=7) == plain and len(plain["w"]) == 7
    assert sum(tested) < 1_000


def test_the_rarest_text_is_the_probe(spark, tested):
    hot = hot_catalog(spark)
    asked = spark.createDataFrame([("q", "snacks", ["everlasting", "oat"])], "text string, category string, search_terms array<string>")
    assert len(answers(hot, asked, 250)["q"]) == 100
    assert max(tested) == 100  # the short rare word, not the category or the long word
    texts = spark.createDataFrame([(1, "word", "everlasting"), (1, "word", "oat"), (2, "word", "nothing"), (2, "tag", "snacks"), (3, "any", "")],
                                  "id int, kind string, pattern string")
    chosen, bridge, kinds = probes.choose_probes(search._catalog(hot), texts, "id")
    assert {tuple(r) for r in chosen.select("id", "kind", "pattern", "load").collect()} == {
        (1, "word", "oat", 100), (2, "word", "nothing", 0), (3, "any", "", 4_000)}
    assert kinds == ["any", "tag", "word"] and "nothing" not in {r["pattern"] for r in bridge.collect()}


def test_products_without_a_code_meet_their_own_probes(spark, monkeypatch):
    rows = [("", "red rice", "en:rice"), ("", "blue beans", "en:beans"), ("", "red rice", "en:rice"), ("1", "oat mix", "en:oats")]
    few = normalize_products(spark.createDataFrame(rows, "code string, product_name string, categories_tags string")
                             .withColumn("categories_tags", F.array("categories_tags"))).cache()
    asked = spark.createDataFrame([("r", "rice"), ("b", "beans")], "text string, category string")
    plain = answers(few, asked, 7)
    assert {k: len(v) for k, v in plain.items()} == {"r": 2, "b": 1}
    monkeypatch.setattr(probes, "fits", lambda df: False)
    assert answers(few, asked, 7) == plain
