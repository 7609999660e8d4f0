"""Written-out literals against Python's own reader."""

import ast
import json
import random

from pyspark.sql import functions as F

from larder.functions.literals import json_of_literal

RNG = random.Random(6)
TEXTS = ["", "L'huile d'olive", 'say "hi"', "back\\slash", "tab\tnew\nline", "é 😀  ", "a, b: [c] {d}", "None", "\x07\x0b\x1f", "it's \"both\"", "(x)", "\\'", "'"]


def some(depth):
    kind = RNG.randrange(8 if depth else 4)
    if kind < 3:
        return RNG.choice(TEXTS)
    if kind == 3:
        return RNG.choice([None, True, False, 0, -12, 3.5, 1e-7, 10**15])
    if kind < 6:
        return [some(depth - 1) for _ in range(RNG.randrange(4))]
    if kind == 6:
        return tuple(some(depth - 1) for _ in range(RNG.randrange(2, 4)))
    return {RNG.choice(TEXTS): some(depth - 1) for _ in range(RNG.randrange(3))}


BY_HAND = [
    "['a' 'b', \"c\"]", "['it\\'s', u'x']", "[1, 2,]", "[1, 2", "[1)", "[,]", "[1,,2]", "{'a': 1,}", "[a]", "[true]", "[null]", "['\\x41\\u00e9\\U0001F600\\101\\q']",
    "[01]", "[1_000, .5, 1., +3]", "['''long''']", "plain text", "", "  ['spaced']  ", "{'a': ['b', ('c', None)], 'd': {'e': \"f'g\"}}", "['a\nb']", "[ ]", "{}", "()", "['\\\nx']", "['a'] extra",
]


def read(text):
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        return None
    return json.loads(json.dumps(value)) if isinstance(value, (list, tuple, dict)) else None


def test_equals_pythons_reader(spark):
    texts = BY_HAND + [repr(some(4)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", json_of_literal(F.col("text")).alias("json")).collect()

    def loaded(x):
        try:
            return None if x is None else json.loads(x)
        except ValueError:
            return None  # from_json and parse_json give NULL too

    wrong = {texts[r["id"]]: (r["json"], read(texts[r["id"]])) for r in rows if loaded(r["json"]) != read(texts[r["id"]])}
    assert wrong == {}
    assert sum(read(t) is not None for t in texts) > 100


def test_texts_only(spark):
    row = spark.createDataFrame([("[1, True, 'x', None]",)], "t string").select(json_of_literal(F.col("t"), texts_only=True).alias("j")).first()
    assert json.loads(row["j"]) == [None, None, "x", None]


def test_long_literals_are_read(spark):
    # Every letter of a text was a step of the pattern's own stack, and every token copied the list of all before it.
    written = ["['" + "x" * 50_000 + "']", repr([["a", 1]] * 4_000), "[" * 40 + "'a'" + ",]" * 40, "[(]", "[')', ']']"]
    rows = spark.createDataFrame(list(enumerate(written)), "id int, text string").select("id", json_of_literal(F.col("text")).alias("json")).collect()
    for r in rows:
        assert (None if r["json"] is None else json.loads(r["json"])) == read(written[r["id"]])
