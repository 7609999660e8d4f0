"""Text and number expressions against plain Python."""

import random
import re

from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions.numbers import number_text, round3


def test_rounding_and_printing_match_python(spark):
    rng = random.Random(3)
    values = [0.0, 0.2875, 5.75 * 1.15, 2.675, 1000.0, 999999.5, 1e6, 1e-4, 0.5, 300.0]
    values += [rng.choice([rng.random() * 10, round(rng.random() * 10, 4), rng.randrange(10**6) / 8]) for _ in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", round3(F.col("x")).alias("r"), number_text(F.col("x")).alias("g")).collect()
    assert [r.r for r in rows] == [round(r.x, 3) for r in rows]
    assert [r.g for r in rows] == ["%g" % r.x for r in rows]


def test_fold_accents(spark):
    rows = spark.createDataFrame([("Céréales ﬁbre Ångström œuf",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.fold_accents(F.col("t"))).collect()] == [
        "Cereales fibre Angstrom œuf", "plain", None]


def test_marked_phrases_equal_word_bounded_patterns(spark):
    rng = random.Random(5)
    words = ["sans", "sucre", "ajoute", "sucres", "en", "cas", "en-cas", "no", "palm", "oil,", "7g"]
    pairs = [("sans sucre ajoute", "zero added sugar"), ("en-cas", "snacks"), ("sans sucre", "zero sugar"), ("en", "in")]
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(300)]
    swapped = X.unmark(X.swap_phrases(X.mark_words(F.col("t")), X.swaps(pairs)))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(swapped).collect()]
    for text, result in zip(texts, got):
        for old, new in pairs:
            text = re.sub(rf"\b{re.escape(old)}\b", new, text)
        assert result == text
