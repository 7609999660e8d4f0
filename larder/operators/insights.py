"""Health profile of every product: score, class, risks, positives, one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.functions.text import literal_map, strings


def _grade_line() -> Column:
    return F.concat(F.lit("Nutri-Score "), F.upper("nutriscore"))


def _over(levels, test) -> list[Column]:
    return [F.when(test(F.col(name), F.lit(limit)), F.lit(text)) for name, limit, text in levels]


def _by_nova(lines: dict[int, str]) -> Column:
    return F.try_element_at(literal_map(lines), F.col("nova_group").cast("string"))


def _risky_additives() -> Column:
    """Flagged additives in the product's order, repeats kept."""
    return F.filter("additives", lambda a: a.isin(tables.RISKY_ADDITIVES))


def _good_labels() -> Column:
    contains_any = lambda label: F.exists(strings(tables.GOOD_LABELS), lambda g: F.contains(label, g))
    return F.filter("labels", contains_any)


def risk_indicators() -> Column:
    poor_grade = F.when(F.col("nutriscore").isin("c", "d", "e"), _grade_line())
    high = _over(tables.HIGH_LEVELS, lambda amount, limit: amount > limit)
    additives = F.transform(_risky_additives(), lambda a: F.concat(F.lit("Contains additive "), a))
    return F.concat(F.array_compact(F.array(poor_grade, _by_nova(tables.NOVA_RISK), *high)), additives)


def positive_indicators() -> Column:
    good_grade = F.when(F.col("nutriscore").isin("a", "b"), _grade_line())
    good = _over(tables.GOOD_LEVELS, lambda amount, limit: amount >= limit)
    labels = F.transform(
        _good_labels(),
        lambda label: F.concat(F.lit("Labelled: "), F.initcap(F.replace(label, F.lit("-"), F.lit(" ")))),
    )
    return F.concat(F.array_compact(F.array(good_grade, _by_nova(tables.NOVA_POSITIVE), *good)), labels)


def health_score() -> Column:
    """Whole-number score around 5."""
    grade = F.try_element_at(literal_map(tables.GRADE_INSIGHT), F.col("nutriscore")) - 2
    nova = F.try_element_at(literal_map(tables.NOVA_PENALTY), F.col("nova_group").cast("string"))
    score = F.lit(5) + F.coalesce(grade, F.lit(0)) - F.coalesce(nova, F.lit(0))
    for name, limit, _ in tables.HIGH_LEVELS:
        score -= F.coalesce((F.col(name) > limit).cast("int"), F.lit(0))
    for name, limit, _ in tables.GOOD_LEVELS:
        score += F.coalesce((F.col(name) >= limit).cast("int"), F.lit(0))
    return score - F.size(_risky_additives()) + F.size(_good_labels())


def health_class(score: Column) -> Column:
    label = F.lit(tables.LOWEST_CLASS)
    for floor, name in reversed(tables.CLASS_FLOORS):
        label = F.when(score >= floor, F.lit(name)).otherwise(label)
    return label


def summary_sentence() -> Column:
    """One sentence from the class, the first positive or the first risks."""
    name, label = F.col("name"), F.col("health_class")
    risks, positives = F.col("risk_indicators"), F.col("positive_indicators")
    listed = lambda n: F.lower(F.array_join(F.slice(risks, 1, n), ", "))
    concerns = lambda n, none: F.when(F.size(risks) > 0, listed(n)).otherwise(F.lit(none))
    tail = lambda lead, items: F.when(
        F.size(items) > 0, F.concat(F.lit(lead), F.lower(F.try_element_at(items, F.lit(1))))
    ).otherwise(F.lit(""))
    return (
        F.when(label == "Excellent", F.concat(
            name, F.lit(" has an excellent nutritional profile"), tail(" with ", positives), F.lit(".")))
        .when(label == "Good", F.concat(
            name, F.lit(" is generally a good nutritional choice"), tail(" though note: ", risks), F.lit(".")))
        .when(label == "Moderate", F.concat(
            name, F.lit(" has moderate nutritional quality due to "),
            concerns(2, "some nutritional concerns"), F.lit(".")))
        .otherwise(F.concat(
            name, F.lit(" raises health concerns: "), concerns(3, "poor nutritional profile"), F.lit(".")))
    )


def add_insights(products: DataFrame) -> DataFrame:
    """Add the health columns; one narrow pass."""
    lists = products.withColumns({
        "health_score": health_score(),
        "risk_indicators": risk_indicators(),
        "positive_indicators": positive_indicators(),
    })
    return lists.withColumn("health_class", health_class(F.col("health_score"))).withColumn(
        "summary", summary_sentence()
    )
