"""What makes one product better than another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import tables
from larder.functions.numbers import percent_text
from larder.functions.text import literal_map


def _less(own: Column, other: Column, label: str) -> Column:
    share = (own - other) / own * 100.0
    shown = (own > 0) & (other != 0) & (share >= 20.0)
    return F.when(shown, F.concat(percent_text(share), F.lit(f"% less {label}")))


def _more(own: Column, other: Column, label: str) -> Column:
    share = (other - own) / own * 100.0
    better = (other != 0) & (own.isNull() | (other > own * 1.20))
    return F.when(
        better,
        F.when(own > 0, F.concat(percent_text(share), F.lit(f"% more {label}"))).otherwise(F.lit(f"Higher {label}")),
    )


def improvements(own: str = "ref_", other: str = "") -> Column:
    """What the other product does better; column names carry the given prefixes."""
    mine, theirs = (lambda n: F.col(own + n)), (lambda n: F.col(other + n))
    points = lambda g: F.coalesce(F.try_element_at(literal_map(tables.GRADE_QUALITY), g), F.lit(0.0))
    grade = F.when(
        points(theirs("nutriscore")) > points(mine("nutriscore")),
        F.concat(F.lit("Better Nutri-Score ("), F.upper(theirs("nutriscore")), F.lit(" vs "),
                 F.upper(F.coalesce(mine("nutriscore"), F.lit("?"))), F.lit(")")),
    )
    less = [_less(mine(n), theirs(n), label) for n, label in tables.LESS_IS_BETTER]
    more = [_more(mine(n), theirs(n), label) for n, label in tables.MORE_IS_BETTER]
    my_nova, their_nova = mine("nova_group"), theirs("nova_group")
    nova = F.when(
        (their_nova != 0) & (their_nova < my_nova),
        F.concat(F.lit("Less processed (NOVA "), their_nova.cast("string"), F.lit(" vs "),
                 my_nova.cast("string"), F.lit(")")),
    )
    fewer = mine("additives_count") - theirs("additives_count")
    additives = F.when(fewer > 0, F.concat(fewer.cast("string"), F.lit(" fewer additive(s)")))
    return F.array_compact(F.array(grade, *less, *more, nova, additives))
