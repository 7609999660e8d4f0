"""An index of each probe's products in blocks, visited best first.

The products of a probe are ordered by grade and processing group, then along a
Z-order curve through the nutrients that intents bound, and cut into blocks of
equal size. A block keeps the least and largest amount of each nutrient and the
best order key of its products. An intent visits only blocks whose amounts its
bounds allow, best key first, a few blocks and then eight times as many each round. It is done when its list
is full at level 0 and no block that is left can hold a better product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import tables
from larder.operators.ordering import nutrition_heuristic
from larder.operators.predicates import within_limits
from larder.plans.joins import checked_join, spread_join
from larder.plans.places import add_places
from larder.plans.probes import PROBE, ROW
from larder.session import cut_lineage

BLOCK_ROWS = 500
CELLS = 16  # ranges of a nutrient that the curve tells apart, of equal counts
FIRST_BLOCKS = 4
GROWTH = 8
VISITS_PER_PART = 50  # intents that visit one block in one task


def bounded_nutrients(intents: DataFrame) -> list[str]:
    """The nutrients that any intent bounds."""
    asked = intents.agg(*[F.max(F.get("caps", F.lit(i)).isNotNull() | F.get("floors", F.lit(i)).isNotNull()).alias(n)
                          for i, n in enumerate(tables.NUTRIENTS)]).first()
    return [n for n in tables.NUTRIENTS if asked[n]]


def cell_edges(products: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Amounts that cut each nutrient into ranges of about equal counts; only the sizes of what is read depend on them."""
    if not names:
        return {}
    shares = [i / CELLS for i in range(1, CELLS)]
    row = products.agg(*[F.percentile_approx(F.col(n).cast("double"), shares).alias(n) for n in names]).first()
    return {n: row[n] or [] for n in names}


def z_code(edges: dict[str, list[float]]) -> Column:
    """The place on a Z-order curve: the bits of all nutrients' ranges in turn, highest first. Missing amounts are in the lowest range."""
    bits = (CELLS - 1).bit_length()
    cells = [reduce(lambda a, b: a + b, [F.when(F.col(n) > e, 1).otherwise(0) for e in own], F.lit(0)) for n, own in edges.items()]
    code = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for cell in cells:
            code = code * 2 + F.shiftright(cell, bit).bitwiseAND(F.lit(1))
    return code


def best_key() -> Column:
    """The part of the order that all intents share; smaller is better."""
    return F.struct((-F.col("grade_points")).alias("grade"), (-F.col("nova_points")).alias("nova"), (-F.col("heuristic")).alias("heuristic"))


def index_offers(offers: DataFrame, names: list[str]) -> DataFrame:
    """(probe, row key, amounts, ``block``) of each product of each probe; equal products once."""
    edges = cell_edges(offers, names)
    slim = offers.select(*PROBE, *ROW, "grade_points", "nova_points", nutrition_heuristic().alias("heuristic"), "present", *tables.NUTRIENTS)
    slim = slim.withColumn("_z", z_code(edges)).distinct()
    order = [F.col("grade_points").desc(), F.col("nova_points").desc(), F.col("_z").asc(), *[F.col(c).asc() for c in ROW]]
    placed = add_places(slim, PROBE, order, "_place")
    return cut_lineage(placed.withColumn("block", F.floor((F.col("_place") - 1) / BLOCK_ROWS)).drop("_z", "_place"))


def block_table(indexed: DataFrame) -> DataFrame:
    """A row per block: best key, least and largest amounts, and whether a nutrient is absent in any row."""
    ranges = []
    for i, n in enumerate(tables.NUTRIENTS):
        ranges += [F.min(n).alias(f"least_{i}"), F.max(n).alias(f"most_{i}"), F.max(~F.get("present", F.lit(i))).alias(f"absent_{i}")]
    return indexed.groupBy(*PROBE, "block").agg(F.min(best_key()).alias("best"), *ranges)


def may_hold() -> Column:
    """Whether a block's ranges leave room for a product within the intent's loosest limits."""
    tests = []
    for i in range(len(tables.NUTRIENTS)):
        cap, floor, absent = F.get("caps", F.lit(i)), F.get("floors", F.lit(i)), F.col(f"absent_{i}")
        tests.append(absent | cap.isNull() | F.coalesce(F.col(f"least_{i}") <= cap, F.lit(False)))
        tests.append(absent | floor.isNull() | F.coalesce(F.col(f"most_{i}") >= floor, F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def plan_visits(indexed: DataFrame, intents: DataFrame) -> DataFrame:
    """(intent, probe, block, limits, ``best``, ``turn``): the blocks each intent may find something in, best first."""
    asked = intents.select("intent_id", *PROBE, "caps", "floors")
    allowed = checked_join(block_table(indexed), asked, PROBE, ["block"]).filter(may_hold())
    turn = F.row_number().over(Window.partitionBy("intent_id").orderBy("best", "block"))
    return cut_lineage(allowed.select("intent_id", *PROBE, "block", "caps", "floors", "best").withColumn("turn", turn))


def visited_pairs(indexed: DataFrame, visits: DataFrame) -> DataFrame:
    """(intent_id, row key) of the products in visited blocks that the loosest limits let pass."""
    asked = visits.select("intent_id", *PROBE, "block", "caps", "floors")
    pairs = spread_join(asked, indexed, [*PROBE, "block"], ["intent_id"], VISITS_PER_PART, heavy=True)
    return pairs.filter(within_limits()).select("intent_id", *ROW)


def still_open(found: DataFrame, visits: DataFrame, limit: int, turn: int) -> DataFrame:
    """The intents that go on after ``turn``: a block is left, and its best key is not behind the last of a full list."""
    left = visits.filter(F.col("turn") == turn + 1).select("intent_id", "best")
    last = found.filter((F.col("level") == 0) & (F.col("candidate_rank") == limit))
    last = last.withColumn("heuristic", nutrition_heuristic()).select("intent_id", best_key().alias("_last"))
    told = left.join(last, "intent_id", "left")
    return told.filter(F.col("_last").isNull() | (F.col("_last") >= F.col("best"))).select("intent_id")
