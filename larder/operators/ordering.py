"""Order of search candidates, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import tables


def grade_points(raw_grade: Column) -> Column:
    """a to e as 5 to 1, anything else 0."""
    points = F.lit(0)
    for grade in tables.GRADES:
        points = F.when(F.lower(raw_grade) == grade, F.lit(int(tables.GRADE_QUALITY[grade]))).otherwise(points)
    return F.when(raw_grade.isNull(), F.lit(0)).otherwise(points)


def nova_points(nova: Column) -> Column:
    return F.coalesce(F.lit(5.0) - nova, F.lit(0.0))


def nutrition_heuristic() -> Column:
    """Rough nutrition value used to order candidates; missing amounts count as 0."""
    amount = lambda name, cap: F.least(F.coalesce(F.col(name), F.lit(0.0)), F.lit(cap))
    kcal = F.col("energy_kcal_100g")
    light = F.when(kcal <= 250, F.lit(2)).when(kcal <= 400, F.lit(1)).otherwise(F.lit(0))
    return (
        amount("proteins_100g", 25.0) * F.lit(0.6)
        - amount("sugars_100g", 30.0) * F.lit(0.35)
        - amount("sodium_100g", 1.5) * F.lit(10.0)
        + light
    )


# The columns that candidates are ordered by.
ORDERED_BY = [
    "grade_points", "nova_points", "energy_kcal_100g", "proteins_100g", "sugars_100g", "sodium_100g", "fiber_100g", "unique_scans_n",
    "name_text",
]


def candidate_order(kids: Column | bool, strict: Column | bool) -> list[Column]:
    """Sort keys of search candidates.

    ``kids`` and ``strict`` (a health preference, a bound or a dietary tag is
    asked for) switch keys on; as columns they switch them per row. The product
    code breaks the remaining ties, so the order is total.
    """
    kids, strict = (F.lit(flag) if isinstance(flag, bool) else flag for flag in (kids, strict))
    amount = lambda name, missing: F.coalesce(F.col(name), F.lit(missing))
    return [
        F.col("grade_points").desc(),
        F.col("nova_points").desc(),
        nutrition_heuristic().desc(),
        F.when(kids, amount("sugars_100g", 9999.0)).asc(),
        F.when(strict, amount("proteins_100g", 0.0)).desc(),
        F.when(strict, amount("fiber_100g", 0.0)).desc(),
        F.when(strict, amount("sugars_100g", 9999.0)).asc(),
        F.when(strict, amount("sodium_100g", 9999.0)).asc(),
        F.coalesce(F.col("unique_scans_n"), F.lit(0)).desc(),
        F.col("name_text").asc(),
        F.col("code").asc(),
    ]


def page_limit(limit: int | None, max_results: int | None, page_size: int = 20) -> int:
    """The limit asked for, else the result count, else the page size (1 to 250)."""
    return limit or max_results or max(1, min(page_size, 250))


GROUP_LIMIT = 1000  # rows up to which Spark itself cuts groups down in each task
GROUP_PARTS = 64  # parts a group is cut down in first beyond that


def first_rows(df: DataFrame, group: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows per group, numbered from 1.

    The limit sits right on the window, so Spark cuts every group down in each
    task before it shuffles: a group of any size sends ``limit`` rows per task.
    Spark does so for limits up to a thousand. Beyond, the rows of a group are cut down in parts first, by
    a hash of the row, so that no task sorts a whole group.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    if limit > GROUP_LIMIT:
        hashed = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
        part = Window.partitionBy(*group, "_cut").orderBy(*order)
        cut = df.withColumn("_cut", F.pmod(F.xxhash64(*hashed), F.lit(GROUP_PARTS)))
        df = cut.withColumn("_cut_place", F.row_number().over(part)).filter(F.col("_cut_place") <= limit).drop("_cut", "_cut_place")
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)
