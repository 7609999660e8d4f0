"""The place of every row in its group, however large the group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.plans.joins import shuffle_parts
from larder.session import cut_lineage


def add_places(df: DataFrame, group: list[str], order: list[Column], place: str = "place", parts: int | None = None) -> DataFrame:
    """All rows, with their place (from 1) in their group under ``order``.

    The rows are dealt by range of group and order, so a slice holds many small
    groups or a part of a large one, and no task sees more than a slice. A row's
    place is its place in the slice plus the group's rows in earlier slices. A
    slice begins in the middle of one group at most, so that table has a row
    per slice at most and is broadcast. The rows are stored twice and shuffled
    twice: pass the columns that are needed only. Rows with equal sort keys are
    told apart by a hash of the row; rows equal in every column have
    neighbouring places. NULL is a group of its own. No rows give no rows.
    """
    columns = df.columns
    # Stored before it is dealt: finding the ranges reads the rows once more.
    slim = cut_lineage(df.withColumn("_tie", F.xxhash64(*columns)))
    keys = [*order, F.col("_tie").asc()]
    dealt = slim.repartitionByRange(parts or shuffle_parts(df), *[F.col(g).asc() for g in group], *keys)
    sliced = cut_lineage(dealt.withColumn("_slice", F.spark_partition_id()))
    own = sliced.withColumn(place, F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*keys)).cast("long"))
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("_before", before).filter("_before is not null")
    later = later.select(F.col("_slice").alias("_at"), "_before", *[F.col(g).alias(f"_in_{g}") for g in group])
    same = F.col("_slice") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_in_{g}"))
    told = own.join(F.broadcast(later), same, "left")
    return told.select(*columns, (F.col(place) + F.coalesce("_before", F.lit(0))).alias(place))
