"""Joins that stay balanced: size-checked broadcasts, split hot keys, substring matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import cut_lineage

# Rows up to which a side may be broadcast, after counting them.
BROADCAST_ROWS = 20_000
# Bytes (written out as JSON) up to which those rows may be broadcast.
BROADCAST_BYTES = 32_000_000
# Rows of one key that may meet in one task before the key is split.
ROWS_PER_PART = 500_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the table has at most this many rows and bytes; counting stops right after the rows."""
    counted = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("_bytes")).limit(rows + 1)
    found = counted.agg(F.count(F.lit(1)), F.sum(F.col("_bytes").cast("long"))).first()
    return found[0] <= rows and (found[1] or 0) <= size


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all shuffle partitions, for work that is heavy per row.

    Adaptive execution sizes partitions by bytes; a count of its own keeps it from
    putting few bytes but much work into one task.
    """
    return df.repartition(shuffle_parts(df), *keys)


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], split_by: list[str], rows_per_part: int | None = None,
    heavy: bool = False,
) -> DataFrame:
    """Equi-join in which a key with very many ``big`` rows is split into parts.

    The parts come from counted loads, so ``small`` is repeated for hot keys
    only. The part of a row is a hash of ``split_by``: the same row lands in
    the same part when a lost task is run again. The load table has at most
    rows(big) / rows_per_part rows; it is stored, and broadcast if it is counted to be small.
    ``heavy`` says that the joined rows are few bytes but much work.
    Keeps the column ``_part``: windows over the keys plus finer columns can
    include it and need no second shuffle.
    """
    per_part = rows_per_part or ROWS_PER_PART
    loads = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > per_part)
    parts = cut_lineage(loads.select(*keys, F.ceil(F.col("_rows") / per_part).cast("int").alias("_parts")))
    parts = F.broadcast(parts) if fits(parts) else parts
    part_of = F.pmod(F.xxhash64(*split_by), F.coalesce("_parts", F.lit(1))).cast("int")
    left = big.join(parts, keys, "left").withColumn("_part", part_of).drop("_parts")
    right = (
        small.join(parts, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    if heavy:
        # Adaptive execution would broadcast a side of few bytes and leave the other where it lay, in a few uneven tasks.
        left, right = evenly(left, *keys, "_part"), right.hint("merge")
    return left.join(right, [*keys, "_part"])


def checked_join(big: DataFrame, small: DataFrame, keys: list[str], split_by: list[str]) -> DataFrame:
    """Broadcast ``small`` if it is counted to be small, else a :func:`spread_join`."""
    if fits(small):
        return big.join(F.broadcast(small), keys).withColumn("_part", F.lit(0))
    return spread_join(big, small, keys, split_by)


def grams(text: Column, size: int) -> Column:
    """All different pieces of ``size`` characters; empty for shorter texts."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    pieces = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def substring_pairs(terms: DataFrame, patterns: DataFrame) -> DataFrame:
    """All (kind, term, pattern) where the term contains the pattern, without a cross join.

    ``terms(kind, term)`` and ``patterns(kind, pattern)`` hold distinct rows. A
    pattern is looked up under its rarest three-letter piece (or itself, when it
    is shorter); every term that contains the pattern contains that piece.
    """
    term_grams = terms.select(
        "kind", "term", F.explode(F.concat(*[grams(F.col("term"), n) for n in (1, 2, 3)])).alias("gram")
    )
    own = F.when(F.length("pattern") >= 3, grams(F.col("pattern"), 3)).otherwise(F.array("pattern"))
    pattern_grams = patterns.select("kind", "pattern", F.explode(own).alias("gram"))
    counts = term_grams.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        pattern_grams.join(counts, ["kind", "gram"])
        .groupBy("kind", "pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    )
    return (
        term_grams.join(rarest, ["kind", "gram"])
        .filter(F.contains(F.col("term"), F.col("pattern")))
        .select("kind", "term", "pattern")
    )
