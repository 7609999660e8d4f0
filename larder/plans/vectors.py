"""Vectors of texts and products: for the ranking, and the nearest rows of many vectors at once, exactly.

The nearest rows are found with pivots. A row lies in the cell of the pivot it
makes the smallest angle with, and a cell knows its largest angle. By the
triangle inequality of angles, a vector can be no nearer to a row of a cell than its
angle to the pivot less the cell's. So each query first looks into the cell of its own pivot;
the last of what it found there says which other cells it must look into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.ordering import first_rows
from larder.plans.joins import shuffle_parts, spread_join
from larder.session import cut_lineage

PIVOTS = 64
CELL_PART_ROWS = 5_000  # rows of a cell in one part, which meets queries in one task
QUERIES_PER_PART = 500  # queries that meet a part in one task
PLACES = 9  # equal to as many places are ties
_SLACK = 1e-9  # of angles, so that rounding cuts nothing


@dataclass(frozen=True)
class Vectors:
    """Ready-made vectors: ``texts(text, vector)`` and ``products(code, vector)``. Of repeated keys the smallest vector counts."""

    texts: DataFrame
    products: DataFrame


def add_vectors(queries: DataFrame, candidates: DataFrame, vectors: Vectors) -> tuple[DataFrame, DataFrame]:
    """Queries with ``query_vector``, candidates with ``product_vector``; NULL where there is none.

    Only the vectors of texts and codes that occur are shuffled on; hot codes are split.
    """
    texts = vectors.texts.groupBy("text").agg(F.min("vector").alias("query_vector"))
    asked = queries.join(texts, "text", "left")
    codes = candidates.filter("code <> ''").select("code").distinct()
    own = vectors.products.join(codes, "code", "left_semi").groupBy("code").agg(F.min("vector").alias("product_vector"))
    every = candidates.select("code").distinct().join(own, "code", "left")
    return asked, spread_join(candidates, every, ["code"], ["intent_id"]).drop("_part")


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, float) for v in vectors])
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norms > 0, norms, 1)[:, None]


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _assigned(pivots: np.ndarray, name: str, all_cells: bool):
    """The nearest pivot of each row and the angle to it, or the angles to all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            angles = _angle(_unit(frame["vector"]) @ pivots.T)
            if all_cells:
                yield pd.DataFrame({name: np.repeat(frame[name].to_numpy(), len(pivots)), "cell": np.tile(np.arange(len(pivots)), len(frame)), "angle": angles.ravel()})
            else:
                yield pd.DataFrame({name: frame[name], "vector": frame["vector"], "cell": angles.argmin(axis=1), "angle": angles.min(axis=1)})

    return run


def _met(limit: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids = rows["id"].to_numpy()
            cosines = np.round(np.clip(_unit(queries["vector"]) @ _unit(rows["vector"]).T, -1, 1), PLACES) + 0.0
            for i, query in enumerate(queries["query_id"]):
                other = np.flatnonzero(ids != query)
                best = other[np.lexsort((ids[other], -cosines[i][other]))[:limit]]
                out.append(pd.DataFrame({"query_id": query, "id": ids[best], "cosine": cosines[i][best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})

    return run


def _looked(visits: DataFrame, asked: DataFrame, placed: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """The best rows of each visited part of a cell, for each query that visits it."""
    visits = visits.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = visits.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)))
    groups = visits.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_PART).cast("int").alias("groups"))
    visits = visits.join(groups, ["cell", "part"]).withColumn("group", (F.col("group") % F.col("groups")).cast("int"))
    left = visits.select("query_id", "cell", "part", "group").join(asked, "query_id")
    right = placed.join(groups, ["cell", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    keys = ["cell", "part", "group"]
    grouped = left.groupBy(*keys).cogroup(right.select("id", "vector", *keys).groupBy(*keys))
    return grouped.applyInPandas(_met(limit), "query_id long, id long, cosine double")


def nearest(rows: DataFrame, queries: DataFrame, limit: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, id, rank, cosine): the ``limit`` rows with the largest cosine for each query, exactly.

    ``rows(id, vector)`` and ``queries(query_id, vector)`` have different whole ids; a query does not find the row with its own id. Ties (to nine
    places) go to the smaller id. Rows and queries without a vector are left out; a vector of zeros has cosine 0 to all. The cosines are computed in blocks of a part of
    a cell and the queries that visit it; the driver holds the pivots and a row per cell. No rows give no rows.
    """
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "query_id long, id long, rank int, cosine double")
    given = cut_lineage(rows.filter("vector is not null").select(F.col("id").cast("long").alias("id"), "vector"))
    asked = cut_lineage(queries.filter("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector"))
    drawn = given.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()  # a bounded list
    if not len(drawn):
        return nothing
    centres = _unit(drawn["vector"])
    kind = given.schema["vector"].dataType.simpleString()
    placed = given.mapInPandas(_assigned(centres, "id", False), f"id long, vector {kind}, cell int, angle double")
    placed = cut_lineage(placed)
    sizes = cut_lineage(placed.groupBy("cell").agg(F.max("angle").alias("widest"), F.ceil(F.count(F.lit(1)) / CELL_PART_ROWS).cast("int").alias("parts")))
    parts = F.broadcast(sizes.select("cell", "parts"))  # a row per pivot at most
    placed = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = cut_lineage(placed.repartition(shuffle_parts(rows), "cell", "part"))
    angles = asked.mapInPandas(_assigned(centres, "query_id", True), "query_id long, cell int, angle double")
    reach = angles.join(F.broadcast(sizes), "cell").withColumn("least", F.greatest(F.lit(0.0), F.col("angle") - F.col("widest")) - _SLACK)
    # A vector of zeros counts as a right angle to everything; the bound holds for it, as its cell is that wide.
    reach = cut_lineage(reach.select("query_id", "cell", "least", "angle"))
    own = reach.groupBy("query_id").agg(F.min_by("cell", F.struct("angle", "cell")).alias("cell"))
    first = cut_lineage(_looked(own, asked, placed, parts, limit))
    best = first_rows(first, ["query_id"], [F.col("cosine").desc(), F.col("id").asc()], limit, "rank")
    last = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("cosine"))
    bound = last.filter(F.col("n") >= limit).select("query_id", F.acos("cosine").alias("bound"))
    further = reach.join(own.withColumnRenamed("cell", "seen"), "query_id").filter("cell <> seen").join(bound, "query_id", "left")
    further = further.filter(F.col("bound").isNull() | (F.col("least") <= F.col("bound") + 1e-4)).select("query_id", "cell")
    found = first.unionByName(_looked(further, asked, placed, parts, limit))
    return first_rows(found, ["query_id"], [F.col("cosine").desc(), F.col("id").asc()], limit, "rank").select("query_id", "id", "rank", "cosine")
