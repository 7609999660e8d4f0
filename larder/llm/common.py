"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Parts of the rows by a checksum of their id, for held-out tests.
FOLDS = 5

SIEVE = 1 << 22  # places of the filter that goes out before a join, half a megabyte at any size


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if SQL can express it."""

    def register(made: Query) -> Query:
        QUERIES[name] = made
        if sql is not None:
            ORACLES[name] = sql
        return made

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (``spark.checkpoint.dir``)."""
    spark_context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or spark_context.getConf().get("spark.checkpoint.dir")
    if base is None:
        cut_lineage(spark.range(1))  # sets a folder of its own in a local session, raises on a cluster
        base = spark_context.getCheckpointDir()
    return f"{base.rstrip('/')}/larder-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back, so no later job computes them again."""
    place = shared_folder(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _through(words: Broadcast):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch["_place"].to_numpy()
            yield batch.filter(pa.array((words.value[place >> 6] >> (place & 63)) & 1 == 1))

    return go


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``wanted``, and a few more: what a filter of fixed size lets through.

    For rows with wide columns that meet few keys: the others stay out of the shuffle of the join that follows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    found = wanted.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    words = np.zeros(SIEVE // 64, np.int64)  # as many numbers at most come to the driver
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    placed = rows.filter(F.col(key).isNotNull()).withColumn("_place", place)
    return placed.mapInArrow(_through(rows.sparkSession.sparkContext.broadcast(words)), placed.schema).drop("_place")


def drawn(rows: DataFrame, count: int, *key: str) -> DataFrame:
    """About ``count`` of the rows, or all if there are fewer, chosen by a hash of their key."""
    every = -(-rows.count() // count) or 1
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(every)) == 0)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the constant first; a small ridge keeps them finite."""
    x = np.column_stack([np.ones(len(features)), features])
    weights = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(weights))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def probability(weights: np.ndarray, columns: list[Column]) -> Column:
    """The fitted probability as an expression."""
    total = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], columns):
        total = total + F.lit(float(w)) * c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
