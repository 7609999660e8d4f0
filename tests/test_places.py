"""Places of rows in groups of any size, held against plain sorting."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.ordering import first_rows
from larder.plans.places import add_places


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_group_with_nearly_all_rows(spark):
    rows = [("hot", i * 7919 % 5_000, i) for i in range(5_000)] + [("cold", 1, 1), ("cold", 0, 2), (None, 3, 3), (None, 4, 4)]
    df = spark.createDataFrame(rows, "kind string, score int, id long")
    placed = add_places(df, ["kind"], [F.col("score").desc(), F.col("id").asc()], parts=16)
    want = []
    for kind in ("hot", "cold", None):
        own = sorted((r for r in rows if r[0] == kind), key=lambda r: (-r[1], r[2]))
        want += [(*r, at + 1) for at, r in enumerate(own)]
    assert rows_of(placed) == sorted(want, key=repr)
    # The windows run per slice of the range, so no task holds the hot group.
    dealt = df.repartitionByRange(16, "kind", F.col("score").desc(), "id").groupBy(F.spark_partition_id()).count()
    assert max(r[1] for r in dealt.collect()) < 1_000


def test_no_group_ties_and_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (0, "d")]
    df = spark.createDataFrame(rows, "score int, name string")
    placed = add_places(df, [], [F.col("score").desc(), F.col("name").asc()], "rank", parts=3)
    assert rows_of(placed.select("rank", "score", "name")) == [(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 0, "d"), (5, None, "c")]
    # Ties in the order alone still give every place once, and the same ones again.
    loose = add_places(df, [], [F.col("score").desc()], "rank", parts=3)
    assert sorted(r["rank"] for r in loose.collect()) == [1, 2, 3, 4, 5]
    again = add_places(df.repartition(4, "name"), [], [F.col("score").desc()], "rank", parts=2)
    assert rows_of(loose) == rows_of(again)


def test_empty_and_constant_order(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL("kind string, score int"))
    assert add_places(empty, ["kind"], [F.col("score").asc()]).collect() == []
    df = spark.createDataFrame([("x", 2), ("x", 1)], "kind string, score int")
    placed = add_places(df, ["kind"], [F.when(F.lit(False), F.col("score")).asc(), F.col("score").asc()])
    assert rows_of(placed) == [("x", 1, 1), ("x", 2, 2)]


def test_first_rows_beyond_sparks_own_limit(spark):
    rows = [("hot", i * 7919 % 5_003, i) for i in range(5_000)] + [("cold", 1, 1), ("cold", 0, 2)]
    df = spark.createDataFrame(rows, "kind string, score int, id long")
    order = [F.col("score").asc(), F.col("id").desc()]
    got = first_rows(df, ["kind"], order, 2_000)
    want = []
    for kind in ("hot", "cold"):
        own = sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1], -r[2]))[:2_000]
        want += [(*r, at + 1) for at, r in enumerate(own)]
    assert rows_of(got) == sorted(want, key=repr)
    assert got._jdf.queryExecution().executedPlan().toString().count("_cut") > 0
