"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
INVENTORY = {"A": 10, "B": 16, "C": 15, "D": 8, "E": 28, "F": 9, "G": 20, "H": 7}
# All of them take minutes; CHECK_ALL=1 runs them.
SOME = ["A5_nutrient_from_list", "B14_normalize", "C11_search_one", "D4_strict_order", "E22_annotate",
        "F5_relaxation_ladder", "G18_score", "H7_recommend"]
NAMES = list(entry.queries()) if os.environ.get("CHECK_ALL") else SOME


def test_every_inventory_id_is_registered():
    ids = {name.split("_")[0] for name in QUERIES}
    assert ids == {f"{letter}{i}" for letter, count in INVENTORY.items() for i in range(1, count + 1)}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    result = duck.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = [tuple(row[i] for i in order) for row in result.fetchall()]
    plain = lambda rows: sorted(map(repr, [
        tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row) for row in rows]))
    assert plain(got) == plain(want)
