"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larder.llm import resampling as R

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_random = np.random.default_rng(9)


def prose(n):
    return " ".join(_random.choice(["the", "of", "River", "stone", "Été", "x2", "no-one", "日本語のテキスト", "ÀÉ"], n))


TEXTS = [None, "", " .. ", "one", "Two WORDS", prose(19), prose(20), prose(400), prose(3_000), "é" * 40_000, "word " * 25, "word " * 25, "a_b`c{d}e\x7ff",
         "z" * 64 + " " + "z" * 65 + " ok", *[prose(30) + f" tail{i} {_random.integers(9**9)}" for i in range(40)]]
TARGET = [None, "the river of stone", prose(50), "tail1 unseen words here"]


def brute(rows, target, longest, percent=10):
    def found(text):
        words = WORD.findall((text or "").translate(ASCII).encode())
        return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    own = [(i, *found(t)) for i, t in rows]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in found(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000.0) / ((s[b] + 1.0) * (big_t + 10_000.0))))
    out = {}
    for i, n, f in own:
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out[i] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in out if out[i][0] >= 20), key=lambda i: (-out[i][3], i))
    for rank, i in enumerate(able[: len(able) * percent // 100]):
        out[i][4] = rank + 1
    return out


@pytest.mark.parametrize("longest, head, pairs", [(1, R.HEAD_WORDS, R.HEAD_PAIRS), (3, 5, 3), (2, 0, 0)])
def test_equals_brute_force(spark, longest, head, pairs):
    documents = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, weight string, place int").repartition(3)
    target = spark.createDataFrame([(t, "x") for t in TARGET], "text string, doc_id string")
    got = R.resample(documents, target, percent=30, longest=longest, head_words=head, head_pairs=pairs).collect()
    want = brute(list(enumerate(TEXTS)), TARGET, longest, 30)
    assert {r["doc_id"]: [r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got} == want
    assert len(got) == len(TEXTS)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: [r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in R.op12(spark, folder).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got == brute(rows, [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 1)


def test_missing_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, prose(30)), (None, prose(30)), (7, TEXTS[8]), (7, TEXTS[8]), (7, prose(25)), (8, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    nothing = documents.limit(0)
    got = R.resample(documents, nothing, percent=100).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert R.resample(nothing, documents).collect() == []


def test_crcs_go_on():
    data = np.frombuffer(b"riverstone" * 30, np.uint8)
    first = np.array([zlib.crc32(b"abc"), 0], np.uint32)
    got = R.crc_from(first, data, np.array([0, 5]), np.array([5, 300]))
    assert got.tolist() == [zlib.crc32(b"abcriver"), zlib.crc32(bytes(data[5:300]))]
    both = R.shifted(first[:1], np.array([5])) ^ np.uint32(zlib.crc32(b"river"))
    assert both[0] == zlib.crc32(b"abcriver")
