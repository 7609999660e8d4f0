"""How much the operators hold in a Python worker at once."""

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import chunks, divergence, jaccard, kernel, pieces, repeats, tiling

TABLE = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "lang": ["en"] * 60, "text": [f"word{k} and more " * 2_000 for k in range(60)]})


@pytest.mark.parametrize("run", [repeats._anchors(100, 24, True), divergence._language_counts, jaccard._classify(5)])
def test_hashes_are_made_for_small_slices(run, monkeypatch):
    sizes, init = [], kernel.Text.__init__
    monkeypatch.setattr(kernel.Text, "__init__", lambda self, data, *more, **named: sizes.append(len(data)) or init(self, data, *more, **named))
    for _ in run(iter([TABLE])):
        pass
    assert max(sizes) <= 500_000 and np.unique(sizes).size > 1


def test_texts_go_to_the_workers_once(spark):
    rows = {(1, "en", "some words"), (2, "en", None), (3, None, "more words")}
    documents = spark.createDataFrame(sorted(rows, key=str), "doc_id long, lang string, text string")
    judged = divergence.quality_rules(documents)
    assert {(r["doc_id"], r["lang"], r["text"]) for r in judged.collect()} == rows
    below = judged._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1]
    assert "AS _keep_0" in below and re.search(r"text#\d+ AS _keep_", below) is None


def test_only_listed_elements_become_rows(spark):
    """Sets that share half of their elements: of the others, nobody else's, none is listed, and of the shared ones a fifth at most."""
    made, batches = np.arange(1, 101, dtype=np.uint64), []
    sets = [np.sort(kernel.mix(np.append(made[:50], made[50:] + np.uint64(1000 * k)))) for k in range(1, 61)]
    rows = [(k, len(x), k, x.view(np.int64).tolist(), [0] * (jaccard.SIGN_BITS // 64)) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "class long, n int, label long, shingles array<long>, bits array<long>")
    cut, jaccard.cut_lineage = jaccard.cut_lineage, lambda df: batches.append(cut(df)) or batches[-1]
    try:
        pairs = jaccard._rare_pairs(frame.select("class", "label"), frame.drop("label"), 80).collect()
    finally:
        jaccard.cut_lineage = cut
    assert pairs == [] and batches[0].count() < 60 * 2
    # two that are linked are found, whatever shares a place
    again = frame.unionByName(frame.filter("class = 7").selectExpr("1007L class", "n", "1007L label", "shingles", "bits"))
    found = {(r["a"], r["b"]) for r in jaccard._rare_pairs(again.select("class", "label"), again.drop("label"), 80).collect()}
    assert (7, 1007) in found


def test_counts_of_elements_are_a_row_for_each_block():
    """A task whose elements fall on very many places sends a row for each block of them; their sums are exact."""
    sets = [np.arange(k, 400_000, 7, dtype=np.int64) for k in range(7)] + [np.arange(1_000, dtype=np.int64)]
    tasks = [[pa.RecordBatch.from_pydict({"shingles": [x]}) for x in part] for part in (sets[:4], sets[4:])]
    rows = [b for part in tasks for b in jaccard._count_elements(iter(part))]
    assert sum(b.num_rows for b in rows) <= 2 * jaccard.PLACES // jaccard.BLOCK < 1_000
    found = {r["block"]: r["levels"] for b in jaccard._levels(iter(rows)) for r in b.to_pylist()}
    levels = np.concatenate([np.frombuffer(found[k], np.uint8) for k in sorted(found)])
    assert (levels[:1_000] == 4).all() and not levels[1_000:].any()


def test_index_hashes_small_slices_and_marks_all_but_the_first(monkeypatch):
    sizes, init = [], kernel.Text.__init__
    monkeypatch.setattr(kernel.Text, "__init__", lambda self, data, *more, **named: sizes.append(len(data)) or init(self, data, *more, **named))
    rng = np.random.default_rng(5)
    pieces = [rng.integers(0, 256, 400, dtype=np.uint8).tobytes() for _ in range(3_000)]
    docs, starts = np.append(np.arange(3_000), [9_000, 5_000]), np.append(np.zeros(3_000, np.int64), [20, 7])
    out = repeats._indexed(docs, starts, pa.array([*pieces, pieces[11], pieces[12]], pa.binary()), 100)
    assert out.to_pylist() == [{"doc_id": 5_000, "a": 7, "b": 407}, {"doc_id": 9_000, "a": 20, "b": 420}]
    assert max(sizes) <= kernel.HASH_SLICE_BYTES
    # one id with different texts, whose pieces overlap: the window at the smaller place is the first
    again = repeats._indexed(np.array([1, 1]), np.array([10, 20]), pa.array([b"x" * 30 + pieces[0][:100], pieces[0][:100]], pa.binary()), 100)
    assert again.to_pylist() == [{"doc_id": 1, "a": 40, "b": 140}]


def _tiles():
    return tiling._tiled(SimpleNamespace(value=tiling.Block([(1, "some words of an item")], 4, 0.5)), 4, 0.5, "long")


@pytest.mark.parametrize("run", [_tiles, lambda: pieces._encode(pieces.default_vocabulary())], ids=["tiling", "pieces"])
def test_texts_are_tiled_and_encoded_in_small_slices(run, monkeypatch, spark):
    sizes, init = [], kernel.Text.__init__
    batch = pa.RecordBatch.from_pydict({"_keep_0": TABLE["doc_id"], "_text": TABLE["text"], "_found": [None] * 60, "_words": [0] * 60})
    go = run()
    monkeypatch.setattr(kernel.Text, "__init__", lambda self, data, *more, **named: sizes.append(len(data)) or init(self, data, *more, **named))
    assert sum(b.num_rows for b in go(iter([batch]))) == 60
    assert max(sizes) <= 550_000


@pytest.mark.parametrize("other", [lambda: divergence._language_counts, lambda: jaccard._classify(5), _tiles], ids=["counts", "classes", "tiling"])
def test_a_worker_gives_the_chunks_back_when_other_work_begins(other, spark):
    path = pieces.default_vocabulary()
    texts = pa.RecordBatch.from_pydict({"_text": [" ".join(f"word{17 * k + j}" for j in range(300)) for k in range(40)]})
    encode = lambda: [b["ids"].to_pylist() for b in pieces._encode(path)(iter([texts]))]
    before, memory = encode(), pieces._memory(path)
    assert len(memory.keys) > 900
    batch = pa.RecordBatch.from_pydict({"doc_id": TABLE["doc_id"], "lang": TABLE["lang"], "text": TABLE["text"], "_keep_0": TABLE["doc_id"],
                                        "_text": TABLE["text"], "_found": [None] * 60, "_words": [0] * 60})
    for _ in other()(iter([batch])):
        pass
    assert not len(memory.keys) and sum(x.nbytes for x in memory.pools.values()) < 1_000_000
    assert encode() == before
