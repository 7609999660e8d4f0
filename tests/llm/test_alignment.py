"""Two tokenizers over the same bytes, against plain loops over whole texts."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larder.llm import alignment as A
from larder.llm import chunks, kernel

_random = np.random.default_rng(11)
LETTERS = list("abcdeé ßñ  \n\t.,;'’-0123中文😀  　​\x85\x1c\r") + ["the ", " a", "ing", "<0x0A>", "<|endoftext|>", "<s>", "\x00", "́", "  ", "   "]
MIXED = ["".join(_random.choice(LETTERS, _random.integers(1, 60))) for _ in range(300)]
TEXTS = [
    None, "", " ", "  ", "\n", "a", "the the the", "see <|endoftext|> here", "one▁two", "<s> and </s> <unk> <0x41>", "x" * 5_000, "ab " * 4_000, " ends ", "tab\tand\nline",
    "naïve café — 中文 😀", *MIXED, *MIXED[:40],
]


@pytest.fixture(scope="module")
def plain():
    byte = Tokenizer.from_file(A.default_tokenizer())
    byte.encode_special_tokens = True
    names = {i: t for t, i in byte.get_vocab().items()}
    letters = A.byte_letters()
    piece = sentencepiece.SentencePieceProcessor(model_file=A.default_vocabulary())

    def piece_bytes(i):
        p = piece.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(text):
        a = byte.encode(" " + text, add_special_tokens=False).ids
        b = piece.encode(text)
        both = [bytes(letters[c] for c in names[i]) for i in a], [piece_bytes(i) for i in b]
        return (a, b, *both) if b"".join(both[0]) == b"".join(both[1]) == (" " + text).encode() else ([], [], [], [])

    def brute(texts):
        out, held = [], Counter()
        for text in texts:
            a, b, a_bytes, b_bytes = tokens(text) if text else ([], [], [], [])
            a_ends, b_ends = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
            links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                     if a_ends[i] - len(a_bytes[i]) < b_ends[j] and b_ends[j] - len(b_bytes[j]) < a_ends[i]] if len(a) < 500 else None
            if links is None:  # the same by one pass, for long texts
                links, j = [], 0
                for i in range(len(a)):
                    while b_ends[j] <= a_ends[i] - len(a_bytes[i]):
                        j += 1
                    links += [(a[i], b[k]) for k in itertools.takewhile(lambda k: b_ends[k] - len(b_bytes[k]) < a_ends[i], range(j, len(b)))]
            common, groups, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
            for end in common:
                k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
                groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
                i, j = k, m
            out.append((len(a), len(b), len(groups), ";".join(groups), links))
            held.update(set(links))
        best = defaultdict(int)
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        return [(na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                 hashlib.sha256(g.encode()).hexdigest() if na else "") for na, nb, ng, g, links in out]

    return brute


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [0, 50, A.HEAD_PAIRS])
def test_query_equals_brute_force(spark, plain, tmp_path, monkeypatch, head):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, groups string, pairs string, n_a int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(A.add_counts, "__defaults__", (head,))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.op13(spark, str(tmp_path)).collect()}
    want = plain(TEXTS)
    assert {i: w for i, w in enumerate(want) if got[i] != w} == {}
    assert len(got) == len(TEXTS)
    assert sum(w[0] > 0 for w in want) > 250


def test_whole_table_equals_brute_force(spark, plain):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.op13(spark, folder).collect()}
    assert got == dict(zip([i for i, _ in rows], plain([t for _, t in rows])))


def test_missing_and_repeated_ids_and_empty_table(spark, plain, tmp_path):
    texts = ["river stone", "river stone", None, "river, stone"]
    df = spark.createDataFrame(list(zip([None, 5, 5, 5], texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in A.op13(spark, str(tmp_path)).collect())
    assert got == sorted(plain(texts))
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert A.op13(spark, f"{tmp_path}/none").collect() == []


def test_chunks_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(kernel.Text, "hashes", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    memory = chunks.Memory(lambda texts: [[ord(c) for c in t] for t in texts])
    data = np.frombuffer(b"ab ab cd efg", np.uint8)
    ids, counts = memory.ids(kernel.Text(data, np.array([0, 5, 12])))
    assert bytes(ids.tolist()) == b"ab ab cd efg" and counts.tolist() == [5, 7]


def test_same_bytes():
    a = np.frombuffer(b"xabcdefghijk" + b"y" * 600 + b"longer" + bytes(8), np.uint8)
    b = np.frombuffer(b"abcdefghijk" + b"y" * 600 + b"longer" + bytes(8), np.uint8).copy()
    at, sizes = np.array([1, 3, 12, 12]), np.array([11, 1, 600, 606])
    assert chunks.same_bytes(a, at, b, at - 1, sizes)
    for place in (0, 10, 11, 299, 610, 616):
        c = b.copy()
        c[place] ^= 1
        assert not chunks.same_bytes(a, at, c, at - 1, sizes)
