"""Alignment of the tokens of two tokenizers over the same bytes.

Each text is encoded twice, and the starts of both sides' tokens are laid over
its bytes. An as-of merge, keyed by document, finds for each token the other side's token
that covers its start; the union of both directions is every pair of tokens
that overlap. Bytes where tokens of both sides end cut the tokens into groups.

How many documents link a pair of ids is counted over all documents. Frequent
pairs are broadcast and looked up where the documents lie, the others are joined by
pair; both ways run always and each pair goes one of them.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chunks, kernel
from larder.llm.common import query, read, stored
from larder.llm.pieces import default_vocabulary
from larder.llm.shards import default_tokenizer

SLICE_BYTES = 250_000  # of texts that are merged at a time
KNOWN_CHUNKS = 400_000  # chunks a worker keeps the ids of, on each side; results do not depend on it
HEAD_PAIRS = 100_000  # frequent pairs that are broadcast; results do not depend on it
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True
_SEPARATORS = ("", ",", "|", ";")
PAIRS = "array<struct<a: int, b: int, n: int>>"


class Side:
    """A tokenizer: its ids by chunk, and the bytes of each id."""

    def __init__(self, memory: chunks.Memory, tokens: list[bytes]) -> None:
        self.memory = memory
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        # Each id as text behind each separator, to write groups out.
        self.names = np.array([[f"{s}{i}" for i in range(len(tokens))] for s in _SEPARATORS], object)

    def tokens(self, text: kernel.Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, text of each id, which texts the ids give back byte by byte)."""
        ids, counts = self.memory.ids(text)
        rows, sizes = np.repeat(np.arange(text.rows), counts), self.size[ids]
        lengths = np.diff(text.offsets)
        same = np.bincount(rows, sizes, text.rows).astype(np.int64) == lengths
        held = same[rows]
        joined = chunks.gather(self.pool, self.first[ids[held]], sizes[held])
        own = np.repeat(np.arange(text.rows), lengths)
        inside = same[own]
        same[own[inside][joined != text.data[inside]]] = False
        return ids, rows, same


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; texts begin with a space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # special strings in a text are plain text here
    letters = byte_letters()
    by_id = {i: token for token, i in tokenizer.get_vocab().items()}
    tokens = [b"" if i not in by_id else bytes(letters[c] for c in by_id[i]) if all(c in letters for c in by_id[i]) else by_id[i].encode() for i in range(max(by_id) + 1)]
    return Side(chunks.Memory(lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], most=KNOWN_CHUNKS), tokens)


@functools.lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A vocabulary of the sentencepiece library, which puts a space before a text itself.

    No piece goes on behind its spaces and letters into another space, so chunks that begin with spaces are encoded alone.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("pieces of this vocabulary go beyond a word")
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    blank = [model.piece_to_id("▁")]

    def encode(texts: list[str]) -> list[list[int]]:
        return [ids or blank for ids in model.encode([t[1:] for t in texts], num_threads=1)]

    return Side(chunks.Memory(encode, _BLANK, KNOWN_CHUNKS), tokens)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all pairs that overlap, each once; both have columns ``text, start, token`` in order of ``start``.

    The tokens of a text cover the same bytes on both sides, so each start lies in a token of the other side.
    """
    names = {"token": "other", "start": "other_start"}
    forth = pd.merge_asof(a, b.rename(columns=names), left_on="start", right_on="other_start", by="text")
    back = pd.merge_asof(b, a.rename(columns=names), left_on="start", right_on="other_start", by="text")
    back = back[back["start"] != back["other_start"]]  # equal starts are in the other direction already
    return (np.concatenate([forth["token"].to_numpy(), back["other"].to_numpy()]).astype(np.int64),
            np.concatenate([forth["other"].to_numpy(), back["token"].to_numpy()]).astype(np.int64))


def _written(a: Side, b: Side, ids: tuple, texts: tuple, groups: tuple, rows: int) -> list[str]:
    """The groups of each text: A's ids, a bar, B's ids; a semicolon between groups."""
    many = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=many))]) for g in groups]
    out = np.empty(len(ids[0]) + len(ids[1]), object)
    for side, names, other in ((0, a.names, before[1][:-1]), (1, b.names, before[0][1:])):
        own, text = groups[side], texts[side]
        first = np.ones(len(own), bool)
        first[1:] = own[1:] != own[:-1]
        kind = np.where(first, 2 if side else 3, 1)
        if not side:
            kind[np.flatnonzero(np.diff(text, prepend=-1))] = 0
        out[np.arange(len(own)) + other[own]] = names[kind, ids[side]]
    ends = np.cumsum(np.bincount(texts[0], minlength=rows) + np.bincount(texts[1], minlength=rows))
    return ["".join(out[s:e].tolist()) for s, e in zip([0, *ends[:-1]], ends)]


def _align(byte_path: str, piece_path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(byte_path), piece_side(piece_path)
        for batch in batches:
            for at, end, data, offsets in kernel.slices(batch["_text"], SLICE_BYTES):
                rows = end - at
                spaced = kernel.Text(np.insert(data, offsets[:-1], 0x20), offsets + np.arange(rows + 1))
                (a_ids, a_rows, a_same), (b_ids, b_rows, b_same) = (s.tokens(spaced) for s in sides)
                live = a_same & b_same & (np.diff(offsets) > 0)
                ids = a_ids[live[a_rows]], b_ids[live[b_rows]]
                texts = a_rows[live[a_rows]], b_rows[live[b_rows]]
                ends = [np.cumsum(s.size[i]) for s, i in zip(sides, ids)]
                starts = [e - s.size[i] for s, e, i in zip(sides, ends, ids)]
                first, second = overlaps(*[pd.DataFrame({"text": t, "start": s, "token": np.arange(len(s))}) for t, s in zip(texts, starts)])
                both = np.intersect1d(*ends, assume_unique=True)
                groups = tuple(np.searchsorted(both, s, "right") for s in starts)
                n_groups = np.bincount(texts[0][np.isin(ends[0], both, assume_unique=True)], minlength=rows)
                # Pairs of ids by text, with how often each is linked.
                linked = texts[0][first]
                sizes = [len(s.size) for s in sides]
                pairs, often = np.unique((linked * sizes[0] + ids[0][first]) * sizes[1] + ids[1][second], return_counts=True)
                of = np.concatenate([[0], np.cumsum(np.bincount(pairs // (sizes[0] * sizes[1]), minlength=rows))])
                kinds = [("a", pairs // sizes[1] % sizes[0]), ("b", pairs % sizes[1]), ("n", often)]
                made = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for _, x in kinds], [n for n, _ in kinds])
                counts = [np.bincount(texts[0], minlength=rows), np.bincount(texts[1], minlength=rows), n_groups, np.bincount(linked, minlength=rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch[n][at:end] for n in names] + [pa.array(x, pa.int64()) for x in counts]
                    + [pa.array(_written(*sides, ids, texts, groups, rows), pa.string()), pa.ListArray.from_arrays(pa.array(of, pa.int32()), made)],
                    [*names, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return run


def align(documents: DataFrame, byte_path: str, piece_path: str, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with what both sides' tokens of each ``text`` have in common.

    ``n_a, n_b`` tokens, ``n_groups``, ``n_links`` overlapping pairs of tokens, ``groups`` written as
    ``a1,a2|b1;a3|b2,b3``, and ``pairs`` (ids ``a, b`` and how many links ``n`` they have in this text). A missing or
    empty text, or one whose tokens do not give its bytes back on both sides, has no tokens. Rows are aligned each by itself: repeated
    rows and ids and an empty table need no care, other columns are ignored.
    """
    rows = documents.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    numbers = [f"{n} long" for n in ("n_a", "n_b", "n_groups", "n_links")]
    return rows.mapInArrow(_align(byte_path, piece_path, keep), ", ".join([*kinds, *numbers, "groups string", f"pairs {PAIRS}"]))


def _lookup(sent: Broadcast, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            lists = batch["pairs"]
            flat = lists.flatten()
            a, b, n = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            key = a << 32 | b
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            own, many, at = of[known], n[known], at[known]
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], own, many * best[at])
            np.add.at(sums[1], own, many * counts[at])
            rest = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=len(lists)))])
            left = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), flat.filter(pa.array(~known)))
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(sums[0]), pa.array(sums[1]), left], [*names, "n_best", "count_sum", "rest"])

    return run


def add_counts(aligned: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to a stored table with ``pairs``; ``pairs`` themselves are dropped.

    A pair's count is the number of rows (documents; repeated ones count each) that have it. ``n_best``: links
    whose pair has the highest count of its A id, ties included; ``count_sum``: counts over links. No rows give no rows.
    """
    spark = aligned.sparkSession
    counted = stored(aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("count")))
    most = counted.groupBy("a").agg(F.max("count").alias("most"))  # a row per A id: bounded by the vocabulary
    rated = counted.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    head = rated.orderBy(F.desc("count"), "a", "b").limit(head_pairs).toPandas()  # a bounded list
    key = head["a"].to_numpy(np.int64) << 32 | head["b"].to_numpy(np.int64)
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], head["count"].to_numpy(np.int64)[order], head["best"].to_numpy(np.int64)[order]))
    keep = [c for c in aligned.columns if c != "pairs"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name != "pairs"]
    looked = aligned.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        _lookup(sent, [*keep, "_row"]), ", ".join([*kinds, "_row long", "n_best long", "count_sum long", f"rest {PAIRS}"]))
    looked = stored(looked)
    links = looked.select("_row", F.explode("rest").alias("p")).select("_row", "p.*").join(rated, ["a", "b"])
    rest = links.groupBy("_row").agg(F.sum(F.col("n") * F.col("best")).alias("_best"), F.sum(F.col("n") * F.col("count")).alias("_sum"))
    whole = looked.drop("rest").join(rest, "_row", "left")
    return whole.select(*keep, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


@query("op13_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = align(read(spark, folder, "documents"), default_tokenizer(), default_vocabulary(), ["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return add_counts(stored(found.withColumn("groups_sha256", digest).drop("groups")))
