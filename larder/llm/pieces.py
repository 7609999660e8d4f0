"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is cut into the pieces of a vocabulary with the least total cost. The
search keeps only a window of the text: once all paths that are still alive go
through one boundary, everything before it is final and leaves the window.

The vocabulary file is of the merging kind: its scores are ranks, not
probabilities. A piece therefore costs the logarithm of its rank (the usual law
of word frequencies); ids can differ from those that merging would give. Of
segmentations that cost the same, the one whose last piece is longest wins, and
so on backwards. Letters that no piece has become bytes. Spaces are kept, so
decoding gives the text back.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chunks, kernel
from larder.llm.common import query, read

COST_UNIT = 1_000_000  # costs are whole numbers, so sums do not depend on where a window begins
SLICE_BYTES = 500_000  # of texts that are encoded at once
BYTE_COST = 25 * COST_UNIT  # of one byte of a letter that no piece has; above that of any piece
_MARK, _LITERAL = "▁", "\udfff"  # a space in a piece; a mark that was in the text itself


class Vocabulary:
    """Pieces with their costs, and the bytes each id stands for."""

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        self.cost: dict[str, tuple[int, int]] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [-1] * 256
        for i, (piece, score) in enumerate(zip(pieces, scores)):
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif piece.startswith("<") and piece.endswith(">") and i < 3:
                self.bytes.append(b"")  # unknown, begin and end are never given out
            else:
                rank = -score if -score < len(pieces) else len(pieces)
                self.cost[piece] = (round(COST_UNIT * math.log(2 + rank)), i)
                self.bytes.append(piece.replace(_MARK, " ").encode())
        self.longest = max(map(len, self.cost))
        self.longest_at: dict[str, int] = {}  # the longest piece that ends with a letter
        for piece in self.cost:
            self.longest_at[piece[-1]] = max(self.longest_at.get(piece[-1], 1), len(piece))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids])


class StreamingViterbi:
    """Takes a text in parts and gives out ids as soon as they are certain.

    ``window`` is the largest number of letters that were kept. A path can only
    go on from one of the last ``longest`` boundaries: those are the living ends.
    """

    def __init__(self, known: Vocabulary) -> None:
        self.known = known
        self.letters = ""
        # Of the best path to each boundary of the window: its cost, the boundary before, the ids of its last step.
        self.cost, self.back, self.step = [0], [-1], [()]
        self.window = 0

    def feed(self, part: str) -> list[int]:
        """Take more letters; the ids that they make certain."""
        ids: list[int] = []
        for at in range(0, len(part), self.known.longest):
            self._extend(part[at : at + self.known.longest])
            if len(self.letters) > 2 * self.known.longest:
                ids += self._commit()
        return ids

    def _extend(self, part: str) -> None:
        known, cost, longest_at = self.known.cost, self.cost, self.known.longest_at
        letters, first = self.letters + part, len(self.letters)
        for end in range(first + 1, len(letters) + 1):
            best, before, found_id = -1, 0, 0
            for start in range(max(0, end - longest_at.get(letters[end - 1], 1)), end):
                found = known.get(letters[start:end])
                if found is not None and (best < 0 or cost[start] + found[0] < best):
                    best, before, found_id = cost[start] + found[0], start, found[1]
            if best < 0:
                raw = (_MARK if letters[end - 1] == _LITERAL else letters[end - 1]).encode()
                cost.append(cost[end - 1] + BYTE_COST * len(raw))
                self.back.append(end - 1)
                self.step.append(tuple(self.known.byte_id[b] for b in raw))
            else:
                cost.append(best)
                self.back.append(before)
                self.step.append((found_id,))
        self.letters = letters
        self.window = max(self.window, len(letters))

    def _commit(self) -> list[int]:
        """Give out what lies before the last boundary that all living paths go through."""
        n = len(self.letters)
        alive = set(range(max(0, n + 1 - self.known.longest), n + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(max(0, self.back[last]))
        meeting = alive.pop()
        if meeting == 0:
            return []
        ids, base = self._path(meeting), self.cost[meeting]
        self.letters = self.letters[meeting:]
        self.cost = [c - base for c in self.cost[meeting:]]
        self.back = [b - meeting for b in self.back[meeting:]]
        self.step = self.step[meeting:]
        return ids

    def _path(self, end: int) -> list[int]:
        steps = []
        while end > 0:
            steps.append(self.step[end])
            end = self.back[end]
        return [i for step in reversed(steps) for i in step]

    def finish(self) -> list[int]:
        return self._path(len(self.letters))


def segment(text: str, known: Vocabulary) -> list[int]:
    """The ids of one text; a space before it is not added here."""
    search = StreamingViterbi(known)
    return search.feed(text.replace(_MARK, _LITERAL).replace(" ", _MARK)) + search.finish()


@functools.lru_cache(maxsize=4)
def _memory(path: str) -> chunks.Memory:
    known = vocabulary(path)
    breaks = kernel.SPACE.copy()
    for piece in known.cost:  # what makes chunks independent of each other
        if _MARK in piece.lstrip(_MARK):
            raise ValueError(f"a piece spans two words: {piece!r}")
        if len(piece) > 1:
            breaks[[ord(c) for c in piece if c in "\t\n\v\f\r"]] = False
    return chunks.Memory(lambda texts: [segment(t, known) for t in texts], breaks)


def _begun(data: np.ndarray, offsets: np.ndarray) -> kernel.Text:
    """The texts with a space before each that is not empty."""
    full = offsets[1:] > offsets[:-1]
    return kernel.Text(np.insert(data, offsets[:-1][full], 32), offsets + np.append(0, np.cumsum(full)))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(path)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_text"]
            for at, end, data, offsets in kernel.slices(batch["_text"], SLICE_BYTES):
                ids, counts = memory.ids(_begun(data, offsets))
                ends = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch[n][at:end] for n in names] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], [*names, "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        lengths = np.array([len(b) for b in known.bytes])
        starts = np.cumsum(lengths) - lengths
        pool = np.frombuffer(b"".join(known.bytes), np.uint8)
        for batch in batches:
            names = batch.schema.names
            ends = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch["ids"]), 0).to_numpy()))
            flat = batch["ids"].flatten().to_numpy()
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + kernel.SLICE_BYTES // 4, "right")) - 1)
                ids = flat[ends[at] : ends[end]]
                raw = chunks.gather(pool, starts[ids], lengths[ids])
                bounds = np.append(0, np.cumsum(lengths[ids]))[ends[at : end + 1] - ends[at]]
                drop = np.zeros(len(raw), bool)
                drop[bounds[:-1][bounds[1:] > bounds[:-1]]] = True  # the space that encoding put first
                bounds = bounds - np.append(0, np.cumsum(drop))[bounds]
                raw = raw[~drop]
                text = pa.Array.from_buffers(pa.string(), end - at, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*[batch[n][at:end] for n in names], text], [*names, "decoded"])
                at = end

    return run


def _with(df: DataFrame, name: str, kind: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_text"]
    return ", ".join([*fields, f"{name} {kind}"])


def encode(documents: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``documents(text)`` (or those in ``keep``) with ``ids``.

    A missing or empty text has no ids. A text of any length takes memory for a
    few megabytes besides itself. A column named ``ids`` is replaced; repeated
    rows get the same ids; no rows give no rows.
    """
    names = [n for n in (documents.columns if keep is None else keep) if n != "ids"]
    rows = documents.select(*[F.col(f"`{n}`") for n in names], F.col("text").alias("_text"))
    return rows.mapInArrow(_encode(path), _with(rows, "ids", "array<int>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded(ids)`` with ``decoded``, the text they came from; no ids give an empty text."""
    rows = encoded.drop("decoded")
    return rows.mapInArrow(_decode(path), _with(rows, "decoded", "string"))


def default_vocabulary() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_hash, round_trip): encoded, decoded, and whether the text came back."""
    back = decode(encode(documents, path, keep=["doc_id", "text"]), path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(read(spark, folder, "documents"), default_vocabulary())
