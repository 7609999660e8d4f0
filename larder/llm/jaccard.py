"""N-gram Jaccard join: subsets for small sets, inverted lists for large ones.

A document is the set of its different shingles (runs of five words). Two
linked sets share many of them, which is used in two ways:

* light sets enumerate all subsets of the sizes that a link could leave in
  common; two linked sets have one of them in common;
* heavy sets put their smallest hashes (about a third) into inverted lists. Two
  linked ones meet in so many lists that lists of one set, and sets in too few
  lists, can go; of the rest only the rarest lists are scanned.

The boundary between them is where the rows of both together are fewest, given
how many sets there are of each size. Candidates are verified on whole sets.

Documents with equal sets are one class from the start. A list's members are
first compared with one pivot, the member that shares most with others; members of one component need no further
comparison, so a group of near copies costs a row per member and not all pairs.
Of the lists that still hold different components, short ones compare all
their pairs; the classes of the others are joined once more, on the rarest
elements of their whole sets. Whole sets are sent only to pairs whose
signatures allow a link.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chunks, kernel
from larder.llm.common import query, read, sieved, stored
from larder.llm.components import components
from larder.session import cut_lineage

SHINGLE_WORDS = 5
PERCENT = 80
LARGEST_LIGHT = 24  # sizes up to which the boundary may lie: beyond, subsets are too many in any case
STAR_ROUNDS = 1  # a cluster's own lists are its rarer ones, which are kept: one round merges most of it
SHORT_LIST = 40  # members up to which all pairs of a remaining list are compared
SIGN_BITS = 1024  # of the signature that bounds how much two sets differ
PLACES = 1 << 20  # on which elements are counted: a megabyte of levels goes out to the tasks at any size
BLOCK = 1 << 12  # places whose counts a task sends as one row

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def needed(n: int, percent: int = PERCENT) -> int:
    """How many elements a set of n shares at least with a linked one that is not larger."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """How many lists two linked sets meet in, if the smaller one has n elements."""
    return 1 + n // 10


def listed(n: int, percent: int = PERCENT) -> int:
    """In how many lists a set of n is put."""
    return min(n, n - needed(n, percent) + spare(n))


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row of the first, sorted different shingles of each text) per slice."""
    chunks.forget()
    for at, _, data, offsets in kernel.slices(column, kernel.HASH_SLICE_BYTES):
        text = kernel.Text(data, offsets, lower=True)
        starts, ends = text.words()
        rows, hashes = text.row_of(starts), text.hashes(starts, ends)
        first, found = kernel.windows(hashes, rows, size)
        bounds = np.searchsorted(rows[first], np.arange(text.rows + 1))
        words = np.searchsorted(rows, np.arange(text.rows + 1))
        made = []
        for i in range(text.rows):
            if bounds[i] < bounds[i + 1]:
                made.append(np.unique(found[bounds[i] : bounds[i + 1]]))
            elif words[i] < words[i + 1]:  # fewer words than a shingle has: all of them are one
                few = hashes[words[i] : words[i + 1]]
                padded = np.concatenate([few, np.full(size - len(few), len(few), np.uint64)])
                made.append(kernel.windows(padded, np.zeros(size, np.int64), size)[1])
            else:
                made.append(np.zeros(0, np.uint64))
        yield at, made


def _class(found: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return kernel.mix(np.array([kernel.mix(found).sum(dtype=np.uint64) + np.uint64(len(found))]))[0]


def _classify(size: int) -> Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, made in _sets(batch["text"], size):
                sizes = np.array([len(x) for x in made], np.int64)
                keys = np.array([_class(x) for x in made], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][at : at + len(made)], pa.array(keys.view(np.int64), mask=sizes == 0), pa.array(sizes)],
                    ["doc_id", "class", "n"])

    return run


def _subsets(found: np.ndarray, percent: int) -> np.ndarray:
    keys = []
    for c in range(needed(len(found), percent), len(found) + 1):
        chosen = np.array(list(itertools.combinations(range(len(found)), c)))
        keys.append(kernel.mix(kernel.mix(found)[chosen].sum(axis=1, dtype=np.uint64) ^ np.uint64(c << 40)))
    return np.concatenate(keys)


def _keys(size: int, percent: int, boundary: int) -> Kernel:
    """(token, class, n, light) of each class once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, made in _sets(batch["text"], size):
                out: list[tuple[np.ndarray, int, int, bool]] = []
                for found in made:
                    n = len(found)
                    if n == 0 or (key := int(_class(found).view(np.int64))) in seen:
                        continue
                    seen.add(key)
                    if n <= boundary:
                        out.append((_subsets(found, percent), key, n, True))
                    if n >= needed(boundary + 1, percent):
                        out.append((found[: listed(n, percent)], key, n, False))
                if out:
                    many = [len(x[0]) for x in out]
                    spread = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in out], kind), many))
                    yield pa.RecordBatch.from_arrays(
                        [kernel.signed(np.concatenate([x[0] for x in out])), spread(1, np.int64), spread(2, np.int32), spread(3, bool)],
                        ["token", "class", "n", "light"])

    return run


def _bits(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls on each place: two sets differ in as many elements as bits, or more."""
    odd = np.bincount((found >> np.uint64(32)).astype(np.int64) % SIGN_BITS, minlength=SIGN_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _arrays(size: int) -> Kernel:
    """(class, n, shingles, bits) of the texts whose class is the one they came with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, made in _sets(batch["text"], size):
                asked = batch["class"][at : at + len(made)].to_pylist()
                right = [(k, x) for k, x in zip(asked, made) if len(x) and int(_class(x).view(np.int64)) == k]
                flat = np.concatenate([x for _, x in right]) if right else np.zeros(0, np.uint64)
                bits = np.concatenate([_bits(x) for _, x in right]) if right else np.zeros(0, np.int64)
                ends = np.cumsum([0] + [len(x) for _, x in right]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in right], pa.int64()), pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends), kernel.signed(flat)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(right) + 1, dtype=np.int32) * (SIGN_BITS // 64)), pa.array(bits)),
                ], ["class", "n", "shingles", "bits"])

    return run


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The largest size of a light set: where subsets and list entries together are fewest.

    A list entry is counted three times, as it goes through three shuffles, a subset twice.
    """
    def rows(limit: int) -> int:
        light = sum(k * 2 * sum(math.comb(n, c) for c in range(needed(n, percent), n + 1)) for n, k in sizes.items() if n <= limit)
        return light + sum(k * 3 * listed(n, percent) for n, k in sizes.items() if n >= needed(limit + 1, percent))

    return min(range(LARGEST_LIGHT + 1), key=rows)


def _differ(x: str, y: str) -> Column:
    """How many elements are in one of two sets only, at least: the bits in which their signatures differ."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SIGN_BITS // 64)), F.lit(0))


def _close(percent: int) -> Column:
    """Whether signatures allow a link of the sets with ``n, bits`` and ``n2, bits2``."""
    return (100 + percent) * _differ("bits", "bits2") <= (100 - percent) * (F.col("n") + F.col("n2"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough.

    Signatures are compared first; whole sets go only to the pairs that are left.
    """
    signed = sets.select("class", "n", "bits")
    other = signed.select(F.col("class").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    near = stored(pairs.join(signed.withColumnRenamed("class", "a"), "a").join(other, "b").filter(_close(percent)).select("a", "b", F.col("n") + F.col("n2")))
    near = near.toDF("a", "b", "both")
    sides = near.select("*", F.explode(F.array("a", "b")).alias("class")).join(sets.select("class", "shingles"), "class")
    shared = F.size(F.array_intersect(F.col("s")[0], F.col("s")[1]))
    return (sides.groupBy("a", "b", "both").agg(F.collect_list("shingles").alias("s")).withColumn("shared", shared)
            .filter(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select("a", "b"))


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes allow a link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _lists(documents: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, class, n, common): the lists that are scanned, of two classes at least."""
    small = {r["n"]: r["count"] for r in sizes.filter(F.col("n").between(1, 2 * LARGEST_LIGHT)).groupBy("n").count().collect()}
    limit = boundary(small, percent)
    keys = documents.select("text").mapInArrow(_keys(size, percent, limit), "token long, class long, n int, light boolean")
    shared = keys.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi")
    met = keys.join(shared.select("token", "rows"), "token").groupBy("class", "n", "light").agg(
        F.sort_array(F.collect_set(F.struct("rows", "token"))).alias("tokens"))
    smallest = f"(1 + (({percent} * n + 99) div 100) div 10)"
    # How much of a set others have too: highest for what copies were made from.
    common = met.withColumn("common", F.expr("cast(if(light, 0, size(tokens) * 1000 div n) as int)"))
    rare = common.filter(f"light or size(tokens) >= {smallest}").withColumn(
        "tokens", F.expr(f"if(light, tokens, slice(tokens, 1, size(tokens) - cast({smallest} as int) + 1))"))
    entries = stored(rare.select(F.explode("tokens.token").alias("token"), "class", "n", "common"))
    # Of lists with the same members, one is enough; a list of one is none.
    members = entries.groupBy("token").agg(F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("n", "class")).alias("y"), F.count(F.lit(1)).alias("rows"))
    one = members.filter("rows > 1").groupBy("x", "y", "rows").agg(F.min("token").alias("token")).select("token")
    return cut_lineage(entries.join(one, "token"))


def _short_pairs(left: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of two labels in a list of ``left``; a pair comes once for each list that both are in.

    Lists are short, so that is cheaper than sending each class's lists along to tell the first one.
    """
    own = left.select("token", "class", "n", "label")
    other = own.select("token", *[F.col(c).alias(f"{c}2") for c in own.columns[1:]])
    pairs = own.join(other, "token").filter((F.col("class") < F.col("class2")) & (F.col("label") != F.col("label2")) & _alike("n", "n2", percent))
    return pairs.select(F.col("class").alias("a"), F.col("class2").alias("b"))


def _places(found: np.ndarray) -> np.ndarray:
    return (found % np.uint64(PLACES)).astype(np.int64)


def _count_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, places, counts): how many elements of one task's sets fall on each place, a row for each block of places."""
    counts = np.zeros(PLACES, np.int64)
    for batch in batches:
        counts += np.bincount(_places(batch["shingles"].flatten().to_numpy().view(np.uint64)), minlength=PLACES)
    at = np.flatnonzero(counts)
    blocks, first = np.unique(at // BLOCK, return_index=True)
    ends = pa.array(np.append(first, len(at)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([
        pa.array(blocks), pa.ListArray.from_arrays(ends, pa.array((at % BLOCK).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts[at])),
    ], ["block", "places", "counts"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, levels): the sums of all tasks' counts as a byte each, 0 for an element that one set has; a block comes to one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, places, counts in zip(batch["block"].to_pylist(), batch["places"], batch["counts"]):
            own = sums.setdefault(block, np.zeros(BLOCK, np.int64))
            own[places.values.to_numpy()] += counts.values.to_numpy()
    made = [np.minimum(4 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8).tobytes() for n in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(made, pa.binary())], ["block", "levels"])


def _rarest(sent: Broadcast, percent: int) -> Kernel:
    """The rows with ``skipped``, how many elements no other set has, and ``tokens``, the rarest of the others that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "shingles"]
            ends = np.append(0, np.cumsum(batch["n"].to_numpy()))
            flat = batch["shingles"].flatten().to_numpy().view(np.uint64)
            levels = sent.value[_places(flat)]
            tokens, skipped = [np.zeros(0, np.uint64)], []
            for a, b in zip(ends, ends[1:]):
                order = np.lexsort((flat[a:b], levels[a:b]))
                skipped.append(int((levels[a:b] == 0).sum()))
                tokens.append(flat[a:b][order][skipped[-1] : b - a - needed(int(b - a), percent) + 1])
            bounds = np.cumsum([len(x) for x in tokens]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch[n] for n in names] + [pa.array(skipped, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), kernel.signed(np.concatenate(tokens)))],
                [*names, "skipped", "tokens"])

    return run


def _rare_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of ``left(class, label)`` of two labels that can be linked, each once.

    Two linked sets share one of their rarest elements, if each puts as many in
    lists as a link could leave without the other's. Elements are ranked by how
    many of the classes here have them, so what all copies of one text share
    comes last, and two copies that changed different places meet nowhere. They
    are counted on a fixed number of places, merged inside each task, and sent as
    a row for each block of places; elements
    that share a place rank alike, which any order allows. Only those that are
    put in lists become rows. The
    places of the first element in common bound how many can follow it, and the
    bits that differ bound how many elements must be in one set only.
    """
    own = left.join(sets, "class").repartition("class").select("class", "n", "label", "bits", "shingles")  # even tasks, wherever the sets lie
    counted = own.select("shingles").mapInArrow(_count_elements, "block long, places array<int>, counts array<long>")
    levels = np.zeros(PLACES, np.uint8)  # as many numbers at most come to the driver
    for r in counted.repartition("block").mapInArrow(_levels, "block long, levels binary").collect():
        levels[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["levels"], np.uint8)
    # What a single class has comes first in the order, but meets nothing: only its number matters.
    first = own.mapInArrow(_rarest(own.sparkSession.sparkContext.broadcast(levels), percent),
                           "class long, n int, label long, bits array<long>, skipped int, tokens array<long>")
    entries = cut_lineage(first.filter("size(tokens) > 0").select("class", "n", "label", "bits", "skipped", "tokens", F.posexplode("tokens").alias("place", "token")))
    other = entries.select(*[F.col(c).alias(f"{c}2") for c in entries.columns])
    most = F.least(F.col("n") - F.col("skipped") - F.col("place"), F.col("n2") - F.col("skipped2") - F.col("place2"))
    met_first = F.element_at(F.array_intersect("tokens", "tokens2"), 1) == F.col("token")
    pairs = entries.join(other, (F.col("token") == F.col("token2")) & (F.col("class") < F.col("class2")) & (F.col("label") != F.col("label2"))
                         & _alike("n", "n2", percent) & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2"))) & _close(percent) & met_first)
    return pairs.select(F.col("class").alias("a"), F.col("class2").alias("b"))


def links(documents: DataFrame, classes: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between classes that connect all that are linked, no more than needed for it."""
    real = classes.filter("n > 0 and doc_id is not null")
    firsts = real.groupBy("class", "n").agg(F.min("doc_id").alias("doc_id"))
    lists = _lists(documents, firsts, size, percent)
    asked = lists.select("class").distinct().join(firsts, "class").select("doc_id", "class")
    asked = stored(asked)
    texts = sieved(documents.select("doc_id", "text"), asked, "doc_id").join(asked, "doc_id")
    sets = stored(texts.select("class", "text").mapInArrow(_arrays(size), "class long, n int, shingles array<long>, bits array<long>").dropDuplicates(["class"]))
    edges = None
    for turn in range(STAR_ROUNDS + 1):
        # Lists that still hold two components.
        own = lists.withColumn("label", F.col("class")) if edges is None else lists.join(
            components(edges).withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        pivot = F.xxhash64("class", F.lit(turn)) if turn else F.struct(-F.col("common"), "class")
        mixed = own.groupBy("token").agg(F.min_by(F.struct("class", "n", "label"), pivot).alias("p"), F.min("label").alias("lo"),
                                         F.max("label").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo < hi")
        left = own.join(mixed.select("token", "p", "rows"), "token")
        if turn == STAR_ROUNDS:
            left = cut_lineage(left)
            short, long = left.filter(F.col("rows") <= SHORT_LIST), left.filter(F.col("rows") > SHORT_LIST)
            asked = _short_pairs(short, percent).union(_rare_pairs(long.select("class", "label").distinct(), sets, percent)).distinct()
        else:
            star = left.filter((F.col("label") != F.col("p.label")) & _alike("n", "p.n", percent))
            asked = star.select(F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b")).distinct()
        found = cut_lineage(_verified(asked, sets, percent))
        edges = found if edges is None else edges.union(found)
    return edges


def jaccard_classes(documents: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents(doc_id, text)``.

    ``component_id`` is the smallest id that can be reached by links. A missing
    or empty text has no shingles and is linked with nothing; a text of fewer
    words than a shingle has is one shingle. A row without an id keeps its row,
    with no component, and links nothing. Repeated rows get a row each; other
    columns do not matter; no rows give no rows.
    """
    classes = stored(documents.select("doc_id", "text").mapInArrow(_classify(size), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, class long, n long"))
    found = components(links(documents, classes, size, percent))
    firsts = classes.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    labelled = firsts.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = labelled.join(smallest, "label").select("class", "component_id")
    joined = classes.join(by_class, "class", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(documents: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    Rows without an id stay. Of repeated rows with that id one stays.
    """
    kept = jaccard_classes(documents, size, percent).filter("component_id = doc_id").select("doc_id").distinct()
    named = documents.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(documents.filter("doc_id is null"))


@query("op10_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(read(spark, folder, "documents"))
