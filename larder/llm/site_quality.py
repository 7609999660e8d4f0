"""Quality of documents and their sites by hierarchical empirical Bayes.

A logistic fit on labelled rows gives each document its own evidence. The
shares of good documents of a host and of the paths below it are then estimated
from the evidence of all their documents: a path is drawn towards its host and
a host towards all hosts, the more the fewer documents it has. How strongly is
estimated from how much groups differ. A document's score adds what its site is
known for, without the document itself, to its own evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import kernel
from larder.llm.common import drawn, fold, logistic, probability, query, read, stored
from larder.llm.divergence import CLASSES, _class_counts, _measure
from larder.plans.joins import fits
from larder.session import cut_lineage

SAMPLE_LABELS = 40_000  # labelled rows that the document evidence is fitted on
HELD_OUT_FOLD = 0
KEEP_FROM = 0.5
STRENGTH = (1.0, 10_000.0)  # documents that a prior may count as, at least and at most
_EDGE = 1e-4

FEATURES = [f"_c{i}" for i in range(CLASSES)] + ["_symbols", "_lines", "_repeats", "_length", "_word", "_few"]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "_text"]
        for at, end, data, offsets in kernel.slices(batch["_text"]):
            text = kernel.Text(data, offsets)
            found, _, _ = _measure(text)
            classes = _class_counts(text)
            words, chars = found["n_words"], np.maximum(classes.sum(1), 1)
            made = [classes[:, i] / chars for i in range(CLASSES)] + [
                found["n_symbols"] / chars, np.log1p(found["n_dup_lines"]), found["n_repeat_words"] / np.maximum(words, 1),
                np.log1p(words), np.minimum(found["word_chars"] / np.maximum(words, 1), 30), (words < 20).astype(float)]
            yield pa.RecordBatch.from_arrays([batch[n][at:end] for n in names] + [pa.array(x.astype(float)) for x in made], [*names, *FEATURES])


def features(documents: DataFrame, keep: list[str]) -> DataFrame:
    rows = documents.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_features, ", ".join([*kinds, *[f"{f} double" for f in FEATURES]]))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> np.ndarray | None:
    """Weights of the document evidence; None without labels of both kinds."""
    learned = labels.filter("doc_id is not null and quality is not null").filter(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    chosen = cut_lineage(drawn(learned.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), sample, "doc_id"))
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about ``sample`` rows
    seen = features(labelled, ["quality"]).toPandas()
    if seen["quality"].nunique() < 2:
        return None
    return logistic(seen[FEATURES].to_numpy(), seen["quality"].to_numpy(float), ridge=0.1)


def site_of(url: Column) -> tuple[Column, Column]:
    """Host, and first part of the path, of an address; '' where there is none."""
    return (F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
            F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1))


def _strength(groups: DataFrame) -> float:
    """How many documents a prior counts as, from the spread of group shares (``good``, ``n``, ``prior``).

    By moments: the spread that is more than what groups of their size show by chance.
    """
    share = F.col("good") / F.col("n")
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (share - F.col("prior")) ** 2).alias("spread"),
                   F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("most"),
                   F.sum(F.col("prior") * (1 - F.col("prior"))).alias("chance")).first()
    if not r["n"] or not r["most"]:
        return STRENGTH[1]
    between = max(0.0, (r["spread"] - r["chance"]) / r["most"])
    return float(np.clip(1 / between - 1 if between > 0 else STRENGTH[1], *STRENGTH))


def site_quality(documents: DataFrame, weights: np.ndarray | None, host: Column, path: Column, keep: list[str], keep_from: float = KEEP_FROM) -> DataFrame:
    """The columns in ``keep`` with ``evidence``, ``host_share``, ``path_share``, ``score`` and ``kept``.

    A missing host or path is one of its own, ''. A missing or empty text is
    judged as one of no words. Without weights all evidence is 1/2 and nothing
    is dropped. Hosts of any size are summed in each task first. Repeated rows
    count as often as they occur; results replace columns of their name.
    """
    names = {f"_keep_{i}": c for i, c in enumerate(keep)}
    rows = documents.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], "text",
                            F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"))
    measured = features(rows, [*names, "_host", "_path"])
    own = F.lit(0.5) if weights is None else probability(weights, [F.col(f) for f in FEATURES])
    seen = stored(measured.select(*names, "_host", "_path", own.alias("evidence")))
    paths = cut_lineage(seen.groupBy("_host", "_path").agg(F.sum("evidence").alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = total["good"] / total["n"] if total["n"] else 0.5
    host_strength = _strength(hosts.withColumn("prior", F.lit(overall)))
    hosts = hosts.select("_host", ((F.col("good") + host_strength * overall) / (F.col("n") + host_strength)).alias("host_share"))
    paths = paths.join(F.broadcast(hosts) if fits(hosts) else hosts, "_host")
    strength = _strength(paths.withColumn("prior", F.col("host_share")))
    joined = seen.join(F.broadcast(paths) if fits(paths) else paths, ["_host", "_path"])
    others = (F.col("good") - F.col("evidence") + strength * F.col("host_share")) / (F.col("n") - 1 + strength)
    logit = lambda p: F.log(F.greatest(F.lit(_EDGE), p) / F.greatest(F.lit(_EDGE), 1 - p))
    score = F.lit(1.0) / (1 + F.exp(-(logit(F.col("evidence")) + logit(others) - logit(F.lit(overall)))))
    kept = F.lit(True) if weights is None else score >= keep_from
    made = {"evidence": F.col("evidence"), "host_share": F.col("host_share"), "path_share": others, "score": score, "kept": kept}
    return joined.select(*[F.col(k).alias(c) for k, c in names.items() if c not in made], *[c.alias(n) for n, c in made.items()])


@query("op3_site_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    weights = fit(documents, read(spark, folder, "labels"))
    return site_quality(documents, weights, F.col("source"), F.col("lang"), ["doc_id"])
