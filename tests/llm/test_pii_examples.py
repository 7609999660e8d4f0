"""Which documents teach the scorer of personal data."""

from pyspark.sql import functions as F

from larder.llm import pii


def test_all_documents_teach(spark, monkeypatch):
    documents = spark.range(20_050).select("id", F.concat(F.lit("write to a"), "id", F.lit("@b.org at once")).alias("text"))
    given, spans = [], pii._spans
    monkeypatch.setattr(pii, "_spans", lambda rows, *names: given.append(rows.count()) or spans(rows, *names))
    assert pii.fit(documents).thresholds["email"] is not None
    assert given == [20_050]


def test_equal_examples_are_counted(spark):
    documents = spark.createDataFrame([("mail me@x.org now",)] * 30, "text string")
    counted = pii.counted_examples(documents)
    assert counted.agg(F.sum("rows")).first()[0] == pii._examples(pii._spans(documents)).count()
    assert counted.count() < 30


def test_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame([("mail me@x.org now",), ("call +49 30 1234567 now",)], "text string").write.parquet(f"{tmp_path}/documents")
    counted = pii.counted_examples(spark.read.parquet(f"{tmp_path}/documents"))
    assert counted._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert {(r["kind"], r["label"]) for r in counted.collect()} >= {(0.0, 1.0), (3.0, 1.0)}
