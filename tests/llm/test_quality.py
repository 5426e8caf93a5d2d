import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.scored(docs, quality.fit(docs, labels))
    assert out.columns == [*docs.columns, "score"]
    rows = out.join(labels, "doc_id").filter(quality.held_out()).select("quality", (F.col("score") >= 0.7).cast("int").alias("kept")).toPandas()
    assert (rows.quality == rows.kept).mean() > 0.97
    assert rows[rows.quality == 1].kept.mean() > 0.99


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "a b c. " * 50), (3, "a b c. " * 50), (None, "x"), (4, "é" * 100_000)]).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, 0, 0), (99, 0, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = quality.scored(docs, quality.fit(docs, some)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(docs.limit(0), quality.grow(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.grow(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
