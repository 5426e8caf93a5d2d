"""The stages on a table with known junk, copies and repeats."""
import random

import corpus_pipeline as P
from ledgerlens.llm import quality


def test_stages(spark, documents):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["stone", "river", "under", "the", "cloud", "bright", "walks", "of", "green"]) + str(rng.randint(0, 99)) for _ in range(n))
    base, passage = words(300), words(60)
    extra = documents([(10_001, base), (10_002, base), (10_003, base + " end"), (10_004, words(80) + ". " + passage), (10_005, words(80) + ". " + passage),
                       (10_006, None), (10_007, "")])

    kept = P.quality_filter(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert len(ids & set(good)) > 0.99 * len(good) and sum(d in ids for d, q in labels.items() if q == 0) < 0.1 * (len(labels) - len(good))
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids == {r.doc_id for r in quality.scored(docs, model).filter(f"score >= {P.KEEP}").select("doc_id").collect()}

    one = P.one_of_each_group(spark, extra, folder)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == [10_001, 10_004, 10_005, 10_006, 10_007]

    cut = P.repeats_removed(spark, one, folder)
    assert cut.columns == docs.columns
    text = {r.doc_id: r.text for r in cut.collect()}
    assert passage in text[10_004] and passage not in text[10_005] and text[10_001] == base and text[10_006] is None
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)

    packed = P.packed_sequences(spark, cut, folder).collect()
    assert {r.doc_id for r in packed} == set(text)
