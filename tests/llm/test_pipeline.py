import zlib

import numpy as np

import corpus_pipeline
from lodestone.llm import packing, quality, simhash, suffixes, tokens, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "suffixes", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = stage["toxicity"](spark, docs, DATA)
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert clean.columns == docs.columns and ids(clean) == ids(toxicity.toxicity(docs, model).where("score < 0.3"))
    good = stage["quality"](spark, docs, DATA)
    assert good.schema == docs.schema and ids(good) == ids(quality.quality_cascade(docs).where("kept"))
    one = stage["simhash"](spark, docs, DATA)
    assert one.columns == docs.columns and ids(one) == ids(simhash.similar_classes(docs).where("doc_id = component_id"))
    cut = stage["suffixes"](spark, docs, DATA)
    assert cut.columns == docs.columns and ids(cut) == ids(docs)
    removed = {r.doc_id: r.n_removed for r in suffixes.suffix_array_dedup(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(before[r.doc_id].encode()) - len(r.text.encode()) in range(removed[r.doc_id] - 6 * (removed[r.doc_id] > 0) * 50, removed[r.doc_id] + 1) for r in cut.collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert list(got[0].asDict()) == list(packing.NAMES) and len({(r.doc_id, r.start) for r in got}) == len(got)


def test_filters_keep_nulls_and_names(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "some words that are no worse than many other words here", 6)], "doc_id long, text string, place long")
    assert quality.keep_good(df).collect() == [df.collect()[1]] and quality.keep_good(df).schema == df.schema
