"""Awkward inputs: texts longer than a block, repeated rows, clashing columns, empty tables, null ids."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import packing, pieces, quality, repeats, scoring, separators, simhash, toxicity
from lodestone.llm.blocks import Block
from tests.llm.test_text_operators import WORD, brute_repeats, tokenizer

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def long_rows():
    """A text above the blocks' 1 MiB, a copy of it, a part of it and a short one."""
    rnd = np.random.default_rng(6)
    words = [f"w{i:x}" for i in rnd.integers(0, 9000, 210_000)]
    text = " ".join(words)
    assert len(text) > 1 << 20
    return [(1, text), (2, text), (3, "new words first " + " ".join(words[5000:5300])), (4, "a short one")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    df = spark.createDataFrame([*long_rows, (None, "no id")], "doc_id long, text string").repartition(3)
    return df.withColumn("carried", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("score", F.lit(0)).withColumn("node", F.lit(1)).withColumn("first", F.lit(2)).cache()


def test_long_texts(long_rows, long_docs):
    every = dict(long_rows)
    for unit in ("bytes", "words"):
        got = repeats.remove_repeats(long_docs, unit=unit).collect()
        want = brute_repeats(long_rows[:1] + long_rows[2:], unit, 50)
        assert {r.doc_id: (r.n_units, r.n_removed) for r in got if r.doc_id != 2} == {d: w[:2] for d, w in want.items()}
        assert [r.n_removed == r.n_units for r in got if r.doc_id == 2] == [True]
    n_words = {d: len(WORD.findall(t)) for d, t in every.items()}
    assert {r.doc_id: r.n_words for r in quality.quality_cascade(long_docs, metrics=True).collect()} == n_words
    assert {r.doc_id: r.n_tokens - 1 for r in scoring.lm_scores(long_docs, lambda d: True).collect()} == n_words
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(long_docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    classes = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_classes(long_docs).collect()}
    assert classes[1] == classes[2] and classes[2][1] == 1
    t = tokenizer()
    n_ids = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in every.items()}
    total = {d: 0 for d in every}
    for r in packing.pack(long_docs).collect():
        total[r.doc_id] += r.length
    assert total == n_ids
    assert {r.doc_id: r.n_tokens for r in separators.token_counts(long_docs).collect()} == n_ids
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert {r.doc_id: (r.n_ids, r.round_trip) for r in pieces.sentencepiece(long_docs).collect()} == {d: (len(model.encode(x)), True) for d, x in every.items()}


def test_toxicity_against_brute_force(spark, long_rows):
    """Scores worked out word by word, with clashing columns, repeated rows, nulls, a long text and an empty table."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.fold("doc_id", 4) != 2)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id % 9 = 0").collect()] + [(10_001, None), (10_002, ""), (10_003, long_rows[0][1]), (10_004, "You stupid STUPID idiot, loser")]
    df = spark.createDataFrame([*rows, rows[0], rows[0], (None, "no id")], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(None).cast("int"))
    got = toxicity.toxicity(df.repartition(3), model).collect()
    assert len(got) == len(rows) + 2

    params = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = [lambda x, c=zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(toxicity.spelled(t), dict_type=zstandard.DICT_TYPE_RAWCONTENT)): len(c.compress(x)) for t in (model.ordinary, model.toxic)]
    known = {}

    def gains(word):
        if word not in known:
            cut = [toxicity.spelled(b" " + word[i : i + toxicity.PIECE] + b" ") for i in range(0, len(word), toxicity.PIECE)]
            both = [(size[0](x), size[1](x)) for x in cut]
            known[word] = (max((a - b) / a for a, b in both), max(a - 2 * b for a, b in both))
        return known[word]

    def score(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        each = [gains(w) for w in raw.split()]
        x = (max(g for g, _ in each), max(e for _, e in each), math.log1p(sum(g >= toxicity.CLEAR for g, _ in each))) if each else (0.0, -20.0, 0.0)
        z = model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.centre, model.scale, strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    want = {d: score(t) for d, t in rows}
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in got)
    assert want[10_004] >= 0.3
    empty = spark.createDataFrame([], df.schema)
    assert toxicity.toxicity(empty, model).count() == 0 and toxicity.fit(empty, labels) is None
    with pytest.raises(ValueError, match="most_bytes"):
        toxicity.fit(docs, labels, most_bytes=0)


def test_one_very_long_labelled_text(spark):
    """A text above the bound of the sample, first by its hash, takes nobody's place; nor do copies of an id."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    plain = toxicity.fit(docs, labels)
    first = labels.where("toxic = 1").orderBy(F.xxhash64(F.col("doc_id").cast("long"))).first().doc_id
    grown = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("word "), 2_100_000)).otherwise(F.col("text")))
    model = toxicity.fit(grown.union(docs.where("doc_id % 50 = 1")), labels)
    held = docs.where(F.col("doc_id") != first)
    a, b = ({r.doc_id: r.score >= 0.3 for r in toxicity.toxicity(held, m).collect()} for m in (plain, model))
    assert model is not None and sum(a[d] != b[d] for d in a) <= 0.02 * len(a) and sum(b.values()) >= 0.8 * sum(a.values())


def test_the_fit_counts_in_tasks(spark):
    """The model is the one of plain counts over the whole sample, of which no text reaches the driver."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    # one text, in other letters, under both labels and under none; a null and an empty text
    first = [labels.where(f"toxic = {y}").first().doc_id for y in (0, 1)]
    shared = F.when(F.col("doc_id") == first[0], F.upper(F.lit("Shared\u00c4 words\x1c and\x0bmore words"))).when(F.col("doc_id") == first[1], F.lit("SHARED\u00c4 WORDS\x1c AND\x0bmore words"))
    odd = F.when(F.col("doc_id") % 40 == 3, F.lit(None)).when(F.col("doc_id") % 40 == 4, F.lit("")).otherwise(F.col("text"))
    docs = docs.withColumn("text", F.coalesce(shared, odd)).cache()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    tracemalloc.start()
    model = toxicity.fit(docs, labels, base_words=50, calibration=120)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < total, "the driver's Python held as much as the texts"

    rows = docs.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").collect()
    every = [(r.text.encode(), r.toxic) for r in rows]
    one = [(text.split(), y) for text, y in {text.lower(): y for text, y in every}.items()]  # the last label of a text
    n = [sum(y == k for _, y in one) for k in (0, 1)]
    held = [Counter(w for words, y in one if y == k for w in set(words)) for k in (0, 1)]
    beside = {(b, w) for words, y in one if y for b, w in zip([b"", *words], words, strict=False)}
    neighbours, least = Counter(w for _, w in beside), max(5, 0.008 * n[1])
    marks = [w for w, k in held[1].items() if k >= least and neighbours[w] >= least and held[0][w] * n[1] <= 0.02 * k * n[0]]
    ordinary = b" " + b" ".join(sorted(held[0], key=lambda w: (-held[0][w], w))[:50]) + b" "
    assert marks and (model.ordinary, model.toxic) == (ordinary, ordinary + b" ".join(sorted(marks, key=lambda w: (held[1][w], w))) + b" ")

    used = [text for text, y in every if y][:40] + [text for text, y in every if not y][:80]
    toxic = np.arange(len(used)) < min(40, sum(y for _, y in every))
    block = Block(np.arange(len(used)), np.frombuffer(b"".join(used), np.uint8), np.cumsum([0, *map(len, used)]))
    share = labels.agg(F.avg(1.0 - F.col("toxic"))).first()[0]
    want = toxicity.calibrated(model, toxicity.Windows(model).features(block), toxic, share)
    for a, b in ((model.weights, want.weights), (model.centre, want.centre), (model.scale, want.scale)):
        assert np.allclose(a, b, rtol=1e-9)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 0")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DATA)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES][:-1])
def test_stages_keep_names_null_ids_and_repeated_rows(spark, name):
    text = "these are some quite harmless words that no rule of the cascade should ever find bad number "
    rows = [(1, text + "one", 7), (1, text + "one", 7), (None, text + "two and then some more", 8), (3, text + "three", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc long").withColumn("carried", F.lit("c")).withColumn("component_id", F.lit(0)).withColumn("place", F.lit(1.5)).withColumn("n", F.lit(2)).withColumn("prints", F.lit(3))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DATA)
    assert out.schema.names == docs.schema.names
    got = sorted((r.doc_id or 0, r.doc or 0, r.carried) for r in out.collect())
    assert {(0, 8, "c"), (1, 7, "c")} <= set(got) and len(got) >= 3
    if name in ("toxicity", "quality"):
        assert out.count() == 4


def test_every_kept_text_reaches_its_tokens(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        now = {r.doc_id: r.text for r in docs.collect()}
        assert now.keys() <= seen[-1].keys()
        seen.append(now)
    assert all(seen[3][d] == t for d, t in seen[3].items()) and all(seen[0][d] == t for d, t in seen[3].items())
    t = tokenizer()
    want = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for d, x in seen[-1].items()}
    found = {d: 0 for d in want}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        found[r.doc_id] += r.length
    assert found == {d: len(x) for d, x in want.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(want)
