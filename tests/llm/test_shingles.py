"""Classes of similar shingle sets, which SimHash finds, against a brute-force version."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, shingle, up, down):
    """The smallest id of each document's class, links being similarities of up / down or more."""
    sets = {d: {tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, bool(w)))} for d, t in rows for w in [words(t)]}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) * down >= len(sets[a] | sets[b]) * up and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


@pytest.fixture(scope="module")
def rows():
    """Chains of edited copies, a frequent line, short, equal and empty texts."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " \n", "One two", "one TWO", "one two three", line, line + " " + line]
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([12, 40, 100, 250]))]
        for _ in range(14):
            if rnd.random() < 0.8:
                base = list(base)
                for _ in range(rnd.choice([1, 1, 2, 4])):
                    base[rnd.randrange(len(base))] = word()
            texts.append(" ".join(base) + (" " + line if rnd.random() < 0.3 else ""))
    ids = rnd.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("small", [8, 1, 10**9])
def test_similar_classes(spark, rows, small, monkeypatch):
    """No false link, and hardly one is lost: a link at exactly 0.8 with probability 0.05, at 0.85 with 0.005."""
    monkeypatch.setattr(simhash, "SMALL", small)
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()}
    want = brute(rows, 5, 4, 5)
    assert got.keys() == want.keys() and len(set(want.values())) < len(want) - 20
    assert all(want[d] == want[c] for d, c in got.items())
    assert sum(got[d] == want[d] for d in want) / len(want) > 0.97


def test_signatures_do_not_depend_on_blocks():
    import numpy as np

    rnd = np.random.default_rng(4)
    size = np.array([0, 1, 3, 254, 255, 256, 1000, 0, 2])
    value = rnd.integers(0, 1 << 63, size.sum(), dtype=np.uint64)
    every = simhash.signatures(value, size, 4)
    at = np.cumsum(size) - size
    for k, (a, n) in enumerate(zip(at, size, strict=True)):
        assert (simhash.signatures(value[a : a + n], size[k : k + 1], 4)[0] == every[k]).all()
        bits = [sum(int(x) >> b & 1 for x in simhash.mix(value[a : a + n] + np.uint64(0x9E3779B97F4A7C15))) * 2 > n for b in range(64)]
        assert int(every[k, 0]) | int(every[k, 1]) << 32 == sum(1 << b for b in range(64) if bits[b])


def test_stage_drops_edited_copies(spark):
    """Similarities from 0.8 to 0.9, whose fingerprints differ in far more than three bits."""
    base = [f"x{i}" for i in range(200)]
    edited = lambda at: " ".join("changed" if i in at else w for i, w in enumerate(base))
    docs = spark.createDataFrame([(1, edited([]), 7), (2, edited([50, 100, 150]), 8), (3, edited([10, 60, 90, 130, 170]), 9)], "doc_id long, text string, n int")
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_empty(spark):
    assert simhash.similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_members_of_a_cluster_are_asked_for_in_few_blocks(spark, monkeypatch):
    """Members of a cluster of near copies, which meet in hundreds of groups, are rows for about a block a part, however many blocks there are."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(f"c{rnd.randrange(10**6)}" if rnd.random() < 0.01 else w for w in base)) for i in range(60)]
    made = simhash.signed(spark.createDataFrame(docs, "doc_id long, text string"), 5, simhash.PARTS)
    grouped = simhash.met(made.select("node", "n", "prints").dropDuplicates(["node"]), simhash.PARTS)
    alike = grouped.where(F.size("node") > simhash.SMALL).groupBy(F.shiftright("key", 32).alias("part"), "node").agg(F.min("key").alias("key"), F.collect_list("key").alias("keys"), F.first("n").alias("n"))
    alike = simhash.table(alike)
    monkeypatch.setattr(simhash, "partitions", lambda spark: 500)
    groups = simhash.table(simhash.in_blocks(alike))
    nodes = alike.select(F.explode("node").alias("node")).distinct().count()
    assert groups.count() == alike.count() > 300 and groups.select("part", "key").distinct().count() == alike.count()
    assert simhash.asked(groups).count() <= (simhash.PARTS + 1) * nodes


def test_equal_small_groups_make_their_pairs_once(spark):
    grouped = spark.createDataFrame([(i, [4, 9], [5, 5]) for i in range(40)] + [(99, [4, 9, 11], [5, 5, 5])], "key long, node array<long>, n array<long>").repartition(8)
    assert simhash.small_pairs(grouped, simhash.Fraction(4, 5)).count() == 4
