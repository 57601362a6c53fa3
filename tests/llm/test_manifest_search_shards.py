"""Merkle manifests, ranked search and shards against brute force, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lexical, merkle, sharding

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, g int, rank string, shard string, slot int"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None, 7) for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    found = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").where("doc_id < 60").collect()]
    odd = [(1000 + i, "s", None, i, f"alpha {i}") for i in range(9)]  # a group without a name
    odd += [(-5, None, "", None, None), (1 << 40, "é", "zz", 3, ""), ((1 << 40) + 1, "é", "zz", 3, "É Alpha, beta_gamma\x00delta")]
    odd += [(77, "s", "en", 5, "same")] * 4 + [(77, "s", "en", 5, "other"), (77, "t", "en", None, "same")]  # repeated ids and rows
    odd += [(None, "s", "en", 1, "no id"), (None, "s", "en", 1, "no id"), (None, None, None, None, None)]
    odd += [(70000 + i * 3, "s", "long", i, " ".join(rnd.choice(["alpha", "beta", "Gamma", "x1"]) for _ in range(rnd.randrange(9)))) for i in range(700)]
    odd += [(200_000, "s", "long", 1, "delta " * 60_000)]
    return found + odd


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
        i >>= 1
    return out


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:3], r[3] + 1, r[4])) if bad else None))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (*x[:3], x[3] is not None, x[3]))
        trees[g] = brute_tree([x[2] for x in groups[g]])
    top = brute_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (there, key, own, other) in enumerate(groups[g]):
            steps, node = path(trees[g], i) + path(top, k), other or own
            for sibling, right in steps:
                node = H(node) if sibling is None else H(sibling, node) if right else H(node, sibling)
            out.append((key if there else None, own, trees[g][-1][0], top[-1][0], H(*(s for s, _ in steps if s)), node, node == top[-1][0]))
    return out


def tampered(docs):
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return merkle.manifest(docs, tampered=changed, changes={"n_chars": F.col("n_chars") + 1})


def test_manifest(spark, rows):
    got = [tuple(r) for r in tampered(made(spark, rows).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(brute_manifest(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_small(spark):
    assert tampered(made(spark, [])).collect() == []
    for some in ([(3, None, None, None, None)], [(3, "a", "en", 2, "x"), (2, "a", "de", 2, "x")], [(i, "a", "en", 2, "x") for i in range(257)]):
        assert sorted(map(tuple, tampered(made(spark, some)).collect()), key=str) == sorted(brute_manifest(some), key=str)


def test_bitmaps_and_ranks():
    rnd = np.random.default_rng(1)
    whole = 1 << merkle.CHUNK
    for n in (1, 5, merkle.DENSE - 1, merkle.DENSE, whole // 2, whole):
        lows = np.sort(rnd.choice(whole, n, replace=False))
        data = merkle.compressed(lows)
        words = merkle.bitmap(data)
        ranks = merkle.Ranks(data, merkle.directory(words).astype("<u2").tobytes(), lows[:1].astype("<u2").tobytes(), np.array([3], "<i8").tobytes())
        assert len(data) <= whole // 8 and (ranks.of(lows) == np.arange(n) + 3 * (lows > lows[0])).all()


def test_scan_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_CHUNKS", 4)
    rnd = random.Random(2)
    counts = [(g, c, rnd.randrange(1, 9)) for g in "ab" for c in rnd.sample(range(-5000, 5_000_000), 40)]
    got = {(r.g, r.chunk): r.before for r in merkle.sums_before(spark.createDataFrame(counts, "g string, chunk long, n long")).collect()}
    assert got == {(g, c): sum(n for h, x, n in counts if h == g and x < c) for g, c, _ in counts}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs if d is not None]
    counts = [(d, c) for d, c in counts if c]
    n, length, df = len(counts), sum(sum(c.values()) for _, c in counts), collections.Counter(t for _, c in counts for t in c)
    asked, out = collections.defaultdict(set), []
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    for i, wanted in asked.items():
        found = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "lot", "cells"), [(50, 2048, 1 << 21), (3, 2, 1), (1000, 2048, 5000)])
def test_ranked(spark, rows, k, lot, cells, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    items = [(1, "Alpha beta GAMMA"), (2, "alpha beta x1 delta"), (3, None), (4, "!!"), (5, "nowhere"), (6, "é É same"), (6, "other"), (None, "alpha"), (7, "alpha beta"), (8, "gamma alpha beta")]
    items += [(100 + i, r[4]) for i, r in enumerate(rows[:12])]
    asked = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, rank string")
    got = [tuple(r) for r in lexical.ranked(made(spark, rows).repartition(4), asked, k, most_items=lot).collect()]
    assert sorted(got) == brute_search([(r[0], r[4]) for r in rows], items, k)


def test_ranked_empty(spark, rows):
    none, items = made(spark, []), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.ranked(none, items).collect() == []
    assert lexical.ranked(made(spark, rows), items.where("item_id < 0")).collect() == []


def test_shared_pairs():
    rnd = random.Random(4)
    sequences = [sorted(rnd.sample(range(30), rnd.randrange(20))) for _ in range(40)]
    left, layers = lexical.shared_pairs([list(s) for s in sequences], 30)
    parts = {n: [n] for n in range(30)}
    for layer in layers:
        for a, b in layer:
            parts[len(parts)] = parts[a] + parts[b]
    assert [[x for n in s for x in parts[n]] for s in left] == sequences and layers
    assert sum(map(len, left)) < sum(map(len, sequences))


def sharded(spark, rows, n, **more):
    docs = made(spark, rows).repartition(6).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    out = sharding.histogram_shards(docs, n, "size", "text", "doc_id", **more).collect()
    places = collections.defaultdict(list)
    for r in out:
        places[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in places.values())
    key = lambda r: tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text", "g", "rank"))
    assert collections.Counter(map(key, out)) == collections.Counter((*r, 1, "x") for r in rows)
    return out


@pytest.mark.parametrize("n", [1, 2, 7])
def test_shards(spark, rows, n):
    out = sharded(spark, rows, n)
    sums = collections.Counter()
    for r in out:
        sums[r.shard] += r.size
    mean, most = sum(sums.values()) / n, max(r.size for r in out)
    assert all(abs(sums[s] - mean) <= most + 0.01 * mean for s in range(n))


def test_shards_of_one_group_and_of_repeated_rows(spark):
    copies = [(i, "s", "en", 1, "the same text") for i in range(4000)]
    again = [(5, "s", "en", 1, "the very same row")] * 3000
    for some in (copies, again, [*copies, *again, *[(9000 + i, "s", "en", 1, f"text {i}") for i in range(2000)]]):
        sums = collections.Counter()
        for r in sharded(spark, some, 8):
            sums[r.shard] += r.size
        assert max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values()) / 8 + 60


def test_groups_stay_whole_where_they_can(spark):
    some = [(i, "s", "en", 1, f"text {i // 4}") for i in range(8000)]
    homes = collections.defaultdict(set)
    for r in sharded(spark, some, 5):
        homes[r.text].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) == 0


def test_shards_empty(spark):
    assert sharded(spark, [], 3) == []
    zero = spark.createDataFrame([(1, "a", None), (2, None, None)], "doc_id long, text string, size long")
    assert {(r.shard, r.slot) for r in sharding.histogram_shards(zero, 3, "size", "text", "doc_id").collect()} == {(0, 0), (0, 1)}
