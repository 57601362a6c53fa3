"""Chunks of blobs in parts against the loop over one cell, and the walk order of layers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, graph

PARAMS = (64, 256, 1024)


@pytest.fixture(scope="module")
def blobs():
    rnd = np.random.default_rng(5)
    out = {f"b{i}": rnd.integers(0, 256, n, dtype=np.uint8).tobytes() for i, n in enumerate((0, 1, 63, 64, 1024, 1025, 5000, 70_000))}
    return out | {"flat": b"a" * 20_000, "words": b"the quick brown fox " * 900}


@pytest.fixture(scope="module")
def parts(spark, blobs):
    rnd, rows = random.Random(1), []
    for key, blob in blobs.items():
        at, n = 0, 0
        rows.append((key, -1, None))
        while at < len(blob) or not n:
            size = rnd.choice([0, 1, 7, 500, 3000])
            rows.append((key, n, blob[at : at + size]))
            at, n = at + size, n + 1
    return spark.createDataFrame(rows, "key string, part int, data binary").repartition(5)


def wanted(blobs):
    out = []
    for key, blob in blobs.items():
        at = 0
        for i, end in enumerate(chunking.boundaries(blob, *PARAMS)):
            out.append((key, i, at, end - at, "sha256:" + hashlib.sha256(blob[at:end]).hexdigest(), blob[at:end]))
            at = end
    return sorted(out)


def got(df):
    return sorted((r["key"], r["ordinal"], r["offset"], r["size"], r["content"], bytes(r["bytes"])) for r in df.collect())


def test_streamed(blobs, parts):
    assert got(chunking.streamed(parts, "key", "part", "data", *PARAMS, keep=True)) == wanted(blobs)


@pytest.mark.parametrize(("size", "fan"), [(1024, 2), (1500, 3), (1 << 20, 64)])
def test_ranged(blobs, parts, size, fan):
    assert got(chunking.ranged(parts, "key", "part", "data", *PARAMS, size=size, fan=fan, keep=True)) == wanted(blobs)
    with pytest.raises(ValueError):
        chunking.ranged(parts, "key", "part", "data", *PARAMS, size=1000)


def test_no_parts(parts):
    none = parts.where("false")
    assert got(chunking.streamed(none, "key", "part", "data", *PARAMS, keep=True)) == [] == got(chunking.ranged(none, "key", "part", "data", *PARAMS, keep=True))


def test_round_trip(spark, blobs, parts):
    made = chunking.streamed(parts, "key", "part", "data", *PARAMS, keep=True).cache()
    headers = chunking.headers_of(parts, "key", "part", "data")
    content = made.select("content", "bytes").dropDuplicates(["content"])
    good = chunking.put_together(made, content, headers, "key").collect()
    assert {r["key"]: (r["size"], r["valid"]) for r in good} == {k: (len(b), True) for k, b in blobs.items()}
    lost = made.where("key = 'words'").first()["content"]
    bad = {r["key"] for r in chunking.put_together(made, content.where(content["content"] != lost), headers, "key").collect() if not r["valid"]}
    assert bad == {"words"}
    listed = {r["key"]: r["manifest"] for r in chunking.chunk_manifests(made, headers, "key", *PARAMS).collect()}
    assert listed["b0"].endswith('"min_chunk":64,"avg_chunk":256,"max_chunk":1024,"chunks":[]}') and set(listed) == set(blobs)


def walked(roots, edges):
    """The order of a depth-first walk."""
    below, seen = {}, []
    for s, d, n in sorted(edges, key=lambda e: (e[2], e[1])):
        below.setdefault(s, []).append(d)

    def visit(node):
        if node not in seen:
            seen.append(node)
            for x in below.get(node, []):
                visit(x)

    for node, _ in sorted(roots, key=lambda r: r[1]):
        visit(node)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_first_visits(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{a}", f"n{b}", rnd.randrange(4)) for a in range(40) for b in rnd.sample(range(a + 1, 60), rnd.randrange(4))]
    edges += [("n3", f"m{i}", 9 + i) for i in range(300)]
    roots = [("n5", 0), ("n0", 1), ("n3", 2), ("alone", 3)]
    got_ = graph.first_visits(spark.createDataFrame(roots, "node string, nth int"), spark.createDataFrame(edges, "src string, dst string, nth int")).collect()
    assert [r.node for r in sorted(got_, key=lambda r: bytes(r.path))] == walked(roots, edges)


def test_first_visits_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "b", 0)], "src string, dst string, nth int")
    with pytest.raises(ValueError, match="cycle"):
        graph.first_visits(spark.createDataFrame([("a", 0)], "node string, nth int"), edges)


def test_edges_are_not_shuffled_again(spark):
    edges = graph.bucketed(spark.range(1000).selectExpr("id as src", "id + 1 as dst"), "src")
    plan = edges.hint("merge").join(spark.range(500).selectExpr("id as src"), "src", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize(("n", "params"), [(3000, (64, 256, 1024)), (700, (1, 2, 7)), (5000, (16, 1 << 16, 400)), (200_000, (64, 1 << 16, 100_000)), (64, (5, 4, 6))])
def test_exits(n, params):
    """The places that chains meet lead where all places lead, by linked keys and by search."""
    rnd = np.random.default_rng(n)
    for symbols in (2, 256):
        raw = rnd.integers(0, symbols, n, dtype=np.uint8)
        for size, entries in ((n, n), (n // 2, min(n // 2, params[2])), (1, 1)):
            every = chunking.leaving(chunking.next_cuts(raw, size, *params), params[0])[:entries]
            assert (chunking.exits(raw, size, entries, *params) == every).all()


def test_ranges_cost(monkeypatch):
    """A range looks up the places that its chains meet, not each of its bytes."""
    raw, (least, avg, most) = np.random.default_rng(1).integers(0, 256, 1 << 18, dtype=np.uint8), PARAMS
    asked, rotated = [], chunking.rotated
    monkeypatch.setattr(chunking, "rotated", lambda x, left: asked.append(x.size) or rotated(x, left))
    chunking.exits(raw, len(raw), most, least, avg, most)
    assert sum(asked) < 2 * len(raw) + len(raw) // 8  # two passes over the bytes, then the places asked


def test_large_sides_are_not_sent(spark, monkeypatch):
    """Frontiers and tables of a walk that have many rows are joined where they lie, with the same results."""
    n = 300
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2)).alias("dst"), F.lit(0).alias("nth")).where(f"dst < {n}")
    roots = spark.createDataFrame([(0, 0)], "node long, nth int")
    tasks, needs = spark.range(n).select(F.col("id").alias("task")), edges.select(F.col("src").alias("task"), F.col("dst").alias("depends_on"))
    run = lambda: ({r.node: r.depth for r in graph.closure(roots, edges).collect()}, {r.task: r.level for r in graph.level_table(tasks, needs).collect()}, {r.node: bytes(r.path) for r in graph.first_visits(roots, edges).collect()})
    before, hinted = run(), []
    monkeypatch.setattr(graph, "SENT", 20)
    shared = graph.shared
    monkeypatch.setattr(graph, "shared", lambda df, rows: hinted.append(rows > 20) or shared(df, rows))
    assert run() == before and any(hinted) and not all(hinted)
    plan = roots.join(graph.shared(tasks.withColumnRenamed("task", "node"), n), "node")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_putting_together_holds_no_blob(spark, monkeypatch):
    """Blobs are joined a batch of chunks at a time, by the runs that hash them, and never as one list of parts."""
    rows = spark.createDataFrame([(i, bytes([i % 251]) * (i * 37 % 5000)) for i in range(60)] + [(99, None)], "k long, b binary")
    listed = chunking.chunks(rows, "k", "b", *PARAMS)
    headers = rows.select("k", F.coalesce(F.octet_length("b"), F.lit(0)).cast("bigint").alias("logical_size"), F.sha2(F.coalesce("b", F.lit(b"")), 256).alias("logical_sha256"))
    made = chunking.reassembled(listed, chunking.chunk_content(rows, listed, "k", "b"), headers, "k")
    assert dict(listed.dtypes)["ordinal"] == "int" and made.where("valid").count() == 61
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
