import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, gates, graph, manifests, store


def plain_boundaries(data, least, avg, most):
    ends, value, n = [], 0, 0
    for i, b in enumerate(data):
        n += 1
        value = ((value << 1 | value >> 63) & (1 << 64) - 1) ^ int(chunking.GEAR[b])
        if n >= least and (value & (avg - 1) == 0 or n >= most):
            ends.append(i + 1)
            value = n = 0
    return ends + ([len(data)] if n else [])


@pytest.mark.parametrize("size", [0, 1, 511, 512, 5000, 60_000])
def test_boundaries(size):
    data = random.Random(size).randbytes(size)
    for step in (1 << 16, 100):
        assert chunking.boundaries(data, 512, 2048, 8192, step) == plain_boundaries(data, 512, 2048, 8192)
    same = bytes(size)
    assert chunking.boundaries(same, 512, 2048, 8192) == plain_boundaries(same, 512, 2048, 8192)


def test_three_mebibytes_round_trip(spark):
    data = bytes(i % 251 for i in range(3 << 20))
    rows = spark.createDataFrame([(1, data), (2, b"")], "k int, b binary")
    listed = chunking.chunks(rows, "k", "b")
    headers = rows.select("k", F.octet_length("b").cast("long").alias("logical_size"), F.sha2("b", 256).alias("logical_sha256"))
    content = chunking.chunk_content(rows, listed, "k", "b")
    assert sorted((r.k, r["size"], r.valid) for r in chunking.reassembled(listed, content, headers, "k").collect()) == [(1, 3 << 20, True), (2, 0, True)]  # an empty blob too
    broken = content.withColumn("bytes", F.concat("bytes", F.lit(b"!")))
    assert {r.k: r.valid for r in chunking.reassembled(listed, broken, headers, "k").collect()} == {1: False, 2: True}


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "z")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("gone",), (None,)], "node string")
    assert sorted((r.node, r.depth) for r in graph.closure(roots, edges).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("gone", 0)]


def test_levels(spark):
    assert graph.levels({"b": ["a", "src"], "a": [], "c": ["b", "a"]}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        graph.levels({"a": ["b"], "b": ["a"]})
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("a", "src")], "task string, depends_on string")
    assert {r.task: r.level for r in graph.level_table(tasks, deps).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        graph.level_table(tasks, deps.union(spark.createDataFrame([("a", "c")], deps.schema)))


def test_manifest_json(spark):
    content = "sha256:" + "0" * 64
    rows = spark.createDataFrame([("t", "z", "blob", content, 1, True), ("t", 'a"\\', "blob", content, 2, None)], "g string, path string, kind string, content string, size long, executable boolean")
    made = manifests.trees(rows, ["g"])
    text = made.first().manifest
    assert text.startswith('{"version":1,"entries":[{"path":"a\\"\\\\","kind":"blob"') and text.endswith('"size":1,"executable":true}]}')
    assert [(r.path, r["size"], r.executable) for r in manifests.list_tree(made, ["g"]).orderBy("ordinal").collect()] == [('a"\\', 2, None), ("z", 1, True)]
    assert manifests.same_set(rows, rows.orderBy("path")) and not manifests.same_set(rows, rows.limit(1))


def test_immutable_refs(spark):
    schema = "name string, artifact string, updated_at timestamp, immutable boolean"
    import datetime as d

    day = lambda n: d.datetime(2024, 1, n)
    refs = spark.createDataFrame([("a", "1", day(1), True), ("b", "1", day(1), False)], schema)
    new = spark.createDataFrame([("a", "2", day(2), False), ("b", "2", day(2), True), ("c", "3", day(2), False)], schema)
    assert sorted((r.name, r.artifact) for r in store.set_ref(refs, new).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_policy_quantifiers(spark):
    subjects = spark.createDataFrame([("s",), ("none",)], "subject string")
    a = spark.createDataFrame([("s", "p", None, None)], "subject string, predicate_type string, issuer string, signature string")
    result = lambda **k: {r.subject: r.reason for r in gates.policy(subjects, a, **k).collect()}
    assert result() == {"s": None, "none": None}
    assert result(signed=True, issuers=["i"]) == {"s": "issuer", "none": None}
    assert result(required=["p"]) == {"s": None, "none": "predicate p"}
    assert result(least=1) == {"s": None, "none": "count"}


def test_verify_reports_missing_and_corrupt(spark):
    expected = spark.createDataFrame([("ok",), ("bad",), ("gone",)], "text string").withColumn("id", store.content_id("text"))
    content = expected.where("text <> 'gone'").select("id", F.when(F.col("text") == "bad", "x").otherwise(F.col("text")).alias("content"))
    assert {r.text: r.status for r in store.verified(expected, content).collect()} == {"ok": "ok", "bad": "corrupt", "gone": "missing"}


def test_materialise_and_read_back(spark, tmp_path):
    from lodestone.sources import acquire
    from lodestone.sources.tables import files

    rows = spark.createDataFrame([("a/x.txt", b"1"), ("b.txt", b"22")], "path string, content binary")
    root = str(tmp_path / "out")
    assert sorted(r.path for r in acquire.materialised(rows, root).collect()) == ["a/x.txt", "b.txt"]
    back = files(spark, root)
    assert sorted((r.path, bytes(r.content)) for r in back.collect()) == [("a/x.txt", b"1"), ("b.txt", b"22")]
    kinds = {r.key: r.kind for r in acquire.members(back.withColumn("g", F.lit(1)), ["g"]).collect()}
    assert kinds == {"a": "tree", "b.txt": "blob"}
    with pytest.raises(Exception, match="unsafe"):
        acquire.materialised(spark.createDataFrame([("../x", b"1")], rows.schema), root).collect()
