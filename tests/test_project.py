import json
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.plans.project import Action, ItemCache, Lock, Output, Project, Runner, identity_of
from lodestone.sources import layout, providers

TOML = """
version = 3
[providers.store]
kind = "s3"
endpoint = "http://x"
[artifacts.raw]
ref = "local:/data"
[tasks.upper]
run = "upper"
inputs = { rows = "@raw" }
[tasks.bundle]
run = "bundle"
inputs = { rows = "@upper.out" }
[refs.final]
target = "@bundle"
"""


def functions():
    return {"upper": lambda rows: {"out": rows.select("key", F.upper("value").alias("value"))}, "bundle": lambda rows: {"out": rows.groupBy().agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))}}


def rows(spark, b="bravo"):
    return spark.createDataFrame([("a", "alpha"), ("b", b), ("c", "charlie")], "key string, value string")


def test_project(spark, tmp_path):
    project = Project.parse(TOML)
    assert project.plan() == [["upper"], ["bundle"]] and project.plan(["@upper.out"]) == [["upper"]]
    assert project.providers["store"]["config"] == {"endpoint": "http://x"}
    assert Project.parse('[artifacts.a]\nref = "x:y"\n').sources == {"a": {"ref": "x:y"}}
    with pytest.raises(KeyError):
        project.plan(["nothing"])
    run = Runner(spark, str(tmp_path / "store"), functions())
    first = run.run_project(project, {"raw": rows(spark)})
    assert {k: r.hit for k, r in first.items()} == {"upper": False, "bundle": False}
    assert run.read(first["bundle"].key, "out").first().value == "ALPHA,BRAVO,CHARLIE"
    again = run.run_project(project, {"raw": rows(spark)})
    assert all(r.hit for r in again.values()) and again["bundle"].outputs == first["bundle"].outputs
    changed = run.run_project(project, {"raw": rows(spark, "beta changed")})
    assert not any(r.hit for r in changed.values())
    assert run.read(changed["bundle"].key, "out").first().value == "ALPHA,BETA CHANGED,CHARLIE"


def test_item_cache(spark, tmp_path):
    """Three items: first all miss, then all hit, then one changed item misses."""
    work = lambda df: df.select("key", F.upper("value").alias("result"))
    seen = []
    for b in ("bravo", "bravo", "beta"):
        cache = ItemCache(spark, str(tmp_path / "items"))
        out = cache.map(rows(spark, b), work)
        seen.append((cache.hits, cache.misses))
    assert seen == [(0, 3), (3, 0), (2, 1)]
    assert sorted(r.result for r in out.collect()) == ["ALPHA", "BETA", "CHARLIE"]
    with pytest.raises(ValueError):
        cache.map(rows(spark).union(rows(spark)), work)
    with pytest.raises(ValueError):
        cache.map(rows(spark).withColumn("key", F.lit(None).cast("string")).limit(1), work)
    assert cache.map(rows(spark).limit(0), work).collect() == []


def test_items_of_a_failed_run(spark, tmp_path):
    """Four items in lots of one; the work fails after two of them, and the next run does the other two."""
    items = spark.createDataFrame([(k, k * 2) for k in "abcd"], "key string, value string")
    lots = []

    def work(df):
        lots.append(1)
        if len(lots) == 3:
            raise RuntimeError("half-way")
        return df.select("key", F.upper("value").alias("result"))

    cache = ItemCache(spark, str(tmp_path / "items"), per_lot=1)
    with pytest.raises(RuntimeError):
        cache.map(items, work)
    done = spark.read.parquet(str(tmp_path / "items")).count()
    cache = ItemCache(spark, str(tmp_path / "items"))
    assert sorted(r.result for r in cache.map(items, work).collect()) == ["AA", "BB", "CC", "DD"]
    assert (cache.hits, cache.misses) == (done, 4 - done)


BY_ITEM = """
version = 3
[sources.docs]
ref = "table:docs"
[sources.rate]
ref = "table:rate"
[tasks.price]
run = "price"
foreach = "docs"
by_item = true
cache = "%s"
inputs = {rate = "rate"}
"""


def test_items_with_side_input_force_and_volatile(spark, tmp_path):
    docs = spark.createDataFrame([("a", 10), ("b", 20)], "key string, value long")
    rate = lambda n: spark.createDataFrame([(n,)], "rate long")
    runs = []

    def price(items, rate):
        runs.append(1)
        return {"out": items.crossJoin(rate).select("key", (F.col("value") * F.col("rate") + len(runs) - 1).alias("result"))}

    def values(cache, n, **more):
        run = Runner(spark, str(tmp_path / cache), {"price": price})
        result = run.run_project(Project.parse(BY_ITEM % cache), {"docs": docs, "rate": rate(n)}, **more)["price"]
        return sorted(r.result for r in run.read(result.stored, "out").collect()), result.hit

    assert values("reproducible", 1) == ([10, 20], False)
    assert values("reproducible", 100) == ([1001, 2001], False)
    assert values("reproducible", 1) == ([10, 20], True)
    assert values("reproducible", 1, force=["price"]) == ([12, 22], False)
    assert values("volatile", 1) == ([13, 23], False) and values("volatile", 1) == ([14, 24], False)
    run = Runner(spark, str(tmp_path / "audit"), {"price": price})
    project = Project.parse(BY_ITEM % "reproducible")
    seen = {run.run_project(project, {"docs": docs, "rate": rate(1)}, force=["price"])["price"].outputs["out"] for _ in range(2)}
    assert len(seen) == 2


def test_hit_needs_its_outputs(spark, tmp_path):
    action = Action("t", ("f",), outputs={"out": Output()})
    run = Runner(spark, str(tmp_path), {})
    first = run.run(action, lambda: {"out": rows(spark)})
    assert run.run(action, lambda: 1 / 0).hit
    shutil.rmtree(tmp_path / first.stored.split(":")[1][:2])
    for r in (run, Runner(spark, str(tmp_path), {})):
        assert not r.why(action)["hit"]
    again = Runner(spark, str(tmp_path), {}).run(action, lambda: {"out": rows(spark)})
    assert not again.hit and again.outputs == first.outputs and run.run(action, lambda: 1 / 0).hit


def test_pure_across_sessions(spark, tmp_path):
    action = Action("t", ("f",), outputs={"out": Output()}, cache="pure")
    Runner(spark, str(tmp_path), {}).run(action, lambda: {"out": rows(spark)})
    with pytest.raises(RuntimeError, match="pure"):
        Runner(spark, str(tmp_path), {}).run(action, lambda: {"out": rows(spark, "other")}, force=True)
    other = Action("t", ("g",), outputs={"out": Output()})
    assert Runner(spark, str(tmp_path), {}).why(other) == {"key": other.key(), "hit": False, "previous": action.key()}


def test_identities(spark):
    frames = [
        spark.sql("select timestamp'2024-01-01 00:00:00.000001' t"), spark.sql("select timestamp'2024-01-01 00:00:00.000002' t"), spark.sql("select timestamp_ntz'2024-01-01 00:00:00.000001' t"),
        spark.sql("select map(1, 2, 3, 4) t"), spark.sql("select map(1, 2, 3, 5) t"), spark.sql("select cast(null as map<int,int>) t"), spark.sql("select X'00' t"), spark.sql("select X'0000' t"),
        spark.sql("select array(timestamp'2024-01-01 00:00:00.000001') t"), spark.sql("select array(timestamp'2024-01-01 00:00:00.000003') t"), spark.sql("select named_struct('a', null) t"), spark.sql("select struct(1 as a) t"),
    ]
    ids = [identity_of(f) for f in frames]
    assert len(set(ids)) == len(ids) and ids == [identity_of(f) for f in frames]
    assert identity_of(spark.sql("select map(3, 4, 1, 2) t")) == ids[3]


def test_runner_gates(spark, tmp_path):
    run = Runner(spark, str(tmp_path / "s"), {})
    df = rows(spark)
    action = Action("t", ("f",), outputs={"out": Output()})
    with pytest.raises(ValueError):
        run.run(action, lambda: {})
    assert run.history[-1]["exit_code"] == 1 and not run.run(action, lambda: {"out": df}).hit
    assert run.run(action, lambda: 1 / 0).hit
    assert not run.run(Action("v", ("f",), cache="volatile"), lambda: {"out": df}).hit and not run.run(Action("v", ("f",), cache="volatile"), lambda: {"out": df}).hit
    assert len(run.audit(action, lambda: {"out": df})["out"]) == 1
    assert run.why(action) == {"key": action.key(), "hit": True, "previous": None}


def test_lock():
    source = {"ref": "local:/x", "include": ["*"]}
    from lodestone.functions.canonical import requirement_hash

    lock = Lock({"b": (requirement_hash("local:/x", ["*"], []), "sha256:1"), "a": ("h", "sha256:2")})
    assert Lock.parse(lock.dump()).sources == lock.sources and lock.dump().index('"a"') < lock.dump().index('"b"')
    assert lock.check("b", source, lambda a: True) == "ok" and lock.check("b", source, lambda a: False) == "locked_missing" and lock.check("c", source, lambda a: True) == "frozen_mismatch"


def test_providers(spark, tmp_path):
    r = providers.Registry()
    r.profile("mine", "gs")
    assert r.route("mine:bucket/x")[0].name == "gcs" and r.route("S3:b")[1] == "b"
    for bad in ("nope:x", "s3:", "x"):
        with pytest.raises((KeyError, ValueError)):
            r.route(bad)
    with pytest.raises(ValueError):
        r.add(providers.Provider("again", ("s3",), "files"))
    assert [(x.path, bytes(x.content)) for x in providers.read(spark, r, "fixture:any").collect()] == [("fixture.txt", b"provider conformance\n")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("hi")
    assert [(x.path, x["size"]) for x in providers.read(spark, r, f"local:{tmp_path}").collect()] == [("d/f.txt", 2)]
    got = providers.read(spark, r, f"dvc:{tmp_path}/d/f.txt", argv=json.dumps(["cat", "{locator}"])).collect()
    assert [(x.path, bytes(x.content)) for x in got] == [("f.txt", b"hi")]
    tar = providers.read(spark, r, f"git:{tmp_path}", argv=json.dumps(["tar", "cf", "-", "-C", "{locator}", "d"]), archive="tar").collect()
    assert [(x.path, bytes(x.content)) for x in tar] == [("d/f.txt", b"hi")]


def test_layout(spark, tmp_path):
    blobs = spark.createDataFrame([("a", b"1"), ("b", b"22")], "title string, content binary")
    layout.write(blobs, str(tmp_path))
    assert sorted((r.title, bytes(r.content), r["size"]) for r in layout.read(spark, str(tmp_path)).collect()) == [("a", b"1", 1), ("b", b"22", 2)]
    got = providers.read(spark, providers.Registry(), f"oci:{tmp_path}").collect()
    assert sorted((r.path, bytes(r.content), r["size"]) for r in got) == [("a", b"1", 1), ("b", b"22", 2)]
