import datetime as d

from lodestone.streaming import incremental


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_changed_items(spark, tmp_path):
    for i, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")]]):
        spark.createDataFrame(rows, "key string, artifact string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("key string, artifact string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, drain(incremental.changed_stream(stream), "changed"))) == [("a", "1"), ("b", "1"), ("b", "2")]


def test_leases(spark, tmp_path):
    at = lambda m: d.datetime(2024, 1, 1, 0, m)
    lots = [[("x", "create", at(0), 60), ("y", "create", at(0), 6000), ("y", "renew", at(1), 60)], [("x", "release", at(5), None), ("z", "create", at(30), None)], [("w", "create", at(50), None)]]
    for i, rows in enumerate(lots):
        spark.createDataFrame(rows, "id string, op string, at timestamp, ttl_seconds long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("id string, op string, at timestamp, ttl_seconds long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "1 minute")
    got = {(r.id, r.state) for r in drain(incremental.lease_stream(stream), "leases")}
    assert {("x", "created"), ("y", "created"), ("y", "renewed"), ("z", "created"), ("w", "created")} <= got
    assert ("x", "expired") in got and ("x", "released") not in got and ("y", "expired") in got and ("z", "expired") not in got


def test_incremental_map(spark):
    old = spark.createDataFrame([("a", "1", 10), ("b", "1", 11)], "key string, artifact string, result int")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, artifact string")
    out = incremental.incremental_map(old, new, lambda x: x.selectExpr("key", "99 as result"))
    assert sorted((r.key, r.result, r.status) for r in out.collect()) == [("a", 10, "hit"), ("b", 99, "miss"), ("c", 99, "miss")]
