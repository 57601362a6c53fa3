"""The content folder, hashes over runs of rows, and the history log."""

import hashlib
import pickle
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import manifests, runs
from lodestone.operators.historylog import HistoryLog
from lodestone.plans.catalogue import ORACLE_SQL, QUERIES
from lodestone.plans.project import Action, Output, Runner
from lodestone.sources import acquire, content


def sha(data):
    return hashlib.sha256(data).hexdigest()


def files(root):
    return {p.name: p.read_bytes() for p in Path(root).rglob("content/*/*") if p.is_file()}


def test_identical_writes_converge(spark, tmp_path):
    rows = spark.createDataFrame([(bytes([i % 5]) * 9,) for i in range(200)] + [(b"",), (None,)], "content binary").repartition(8)
    content.put(rows, str(tmp_path))
    content.put(rows, f"file:{tmp_path}")
    found = files(tmp_path)
    assert found == {sha(v): v for v in [bytes([i]) * 9 for i in range(5)] + [b""]} and all((tmp_path / content.place(h)).exists() for h in found)
    assert not list(Path(tmp_path).rglob("staging/*"))
    done = content.commits(spark, str(tmp_path)).collect()
    assert sorted((r.objects, r["size"]) for r in done) == [(201, 1800)] * 2 and min(r.new for r in done) == 0


def test_each_object_is_new_once(spark, tmp_path):
    """Copies in all tasks at once, named in several ways: every text counts as new in one task only."""
    rows = spark.range(4000, numPartitions=8).select(F.lpad((F.col("id") % 500).cast("string"), 2000, "x").cast("binary").alias("content"), "id")
    named = F.when(F.col("id") % 3 == 0, F.concat(F.lit("sha256:"), F.upper(F.sha2("content", 256)))).when(F.col("id") % 3 == 1, F.concat(F.lit("SHA256:"), F.sha2("content", 256)))
    for i in range(3):
        content.put(rows.withColumn("id", named), f"{tmp_path}/{i}", identity="id")
        done = content.commits(spark, f"{tmp_path}/{i}").first()
        assert (done.objects, done.new, done["size"]) == (4000, 500, 4000 * 2000)


def test_corrupt_object_is_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(b"good",), (b"other",)], "content binary")
    content.put(rows, str(tmp_path))
    (tmp_path / content.place(sha(b"good"))).write_bytes(b"evil")
    content.put(rows, str(tmp_path))
    assert files(tmp_path) == {sha(b"good"): b"good", sha(b"other"): b"other"}
    assert sorted(r.replaced for r in content.commits(spark, str(tmp_path)).collect()) == [0, 1]
    assert {r.id: bytes(r.content) for r in content.objects(spark, str(tmp_path)).collect()} == {"sha256:" + sha(v): v for v in (b"good", b"other")}


def test_wrong_identity_fails_and_leaves_no_staged_file(spark, tmp_path):
    rows = spark.createDataFrame([("sha256:" + sha(b"a"), b"a"), ("sha256:" + sha(b"b"), b"x")], "id string, content binary")
    with pytest.raises(Exception, match="content of sha256"):
        content.put(rows, str(tmp_path), identity="id")
    assert sha(b"x") not in files(tmp_path) and not list(Path(tmp_path).rglob("staging/*/*")) and not (tmp_path / "commits").exists()


def test_hashed_runs_and_pieces(spark):
    rows = [("a", None, i, f",{i}" * (i % 7)) for i in range(3000)] + [("b", 1, 0, None), ("b", 1, 1, ",x"), (None, 2, 0, ",n"), ("c", 1, 0, "")]
    df = spark.createDataFrame(rows, "g string, h int, o int, t string").repartition(6)
    whole = {}
    for g, h, _, t in sorted(rows, key=lambda r: (str(r[0]), r[2])):
        whole.setdefault((g, h), []).append(t or "")
    want = {}
    for k, parts in whole.items():
        parts[0] = parts[0][1:]
        want[k] = b"<" + "".join(parts).encode() + b">"
    got = runs.hashed_runs(df, ["g", "h"], ["o"], F.col("t"), b"<", b">", 1).collect()
    assert {(r.g, r.h): (r.parts, r["size"], r.sha256) for r in got} == {k: (len(whole[k]), len(v), sha(v)) for k, v in want.items()}
    text = {}
    for r in sorted(runs.pieces(df, ["g", "h"], ["o"], F.col("t"), b"<", b">", 1, most=100).collect(), key=lambda r: r.ordinal):
        assert len(r.data) < 300
        text[r.g, r.h] = text.get((r.g, r.h), b"") + bytes(r.data)
    assert text == want
    assert runs.hashed_runs(df.where("false"), ["g"], ["o"], F.col("t")).collect() == []


def test_manifests_without_cells(spark):
    rows = spark.range(30_000).selectExpr("cast(id % 3 as string) as g", "concat('d/', lpad(id, 9, '0')) as path", "'blob' as kind", "concat('sha256:', sha2(cast(id as string), 256)) as content", "id as size", "if(id % 2 = 0, true, null) as executable")
    short = {r.g: (r.entries, r.content) for r in manifests.trees(rows, ["g"]).collect()}
    assert {r.g: (r.entries, r.content) for r in manifests.tree_ids(rows, ["g"]).collect()} == short
    entries = acquire.entries(spark.createDataFrame([("s", "a/run.sh", b"x", True), ("s", "b", b"y", None), ("s", "../c", b"z", None)], "s string, path string, content binary, executable boolean"), ["s"])
    assert sorted((r.path, r.executable) for r in entries.collect()) == [("a/run.sh", True), ("b", None)]


def test_history_log(spark, tmp_path):
    log = HistoryLog(spark, str(tmp_path))
    row = lambda *r: spark.createDataFrame([r], "id int, state string, at int")
    assert log.table("attempts") is None and log.compact("attempts") is None
    log.stage("lost", {"attempts": row(9, "running", 0)})
    assert log.table("attempts").collect() == []
    log.commit(attempts=row(1, "running", 0), realizations=row(1, "x", 0))
    before = log.table("attempts")
    log.commit(attempts=row(1, "success", 1))
    log.commit(attempts=row(2, "running", 2))
    states = lambda: sorted(tuple(r) for r in log.newest("attempts", ["id"], ["at"]).collect())
    assert states() == [(1, "success", 1), (2, "running", 2)]
    assert log.compact("attempts", ["id"], ["at"]) and states() == [(1, "success", 1), (2, "running", 2)]
    assert log.table("attempts").count() == 2 and log.live("attempts").count() == 1 and log.table("realizations").count() == 1
    log.commit(attempts=row(2, "failed", 3))
    assert states() == [(1, "success", 1), (2, "failed", 3)] and before is not None


def test_runner_keeps_attempts(spark, tmp_path):
    run = Runner(spark, str(tmp_path), {})
    seen = []
    action = Action("t", ("f",), outputs={"out": Output()})

    def work():
        seen.append([r.finished_at for r in run.attempts().collect()])
        return {"out": spark.range(3)}

    run.run(action, work)
    with pytest.raises(ZeroDivisionError):
        run.run(Action("u", ("g",)), lambda: 1 / 0)
    assert seen == [[None]]
    later = Runner(spark, str(tmp_path), {})
    assert sorted((r.name, r.exit_code) for r in later.attempts().collect()) == [("t", 0), ("u", 1)]
    assert later.realizations().count() == 1 == later.log.table("outputs").count()
    attempt = later.attempts().where("name = 't'").first()
    assert not later.retry(attempt.id, {attempt.action_key: (action, work)}).hit


def test_compaction_groups_in_many_tasks(spark, tmp_path, monkeypatch):
    """Few files are written, but not by few tasks that group all rows."""
    log, plans = HistoryLog(spark, str(tmp_path)), []
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("at"))
    log.commit(t=rows)
    log.commit(t=rows.withColumn("at", F.col("at") + 1))
    stage = log.stage
    monkeypatch.setattr(log, "stage", lambda c, tables: plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in tables.values()) or stage(c, tables))
    made = log.compact("t", ["id"], ["at"], files=2)
    assert "Repartition 2, true" in plans[0]
    stored = spark.read.parquet(f"{tmp_path}/tables/t").where(F.col("commit_id") == made)
    assert stored.select(F.input_file_name()).distinct().count() == 2 and stored.count() == 1000
    assert {r.id: r.at for r in log.table("t").collect()} == {i: i % 7 + 1 for i in range(1000)}


def test_tasks_stage_in_folders_of_their_own(tmp_path):
    import pyarrow as pa

    writer = content._Writer(str(tmp_path), "content")
    batch = lambda *values: pa.RecordBatch.from_pydict({"id": pa.array([None] * len(values), pa.string()), "content": pa.array(values, pa.binary()), "copies": pa.array([2] * len(values), pa.int64())})
    done = [writer.write(iter([batch(b"a", b"bc"), batch(b"a")])), writer.write(iter([batch(b"d")]))]
    assert [(m.objects, m.new, m.size) for m in done] == [(6, 2, 8), (2, 1, 2)] and files(tmp_path).keys() == {sha(v) for v in (b"a", b"bc", b"d")}
    assert len(list((tmp_path / "staging" / writer.job).iterdir())) == 2
    writer.commit(done)
    assert not list((tmp_path / "staging").iterdir())


def test_a_repeated_task_counts_what_the_first_one_put(tmp_path):
    """A task ends after it has put objects, as with a lost executor, and runs again: what was new or wrong to the first is so to the job."""
    import pyarrow as pa

    batch = lambda *values: pa.RecordBatch.from_pydict({"id": pa.array([None] * len(values), pa.string()), "content": pa.array(values, pa.binary()), "copies": pa.array([1] * len(values), pa.int64())})

    def lost():
        yield batch(b"a", b"b")
        raise OSError("lost")

    wrong = tmp_path / content.place(sha(b"b"))
    wrong.parent.mkdir(parents=True)
    wrong.write_bytes(b"evil")
    writer = pickle.dumps(content._Writer(str(tmp_path), "content"))
    with pytest.raises(OSError, match="lost"):
        pickle.loads(writer).write(lost())
    assert files(tmp_path) == {sha(v): v for v in (b"a", b"b")}
    done = pickle.loads(writer).write(iter([batch(b"c", b"a"), batch(b"b", b"d")]))
    assert (done.objects, done.new, done.replaced) == (4, 3, 1)
    pickle.loads(writer).commit([done])
    assert not list((tmp_path / "staging").iterdir())
    again = content._Writer(str(tmp_path), "content").write(iter([batch(b"a", b"b", b"c", b"d")]))
    assert (again.objects, again.new, again.replaced) == (4, 0, 0)


def cas_write_and_sql(spark, folder, texts):
    """Rows of cas_write on these texts, and of its SQL."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{folder}/documents.parquet")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL["cas_write"])
    return order(QUERIES["cas_write"](spark, str(folder)).select(*want.columns).collect()), order(want.fetchall())


def test_cas_write_with_null_texts(spark, tmp_path):
    got, want = cas_write_and_sql(spark, tmp_path, ["a", None, "b", "a", None])
    assert got == want and len(got) == 3


def test_cas_write_with_empty_texts(spark, tmp_path):
    got, want = cas_write_and_sql(spark, tmp_path, ["", "a", None, ""])
    assert got == want and len(got) == 3


def test_objects_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Names of objects don't reach the driver: its plan holds no files. Batches are bounded by bytes, and no row is lost."""
    content.put(spark.range(3000).select(F.concat(F.lit("t"), F.col("id").cast("string")).cast("binary").alias("content")), str(tmp_path))
    assert content.objects(spark, str(tmp_path)).inputFiles() == []
    monkeypatch.setattr(content, "BATCH", 20)
    df = content.objects(spark, f"file:{tmp_path}/")
    assert 1 < df.rdd.getNumPartitions() <= 256
    want = {"sha256:" + sha(v): v for v in (b"t%d" % i for i in range(3000))}
    assert {r["id"]: (r["size"], bytes(r["content"])) for r in df.collect()} == {k: (len(v), v) for k, v in want.items()}
    assert content.objects(spark, str(tmp_path), "artifacts").collect() == []
    with pytest.raises(FileNotFoundError):
        content.objects(spark, f"{tmp_path}/absent")
