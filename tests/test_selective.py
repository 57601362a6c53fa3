"""Files chosen before they are read, and differences of records."""

import json
from pathlib import Path

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lodestone.operators import history
from lodestone.sources import acquire, selective

NAMES = ["a.txt", "b.csv", "in/a.txt", "in/deep/c.txt", "in/deep/er/d.txt", "out/a.txt", "out/a.txt\n", "é/ü.txt"]


@pytest.fixture
def root(tmp_path):
    for i, n in enumerate(NAMES):
        p = tmp_path / "r" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * i)
    return str(tmp_path / "r")


def paths(df):
    return sorted(r.path for r in df.collect())


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_all_files_once_however_they_are_dealt(spark, root, tasks):
    got = selective.files(spark, root, tasks=tasks, split=3).collect()
    assert sorted((r.path, r["size"], bytes(r.content)) for r in got) == sorted((n, i, b"x" * i) for i, n in enumerate(NAMES))
    assert {r.authority for r in got} == {"file:"} and len({r.version for r in got}) == len(NAMES)
    assert paths(selective.files(spark, f"file://{root}", ["in/**"], ["*/er/*"], content=False, tasks=tasks)) == ["in/a.txt", "in/deep/c.txt"]
    assert paths(selective.files(spark, root, ["*.txt"], tasks=tasks)) == sorted(n for n in NAMES if n.endswith(".txt"))


def test_conditions_are_pushed_and_nothing_else_is_opened(spark, root):
    cases = {
        "path = 'in/a.txt'": ["in/a.txt"], "path IN ('a.txt', 'out/a.txt')": ["a.txt", "out/a.txt"], "path LIKE 'in/%'": NAMES[2:5], "path LIKE '%.csv'": ["b.csv"], "path LIKE '%deep%'": NAMES[3:5],
        "size > 1 AND size <= 3": NAMES[2:4], "size IN (0, 5)": ["a.txt", "out/a.txt"], "size < 2 OR path = 'b.csv'": ["a.txt", "b.csv"], "path > 'out'": ["out/a.txt", "out/a.txt\n", "é/ü.txt"],
        "NOT path = 'a.txt' AND size < 2": ["b.csv"], "path IS NULL": [],
    }
    for where, want in cases.items():
        assert paths(selective.files(spark, root).where(where)) == sorted(want), where
    assert "PushedFilters: [IsNotNull(size), GreaterThan(size,1)]" in selective.files(spark, root).where("size > 1")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    reader = selective.SelectedFiles({"path": root, "include": json.dumps(["*.txt"])}).reader(spark.createDataFrame([], selective.LISTED + ", content binary").schema)
    left = list(reader.pushFilters([D.GreaterThan(("size",), 2), D.StringStartsWith(("path",), "in/"), D.GreaterThan(("path",), "a"), D.IsNotNull(("size",)), D.EqualTo(("content",), b"")]))
    assert left == [D.GreaterThan(("path",), "a"), D.EqualTo(("content",), b"")]
    lots = reader.partitions()
    assert {f for x in lots for f, _ in x.folders} == {"", "in/", "in/deep/", "in/deep/er/"}  # out/ and é/ are not listed
    for p in Path(root).rglob("*"):
        if p.is_file() and str(p.relative_to(root)) not in NAMES[3:5]:
            size = p.stat().st_size
            p.unlink()
            p.symlink_to(f"/proc/self/fd/{900 + size}")  # opening it would fail
    assert sorted(r[1] for x in lots for r in reader.read(x)) == NAMES[3:5]


def test_pages_follow_one_another(spark):
    rows = [(n, k) for k, n in enumerate(["ab", None, "b", "ab", "aé", None, "a", "ab", "xa\n"])]
    catalog = spark.createDataFrame(rows, "name string, k int").withColumn("all", F.lit("A"))
    walked, last = [], None
    while page := acquire.searched(catalog, "a", ["all"], ["name", "k"], 2, after=last).collect():
        walked += [(r.name, r.k) for r in page]
        last = walked[-1]
    assert walked == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    plan = acquire.searched(catalog, "a", ["name"], ["name", "k"], 2, after=("ab", 0))
    assert [(r.name, r.k) for r in plan.collect()] == [("ab", 3), ("ab", 7)]


def test_empty_and_missing_roots(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert selective.files(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="lost"):
        selective.files(spark, str(tmp_path / "lost")).collect()


def test_record_changes(spark):
    def changes(rows):
        old, new = ([(k, v) for k, *both in rows if (v := both[i]) != "-"] for i in (0, 1))
        frame = lambda r: spark.createDataFrame(r, "k string, record string").withColumn("path", F.lit("clash"))
        return {(r.k, r.path, r.old, r.new) for r in history.record_changes(frame(old), frame(new), "k").collect()}

    deep = lambda v: '{"a":' * 40 + v + "}" * 40
    assert changes([
        ("same", '{"a":1,"b":[1,{"c":2}]}', '{"b":[1,{"c":2}],"a":1}'), ("value", '{"a":1,"b":{"c":2,"d":3}}', '{"a":1,"b":{"c":2,"d":4}}'), ("gone", '{"a":null}', "{}"), ("kind", '{"a":{"b":1}}', '{"a":[1]}'),
        ("names", '{"a/b":{"~":1},"":1}', '{"a/b":{"~":2},"":2}'), ("number", "1", "1.5"), ("decimal", "1", "1.0"), ("array", "[1,2]", "[2,1]"), ("left", '{"a":1}', "-"), ("right", "-", "2"), ("null", None, '"x"'), ("nulls", None, None), ("deep", deep("1"), deep("2")), (None, "1", "-"),
    ]) == {
        ("value", "/b/d", "3", "4"), ("gone", "/a", "null", None), ("kind", "/a", '{"b":1}', "[1]"), ("names", "/a~1b/~0", "1", "2"), ("names", "/", "1", "2"), ("number", "", "1", "1.5"), ("array", "", "[1,2]", "[2,1]"),
        ("left", "", '{"a":1}', None), ("right", "", None, "2"), ("null", "", None, '"x"'), ("deep", "/a" * 40, "1", "2"), (None, "", "1", None),
    }
    assert changes([]) == set() and changes([("a", "1", "1")]) == set()
    with pytest.raises(Exception, match="MALFORMED"):
        changes([("a", "{", "1")])
