"""Copies of stored objects by waves, and the files of artifacts."""

import hashlib
from pathlib import Path

import pytest

from lodestone.operators import chunking, graph, manifests
from lodestone.plans.catalogue import QUERIES
from lodestone.sources import content, mirror


def sha(data):
    return hashlib.sha256(data).hexdigest()


def name(data):
    return "sha256:" + sha(data)


A, B, TREE, ART, TOP = b"first", b"second" * 500_000, b"tree of a, b", b"artifact of tree", b"artifact of artifact"


@pytest.fixture
def stored(spark, tmp_path):
    here = str(tmp_path / "here")
    content.put(spark.createDataFrame([(A,), (B,), (TREE,)], "content binary"), here)
    content.put(spark.createDataFrame([(ART,), (TOP,)], "content binary"), here, role="artifacts")
    edges = [(TOP, ART), (TOP, A), (ART, TREE), (TREE, A), (TREE, B), (TREE, A)]
    edges = spark.createDataFrame([(name(s), name(t)) for s, t in edges] + [(None, name(A))], "src string, dst string")
    artifacts = spark.createDataFrame([(name(ART),), (name(TOP),)], "id string")
    return here, mirror.waves(spark.createDataFrame([(name(TOP),), (name(TOP),), (None,)], "node string"), edges, artifacts)


def status(rows):
    return {r.node: (r.role, r.level, r["size"], r.status) for r in rows.collect()}


def test_leaves_come_first_and_a_second_copy_finds_all(stored, tmp_path):
    here, waves = stored
    there = str(tmp_path / "there")
    want = {name(A): ("content", 0, 5), name(B): ("content", 0, len(B)), name(TREE): ("content", 1, len(TREE)), name(ART): ("artifacts", 2, len(ART)), name(TOP): ("artifacts", 3, len(TOP))}
    assert status(mirror.copied(waves, here, there)) == {k: (*v, "copied") for k, v in want.items()}
    assert status(mirror.copied(waves, here, there)) == {k: (*v, "present") for k, v in want.items()}
    assert (Path(there) / content.place(sha(B))).read_bytes() == B and not list(Path(there).glob("staging/*"))
    (Path(there) / content.place(sha(A))).write_bytes(b"worse")
    assert status(mirror.copied(waves, here, there, trust=True))[name(A)][3] == "present"
    assert status(mirror.copied(waves, here, f"file:{there}"))[name(A)] == ("content", 0, 5, "replaced")


@pytest.mark.parametrize("broken", [TREE, None])
def test_a_broken_copy_is_refused_before_its_parents_and_taken_up_again(stored, tmp_path, broken):
    here, waves = stored
    there, place = tmp_path / "there", Path(here) / content.place(sha(TREE))
    if broken is None:
        place.unlink()
    else:
        place.write_bytes(b"other bytes")
    with pytest.raises(Exception, match="is not in" if broken is None else "content of sha256"):
        mirror.copied(waves, here, str(there)).collect()
    assert sorted(p.name for p in there.rglob("*") if p.is_file() and "commits" not in str(p)) == sorted([sha(A), sha(B)])
    place.write_bytes(TREE)
    got = status(mirror.copied(waves, here, str(there)))
    assert [got[name(x)][3] for x in (A, B, TREE, ART, TOP)] == ["present", "present", "copied", "copied", "copied"]


def test_nothing_and_cycles(spark, stored, tmp_path):
    here, waves = stored
    assert mirror.copied(waves.where("false"), here, str(tmp_path / "empty")).collect() == []
    with pytest.raises(ValueError, match="cycle"):
        mirror.waves(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), spark.createDataFrame([], "id string"))


def layout(spark):
    """A collection of a plain blob, a chunked one, an empty chunked one, a tree, and a collection with the tree again."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    artifacts = frame([("plain", name(A), "blob"), ("cut", "m1", "blob"), ("empty", "m2", "blob"), ("tree", "t", "tree"), ("inner", "c2", "collection"), ("outer", "c1", "collection")], "id string, content string, kind string")
    members = frame([("c1", "a b", "plain"), ("c1", "cut", "cut"), ("c1", "empty", "empty"), ("c1", "in", "inner"), ("c2", "x/y", "tree"), ("c2", "again", "plain")], "collection_content string, key string, artifact string")
    entries = frame([("t", "bin/run", name(B), True), ("t", "doc.txt", name(A), None)], "tree_content string, path string, content string, executable boolean")
    chunks = frame([("m1", 0, name(A)), ("m1", 1, name(B)), ("m1", 2, name(A))], "manifest_content string, ordinal int, content string")
    headers = frame([("m1", name(A + B + A)), ("m2", sha(b""))], "manifest_content string, logical_sha256 string")
    return artifacts, members, entries, chunks, headers


def test_files_of_artifacts(spark, stored, tmp_path):
    here, _ = stored
    roots = spark.createDataFrame([("outer", "o"), ("plain", "p.txt")], "artifact string, path string")
    files = mirror.expanded(roots, *layout(spark))
    want = {"o/a_b": A, "o/cut": A + B + A, "o/empty": b"", "o/in/x_y/bin/run": B, "o/in/x_y/doc.txt": A, "o/in/again": A, "p.txt": A}
    for whole in (True, False, True):
        out = tmp_path / "out"
        (out / "old").parent.mkdir(exist_ok=True)
        (out / "old").write_text("x")
        got = mirror.materialised(files, here, str(out), whole)
        assert {(r.path, r["size"], r.sha256) for r in got.collect()} == {(k, len(v), sha(v)) for k, v in want.items()}
        assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == want | ({} if whole else {"old": b"x"})
        assert (out / "o/in/x_y/bin/run").stat().st_mode & 0o111 and not (out / "p.txt").stat().st_mode & 0o111
        assert not list(tmp_path.glob("out.*"))


def test_a_wrong_hash_changes_nothing(spark, stored, tmp_path):
    here, _ = stored
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "kept").write_text("x")
    artifacts, members, entries, chunks, _ = layout(spark)
    headers = spark.createDataFrame([("m1", sha(b"else"))], "manifest_content string, logical_sha256 string")
    files = mirror.expanded(spark.createDataFrame([("cut", "c")], "artifact string, path string"), artifacts, members, entries, chunks, headers)
    with pytest.raises(Exception, match="content of 'c'"):
        mirror.materialised(files, here, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["kept"] and not list(tmp_path.glob("out.*"))


def test_what_has_no_files(spark, stored, tmp_path):
    here, _ = stored
    artifacts, members, entries, chunks, headers = layout(spark)
    roots = lambda *r: spark.createDataFrame(list(r), "artifact string, path string")
    assert mirror.materialised(mirror.expanded(roots(), artifacts, members, entries, chunks, headers), here, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="no artifact lost"):
        mirror.expanded(roots(("lost", "x")), artifacts, members, entries, chunks, headers).collect()
    with pytest.raises(ValueError, match="both at 'x'"):
        mirror.materialised(mirror.expanded(roots(("plain", "x"), ("cut", "x")), artifacts, members, entries, chunks, headers), here, str(tmp_path / "none"))
    bad = spark.createDataFrame([("t", "../up", name(A), None)], "tree_content string, path string, content string, executable boolean")
    with pytest.raises(Exception, match="unsafe path"):
        mirror.expanded(roots(("tree", "x")), artifacts, members, bad, chunks, headers).collect()


def test_content_edges_feed_waves(spark):
    one = spark.createDataFrame([("a", "c", None)], "id string, content string, schema string")
    pair = lambda x, y: spark.createDataFrame([], f"{x} string, {y} string")
    edges = graph.content_edges(one, pair("collection_content", "artifact"), pair("tree_content", "content"), pair("manifest_content", "content"))
    got = mirror.waves(spark.createDataFrame([("a",)], "node string"), edges, one)
    assert {(r.node, r.role, r.level) for r in got.collect()} == {("a", "artifacts", 1), ("c", "content", 0)}


@pytest.mark.parametrize("query,module,function", [("artifact_files", chunking, "chunks"), ("mirror_push", manifests, "trees")])
def test_queries_make_their_objects_once(spark, monkeypatch, query, module, function):
    """What names chunks and trees is computed once, however many steps read the names."""
    made, rows, right = getattr(module, function), spark.sparkContext.accumulator(0), []

    def counted(*args):
        out = made(*args)
        right.append(out.count())

        def count(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b

        return out.mapInArrow(count, out.schema)

    monkeypatch.setattr(module, function, counted)
    assert QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0
    assert right == [rows.value] and rows.value > 0
