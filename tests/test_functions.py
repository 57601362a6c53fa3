import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import canonical, globs, scalars
from lodestone.plans.project import Action, ActionBuilder, Output, action_diff


def column(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_paths(spark):
    raw = ["../x", "..\\x", "/etc/passwd", "C:/x", "C:\\x", "a/b", "a\\.\\b", "./a//b/", "", ".", None, "a/..b"]
    assert column(spark, scalars.path("v"), raw) == [None] * 5 + ["a/b", "a/b", "a/b", None, None, None, "a/..b"]


def test_references(spark):
    got = column(spark, scalars.reference("v"), ["S3:bucket/a:b", "x", ":y", "a b:c", "h+1.-_:z", "s:", None])
    assert [tuple(g) if g else None for g in got] == [("s3", "bucket/a:b"), None, None, None, ("h+1.-_", "z"), None, None]


def test_digests_and_names(spark):
    d = "sha256:" + "Ab" * 32
    assert column(spark, scalars.digest("v"), [d, "md5:" + "a" * 64, d[:-1], None]) == [d.lower(), None, None, None]
    assert column(spark, scalars.file_name("v"), ["a/b c", "é.x"]) == ["a_b_c", "_.x"]
    assert column(spark, scalars.env_name("v"), ["a-b.1", "É"]) == ["A_B_1", "_"]
    assert column(spark, scalars.shell_join(F.array("v", F.lit("b"))), ["it's"]) == ["'it'\\''s' 'b'"]
    assert column(spark, scalars.translate_prefix("v", "/a", "/z"), ["/a/x", "/ab", "b"]) == ["/z/x", "/zb", "b"]
    assert column(spark, scalars.env_reference("v"), ["${HOME}", "x${HOME}", "${}"]) == ["HOME", None, None]
    assert column(spark, scalars.fallback_name("v", "d"), ["a/b.txt", "r#c.bin", "a/b"]) == ["b.txt", "c.bin", "d"]
    assert column(spark, scalars.lossy_text("v"), [b"a\xff", b"\xc3\xa9"], "binary") == ["a\ufffd", "é"]
    assert [tuple(x) for x in column(spark, scalars.assignment("v"), ["a=b=c"])] == [("a", "b=c")]


def test_substitution_is_sequential(spark):
    row = spark.range(1).select(scalars.substitute(F.lit("{a}-{b}"), F.create_map(F.lit("{b}"), F.lit("2"), F.lit("{a}"), F.lit("{b}"))).alias("x")).first()
    assert row.x == "2-2"


def test_costs_and_status(spark):
    rows = spark.createDataFrame([(3_600_000, 1), (1, 3_599_999), (None, 5), (9_000_000_000_000_000, 3_600_000)], "rate long, ms long")
    assert [r[0] for r in rows.select(scalars.cost_micros("rate", "ms")).collect()] == [1, 0, 0, 9_000_000_000_000_000]


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.txt", ["a.txt", "d/a.txt"], ["a.txt2"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]), ("[!a]?", ["bc"], ["ac", "b"]), ("{x,y}.{1,2}", ["x.1", "y.2"], ["z.1"]), ("a\\*", ["a*"], ["ab"]), ("**", ["", "a/b"], [])])
def test_globs(spark, glob, yes, no):
    assert column(spark, globs.selected("v", [glob]), yes + no) == [True] * len(yes) + [False] * len(no)


def test_selection_excludes_last(spark):
    assert column(spark, globs.selected("v", [], ["*.tmp"]), ["a", "a.tmp"]) == [True, False]
    assert column(spark, globs.selected("v"), ["a"]) == [True]


def test_action_identity():
    plain = Action("x", ("echo", "hi"))
    assert plain.identity() == b'{"version":1,"command":["echo","hi"],"inputs":{},"code":{},"parameters":null,"environment":{"variables":{}},"outputs":{},"network":"deny","sandbox":"read_only_inputs","platform":null}'
    same = Action("other", ("echo", "hi"), cache="pure", timeout_seconds=5, max_usd_micros=7)
    assert same.key() == plain.key()
    assert Action("x", ("echo", "hi", "!")).key() != plain.key()
    assert action_diff(plain, same) == ["cache", "max_usd_micros", "name", "timeout_seconds"]
    assert Action("x", ("a",), timeout_seconds=9, max_wall_seconds=4).wall_limit() == 4
    with pytest.raises(ValueError):
        Action("x", ())


def test_builder():
    art = "sha256:" + "a" * 64
    a = ActionBuilder("t", "run").args("-v", "1").input("b", art).input("a", art).code("c", art).output("o", Output("tree", "x/y")).parameter("k", {"z": 1, "a": 2}).env("E", "1").options(network="allow").build()
    record = json.loads(a.identity())
    assert list(record["inputs"]) == ["a", "b"] and list(record["parameters"]["k"]) == ["a", "z"] and record["outputs"]["o"] == {"kind": "tree", "media_type": "x/y"}
    assert a.summary() == {"argv": 3, "code": 1, "inputs": 2, "outputs": 1}


def test_canonical_manifests():
    content = "sha256:" + hashlib.sha256(b"x").hexdigest()
    assert canonical.artifact_manifest(content, "blob").decode() == '{"version":1,"content":{"algorithm":"sha256","value":"' + content[7:] + '"},"kind":"blob"}'
    assert canonical.artifact_id(content, "blob", annotations={"b": "1", "a": "2"}) == canonical.artifact_id(content, "blob", annotations={"a": "2", "b": "1"})
    assert canonical.artifact_id(content, "blob", media_type="a/b") != canonical.artifact_id(content, "blob")
    with pytest.raises(ValueError):
        canonical.artifact_id("md5:x", "blob")
    receipt = {"schema": "s", "payload": {"a": 1}}
    assert canonical.receipt_id(receipt) != canonical.receipt_id(receipt | {"payload": {"a": 2}})
    assert canonical.receipt_id(receipt) == canonical.receipt_id(receipt | {"receipt_id": "anything"})
