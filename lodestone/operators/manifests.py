"""Tree and collection manifests: sorted entries, canonical JSON, identity, listings, differences.

``trees`` and ``collections`` give the manifest as a cell, which has to hold it; ``tree_ids`` and ``collection_ids`` give
the identity alone and ``tree_pieces`` the text in pieces, for manifests of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import digest_json, quoted
from ..functions.scalars import content_id
from . import runs


def _manifest(entries: DataFrame, group: list[str], order: str, entry: Column) -> DataFrame:
    listed = entries.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), entry.alias("j")))).alias("_e"))
    json = F.concat(F.lit('{"version":1,"entries":['), F.array_join(F.transform("_e", lambda e: e["j"]), ","), F.lit("]}"))
    return listed.withColumn("manifest", json).withColumn("entries", F.size("_e")).withColumn("content", content_id("manifest")).drop("_e")


def tree_entry() -> Column:
    """An entry of a tree as JSON, from path, kind, content, size, executable (or null)."""
    flag = F.when(F.col("executable").isNotNull(), F.concat(F.lit(',"executable":'), F.col("executable").cast("string"))).otherwise("")
    return F.concat(F.lit('{"path":'), quoted("path"), F.lit(',"kind":"'), F.col("kind"), F.lit('","content":'), digest_json("content"), F.lit(',"size":'), F.col("size").cast("string"), flag, F.lit("}"))


def collection_entry() -> Column:
    """An entry of a collection as JSON, from key, artifact, label (or null)."""
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit(',"label":'), quoted("label"))).otherwise("")
    return F.concat(F.lit('{"key":'), quoted("key"), F.lit(',"artifact":'), digest_json("artifact"), label, F.lit("}"))


def trees(entries: DataFrame, group: list[str]) -> DataFrame:
    """group, manifest, entries, content of each tree; entries have path, kind, content, size, executable (or null)."""
    return _manifest(entries, group, "path", tree_entry())


def collections(entries: DataFrame, group: list[str]) -> DataFrame:
    """group, manifest, entries, content of each collection; entries have key, artifact, label (or null)."""
    return _manifest(entries, group, "key", collection_entry())


FRAME = {"before": b'{"version":1,"entries":[', "after": b"]}", "skip": 1}


def _ids(entries: DataFrame, group: list[str], order: str, entry: Column) -> DataFrame:
    listed = entries.select(*group, F.col(order).alias("_k"), F.concat(F.lit(","), entry).alias("_j"))
    made = runs.hashed_runs(listed, group, ["_k", "_j"], F.col("_j"), **FRAME)
    return made.select(*group, F.col("parts").cast("int").alias("entries"), F.concat(F.lit("sha256:"), "sha256").alias("content"), "size")


def tree_ids(entries: DataFrame, group: list[str]) -> DataFrame:
    """group, entries, content, size (of the manifest) of each tree of ``trees``, however many entries it has."""
    return _ids(entries, group, "path", tree_entry())


def collection_ids(entries: DataFrame, group: list[str]) -> DataFrame:
    """group, entries, content, size (of the manifest) of each collection of ``collections``, however many entries it has."""
    return _ids(entries, group, "key", collection_entry())


def tree_pieces(entries: DataFrame, group: list[str], most: int = 1 << 20) -> DataFrame:
    """group, ordinal, data: each tree's manifest in pieces of about most bytes."""
    listed = entries.select(*group, F.col("path").alias("_k"), F.concat(F.lit(","), tree_entry()).alias("_j"))
    return runs.pieces(listed, group, ["_k", "_j"], F.col("_j"), **FRAME, most=most)


def artifact_json(content: Column | str, kind: str, media_type: Column | None = None) -> Column:
    media = F.lit("") if media_type is None else F.when(media_type.isNotNull(), F.concat(F.lit(',"media_type":'), quoted(media_type))).otherwise("")
    return F.concat(F.lit('{"version":1,"content":'), digest_json(content), F.lit(f',"kind":"{kind}"'), media, F.lit("}"))


def artifact_ids(rows: DataFrame, content: str, kind: str, media_type: Column | None = None, name: str = "artifact") -> DataFrame:
    return rows.withColumn(name, content_id(artifact_json(content, kind, media_type)))


TREE = "struct<version:int,entries:array<struct<path:string,kind:string,content:struct<algorithm:string,value:string>,size:bigint,executable:boolean>>>"
COLLECTION = "struct<version:int,entries:array<struct<key:string,artifact:struct<algorithm:string,value:string>,label:string>>>"


def list_tree(manifests: DataFrame, keep: list[str], manifest: str = "manifest") -> DataFrame:
    """A row for each entry, decoded from the manifest's JSON, with its place."""
    e = manifests.select(*keep, F.posexplode(F.from_json(manifest, TREE)["entries"]).alias("ordinal", "e"))
    return e.select(*keep, "ordinal", "e.path", "e.kind", F.concat_ws(":", "e.content.algorithm", "e.content.value").alias("content"), "e.size", "e.executable")


def list_collection(manifests: DataFrame, keep: list[str], manifest: str = "manifest") -> DataFrame:
    e = manifests.select(*keep, F.posexplode(F.from_json(manifest, COLLECTION)["entries"]).alias("ordinal", "e"))
    return e.select(*keep, "ordinal", "e.key", F.concat_ws(":", "e.artifact.algorithm", "e.artifact.value").alias("artifact"), "e.label")


def diff(old: DataFrame, new: DataFrame, on: str, value: str) -> DataFrame:
    """on, change: added, removed or changed; equal entries are left out."""
    a, b = old.select(on, F.col(value).alias("old")), new.select(on, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, on, "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(on, "old", "new", change.alias("change"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Both frames hold the same rows, as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def repeated_keys(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def blobs_of(entries: DataFrame) -> DataFrame:
    """Entries that a task is mapped over: blobs, not trees or links."""
    return entries.where(F.col("kind") == "blob")


def decoded(rows: DataFrame, record: str, schema: str, name: str = "record") -> DataFrame:
    """rows with a column of JSON text as a typed record; NULL where it is no such JSON."""
    return rows.withColumn(name, F.from_json(record, schema))
