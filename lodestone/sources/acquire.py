"""From files to stored objects: selection, trees, collections, imports, and back to files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import selected
from ..functions.scalars import content_id, file_name
from ..functions.scalars import path as normal_path
from ..operators import manifests


def entries(files: DataFrame, group: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """Tree entries of files; paths that leave their root are left out. Files with a column executable keep that bit."""
    data, bit = F.col(content).cast("binary"), F.col("executable").cast("boolean") if "executable" in files.columns else F.lit(None).cast("boolean")
    return files.select(*group, normal_path(path).alias("path"), F.lit("blob").alias("kind"), content_id(data).alias("content"), F.octet_length(data).cast("bigint").alias("size"), bit.alias("executable")).where("path is not null")


def acquired(files: DataFrame, group: list[str], include: Iterable[str] = (), exclude: Iterable[str] = (), path: str = "path", content: str = "content") -> DataFrame:
    """group, kind, content, files: what each source comes to.

    A blob if one file was resolved and it was selected, else a tree of the selected files
    (also where only one of several was); sources with nothing selected have no row.
    """
    resolved = files.groupBy(*group).agg(F.count("*").alias("resolved"))
    chosen = entries(files.where(selected(path, include, exclude)), group, path, content)
    trees = manifests.tree_ids(chosen, group).select(*group, F.col("content").alias("tree"), F.col("entries").alias("files"))
    blobs = chosen.groupBy(*group).agg(F.min("content").alias("blob"))
    single = (F.col("files") == 1) & (F.col("resolved") == 1)
    return trees.join(blobs, group).join(resolved, group).select(*group, F.when(single, "blob").otherwise("tree").alias("kind"), F.when(single, F.col("blob")).otherwise(F.col("tree")).alias("content"), "files")


def members(files: DataFrame, group: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """group, key, kind, content: children of a folder; a file is a blob, a folder a tree of what is below it."""
    e = entries(files, group, path, content).withColumn("key", F.substring_index("path", "/", 1))
    nested = F.col("path").contains("/")
    below = e.where(nested).withColumn("path", F.expr("substring(path, length(key) + 2)"))
    trees = manifests.tree_ids(below, [*group, "key"]).select(*group, "key", F.lit("tree").alias("kind"), "content")
    return e.where(~nested).select(*group, "key", "kind", "content").unionByName(trees)


def imported_store(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """id, size, valid of a flat store whose file names are hashes."""
    data = F.col(content).cast("binary")
    return files.select(content_id(data).alias("id"), F.octet_length(data).cast("bigint").alias("size"), (F.substring_index(path, "/", -1) == F.sha2(data, 256)).alias("valid"))


def searched(catalog: DataFrame, text: str, columns: list[str], order: list[str], limit: int, cursor: int = 0, after: Sequence | None = None) -> DataFrame:
    """Rows with text in any of columns, in order (nulls first), from cursor on or after a row.

    after has the values of order in the last row of the page before. It costs the same for each page, while a cursor
    sorts all rows before it again; order should name one row only, or rows equal to the last one are passed over.
    """
    hit = F.lit(False)
    for c in columns:
        hit |= F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    found = catalog.where(hit)
    if after is not None:
        last = [F.lit(v).cast(catalog.schema[c].dataType) for c, v in zip(order, after, strict=True)]
        if after[0] is not None:
            found = found.where(F.col(order[0]) >= last[0])  # reaches the scan
        found = found.where(F.struct(*order) > F.struct(*[v.alias(c) for c, v in zip(order, last, strict=True)]))
    return found.orderBy(*order).offset(cursor).limit(limit)


def conformance(resolved: DataFrame, listed: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """path, fault: duplicate, unsafe, unselected, unlisted or unresolved; no rows if a provider conforms."""
    path = F.col("path")
    faults = [
        resolved.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("duplicate").alias("fault")),
        resolved.where(normal_path("path").isNull()).select("path", F.lit("unsafe").alias("fault")),
        resolved.where(~selected(path, include, exclude)).select("path", F.lit("unselected").alias("fault")),
        resolved.select("path").distinct().exceptAll(listed.select("path").distinct()).withColumn("fault", F.lit("unlisted")),
        listed.select("path").distinct().exceptAll(resolved.select("path").distinct()).withColumn("fault", F.lit("unresolved")),
    ]
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out.distinct()


def materialised(files: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """Writes files below root, a folder that all executors mount, and returns path, size, sha256.

    Each file is written beside its place and renamed. Names that only differ in characters
    a file system may not have must not meet, so paths are kept as they are; unsafe ones raise.
    """
    rows = files.select(normal_path(path).alias("path"), F.col(path).alias("raw"), F.col(content).cast("binary").alias("content"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for r in f.itertuples():
                if r.path is None:
                    raise ValueError(f"unsafe path {r.raw!r}")
                to = Path(root) / r.path
                to.parent.mkdir(parents=True, exist_ok=True)
                beside = to.with_name(f".{to.name}.{os.getpid()}")
                beside.write_bytes(bytes(r.content))
                beside.replace(to)
                done.append((r.path, len(r.content), hashlib.sha256(bytes(r.content)).hexdigest()))
            yield pd.DataFrame(done, columns=["path", "size", "sha256"])

    return rows.mapInPandas(put, "path string, size long, sha256 string")


def colliding(names: DataFrame, column: str) -> DataFrame:
    """Names that become equal as file names."""
    return names.select(column).distinct().withColumn("file", file_name(column)).groupBy("file").agg(F.array_sort(F.collect_list(column)).alias("names")).where(F.size("names") > 1)


def counted(files: DataFrame, depth: int = 1, path: str = "path") -> DataFrame:
    """folder, files: how many files lie below each folder of that depth; '.' for those above it."""
    parts = F.split(normal_path(path), "/")
    folder = F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise(F.lit("."))
    return files.where(normal_path(path).isNotNull()).groupBy(folder.alias("folder")).agg(F.count("*").alias("files"))
