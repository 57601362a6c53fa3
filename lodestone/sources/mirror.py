"""Stored objects from one content folder to another, from leaves to roots, and the files that artifacts stand for.

Nothing here holds an object in a cell: a task streams it in blocks, hashes it on the way, and moves it to its place
only if its hash is its name. Any file system that pyarrow opens will do, on both sides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.scalars import file_name
from ..functions.scalars import path as normal_path
from ..operators.graph import closure, level_table, union
from ..operators.runs import in_order
from .content import opened, place

BLOCK = 1 << 20


def _hash(stream) -> tuple[str, int]:
    digest, size = hashlib.sha256(), 0
    while block := stream.read(BLOCK):
        digest.update(block)
        size += len(block)
    return digest.hexdigest(), size


def _parent(store, path: str, made: set[str]) -> None:
    """Makes the folder of a path, unless it is one of those that this task has made."""
    folder = path.rsplit("/", 1)[0]
    if folder not in made:
        store.create_dir(folder, recursive=True)
        made.add(folder)


def waves(roots: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """node, role, level of all that roots (node) reach over edges (src, dst; see ``graph.content_edges``).

    role is artifacts for a manifest of artifacts (id), else content. A level is the longest way down to a leaf, so
    every object stands above all that it names. Nulls are no nodes, a repeated root or edge counts once. Raises on a cycle.
    """
    reached = written(closure(roots, edges).select("node"))
    inside = edges.join(reached.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("task"), F.col("dst").alias("depends_on"))
    levelled = level_table(reached.select(F.col("node").alias("task")), inside).withColumnRenamed("task", "node")
    named = artifacts.select(F.col("id").alias("node"), F.lit("artifacts").alias("role")).distinct()
    return levelled.join(named, "node", "left").select("node", F.coalesce("role", F.lit("content")).alias("role"), "level")


def copied(objects: DataFrame, source: str, target: str, trust: bool = False, tasks: int | None = None) -> DataFrame:
    """node, role, level, size, status of objects (node, role, level; see ``waves``), copied from folder to folder.

    One level is copied after the other, lowest first, so an object is never visible before all that it names. status is
    copied, present (there already, with the right bytes), or replaced (there with wrong ones). With trust, what is there isn't
    read again. A missing object, or one whose bytes are not those of its name, fails the job before anything above it is
    written; run again, it copies only what is not there. Tasks that are repeated put the same bytes in the same place.
    """
    spark, job = objects.sparkSession, uuid.uuid4().hex
    source, target = source.rstrip("/"), target.rstrip("/")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        (here, below), (there, root) = opened(source), opened(target)
        own, made = f"{root}/staging/{job}/{uuid.uuid4().hex}", set()  # a task's own, as in ``content``
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = place(row["node"].removeprefix("sha256:"), row["role"])
                status, info = "copied", there.get_file_info(f"{root}/{name}")
                if info.type == fs.FileType.File:
                    status = "present"
                    if not trust:
                        with there.open_input_stream(f"{root}/{name}") as f:
                            status = "present" if "sha256:" + _hash(f)[0] == row["node"] else "replaced"
                size = info.size
                if status != "present":
                    if here.get_file_info(f"{below}/{name}").type != fs.FileType.File:
                        raise FileNotFoundError(f"{row['node']} is not in {source}")
                    staged, digest, size = f"{own}/{uuid.uuid4().hex}", hashlib.sha256(), 0
                    _parent(there, staged, made)
                    with here.open_input_stream(f"{below}/{name}") as f, there.open_output_stream(staged) as to:
                        while block := f.read(BLOCK):
                            digest.update(block)
                            to.write(block)
                            size += len(block)
                    if "sha256:" + digest.hexdigest() != row["node"]:
                        there.delete_file(staged)
                        raise ValueError(f"content of {row['node']} is sha256:{digest.hexdigest()}")
                    _parent(there, f"{root}/{name}", made)
                    there.move(staged, f"{root}/{name}")
                out.append((row["node"], row["role"], row["level"], size, status))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["node", "role", "level", "size", "status"])

    wanted = written(objects.select("node", "role", F.col("level").cast("int").alias("level")).where("node is not null").distinct())
    top = wanted.agg(F.max("level").alias("top")).first()["top"]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = []
    try:
        for level in range(0 if top is None else top + 1):
            rows = wanted.where(F.col("level") == level).repartition(tasks, "node")
            done.append(written(rows.mapInArrow(copy, "node string, role string, level int, size long, status string")))
            if len(done) > 8:
                done = [written(union(done))]
    finally:
        _removed(f"{target}/staging/{job}")
    return union(done) if done else wanted.select("node", "role", "level", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("status"))


def _removed(folder: str) -> None:
    from pyarrow import fs

    store, path = opened(folder)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def expanded(roots: DataFrame, artifacts: DataFrame, collections: DataFrame, tree_entries: DataFrame, chunks: DataFrame, headers: DataFrame) -> DataFrame:
    """path, file, sha256, executable, ordinal, content: the files that artifacts stand for, a row for each part.

    roots has artifact and path. A blob is a file at its path, a tree the files of its entries (tree_content, path, content,
    executable) below it, a collection its members (collection_content, key, artifact), each at a name made of its key.
    artifacts has id, content, kind; a blob's content with a row in headers (manifest_content, logical_sha256) consists of chunks
    (manifest_content, ordinal, content), any other one of itself. file names the content that a path gets. An empty chunked blob has
    a row without content. An artifact that artifacts lacks, or a path that leaves its place, raises when the rows are read.
    """
    frontier, found = written(roots.select("artifact", "path").distinct()), []
    known = artifacts.select(F.col("id").alias("artifact"), "content", "kind").dropDuplicates(["artifact"])
    while not frontier.isEmpty():
        here = written(frontier.join(known, "artifact", "left").withColumn("kind", F.coalesce("kind", F.raise_error(F.concat(F.lit("no artifact "), "artifact")))))
        found.append(here.where("kind = 'blob'").select("path", F.col("content").alias("file"), F.lit(None).cast("boolean").alias("executable")))
        inside = here.where("kind = 'tree'").select("path", F.col("content").alias("tree_content")).join(tree_entries.select("tree_content", F.col("path").alias("_below"), "content", "executable"), "tree_content")
        found.append(inside.select(F.concat_ws("/", "path", F.coalesce(normal_path("_below"), F.raise_error(F.concat(F.lit("unsafe path "), "_below")))).alias("path"), F.col("content").alias("file"), "executable"))
        of = here.where("kind = 'collection'").select("path", F.col("content").alias("collection_content"))
        members = of.join(collections.select("collection_content", "key", "artifact"), "collection_content")
        frontier = written(members.select("artifact", F.concat_ws("/", "path", file_name("key")).alias("path")).distinct())
        if len(found) > 16:
            found = [written(union(found))]
    if not found:
        found = [frontier.select("path", F.col("artifact").alias("file"), F.lit(None).cast("boolean").alias("executable"))]
    # trees name plain contents, so only blobs can be chunked; a content has one meaning, so the join needs no kind
    listed = union(found).groupBy("path", "file").agg(F.max("executable").alias("executable"))
    heads = headers.select(F.col("manifest_content").alias("file"), F.regexp_replace("logical_sha256", "^sha256:", "").alias("_logical")).dropDuplicates(["file"])
    parts = chunks.select(F.col("manifest_content").alias("file"), F.col("ordinal").cast("long").alias("ordinal"), F.col("content").alias("_part")).dropDuplicates(["file", "ordinal"])
    both = listed.join(heads, "file", "left").join(parts, "file", "left")
    plain = F.col("_logical").isNull()
    return both.select("path", "file", F.when(plain, F.regexp_replace("file", "^sha256:", "")).otherwise(F.col("_logical")).alias("sha256"), "executable", F.when(plain, 0).otherwise(F.col("ordinal")).cast("long").alias("ordinal"), F.when(plain, F.col("file")).otherwise(F.col("_part")).alias("content"))


def materialised(files: DataFrame, source: str, root: str, whole: bool = True) -> DataFrame:
    """Writes files (see ``expanded``) from a content folder below root and returns path, size, sha256.

    A file's parts run through one task in order, a block at a time, and it moves to its place only if its hash is the one named. With whole, all
    files are made beside root, which then takes the place of what was there, so a reader sees all of them or none, and a failed
    job changes nothing; the store has to move folders for that. Without it, each file is complete when it is seen, and others
    below root stay. Executable bits are set on mounted folders. Two contents for one path raise, and so does a path below a file.
    """
    spark, job = files.sparkSession, uuid.uuid4().hex
    source, root = source.rstrip("/"), root.rstrip("/")
    made = f"{root}.partial-{job}" if whole else root
    files = written(files.select("path", "file", "sha256", F.coalesce("executable", F.lit(False)).alias("executable"), "ordinal", "content"))
    clash = files.groupBy("path").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").first()
    if clash:
        raise ValueError(f"{clash['a']} and {clash['b']} are both at {clash['path']!r}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, below), (there, to) = opened(source), opened(made)
        now = stream = staged = digest = None
        size, out, folders = 0, [], set()
        own = f"{to}.staging-{job}/{uuid.uuid4().hex}"

        def close() -> None:
            nonlocal stream
            stream.close()
            stream = None
            if digest.hexdigest() != now[1]:
                there.delete_file(staged)
                raise ValueError(f"content of {now[0]!r} is sha256:{digest.hexdigest()}, not sha256:{now[1]}")
            _parent(there, f"{to}/{now[0]}", folders)
            there.move(staged, f"{to}/{now[0]}")
            if now[2] and there.type_name == "local":
                import os

                os.chmod(f"{to}/{now[0]}", 0o755)
            out.append((now[0], size, now[1]))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string()], strict=True)], ["path", "size", "sha256"])

        try:
            for b in batches:
                for path, sha256, executable, content in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if (path, sha256, executable) != now:
                        if stream is not None:
                            close()
                        now, digest, size = (path, sha256, executable), hashlib.sha256(), 0
                        staged = f"{own}/{uuid.uuid4().hex}"
                        _parent(there, staged, folders)
                        stream = there.open_output_stream(staged)
                    if content is not None:
                        with here.open_input_stream(f"{below}/{place(bytes(content).decode().removeprefix('sha256:'))}") as f:
                            while block := f.read(BLOCK):
                                digest.update(block)
                                stream.write(block)
                                size += len(block)
                yield batch()
            if stream is not None:
                close()
                yield batch()
        finally:
            if stream is not None:
                stream.close()

    from pyarrow import fs

    keys = ["path", "sha256", "executable"]
    try:
        done = written(in_order(files, keys, ["ordinal"], F.col("content")).mapInArrow(put, "path string, size long, sha256 string"))
        store, to = opened(root)
        if whole:
            store.create_dir(opened(made)[1], recursive=True)
            if store.get_file_info(to).type == fs.FileType.Directory:
                store.delete_dir(to)
            elif store.get_file_info(to).type == fs.FileType.File:
                store.delete_file(to)
            store.move(opened(made)[1], to)
    finally:
        for name in [made, f"{made}.staging-{job}"] if whole else [f"{made}.staging-{job}"]:
            _removed(name)
    return done
