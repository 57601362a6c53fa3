"""A content-addressed folder as a sink: format("content_folder") writes each row's bytes as one object named by their hash.

Objects lie at <folder>/content/<first two digits>/<digest>. A task stages an object beside its place, hashes it, and
moves it there, so a reader never sees half of one; tasks that are repeated or run twice put the same bytes in
the same place. An object that is there is kept if its bytes are right and replaced if not. ``put`` brings equal bytes
together first, so one task makes an object and it counts as new once; rows written without it may meet in two tasks. A
task notes in the staging folder what it found missing or wrong before it moves anything, so a repeated one, that finds what the
first has put, tells the same. When all tasks are done, commits/<job>.json tells what the job did; staged files and notes are removed, also an aborted job's.

Any file system that pyarrow opens will do (mounted folders, hdfs, s3, gs); s3a is read as s3.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage


#: Bytes of content after which a batch of objects that were read leaves its task.
BATCH = 4 << 20


def opened(folder: str):
    """The file system of a folder's address, and the path there."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else folder).lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme == "s3a" else scheme) + ":" + rest)


def place(digest: str, role: str = "content") -> str:
    """Where an object lies below its folder; role is content, or artifacts for manifests of artifacts."""
    return f"{role}/{digest[:2]}/{digest}"


@dataclass
class Put(WriterCommitMessage):
    objects: int
    new: int
    replaced: int
    size: int


class ContentFolder(DataSource):
    """Rows of (id, content, copies): id may be null, or else has to be the identity of content; copies is how many rows this one stands for."""

    @classmethod
    def name(cls) -> str:
        return "content_folder"

    def schema(self) -> str:
        return "id string, content binary, copies long"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are written once: use mode append")
        return _Writer(self.options["path"], self.options.get("role", "content"))


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, role: str):
        self.folder, self.role, self.job = folder.rstrip("/"), role, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Put:
        store, root = opened(self.folder)
        done, made, folders = Put(0, 0, 0, 0), set(), set()
        own = f"{root}/staging/{self.job}/{uuid.uuid4().hex}"  # tasks that stage in one folder wait for each other at every file
        task = TaskContext.get()
        notes = f"{root}/staging/{self.job}.notes/{task.partitionId() if task else 0}"  # an attempt reads those of earlier ones

        def save(data: bytes | pa.Buffer, to: str) -> None:
            staged = f"{own}/{uuid.uuid4().hex}"
            for folder in {own, to.rsplit("/", 1)[0]} - folders:
                store.create_dir(folder, recursive=True)
                folders.add(folder)
            with store.open_output_stream(staged) as f:
                f.write(data)
            store.move(staged, to)

        for b in batches:
            found = {}
            for identity, c, copies in zip(b.column("id").to_pylist(), b.column("content"), b.column("copies").to_pylist(), strict=True):
                data = c.as_buffer()
                digest = hashlib.sha256(data).hexdigest()
                if identity is not None and identity.lower() != f"sha256:{digest}":
                    raise ValueError(f"content of {identity} is sha256:{digest}")
                done.objects, done.size = done.objects + copies, done.size + copies * len(data)
                if digest not in made:
                    made.add(digest)
                    found[digest] = self._found(store, f"{root}/{place(digest, self.role)}", digest, len(data)), data
            missing = {d: kind for d, (kind, _) in found.items() if kind != "present"}
            if missing:
                save(json.dumps(missing).encode(), f"{notes}/{uuid.uuid4().hex}")
            # read after the look at the objects: what another attempt has put by then, it has noted
            noted = self._noted(store, notes) if len(missing) < len(found) else {}
            for digest, (kind, data) in found.items():
                first = noted.get(digest, kind)
                done.new, done.replaced = done.new + (first == "new"), done.replaced + (first == "replaced")
                if kind != "present":
                    save(data, f"{root}/{place(digest, self.role)}")
        return done

    @staticmethod
    def _found(store, path: str, digest: str, size: int) -> str:
        from pyarrow import fs

        there = store.get_file_info(path)
        if there.type != fs.FileType.File:
            return "new"
        with store.open_input_stream(path) as f:
            return "present" if there.size == size and hashlib.sha256(f.read()).hexdigest() == digest else "replaced"

    @staticmethod
    def _noted(store, folder: str) -> dict[str, str]:
        """What each object noted in a folder was when an attempt found it first; one that was missing is new, whatever became of it."""
        from pyarrow import fs

        noted = {}
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            with store.open_input_stream(info.path) as f:
                for digest, kind in json.loads(f.read()).items():
                    noted[digest] = "new" if "new" in (kind, noted.get(digest)) else kind
        return noted

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = opened(self.folder)
        for folder in (f"{root}/staging/{self.job}", f"{root}/staging/{self.job}.notes"):
            if store.get_file_info(folder).type == fs.FileType.Directory:
                store.delete_dir(folder)

    def commit(self, messages: list[Put | None]) -> None:
        self._clear()
        store, root = opened(self.folder)
        total = {n: sum(getattr(m, n) for m in messages if m) for n in ("objects", "new", "replaced", "size")}
        store.create_dir(f"{root}/commits", recursive=True)
        with store.open_output_stream(f"{root}/commits/{self.job}.json") as f:
            f.write(json.dumps(total).encode())

    def abort(self, messages: list[Put | None]) -> None:
        self._clear()


def put(rows: DataFrame, folder: str, content: str = "content", identity: str | None = None, role: str = "content") -> None:
    """Writes the bytes of rows as objects of a role; with identity, bytes of another identity fail the job. Null contents are left out."""
    rows.sparkSession.dataSource.register(ContentFolder)
    own = F.concat(F.lit("sha256:"), F.sha2(F.col(content).cast("binary"), 256))
    named = own if identity is None else F.coalesce(F.lower(identity), own)
    # copies become one row before the shuffle; if two tasks found an object missing, both would count it as new
    each = rows.where(F.col(content).isNotNull()).select(named.alias("id"), F.col(content).cast("binary").alias("content")).groupBy("id", "content").agg(F.count("*").alias("copies"))
    each.write.format("content_folder").mode("append").option("role", role).save(folder)


def objects(spark: SparkSession, folder: str, role: str = "content") -> DataFrame:
    """id (by name), size, content of the objects of a folder and role, empty ones too.

    Tasks list and read the folders of two digits when the rows are read, so no names reach the driver and a task holds those
    of one such folder and a batch. A missing folder raises; one without objects of the role has no rows.
    """
    from pyarrow import fs

    folder = folder.rstrip("/")
    if (at := opened(folder))[0].get_file_info(at[1]).type != fs.FileType.Directory:
        raise FileNotFoundError(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = opened(folder)
        for digits in (n for b in batches for n in b.column("id").to_pylist()):
            rows, held = [], 0
            for info in store.get_file_info(fs.FileSelector(f"{root}/{role}/{digits:02x}", allow_not_found=True)):
                if info.type == fs.FileType.File:
                    with store.open_input_stream(info.path) as f:
                        data = f.read()
                    rows.append((f"sha256:{info.base_name}", len(data), data))
                    held += len(data)
                    if held >= BATCH or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    tasks = min(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.range(0, 256, 1, tasks).mapInArrow(read, "id string, size long, content binary")


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    ids, sizes, contents = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], ["id", "size", "content"])


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """objects, new, replaced, size of each job that committed."""
    return spark.read.schema("objects long, new long, replaced long, size long").json(f"{folder}/commits")
