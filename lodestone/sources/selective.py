"""Files of a store by path and size, chosen before any content is read: format("selected_files").

Globs are options; filters of a query on path and size are pushed to the reader, so a task lists names and opens only the files
that are wanted. A folder that no wanted path can lie in isn't listed at all.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from ..functions.globs import regex
from .content import opened

LISTED = "authority string, path string, size bigint, version string"


def literal(glob: str) -> str:
    """What all paths that a glob matches begin with."""
    return re.split(r"[*?\[{\\]", glob, maxsplit=1)[0]


@dataclass
class Lot(D.InputPartition):
    folders: list[tuple[str, bool]]  # and whether what is below belongs to it
    nth: int
    of: int

    def __init__(self, folders: list[tuple[str, bool]], nth: int, of: int):
        super().__init__(folders)
        self.folders, self.nth, self.of = folders, nth, of


class SelectedFiles(D.DataSource):
    """authority, path (below the root), size, version (of size and time of change), and content unless option content is false.

    Options: path (the root), include and exclude (JSON lists of globs), tasks (how many folders planning looks for before it
    stops going down, and how many groups they are dealt to) and split (among how many tasks at least a group's files are dealt,
    by name, so that one large folder is read by several).
    """

    @classmethod
    def name(cls) -> str:
        return "selected_files"

    def schema(self) -> str:
        return LISTED if self.options.get("content") == "false" else LISTED + ", content binary"

    def reader(self, schema) -> D.DataSourceReader:
        return _Reader(dict(self.options), "content" in schema.fieldNames())


class _Reader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], content: bool):
        self.root, self.content = options["path"].rstrip("/"), content
        include, exclude = (json.loads(options.get(n, "[]")) for n in ("include", "exclude"))
        # Python's \Z is what \z is elsewhere
        self.include, self.exclude = ([regex(g).replace(r"\z", r"\Z") for g in globs] for globs in (include, exclude))
        self.starts = [{literal(g) for g in include}] if include else []
        self.tests: list[tuple[str, str, object]] = []
        self.tasks, self.split = int(options.get("tasks", 64)), int(options.get("split", 4))

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        kinds = {D.EqualTo: "=", D.In: "in", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.StringStartsWith: "starts", D.StringEndsWith: "ends", D.StringContains: "holds"}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = kinds.get(type(f))
            if isinstance(f, D.IsNotNull) and column in ("path", "size"):
                continue
            # texts are ordered by bytes in Spark, so only sizes are compared here
            if column == "size" and kind in ("=", "in", ">", ">=", "<", "<=") or column == "path" and kind in ("=", "in", "starts", "ends", "holds"):
                value = tuple(f.value) if kind == "in" else f.value
                self.tests.append((column, kind, value))
                if column == "path" and kind in ("=", "in", "starts"):
                    self.starts.append(set(value) if kind == "in" else {value})
            else:
                yield f

    def wanted(self, path: str, size: int) -> bool:
        if self.include and not any(re.search(p, path) for p in self.include) or any(re.search(p, path) for p in self.exclude):
            return False
        for column, kind, value in self.tests:
            x = path if column == "path" else size
            if not {
                "=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value,
                "starts": lambda: x.startswith(value), "ends": lambda: x.endswith(value), "holds": lambda: value in x,
            }[kind]():
                return False
        return True

    def possible(self, folder: str) -> bool:
        """Whether a wanted path can lie below a folder (path and slash)."""
        return all(any(s.startswith(folder) or folder.startswith(s) for s in starts) for starts in self.starts)

    def partitions(self) -> list[Lot]:
        from pyarrow import fs

        store, root = opened(self.root)
        lots, waiting = [], [""]
        while waiting and len(lots) + len(waiting) < self.tasks:
            below = []
            for folder in waiting:
                lots.append((folder, False))
                for info in store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"))):
                    name = info.path[len(root) :].lstrip("/") + "/"
                    if info.type == fs.FileType.Directory and self.possible(name):
                        below.append(name)
            waiting = below
        lots += [(folder, True) for folder in waiting]
        groups = [lots[i :: self.tasks] for i in range(min(self.tasks, len(lots)))]
        of = max(self.split, -(-self.tasks // max(len(groups), 1)))
        return [Lot(group, i, of) for group in groups for i in range(of)]

    def read(self, partition: Lot) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = opened(self.root)
        authority = self.root[: len(self.root) - len(root)] or "file:"
        waiting = list(partition.folders)
        while waiting:
            folder, deep = waiting.pop()
            for info in store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"))):
                path = info.path[len(root) :].lstrip("/")
                if info.type == fs.FileType.Directory:
                    if deep and self.possible(path + "/"):
                        waiting.append((path + "/", True))
                elif zlib.crc32(path.encode()) % partition.of == partition.nth and self.wanted(path, info.size):
                    row = authority, path, info.size, f"{info.size:x}-{info.mtime_ns or 0:x}"
                    if not self.content:
                        yield row
                        continue
                    with store.open_input_stream(info.path) as f:
                        yield *row, f.read()


def files(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = (), content: bool = True, tasks: int | None = None, split: int = 4) -> DataFrame:
    """authority, path, size, version, content of the files below root (see ``SelectedFiles``) that include's globs match, or all, and exclude's don't.

    Conditions on path and size that follow are pushed down. Without content nothing is opened. An empty root has no rows, a
    missing one raises; a name with a line end is matched as a whole.
    """
    spark.dataSource.register(SelectedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; a reader that takes filters needs it
    options = {"include": json.dumps(list(include)), "exclude": json.dumps(list(exclude)), "content": str(content).lower(), "tasks": str(tasks or spark.conf.get("spark.sql.shuffle.partitions")), "split": str(split)}
    return spark.read.format("selected_files").options(**options).load(root)
