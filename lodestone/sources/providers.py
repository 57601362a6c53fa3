"""Providers: what each scheme is read with, routing of profile aliases, and Python data sources.

Stores that Spark's file systems reach (s3a, gs, abfs, hdfs, webhdfs) are read natively.
Services behind commands or REST become Python DataSources whose partitions are references;
their tools and networks are not part of this repository, so tests use fixtures.
"""

from __future__ import annotations

import json
import os
import subprocess
import tarfile
import tempfile
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import layout
from .tables import files

ROW = "reference string, path string, size bigint, content binary"


@dataclass(frozen=True)
class Provider:
    name: str
    schemes: tuple[str, ...]
    kind: str  # files, rest, command
    detail: str = ""
    capabilities: dict[str, bool] = field(default_factory=dict)


#: Names, schemes, and how each is read.
PROVIDERS = [
    Provider("local", ("local", "file"), "files", "file://"),
    Provider("http", ("http", "https"), "rest", "{locator}"),
    Provider("s3", ("s3",), "files", "s3a://"),
    Provider("gcs", ("gcs", "gs"), "files", "gs://"),
    Provider("azure", ("azure", "azblob"), "files", "abfs://"),
    Provider("hdfs", ("hdfs",), "files", "hdfs://"),
    Provider("webhdfs", ("webhdfs",), "files", "webhdfs://"),
    Provider("git", ("git",), "command", "git archive"),
    Provider("oci", ("oci",), "files", "layout"),
    Provider("github", ("github", "gh"), "rest", "https://api.github.com/repos/{repo}/releases/{tag}"),
    Provider("huggingface", ("huggingface", "hf"), "rest", "https://huggingface.co/api/{kind}s/{repo}/revision/{revision}"),
    Provider("zenodo", ("zenodo",), "rest", "https://zenodo.org/api/records/{locator}"),
    Provider("figshare", ("figshare",), "rest", "https://api.figshare.com/v2/articles/{locator}"),
    Provider("osf", ("osf",), "rest", "https://api.osf.io/v2/files/{locator}/"),
    Provider("dataverse", ("dataverse",), "rest", "{server}/api/datasets/{locator}"),
    Provider("gitlab", ("gitlab",), "rest", "https://gitlab.com/api/v4/projects/{repo}/repository/files/{path}/raw"),
    *[Provider(n, (n,), "command", n) for n in ("dvc", "kaggle", "modelscope", "mlflow", "wandb", "clearml", "comet", "ngc")],
    *[Provider(n, (n,), "command", "rclone cat") for n in ("lakefs", "ipfs", "sftp", "webdav", "gdrive", "onedrive", "dropbox", "swift", "oss", "obs", "cos")],
    Provider("ftp", ("ftp", "ftps"), "command", "rclone cat"),
    Provider("fixture", ("fixture",), "fixture"),
]


class Registry:
    """Unique provider names and schemes; profiles are aliases of a provider's name or scheme."""

    def __init__(self, providers: list[Provider] | None = None):
        self.by_name: dict[str, Provider] = {}
        self.by_scheme: dict[str, Provider] = {}
        self.profiles: dict[str, tuple[Provider, dict]] = {}
        for p in PROVIDERS if providers is None else providers:
            self.add(p)

    def add(self, p: Provider) -> None:
        if p.name in self.by_name or any(s in self.by_scheme for s in p.schemes):
            raise ValueError(f"provider {p.name!r} or one of its schemes is there already")
        self.by_name[p.name] = p
        self.by_scheme |= dict.fromkeys(p.schemes, p)

    def profile(self, alias: str, kind: str, **config: str) -> None:
        found = self.by_name.get(kind) or self.by_scheme.get(kind)
        if found is None:
            raise KeyError(f"no provider {kind!r}")
        self.profiles[alias] = found, {k: expanded(v) for k, v in config.items()}

    def route(self, reference: str) -> tuple[Provider, str, dict]:
        """Provider, locator and configuration of scheme:locator."""
        scheme, colon, locator = reference.partition(":")
        scheme = scheme.lower()
        if not colon or not locator:
            raise ValueError(f"not a reference: {reference!r}")
        if scheme in self.profiles:
            provider, config = self.profiles[scheme]
            return provider, locator, config
        if scheme not in self.by_scheme:
            raise KeyError(f"no provider for {scheme!r}")
        return self.by_scheme[scheme], locator, {}

    def descriptors(self) -> list[Provider]:
        return [self.by_name[n] for n in sorted(self.by_name)]


def expanded(value: str) -> str:
    """A value that is exactly ${NAME} from the driver's environment."""
    if value.startswith("${") and value.endswith("}") and value.count("$") == 1:
        return os.environ[value[2:-1]]
    return value


@dataclass
class Ref(InputPartition):
    reference: str

    def __init__(self, reference: str):
        super().__init__(reference)
        self.reference = reference


class _Source(DataSource):
    def schema(self) -> str:
        return ROW

    def references(self) -> list[str]:
        return json.loads(self.options["references"])


class CommandSource(_Source):
    """format("command_bridge"): argv template with {locator}; stdout is the file, or with option archive=tar its members are."""

    @classmethod
    def name(cls) -> str:
        return "command_bridge"

    def reader(self, schema) -> DataSourceReader:
        return _CommandReader(self.references(), json.loads(self.options["argv"]), self.options.get("archive"))


class _CommandReader(DataSourceReader):
    def __init__(self, references, argv, archive):
        self.references, self.argv, self.archive = references, argv, archive

    def partitions(self) -> list[InputPartition]:
        return [Ref(r) for r in self.references]

    def read(self, partition: Ref) -> Iterator[tuple]:
        locator = partition.reference.partition(":")[2]
        with tempfile.TemporaryFile() as out:
            subprocess.run([a.replace("{locator}", locator).replace("{reference}", partition.reference) for a in self.argv], stdout=out, check=True)
            out.seek(0)
            if self.archive == "tar":
                with tarfile.open(fileobj=out) as tar:
                    for member in sorted(tar.getmembers(), key=lambda m: m.name):
                        if member.isfile():
                            data = tar.extractfile(member).read()
                            yield partition.reference, member.name, len(data), data
            else:
                data = out.read()
                yield partition.reference, locator.rsplit("/", 1)[-1] or "download", len(data), data


class HttpSource(_Source):
    """format("http_files"): one file for each URL, named by its last segment."""

    @classmethod
    def name(cls) -> str:
        return "http_files"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.references(), self.options.get("token_variable"))


class _HttpReader(DataSourceReader):
    def __init__(self, references, token_variable):
        self.references, self.token_variable = references, token_variable

    def partitions(self) -> list[InputPartition]:
        return [Ref(r) for r in self.references]

    def read(self, partition: Ref) -> Iterator[tuple]:
        headers = {"Authorization": f"Bearer {os.environ[self.token_variable]}"} if self.token_variable and self.token_variable in os.environ else {}
        with urllib.request.urlopen(urllib.request.Request(partition.reference, headers=headers), timeout=60) as answer:
            data = answer.read()
        yield partition.reference, partition.reference.split("#")[0].split("?")[0].rstrip("/").rsplit("/", 1)[-1] or "download", len(data), data


class FixtureSource(_Source):
    """format("fixture_files"): one fixed text file for each reference."""

    @classmethod
    def name(cls) -> str:
        return "fixture_files"

    def reader(self, schema) -> DataSourceReader:
        return _FixtureReader(self.references())


class _FixtureReader(_HttpReader):
    def __init__(self, references):
        super().__init__(references, None)

    def read(self, partition: Ref) -> Iterator[tuple]:
        data = b"provider conformance\n"
        yield partition.reference, "fixture.txt", len(data), data


def register(spark: SparkSession) -> None:
    for source in (CommandSource, HttpSource, FixtureSource):
        spark.dataSource.register(source)


def read(spark: SparkSession, registry: Registry, reference: str, **options: str) -> DataFrame:
    """path, size, content (and more) of what a reference names."""
    provider, locator, config = registry.route(reference)
    if provider.name == "oci":
        return layout.read(spark, locator).select(F.col("title").alias("path"), "size", "content")
    if provider.kind == "files":
        root = locator if provider.name == "local" else provider.detail + locator.lstrip("/")
        return files(spark, root)
    register(spark)
    if provider.kind == "fixture":
        return spark.read.format("fixture_files").option("references", json.dumps([reference])).load()
    if provider.name == "http":
        return spark.read.format("http_files").option("references", json.dumps([reference])).load()
    if provider.kind == "command":
        argv = options.get("argv") or json.dumps(config.get("argv", f"{provider.detail} {{reference}}").split())
        return spark.read.format("command_bridge").option("references", json.dumps([reference])).option("argv", argv).options(**{k: v for k, v in options.items() if k != "argv"}).load()
    raise NotImplementedError(f"{provider.name} needs its service: list files over {provider.detail}, then read their URLs with http")
