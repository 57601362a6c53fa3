"""Listings of REST repositories as column expressions: the address to ask, and the files in its JSON answer.

Fetching is separate (see ``providers``), so answers may come from any reader. Every listing gives
path, size, sha256, media_type, url, md5 of each file, with revision and canonical_ref of the
whole; a path that leaves its root is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import regexes
from ..functions.scalars import dataset_version, hub_locator, path, release_locator

FILES = "array<struct<path:string,size:bigint,sha256:string,media_type:string,url:string,md5:string>>"
CHALLENGE = "struct<provider:string,requirement:string,message:string>"


def _file(name: Column, size: Column, url: Column, sha256: Column | None = None, media_type: Column | None = None, md5: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(path(name).alias("path"), size.alias("size"), (none if sha256 is None else sha256).alias("sha256"), (none if media_type is None else media_type).alias("media_type"), url.alias("url"), (none if md5 is None else md5).alias("md5"))


def _listing(files: Column, revision: Column, reference: Column) -> Column:
    return F.struct(F.coalesce(files, F.array().cast(FILES)).alias("files"), revision.alias("revision"), reference.alias("canonical_ref"))


def _github(locator: Column, body: Column) -> Column:
    at, v = release_locator(locator), F.from_json(body, "tag_name string, assets array<struct<name:string,size:bigint,browser_download_url:string>>")
    files = F.transform(v["assets"], lambda a: _file(a["name"], a["size"], a["browser_download_url"]))
    return _listing(files, v["tag_name"], F.concat(F.lit("github:"), at["repo"], F.lit("@"), v["tag_name"], F.lit("#"), at["pattern"]))


def _huggingface(locator: Column, body: Column, revision: Column | None = None) -> Column:
    at, v = hub_locator(locator), F.from_json(body, "sha string, siblings array<struct<rfilename:string,size:bigint>>")
    sha, dataset = F.coalesce(v["sha"], *([] if revision is None else [revision]), at["revision"]), at["kind"] == "dataset"
    root = F.concat(F.lit("https://huggingface.co/"), F.when(dataset, "datasets/").otherwise(""), at["repo"], F.lit("/resolve/"), sha, F.lit("/"))
    files = F.transform(v["siblings"], lambda s: _file(s["rfilename"], s["size"], F.concat(root, s["rfilename"])))
    return _listing(files, sha, F.concat(F.lit("hf:"), F.when(dataset, "dataset:").otherwise(""), at["repo"], F.lit("@"), sha))


def _zenodo(locator: Column, body: Column) -> Column:
    v = F.from_json(body, "id bigint, files array<struct<key:string,size:bigint,checksum:string,links:struct<self:string,content:string>>>")
    own = F.regexp_replace(locator, "^(record:)+", "")
    record = F.coalesce(v["id"], own.try_cast("bigint"), F.lit(0)).cast("string")
    digest = lambda f: F.when(f["checksum"].startswith("sha256:"), F.substr(f["checksum"], F.lit(8)))
    files = F.transform(v["files"], lambda f: _file(F.coalesce(f["key"], F.lit("file")), f["size"], F.coalesce(f["links"]["self"], f["links"]["content"], F.lit("")), digest(f)))
    return _listing(files, record, F.concat(F.lit("zenodo:"), record))


def _figshare(locator: Column, body: Column) -> Column:
    v = F.from_json(body, "modified_date string, files array<struct<name:string,size:bigint,download_url:string,computed_md5:string>>")
    files = F.transform(v["files"], lambda f: _file(F.coalesce(f["name"], F.lit("file")), f["size"], F.coalesce(f["download_url"], F.lit("")), md5=f["computed_md5"]))
    return _listing(files, F.coalesce(v["modified_date"], locator), F.concat(F.lit("figshare:"), locator))


def _osf(locator: Column, body: Column) -> Column:
    d = F.from_json(body, "data struct<attributes:struct<name:string,size:bigint,date_modified:string>,links:struct<download:string>>")["data"]
    one = _file(F.coalesce(d["attributes"]["name"], F.lit("osf-file")), d["attributes"]["size"], F.coalesce(d["links"]["download"], F.lit("")))
    return _listing(F.array(one), F.coalesce(d["attributes"]["date_modified"], locator), F.concat(F.lit("osf:"), locator))


def _dataverse(locator: Column, body: Column, base: str = "https://dataverse.harvard.edu") -> Column:
    kind = "data struct<latestVersion:struct<versionNumber:bigint,versionMinorNumber:bigint,files:array<struct<label:string,dataFile:struct<id:bigint,filename:string,filesize:bigint,contentType:string>>>>>"
    v = F.from_json(body, kind)["data"]["latestVersion"]
    revision = dataset_version(v["versionNumber"], v["versionMinorNumber"])

    def one(f: Column) -> Column:
        d = f["dataFile"]
        return _file(F.coalesce(f["label"], d["filename"], F.lit("file")), d["filesize"], F.concat(F.lit(f"{base}/api/access/datafile/"), F.coalesce(d["id"], F.lit(0)).cast("string")), media_type=d["contentType"])

    return _listing(F.transform(v["files"], one), revision, F.concat(F.lit("dataverse:"), locator, F.lit("@"), revision))


def _gitlab(locator: Column, revision: Column, base: str = "https://gitlab.com") -> Column:
    """Needs no answer: the reference names one file, group/project#path. NULL without a #."""
    at, rev = F.instr(locator, "#"), F.coalesce(revision, F.lit("main"))
    project, name = F.substr(locator, F.lit(1), at - 1), F.substr(locator, at + 1)
    one = _file(F.substring_index(name, "/", -1), F.lit(None).cast("bigint"), F.concat(F.lit(f"{base}/"), project, F.lit("/-/raw/"), rev, F.lit("/"), name))
    return F.when(at > 0, _listing(F.array(one), rev, F.concat(F.lit("gitlab:"), project, F.lit("@"), rev, F.lit("#"), name)))


PARSERS: dict[str, Callable[..., Column]] = {"github": _github, "huggingface": _huggingface, "zenodo": _zenodo, "figshare": _figshare, "osf": _osf, "dataverse": _dataverse, "gitlab": _gitlab}


def endpoint(provider: str, locator: str = "locator", base: str | None = None, revision: str | None = None) -> Column:
    """The address of the JSON that describes a reference; a column revision, where not null, goes before the reference's own."""
    v = F.col(locator)
    if provider == "github":
        at = release_locator(v)
        return F.concat(F.lit("https://api.github.com/repos/"), at["repo"], F.lit("/releases/"), F.when(at["tag"] == "latest", "latest").otherwise(F.concat(F.lit("tags/"), at["tag"])))
    if provider == "huggingface":
        at = hub_locator(v)
        return F.concat(F.lit("https://huggingface.co/api/"), at["kind"], F.lit("s/"), at["repo"], F.lit("/revision/"), at["revision"] if revision is None else F.coalesce(F.col(revision), at["revision"]))
    if provider == "zenodo":
        return F.concat(F.lit("https://zenodo.org/api/records/"), F.regexp_replace(v, "^(record:)+", ""))
    if provider == "figshare":
        return F.concat(F.lit("https://api.figshare.com/v2/articles/"), v)
    if provider == "osf":
        return F.concat(F.lit("https://api.osf.io/v2/files/"), v, F.lit("/"))
    if provider == "dataverse":
        root = F.lit(f"{base or 'https://dataverse.harvard.edu'}/api/datasets/")
        return F.when(v.rlike(r"\A[0-9]*\z"), F.concat(root, v)).otherwise(F.concat(root, F.lit(":persistentId/?persistentId="), F.url_encode(v)))
    raise KeyError(f"{provider!r} has no listing to ask for")


def listed(answers: DataFrame, provider: str, locator: str = "locator", answer: str = "body", keep: tuple[str, ...] = (), revision: str | None = None, base: str | None = None) -> DataFrame:
    """A row for each file of each answer: keep, path, size, sha256, media_type, url, md5, revision, canonical_ref.

    answers has a locator and the body of its answer (for gitlab the revision, or null). Of releases,
    only files that the reference's pattern selects. revision names a column with a revision asked
    for beside the reference (huggingface); base is the address of an own server (dataverse, gitlab).
    """
    more = ({"revision": F.col(revision)} if revision else {}) | ({"base": base} if base else {})
    made = answers.select(*keep, F.col(locator).alias("_l"), PARSERS[provider](F.col(locator), F.col(answer), **more).alias("_a")).where("_a is not null")
    rows = made.select(*keep, "_l", F.explode("_a.files").alias("f"), "_a.revision", "_a.canonical_ref").select(*keep, "_l", "f.*", "revision", "canonical_ref")
    if provider == "github":
        rows = rows.withColumn("_p", regexes(release_locator("_l")["pattern"])).where(F.rlike("path", F.col("_p"))).drop("_p")
    return rows.drop("_l")


def challenge(provider: Column | str, status: Column | str) -> Column:
    """struct(provider, requirement, message) where a service refuses access (401 or 403), else NULL."""
    p, s = (F.col(x) if isinstance(x, str) else x for x in (provider, status))
    return F.when(s.isin(401, 403), F.struct(p.alias("provider"), F.lit("authentication").alias("requirement"), F.lit("access needs authentication or approval").alias("message")))
