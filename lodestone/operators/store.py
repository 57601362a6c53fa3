"""Content: identity, exact de-duplication, verification, statistics, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_id


def identified(rows: DataFrame, data: str, name: str = "id") -> DataFrame:
    return rows.withColumn(name, content_id(data))


def deduplicated(rows: DataFrame, identity: str, key: str) -> DataFrame:
    """One row for each identity: copies and the smallest key; combined before the shuffle."""
    return rows.groupBy(identity).agg(F.count("*").alias("copies"), F.min(key).alias("representative"))


def verified(expected: DataFrame, content: DataFrame, identity: str = "id", data: str = "content") -> DataFrame:
    """expected with status: ok, missing or corrupt; of several stored copies one good one is enough.

    Contents are hashed where they are read, so that bytes are not shuffled.
    """
    found = content.select(identity, (content_id(data) == F.col(identity)).alias("_good")).groupBy(identity).agg(F.coalesce(F.bool_or("_good"), F.lit(False)).alias("_good"))
    status = F.when(F.col("_good").isNull(), "missing").when(F.col("_good"), "ok").otherwise("corrupt")
    return expected.join(found, identity, "left").withColumn("status", status).drop("_good")


def work_list(expected: DataFrame, present: DataFrame, identity: str = "id") -> DataFrame:
    """What has to be fetched or copied: expected rows whose identity is not present."""
    return expected.join(present.select(identity).distinct(), identity, "left_anti")


def appended(table: DataFrame, new: DataFrame, identity: str = "id") -> DataFrame:
    """Write-once append: rows of new whose identity the table lacks, one of each."""
    return work_list(new.dropDuplicates([identity]), table, identity)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of each key the row that is last in order. An aggregate, so a hot key shrinks before the shuffle."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_r")).select("_r.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: of each key the row that is first in order."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_r")).select("_r.*")


def set_ref(refs: DataFrame, new: DataFrame) -> DataFrame:
    """refs after setting new ones (name, artifact, updated_at, immutable), in order of their times.

    An immutable ref can't be moved; setting it to what it is changes nothing. So of several settings of a
    name the first immutable one stays, and without one the last.
    """
    row = F.struct(*refs.columns)
    both = refs.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    time, fixed = F.struct("updated_at", "artifact"), F.coalesce("immutable", F.lit(False))
    old = F.max_by(row, F.when(~F.col("_new"), time))
    locked = F.bool_or(~F.col("_new") & fixed)
    made = F.coalesce(F.min_by(row, F.when(F.col("_new") & fixed, time)), F.max_by(row, F.when(F.col("_new"), time)), old)
    return both.groupBy("name").agg(F.when(locked, old).otherwise(made).alias("_r")).select("_r.*")


def stats(content: DataFrame, artifacts: DataFrame, refs: DataFrame, leases: DataFrame, size: str = "size") -> DataFrame:
    """One row: objects, artifacts, refs, leases and physical bytes of content and manifests."""
    c = content.agg(F.count("*").alias("content_objects"), F.coalesce(F.sum(size), F.lit(0)).alias("_c"))
    a = artifacts.agg(F.count("*").alias("artifacts"), F.coalesce(F.sum(size), F.lit(0)).alias("_a"))
    r, n = refs.agg(F.count("*").alias("refs")), leases.agg(F.count("*").alias("leases"))
    return c.crossJoin(a).crossJoin(r).crossJoin(n).select("content_objects", "artifacts", "refs", "leases", (F.col("_c") + F.col("_a")).alias("physical_bytes"))


def get_refs(refs: DataFrame, names: DataFrame) -> DataFrame:
    """name, artifact of each name asked for; artifact is null where there is no such ref."""
    return names.select("name").distinct().join(refs.select("name", "artifact"), "name", "left")


def delete_refs(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs without those named; a name without a ref is no fault, and an immutable ref may be deleted."""
    return refs.join(names.select("name").distinct(), "name", "left_anti")


def attested(attestations: DataFrame, new: DataFrame) -> DataFrame:
    """attestations after adding new ones (id, subject, predicate_type, statement, created_at, issuer), which nobody signed yet."""
    return appended(attestations, new.withColumn("signature", F.lit(None).cast("string"))).select(attestations.columns).unionByName(attestations)


def put_manifests(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """artifacts (id, manifest) after putting canonical manifests: named by their hash, written once."""
    made = new.select(content_id("manifest").alias("id"), "manifest")
    return artifacts.select("id", "manifest").unionByName(appended(artifacts, made).select("id", "manifest"))
