"""Gates: trust policy, cost budget, frozen locks, output contracts, receipts, reference resolution."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cost_micros
from .store import set_ref


def policy(subjects: DataFrame, attestations: DataFrame, required: Iterable[str] = (), issuers: Iterable[str] = (), signed: bool = False, least: int = 0) -> DataFrame:
    """subject, passes, reason: the first check that fails, in the order count, predicates, issuers, signatures.

    Quantifiers over no attestations: 'all' holds, 'any' doesn't. A null issuer is not allowed.
    """
    required, issuers = list(required), list(issuers)
    allowed = F.coalesce(F.col("issuer").isin(issuers), F.lit(False)) if issuers else F.lit(True)
    each = attestations.groupBy("subject").agg(
        F.count("*").alias("n"), F.collect_set("predicate_type").alias("predicates"), F.bool_and(allowed).alias("issued"), F.bool_and(F.col("signature").isNotNull()).alias("signed")
    )
    joined = subjects.select("subject").distinct().join(each, "subject", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < least, F.lit("count"))
    for p in required:
        reason = reason.when(~F.coalesce(F.array_contains("predicates", p), F.lit(False)), F.lit(f"predicate {p}"))
    reason = reason.when(~F.coalesce("issued", F.lit(True)), F.lit("issuer"))
    if signed:
        reason = reason.when(~F.coalesce("signed", F.lit(True)), F.lit("signature"))
    return joined.select("subject", reason.alias("reason")).select("subject", F.col("reason").isNull().alias("passes"), "reason")


def within_cost(runs: DataFrame, rate: str, millis: str, most: Column | str) -> DataFrame:
    """runs with cost_usd_micros and accepted: not above most; without a bound always."""
    most = F.col(most) if isinstance(most, str) else most
    return runs.withColumn("cost_usd_micros", cost_micros(rate, millis)).withColumn("accepted", ~F.coalesce(F.col("cost_usd_micros") > most, F.lit(False)))


def timeout(seconds: Column | str, most_wall: Column | str) -> Column:
    return F.least(seconds, most_wall)


def missing_outputs(declared: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    return declared.join(produced.select(*keys).distinct(), keys, "left_anti")


def lock_status(intents: DataFrame, locks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """name, status: ok, frozen_mismatch (not locked, or locked for another requirement) or locked_missing."""
    held = locks.select("name", F.col("requirement_hash").alias("locked_hash"), "artifact")
    there = artifacts.select(F.col("id").alias("artifact"), F.lit(True).alias("there")).distinct()
    joined = intents.join(held, "name", "left").join(there, "artifact", "left")
    same = F.coalesce(F.col("requirement_hash") == F.col("locked_hash"), F.lit(False))
    return joined.select("name", F.when(~same, "frozen_mismatch").when(F.col("there").isNull(), "locked_missing").otherwise("ok").alias("status"))


RECEIPT_FIELDS = ("schema_name", "producer_name", "producer_version", "producer_contract", "producer_build")


def receipt_status(receipts: DataFrame, identity: Column | None = None, fields: Iterable[str] = RECEIPT_FIELDS) -> DataFrame:
    """receipts with reason: the first fault, or null. Fields must not be blank, the interval not reversed, receipt_id the identity of the rest."""
    reason = None
    for f in fields:
        blank = F.coalesce(F.trim(f) == "", F.lit(True))
        reason = F.when(blank, F.lit(f"blank {f}")) if reason is None else reason.when(blank, F.lit(f"blank {f}"))
    late = F.col("finished_at") < F.col("started_at")
    reason = F.when(late, F.lit("interval")) if reason is None else reason.when(late, F.lit("interval"))
    if identity is not None:
        reason = reason.when(~F.col("receipt_id").eqNullSafe(identity), F.lit("identity"))
    return receipts.withColumn("reason", reason)


def resolve(targets: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """target, artifact, found: a source of that name, else an output of that name, else the only output of that task."""
    task = outputs.withColumn("task", F.substring_index("name", ".", 1)).where(F.col("task") != F.col("name")).groupBy("task").agg(F.count("*").alias("n"), F.min("artifact").alias("only"))
    joined = (
        targets.join(sources.select(F.col("name").alias("target"), F.col("artifact").alias("s")), "target", "left")
        .join(outputs.select(F.col("name").alias("target"), F.col("artifact").alias("o")), "target", "left")
        .join(task.where("n = 1").select(F.col("task").alias("target"), "only"), "target", "left")
    )
    found = F.when(F.col("s").isNotNull(), "source").when(F.col("o").isNotNull(), "output").when(F.col("only").isNotNull(), "task").otherwise("unknown")
    return joined.select("target", F.coalesce("s", "o", "only").alias("artifact"), found.alias("found"))


def routed(references: DataFrame, profiles: DataFrame, providers: DataFrame) -> DataFrame:
    """scheme, locator, provider, effective scheme: a profile alias leads to its provider by name or scheme; else the scheme's own provider."""
    p = profiles.select(F.col("alias").alias("scheme"), F.col("kind"))
    by_name = providers.select(F.col("name").alias("kind"), F.col("name").alias("n1"), F.element_at("schemes", 1).alias("s1"))
    by_scheme = providers.select(F.col("name").alias("n2"), F.explode("schemes").alias("k2"))
    routed_ = references.join(p, "scheme", "left").withColumn("wanted", F.coalesce("kind", "scheme"))
    routed_ = routed_.join(by_name, "kind", "left").join(by_scheme, F.col("wanted") == F.col("k2"), "left")
    return routed_.select("scheme", "locator", F.coalesce("n1", "n2").alias("provider"), F.coalesce("s1", "k2").alias("effective"))


def promoted(refs: DataFrame, wanted: DataFrame, verdicts: DataFrame, at: str, mutable: bool = False) -> DataFrame:
    """refs after pointing the names of wanted (name, artifact) to their artifacts, where the policy's verdicts (subject, passes) allow it."""
    fine = wanted.join(verdicts.where("passes").select(F.col("subject").alias("artifact")), "artifact", "left_semi")
    return set_ref(refs, fine.select("name", "artifact", F.lit(at).cast("timestamp").alias("updated_at"), F.lit(not mutable).alias("immutable")))
