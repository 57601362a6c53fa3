"""Queries over recorded history: actions, attempts, realizations, checkpoints, attestations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.scalars import attempt_status


def with_status(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("status", attempt_status("finished_at", "exit_code"))


def latest(rows: DataFrame, keys: list[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key; of equal times the greatest tie. An aggregate, so a hot key shrinks before the shuffle."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(time, tie))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select("_r.*")


def latest_with_ties(rows: DataFrame, keys: list[str], time: str = "created_at") -> DataFrame:
    """Every row whose time is its key's greatest."""
    return rows.join(rows.groupBy(*keys).agg(F.max(time).alias(time)), [*keys, time], "left_semi")


def recent(rows: DataFrame, n: int, time: str = "started_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)


def within_days(time: str | Column, as_of: str, days: int) -> Column:
    """At or after as_of minus days, never fewer than none."""
    time = F.col(time) if isinstance(time, str) else time
    return time >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(max(days, 0)))


def live(leases: DataFrame, as_of: str, expires: str = "expires_at") -> DataFrame:
    return leases.where(F.col(expires) > F.lit(as_of).cast("timestamp"))


def producers(realizations: DataFrame, outputs: DataFrame, artifact: str | None = None) -> DataFrame:
    """Realizations with the outputs they produced; one row for each output name."""
    if artifact is not None:
        outputs = outputs.where(F.col("artifact") == artifact)
    return realizations.join(outputs, realizations.id == outputs.realization_id).drop("realization_id")


def previous_actions(attempts: DataFrame) -> DataFrame:
    """Where a task's action key changed: name, action_key, previous_key."""
    w = Window.partitionBy("name").orderBy("started_at", "id")
    lagged = attempts.withColumn("previous_key", F.lag("action_key").over(w))
    return lagged.where("previous_key is not null and previous_key <> action_key").select("name", "id", "action_key", "previous_key")


def determinism(realizations: DataFrame, outputs: DataFrame) -> DataFrame:
    """action_key, name, variants (sorted distinct artifacts)."""
    joined = realizations.select("id", "action_key").join(outputs, F.col("id") == F.col("realization_id"))
    return joined.groupBy("action_key", "name").agg(F.array_sort(F.collect_set("artifact")).alias("variants"))


def deterministic(realizations: DataFrame, outputs: DataFrame) -> DataFrame:
    """action_key, deterministic: every output had one variant."""
    joined = realizations.select("id", "action_key").join(outputs, F.col("id") == F.col("realization_id"))
    each = joined.groupBy("action_key", "name").agg((F.min("artifact") == F.max("artifact")).alias("one"))
    return each.groupBy("action_key").agg(F.bool_and("one").alias("deterministic"))


def retained_roots(realizations: DataFrame, outputs: DataFrame, inputs: DataFrame, checkpoints: DataFrame, attestations: DataFrame, as_of: str, days: int) -> DataFrame:
    """Distinct artifacts that retention keeps: outputs and inputs of recent realizations, checkpoints, attested subjects."""
    newest = realizations.where(within_days("created_at", as_of, days))
    made = newest.join(outputs, newest.id == outputs.realization_id).select("artifact")
    used = newest.select("action_key").distinct().join(inputs, "action_key").select("artifact")
    held = checkpoints.where(within_days("created_at", as_of, days)).select("artifact")
    attested = attestations.select(F.col("subject").alias("artifact"))
    return made.union(used).union(held).union(attested).distinct()


def cacheable(actions: DataFrame, realizations: DataFrame, outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """action_key, hit: the policy allows reuse and every artifact of the newest realization can be loaded."""
    newest = latest(realizations, ["action_key"]).select("action_key", F.col("id").alias("realization_id"))
    wanted = newest.join(outputs, "realization_id", "left").join(artifacts.select(F.col("id").alias("artifact"), F.lit(True).alias("there")).distinct(), "artifact", "left")
    there = wanted.groupBy("action_key").agg(F.bool_and(F.col("artifact").isNull() | F.coalesce("there", F.lit(False))).alias("all_there"))
    hit = F.col("cache").isin("pure", "reproducible") & F.coalesce("all_there", F.lit(False))
    return actions.join(there, "action_key", "left").select("action_key", hit.alias("hit"))


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old, new of the fields that differ (nulls compare as values)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(key, fields, "field", name)

    both = long(old, "old").join(long(new, "new"), [key, "field"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def record_changes(old: DataFrame, new: DataFrame, key: str, record: str = "record") -> DataFrame:
    """key, path, old, new: where two records (JSON) of a key differ, down to the fields of nested objects.

    path is a JSON pointer; old and new are JSON, null where a side lacks the field (a field that is null is 'null'). Objects are
    compared field by field whatever their order, arrays as a whole, decimals by value (1 is 1.0). A key of one side, or
    a null record, differs at path ''. Keys are unique on each side, and text that is no JSON raises. One join brings
    the two records together; from then on each row goes down into what differs only, without a shuffle.
    """
    # text between rounds: casts of variant columns are pushed into Parquet scans, where those of other kinds fail
    side = lambda df, name: df.select(key, F.to_json(F.parse_json(F.col(record).cast("string"))).alias(name))
    fields = lambda c: F.try_variant_get(F.parse_json(c), "$", "map<string, variant>")
    value = lambda c: F.to_json(F.try_element_at(c, F.col("_f")))
    differ, both = ~F.col("old").eqNullSafe(F.col("new")), F.col("_o").isNotNull() & F.col("_n").isNotNull()
    pointer = F.concat("path", F.lit("/"), F.replace(F.replace("_f", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    level = written(side(old, "old").join(side(new, "new"), key, "full").select(key, F.lit("").alias("path"), "old", "new").where(differ))
    found = [level.where("false")]
    while not level.isEmpty():
        parsed = level.withColumn("_o", fields("old")).withColumn("_n", fields("new"))
        found.append(parsed.where(~both).select(key, "path", "old", "new"))
        each = parsed.where(both).select(key, "path", "_o", "_n", F.explode(F.array_union(F.map_keys("_o"), F.map_keys("_n"))).alias("_f"))
        level = written(each.select(key, pointer.alias("path"), value("_o").alias("old"), value("_n").alias("new")).where(differ))
        if len(found) > 8:
            found = [written(reduce(DataFrame.unionByName, found))]
    return reduce(DataFrame.unionByName, found)


def inspected(artifacts: DataFrame, observations: DataFrame, realizations: DataFrame, outputs: DataFrame, attestations: DataFrame) -> DataFrame:
    """All that is known of each artifact (id, manifest): sources, producers and attestations, as sorted arrays."""
    seen = observations.groupBy(F.col("artifact").alias("id")).agg(F.array_sort(F.collect_list("canonical_ref")).alias("sources"))
    made = outputs.join(realizations.select(F.col("id").alias("realization_id")), "realization_id", "left_semi").groupBy(F.col("artifact").alias("id")).agg(F.array_sort(F.collect_list("realization_id")).alias("producers"))
    said = attestations.groupBy(F.col("subject").alias("id")).agg(F.array_sort(F.collect_list("predicate_type")).alias("attestations"))
    return artifacts.join(seen, "id", "left").join(made, "id", "left").join(said, "id", "left")
