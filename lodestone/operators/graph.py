"""Graph computations over edge tables: closures, garbage collection, lineage, mirroring, levels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import folder, written
from .history import live
from .store import verified


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Rows that a side of a join may have to be sent to all tasks by way of the driver. Sizes of files don't tell: they are compressed.
SENT = 100_000


def shared(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, as a side of a join: one of more than SENT is joined where it lies and not broadcast."""
    return df.hint("merge") if rows > SENT else df


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """df in the shared folder, dealt out and sorted by a column, and registered under a name of its own: joins on that column don't shuffle it again."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    name, n = f"lodestone_{path.rsplit('/', 1)[-1]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(name)
    return spark.table(name)


def closure(roots: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node, depth of all nodes that roots reach; roots has node, edges has src and dst.

    Edges are written once, in buckets by src, so no round shuffles them. Each round joins only the newest
    nodes with them, and every round's nodes are written once. Rounds are merged now and then. Cycles
    end by the anti join. Nodes without a row of their own are reached but not expanded.
    """
    edges = bucketed(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "src")
    frontier = written(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    rounds, new = [frontier], frontier.count()
    total = new
    for depth in range(1, most_rounds + 1):
        step = edges.join(shared(frontier.select(F.col("node").alias("src")), new), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(shared(union(rounds).select("node"), total), "node", "left_anti").withColumn("depth", F.lit(depth)))
        new = frontier.count()
        total += new
        if not new:
            return union(rounds)
        rounds.append(frontier)
        if len(rounds) > 8:
            rounds = [written(union(rounds))]
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def seeds(refs: DataFrame, leases: DataFrame, extra: DataFrame, as_of: str) -> DataFrame:
    """Roots: refs, what live leases hold, and extra ones."""
    held = live(leases, as_of).select(F.explode("roots").alias("node"))
    return refs.select(F.col("artifact").alias("node")).union(held).union(extra.select("node")).distinct()


def content_edges(artifacts: DataFrame, collections: DataFrame, tree_entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The edges of stored objects: artifact to content, schema, members; tree to contents; chunk manifest to chunks."""
    return (
        artifacts.select(F.col("id").alias("src"), F.col("content").alias("dst"))
        .union(artifacts.where("schema is not null").select("id", "schema"))
        .union(collections.select("collection_content", "artifact"))
        .union(tree_entries.select("tree_content", "content"))
        .union(chunks.select("manifest_content", "content"))
    )


def unreachable(objects: DataFrame, reached: DataFrame, identity: str = "id") -> DataFrame:
    return objects.join(reached.select(F.col("node").alias(identity)), identity, "left_anti")


def collection_report(objects: DataFrame, reached: DataFrame, identity: str = "id", size: str = "size", dry_run: bool = True) -> DataFrame:
    """One row: removed objects and bytes, retained objects, dry_run."""
    marked = objects.join(reached.select(F.col("node").alias(identity), F.lit(True).alias("_kept")), identity, "left")
    gone = F.col("_kept").isNull()
    return marked.agg(
        F.count(F.when(gone, 1)).alias("removed"), F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("reclaimed_bytes"), F.count(F.when(~gone, 1)).alias("retained"), F.lit(dry_run).alias("dry_run")
    )


def lineage_edges(realizations: DataFrame, outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Artifact to the artifacts that the actions producing it used."""
    return outputs.join(realizations.select(F.col("id").alias("realization_id"), "action_key"), "realization_id").join(inputs.withColumnRenamed("artifact", "used"), "action_key").select(F.col("artifact").alias("src"), F.col("used").alias("dst"))


def lineage(artifacts: DataFrame, realizations: DataFrame, outputs: DataFrame, inputs: DataFrame, observations: DataFrame) -> DataFrame:
    """artifact, depth, producers, inputs (a multiset), sources of everything upstream of artifacts (node)."""
    nodes = closure(artifacts, lineage_edges(realizations, outputs, inputs)).withColumnRenamed("node", "artifact")
    made = outputs.join(realizations.select(F.col("id").alias("realization_id"), "action_key"), "realization_id")
    by = made.groupBy("artifact").agg(F.array_sort(F.collect_list("realization_id")).alias("producers"))
    used = made.join(inputs.withColumnRenamed("artifact", "used"), "action_key").groupBy("artifact").agg(F.array_sort(F.collect_list("used")).alias("inputs"))
    seen = observations.groupBy("artifact").agg(F.array_sort(F.collect_list("canonical_ref")).alias("sources"))
    return nodes.join(by, "artifact", "left").join(used, "artifact", "left").join(seen, "artifact", "left")


def missing_from(reached: DataFrame, target: DataFrame, identity: str = "id") -> DataFrame:
    """Objects of a closure that a mirror lacks, with their depth: greater ones go first, so that contents come before manifests."""
    return reached.withColumnRenamed("node", identity).join(target.select(identity).distinct(), identity, "left_anti")


def levels(dependencies: dict[str, Iterable[str]]) -> list[list[str]]:
    """Tasks by level: each after all it depends on; names that are no tasks are sources. Raises on a cycle."""
    waiting = {t: {d for d in deps if d in dependencies} for t, deps in dependencies.items()}
    out = []
    while waiting:
        ready = sorted(t for t, deps in waiting.items() if not deps)
        if not ready:
            raise ValueError(f"cycle among {sorted(waiting)}")
        out.append(ready)
        waiting = {t: deps - set(ready) for t, deps in waiting.items() if t not in ready}
    return out


def level_table(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """task, level for a DAG as tables (task; task, depends_on): the longest path to a source. Raises on a cycle."""
    nodes = written(tasks.select("task").distinct())
    of = shared(nodes.withColumnRenamed("task", "depends_on"), nodes.count())
    edges = written(dependencies.join(of, "depends_on", "left_semi").select("task", "depends_on").distinct())
    level, waiting = 0, edges.count()
    ready = written(nodes.join(shared(edges.select("task").distinct(), waiting), "task", "left_anti").withColumn("level", F.lit(level)))
    rounds = [ready]
    while waiting:
        new = ready.count()
        if not new:
            raise ValueError("cycle")
        left = written(edges.join(shared(ready.select(F.col("task").alias("depends_on")), new), "depends_on", "left_anti"))
        level, waiting = level + 1, left.count()
        ready = written(edges.select("task").distinct().join(shared(left.select("task").distinct(), waiting), "task", "left_anti").withColumn("level", F.lit(level)))
        edges = left
        rounds = [written(union(rounds)), ready] if len(rounds) > 8 else [*rounds, ready]
    return union(rounds)


def integrity(roots: DataFrame, edges: DataFrame, objects: DataFrame, identity: str = "id", data: str = "content") -> DataFrame:
    """node, status (missing or corrupt) of what roots reach and objects (id, content) doesn't hold as it should; no rows if all is well."""
    reached = closure(roots, edges).select(F.col("node").alias(identity))
    return verified(reached, objects, identity, data).where("status <> 'ok'").select(F.col(identity).alias("node"), "status")


def first_visits(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, path of all nodes that roots reach, where path orders them as a depth-first walk first meets them.

    roots has node and nth (the order of the walks), edges src, dst and nth (the order of src's
    children; equal ones go by dst). In a graph without cycles a walk first meets a node by its least path, as a
    smaller path to a node on the way would lead there too. So a node's path is the least, over its parents,
    of the parent's path and its own number below it; each round settles the nodes whose parents are all
    settled. A number takes two bytes of a path up to 255 children, three up to 65,535. Raises on a cycle.
    """
    asked = roots.select(F.lit(None).cast(dict(edges.dtypes)["src"]).alias("src"), F.col("node").alias("dst"), "nth")
    reached = closure(roots, edges).select(F.col("node").alias("src"))
    every = written(asked.unionByName(edges.select("src", "dst", "nth").join(shared(reached, reached.count()), "src", "left_semi")).where("dst is not null").groupBy("src", "dst").agg(F.min("nth").alias("nth")))
    # children by their place, from 0, so that numbers are short; a hot parent's children are numbered by ranges
    placed = numbered(every, ["src", "nth", "dst"], "place")
    start = placed.groupBy(F.col("src").alias("_src")).agg(F.min("place").alias("_start"))
    some = every.count()
    joined = placed.join(shared(start, some), F.col("src").eqNullSafe(F.col("_src"))).select("src", "dst", (F.col("place") - F.col("_start")).alias("k"))
    digits = F.hex("k")
    digits = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    whole = F.concat(F.lpad(F.hex((F.length(digits) / 2).cast("int")), 2, "0"), digits)
    whole = written(joined.select("src", "dst", F.unhex(whole).alias("own")))
    needed = written(whole.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("parents")))
    needed = shared(needed, needed.count())
    edges = bucketed(whole.where("src is not null"), "src")
    reached = whole.where("src is null").select(F.col("dst").alias("node"), F.col("own").alias("path"), F.lit(1).cast("long").alias("seen"))
    waiting, settled = None, []
    while True:
        all_ = reached if waiting is None else waiting.unionByName(reached)
        state = written(all_.groupBy("node").agg(F.min("path").alias("path"), F.sum("seen").alias("seen")).join(needed, "node"))
        done = state.where("seen = parents").select("node", "path")
        waiting = state.where("seen < parents").select("node", "path", "seen")
        new = done.count()
        if not new:
            if not waiting.isEmpty():
                raise ValueError("cycle")
            return union(settled) if settled else done
        settled = [written(union([*settled, done]))] if len(settled) > 7 else [*settled, done]
        reached = edges.join(shared(done.withColumnRenamed("node", "src"), new), "src").select(F.col("dst").alias("node"), F.concat("path", "own").alias("path"), F.lit(1).cast("long").alias("seen"))


def layer_edges(artifacts: DataFrame, collections: DataFrame, tree_entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst, nth: what an image of an artifact (id, content, schema, kind) holds, in order: its content, its schema, then its members.

    Members are of the manifest that is its content: artifacts of a collection (collection_content, ordinal,
    artifact), contents of a tree (tree_content, ordinal, content), chunks of a blob (manifest_content, ordinal, content).
    """
    own = artifacts.select(F.col("id").alias("src"), F.col("content").alias("dst"), F.lit(0).cast("long").alias("nth"))
    schema = artifacts.where("schema is not null").select(F.col("id").alias("src"), F.col("schema").alias("dst"), F.lit(1).cast("long").alias("nth"))
    out = own.unionByName(schema)
    for kind, members, key, value in (("collection", collections, "collection_content", "artifact"), ("tree", tree_entries, "tree_content", "content"), ("blob", chunks, "manifest_content", "content")):
        of = artifacts.where(F.col("kind") == kind).select(F.col("id").alias("src"), F.col("content").alias("_key"))
        out = out.unionByName(of.join(members.select(F.col(key).alias("_key"), F.col(value).alias("dst"), (F.col("ordinal").cast("long") + 2).alias("nth")), "_key").select("src", "dst", "nth"))
    return out


def image_layers(roots: DataFrame, edges: DataFrame, artifacts: DataFrame, objects: DataFrame) -> DataFrame:
    """node, role, ordinal, size: the layers of an image that holds all that roots (node, nth) reach, each once.

    They stand as a depth-first walk over edges (src, dst, nth; see ``layer_edges``) first meets them.
    artifacts (id, size) are manifests, objects (id, size) contents; what neither holds has no layer.
    """
    both = artifacts.select("id", "size", F.lit("artifact-manifest").alias("role")).unionByName(objects.select("id", "size", F.lit("content").alias("role")))
    visits = first_visits(roots, edges)
    layers = shared(visits, visits.count()).join(both.withColumnRenamed("id", "node"), "node")
    return numbered(layers, ["path"], "ordinal").select("node", "role", "ordinal", "size")


def running(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value up to each in order, itself included; by ranges, so that no task holds them all. Ties in any order."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = written(parts)
    sizes = parts.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_s", inside).join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p").withColumn(name, F.col("_before") + F.col("_s")).drop("_p", "_i", "_s", "_before")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in order, from 0; by ranges, so that no task holds them all."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = written(parts)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return parts.join(F.broadcast(sizes.withColumn("_before", before)), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_n", "_first", "_before")
