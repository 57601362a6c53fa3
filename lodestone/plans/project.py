"""Projects: tasks over datasets, planned by level, run with content-keyed reuse.

A project is TOML (version 3; version 2 is upgraded): providers, sources, tasks, refs. A
task is a Python callable from named DataFrames to named DataFrames, registered by name. Its
action key is the hash of what it does and of its inputs' identities, so an unchanged task
is not run again; ``foreach`` tasks are keyed by item. Plan objects are small and live on
the driver; data stays in DataFrames.
"""

from __future__ import annotations

import json
import math
import time
import tomllib
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import written
from ..functions.canonical import artifact_id, canonical_json, digest_record, ordered, requirement_hash, sha256_id
from ..operators.graph import levels
from ..operators.historylog import HistoryLog

REALIZATION = "id string, attempt_id string, action_key string, name string, stored string, cache string, started_at timestamp, finished_at timestamp, outputs map<string,string>"
ATTEMPT = "id string, action_key string, name string, started_at timestamp, finished_at timestamp, exit_code int, error string"
OUTPUT = "realization_id string, name string, artifact string"
CACHES = ("pure", "reproducible", "volatile", "effect")  # fixed values
REUSED = CACHES[:2]
NETWORKS = ("deny", "allow", "restricted")
SANDBOXES = ("none", "read_only_inputs", "strict", "container")


@dataclass(frozen=True)
class Output:
    kind: str = "blob"
    media_type: str | None = None
    schema: str | None = None

    def record(self) -> dict[str, Any]:
        return {"kind": self.kind} | ({"media_type": self.media_type} if self.media_type is not None else {}) | ({"schema": digest_record(self.schema)} if self.schema else {})


@dataclass(frozen=True)
class Action:
    """A requested computation. Only what affects its result enters the key."""

    name: str
    command: tuple[str, ...]
    inputs: dict[str, str] = field(default_factory=dict)
    code: dict[str, str] = field(default_factory=dict)
    parameters: Any = None
    variables: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, Output] = field(default_factory=dict)
    network: str = "deny"
    sandbox: str = "read_only_inputs"
    cache: str = "reproducible"
    platform: str | None = None
    timeout_seconds: int | None = None
    max_wall_seconds: int | None = None
    max_usd_micros: int | None = None
    cost_usd_micros_per_hour: int | None = None

    def __post_init__(self):
        if not self.command:
            raise ValueError("an action needs a command")
        if self.cache not in CACHES:
            raise ValueError(f"unknown cache policy {self.cache!r}")

    def identity(self) -> bytes:
        ids = lambda m: {k: digest_record(m[k]) for k in sorted(m)}
        return canonical_json({
            "version": 1, "command": list(self.command), "inputs": ids(self.inputs), "code": ids(self.code), "parameters": ordered(self.parameters), "environment": {"variables": ordered(self.variables)},
            "outputs": {k: self.outputs[k].record() for k in sorted(self.outputs)}, "network": self.network, "sandbox": self.sandbox, "platform": self.platform,
        })

    def key(self) -> str:
        return sha256_id(self.identity())

    def wall_limit(self) -> int | None:
        known = [x for x in (self.timeout_seconds, self.max_wall_seconds) if x is not None]
        return min(known) if known else None

    def summary(self) -> dict[str, int]:
        return {"argv": len(self.command), "code": len(self.code), "inputs": len(self.inputs), "outputs": len(self.outputs)}


class ActionBuilder:
    """Builds an Action step by step; parameters and maps add up."""

    def __init__(self, name: str, program: str):
        self._a = Action(name, (program,))

    def args(self, *values: str) -> ActionBuilder:
        self._a = replace(self._a, command=(*self._a.command, *values))
        return self

    def _put(self, field_: str, key: str, value: Any) -> ActionBuilder:
        self._a = replace(self._a, **{field_: (getattr(self._a, field_) or {}) | {key: value}})
        return self

    def input(self, name: str, artifact: str) -> ActionBuilder:
        return self._put("inputs", name, artifact)

    def code(self, name: str, artifact: str) -> ActionBuilder:
        return self._put("code", name, artifact)

    def output(self, name: str, output: Output = Output()) -> ActionBuilder:
        return self._put("outputs", name, output)

    def parameter(self, key: str, value: Any) -> ActionBuilder:
        return self._put("parameters", key, value)

    def env(self, key: str, value: str) -> ActionBuilder:
        return self._put("variables", key, value)

    def options(self, **fields: Any) -> ActionBuilder:
        self._a = replace(self._a, **fields)
        return self

    def build(self) -> Action:
        return self._a


def action_diff(old: Action, new: Action) -> list[str]:
    """Fields that differ between two actions."""
    return sorted(f for f in Action.__dataclass_fields__ if getattr(old, f) != getattr(new, f))


@dataclass
class Task:
    run: str
    inputs: dict[str, str] = field(default_factory=dict)
    foreach: str | None = None
    outputs: tuple[str, ...] = ("out",)
    parameters: dict[str, Any] = field(default_factory=dict)
    cache: str = "reproducible"
    depends_on: tuple[str, ...] = ()
    by_item: bool = False

    def dependencies(self) -> set[str]:
        named = [*self.inputs.values(), *([self.foreach] if self.foreach else []), *self.depends_on]
        return {n.removeprefix("@").split(".", 1)[0] for n in named}


@dataclass
class Project:
    providers: dict[str, dict] = field(default_factory=dict)
    sources: dict[str, dict] = field(default_factory=dict)
    tasks: dict[str, Task] = field(default_factory=dict)
    refs: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Project:
        """Version 3, or 2 (the default), of which providers and artifacts stay. Provider settings may be flat."""
        raw = tomllib.loads(text)
        version = raw.get("version", 2)
        if version not in (2, 3):
            raise ValueError(f"unknown project version {version}")
        tasks = {} if version == 2 else raw.get("tasks", {})
        flat = {n: {"kind": p.get("kind"), "config": p.get("config", {}) | {k: v for k, v in p.items() if k not in ("kind", "config")}} for n, p in raw.get("providers", {}).items()}
        made = {n: Task(t["run"], t.get("inputs", {}), t.get("foreach"), tuple(t.get("outputs", ("out",))), t.get("parameters", {}), t.get("cache", "reproducible"), tuple(t.get("depends_on", ())), bool(t.get("by_item", False))) for n, t in tasks.items()}
        return Project(flat, raw.get("artifacts", raw.get("sources", {})), made, raw.get("refs", {}) if version == 3 else {})

    def plan(self, targets: Iterable[str] | None = None) -> list[list[str]]:
        """Levels of the tasks that targets need (all without targets); unknown names and cycles raise."""
        for name, task in self.tasks.items():
            for d in task.dependencies():
                if d not in self.tasks and d not in self.sources:
                    raise KeyError(f"{name} depends on unknown {d!r}")
        wanted, stack = set(), [t.removeprefix("@").split(".", 1)[0] for t in (self.tasks if targets is None else targets)]
        while stack:
            t = stack.pop()
            if t in self.tasks and t not in wanted:
                wanted.add(t)
                stack += self.tasks[t].dependencies()
            elif t not in self.tasks and t not in self.sources:
                raise KeyError(f"unknown target {t!r}")
        return levels({t: self.tasks[t].dependencies() for t in wanted})


def exact(value: Column, kind: T.DataType) -> Column:
    """A value whose JSON tells all values of its type apart: times to the microsecond, maps as sorted pairs."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, (T.TimestampNTZType, T.TimeType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return value.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[exact(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])) if kind.fields else value.isNull()
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: exact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(F.to_json(F.struct(exact(e["key"], kind.keyType).alias("k")), KEEP_NULLS).alias("k"), exact(e["value"], kind.valueType).alias("v")))
        return F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return value


KEEP_NULLS = {"ignoreNullFields": "false"}


def row_name(columns: list[tuple[Column, T.DataType]]) -> Column:
    """SHA-256, in hex, of a row's exact values, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[exact(c, k).alias(f"c{i}") for i, (c, k) in enumerate(columns)]), KEEP_NULLS) if columns else F.lit("{}"), 256)


def _any_null(schema: Any) -> Any:
    """A schema's JSON without what it says of nulls, which files don't keep."""
    if isinstance(schema, dict):
        return {k: _any_null(v) for k, v in schema.items() if k not in ("nullable", "containsNull", "valueContainsNull")}
    return [_any_null(x) for x in schema] if isinstance(schema, list) else schema


def identity_of(df: DataFrame) -> str:
    """A frame's content identity: its schema and its rows as a multiset.

    Rows are named by SHA-256 of their exact values, nulls kept. The sums of the names' four quarters don't
    depend on the order of rows and combine before the shuffle.
    """
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    name = row_name([(F.col(f.name), f.dataType) for f in renamed.schema.fields])
    quarters = [F.conv(F.substring(name, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    row = renamed.agg(F.count("*"), *[F.coalesce(F.sum(q), F.lit(0)) for q in quarters]).first()
    return artifact_id(sha256_id(canonical_json([_any_null(df.schema.jsonValue()), *map(str, row)])), "collection")


@dataclass
class Result:
    """What a run gave: its action's key, its outputs' identities, whether they were reused, and the key their tables lie under."""

    key: str
    outputs: dict[str, str]
    hit: bool
    stored: str


class Runner:
    """Runs projects; keeps outputs by action key, history as rows, and items of foreach tasks one by one.

    root is a folder that all executors share. Outputs are Parquet tables named by key, written
    once: contents first, the history last, so a failed run leaves nothing that looks done. Items are
    worked on in lots of about per_lot, each kept when it is done, so a run after a failed one does the rest.
    """

    def __init__(self, spark: SparkSession, root: str, functions: dict[str, Callable], jobs: int = 8, per_lot: int = 1_000_000):
        self.spark, self.root, self.functions, self.jobs, self.per_lot = spark, root.rstrip("/"), functions, max(jobs, 1), per_lot
        self.log = HistoryLog(spark, f"{self.root}/history")
        self.history: list[dict] = []  # this session's attempts
        self.items: dict[str, ItemCache] = {}
        self.known: dict[str, tuple[dict[str, str], str]] = {}

    def _started(self, attempt: dict) -> None:
        """An attempt is on record as running before its work begins, so that a lost driver leaves a trace."""
        self.log.commit(attempts=self._rows(ATTEMPT, attempt))

    def _ended(self, attempt: dict, action: Action, stored: str | None = None, outputs: dict[str, str] | None = None) -> None:
        """The attempt's end, and, where it succeeded, its realization and outputs: all at once, after their contents."""
        tables = {"attempts": self._rows(ATTEMPT, attempt)}
        if outputs is not None:
            made = {"attempt_id": attempt["id"], "stored": stored, "cache": action.cache, "outputs": outputs} | {k: attempt[k] for k in ("action_key", "name", "started_at", "finished_at")}
            made["id"] = str(uuid.uuid4())
            tables["realizations"] = self._rows(REALIZATION, made)
            tables["outputs"] = self._rows(OUTPUT, *[{"realization_id": made["id"], "name": n, "artifact": a} for n, a in sorted(outputs.items())])
        self.log.commit(**tables)

    def _rows(self, schema: str, *records: dict) -> DataFrame:
        names = [f.split()[0] for f in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema).coalesce(1)

    def _past(self, **wanted: str) -> DataFrame | None:
        """Realizations of all sessions whose columns have these values; None where there is no history yet."""
        rows = self.realizations()
        for column, value in wanted.items() if rows is not None else ():
            rows = rows.where(F.col(column) == value)
        return rows

    def _known(self, key: str) -> tuple[dict[str, str], str] | None:
        """The newest outputs of an action and where they lie, of this session or an earlier one, if they are still there."""
        if key not in self.known:
            past = self._past(action_key=key)
            newest = past and past.agg(F.max_by(F.struct("stored", "outputs"), F.struct("finished_at", "id")).alias("r")).first().r
            if newest:
                self.known[key] = (dict(newest.outputs), newest.stored)
        if key in self.known and all(self._there(self.known[key][1], o) for o in self.known[key][0]):
            return self.known[key]
        return None

    def _there(self, stored: str, output: str) -> bool:
        try:
            self.read(stored, output)
        except AnalysisException:  # no such folder, or no file in it
            return False
        return True

    def realizations(self) -> DataFrame | None:
        """All sessions' results: id, attempt_id, action_key, name, stored, cache, started_at, finished_at, outputs."""
        return self.log.table("realizations")

    def attempts(self) -> DataFrame | None:
        """All sessions' attempts as they stand: one that runs, or whose driver was lost, has no finished_at."""
        return self.log.newest("attempts", ["id"], ["finished_at"])

    def retry(self, attempt_id: str, actions: dict[str, tuple[Action, Callable[[], dict[str, DataFrame]]]]) -> Result:
        """Runs the action of an attempt again, without reuse; actions holds what each key stands for."""
        attempts = self.attempts()
        found = attempts and attempts.where(F.col("id") == attempt_id).select("action_key").first()
        key = found and found[0]
        if key not in actions:
            raise KeyError(f"unknown attempt {attempt_id!r}")
        return self.run(*actions[key], force=True)

    def _path(self, key: str, output: str) -> str:
        return f"{self.root}/{key.split(':')[1][:2]}/{key.split(':')[1]}/{output}"

    def read(self, key: str, output: str) -> DataFrame:
        return self.spark.read.parquet(self._path(key, output))

    def run(self, action: Action, work: Callable[[], dict[str, DataFrame]], force: bool = False) -> Result:
        """Reuses the newest outputs of a pure or reproducible action, else works and records an attempt."""
        key, reused = action.key(), action.cache in REUSED and not force
        if reused and (found := self._known(key)):
            return Result(key, found[0], True, found[1])
        attempt = {"id": str(uuid.uuid4()), "action_key": key, "name": action.name, "started_at": datetime.now(timezone.utc), "finished_at": None, "exit_code": None, "error": None}
        self.history.append(attempt)
        self._started(attempt)
        began = time.monotonic()
        try:
            made = work(fresh=not reused) if isinstance(work, ItemWork) else work()
            missing = set(action.outputs) - set(made)
            if missing:
                raise ValueError(f"{action.name} did not produce {sorted(missing)}")
            # a run's tables lie under its key; a further run of an action gets a key of its own
            run_key = sha256_id((key + attempt["id"]).encode()) if any(self._there(key, o) for o in made) else key
            ids = {}
            for name, df in made.items():
                df.write.mode("overwrite").parquet(self._path(run_key, name))
                ids[name] = identity_of(self.read(run_key, name))
            millis = int((time.monotonic() - began) * 1000)
            cost = (action.cost_usd_micros_per_hour or 0) * millis // 3_600_000
            if action.max_usd_micros is not None and cost > action.max_usd_micros:
                raise RuntimeError(f"{action.name} cost {cost}, more than {action.max_usd_micros}")
            attempt |= {"finished_at": datetime.now(timezone.utc), "exit_code": 0, "outputs": ids}
        except Exception as e:
            attempt |= {"finished_at": datetime.now(timezone.utc), "exit_code": 1, "error": str(e)[:500]}
            self._ended(attempt, action)
            raise
        # reuse takes the newest outputs, so what is known moves on with every run
        self.known[key] = (ids, run_key)
        self._ended(attempt, action, run_key, ids)
        if action.cache == "pure" and self._past(action_key=key).select(F.array_sort(F.map_entries("outputs"))).distinct().limit(2).count() > 1:
            raise RuntimeError(f"{action.name} is declared pure but gave different outputs")
        return Result(key, ids, False, run_key)

    def why(self, action: Action) -> dict[str, Any]:
        """Whether the action would be reused, and the key its name had before."""
        key, past = action.key(), self._past(name=action.name)
        before = past and past.where(F.col("action_key") != key).agg(F.max_by("action_key", F.struct("finished_at", "id"))).first()[0]
        return {"key": key, "hit": action.cache in REUSED and self._known(key) is not None, "previous": before or None}

    def audit(self, action: Action, work: Callable[[], dict[str, DataFrame]], runs: int = 2) -> dict[str, list[str]]:
        """Each output's distinct identities over at least two forced runs."""
        seen: dict[str, set[str]] = {}
        for _ in range(max(runs, 2)):
            for name, identity in self.run(action, work, force=True).outputs.items():
                seen.setdefault(name, set()).add(identity)
        return {k: sorted(v) for k, v in seen.items()}

    def _each(self, name: str, task: Task, action: Action, items: DataFrame, function: Callable, fresh: bool) -> dict[str, DataFrame]:
        """A by_item task over its items (key, value): items that an earlier run worked on keep their results.

        Results are kept below root under the action's key without its items, so other code, parameters or
        inputs don't meet them; fresh works on all items again.
        """
        if len(task.outputs) != 1:
            raise ValueError(f"{name}: a task by item has one output")
        alone = replace(action, inputs={k: v for k, v in action.inputs.items() if k != "items"})
        cache = self.items[name] = ItemCache(self.spark, f"{self.root}/items/{alone.key().split(':')[1]}", self.per_lot)
        return {task.outputs[0]: cache.map(items, lambda missed: function(items=missed)[task.outputs[0]], fresh).select("key", "result")}

    def run_project(self, project: Project, sources: dict[str, DataFrame], targets: Iterable[str] | None = None, force: Iterable[str] = ()) -> dict[str, Result]:
        """Runs what targets need, level by level, the tasks of a level at the same time; only sources in use are read. Tasks named in force run without reuse."""
        frames: dict[str, DataFrame] = dict(sources)
        ids: dict[str, str] = {}
        done: dict[str, Result] = {}

        def lookup(name: str) -> tuple[DataFrame, str]:
            name = name.removeprefix("@")
            if name not in frames:
                alone = [n for n in frames if n.startswith(name + ".")]
                if len(alone) != 1:
                    raise KeyError(f"{name!r} is no source, output, or task with a single output")
                name = alone[0]
            if name not in ids:
                ids[name] = identity_of(frames[name])
            return frames[name], ids[name]

        def work(name: str) -> tuple[str, Result]:
            task = project.tasks[name]
            given = {k: lookup(v) for k, v in task.inputs.items()}
            if task.foreach:
                given["items"] = lookup(task.foreach)
            action = Action(name, (task.run,), {k: i for k, (_, i) in given.items()}, parameters=task.parameters or None, outputs={o: Output("collection") for o in task.outputs}, cache=task.cache)
            function = lambda **items: self.functions[task.run](**{k: df for k, (df, _) in given.items()} | items, **task.parameters)
            return name, self.run(action, ItemWork(lambda fresh: self._each(name, task, action, given["items"][0], function, fresh)) if task.by_item else function, name in force)

        for level in project.plan(targets):
            with ThreadPoolExecutor(self.jobs) as pool:
                for name, result in pool.map(work, level):
                    done[name] = result
                    for output, identity in result.outputs.items():
                        frames[f"{name}.{output}"], ids[f"{name}.{output}"] = self.read(result.stored, output), identity
        return done


@dataclass(frozen=True)
class ItemWork:
    """Work that can leave out items done before; called with whether it must not."""

    each: Callable[[bool], dict[str, DataFrame]]

    def __call__(self, fresh: bool = False) -> dict[str, DataFrame]:
        return self.each(fresh)


class ItemCache:
    """Results of a task by item key and content, appended below a folder as lots of items are done."""

    def __init__(self, spark: SparkSession, where: str, per_lot: int = 1_000_000):
        self.spark, self.where, self.per_lot = spark, where, max(per_lot, 1)
        self.hits = self.misses = 0

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.where)
        except AnalysisException:  # nothing yet
            return None

    def map(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], fresh: bool = False) -> DataFrame:
        """key, value, result of items (key, value); work gets key and value of those not done before, and returns key and result.

        Keys must be there and not repeat. Of several results of an item the newest counts; fresh
        takes this run's only. Items that work gives no result for have no row.
        """
        if not items.groupBy("key").count().where("count > 1 or key is null").isEmpty():
            raise ValueError("item keys repeat or are null")
        run, kind = f"{time.time_ns():020d}", items.schema["value"].dataType
        items = written(items.select("key", "value", row_name([(F.col("value"), kind)]).alias("item")))
        stored = None if fresh else self._stored()
        missed = items if stored is None else written(items.join(stored.select("key", "item").distinct(), ["key", "item"], "left_anti"))
        self.misses = missed.count()
        self.hits = items.count() - self.misses
        lots = max(1, math.ceil(self.misses / self.per_lot))
        for lot in range(lots) if self.misses else ():
            part = missed.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == lot)
            part.select("key", "item").join(work(part.select("key", "value")), "key").select("key", "item", "result", F.lit(run).alias("run")).write.mode("append").parquet(self.where)
        stored = self._stored()
        if stored is None:  # no item at all: as many rows, of the type that work gives
            return items.select("key", "value").join(work(items.select("key", "value")), "key").select("key", "value", "result")
        own = (stored.where(F.col("run") == run) if fresh else stored).groupBy("key", "item").agg(F.max_by(F.struct("result"), "run").alias("r"))
        return items.join(own, ["key", "item"]).select("key", "value", "r.result")


def toml_string(text: str) -> str:
    """A basic string: JSON's escapes are TOML's too, but for U+007F."""
    return json.dumps(text, ensure_ascii=False).replace("\x7f", "\\u007f")


@dataclass
class Lock:
    """Locked sources: name, requirement hash, artifact."""

    sources: dict[str, tuple[str, str]] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Lock:
        raw = tomllib.loads(text) if text.strip() else {"version": 3}
        if raw.get("version") != 3:
            raise ValueError("only lock version 3 is known")
        return Lock({s["name"]: (s["requirement_hash"], s["artifact"]) for s in raw.get("sources", [])})

    def dump(self) -> str:
        out = ["version = 3"]
        for name in sorted(self.sources):
            h, a = self.sources[name]
            out += ["", "[[sources]]", *(f"{k} = {toml_string(v)}" for k, v in (("name", name), ("requirement_hash", h), ("artifact", a)))]
        return "\n".join(out) + "\n"

    def check(self, name: str, source: dict, present: Callable[[str], bool]) -> str:
        wanted = requirement_hash(source.get("ref", ""), list(source.get("include", [])), list(source.get("exclude", [])))
        if name not in self.sources or self.sources[name][0] != wanted:
            return "frozen_mismatch"
        return "ok" if present(self.sources[name][1]) else "locked_missing"
