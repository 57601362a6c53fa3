"""History as tables that move on together: rows of several tables become visible by one append.

Each table is a Parquet folder whose rows carry the id of their commit. A commit writes its rows first and
its id to the log last, with a single file; what is not in the log is not there. Compaction is a
commit too: it rewrites what a table shows, and its log row names the commits that it takes the place of.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import last_wins

LOG = "commit_id string, at timestamp, tables array<string>, replaces array<struct<table:string,commit_id:string>>"


class HistoryLog:
    """Tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/tables/{table}"

    def stage(self, commit_id: str, tables: dict[str, DataFrame]) -> None:
        """Writes rows that nobody sees yet."""
        for name, rows in tables.items():
            rows.withColumn("commit_id", F.lit(commit_id)).write.mode("append").parquet(self._path(name))

    def publish(self, commit_id: str, tables: list[str], replaces: list[tuple[str, str]] = ()) -> None:
        row = (commit_id, datetime.now(timezone.utc), tables, list(replaces))
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def commit(self, **tables: DataFrame) -> str:
        """Adds rows to tables; readers see all of them or none."""
        commit_id = uuid.uuid4().hex
        self.stage(commit_id, tables)
        self.publish(commit_id, sorted(tables))
        return commit_id

    def log(self) -> DataFrame:
        """commit_id, at, tables, replaces of all commits."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except AnalysisException:  # nothing yet
            return self.spark.createDataFrame([], LOG)

    def live(self, table: str) -> DataFrame:
        """commit_id of the commits whose rows a table shows."""
        log = self.log()
        replaced = log.select(F.explode("replaces").alias("r")).where(F.col("r.table") == table).select("r.commit_id")
        return log.where(F.array_contains("tables", table)).select("commit_id").join(replaced, "commit_id", "left_anti")

    def table(self, name: str) -> DataFrame | None:
        """Rows of all commits but those that were replaced; None where no commit wrote the table."""
        try:
            rows = self.spark.read.option("mergeSchema", "true").parquet(self._path(name))
        except AnalysisException:
            return None
        return rows.join(self.live(name), "commit_id", "left_semi").drop("commit_id")

    def newest(self, name: str, keys: list[str], order: list[str]) -> DataFrame | None:
        """Of each key the row that is last in order, such as an attempt's last state."""
        rows = self.table(name)
        return rows and last_wins(rows, keys, order)

    def compact(self, name: str, keys: list[str] | None = None, order: list[str] | None = None, files: int = 1) -> str | None:
        """Rewrites a table's rows (with keys, each key's last only) into few files; None if there is nothing to do.

        A reader sees the old rows until the log names the new ones. Rows that a commit adds meanwhile stay.
        """
        old = [r[0] for r in self.live(name).collect()]  # a row for each commit since the last compaction
        if len(old) < 2:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(self._path(name)).where(F.col("commit_id").isin(old)).drop("commit_id")
        commit_id = uuid.uuid4().hex
        # a shuffle between: coalesced, as few tasks as files would also group and sort all rows
        self.stage(commit_id, {name: (last_wins(rows, keys, order) if keys else rows).repartition(files)})
        self.publish(commit_id, [name], [(name, c) for c in old])
        return commit_id

