"""Run logs that the engine measures itself (AGG-3, AGG-6, AGG-18): an
observed write counts the rows that pass through it, a clock runs around it,
and one row per run is appended to a log; streams append one per micro-batch.

What a run did is counted while it is done: no second pass over the data."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = ("run_id string, grp string, scheme string, status string, n long, n_chars long, n_bytes long, total_rules long, total_aligned long, "
          "seconds double, speed double, started timestamp, error string, output string")


def _row(**values) -> dict:
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    return {c: values.get(c) for c in names}


def append(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Append rows to the log; one small file each time."""
    spark.createDataFrame([tuple(_row(**r).values()) for r in rows], SCHEMA).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def measured(scores: DataFrame, write: Callable[[DataFrame], None], log: str, run_id: str, scheme: str | None = None,
             grp: str | None = None, output: str | None = None) -> dict:
    """Write document scores (AGG-1) by ``write`` and append the run's row:
    documents, sizes and rules as observed by the write itself, wall seconds
    and characters per second. A run that raises is logged as ``failed`` with
    its error, and raises."""
    spark = scores.sparkSession
    seen = Observation(run_id)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    x = scores.observe(seen, F.count(F.lit(1)).alias("n"), total("n_chars"), total("n_bytes"), total("n_distinct_rules"), total("n_distinct_aligned"))
    row = {"run_id": run_id, "grp": grp, "scheme": scheme, "output": output, "started": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)}
    begun = time.monotonic()
    try:
        write(x)
    except Exception as e:
        append(spark, log, [row | {"status": "failed", "seconds": time.monotonic() - begun, "error": f"{type(e).__name__}: {e}"[:500]}])
        raise
    seconds, got = time.monotonic() - begun, seen.get
    row |= {"status": "ok" if got["n_distinct_rules"] else "empty", "n": got["n"], "n_chars": got["n_chars"], "n_bytes": got["n_bytes"],
            "total_rules": got["n_distinct_rules"], "total_aligned": got["n_distinct_aligned"], "seconds": seconds, "speed": got["n_chars"] / max(seconds, 1e-9)}
    append(spark, log, [row])
    return row


class StreamLog(StreamingQueryListener):
    """Appends a row per micro-batch with input, and one when a query fails:
    run_id is ``<query name>/<batch>``, n its input rows, seconds its duration.
    Add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str, queries: set[str] | None = None) -> None:
        self.spark, self.path, self.queries, self.names = spark, path, queries, {}

    def _wanted(self, name: str | None) -> bool:
        return self.queries is None or name in self.queries

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows and self._wanted(p.name):
            spent = p.durationMs.get("triggerExecution", 0) / 1000
            append(self.spark, self.path, [{"run_id": f"{p.name or p.id}/{p.batchId}", "status": "ok", "n": p.numInputRows, "seconds": spent,
                                            "started": dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)}])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.get(str(event.id))
        if event.exception and self._wanted(name):
            append(self.spark, self.path, [{"run_id": f"{name or event.id}", "status": "failed", "error": json.dumps(event.exception)[:500]}])
