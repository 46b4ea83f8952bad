"""Structured Streaming variants (SRC-7, STR-1..4).

Per-document scoring of covering spans is row-local, so it runs unchanged
on a stream; running totals per group are a stateful streaming aggregate;
flush parts number each micro-batch with the distributed per-group index; every query
keeps its progress in a checkpoint folder under ``spark.checkpoint.dir`` and
so resumes exactly once after a restart or a lost executor.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanalign.session import scratch_path


def corpus_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                  max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """SRC-7: files of a folder as a stream (a folder, not a single file,
    is the source; ``glob`` selects files inside it). ``table_stream`` reads a
    table that is one file or a folder of part files."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(directory)


def table_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """SRC-7: a table as a stream, be it a single file or a folder of part
    files. Without ``max_files_per_trigger`` a trigger takes all that is there."""
    # a pattern that matches this one name: the file source takes files and folders from a pattern, without one only folders
    return corpus_stream(spark, re.sub(r"(.)(/*)$", r"[\1]", path), schema, max_files_per_trigger=max_files_per_trigger, fmt=fmt)


def run_available(df: DataFrame, sink, checkpoint: str | None = None, mode: str = "append", name: str = "stream"):
    """Run a streaming query over everything available now, then stop.
    ``sink`` is a foreachBatch function or a folder for the parquet sink."""
    spark = df.sparkSession
    ck = checkpoint or scratch_path(spark, f"{name}-ckpt-{uuid.uuid4().hex}")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if callable(sink) else w.format("parquet").option("path", sink).start()
    q.awaitTermination()
    return ck


def stream_doc_scores(docs_stream: DataFrame, pieces_col) -> DataFrame:
    """Row-local per-document chunk scores of a corpus stream (stateless)."""
    from spanalign.operators.scores import doc_scores_covering
    return doc_scores_covering(docs_stream, pieces_col)


def stream_group_stats(scores_stream: DataFrame, by: str = "grp", include_perfect: bool = True) -> DataFrame:
    """STR-1: running totals per group (complete-mode streaming aggregate)."""
    from spanalign.operators.scores import group_stats
    return group_stats(scores_stream, by, include_perfect)


def overwrite_sink(path: str):
    """foreachBatch sink that replaces ``path`` with the batch (idempotent
    per epoch: a replayed epoch writes the same complete result again)."""
    def sink(batch: DataFrame, epoch_id: int):
        batch.write.mode("overwrite").parquet(path)
    return sink


def stream_limit(stream: DataFrame, n: int) -> DataFrame:
    """STR-3: stop after n accepted rows (streaming limit, append mode)."""
    return stream.limit(n)


def flush_parts_sink(out: str, state: str, every: int, group: str = "grp", order_by: str = "doc_id"):
    """STR-2, a part after every ``every`` documents of a group in arrival
    order, without a per-group task: a foreachBatch sink that numbers each
    micro-batch with the distributed per-group index (hot groups are spread
    by a range sort) and keeps the running count per group as a tiny table
    under ``state`` (one folder per epoch). A replayed epoch reads the
    counts of the epochs before it and overwrites its own output, so the
    result is exactly once."""
    from spanalign.operators.batching import with_index

    def sink(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        prev = _latest_counts(spark, state, epoch_id, group)
        x = with_index(batch.select(F.col(order_by).alias("doc_id"), F.col(group).alias("grp")), "doc_id", "grp")
        if prev is not None:   # one row per group: AQE broadcasts it; null is a group
            x = x.join(prev, F.col("grp").eqNullSafe(F.col("_grp")), "left").drop("_grp")
        else:
            x = x.withColumn("_seen", F.lit(0).cast("long"))
        seq = F.coalesce(F.col("_seen"), F.lit(0)) + F.col("idx")
        parts = x.select("doc_id", "grp", (F.floor(seq / every) + 1).cast("int").alias("part"), seq.alias("seq"))
        parts.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
        cnt = batch.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("_n"))
        both = cnt if prev is None else cnt.union(prev.select(F.col("_grp").alias("grp"), F.col("_seen").alias("_n")))
        new = both.groupBy("grp").agg(F.sum("_n").cast("long").alias("_seen"))
        new.write.mode("overwrite").parquet(f"{state}/epoch={epoch_id}")
    return sink


def _latest_counts(spark: SparkSession, state: str, epoch_id: int, group: str):
    """Counts after the newest epoch before ``epoch_id`` (None at start)."""
    try:
        table = spark.read.parquet(state)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":   # no epoch has been counted yet
            return None
        raise
    last = table.filter(F.col("epoch") < epoch_id).agg(F.max("epoch")).first()[0]
    if last is None:
        return None
    return spark.read.parquet(f"{state}/epoch={last}").select(F.col("grp").alias("_grp"), "_seen")
