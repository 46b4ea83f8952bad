"""Streaming plans: the documents table replayed as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.operators.clean import drop_blank
from spanalign.operators.spans import chunk_pieces
from spanalign.plans.catalog import (GS_COLS, SQL_CHUNKS, SQL_DOC_SCORES, SQL_DOCS, r6, register, sql_group_stats)
from spanalign.plans.common import CHUNK
from spanalign.session import scratch_path
from spanalign.streaming.stream import (overwrite_sink, run_available, stream_doc_scores, stream_group_stats,
                                        stream_limit, table_stream)
from spanalign.sources.tables import read_table


def _doc_stream(spark, sf):
    # all files of the table in one trigger, as when it is one file: STR-2 then numbers the documents in doc_id order
    schema = read_table(spark, sf, "documents").schema
    s = table_stream(spark, f"{sf.rstrip('/')}/documents.parquet", schema)
    d = s.select("doc_id", F.col("lang").alias("grp"), "text")
    return drop_blank(d)


@register("stream_group_stats", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)}
SELECT {GS_COLS} FROM gs""")
def stream_group_stats_q(spark, sf):
    """STR-1: running per-language totals of a document stream; the final
    state equals the batch group_stats."""
    import uuid
    st = stream_group_stats(stream_doc_scores(_doc_stream(spark, sf), chunk_pieces("text", CHUNK)))
    out = scratch_path(spark, f"stream-group-stats-{uuid.uuid4().hex}")
    run_available(st, overwrite_sink(out), mode="complete", name="group-stats")
    return r6(spark.read.parquet(out))


ORACLE_PARTS = f"""WITH {SQL_DOCS}, x AS (SELECT grp, floor((row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1) / 40) + 1 AS part FROM d)
SELECT grp, CAST(part AS INTEGER) AS part, count(*) AS file_count FROM x GROUP BY 1, 2"""


def _flushed(spark, stream, every):
    import uuid
    from spanalign.streaming.stream import flush_parts_sink
    base = scratch_path(spark, f"stream-parts-{uuid.uuid4().hex}")
    run_available(stream.select("doc_id", "grp"), flush_parts_sink(f"{base}/out", f"{base}/state", every), mode="append", name="flush-parts")
    return spark.read.parquet(f"{base}/out")


@register("stream_flush_parts", f"""WITH {SQL_DOCS}, x AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS seq FROM d)
SELECT doc_id, grp, CAST(floor(seq / 40) + 1 AS INTEGER) AS part, CAST(seq AS BIGINT) AS seq FROM x""")
def stream_flush_parts_q(spark, sf):
    """STR-2: the part and number of every document of the stream, a part
    after every 40 documents of a language; the remainder is the last part."""
    return _flushed(spark, _doc_stream(spark, sf), 40).select("doc_id", "grp", "part", "seq")


@register("stream_flush_parts_distributed", ORACLE_PARTS)
def stream_flush_parts_distributed_q(spark, sf):
    """STR-2: files per part (per micro-batch distributed per-language
    numbering plus a per-language counter table kept per epoch)."""
    return _flushed(spark, _doc_stream(spark, sf), 40).groupBy("grp", "part").agg(F.count(F.lit(1)).alias("file_count"))


@register("stream_limit", f"""WITH {SQL_DOCS} SELECT count(*) AS n_rows FROM (SELECT 1 FROM d LIMIT 300)""")
def stream_limit_q(spark, sf):
    """STR-3: the stream stops after 300 accepted documents."""
    import uuid
    out = scratch_path(spark, f"stream-limit-{uuid.uuid4().hex}")
    run_available(stream_limit(_doc_stream(spark, sf).select("doc_id"), 300), out, mode="append", name="limit")
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n_rows"))
