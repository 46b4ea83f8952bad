"""Report sinks and sources (SNK-1..4, SRC-8).

The reference writes one nested JSON document per run holding every file
and every failing rule. At corpus scale that document would pass through a
single task, so a report here is a folder of three linked JSON-lines
tables - ``summary`` (one row per run), ``languages`` (one row per group)
and ``files`` (one row per document, failing rules nested) - each written
in parallel and partitioned by scheme (the model name of the reference)."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A rule in a report's list of failing rules.
UNALIGNED = ("array<struct<rule_key:string,type:string,start_byte:long,end_byte:long,start_aligned:boolean,end_aligned:boolean,"
             "crossing_start:boolean,crossing_end:boolean,crossing_start_reason:string,crossing_end_reason:string,text_preview:string>>")


def _write(df: DataFrame, path: str, scheme: str, mode: str) -> None:
    """One folder per scheme; overwriting replaces this scheme's folder only.
    The schema is kept beside the rows, so that reading needs no inference."""
    df = df.withColumn("scheme", F.lit(scheme))
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("scheme").json(path))
    one = df.sparkSession.createDataFrame([(df.schema.json(), scheme)], "schema string, scheme string")
    one.coalesce(1).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("scheme").json(path + "_schema")


def _read(spark: SparkSession, path: str) -> DataFrame:
    kept = [T.StructType.fromJson(json.loads(r["schema"])) for r in
            spark.read.schema("schema string, scheme string").json(path + "_schema").select("schema").distinct().collect()]
    fields = {f.name: f for s in kept for f in s.fields}
    return spark.read.schema(T.StructType(list(fields.values()))).json(path)


def write_report(stats: DataFrame | None, scores: DataFrame, path: str, scheme: str,
                 unaligned: DataFrame | None = None, elapsed: float = 0.0, mode: str = "overwrite", by: str = "grp") -> None:
    """SNK-1: one report per scheme under ``path``. The scores are written
    first and, with ``stats=None``, group statistics come from what was
    written, so nothing is scored twice."""
    from spanalign.operators.scores import group_stats
    root = path.rstrip("/")
    now = _dt.datetime.now(_dt.timezone.utc).isoformat()
    files = scores
    if unaligned is not None:
        files = files.join(unaligned, "doc_id", "left")
    _write(files, f"{root}/files", scheme, mode)
    spark = scores.sparkSession
    mine = lambda name: _read(spark, f"{root}/{name}").filter(F.col("scheme") == scheme).drop("scheme")
    _write(group_stats(mine("files"), by) if stats is None else stats, f"{root}/languages", scheme, mode)
    summary = mine("languages").agg(
        F.count(F.lit(1)).alias("total_languages"), F.sum("file_count").alias("total_files"),
        F.sum("total_rules").alias("total_rules"), F.sum("total_aligned").alias("total_aligned"),
        F.sum("total_code_size").alias("total_code_size")).select(
        F.lit(now).alias("timestamp"), F.lit(float(elapsed)).alias("overall_analysis_time"),
        F.struct("total_languages", "total_files", "total_rules", "total_aligned", "total_code_size",
                 F.coalesce(F.try_divide(F.col("total_code_size").cast("double"), F.lit(float(elapsed))), F.lit(0.0)).alias("avg_processing_speed")).alias("summary"))
    _write(summary, f"{root}/summary", scheme, mode)


def read_report(spark: SparkSession, path: str):
    """SRC-8: the three tables of a report folder back as DataFrames."""
    root = path.rstrip("/")
    return tuple(_read(spark, f"{root}/{name}") for name in ("summary", "languages", "files"))


def read_nested_report(spark: SparkSession, path: str):
    """SRC-8 for a single nested document ``{model, timestamp,
    overall_analysis_time, summary, languages: {lang: {..., files: [...]}}}``:
    languages and files as rows, the files with their failing rules (the run's
    own row: ``read_nested_run``)."""
    lang = ("struct<file_count:long,avg_score:double,total_rules:long,total_aligned:long,overall_alignment:double,"
            "total_code_size:long,total_analysis_time:double,avg_processing_speed:double,"
            "files:array<struct<file:string,path:string,score:double,total_rules:long,aligned_rules:long,"
            f"unaligned_rules:{UNALIGNED},code_size:long,analysis_time:double,processing_speed:double,is_perfect:boolean>>>")
    doc = spark.read.schema(f"model string, languages map<string,{lang}>").option("multiLine", "true").json(path)
    lg = doc.select("model", F.explode("languages").alias("language", "l")).select("model", "language", "l.*")
    files = lg.select("model", "language", F.explode("files").alias("f")).select("model", "language", "f.*")
    return lg.drop("files"), files


def read_nested_run(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: model, timestamp, total time and summary of a nested document."""
    doc = spark.read.schema("model string, timestamp string, overall_analysis_time double, summary struct<total_languages:long,total_files:long,"
                            "total_rules:long,total_aligned:long,total_code_size:long,avg_processing_speed:double>").option("multiLine", "true").json(path)
    return doc.select("model", "timestamp", "overall_analysis_time", "summary.*")


def write_parts(parts_input: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2: rows carrying ``grp`` and ``part`` (from flush_parts or
    with_index) written one folder per language and part."""
    parts_input.write.mode(mode).partitionBy("grp", "part").json(path)


def write_run_index(run_log: DataFrame, path: str) -> None:
    """SNK-3: append this run's rows (run_id, grp, scheme, status, n,
    seconds, output path) to the run index."""
    run_log.write.mode("append").json(path)


def write_comparison_document(cmp_long: DataFrame, path: str, by: str = "grp", mode: str = "overwrite") -> None:
    """SNK-4: the nested comparison document ``{languages, models, data}`` as
    one JSON row (groups times schemes, a handful of each)."""
    from spanalign.operators.reports import comparison_document
    comparison_document(cmp_long, by).coalesce(1).write.mode(mode).json(path)


def write_comparison(cmp_long: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-4: the group x scheme comparison as one row per pair."""
    cmp_long.write.mode(mode).json(path)
