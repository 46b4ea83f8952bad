"""Plans over reports in one commit, nested reports read in ranges (SNK-1,
SRC-8) and rows within files as stream offsets (SRC-7, STR-2)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanalign.operators.inrow import chunk_details
from spanalign.operators.scores import unaligned_list
from spanalign.plans.catalog import SQL_CHUNKS, SQL_DOC_SCORES, SQL_DOCS, r6, register, sql_group_stats
from spanalign.plans.common import CHUNK, docs
from spanalign.plans.queries_align import SQL_DETAIL
from spanalign.plans.queries_core import chunk_doc_scores
from spanalign.session import scratch_path, written
from spanalign.sources.report_store import TASK, commit_report, read_committed, read_nested_files
from spanalign.sources.tables import spread
from spanalign.streaming.jsonl import jsonl_stream, run_to_end
from spanalign.streaming.stream import flush_parts_sink


def _failing(spark, sf):
    return unaligned_list(chunk_details(spread(docs(spark, sf)), CHUNK, "pretok", failing_only=True))


SQL_FILES = SQL_DETAIL + f""",
{SQL_CHUNKS}, {SQL_DOC_SCORES},
ul AS (SELECT doc_id, count(*) AS n_unaligned, arg_min(type || '_' || s || '_' || e, s) AS first_rule_key FROM det WHERE ms OR me GROUP BY doc_id)"""


@register("report_committed", SQL_FILES + f""", {sql_group_stats(True)}
SELECT grp, dss.doc_id, round(dss.score, 6) AS score, n_distinct_rules, CAST(coalesce(n_unaligned, 0) AS BIGINT) AS n_unaligned, first_rule_key, gs.file_count, CAST((SELECT count(*) FROM dss) AS BIGINT) AS total_files
FROM dss LEFT JOIN ul ON ul.doc_id = dss.doc_id JOIN gs USING (grp)""")
def report_committed_q(spark, sf):
    """SNK-1: two commits of a scheme and one of another; the tables of the
    first scheme's last commit joined."""
    path = scratch_path(spark, f"committed-{uuid.uuid4().hex}")
    scores = chunk_doc_scores(spark, sf)
    commit_report(scores.limit(5), path, "chunks")
    commit_report(scores.limit(3), path, "other")
    commit_report(scores, path, "chunks", _failing(spark, sf), elapsed=1.0)
    read = lambda table, schema=None: read_committed(spark, path, table, "chunks", schema).drop("scheme")
    columns = scores.select("grp", "doc_id", "score", "n_distinct_rules", F.lit(None).cast("array<struct<rule_key:string>>").alias("unaligned_rules")).schema
    rules = F.coalesce(F.size("unaligned_rules"), F.lit(0))
    files = read("files", columns).select("grp", "doc_id", "score", "n_distinct_rules", F.greatest(rules, F.lit(0)).cast("bigint").alias("n_unaligned"), F.get("unaligned_rules", 0)["rule_key"].alias("first_rule_key"), F.lit(1).alias("_k"))
    total = read("summary").select("summary.total_files", F.lit(1).alias("_k"))
    return r6(files.join(read("languages").select("grp", "file_count"), "grp").join(total, "_k").drop("_k"))


def _nested(spark, sf) -> str:
    """Stand-in report of another tool: one nested document, in a folder of
    part files that make it up one after the other."""
    files = chunk_doc_scores(spark, sf).join(_failing(spark, sf), "doc_id", "left")
    item = F.struct(F.col("doc_id").cast("string").alias("file"), "score", F.col("n_distinct_rules").alias("total_rules"), F.col("n_distinct_aligned").alias("aligned_rules"), "unaligned_rules", "is_perfect")
    key = F.when(F.col("grp").isNull(), F.raise_error(F.lit("a language without a name"))).otherwise(F.col("grp")).alias("grp")
    items = written(files.select(key, F.to_json(item).alias("value"), F.monotonically_increasing_id().alias("i")), "items")
    langs = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))   # a row per language
    at = lambda part, inner: [F.lit(part).alias("part"), F.lit(inner).alias("inner")]
    # a name in JSON: the key of a map of one entry
    name = F.regexp_replace(F.to_json(F.create_map("grp", F.lit(0))), r"^\{(?s:(.*)):0\}$", "$1")
    comma = lambda first: F.when(first, "").otherwise(",")
    rank = F.row_number().over(Window.orderBy("grp"))
    head = langs.select(*at(1, 0), "grp", F.lit(0).cast("long").alias("i"), F.concat(comma(rank == 1), name, F.lit(':{"file_count":'), F.col("n").cast("string"), F.lit(',"files":[')).alias("value"))
    body = items.join(F.broadcast(langs.select("grp", "first")), "grp").select(*at(1, 1), "grp", "i", F.concat(comma(F.col("i") == F.col("first")), "value").alias("value"))
    tail = langs.select(*at(1, 2), "grp", F.lit(0).cast("long").alias("i"), F.lit("]}").alias("value"))
    ends = spark.createDataFrame([(0, 0, "", 0, '{"model":"chunks {64}","languages":{'), (2, 0, "", 0, "}}")], "part int, inner int, grp string, i long, value string")
    path = scratch_path(spark, f"nested-{uuid.uuid4().hex}")
    head.unionByName(body).unionByName(tail).unionByName(ends).orderBy("part", "grp", "inner", "i").select("value").write.text(path)
    return path


@register("nested_report_files", SQL_FILES + """
SELECT grp AS language, CAST(dss.doc_id AS VARCHAR) AS file, round(dss.score, 6) AS score, n_distinct_rules AS total_rules, n_distinct_aligned AS aligned_rules,
  CAST(coalesce(n_unaligned, 0) AS BIGINT) AS n_unaligned, first_rule_key FROM dss LEFT JOIN ul ON ul.doc_id = dss.doc_id""")
def nested_report_files_q(spark, sf):
    """SRC-8: files and failing rules of a nested document, read in ranges of
    64 KB."""
    schema = "file string, score double, total_rules long, aligned_rules long, unaligned_rules array<struct<rule_key:string,text_preview:string>>, is_perfect boolean"
    f = read_nested_files(spark, _nested(spark, sf), schema, 1 << 16, TASK)
    n = F.greatest(F.coalesce(F.size("unaligned_rules"), F.lit(0)), F.lit(0))
    return r6(f.select("language", "file", "score", "total_rules", "aligned_rules", n.cast("bigint").alias("n_unaligned"), F.get("unaligned_rules", 0)["rule_key"].alias("first_rule_key")))


#: Text bytes of a shard, about; three shards at least.
SHARD = 32 << 20


@register("stream_jsonl_parts", f"""WITH {SQL_DOCS}, x AS (SELECT grp, floor((row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1) / 40) + 1 AS part FROM d)
SELECT grp, CAST(part AS INTEGER) AS part, count(*) AS file_count, true AS several_batches FROM x GROUP BY 1, 2""")
def stream_jsonl_parts_q(spark, sf):
    """SRC-7, STR-2: a stream over JSON-lines shards whose offsets lie inside
    files; parts of 40 documents over several micro-batches."""
    base = scratch_path(spark, f"jsonl-{uuid.uuid4().hex}")
    rows = docs(spark, sf).select("doc_id", "grp", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows.repartition(max(3, -(-size // SHARD))).write.json(f"{base}/in")
    s = jsonl_stream(spark, f"{base}/in", "doc_id long, grp string, text string", max_bytes=max(1, size // 5))
    run_to_end(s.select("doc_id", "grp"), flush_parts_sink(f"{base}/out", f"{base}/state", 40), f"{base}/ck")
    out = spark.read.parquet(f"{base}/out")
    batches = out.agg((F.count_distinct("epoch") > 2).alias("several_batches"), F.lit(1).alias("_k"))
    return out.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("file_count"), F.lit(1).alias("_k")).join(batches, "_k").drop("_k")
