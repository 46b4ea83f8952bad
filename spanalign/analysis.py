"""One-call analysis runs: the reference's directory / dataset analysis
flow (corpus -> rules -> tokens -> per-rule test -> document scores ->
group statistics -> ranking -> summary) as one lazily built set of
DataFrames. Nothing is executed here; callers act on what they need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.operators.align import align_detail, nearest_token, token_cut
from spanalign.operators.scores import corpus_summary, doc_scores, doc_scores_covering, group_stats, rank_groups
from spanalign.operators.spans import chunk_pieces, chunk_spans, extract_spans, with_word_split
from spanalign.operators.tokens import tokens
from spanalign.sources.tables import by_doc

METRICS = ("word_split", "tolerance", "token_cut")


@dataclass
class Analysis:
    rule_flags: DataFrame      # one row per rule with fully_aligned
    doc_scores: DataFrame      # AGG-1
    group_stats: DataFrame     # AGG-3
    rankings: DataFrame        # AGG-5
    summary: DataFrame         # AGG-4


def _rules(docs: DataFrame, rules, border_chars: bool, keep=("grp",)) -> DataFrame:
    if isinstance(rules, DataFrame):
        return rules
    if isinstance(rules, int):
        return chunk_spans(docs, rules, keep=keep, border_chars=border_chars)
    if isinstance(rules, dict):
        return extract_spans(docs, rules, keep=keep, border_chars=border_chars)
    raise TypeError("rules: chunk size (int), {type: regex} or a span DataFrame")


def analyze(corpus: DataFrame, rules=64, metric: str = "word_split", scheme: str = "pretok", tol: int = 1,
            include_perfect: bool = True, by: str = "grp", partitioned: bool = False) -> Analysis:
    """Score every document of ``corpus`` (doc_id, grp, text).

    ``rules``: chunk size, a ``{type: regex}`` dict, or a span DataFrame
    (doc_id, type, span_id, s, e[, piece]). ``metric``: M1 ``word_split``,
    M2 ``tolerance`` (tokens of ``scheme``, ``tol`` bytes), or M3
    ``token_cut``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    docs = corpus if partitioned else by_doc(corpus)
    if metric == "word_split" and isinstance(rules, int):
        scores = doc_scores_covering(docs, chunk_pieces("text", rules), keep=(by,))
        flags = with_word_split(chunk_spans(docs, rules, keep=(by,), border_chars=True))
    else:
        own = not isinstance(rules, DataFrame)
        r = _rules(docs, rules, border_chars=(metric == "word_split" and own))
        if metric == "word_split":
            if own:
                flags = with_word_split(r)
            else:
                from spanalign.operators.align import rule_word_split
                from spanalign.operators.tokens import word_runs
                flags = rule_word_split(r, word_runs(docs, keep=(by,)), keep=(by,) if by in r.columns else ())
        elif metric == "tolerance":
            flags = nearest_token(r, tokens(docs, scheme, keep=(by,)), tol=tol, keep=(by,) if by in r.columns else (),
                                  covering=True)
        else:
            flags = token_cut(r, tokens(docs, scheme, keep=(by,)), keep=(by,) if by in r.columns else ()) \
                .withColumn("fully_aligned", F.col("uncut"))
        scores = doc_scores(flags, docs, keep=(by,))
    stats = group_stats(scores, by, include_perfect)
    return Analysis(flags, scores, stats, rank_groups(stats, by), corpus_summary(stats))


def run_analysis(corpus: DataFrame, out: str, log: str, run_id: str, rules=64, metric: str = "word_split", scheme: str = "pretok",
                 by: str = "grp", **how) -> tuple[DataFrame, dict]:
    """``analyze`` carried out and measured: document scores are written to
    ``out`` (Parquet) and the run's own row (documents, sizes, rules, seconds,
    speed, status) is appended to ``log``. Returns the written scores and the
    row; ``rank_speed`` and ``run_summary`` read the log."""
    from spanalign.sources.runlog import measured
    scores = analyze(corpus, rules, metric, scheme, by=by, **how).doc_scores
    row = measured(scores, lambda x: x.write.mode("overwrite").parquet(out), log, run_id, scheme=scheme, output=out)
    return corpus.sparkSession.read.schema(scores.schema).parquet(out), row


def analyze_detail(corpus: DataFrame, rules=64, scheme: str = "pretok", partitioned: bool = False,
                   by: str = "grp") -> DataFrame:
    """The reference's per-rule detail records (M1 with token context)."""
    docs = corpus if partitioned else by_doc(corpus)
    return align_detail(_rules(docs, rules, border_chars=True, keep=(by,)), None, tokens(docs, scheme, keep=(by,)),
                        keep=(by,))


def folder_runs(files: DataFrame, schemes, rules=64, tol: int = 1, run_id: str = "run",
                folder: str = "dir_prefix", skipped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """E3: the folder batch runner as ONE job. ``files`` is the corpus of
    ``code_output_dirs`` (doc_id, grp, text, dir_prefix); every scheme of the
    literal list is scored (M2, tolerance ``tol``) in the same pass, and
    statistics are grouped by (folder, language, scheme). Documents without
    any rule count as files with score 0. Returns (stats, run_log) - the run
    log holds one row per folder, language and scheme with status ``ok``, or
    ``empty`` when none of its documents has a rule, and a row with status
    ``skipped`` for each folder of ``skipped`` (of ``code_output_dirs``)."""
    from spanalign.operators.tokens import multi_scheme_tokens
    docs = by_doc(files.select("doc_id", "grp", "text", F.col(folder).alias("folder")))
    r = _rules(docs, rules, border_chars=False, keep=("grp", "folder"))
    toks = multi_scheme_tokens(docs, list(schemes), keep=("grp", "folder"))
    fl = nearest_token(r, toks, tol=tol, keep=("grp", "folder"), schemes=list(schemes), covering=True)
    # one marker row per document and scheme keeps documents without rules
    marks = docs.select("doc_id", "grp", "folder", F.explode(F.array(*[F.lit(s) for s in schemes])).alias("scheme"),
                        F.lit(None).cast("boolean").alias("fully_aligned"))
    every = marks.unionByName(fl.select("doc_id", "grp", "folder", "scheme", "fully_aligned"))
    per_doc = every.groupBy("doc_id", "grp", "folder", "scheme").agg(
        F.count("fully_aligned").alias("n"), F.count_if("fully_aligned").alias("a"))
    score = F.coalesce(F.try_divide(F.col("a") * 100.0, F.col("n").cast("double")), F.lit(0.0))
    stats = per_doc.groupBy("folder", "grp", "scheme").agg(
        F.count(F.lit(1)).alias("file_count"), F.avg(score).alias("avg_score"),
        F.sum("n").alias("total_rules"), F.sum("a").alias("total_aligned"))
    run_log = stats.select(F.lit(run_id).alias("run_id"), "folder", "grp", "scheme",
                           F.when(F.col("total_rules") > 0, "ok").otherwise("empty").alias("status"),
                           F.col("file_count").alias("n"))
    if skipped is not None:
        run_log = run_log.unionByName(skipped.select(F.lit(run_id).alias("run_id"), F.col(skipped.columns[0]).alias("folder"),
                                                     F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("n")), allowMissingColumns=True)
    return stats, run_log
