"""Re-analysis of a changed corpus (FLT-7, STR-4): only documents whose
content differs from the last state are scored again, and group totals are
kept by adding what is new and subtracting what is gone.

A state is one row per document: its scores and a hash of what they were
made from. Comparing two corpora joins ids and hashes; texts are read again
for added and changed documents alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanalign.session import written

KEY = "content_key"
#: What a group's totals are sums of; all of them can be subtracted exactly (scores in 2 ** -40ths).
SCALE = 1 << 40


def content_key(text: str = "text", group: str = "grp") -> Column:
    """128 bits of a document's text and group (a null is told from an empty
    text): what its scores depend on."""
    return F.md5(F.concat(F.to_json(F.struct(group)), F.lit("\n"), F.coalesce(F.concat(F.lit("t"), text), F.lit("null"))))


def changes(state: DataFrame | None, corpus: DataFrame, group: str = "grp") -> DataFrame:
    """``doc_id, change``: added, changed or removed documents of ``corpus``
    (doc_id, grp, text) against ``state`` (doc_id, content_key, ...). Ids must be
    unique and not null. No text is shuffled."""
    now = corpus.select("doc_id", content_key(group=group).alias("_now"))
    if state is None:
        return now.select("doc_id", F.lit("added").alias("change"))
    was = state.select("doc_id", F.col(KEY).alias("_was"))
    both = now.join(was, "doc_id", "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_was"), "changed")
    return both.select("doc_id", change.alias("change")).filter("change IS NOT NULL")


def totals(scores: DataFrame, by: str = "grp") -> DataFrame:
    """Additive totals per group of rows of a state."""
    part = F.round(F.col("score") * SCALE).cast("decimal(38,0)")
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("file_count"), F.sum(part).alias("score_parts"),
                                  F.sum("n_distinct_rules").alias("total_rules"), F.sum("n_distinct_aligned").alias("total_aligned"),
                                  F.sum("n_chars").alias("total_code_size"), F.sum("n_bytes").alias("total_bytes"))


def combined(first: DataFrame, *signed: tuple[int, DataFrame], by: str = "grp") -> DataFrame:
    """Totals plus or minus totals; groups without any file left are gone."""
    sums = [c for c in first.columns if c != by]
    rows = first
    for sign, other in signed:
        rows = rows.unionByName(other.select(by, *[(F.col(c) * sign).alias(c) for c in sums]))
    return rows.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums]).filter("file_count > 0")


def stats_of(sums: DataFrame, by: str = "grp") -> DataFrame:
    """AGG-3's group statistics from totals."""
    share = F.coalesce(F.try_divide(F.col("total_aligned") * 100.0, F.col("total_rules").cast("double")), F.lit(0.0))
    return sums.select(by, F.col("file_count").cast("long").alias("file_count"), (F.col("score_parts").cast("double") / F.lit(float(SCALE)) / F.col("file_count")).alias("avg_score"),
                       *[F.col(c).cast("long").alias(c) for c in ("total_rules", "total_aligned", "total_code_size", "total_bytes")], share.alias("overall_alignment"))


class Update:
    """The outcome of ``refresh``: ``state`` and ``totals`` to keep for the next
    time, and the ``changes`` that were made (all written to the shared folder)."""

    def __init__(self, state: DataFrame, sums: DataFrame, made: DataFrame, by: str) -> None:
        self.state, self.totals, self.changes, self.by = state, sums, made, by

    @property
    def group_stats(self) -> DataFrame:
        return stats_of(self.totals, self.by)


def refresh(corpus: DataFrame, score: Callable[[DataFrame], DataFrame], last: Update | None = None, by: str = "grp") -> Update:
    """Bring an analysis up to date: ``score`` (documents -> AGG-1's document
    scores with doc_id and ``by``) runs on added and changed documents only.

    The next state is the last one without removed and changed documents,
    plus the new scores; the next totals are the last ones minus the scores
    that are gone plus the new ones. The first time all documents are added."""
    made = written(changes(last.state if last else None, corpus, by), "changes")
    again = made.filter("change <> 'removed'").select("doc_id")
    some = corpus.join(again, "doc_id", "left_semi") if last else corpus
    keys = some.select("doc_id", content_key(group=by).alias(KEY))
    new = written(score(some).join(keys, "doc_id"), "scores")
    if last is None:
        return Update(new, written(totals(new, by), "totals"), made, by)
    gone = last.state.join(made.filter("change <> 'added'").select("doc_id"), "doc_id", "left_semi")
    kept = last.state.join(made.select("doc_id"), "doc_id", "left_anti")
    sums = combined(last.totals, (-1, totals(gone, by)), (1, totals(new, by)), by=by)
    return Update(written(kept.select(*new.columns).unionByName(new), "state"), written(sums, "totals"), made, by)
