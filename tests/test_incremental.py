"""A refreshed analysis equals a full one and scores only what changed; runs
log what they did."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanalign.analysis import analyze, run_analysis
from spanalign.operators.incremental import refresh, stats_of, totals
from spanalign.operators.scores import doc_scores_covering, group_stats, rank_speed
from spanalign.operators.series import run_summary
from spanalign.operators.spans import chunk_pieces
from spanalign.sources.runlog import StreamLog, measured, read_log
from spanalign.streaming.stream import corpus_stream


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, grp string, text string")


def score(docs):
    return doc_scores_covering(docs, chunk_pieces("text", 8))


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_refresh(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["word", "été", "a", "longer_word"]) for _ in range(rng.randint(0, 60)))
    now = {i: (rng.choice(["g", "h", None]), text()) for i in range(60)}
    now[60], now[61] = ("g", None), ("gone", "the only one of its group")
    last, seen = None, []

    def counted(docs):
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        return score(docs)

    for step in range(4):
        if step == 1:
            now[3], now[5], now[100], now[60] = ("g", "changed text"), ("other", now[5][1]), ("h", text()), ("g", "")
            del now[7], now[61]
        if step == 3:
            now = {}
        docs = corpus(spark, [(i, g, t) for i, (g, t) in now.items()])
        last = refresh(docs, counted, last)
        full = score(docs)
        assert rows(last.group_stats) == rows(stats_of(totals(full)))
        want = group_stats(full).select("grp", "file_count", "avg_score", "total_rules", "total_aligned", "total_code_size", "total_bytes", "overall_alignment")
        assert rows(last.group_stats) == rows(want)
        assert rows(last.state.select(*full.columns)) == rows(full)
        made = {r.doc_id: r.change for r in last.changes.collect()}
        if step == 1:
            assert made == {3: "changed", 5: "changed", 60: "changed", 100: "added", 7: "removed", 61: "removed"} and seen[-1] == [3, 5, 60, 100]
        if step == 2:
            assert made == {} and seen[-1] == []
    assert len(seen[0]) == 62 and last.state.count() == 0 and last.group_stats.count() == 0


def test_runs_are_measured(spark, tmp_path):
    docs = corpus(spark, [(i, "g", "some words in a text " * i) for i in range(1, 30)])
    log = str(tmp_path / "log")
    out, row = run_analysis(docs, str(tmp_path / "out"), log, "run-1", rules=8)
    full = analyze(docs, 8).doc_scores
    assert rows(out) == rows(full) and row["status"] == "ok" and row["seconds"] > 0
    run_analysis(docs.limit(0), str(tmp_path / "none"), log, "run-2", rules=8)

    def bad(x):
        x.select(F.raise_error(F.lit("broken"))).write.format("noop").mode("overwrite").save()

    with pytest.raises(Exception, match="broken"):
        measured(full, bad, log, "run-3")
    got = {r.run_id: r for r in read_log(spark, log).collect()}
    assert {k: r.status for k, r in got.items()} == {"run-1": "ok", "run-2": "empty", "run-3": "failed"} and "broken" in got["run-3"].error
    want = full.agg(F.count("*"), F.sum("n_chars"), F.sum("n_bytes"), F.sum("n_distinct_rules"), F.sum("n_distinct_aligned")).first()
    assert tuple(got["run-1"][c] for c in ("n", "n_chars", "n_bytes", "total_rules", "total_aligned")) == tuple(want)
    assert abs(got["run-1"].speed * got["run-1"].seconds - want[1]) < 1
    summary = run_summary(read_log(spark, log).withColumn("run", F.lit("all"))).first()
    assert (summary.n_success, summary.n_failure, summary.n_total) == (1, 2, 3)
    ranks = rank_speed(read_log(spark, log).filter("status = 'ok'"), by="run_id", size="n_chars", seconds="seconds").collect()
    assert [(r.run_id, r["rank"]) for r in ranks] == [("run-1", 1)]


def test_streams_are_logged(spark, tmp_path):
    for k in range(3):
        corpus(spark, [(10 * k + i, "g", "x y z") for i in range(4)]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = corpus_stream(spark, str(tmp_path / "in" / "*"), "doc_id long, grp string, text string", max_files_per_trigger=1)
    log = str(tmp_path / "log")
    listener = StreamLog(spark, log, {"logged-stream"})
    spark.streams.addListener(listener)
    try:
        q = src.writeStream.queryName("logged-stream").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):   # the listener runs beside the query
            try:
                if read_log(spark, log).count() == 3:
                    break
            except Exception:
                pass
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted((r.run_id, r.status, r.n) for r in read_log(spark, log).collect()) == [(f"logged-stream/{k}", "ok", 4) for k in range(3)]
