"""A stream that stops inside a file goes on there: nothing lost, nothing twice."""

import json
import random

import pytest

from spanalign.streaming.jsonl import JsonlReader, jsonl_stream, lines_of, run_to_end

SCHEMA = "doc_id long, text string"


@pytest.fixture
def shards(tmp_path):
    rng = random.Random(3)
    ids = iter(range(10_000))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, n in enumerate([50, 0, 1, 200]):
        lines = [json.dumps({"doc_id": next(ids), "text": "é" * rng.randint(0, 120)}, ensure_ascii=False) for _ in range(n)]
        if k == 2:
            lines[0] = json.dumps({"doc_id": next(ids), "text": "long " * 5000})
        (folder / f"part-{k}.json").write_text("\n".join(lines) + ("\n\n" if k == 0 else ""))
    (folder / "_SUCCESS").write_text("x")
    return folder


def collected(spark, out):
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_lines_belong_to_one_range(tmp_path, step):
    rng = random.Random(step)
    lines = ["x" * rng.randint(0, 30) for _ in range(60)]
    p = tmp_path / "f"
    p.write_text("\n".join(lines))
    size = p.stat().st_size
    for width in (1, 5, 40, size):
        got = [x.decode() for a in range(0, size, width) for x in lines_of(str(p), a, min(a + width, size), step)]
        assert got == lines[:-1] + ([lines[-1]] if lines[-1] else [])


def test_offsets_and_splits(shards):
    r = JsonlReader({"path": str(shards), "maxbytespertrigger": "1000", "splitbytes": "300"})
    at, seen = r.initialOffset(), []
    while (end := r.latestOffset()) != at:
        parts = r.partitions(at, end)
        assert sum(p.stop - p.start for p in parts) <= 1000 and all(p.stop - p.start <= 300 for p in parts)
        seen += [json.loads(v.as_py())["doc_id"] for p in parts for b in r.read(p) for v in b.column("value")]
        at = end
    assert sorted(seen) == sorted(set(seen)) and len(seen) == 251


def test_restart_inside_a_file(spark, shards, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = lambda: jsonl_stream(spark, str(shards), SCHEMA, max_bytes=3000, split_bytes=700)
    assert run_to_end(stream(), collected(spark, out), ck, batches=2) >= 2
    some = spark.read.parquet(out).count()
    assert 0 < some < 251
    assert run_to_end(stream(), collected(spark, out), ck) > 3
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("doc_id").distinct().count() == 251
    # a file that comes later is taken from its beginning
    (shards / "part-9.json").write_text('{"doc_id": 5000, "text": "late"}\n')
    run_to_end(stream(), collected(spark, out), ck)
    assert spark.read.parquet(out).count() == 252
