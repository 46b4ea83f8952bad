"""Rows within files as stream offsets (SRC-7): a stream over JSON-lines
shards that stops and goes on inside a file.

An offset is (file, byte) in the order of the files' names. Each trigger takes
at most ``max_bytes`` from there, cut into ranges for the tasks; a line belongs
to the range in which it begins, so no range needs another's. The driver
lists names and sizes and reads no line. New files must have names after the
old ones, and files must not change once they are listed."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that a task reads, about, and bytes read at once.
SPLIT, STEP = 8 << 20, 1 << 20


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int) -> None:
        self.file, self.start, self.stop = file, start, stop


def lines_of(path: str, start: int, stop: int, step: int = STEP) -> Iterator[bytes]:
    """Lines of a file that begin in [start, stop); the last may end beyond it,
    and the last of the file may lack its line feed."""
    from pyarrow import fs
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        at = start
        if start:   # what comes before the first line feed belongs to the range before
            at = start - 1
            while True:
                data = f.read_at(step, at)
                k = data.find(b"\n")
                if k >= 0 or not data:
                    at += k + 1
                    break
                at += len(data)
        held, begun = b"", at
        while begun < stop:
            data = f.read_at(step, at)
            if not data:
                if held:
                    yield held
                return
            at += len(data)
            *full, held = (held + data).split(b"\n")
            for line in full:
                if begun >= stop:
                    return
                yield line
                begun += len(line) + 1


class JsonlReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.max_bytes, self.split = int(options.get("maxbytespertrigger", 1 << 30)), int(options.get("splitbytes", SPLIT))
        self.at: tuple[str, int] | None = None   # where the last batch ended

    def listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted((f.path[len(base):].lstrip("/"), f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))

    def ranges(self, start: tuple[str, int], stop: tuple[str, int]) -> Iterator[tuple[str, int, int]]:
        for name, size in self.listed():
            a = start[1] if name == start[0] else 0 if name > start[0] else size
            z = stop[1] if name == stop[0] else size if name < stop[0] else 0
            if a < min(z, size):
                yield name, a, min(z, size)

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        """At most ``max_bytes`` beyond the last offset."""
        start, left = self.at or ("", 0), self.max_bytes
        end = start
        for name, size in self.listed():
            a = start[1] if name == start[0] else 0
            if name < start[0] or a >= size or left <= 0:
                continue
            end = (name, min(size, a + left))
            left -= size - a
        self.at = end
        return {"file": end[0], "byte": end[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        first, last = (start["file"], start["byte"]), (end["file"], end["byte"])
        self.at = max(self.at or ("", 0), last)   # a restarted query begins where it stopped
        return [Range(name, x, min(x + self.split, z)) for name, a, z in self.ranges(first, last) for x in range(a, z, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[str] = []
        for line in lines_of(f"{self.path}/{partition.file}", partition.start, partition.stop):
            if line.strip():
                rows.append(line.decode("utf-8", "replace"))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    def commit(self, end: dict) -> None:
        pass


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_rows"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> JsonlReader:
        return JsonlReader({k.lower(): v for k, v in self.options.items()})


def jsonl_stream(spark: SparkSession, directory: str, schema: str, max_bytes: int = 1 << 30, split_bytes: int = SPLIT) -> DataFrame:
    """SRC-7: the rows of a folder of JSON-lines files as a stream that takes
    at most ``max_bytes`` a trigger, also from the middle of a file."""
    spark.dataSource.register(JsonLines)
    raw = spark.readStream.format("jsonl_rows").option("path", directory).option("maxBytesPerTrigger", str(max_bytes)).option("splitBytes", str(split_bytes)).load()
    return raw.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def run_to_end(df: DataFrame, sink, checkpoint: str, batches: int | None = None) -> int:
    """Run micro-batches until nothing is left (or ``batches`` of them), then
    stop; returns how many had rows. Goes on where ``checkpoint`` says."""
    done = [0]

    def each(batch: DataFrame, epoch: int) -> None:
        sink(batch, epoch)
        done[0] += 1

    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    try:
        if batches is None:
            q.processAllAvailable()
        else:
            while q.isActive and done[0] < batches:
                time.sleep(0.05)
    finally:
        q.stop()
    return done[0]
