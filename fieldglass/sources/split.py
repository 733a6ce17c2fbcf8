"""Scan documents larger than a task: one row a device, from byte ranges of the files.

A range is looked at without what stands before it. Its effect on each state that it may begin in (outside of a string,
in one, in one after a backslash) is a state and a change of depth, and effects compose; so the effects of the ranges
before give each range the state and depth that it begins in. Then ranges report where values open and close at the
depth of sections and of devices, the n-th opening belongs to the n-th closing, and each device's bytes are read by
themselves. A range holds its bytes, a device its own; nothing holds a document.

Files are read through Arrow's file systems. A document that isn't one object has no devices; a file without any gives
no rows. Names and devices are as in the file, repeated names too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_table
from ..operators.order import numbered
from .committed import opened

#: Bytes of a range, and bytes read at a time in search of a name.
RANGE, NAME = 32 << 20, 1 << 12
OUT, IN, ESCAPED = range(3)
OPEN, CLOSE, QUOTE, SLASH = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8), ord('"'), ord("\\")


def read(path: str, start: int, end: int) -> bytes:
    files, place = opened(path)
    with files.open_input_file(place) as file:
        file.seek(start)
        return file.read(end - start)


def looked_at(data: bytes, state: int) -> tuple[np.ndarray, int]:
    """The change of depth at each byte, for a range that begins in `state`, and the state at its end."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.zeros(0, np.int8), state
    slash = x == SLASH
    # A byte is escaped if the run of backslashes before it has an odd length.
    at = np.arange(len(x))
    run = at - np.maximum.accumulate(np.where(slash, -1, at))  # backslashes up to and with each byte, if none before is cut off
    run = np.where(slash & (np.maximum.accumulate(np.where(slash, -1, at)) < 0), at + 1 + (state == ESCAPED), run)
    before = np.concatenate(([1 if state == ESCAPED else 0], run[:-1] * slash[:-1]))
    escaped = before % 2 == 1
    quote = (x == QUOTE) & ~escaped
    inside = (np.cumsum(quote) + (state != OUT)) % 2 == 1
    change = np.where(inside, 0, np.isin(x, OPEN).astype(np.int8) - np.isin(x, CLOSE).astype(np.int8)).astype(np.int8)
    last = inside[-1]
    return change, (ESCAPED if slash[-1] and not escaped[-1] else IN) if last else OUT


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, start, end) of the byte ranges of every *.json of a folder; only names and lengths come to the driver."""
    files, folder = opened(path)
    scheme = path[: len(path.rstrip("/")) - len(folder)] if path.rstrip("/").endswith(folder) else ""
    found = [(f"{scheme}{x.path}", x.size) for x in files.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File and x.path.endswith(".json")]
    listed = spark.createDataFrame(found, "file string, size bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size)))
    cut = listed.select("file", "size", starts.alias("start")).select("file", "start", F.least(F.col("start") + size, F.col("size")).alias("end"))
    return cut.repartition(max(1, len(found)), "file", "start")


def effects(cut: DataFrame) -> DataFrame:
    """Ranges with their effect: for each state that they may begin in, the state at the end and the change of depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                data = read(file, start, end)
                found = [looked_at(data, s) for s in (OUT, IN, ESCAPED)]
                out.append(([s for _, s in found], [int(c.sum(dtype=np.int64)) for c, _ in found]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["file", "start", "end", "states", "depths"])

    return cut.mapInArrow(run, "file string, start bigint, end bigint, states array<int>, depths array<bigint>")


def entered(effects_: DataFrame) -> DataFrame:
    """Ranges with the state and depth that they begin in: effects composed in order, one small row a range."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "states", "depths")))
    first = F.struct(F.lit(OUT).alias("state"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<start:bigint,end:bigint,state:int,depth:bigint>>").alias("done"))
    step = lambda a, r: F.struct(
        r["states"][a["state"]].alias("state"), (a["depth"] + r["depths"][a["state"]]).alias("depth"),
        F.concat(a["done"], F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"), a["state"].alias("state"), a["depth"].alias("depth")))).alias("done"),
    )
    done = effects_.groupBy("file").agg(F.aggregate(ordered, first, step, lambda a: a["done"]).alias("r"))
    return done.select("file", F.explode("r").alias("r")).select("file", "r.*")


def brackets(begun: DataFrame) -> DataFrame:
    """(file, at, depth, opens): where values open to depth 2 (sections) and 3 (devices), and where they close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end, state, depth in zip(*(c.to_pylist() for c in batch.columns)):
                change, _ = looked_at(read(file, start, end), state)
                where = np.flatnonzero(change)
                after = np.cumsum(change[where].astype(np.int64)) + depth
                opens = change[where] > 0
                level = np.where(opens, after, after + 1)
                keep = (level == 2) | (level == 3)
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(where[keep] + start), pa.array(level[keep].astype(np.int32)), pa.array(opens[keep])], names=["file", "at", "depth", "opens"])

    return begun.mapInArrow(run, "file string, at bigint, depth int, opens boolean")


def name_before(file: str, at: int) -> tuple[str | None, int]:
    """The name of the value that opens at `at`, and where the name begins; none for an element of a list."""
    size = NAME
    while True:
        start = max(0, at - size)
        data = read(file, start, at).rstrip()
        if not data.endswith(b":"):
            return None, at
        data = data[:-1].rstrip()
        place = len(data) - 1
        while True:  # the quote that opens the name has an even run of backslashes before it
            place = data.rfind(b'"', 0, place)
            if place < 0:
                break
            if (place - len(data[:place].rstrip(b"\\"))) % 2 == 0:
                return json.loads(data[place:]), start + place
        if start == 0:
            return None, at
        size *= 2


def devices(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, device_ord, name, device): the text of every device of every document of a folder."""
    found = shared_table(brackets(entered(effects(ranges(spark, path, size)))))
    spans = lambda depth: (  # noqa: E731  the n-th opening belongs to the n-th closing
        numbered(found.where(f"depth = {depth} AND opens").select("file", F.col("at").alias("begin")), ["file"], ["begin"])
        .join(numbered(found.where(f"depth = {depth} AND NOT opens").select("file", F.col("at").alias("end")), ["file"], ["end"]), ["file", "at"])
    )

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [name_before(f, b)[0] for f, b in zip(batch.column("file").to_pylist(), batch.column("begin").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "name"])

    section = spans(2).select("file", "begin", "end").mapInArrow(named, "file string, begin bigint, end bigint, name string")
    # Of a repeated name the last section counts; there is one a file, at most.
    section = section.where("name = 'devices'").groupBy("file").agg(F.max_by(F.struct("begin", "end"), "begin").alias("s"))
    inside = spans(3).join(section, "file").where((F.col("begin") > F.col("s.begin")) & (F.col("end") < F.col("s.end"))).select("file", "begin", "end")
    order = numbered(inside, ["file"], ["begin"], "device_ord")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin, end, n in zip(*(c.to_pylist() for c in batch.columns)):
                name, _ = name_before(file, begin)
                text = read(file, begin, end + 1).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64()), pa.array([name], pa.string()), pa.array([text])], names=["file", "device_ord", "name", "device"])

    return order.select("file", "begin", "end", "device_ord").mapInArrow(texts, "file string, device_ord bigint, name string, device string").where("name IS NOT NULL")
