"""Text lines numbered through, read by ranges of bytes: no task sees more than its range, and no order of splits is presumed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .bgzf import open_file


def owned(file, size: int, lo: int, hi: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The lines that start at bytes lo to hi: a range leaves out what the byte before it has begun."""
    at = max(lo - 1, 0)
    held, here = b"", at  # here: where held starts
    skip = lo > 0
    while True:
        cut = held.find(b"\n")
        if cut < 0:
            if at >= size:
                if held and not skip and here < hi:
                    yield held
                return
            more = file.read_at(min(step, size - at), at)
            held, at = held + more, at + len(more)
            continue
        if not skip:
            if here >= hi:
                return
            yield held[:cut]
        skip = False
        held, here = held[cut + 1 :], here + cut + 1
        # Lines that are whole already go in one split.
        last = held.rfind(b"\n")
        if last >= 0 and here + last < hi:
            yield from held[:last].split(b"\n")
            held, here = held[last + 1 :], here + last + 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("bytesPerPartition", 16 << 20))

    def partitions(self) -> list[InputPartition]:
        with open_file(self.path) as f:
            size = f.size()
        return [InputPartition((i, lo, min(size, lo + self.each))) for i, lo in enumerate(range(0, size, self.each))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        part, lo, hi = partition.value
        with open_file(self.path) as f:
            lines = [x for x in owned(f, f.size(), lo, hi) if x.strip()]
        for at in range(0, len(lines), 1 << 16):
            n = len(lines[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(lines[at : at + n], pa.string())], names=["part", "nth", "value"])


class RangedText(DataSource):
    """``spark.read.format("rangedtext").load(path)``: a file's non-blank lines with their range and place in it."""

    @classmethod
    def name(cls) -> str:
        return "rangedtext"

    def schema(self) -> str:
        return "part int, nth long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def numbered(spark: SparkSession, path: str, each: int = 16 << 20) -> DataFrame:
    """``number, value``: the non-blank lines of a file, counted from 0; only the ranges' counts are summed in one task."""
    spark.dataSource.register(RangedText)
    lines = spark.read.format("rangedtext").option("bytesPerPartition", each).load(path)
    counts = lines.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return lines.join(before, "part").select((F.col("before") + F.col("nth")).alias("number"), "value")
