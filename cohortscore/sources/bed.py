"""Two-bit genotype files: codec, a Python data source with a partition for each range of variants, and packing of calls into rows (``dataset.write_trios`` writes them)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

#: The file's magic bytes, and the dosage of the first allele for the codes 0..3 (-1: missing).
MAGIC = b"\x6c\x1b\x01"
DOSAGE_OF_CODE = np.array([2, -1, 1, 0], np.int8)
SYMBOLIC = "DEL|DUP|INS|INV|BND|STR|VNTR|ME"
CODE_OF_DOSAGE = np.array([3, 2, 0, 1], np.uint8)  # for 0, 1, 2 and missing (-1 or 3)


def unpack(raw: bytes, n: int) -> np.ndarray:
    """n dosages, low bits first; -1 is missing."""
    b = np.frombuffer(raw, np.uint8)
    return DOSAGE_OF_CODE[(b[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3].reshape(-1)[:n]


def pack(dosages: np.ndarray) -> bytes:
    """The reverse; other values than 0, 1, 2 and -1 raise."""
    d = np.asarray(dosages)
    if not np.isin(d, (-1, 0, 1, 2)).all():
        raise ValueError("only hard calls can be packed")
    codes = np.zeros(-(-len(d) // 4) * 4, np.uint8)
    codes[: len(d)] = CODE_OF_DOSAGE[d]
    return (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _open(path: str):
    import pyarrow.fs

    fs, p = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs.open_input_file(p)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.samples = options["path"], int(options["samples"])
        self.each = int(options.get("variantsPerPartition", 4096))

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path} is no variant-major .bed file")
            size = f.size() - 3
        width = -(-self.samples // 4)
        if size % width:
            raise ValueError(f"{self.path}: its size does not fit {self.samples} samples")
        n = size // width
        return [InputPartition((lo, min(n, lo + self.each))) for lo in range(0, n, self.each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lo, hi = partition.value
        width = -(-self.samples // 4)
        with _open(self.path) as f:
            f.seek(3 + lo * width)
            for v in range(lo, hi):
                d = unpack(f.read(width), self.samples)
                at = np.flatnonzero(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), v, np.int64)), pa.array(at.astype(np.int64)), pa.array(d[at].astype(np.int32), mask=d[at] < 0)],
                    names=["variant_index", "sample_index", "dosage"],
                )


class BedSource(DataSource):
    """``spark.read.format("bed2bit").option("samples", n).load(path)``: carriers and missing calls."""

    @classmethod
    def name(cls) -> str:
        return "bed2bit"

    def schema(self) -> str:
        return "variant_index long, sample_index long, dosage int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def pack_calls(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """``variant_id, packed``: each variant's calls in the order of ``samples.ordinal``, two bits each.

    ``samples`` (sample_id, ordinal from 0) gives the number of samples; a variant's carriers are one row.
    """
    n = samples.count()
    placed = together(calls, samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, d in filled(batches, n):
            yield pa.RecordBatch.from_arrays([v, pa.array([pack(d)], pa.binary())], names=["variant_id", "packed"])

    return placed.mapInArrow(run, StructType([placed.schema["variant_id"], StructField("packed", BinaryType())]))


def together(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """``variant_id, ordinal, dosage`` (-1: missing), a variant's rows one after another; no list of a variant's carriers is made."""
    placed = calls.join(samples, "sample_id").select("variant_id", "ordinal", F.coalesce("dosage", F.lit(-1)).cast("byte").alias("dosage"))
    return placed.repartition("variant_id").sortWithinPartitions("variant_id")


def filled(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(variant, its n dosages) of the rows of ``together``, as they stream by: one variant is held."""
    variant, row = None, None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0)
        nth = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, nth[1:] != nth[:-1], True])
        at, d = b.column(1).to_numpy(), b.column(2).to_numpy()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = ids.slice(lo, 1)
            if row is None or not own.equals(variant):
                if row is not None:
                    yield variant, row
                variant, row = own, np.zeros(n, np.int8)
            row[at[lo:hi]] = d[lo:hi]
    if row is not None:
        yield variant, row


def unpack_calls(packed: DataFrame, n: int) -> DataFrame:
    """``variant_id, ordinal, dosage``: carriers and missing calls of packed variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = unpack(raw, n)
                at = np.flatnonzero(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), v, np.int64)), pa.array(at.astype(np.int64)), pa.array(d[at].astype(np.int32), mask=d[at] < 0)], names=["variant_id", "ordinal", "dosage"]
                )

    return packed.mapInArrow(run, "variant_id long, ordinal long, dosage int")


def bim(text: DataFrame) -> DataFrame:
    """Variant records of .bim lines (six fields, any white space); short lines raise."""
    f = text.where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))
    f = f.where(F.when(F.size("f") < 6, F.raise_error(F.lit("a .bim line has fewer than 6 fields"))).otherwise(True))
    a1, a2 = F.element_at("f", 5), F.element_at("f", 6)
    token = F.when(F.upper(a1).rlike(SYMBOLIC), F.upper(a1)).when(F.upper(a2).rlike(SYMBOLIC), F.upper(a2))
    kind = (
        F.when(token.contains("DEL"), "deletion_short").when(token.rlike("DUP|CNV"), "duplication_short").when(token.rlike("INS|ME"), "insertion_mei")
        .when(token.rlike("INV|BND"), "inversion_bnd_complex").when(token.rlike("STR|VNTR"), "str_vntr_repeat").when(token.isNotNull(), "other_complex_sv")
        .when((F.length(a1) == 1) & (F.length(a2) == 1), "snv").otherwise("small_indel")
    )
    return f.select(F.element_at("f", 1).alias("chrom"), F.element_at("f", 2).alias("variant_id"), F.element_at("f", 4).cast("long").alias("pos"), a1.alias("a1"), a2.alias("a2"), kind.alias("variant_class"), F.lit(1.0).alias("length"))


def fam(text: DataFrame) -> DataFrame:
    """Sample ids of .fam lines: the second field."""
    return text.where(F.trim("value") != "").select(F.element_at(F.split(F.trim("value"), r"\s+"), 2).alias("sample_id"))


def sample_layout(available: list[str], wanted: list[str] | None = None, order: list[str] | None = None) -> list[int]:
    """Places in the file of the samples to write, in the order asked for; unknown or repeated ids raise."""
    if len(set(available)) != len(available):
        raise ValueError("sample ids repeat")
    keep = set(wanted) if wanted is not None else set(available)
    ids = [s for s in (order if order is not None else available) if s in keep]
    at = {s: i for i, s in enumerate(available)}
    if lost := [s for s in [*keep, *ids] if s not in at]:
        raise ValueError(f"unknown samples: {', '.join(sorted(set(lost)))}")
    return [at[s] for s in ids]
