"""Text call files (plain, gzip or block-compressed): header, records, and one row for each called sample."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bgzf


def genotype_format(path: str) -> str:
    """``vcf``, ``bcf`` or ``plink1`` by the path's suffix."""
    p = path.lower()
    if p.endswith(".bed"):
        return "plink1"
    if p.endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        return "vcf"
    if p.endswith(".bcf"):
        return "bcf"
    raise ValueError(f"unknown genotype format: {path}")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The text lines; plain and block-compressed files are split, other gzip files are one task each."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        blocked = path.lower().endswith((".gz", ".bgz")) and bgzf.is_bgzf(path)
        if blocked:
            spark.dataSource.register(bgzf.BgzfText)
        found.append(spark.read.format("bgzftext").load(path) if blocked else spark.read.text(path))
    return reduce(DataFrame.unionByName, found)


def header(text: DataFrame) -> tuple[list[str], list[tuple[str, int]]]:
    """Sample ids in order, and contigs with their lengths; only header lines reach the driver."""
    samples: list[str] = []
    contigs = []
    for row in text.where(F.col("value").startswith("#")).collect():
        v = row["value"]
        if v.startswith("##contig="):
            fields = dict(x.split("=", 1) for x in v[v.index("<") + 1 : v.rindex(">")].split(",") if "=" in x)
            contigs.append((fields["ID"], int(fields.get("length", 0))))
        elif v.startswith("#CHROM"):
            samples = v.split("\t")[9:]
    return samples, contigs


def _field(i: int) -> Column:
    return F.element_at("f", i)


def records(text: DataFrame, region: tuple[str, int, int] | None = None) -> DataFrame:
    """One row a record, its samples' fields as one text; short records and several alternative alleles raise. ``region`` is by POS, inclusive."""
    r = text.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t", 10).alias("f"))
    r = r.where(F.when(F.size("f") < 8, F.raise_error(F.lit("a record has fewer than 8 columns"))).otherwise(True))
    r = r.where(F.when(_field(5).contains(","), F.raise_error(F.lit("a record has several alternative alleles"))).otherwise(True))
    r = r.select(
        _field(1).alias("chrom"), _field(2).cast("long").alias("pos"), F.nullif(_field(3), F.lit(".")).alias("id"), _field(4).alias("ref"), _field(5).alias("alt"),
        _field(6).try_cast("double").alias("qual"), _field(8).alias("info"), F.try_element_at("f", F.lit(9)).alias("format"), F.try_element_at("f", F.lit(10)).alias("samples"),
    )
    if region:
        r = r.where((F.col("chrom") == region[0]) & F.col("pos").between(*region[1:]))
    return r.withColumn("variant_id", F.coalesce("id", F.concat_ws(":", "chrom", "pos", "ref", "alt")))


#: Bytes of a line's samples that are looked at in one step.
STEP = 1 << 22
TAB, COLON = 9, 58
#: What cannot be an allele of one character: the marks between alleles, fields and samples.
_IS_MARK = np.isin(np.arange(256), [TAB, COLON, ord("/"), ord("|")]) | (np.arange(256) > 127)


def dosage(token: str | None) -> int:
    """Alternative alleles of a call, -1 if any allele is missing; one allele counts twice."""
    alleles = (token or "").replace("|", "/").split("/")
    if any(a in (".", "") for a in alleles):
        return -1
    alt = sum(a != "0" for a in alleles)
    return 2 * alt if len(alleles) == 1 else 0 if alt == 0 else 2 if alt == len(alleles) else 1


def dosages(part: bytes, gt: int, known: dict[bytes, int]) -> np.ndarray:
    """Dosages of samples' fields between tabs; GT is their field number ``gt`` (0: none). ``known`` keeps the spellings met."""
    if gt != 1:
        fields = [x.split(b":") for x in part.split(b"\t")]
        return np.array([dosage(f[gt - 1].decode()) if 0 < gt <= len(f) else -1 for f in fields], np.int8)
    b = np.frombuffer(part + b"\t\t\t\t", np.uint8)
    stop = np.flatnonzero(b[:-3] == TAB)
    start = np.r_[0, stop[:-1] + 1]
    one, mark, two, end = (b[np.minimum(start + i, len(b) - 1)] for i in range(4))
    # Two alleles of one character are read at once; all else by its spelling.
    plain = ~_IS_MARK[one] & ((mark == ord("/")) | (mark == ord("|"))) & ~_IS_MARK[two] & ((end == TAB) | (end == COLON))
    out = ((one != ord("0")).astype(np.int8) + (two != ord("0"))).astype(np.int8)
    out[(one == ord(".")) | (two == ord("."))] = -1
    for i in np.flatnonzero(~plain):
        token = part[start[i] : stop[i]].partition(b":")[0]
        if token not in known:
            known[token] = dosage(token.decode())
        out[i] = known[token]
    return out


def parts_of(samples: bytes) -> Iterator[bytes]:
    """The samples' fields in pieces of about ``STEP`` bytes, cut at tabs."""
    lo = 0
    while True:
        cut = samples.find(b"\t", lo + STEP)
        if cut < 0:
            yield samples[lo:]
            return
        yield samples[lo:cut]
        lo = cut + 1


def calls(text: DataFrame) -> DataFrame:
    """``variant_id, sample_index, dosage``: carriers and missing calls (an absent row is 0)."""
    at = F.coalesce(F.array_position(F.split("format", ":"), "GT").cast("int"), F.lit(0))
    r = records(text).where(F.col("samples").isNotNull()).select("variant_id", at.alias("gt"), F.col("samples").cast("binary").alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, gt, samples in zip(b.column(0), b.column(1).to_pylist(), b.column(2), strict=True):
                before, known = 0, {}
                for part in parts_of(samples.as_py()):
                    d = dosages(part, gt, known)
                    own = np.flatnonzero(d)
                    found = pa.array(d[own].astype(np.int32), mask=d[own] < 0)
                    yield pa.RecordBatch.from_arrays([pa.repeat(v, len(own)), pa.array((own + before).astype(np.int32)), found], names=["variant_id", "sample_index", "dosage"])
                    before += len(d)

    return r.mapInArrow(run, "variant_id string, sample_index int, dosage int")
