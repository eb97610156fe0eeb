"""Loading call files of one or several formats with a sample table, and writing two-bit trios.

Sources are joined, never gathered: calls stay sparse rows, samples are those that all sources and the
sample table share, and a variant that several sources have comes from the first of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscore.operators import components

from . import bcf, bed, bgzf, lines, tables, vcf


@dataclass(frozen=True)
class Dataset:
    """``calls`` (sample_id, variant_id, dosage), ``samples`` (sample_id, target, covariates), ``variants`` (variant_id, chrom, pos, variant_class, length, ref, alt)."""

    calls: DataFrame
    samples: DataFrame
    variants: DataFrame
    origin: dict = field(default_factory=dict)  #: what it was loaded from, so that another input is another run


def stamps(spark: SparkSession, paths: list[str]) -> list[list]:
    """Path, size and time of every file of ``paths``, in order; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", F.col("modificationTime").cast("string").alias("time"))
    return sorted([r["path"], r["length"], r["time"]] for r in found.collect())


def contents(table: DataFrame) -> list:
    """Rows and a sum of their hashes: equal for equal rows in any order."""
    n, digest = table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first()
    return [n, str(digest)]


def _named(calls: DataFrame, names: DataFrame) -> DataFrame:
    """sample_index becomes sample_id, by a join with ``names`` (sample_index, sample_id): no plan and no task holds them all."""
    return calls.withColumn("sample_index", F.col("sample_index").cast("long")).join(names, "sample_index").select("sample_id", "variant_id", "dosage")


def described_alleles(r: DataFrame, svlen: Column) -> DataFrame:
    """Variants of records with class and length by their alleles; ``svlen`` is text."""
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    length = F.greatest(F.length("ref"), F.length("alt")).cast("double")
    size = F.abs(svlen.try_cast("double"))
    token = F.upper(F.col("alt"))
    kind = (
        F.when(token.contains("DEL"), F.when(size >= 1000, "deletion_long").otherwise("deletion_short"))
        .when(token.rlike("DUP|CNV"), F.when(size >= 1000, "duplication_long").otherwise("duplication_short"))
        .when(token.rlike("INS|ME"), F.lit("insertion_mei")).when(token.rlike("INV|BND"), F.lit("inversion_bnd_complex"))
        .when(token.rlike("STR|VNTR"), F.lit("str_vntr_repeat")).when(token.startswith("<"), F.lit("other_complex_sv"))
        .when(snv, F.lit("snv")).otherwise(F.lit("small_indel"))
    )
    return r.select("variant_id", "chrom", "pos", kind.alias("variant_class"), F.coalesce(size, length).alias("length"), "ref", "alt")


def _text_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = vcf.lines(spark, path)
    names = text.where(F.col("value").startswith("#CHROM")).distinct().select(F.posexplode(F.split(F.split("value", "\t", 10)[9], "\t")).alias("sample_index", "sample_id"))
    variants = described_alleles(vcf.records(text), F.regexp_extract(F.concat(F.lit(";"), "info"), ";SVLEN=([^;,]*)", 1))
    return vcf.calls(text), variants, names


def _binary_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark.dataSource.register(bcf.BcfSource)

    def header(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with bgzf.open_file(path) as f:
            found = bcf.read_header(bgzf.Blocks(f, f.size()))[0].samples
        for lo in range(0, len(found), 1 << 16):
            own = found[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(own)), pa.int64()), pa.array(own, pa.string())], names=["sample_index", "sample_id"])

    names = spark.range(0, 1, 1, 1).mapInArrow(header, "sample_index long, sample_id string")
    r = spark.read.format("bcf2").load(path).withColumn("variant_id", F.coalesce("id", F.concat_ws(":", "chrom", "pos", "ref", "alt")))
    calls = r.select("variant_id", F.explode(F.arrays_zip("at", "dosage")).alias("x")).select("variant_id", F.col("x.at").alias("sample_index"), "x.dosage")
    return calls, described_alleles(r, F.split_part(F.col("info")["SVLEN"], F.lit(","), F.lit(1))), names


def _bed_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stem = path.removesuffix(".bed")
    names = lines.numbered(spark, f"{stem}.fam").select(F.col("number").alias("sample_index"), F.element_at(F.split(F.trim("value"), r"\s+"), 2).alias("sample_id"))
    indexed = lines.numbered(spark, f"{stem}.bim").select("value", F.col("number").alias("variant_index"))
    fields = bed.bim(indexed.select("value"))
    variants = indexed.select("variant_index", F.element_at(F.split(F.trim("value"), r"\s+"), 2).alias("variant_id"))
    spark.dataSource.register(bed.BedSource)
    raw = spark.read.format("bed2bit").option("samples", names.count()).load(path)
    calls = raw.join(variants, "variant_index").select("variant_id", "sample_index", "dosage")
    # The file counts its first allele.
    return calls, fields.select("variant_id", "chrom", "pos", "variant_class", "length", F.col("a2").alias("ref"), F.col("a1").alias("alt")), names


def load_calls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Calls, variants and the file's sample ids in order, by the path's suffix; for files whose ids a list can hold."""
    calls, variants, names = _opened(spark, path)
    return _named(calls, names), variants, [r["sample_id"] for r in names.orderBy("sample_index").collect()]


def named_calls(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, variant_id, dosage`` of a file of any number of samples."""
    calls, _, names = _opened(spark, path)
    return _named(calls, names)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls by sample_index, variants and ``sample_index, sample_id``, which are read once and kept in the shared folder."""
    source_of = {"vcf": _text_source, "bcf": _binary_source, "plink1": _bed_source}
    calls, variants, names = source_of[vcf.genotype_format(path)](spark, path)
    components.shared_dir(spark)
    names = names.select(F.col("sample_index").cast("long").alias("sample_index"), "sample_id").checkpoint()
    n, places, ids = names.agg(F.count("*"), F.count_distinct("sample_index"), F.count_distinct("sample_id")).first()
    if places != n:
        raise ValueError(f"{path}: its header lines differ")
    if ids != n:
        raise ValueError(f"{path}: sample ids repeat")
    return calls, variants, names


def load_dataset(
    spark: SparkSession, paths: list[str], sample_table: str, target: str, covariates: list[str], sample_id: str | None = None, metadata: str | None = None
) -> Dataset:
    """Calls of all ``paths`` for the samples that all of them and the sample table have.

    The id column is the one given, or that of ``sample_id, research_id, person_id`` which matches most
    samples (the first of equals).  Samples whose target or covariate is not a finite number go.  Rows
    of ``metadata`` (variant_id and columns to override) without a variant raise, repeated ones too.
    """
    if not paths:
        raise ValueError("no call files")
    found = [_opened(spark, p) for p in paths]
    ids = reduce(lambda a, b: a.join(b, "id", "left_semi"), [names.select(F.col("sample_id").alias("id")) for _, _, names in found])
    table = tables.delimited(spark, sample_table)
    tables.require_columns(table, [target, *covariates], sample_table)
    key = sample_id
    if key is None:
        there = [c for c in ("sample_id", "research_id", "person_id") if c in table.columns]
        matches = {c: table.join(ids, table[c] == ids["id"], "left_semi").count() for c in there}
        key = max(there, key=lambda c: matches[c], default=None)
        if key is None or not matches[key]:
            raise ValueError(f"{sample_table}: no id column matches the call files' samples")
    number = lambda c: F.col(c).try_cast("double")
    finite = [number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) != float("inf")) for c in (target, *covariates)]
    samples = table.where(reduce(lambda a, b: a & b, finite)).join(ids, table[key] == ids["id"]).select(F.col("id").alias("sample_id"), number(target).alias("target"), *[number(c).alias(c) for c in covariates])
    if twice := samples.groupBy("sample_id").count().where("count > 1").first():
        raise ValueError(f"{sample_table}: sample {twice['sample_id']} comes twice")
    sourced = reduce(DataFrame.unionByName, [v.withColumn("source", F.lit(i)) for i, (_, v, _) in enumerate(found)])
    first = Window.partitionBy("chrom", "pos", "variant_id").orderBy("source")
    variants = sourced.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    # Names of samples that stay, so that calls of all others go in the same join.
    named = [_named(c, names.join(samples.select("sample_id"), "sample_id", "left_semi")) for c, _, names in found]
    calls = reduce(DataFrame.unionByName, [c.withColumn("source", F.lit(i)) for i, c in enumerate(named)])
    calls = calls.join(variants.select("variant_id", "source"), ["variant_id", "source"], "left_semi").drop("source")
    more = tables.delimited(spark, metadata) if metadata else None
    origin = {
        "calls": [stamps(spark, [*beside(p)]) for p in paths], "samples": contents(table), "target": target, "covariates": covariates, "id": key,
        "metadata": contents(more) if metadata else None,
    }
    return Dataset(calls.select("sample_id", "variant_id", "dosage"), samples, described(variants.drop("source"), more), origin)


def beside(path: str) -> list[str]:
    """A call file and those that belong to it."""
    stem = path.removesuffix(".bed")
    return [path] if stem == path else [path, f"{stem}.bim", f"{stem}.fam"]


def described(variants: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Variants with the metadata's columns in place of the defaults where it has a value."""
    if metadata is None:
        return variants
    if twice := metadata.groupBy("variant_id").count().where("count > 1").first():
        raise ValueError(f"metadata of {twice['variant_id']} comes twice")
    if orphan := metadata.join(variants, "variant_id", "left_anti").first():
        raise ValueError(f"metadata of an unknown variant: {orphan['variant_id']}")
    kinds = dict(variants.dtypes)
    m = metadata.select("variant_id", *[F.col(c).alias(f"new_{c}") for c in metadata.columns if c != "variant_id"])
    own = [F.coalesce(F.col(f"new_{c}").try_cast(kinds[c]), F.col(c)).alias(c) if f"new_{c}" in m.columns else F.col(c) for c in variants.columns]
    more = [F.col(f"new_{c}").alias(c) for c in metadata.columns if c not in variants.columns]
    return variants.join(m, "variant_id", "left").select(*own, *more)


def write_trios(calls: DataFrame, variants: DataFrame, samples: DataFrame, path: str, parts: int = 1) -> DataFrame:
    """Write ``path/part-N.bed`` with its .bim and .fam for each range of variants, and tell (part, n_variants).

    ``samples`` (sample_id, ordinal from 0) is the order in the files.  Variants keep their alleles (``alt`` first, as it
    is counted, then ``ref``); those without are written as A and G.  Each part is a whole trio that its task
    writes alone, under a name of its own until it is complete, so a lost task is only run again.
    """
    name = F.col("sample_id").cast("string")
    pieces, _ = _pieces(samples.select("ordinal", F.concat(name, F.lit(" "), name, F.lit(" 0 0 0 -9\n")).alias("text")), f"{path}-lines")  # the .fam file's
    packed, n_samples = bed.pack_calls(calls, samples), samples.count()
    alleles = [F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) if c in variants.columns else F.lit(d).alias(c) for c, d in (("alt", "A"), ("ref", "G"))]
    rows = variants.select("variant_id", "chrom", "pos", *alleles).join(packed, "variant_id", "left").repartitionByRange(parts, "chrom", "pos", "variant_id").sortWithinPartitions("chrom", "pos", "variant_id")
    rows = rows.select(F.spark_partition_id().alias("part"), F.col("chrom").cast("string").alias("chrom"), "pos", F.col("variant_id").cast("string").alias("variant_id"), "packed", "alt", "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.fs

        fs, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(folder)
        own, part, n = f"{folder}/.{uuid.uuid4().hex}", None, 0
        blank = bed.pack(np.zeros(n_samples, np.int8))
        with fs.open_output_stream(f"{own}.bed") as calls_out, fs.open_output_stream(f"{own}.bim") as lines_out:
            calls_out.write(bed.MAGIC)
            for b in batches:
                for p, chrom, pos, name, raw, alt, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    part, n = p, n + 1
                    calls_out.write(raw if raw is not None else blank)
                    lines_out.write(f"{chrom}\t{name}\t0\t{pos}\t{alt}\t{ref}\n".encode())
        with fs.open_output_stream(f"{own}.fam") as f:
            for piece in pieces if part is not None else []:
                with bgzf.open_file(piece) as lines_in:
                    while raw := lines_in.read(1 << 20):
                        f.write(raw)
        for suffix in ("bed", "bim", "fam"):
            if part is None:
                fs.delete_file(f"{own}.{suffix}")
            else:
                fs.move(f"{own}.{suffix}", f"{folder}/part-{part}.{suffix}")
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "n_variants"])

    return rows.mapInArrow(run, "part int, n_variants long")


def name_pieces(named: DataFrame, path: str) -> tuple[list[str], int]:
    """Write the names of ``named`` (ordinal, name) in order below ``path``, a tab before each, and tell the files and their bytes in all.

    A header line may have millions of names: they go from tasks to tasks through files of ranges, not through the driver.
    """
    return _pieces(named.select("ordinal", F.concat(F.lit("\t"), F.col("name").cast("string")).alias("text")), path)


def _pieces(texts: DataFrame, path: str) -> tuple[list[str], int]:
    """Write the texts of ``texts`` (ordinal, text) in order below ``path``, and tell the files and their bytes in all."""
    rows = texts.select("ordinal", "text").repartitionByRange("ordinal").sortWithinPartitions("ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.fs

        fs, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(folder)
        first, size, name = None, 0, f"{uuid.uuid4().hex}.names"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for b in batches:
                if not b.num_rows:
                    continue
                first = b.column(0)[0].as_py() if first is None else first
                raw = "".join(b.column(1).to_pylist()).encode()
                out.write(raw)
                size += len(raw)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([f"{path}/{name}"]), pa.array([size], pa.int64())], names=["first", "path", "size"])

    told = sorted(rows.mapInArrow(run, "first long, path string, size long").collect())  # a row a range
    return [r["path"] for r in told], sum(r["size"] for r in told)


def write_blocks(text: DataFrame, head: str | list[bytes | str], path: str) -> DataFrame:
    """Write ``text`` (value) as block-compressed call files below ``path``, one a task, each with ``head`` before; told as ``path``.

    ``head`` is a text, or a list of bytes and of paths of files that hold parts of it.
    """
    return _files(text.select("value"), path, "vcf.gz", [head.encode()] if isinstance(head, str) else head, lambda b: (x + b"\n" for x in b.column(0).cast(pa.binary()).to_pylist()))


def write_binary(calls: DataFrame, variants: DataFrame, samples: DataFrame, path: str) -> DataFrame:
    """Write calls as binary call files below ``path``, one a task; told as ``path``.

    ``variants`` (variant_id, chrom, pos, ref, alt), ``samples`` (sample_id, ordinal from 0): the header's contigs and names.
    """
    contigs = sorted(str(r["chrom"]) for r in variants.select("chrom").distinct().collect())  # the header's lines
    names, size = name_pieces(samples.select("ordinal", F.col("sample_id").alias("name")), f"{path}-names")
    place, n = {c: i for i, c in enumerate(contigs)}, samples.count()
    before, after = bcf.head_around(contigs, size)
    rows = variants.join(bed.pack_calls(calls, samples), "variant_id", "left").select("chrom", "pos", "variant_id", "ref", "alt", "packed").select(F.col("chrom").cast("string"), F.col("pos").cast("long"), F.col("variant_id").cast("string"), "ref", "alt", "packed")

    def body(b: pa.RecordBatch) -> Iterator[bytes]:
        for chrom, pos, name, ref, alt, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            d = np.zeros(n, np.int8) if packed is None else bed.unpack(packed, n)
            yield bcf.encode(place[chrom], pos, name, ref, alt, d, 1)

    return _files(rows, path, "bcf", [before, *names, after], body)


def _files(rows: DataFrame, path: str, suffix: str, head: list[bytes | str], body: Callable[[pa.RecordBatch], Iterator[bytes]]) -> DataFrame:
    """A block-compressed file of each task with rows, under a name of its own: only those that are told of are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.fs

        fs, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(folder)
        name, out, held = f"{uuid.uuid4().hex}.{suffix}", None, b""

        def put(piece: bytes) -> None:
            nonlocal held
            whole = memoryview(held + piece if held else piece)
            for at in range(0, len(whole) - 65_279, 65_280):
                out.write(bgzf.deflate(whole[at : at + 65_280]))
            held = bytes(whole[len(whole) // 65_280 * 65_280 :])

        for b in batches:
            if out is None:
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                for part in head:
                    if isinstance(part, bytes):
                        put(part)
                        continue
                    with bgzf.open_file(part) as f:
                        put(f.read())
            for piece in body(b):
                put(piece)
        if out is not None:
            out.write(bgzf.deflate(held) + bgzf.EMPTY)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"])], names=["path"])

    return rows.mapInArrow(run, "path string")
