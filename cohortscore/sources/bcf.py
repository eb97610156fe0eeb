"""Binary call files (BCF2): typed values, the header's dictionaries, and a data source that reads ranges of blocks.

Records have no marks between them.  A reader that begins somewhere finds the first record by what every record
must satisfy: known contig, plausible lengths, the header's number of samples, and that its length leads to others
that satisfy the same.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import bgzf

#: The file's first bytes, and numpy's names of the typed values' types with those of missing and of a vector's end.
MAGIC = b"BCF\x02\x02"
KINDS = {1: "<i1", 2: "<i2", 3: "<i4", 5: "<f4", 7: "S1"}
MISSING = {1: -0x80, 2: -0x8000, 3: -0x80000000}
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002
#: Records in a row that a reader asks for before it trusts its start.
CHAIN = 4


@dataclass(frozen=True)
class Header:
    strings: dict[int, str]
    contigs: dict[int, str]
    samples: Sequence[str]
    lengths: list[tuple[str, int]]


def parse_header(text: str, names: bool = True) -> Header:
    """Dictionaries in the order of the lines, unless a line gives its number (IDX); PASS is 0. Without ``names``, samples are numbers."""
    strings, contigs, samples, lengths = {0: "PASS"}, {}, [], []
    place = {"PASS": 0}
    for line in text.splitlines():
        if m := re.match(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>$", line):
            fields = dict(x.split("=", 1) for x in re.findall(r'(\w+=(?:"(?:[^"\\]|\\.)*"|[^,]*))', m[2]))
            if m[1] == "contig":
                contigs[int(fields.get("IDX", len(contigs)))] = fields["ID"]
                lengths.append((fields["ID"], int(fields.get("length", 0))))
            elif fields["ID"] not in place:
                place[fields["ID"]] = int(fields.get("IDX", max(strings) + 1))
                strings[place[fields["ID"]]] = fields["ID"]
        elif line.startswith("#CHROM"):
            samples = line.split("\t")[9:] if names else range(max(0, line.count("\t") - 8))
    return Header(strings, contigs, samples, lengths)


class Values:
    """A cursor over typed values."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def shape(self) -> tuple[int, int]:
        """(type, length) of the next value."""
        head = self.data[self.at]
        self.at += 1
        n = head >> 4
        return head & 15, self.integer() if n == 15 else n

    def array(self, kind: int, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, KINDS[kind], n, self.at)
        self.at += out.nbytes
        return out

    def integer(self) -> int:
        kind, n = self.shape()
        return int(self.array(kind, n)[0])

    def string(self) -> str:
        kind, n = self.shape()
        raw = self.data[self.at : self.at + n]
        self.at += n
        if n and kind != 7:
            raise ValueError("a string is of another type")
        return raw.rstrip(b"\0").decode()

    def text(self) -> str | None:
        """The next value as call files spell it: None for a flag, '.' for what is missing."""
        kind, n = self.shape()
        if kind == 0 or n == 0:
            return None if kind == 0 else "."
        if kind == 7:
            raw = self.data[self.at : self.at + n]
            self.at += n
            return raw.rstrip(b"\0").decode()
        values = self.array(kind, n)
        if kind == 5:
            bits = values.view("<u4")
            return ",".join("." if b == FLOAT_MISSING else np.format_float_positional(x, trim="-") for x, b in zip(values, bits, strict=True) if b != FLOAT_END)
        return ",".join("." if x == MISSING[kind] else str(x) for x in values.tolist() if x != MISSING[kind] + 1)


def dosages(raw: np.ndarray, kind: int) -> np.ndarray:
    """Alternative alleles of each sample's call (-1: missing): all alleles alternative is 2, some 1; the row's end pads lower ploidy."""
    there = raw != MISSING[kind] + 1
    allele = (raw >> 1) - 1
    missing = (there & ((allele < 0) | (raw == MISSING[kind]))).any(axis=1) | ~there.any(axis=1)
    alt = (there & (allele > 0)).sum(axis=1)
    return np.where(missing, -1, np.where(alt == 0, 0, np.where(alt == there.sum(axis=1), 2, 1))).astype(np.int8)


def decode(shared: bytes, own: bytes, header: Header) -> dict:
    """A record's fields, calls as places and dosages of samples that are not homozygous for the reference; several alternatives raise."""
    contig, pos, _, qual, allele_info, sample_format = struct.unpack_from("<iiiIII", shared)
    n_info, n_allele, n_sample, n_format = allele_info & 0xFFFF, allele_info >> 16, sample_format & 0xFFFFFF, sample_format >> 24
    v = Values(shared, 24)
    name = v.string()
    alleles = [v.string() for _ in range(n_allele)]
    if n_allele > 2:
        raise ValueError(f"a record at {header.contigs[contig]}:{pos + 1} has several alternative alleles")
    kind, n = v.shape()
    filters = [header.strings[int(i)] for i in v.array(kind, n)] if n else []
    info = {}
    for _ in range(n_info):
        key = header.strings[v.integer()]
        info[key] = v.text() or ""
    at, d = np.zeros(0, np.int32), np.zeros(0, np.int8)
    f = Values(own)
    for _ in range(n_format):
        key = header.strings[f.integer()]
        kind, n = f.shape()
        if key == "GT":
            calls = dosages(f.array(kind, n * n_sample).reshape(n_sample, n), kind)
            at = np.flatnonzero(calls).astype(np.int32)
            d = calls[at]
        else:
            f.at += n * n_sample * (1 if kind in (0, 7) else np.dtype(KINDS[kind]).itemsize)
    value = struct.unpack("<f", struct.pack("<I", qual))[0]
    return {"chrom": header.contigs[contig], "pos": pos + 1, "id": name if name not in ("", ".") else None, "ref": alleles[0], "alt": alleles[1] if n_allele == 2 else ".", "qual": None if qual == FLOAT_MISSING else float(value),
            "filters": filters, "info": info, "at": at, "dosage": d}


def plausible(data: bytes, at: int, header: Header, chain: int = CHAIN, whole: bool = False) -> bool | None:
    """Whether records may start here: so many in a row, or as far as the data goes (``whole``: they must end with it); None if more data must tell."""
    for _ in range(chain):
        if at == len(data) and whole:
            return True
        if at + 32 > len(data):
            return False if whole else None
        n_shared, n_own, contig, pos, span, _, allele_info, sample_format = struct.unpack_from("<IIiiiIII", data, at)
        if n_shared < 26 or contig not in header.contigs or pos < -1 or span < 0 or not allele_info >> 16 or (sample_format & 0xFFFFFF) != len(header.samples):
            return False
        at += 8 + n_shared + n_own
        if at > len(data) and whole:
            return False
    return True


# Encoding


def typed(values, kind: int | None = None) -> bytes:
    """A typed value of integers, floats or text, in the least type that holds it."""
    if isinstance(values, str):
        raw, kind, n = values.encode(), 7, len(values.encode())
    else:
        n = len(values)
        kind = kind or (5 if any(isinstance(x, float) for x in values) else next(k for k in (1, 2, 3) if all(MISSING[k] + 8 <= x <= -MISSING[k] - 1 for x in values)))
        raw = np.array(values, KINDS[kind]).tobytes()
    return (bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + typed([n])) + raw


def encode(contig: int, pos: int, name: str, ref: str, alt: str, dosage: np.ndarray, gt: int, qual: float | None = None, info: list[tuple[int, bytes]] = ()) -> bytes:
    """A record of diploid calls (-1: missing); ``gt`` and infos' keys are numbers in the dictionary."""
    bits = FLOAT_MISSING if qual is None else struct.unpack("<I", struct.pack("<f", qual))[0]
    shared = struct.pack("<iiiIII", contig, pos - 1, len(ref), bits, 2 << 16 | len(info), 1 << 24 | len(dosage)) + typed(name) + typed(ref) + typed(alt) + typed([0]) + b"".join(typed([k]) + v for k, v in info)
    calls = np.array([[0, 0], [2, 2], [2, 4], [4, 4]], "<i1")[np.asarray(dosage, int) + 1]
    own = typed([gt]) + bytes([2 << 4 | 1]) + calls.tobytes()
    return struct.pack("<II", len(shared), len(own)) + shared + own


def file_head(contigs: list[str], samples: list[str]) -> bytes:
    """The file's start for diploid calls without more: the dictionary has GT as 1."""
    before, after = head_around(contigs, sum(len(s.encode()) + 1 for s in samples))
    return before + "".join(f"\t{s}" for s in samples).encode() + after


def head_around(contigs: list[str], size: int) -> tuple[bytes, bytes]:
    """What stands before and after the samples' names in the file's start; ``size``: bytes of the names with a tab before each."""
    text = "\n".join([
        "##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed",IDX=0>', *[f"##contig=<ID={c},IDX={i}>" for i, c in enumerate(contigs)],
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype",IDX=1>', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]),
    ]).encode()
    return MAGIC + struct.pack("<I", len(text) + size + 2) + text, b"\n\0"


# Reading


def read_header(blocks: bgzf.Blocks, names: bool = True) -> tuple[Header, int, int]:
    """The header, the block in which the first record starts, and where in that block's data."""
    held, before = bytearray(), 0
    for place, data in blocks.read(0):
        held += data
        if len(held) >= 9:
            if held[:5] != MAGIC:
                raise ValueError("no binary call file of version 2")
            stop = 9 + struct.unpack_from("<I", held, 5)[0]
            if len(held) > stop or (len(held) == stop and not data):
                return parse_header(held[9:stop].rstrip(b"\0").decode(), names), place, stop - before
        before = len(held)
    if len(held) >= 9 and len(held) == 9 + struct.unpack_from("<I", held, 5)[0]:
        return parse_header(held[9:].rstrip(b"\0").decode(), names), blocks.size, 0
    raise ValueError("the header is cut off")


def records_of(blocks: bgzf.Blocks, header: Header, lo: int, hi: int, begin: tuple[int, int]) -> Iterator[dict]:
    """Records that start in blocks that start at bytes lo to hi; ``begin`` is where the first record of all starts."""
    known = lo <= begin[0] < hi
    start = begin[0] if known else blocks.first(lo)
    if start >= hi or start < begin[0]:
        return
    data, at, edge, ended = bytearray(), begin[1] if known else 0, None, False
    stream = blocks.read(start)

    def more() -> bool:
        """Another block; from the first beyond hi on, records that start there belong to the next range."""
        nonlocal data, edge, ended
        got = next(stream, None)
        if got is None:
            ended = True
            return False
        if got[0] >= hi and edge is None:
            edge = len(data)
        data += got[1]
        return True

    more()
    mark = struct.pack("<I", len(header.samples))[:3]
    while not known:
        # The first byte from which a chain of records goes on; a record has its number of samples 28 bytes on.  The range's own
        # blocks are all looked through before any beyond them is read, so ranges within a long record end early.
        here = data.find(mark, at + 28) - 28
        if edge is not None and (at >= edge or here >= edge):
            return
        if here < 0:
            at = max(at, len(data) - 30)
            if not more():
                return
            continue
        at = here
        answer = plausible(data, at, header, whole=ended)
        if answer:
            break
        if answer is None:
            more()
            continue
        at += 1
    while True:
        while len(data) < at + 8 and more():
            pass
        if (edge is not None and at >= edge) or len(data) == at:
            return
        if len(data) < at + 8:
            raise ValueError("a record is cut off")
        n_shared, n_own = struct.unpack_from("<II", data, at)
        stop = at + 8 + n_shared + n_own
        while len(data) < stop:
            if not more():
                raise ValueError("a record is cut off")
        yield decode(bytes(data[at + 8 : at + 8 + n_shared]), bytes(data[at + 8 + n_shared : stop]), header)
        at = stop
        if at > 1 << 22:
            del data[:at]
            edge, at = None if edge is None else edge - at, 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("bytesPerPartition", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        with bgzf.open_file(self.path) as f:
            blocks = bgzf.Blocks(f, f.size())
            # A partition's reader needs the samples' number alone: names in each would be names times ranges on the driver.
            header, place, at = read_header(blocks, names=False)
            return [InputPartition((lo, min(blocks.size, lo + self.each), header, (place, at))) for lo in range(place, blocks.size, self.each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lo, hi, header, begin = partition.value
        with bgzf.open_file(self.path) as f:
            for r in records_of(bgzf.Blocks(f, f.size()), header, lo, hi, begin):
                d = pa.array(r["dosage"].astype(np.int32), mask=r["dosage"] < 0)
                lists = [pa.array([r["filters"]], pa.list_(pa.string())), pa.array([list(r["info"].items())], pa.map_(pa.string(), pa.string()))]
                calls = [pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), x) for x in (pa.array(r["at"]), d)]
                plain = [pa.array([r[k]], t) for k, t in (("chrom", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("ref", pa.string()), ("alt", pa.string()), ("qual", pa.float64()))]
                yield pa.RecordBatch.from_arrays([*plain, *lists, *calls], names=["chrom", "pos", "id", "ref", "alt", "qual", "filters", "info", "at", "dosage"])


class BcfSource(DataSource):
    """``spark.read.format("bcf2").load(path)``: a row a record; ``at`` and ``dosage`` are the carriers and missing calls."""

    @classmethod
    def name(cls) -> str:
        return "bcf2"

    def schema(self) -> str:
        return "chrom string, pos long, id string, ref string, alt string, qual double, filters array<string>, info map<string,string>, at array<int>, dosage array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
