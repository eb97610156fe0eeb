"""Block-compressed text and binary call files, read by ranges, against whole and plain reads."""

import gzip
import io
import pickle
import struct

import numpy as np
import pytest

from cohortscore.sources import bcf, bgzf, dataset, lines



class _File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def _blocks(data):
    return bgzf.Blocks(_File(data), len(data))


def _split(data, each, read):
    return [x for lo in range(0, len(data), each) for x in read(lo, min(len(data), lo + each))]


TEXTS = [
    b"", b"a", b"a\n", b"\n\n\n", b"one\ntwo\nthree", b"one\ntwo\n\nthree\n", b"x" * 900 + b"\n" + b"y" * 5, b"\n".join(str(i).encode() * (i % 7) for i in range(300)),
    bgzf.HEAD * 40 + b"\n" + bgzf.HEAD * 3 + bytes(range(256)) * 3,
]


@pytest.mark.parametrize("step", [1, 3, 64, 65_280])
def test_lines_by_ranges(step):
    for text in TEXTS:
        data = bgzf.compress(text, step)
        assert gzip.decompress(data) == text
        want = text.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for each in (1, 7, 29, 200, 10_000) if len(data) < 40_000 else (997, 10_000):
            assert _split(data, each, lambda lo, hi: bgzf.lines_of(_blocks(data), lo, hi)) == want, (text[:20], step, each)


def test_blocks_that_hold_other_blocks():
    """Stored data may look like blocks; what does not lead on to another block is none."""
    inner = bgzf.compress(b"inner " * 9)
    rng = np.random.default_rng(0)
    text = b"\n".join(rng.integers(0, 256, 300, np.uint8).tobytes().replace(b"\n", b"") + inner[:30] for _ in range(50))
    data = bgzf.compress(text, 4000)
    for each in (100, 1500):
        assert _split(data, each, lambda lo, hi: bgzf.lines_of(_blocks(data), lo, hi)) == text.split(b"\n")


class _Counted(bytes):
    """Bytes that count what is added to them, piece by piece."""

    added = 0

    def __radd__(self, other):
        _Counted.added += len(other) + len(self)
        return _Counted(bytes(other) + bytes(self))

    def __add__(self, other):
        _Counted.added += len(other) + len(self)
        return _Counted(bytes(self) + bytes(other))


def test_a_long_line_is_put_together_once(monkeypatch):
    """A line of many blocks is not copied again with each of them."""
    text = b"a" * 50_000 + b"\n" + b"b" * 70_000 + b"\n"
    data, whole = bgzf.compress(text, 100), bgzf.inflate
    monkeypatch.setattr(bgzf, "inflate", lambda block: _Counted(whole(block)))
    _Counted.added = 0
    assert list(bgzf.lines_of(_blocks(data), 0, len(data))) == text.split(b"\n")[:2]
    assert _Counted.added < 10 * len(text)


def test_damage_raises():
    data = bgzf.compress(b"some text\n" * 50, 100)
    for bad in (data[:-40], data[:60] + b"\0\1\2" + data[63:]):
        with pytest.raises(Exception):
            list(bgzf.lines_of(_blocks(bad), 0, len(bad)))


def test_several_tasks_read_one_file(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(20_000)]
    (tmp_path / "t.gz").write_bytes(bgzf.compress("\r\n".join(lines).encode(), 20_000))
    spark.dataSource.register(bgzf.BgzfText)
    got = spark.read.format("bgzftext").option("bytesPerPartition", 10_000).load(str(tmp_path / "t.gz"))
    assert got.rdd.getNumPartitions() > 5 and [r[0] for r in got.collect()] == lines
    assert got.where("value LIKE '%7 %'").count() == sum("7 " in x for x in lines)
    (tmp_path / "plain.gz").write_bytes(gzip.compress(b"a\nb\n"))
    assert not bgzf.is_bgzf(str(tmp_path / "plain.gz"))
    with pytest.raises(Exception, match="not block-compressed"):
        spark.read.format("bgzftext").load(str(tmp_path / "plain.gz")).count()


# Binary call files

HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="All filters passed">
##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="a, b=\\"c\\"">
##INFO=<ID=AF,Number=A,Type=Float,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##INFO=<ID=NAME,Number=1,Type=String,Description="x">
##FILTER=<ID=low,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">
##contig=<ID=1,length=1000>
##contig=<ID=chrX,IDX=7>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\tD
"""


def _hand_made():
    """A record byte by byte: typed vectors of each width, a flag, a float, missing values, mixed ploidy, another format field first."""
    shared = struct.pack("<iiifII", 7, 99, 1, 12.5, 2 << 16 | 4, 2 << 24 | 4)
    shared += bytes([0x07]) + bytes([0x17]) + b"C" + bytes([0x57]) + b"<DEL>" + bytes([0x21, 0, 5])  # no id, alleles, filters PASS and low
    shared += bytes([0x11, 1, 0x12]) + struct.pack("<h", -1500) + bytes([0x11, 2, 0x25]) + struct.pack("<fI", 0.25, bcf.FLOAT_MISSING) + bytes([0x11, 3, 0x00]) + bytes([0x11, 4, 0xF7, 0x11, 20]) + b"a name of twenty ch."
    own = bytes([0x11, 7, 0x13]) + struct.pack("<4i", 1, 2, bcf.MISSING[3], 4) + bytes([0x11, 6, 0x21]) + struct.pack("<8b", 2, 5, 4, -127, 4, 5, 0, 4)
    return struct.pack("<II", len(shared), len(own)) + shared + own


def test_a_record_by_hand():
    text = HEADER.encode() + b"\0"
    data = bgzf.compress(bcf.MAGIC + struct.pack("<I", len(text)) + text + _hand_made())
    header, place, at = bcf.read_header(_blocks(data))
    assert header.samples == list("ABCD") and header.contigs == {0: "1", 7: "chrX"} and header.strings == {0: "PASS", 1: "SVLEN", 2: "AF", 3: "DB", 4: "NAME", 5: "low", 6: "GT", 7: "DP"}
    (r,) = bcf.records_of(_blocks(data), header, 0, len(data), (place, at))
    assert (r["chrom"], r["pos"], r["id"], r["ref"], r["alt"], r["qual"], r["filters"]) == ("chrX", 100, None, "C", "<DEL>", 12.5, ["PASS", "low"])
    assert r["info"] == {"SVLEN": "-1500", "AF": "0.25,.", "DB": "", "NAME": "a name of twenty ch."}
    assert r["at"].tolist() == [0, 1, 2, 3] and r["dosage"].tolist() == [1, 2, 2, -1]  # 0|1, 1 (one allele), 1|1, .|1 unphased


@pytest.mark.parametrize(("n", "step"), [(4, 100), (4, 65_280), (3000, 5000), (3000, 65_280)])
def test_records_by_ranges(n, step):
    rng = np.random.default_rng(1)
    names = [f"S{i}" for i in range(n)]
    want = [(str(i % 2 + 1), 10 * i + 1, f"v{i}", "A", "G" * (1 + i % 40), rng.choice([-1, 0, 0, 1, 2], n)) for i in range(60)]
    data = bgzf.compress(bcf.file_head(["1", "2"], names) + b"".join(bcf.encode(int(c) - 1, p, v, r, a, d, 1, qual=3.0) for c, p, v, r, a, d in want), step)
    header, place, at = bcf.read_header(_blocks(data))
    assert header.samples == names
    for each in (50, 1000, 1 << 20):
        got = _split(data, each, lambda lo, hi: bcf.records_of(_blocks(data), header, lo, hi, (place, at)))
        assert [(r["chrom"], r["pos"], r["id"], r["ref"], r["alt"]) for r in got] == [w[:5] for w in want], each
        for r, w in zip(got, want, strict=True):
            d = np.zeros(n, int)
            d[r["at"]] = r["dosage"]
            assert (d == w[5]).all()


def test_ranges_of_a_binary_file_know_no_names(tmp_path):
    """What the driver holds of a range does not grow with the header's names."""
    names = [f"a-name-of-sample-{i:06}" for i in range(20_000)]
    record = bcf.encode(0, 5, "v", "A", "G", np.random.default_rng(0).choice([-1, 0, 1, 2], len(names)), 1)
    (tmp_path / "x.bcf").write_bytes(bgzf.compress(bcf.file_head(["1"], names) + record * 20))
    ranges = bcf.BcfSource({"path": str(tmp_path / "x.bcf"), "bytesPerPartition": "5000"}).reader(None).partitions()
    assert len(ranges) > 10 and sum(len(pickle.dumps(r)) for r in ranges) < 1000 * len(ranges)


def test_binary_refuses_what_it_cannot_tell():
    head = bcf.file_head(["1"], ["A"])
    record = bcf.encode(0, 5, "v", "A", "G", np.array([1]), 1)
    three = record.replace(struct.pack("<I", 2 << 16), struct.pack("<I", 3 << 16)).replace(bytes([0x17]) + b"G", bytes([0x17]) + b"G" + bytes([0x17]) + b"T")
    three = struct.pack("<I", struct.unpack_from("<I", three)[0] + 2) + three[4:]
    for bad, why in ((three, "several alternative"), (record[:-1], "cut off")):
        data = bgzf.compress(head + bad)
        header, place, at = bcf.read_header(_blocks(data))
        with pytest.raises(ValueError, match=why):
            list(bcf.records_of(_blocks(data), header, 0, len(data), (place, at)))
    with pytest.raises(ValueError, match="no binary call file"):
        bcf.read_header(_blocks(bgzf.compress(b"##fileformat=VCFv4.2\n")))
    empty = bgzf.compress(head)
    header, place, at = bcf.read_header(_blocks(empty))
    assert list(bcf.records_of(_blocks(empty), header, 0, len(empty), (place, at))) == []


def test_text_and_binary_files_load_alike(spark, tmp_path):
    rng = np.random.default_rng(2)
    n, token = 30, {-1: "./.", 0: "0/0", 1: "0/1", 2: "1/1"}
    names = [f"S{i}" for i in range(n)]
    records = [(str(1 + i % 2), 5 * i + 1, f"v{i}", "A" if i % 3 else "N", ["G", "AT", "<DUP>"][i % 3 - 1], rng.choice([-1, 0, 0, 0, 1, 2], n)) for i in range(40)]
    text = "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names]) + "\n"
    text += "".join("\t".join([c, str(p), v, r, a, ".", ".", ".", "GT", *(token[x] for x in d)]) + "\n" for c, p, v, r, a, d in records)
    (tmp_path / "x.vcf").write_text(text)
    (tmp_path / "x.vcf.gz").write_bytes(bgzf.compress(text.encode(), 500))
    (tmp_path / "y.vcf.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "x.bcf").write_bytes(bgzf.compress(bcf.file_head(["1", "2"], names) + b"".join(bcf.encode(int(c) - 1, p, v, r, a, d, 1) for c, p, v, r, a, d in records), 500))
    got = [dataset.load_calls(spark, str(tmp_path / name)) for name in ("x.vcf", "x.vcf.gz", "y.vcf.gz", "x.bcf")]
    calls = [sorted(map(tuple, g[0].collect()), key=str) for g in got]
    variants = [sorted(map(tuple, g[1].collect())) for g in got]
    assert all(c == calls[0] for c in calls) and all(v == variants[0] for v in variants) and all(g[2] == names for g in got)
    assert len(calls[0]) == sum(int((d != 0).sum()) for *_, d in records)


def test_written_files_are_whole(spark, tmp_path):
    lines = spark.createDataFrame([(f"row {i}",) for i in range(1000)], "value string").repartition(3)
    told = [r["path"] for r in dataset.write_blocks(lines, "head\n", str(tmp_path / "b")).collect()]
    assert len(told) == 3
    texts = [gzip.open(io.BytesIO(open(p, "rb").read()), "rt").read().splitlines() for p in told]
    assert all(t[0] == "head" for t in texts) and sorted(x for t in texts for x in t[1:]) == sorted(f"row {i}" for i in range(1000))


def test_a_header_in_pieces(spark, tmp_path):
    """Names are written by ranges, in order, and each file begins with all of them."""
    named = spark.range(1000).selectExpr("999 - id AS ordinal", "concat('S', 999 - id) AS name").repartition(5)
    pieces, size = dataset.name_pieces(named, str(tmp_path / "n"))
    names = "".join(f"\tS{i}" for i in range(1000)).encode()
    assert b"".join(open(p, "rb").read() for p in pieces) == names and size == len(names)
    text = spark.createDataFrame([("x" * 200_000,), ("y",)], "value string").coalesce(1)
    (told,) = dataset.write_blocks(text, [b"head", *pieces, b"\n"], str(tmp_path / "b")).collect()
    assert gzip.decompress(open(told["path"], "rb").read()) == b"head" + names + b"\n" + b"x" * 200_000 + b"\ny\n"


@pytest.mark.parametrize("step", [1, 5, 1 << 20])
def test_lines_by_ranges_of_bytes(step):
    for text in TEXTS:
        want = text.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for each in (1, 2, 7, 100, 5000):
            assert _split(text, each, lambda lo, hi: lines.owned(_File(text), len(text), lo, hi, step)) == want, (text[:20], step, each)


def test_numbered_lines(spark, tmp_path):
    text = [f"row {i}" for i in range(3000)]
    (tmp_path / "t").write_text("\n\n".join(text) + "\n  \n")
    got = lines.numbered(spark, str(tmp_path / "t"), 1000).collect()
    assert {r["number"]: r["value"] for r in got} == dict(enumerate(text)) and len(got) == 3000
