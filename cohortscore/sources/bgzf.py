"""Block-compressed files (BGZF): read by ranges of blocks, each by a task of its own.

Such a file is a chain of small gzip members, each of which tells its own size in an extra field.  So a reader
may start at any block, and blocks can be found again from any byte: a block's head is a rare pattern, and it
leads from block to block.  A range of bytes owns the blocks that start in it; a text line belongs to the range
that owns the block it starts in, and its reader goes on into the blocks beyond until the line ends.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: The head of a block up to its extra field's length, the subfield that holds its size, and the empty block at the end.
HEAD, SIZE = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
EMPTY = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: A block's size, compressed or not, is at most this.
MOST = 1 << 16


def block_size(head: bytes) -> int | None:
    """Whole size of the block that starts so, or None if none does (or the head is cut off)."""
    if len(head) < 18 or head[:4] != HEAD:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, stop = 12, 12 + extra
    while at + 4 <= min(stop, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 4] == SIZE and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def inflate(block: bytes) -> bytes:
    """A whole block's data; damage raises."""
    extra = struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[12 + extra : -8], -15)
    crc, n = struct.unpack_from("<II", block, len(block) - 8)
    if len(data) != n or zlib.crc32(data) != crc:
        raise ValueError("a block is damaged")
    return data


def deflate(data: bytes, level: int = 6) -> bytes:
    """One block of at most 65,280 bytes of data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return HEAD + bytes(5) + b"\xff" + struct.pack("<H", 6) + SIZE + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, step: int = 65_280) -> bytes:
    return b"".join(deflate(data[i : i + step]) for i in range(0, len(data), step)) + EMPTY


class Blocks:
    """Blocks of a random-access file, in order, from the first that starts at or after a byte."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def first(self, at: int) -> int:
        """Where the first block at or after ``at`` starts (the file's size if none does): its size must lead to another block, or the end."""
        if at == 0:
            return 0
        while at < self.size:
            held = self.file.read_at(min(2 * MOST, self.size - at), at)
            here = held.find(HEAD)
            while here >= 0:
                if (n := block_size(held[here : here + 64])) is not None:
                    after = at + here + n
                    if after == self.size or (after < self.size and block_size(self.file.read_at(min(64, self.size - after), after)) is not None):
                        return at + here
                here = held.find(HEAD, here + 1)
            at += max(len(held) - 64, 1) if at + len(held) < self.size else len(held)
        return self.size

    def read(self, start: int, ahead: int = 1 << 22) -> Iterator[tuple[int, bytes]]:
        """(place, data) of every block from ``start`` on; compressed bytes are fetched in long reads."""
        held, base, at = b"", start, 0
        while base + at < self.size:
            n = block_size(held[at : at + 64])
            if n is None or at + n > len(held):
                if base + len(held) >= self.size:
                    raise ValueError("the file ends within a block, or is not block-compressed")
                base, held, at = base + at, held[at:], 0
                held += self.file.read_at(min(ahead, self.size - base - len(held)), base + len(held))
                continue
            yield base + at, inflate(held[at : at + n])
            at += n


def open_file(path: str):
    import pyarrow.fs

    fs, p = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs.open_input_file(p)


def is_bgzf(path: str) -> bool:
    with open_file(path) as f:
        return block_size(f.read(64)) is not None


def lines_of(blocks: Blocks, lo: int, hi: int) -> Iterator[bytes]:
    """The lines of the range of bytes lo to hi.

    A range cannot see whether its first block goes on with a line, so it leaves out everything up to its first line
    break, but for the file's first range.  In turn it reads on beyond its last block until the line is complete
    that has begun by then, be it at the very end.
    """
    start, skip, tail = blocks.first(lo), lo > 0, []  # tail: the pieces of the line that has begun
    if start >= hi:
        return
    for place, data in blocks.read(start):
        if place >= hi and skip:
            return  # one long line covers the whole range
        cut = data.find(b"\n") if place >= hi or skip else 0
        if cut < 0:
            if not skip:
                tail.append(data)
            continue
        if place >= hi:
            yield b"".join([*tail, data[:cut]])
            return
        if skip:
            data, skip = data[cut + 1 :], False
        first, *more = data.split(b"\n")
        tail.append(first)
        if more:
            yield b"".join(tail)
            yield from more[:-1]
            tail = more[-1:]
    if any(tail):
        yield b"".join(tail)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("bytesPerPartition", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        with open_file(self.path) as f:
            size = f.size()
            if size and block_size(f.read(64)) is None:
                raise ValueError(f"{self.path} is not block-compressed")
        return [InputPartition((lo, min(size, lo + self.each))) for lo in range(0, size, self.each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        with open_file(self.path) as f:
            for line in lines_of(Blocks(f, f.size()), *partition.value):
                out.append(line.removesuffix(b"\r"))
                held += len(line)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


class BgzfText(DataSource):
    """``spark.read.format("bgzftext").load(path)``: lines, as ``spark.read.text`` has them, by ranges of blocks."""

    @classmethod
    def name(cls) -> str:
        return "bgzftext"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
