"""Fill-in-middle: a document's middle moves to its end, cut at token starts, by overlapping chunks.

A token is a run of ASCII letters or any other code point, so whether one starts at a place depends on
two adjacent characters only.  A text is taken in chunks of bytes that overlap by the byte before them;
each chunk counts its token starts by an expression over the whole chunk.  Prefix sums over the counts
tell which chunk owns a cut rank, and only the two owning chunks are scanned again for the places.
Documents are rows: Spark deals them out, and a row's chunks are counted where the row lies, since its
output is one string anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import col

CHUNK = 1 << 16
#: Bytes of text that one batch of results holds, or a single longer document.
BATCH = 8 << 20
#: The marks of the three parts, and the shares of a hundred that are transformed, and suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20

#: Of a byte of UTF-8: 0 goes on with a code point, 1 is a letter, 2 starts any other code point.
_KIND = np.array([1 if chr(b).isascii() and chr(b).isalpha() else 0 if 0x80 <= b < 0xC0 else 2 for b in range(256)], np.uint8)


def token_starts(text: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether a token starts at each of the bytes ``lo`` to ``hi``; looks at the byte before ``lo`` too."""
    kind = _KIND[text[max(lo - 1, 0) : hi]]
    starts = kind != 0
    starts[1:] &= (kind[1:] != 1) | (kind[:-1] != 1)
    return starts if lo == 0 else starts[1:]


def chunk_counts(text: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Token starts in each chunk."""
    return np.array([np.count_nonzero(token_starts(text, lo, lo + chunk)) for lo in range(0, len(text), chunk)], np.int64)


def place(text: np.ndarray, counts: np.ndarray, rank: int, chunk: int = CHUNK) -> int:
    """The byte where token ``rank`` starts, or the end: one chunk is scanned, the one that owns the rank."""
    ends = np.cumsum(counts)
    own = int(np.searchsorted(ends, rank, side="right"))
    if own == len(ends):
        return len(text)
    inside = rank - int(ends[own] - counts[own])
    return own * chunk + int(np.flatnonzero(token_starts(text, own * chunk, (own + 1) * chunk))[inside])


def characters(text: np.ndarray, chunk: int = CHUNK) -> int:
    return sum(np.count_nonzero(_KIND[text[lo : lo + chunk]]) for lo in range(0, len(text), chunk))


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits for a document; a null id is spelled as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def moved(raw: bytes, doc_id: int | None, seed: int = 1, chunk: int = CHUNK) -> tuple[bytes, int, str, int | None, int | None]:
    """Output, tokens, form, and the code points of prefix and middle (None if plain)."""
    text = np.frombuffer(raw, np.uint8)
    counts = chunk_counts(text, chunk)
    n = int(counts.sum())
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= TRANSFORMED or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return raw, n, "plain", None, None
    a, b = (place(text, counts, rank, chunk) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), n, "spm", characters(text[:a], chunk), characters(text[a:b], chunk)
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), n, "psm", characters(text[:a], chunk), characters(text[a:b], chunk)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, chunk: int = CHUNK, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fim_text, fim_form, n_tokens, prefix_chars, middle_chars`` (columns of these names are replaced).

    Null text counts as empty, and empty text is plain; so is text that holds one of the marks, which keeps the
    output reversible.  A null id draws as an id without digits; rows that repeat id and text get equal results, as each
    row is looked at alone (there are no ties).  Very long texts are cut whole, by chunks.  All other columns stay as
    they are, or those that ``carry`` names; an empty table gives no rows.
    """
    added = ("fim_text", "fim_form", "n_tokens", "prefix_chars", "middle_chars")
    kept = [c for c in docs.columns if c.lower() not in added] if carry is None else carry
    others = [col(c) for c in kept if c != text_col] or [F.lit(None).cast("string").alias("none")]
    # The text travels once, beside the other columns.
    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"), F.struct(*others).alias("row"))
    back = [StructField("text", StringType())] if text_col in kept else []
    schema = StructType([source.schema["row"], *back, *[StructField(n, StringType() if n in added[:2] else LongType()) for n in added]])
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size, first, raws = [], 0, 0, b.column(1).cast(pa.binary())
            for i, (key, raw) in enumerate(zip(b.column(0).to_pylist(), raws, strict=True)):
                text, n, form, prefix, middle = moved(raw.as_py() or b"", key, seed, chunk)
                out.append((text, form, n, prefix, middle))
                size += len(text)
                if size >= BATCH or i + 1 == b.num_rows:
                    columns = [pa.array(v, kinds[k]) for k, v in enumerate(zip(*out, strict=True))]
                    slices = [b.column(2).slice(first, len(out)), *([b.column(1).slice(first, len(out))] if back else [])]
                    yield pa.RecordBatch.from_arrays([*slices, *columns], names=schema.names)
                    out, size, first = [], 0, i + 1

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept], *added)


def restored(text: Column, form: Column) -> Column:
    """The text as it was before; parts never hold a mark, so splitting at the marks is exact."""
    parts = F.split(text, "<[PSM]>", -1)
    first, second, middle = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """Of each document: tokens, form, lengths of the parts, and digests of the output and of the text rebuilt from it."""
    done = transform(docs, carry=["doc_id"])
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select(
        "doc_id", F.col("n_tokens").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars",
        sha(F.col("fim_text")).alias("output_sha256"), sha(restored(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    """DuckDB: the list of tokens of each whole text, cut and put together again."""
    h = [f"CAST('0x' || substr(h, {i}, 8) AS BIGINT)" for i in (1, 9, 17, 25)]
    join = "coalesce(array_to_string(list_slice(tokens, {}, {}), ''), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, len(tokens) AS n, least({h[0]} % (len(tokens) + 1), {h[1]} % (len(tokens) + 1)) AS a, greatest({h[0]} % (len(tokens) + 1), {h[1]} % (len(tokens) + 1)) AS b FROM d),
p AS (SELECT *, {join.format(1, 'a')} AS prefix, {join.format('a + 1', 'b')} AS middle, {join.format('b + 1', 'n')} AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h[2]} % 100 >= {TRANSFORMED} THEN 'plain'
    WHEN {h[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
