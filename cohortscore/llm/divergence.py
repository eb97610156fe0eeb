"""Source divergence audit: how the sources of a language differ in the words that the language keeps.

Two passes.  The first counts document frequencies exactly, and leaves the texts behind in chunks of
bounded size, words lower-cased and set apart by single spaces.  The second counts occurrences: a few chunks
meet those of their words that the language keeps, an Aho-Corasick automaton over them, each padded by
the space on either side, runs over the chunks' texts.  An automaton thus holds some chunks' words at most,
however large the vocabulary is.

Groups (lang, source) then are sparse postings of shares.  A pair's distance over all kept words is what
two groups without any word would have, corrected at the words of either (sorted sums) and at the words of
both; sources meet in tiles and words in blocks, so no task holds a whole language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_DOCS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
#: Bytes of text in a chunk, and in one row of its texts (or one document).
CHUNK, ROW = 16 << 20, 1 << 20
#: Chunks that share an automaton; counts that a task holds before it passes them on; sources in a tile; postings in a block of words.
SHARED, HELD, TILE, BLOCK = 4, 1_000_000, 128, 1 << 16

#: Bytes of UTF-8 text: A-Z become a-z, all ASCII but letters becomes a space.
_WORDS = bytes((b | 0x20 if chr(b).isalpha() else 0x20) if b < 0x80 else b for b in range(256))
_PREPARED = "chunk long, lang string, source string, body binary, term string, df long"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def prepare(docs: DataFrame, chunk: int = CHUNK, row: int = ROW) -> DataFrame:
    """The first pass, as a table: ``chunk, lang, source, body`` (texts) and ``chunk, lang, term, df`` (documents of the chunk that have the term)."""
    names = ["chunk", "lang", "source", "body", "term", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        texts: dict[tuple[str, str], list[bytes]] = {}
        sizes: Counter = Counter()
        seen: dict[str, Counter] = {}

        def body(group: tuple[str, str]) -> pa.RecordBatch:
            sizes.pop(group, None)
            values = [number], [group[0]], [group[1]], [packed(b" ".join([b"", *texts.pop(group), b""]))], [None], [None]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()), strict=True)], names=names)

        def terms(lang: str, found: list[bytes], df: list[int]) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array([lang] * n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array(found, pa.string()), pa.array(df, pa.int64())], names=names)

        def finish() -> Iterator[pa.RecordBatch]:
            for group in list(texts):
                yield body(group)
            for lang, counted in seen.items():
                found, df = list(counted), list(counted.values())
                for lo in range(0, len(found), 1 << 16):
                    yield terms(lang, found[lo : lo + (1 << 16)], df[lo : lo + (1 << 16)])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                group, found = (lang, source), words(text.as_py())
                seen.setdefault(lang, Counter()).update(set(found))
                joined = b" ".join(found)
                texts.setdefault(group, []).append(joined)
                sizes[group] += len(joined)
                size += len(joined) + 64
                if sizes[group] >= row:
                    yield body(group)
                if size >= chunk:
                    yield from finish()
                    number, size, seen = number + 1, 0, {}
        yield from finish()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return stored(docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, _PREPARED), "divergence-texts")


def kept_terms(prepared: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, term``: terms of at least so many documents of the language."""
    found = prepared.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    return stored(found.select("lang", "term"), "kept-terms")


def occurrences(prepared: DataFrame, kept: DataFrame, held: int = HELD, shared: int = SHARED) -> DataFrame:
    """The second pass, as a table: ``lang, source, term, n``, how often each kept term occurs in a group.

    About ``shared`` chunks of a language go together: their kept terms, each once, come before their texts in the
    order of one sorted exchange, and what they count is added up before it is exchanged.
    """
    units = max(1, -(-prepared.select(F.count_distinct("chunk")).first()[0] // shared))
    unit = F.pmod(F.xxhash64("chunk"), F.lit(units)).cast("int").alias("unit")
    terms = prepared.where(F.col("term").isNotNull()).select(unit, "lang", "term").join(kept, ["lang", "term"], "left_semi").distinct()
    terms = terms.select("unit", "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("body"), "term")
    bodies = prepared.where(F.col("body").isNotNull()).select(unit, "lang", "source", "body", F.lit(None).cast("string").alias("term"))
    dealt = terms.unionByName(bodies).repartition("unit", "lang").sortWithinPartitions("unit", "lang", F.col("body").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, own, automaton = None, [], None
        counts: dict[tuple[str, str], Counter] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "source", "term", "n"])

        for b in batches:
            for unit, lang, source, body, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
                if (unit, lang) != at:
                    at, own, automaton = (unit, lang), [], None
                if term is not None:
                    own.append(term)
                    continue
                if not own:
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for word in own:
                        automaton.add_word(f" {word} ", word)
                    automaton.make_automaton()
                found = counts.setdefault((lang, source), Counter())
                before = len(found)
                found.update(map(itemgetter(1), automaton.iter(unpacked(body.as_py()).decode())))
                size += len(found) - before
                if size >= held:
                    yield from told()
                    counts, size = {}, 0
        yield from told()

    parts = dealt.mapInArrow(run, "lang string, source string, term string, n long")
    return stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "occurrences")


def packed(body: bytes) -> bytes:
    """A text with its length before it, compressed."""
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT (n + SMOOTH) / (total + SMOOTH v)), in integers that hold any count; 0 where nothing is kept."""
    wide = lambda c: c.cast("decimal(18,0)")
    over = wide(total) + F.lit(SMOOTH) * wide(v)
    exact = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + F.lit(SMOOTH)), over)
    return F.when(v > 0, exact + 1).otherwise(F.lit(0).cast("long"))


def tile_distances(postings: pd.DataFrame, sides: pd.DataFrame, i: int, j: int, first: bool) -> pd.DataFrame:
    """``a, b, part`` for sources of tile i against those of tile j over one block of terms.

    ``postings`` (ix, term, p) and ``sides`` (ix, tile, z, v); ``first`` adds what no block's terms decide.
    """
    place = {}
    names, zs = [], []
    for t in (i, j):
        s = sides[sides["tile"] == t].sort_values("ix")
        names.append(s["ix"].to_numpy())
        zs.append(s["z"].to_numpy())
        place[t] = {x: k for k, x in enumerate(s["ix"])}
    za, zb = zs
    apart = np.abs(za[:, None] - zb[None, :])
    out = apart * int(sides["v"].iloc[0]) if first else np.zeros_like(apart)
    if len(postings):
        code = pd.factorize(postings["term"])[0]
        tile, ix, p = postings["tile"].to_numpy(), postings["ix"].to_numpy(), postings["p"].to_numpy()
        cells = []
        for t in (i, j):
            of = np.flatnonzero(tile == t)
            of = of[np.argsort(code[of], kind="stable")]
            cells.append((np.array([place[t][x] for x in ix[of]], np.int64), code[of], p[of]))
        (ga, ca, pa_), (gb, cb, pb) = cells
        out += alone(ga, pa_, za, zb)
        out += alone(gb, pb, zb, za).T
        for term in np.intersect1d(ca, cb):
            x, y = slice(*np.searchsorted(ca, [term, term + 1])), slice(*np.searchsorted(cb, [term, term + 1]))
            at = np.ix_(ga[x], gb[y])
            u, w = pa_[x][:, None], pb[y][None, :]
            out[at] += np.abs(u - w) + apart[at] - np.abs(u - zb[gb[y]][None, :]) - np.abs(za[ga[x]][:, None] - w)
    a, b = np.broadcast_arrays(names[0][:, None], names[1][None, :])
    flat = pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "part": out.ravel()})
    if i != j:
        flat = pd.concat([flat, flat.rename(columns={"a": "b", "b": "a"})])
    return flat[flat["a"] != flat["b"]]


def alone(group: np.ndarray, p: np.ndarray, z: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sum over each group's terms of |p - z of the other| - |z - z of the other|, for all others: sorted shares and their running sums."""
    out = np.zeros((len(z), len(others)), np.int64)
    for g in np.unique(group):
        own = np.sort(p[group == g])
        sums = np.concatenate([[0], np.cumsum(own)])
        below = np.searchsorted(own, others)
        out[g] = others * below - sums[below] + (sums[-1] - sums[below]) - others * (len(own) - below) - np.abs(z[g] - others) * len(own)
    return out


def pair_distances(counts: DataFrame, groups: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``lang, source, item, value``: the distance of every two sources of a language over all its kept terms.

    ``groups`` (lang, source, total, v) names every group; ``counts`` are the terms' occurrences there.
    """
    ix = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    named = groups.select("lang", "source", "total", "v", ix.alias("ix")).withColumn("tile", F.floor(F.col("ix") / tile).cast("int"))
    named = named.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1).withColumn("z", share(F.lit(0), F.col("total"), F.col("v")))
    named = stored(named, "sources")
    blocks = max(1, -(-counts.count() // block))
    i, j = F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j")
    met = named.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))  # a tile meets every tile, itself included
    p = counts.join(met, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    postings = p.select("lang", i, j, F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "ix", "tile", "term", "p")
    sides = met.select("lang", i, j, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ix", "tile", "z", "v").toDF("lang", "i", "j", "block", "ix", "tile", "z", "v")
    key = ["lang", "i", "j", "block"]

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = tile_distances(left, right, k[1], k[2], k[3] == 0)
        return got.assign(lang=k[0])[["lang", "a", "b", "part"]]

    parts = postings.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(run, "lang string, a int, b int, part long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    own, other = named.select("lang", F.col("ix").alias("a"), "source"), named.select("lang", F.col("ix").alias("b"), F.col("source").alias("item"))
    return sums.join(own, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", "item", "value")


def term_excess(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: terms of a group whose share there exceeds the language's, and by how much."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    everywhere = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_all"))
    at = counts.join(everywhere, ["lang", "term"]).join(groups, ["lang", "source"]).join(whole, "lang")
    over = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("n_all"), F.col("all"), F.col("v"))
    return at.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where(F.col("value") > 0)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's other sources (part ``pair``), farthest first, and
    its most excessive terms (part ``term``, ranks to ``top``).

    Null text, lang or source count as ''.  Groups without a word, and languages that keep no term, have pairs like
    others (of distance 0, if nothing is kept); a language of one source has none.  Very long texts are rows and
    chunks of their own; repeated rows count as often as they occur; ties in value go by the item's UTF-8 bytes.
    Other columns are not read, whatever their names; an empty table gives no rows.
    """
    prepared = prepare(docs, chunk)
    kept = kept_terms(prepared, least)
    counts = occurrences(prepared, kept)
    groups = prepared.where(F.col("body").isNotNull()).select("lang", "source").distinct()
    totals, sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = stored(groups, "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(found: DataFrame, part: str, most: int | None = None) -> DataFrame:
        r = found.withColumn("rank", F.row_number().over(order))
        return (r if most is None else r.where(F.col("rank") <= most)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pair_distances(counts, groups), "pair").unionByName(ranked(term_excess(counts, groups), "term", top))


def oracle_sql(least: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB: every kept term in every group, and all pairs of groups term by term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= {least}),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
w AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
q AS (SELECT c.lang, c.term, 1 + (CAST({UNIT} AS HUGEINT) * (sum(c.n) + {SMOOTH})) // (any_value(w.total) + {SMOOTH} * any_value(v.v)) AS q FROM counts c JOIN w USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(s.total, 0) + {SMOOTH} * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over) AS u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""
