"""Line dedup: repeated runs of lines, found by a suffix array over line ids; later copies go.

DataFrame functions only.  The sequence is the documents' line ids, a break after each document.
Lines that occur once are breaks too: no repeat crosses them.  Suffixes start with the rank of
their line among all repeated lines; a round of prefix doubling splits every class of equal ranks
by the rank 2^k lines on, so that ranks order suffixes by their first 2^(k+1) lines.  A rank is the
first place of its class in the suffix array, and the array is kept by classes.

From each position the run reaches as many lines as make up ``min_chars``.  Neighbours in the array
are compared line by line: their longest common prefix.  Where it is shorter than the run, a new
interval of the array starts; the suffixes of an interval share their run.  The first position of an
interval stays, the others are later copies.  Their union gives the maximal repeated runs that are
deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, stored

MIN_CHARS = 20
RANGE = 1 << 16  # ranks that a window over successors holds at most
PLACES = 1 << 13  # places of the suffix array that a window over neighbours holds at most


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines ``doc, pos, h1, h2, need``; doc: id and a hash of the text (a null id equals itself so); need: lines from here that hold min_chars (null if the text ends before)."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    d = d.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    d = d.withColumn("lens", F.transform("lines", lambda x: F.length(x) + 1))
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        return F.when(a["chars"] >= min_chars + 1, a).otherwise(F.struct((a["chars"] + x).alias("chars"), (a["n"] + 1).alias("n")))

    def need(i: Column) -> Column:
        got = F.aggregate(F.slice("lens", i + 1, F.lit(min_chars + 1)), zero, step)
        return F.when(F.get("lens", i) >= min_chars + 1, F.lit(1)).otherwise(F.when(got["chars"] >= min_chars + 1, got["n"]))

    cells = F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x, F.length(x)).alias("h2"), need(i).alias("need")))
    return d.select(F.struct("doc_id", "th").alias("doc"), F.posexplode(cells).alias("pos", "x")).select("doc", "pos", "x.h1", "x.h2", "x.need")


def _ranked(lines: DataFrame) -> DataFrame:
    """Repeated lines only, with ``line, rank``: their line's first place among all repeated lines, by id.

    ``reach``: so many repeated lines follow each other from here; ``need`` is null if these are too few.
    """
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    ids = stored(ids.withColumn("bucket", F.shiftrightunsigned("h1", 64 - 12).cast("int")), "line-ids")
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = ids.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.join(F.broadcast(base), "bucket").select("h1", "h2", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("line"))  # base: at most 4096 rows
    s = lines.join(ids, ["h1", "h2"]).select("doc", "pos", "need", "line").dropDuplicates(["doc", "pos"])
    s = s.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    s = s.withColumn("reach", F.max("pos").over(Window.partitionBy("doc", "island")) - F.col("pos") + 1)
    return s.select("doc", "pos", F.when(F.col("need") <= F.col("reach"), F.col("need")).alias("need"), "reach", "line", F.col("line").alias("rank"))


def _ahead(column: str, lines: int) -> Column:
    """The value so many lines on, null if that line is a break."""
    at = Window.partitionBy("doc").orderBy("pos").rangeBetween(lines, lines)
    return F.max(column).over(at)


def suffix_array(suffixes: DataFrame, depth: int) -> DataFrame:
    """Sets ``rank`` to the first place, in the array of all suffixes, of those that share ``depth`` lines with this one.

    Stops early when a round splits no class: then no later one does.
    """
    s = suffixes
    k, classes = 1, s.select(F.count_distinct("rank")).first()[0]
    while k < depth:
        ahead = F.when(F.col("reach") > k, _ahead("rank", k))
        s = s.withColumn("next", F.coalesce(ahead, F.lit(-1).cast("long")))
        pairs = stored(s.groupBy("rank", "next").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("next") / RANGE).cast("long")), f"pairs-{2 * k}")
        # A common line has successors without number: they are summed by ranges, then within one.
        ranges, first = Window.partitionBy("rank").orderBy("range"), Window.unboundedPreceding
        base = pairs.groupBy("rank", "range").agg(F.sum("n").alias("n")).select("rank", "range", F.coalesce(F.sum("n").over(ranges.rowsBetween(first, -1)), F.lit(0)).alias("base"))
        inside = Window.partitionBy("rank", "range").orderBy("next").rowsBetween(first, -1)
        split = pairs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, ["rank", "range"])
        # Stored, so that the join is dealt by both columns, and AQE can split a hot pair's rows.
        split = stored(split.select("rank", "next", (F.col("rank") + F.col("base") + F.col("inside")).alias("new")), f"split-{2 * k}")
        s = s.join(split, ["rank", "next"]).select("doc", "pos", "need", "reach", "line", F.col("new").alias("rank"))
        s = stored(s, f"suffixes-{2 * k}")
        k, now = 2 * k, s.select(F.count_distinct("rank")).first()[0]
        if now == classes:
            break
        classes = now
    return s


def _common(a: Column, b: Column) -> Column:
    """How many lines two lists share from the start; none with a list that is null."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(other > 0, other - 1).when(other == 0, F.size(b)).otherwise(0).cast("int")


def lcp_array(array: DataFrame, depth: int) -> DataFrame:
    """The suffix array by classes, of the suffixes that reach their ``need``: ``bucket, rank, first, n, need, lcp``.

    ``first``: the class's first position; ``n``: its suffixes; ``lcp``: lines (of those needed) shared with
    the class before, which is in the bucket before for a bucket's first class.
    """
    ahead = Window.partitionBy("doc").orderBy("pos").rangeBetween(0, depth - 1)
    s = array.withColumn("lines", F.slice(F.collect_list("line").over(ahead), 1, F.col("need"))).where(F.col("need").isNotNull())
    # All suffixes of a class share the lines they need.
    c = s.groupBy("rank").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n"), F.first("lines").alias("lines"))
    c = stored(c.withColumn("bucket", F.floor(F.col("rank") / PLACES).cast("long")), "classes")
    last = c.groupBy("bucket").agg(F.max_by("lines", "rank").alias("last"))
    last = last.select("bucket", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("bucket")).alias("last"))
    before = F.coalesce(F.lag("lines").over(Window.partitionBy("bucket").orderBy("rank")), F.col("last"))
    return c.join(last, "bucket").select("bucket", "rank", "first", "n", F.size("lines").alias("need"), _common(before, F.col("lines")).alias("lcp"))


def lcp_intervals(lcps: DataFrame) -> DataFrame:
    """``rank, interval, first, n``: an interval, named by its first rank, goes on while neighbours share the lines they need."""
    c = lcps.withColumn("head", F.when(F.col("lcp") < F.col("need"), F.col("rank")))
    first = Window.unboundedPreceding
    over = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(first, -1)
    open_ = c.groupBy("bucket").agg(F.max("head").alias("head")).select("bucket", F.max("head").over(over).alias("open"))
    here = F.max("head").over(Window.partitionBy("bucket").orderBy("rank").rowsBetween(first, 0))
    return c.join(open_, "bucket").select("rank", F.coalesce(here, F.col("open")).alias("interval"), "first", "n")


def later_copies(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, runs``: of each document that has any, the maximal runs (from, to) of lines to delete."""
    suffixes = stored(_ranked(_lines(docs, min_chars)), "repeated")
    depth = suffixes.agg(F.max("need")).first()[0] or 1
    array = suffix_array(suffixes, depth)
    # Stored, so that the joins below read plain exchanges, whose hot keys AQE splits.
    intervals = stored(lcp_intervals(stored(lcp_array(array, depth), "lcp")), "intervals")
    kept = intervals.groupBy("interval").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where(F.col("n") > 1).drop("n")
    kept = stored(intervals.join(stored(kept, "kept"), "interval").select("rank", "kept"), "copies")
    late = array.join(kept, "rank").where(F.struct("doc", "pos") != F.col("kept")).select("doc", "pos", (F.col("pos") + F.col("need")).alias("to"))
    doc = Window.partitionBy("doc").orderBy("pos")
    far = F.max("to").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    new = (far.isNull() | (F.col("pos") > far)).cast("int")
    run = late.withColumn("new", new).withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.groupBy("doc", "run").agg(F.min("pos").alias("from"), F.max("to").alias("to"))
    return run.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def _deleted(docs: DataFrame, min_chars: int) -> tuple[DataFrame, str, str, str, str]:
    """``docs`` with the text that is left, lines, removed lines and spans in columns of fresh names."""
    key, runs_, cut_, n_, gone_, spans_ = fresh(docs, "doc_key", "runs", "left", "n_lines", "n_removed", "n_spans")
    found = later_copies(docs, min_chars).select(F.col("doc").alias(key), F.col("runs").alias(runs_))
    text = F.col("text").cast("string")
    d = docs.join(found, F.struct(F.col("doc_id"), F.xxhash64(text).alias("th")) == F.col(key), "left")
    lines = F.split(text, "\n")
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines))
    stops = F.transform(runs_, lambda r, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(runs_, i - 1)["to"]).alias("a"), r["from"].alias("b")))
    tail = F.array(F.struct(F.element_at(runs_, -1)["to"].alias("a"), F.size(lines).alias("b")))
    kept = F.flatten(F.transform(F.concat(stops, tail), lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))
    cut = F.when(F.col(runs_).isNull(), text).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.aggregate(runs_, F.lit(0), lambda s, r: s + r["to"] - r["from"]), F.lit(0))
    spans = F.coalesce(F.size(runs_), F.lit(0))
    return d.withColumns({cut_: cut, n_: n.cast("long"), gone_: gone.cast("long"), spans_: spans.cast("long")}), cut_, n_, gone_, spans_


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with later copies of repeated line runs deleted from ``text``.

    Adds ``n_lines, n_removed, n_spans`` (in place of columns of these names).  A run is a repeat if
    its lines, joined by newlines, have ``min_chars`` characters; documents are ordered by doc_id (null
    first), then by a hash of the text.  Lines are compared by two 64-bit hashes.  Very long texts are
    lines like others: no array grows beyond a document's own lines.  Null text stays null and has no lines; the empty text is one
    empty line.  Rows that repeat both doc_id and text are one document: each of them gets its result.
    All other columns stay as they are; an empty table gives no rows.
    """
    d, cut, n, gone, spans = _deleted(docs, min_chars)
    counts = {"n_lines": n, "n_removed": gone, "n_spans": spans}
    keep = [F.col(cut).alias(c) if c == "text" else col(c) for c in docs.columns if c.lower() not in counts]
    return d.select(*keep, *[F.col(c).alias(name) for name, c in counts.items()])


def kept_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The deduplicated documents with the columns of ``docs``; those of which only blanks are left go."""
    d, cut, _, gone, _ = _deleted(docs, min_chars)
    d = d.where((F.col(gone) == 0) | F.col(cut).rlike(r"\S"))
    new = {"text": F.col(cut).alias("text"), "n_chars": F.length(cut).cast("long").alias("n_chars")}
    return d.select(*[new.get(c, col(c)) for c in docs.columns])


def oracle_sql(min_chars: int = MIN_CHARS) -> str:
    """DuckDB: every position's run of lines as a string; its later occurrences are deleted."""
    return f"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs WHERE text IS NOT NULL),
c AS (SELECT *, CAST(length(line) + 1 AS BIGINT) AS len, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS c1 FROM l),
e AS (SELECT *, min(pos) OVER (PARTITION BY doc_id ORDER BY c1 RANGE BETWEEN greatest({min_chars} + 1 - len, 0) FOLLOWING AND UNBOUNDED FOLLOWING) AS last FROM c),
r AS (SELECT e.doc_id, pos, last, array_to_string(list_slice(d.lines, pos, last), chr(10)) AS run FROM e JOIN docs d USING (doc_id) WHERE last IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM r),
dead AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM w WHERE nth > 1),
k AS (SELECT l.doc_id, l.pos, l.line, dead.pos IS NOT NULL AS gone FROM l LEFT JOIN dead ON l.doc_id = dead.doc_id AND l.pos = dead.pos),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM k)
SELECT d.doc_id, count(s.pos) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY s.pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM docs d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
