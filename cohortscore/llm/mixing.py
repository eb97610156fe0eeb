"""Mixing sources to target weights by Sainte-Lague apportionment.

DataFrame operations only.  Words are apportioned in equal blocks: first to the sources by
their targets, then within each source to its shards by their sizes, always by the highest
quotients size / (2 k + 1).  A shard lays its documents in a seeded order; its quota of blocks
is so many full passes and a seeded run of blocks, around the end if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, stored

WORD = r"[^\x20\x09-\x0D]+"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WEIGHTS = (3.0, 1.0, 2.0)


def seeded(*parts: Column) -> Column:
    """A 60-bit hash of values as text (nulls are skipped), one that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Number of words, without an array of them."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACE, "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to ``key, source, source_size, n_docs``: one row a source.

    ``share`` of all sizes is dealt by weight; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight, until none is above (water filling: in the order
    of size to weight, the first level that its source's limit reaches).
    Sources take the weights in turn, by code point, null last.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("limit", F.lit(most) * F.col("source_size"))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "key")
    every = Window.partitionBy(F.lit(0))
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    lv = w.withColumn("level", level).withColumn("place", F.row_number().over(filled))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))).over(every)
    lv = lv.withColumn("first", first)
    return lv.select("key", "source", "source_size", "n_docs", F.coalesce(F.least("limit", F.col("first.level") * F.col("weight")), F.col("limit")).alias("target"))


def sainte_lague(parties: DataFrame, within: list[str], party: list[str], weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each party, by the highest quotients weight / (2 k + 1).

    ``seats`` is the number to deal in each group ``within``.  All parties start from the rounding
    at the mean divisor, which is right for its own total; the seats that this total lacks or has
    too many come from the next (or last) quotients.  Moving n seats among m parties changes a
    party by at most weight * (n + m) / total + 1, so that many of its quotients are looked at.
    Ties go by ``party``.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_w", F.col(weight).cast("double")).withColumn("_total", F.sum("_w").over(group)).withColumn("_m", F.count("*").over(group))
    p = p.withColumn("_start", F.when(F.col("_total") > 0, F.floor(F.col("_w") * F.col(seats) / F.col("_total") + 0.5)).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("_lack", F.when(F.col("_total") > 0, F.col(seats) - F.sum("_start").over(group)).otherwise(F.lit(0)).cast("long"))
    reach = F.ceil(F.col("_w") * (F.abs("_lack") + F.col("_m")) / F.col("_total")).cast("long") + 1
    ks = F.when(F.col("_lack") > 0, F.sequence(F.col("_start"), F.col("_start") + reach - 1)).when(
        (F.col("_lack") < 0) & (F.col("_start") > 0), F.sequence(F.greatest(F.lit(0), F.col("_start") - reach), F.col("_start") - 1)
    )
    moved = p.where((F.col("_lack") != 0) & (F.col("_w") > 0)).select(*within, *party, "_w", "_lack", F.explode(ks).alias("_k")).withColumn("_q", F.col("_w") / (2 * F.col("_k") + 1))
    up = Window.partitionBy(*within, F.col("_lack") > 0) if within else Window.partitionBy(F.col("_lack") > 0)
    sign = F.when(F.col("_lack") > 0, -F.col("_q")).otherwise(F.col("_q"))
    tie = [F.when(F.col("_lack") > 0, F.col("_k")).otherwise(-F.col("_k"))]
    turn = F.row_number().over(up.orderBy(sign, *tie, *party))
    change = (
        moved.withColumn("_turn", turn).where(F.col("_turn") <= F.abs("_lack"))
        .groupBy(*within, *party).agg(F.sum(F.signum(F.col("_lack").cast("double"))).cast("long").alias("_change"))
    )
    joined = p.join(change, [*within, *party], "left").withColumn("quota", F.col("_start") + F.coalesce(F.col("_change"), F.lit(0)))
    return joined.drop("_w", "_total", "_m", "_start", "_lack", "_change")


def mix(
    docs: DataFrame,
    seed: int = 20,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block: int = 4,
    shard_docs: int = 20_000,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` and the words taken as runs.

    ``passes`` is how often the whole document is taken, ``runs`` (array of from, to; words counted
    from 0) what is taken besides; ``taken`` counts repeats and never exceeds twice the size.

    Null text has size 0 and is never taken; a null source is a source of its own, the last one.
    Repeated rows are documents of their own.  Empty tables give no rows.  A source has one shard
    for each ``shard_docs`` documents, by a hash of the id, so no window grows with a hot source.
    """
    sized = stored(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("th"))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("h", seeded(F.lit(seed), F.col("doc_id"))),
        "sizes",
    )
    by_source = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aims = targets(by_source, weights, share, most)
    every = Window.partitionBy(F.lit(0))
    aims = aims.withColumn("blocks", F.round(F.sum("target").over(every) / block).cast("long"))
    aims = sainte_lague(aims, [], ["key"], "target", "blocks").withColumnRenamed("quota", "source_blocks")
    aims = aims.select("key", "source_size", "target", "source_blocks", F.ceil(F.col("n_docs") / shard_docs).cast("long").alias("shards"))
    aims = stored(aims, "aims")
    d = sized.join(aims, "key").withColumn("shard", F.pmod("h", F.col("shards")))
    shards = d.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    quotas = sainte_lague(shards, ["key"], ["shard"], "shard_size", "source_blocks").withColumn(
        "quota_words", F.least(F.col("quota") * block, F.round(F.lit(most) * F.col("shard_size")).cast("long"))
    )
    quotas = quotas.select("key", "shard", "shard_size", "quota_words")
    line = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size")
    laid = d.withColumn("c1", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(quotas, ["key", "shard"])
    has = F.greatest("shard_size", F.lit(1))
    start = F.pmod(seeded(F.lit("start"), F.lit(seed), F.col("key"), F.col("shard")), F.floor((has - 1) / block) + 1) * block
    laid = (
        laid.withColumn("c0", F.col("c1") - F.col("size"))
        .withColumn("passes", F.floor(F.col("quota_words") / has).cast("long"))
        .withColumn("rest", F.col("quota_words") % has)
        .withColumn("start", start)
    )

    def run(a: Column, b: Column) -> Column:
        lo, hi = F.greatest("c0", a), F.least("c1", b)
        return F.struct((lo - F.col("c0")).alias("from"), (F.greatest(lo, hi) - F.col("c0")).alias("to"))

    runs = F.array(run(F.col("start") - F.col("shard_size"), F.col("start") + F.col("rest") - F.col("shard_size")), run(F.col("start"), F.col("start") + F.col("rest")))
    laid = laid.withColumn("runs", F.filter(runs, lambda x: x["to"] > x["from"]))
    partly = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + partly).alias("taken"), "passes", "runs", "th")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each full pass and each run of words.

    A run that is not the whole text is its words joined by blanks.  Rows that repeat both doc_id and
    text are taken together.  Documents of which nothing is taken go.
    """
    row, size, passes, runs, copies, taken, take = fresh(docs, "doc_key", "size", "passes", "runs", "copies", "taken", "take")
    m = mix(docs, **parameters)
    m = stored(
        m.groupBy(F.struct("doc_id", "th").alias(row), F.col("size").alias(size))
        .agg(F.sum("passes").alias(passes), F.flatten(F.collect_list("runs")).alias(runs), F.count("*").alias(copies), F.sum("taken").alias(taken)),
        "mix",
    )
    text = F.col("text").cast("string")
    here = F.struct(F.col("doc_id"), F.xxhash64(text).alias("th"))
    many = m.where(F.col(copies) > 1).select(row)
    if not many.isEmpty():
        once = docs.join(many, here == F.col(row), "left_semi").dropDuplicates(["doc_id", "text"])
        docs = docs.join(many, here == F.col(row), "left_anti").unionByName(once)
    d = docs.join(m.where(F.col(taken) > 0), here == F.col(row))
    whole = F.struct(F.lit(0).cast("long").alias("from"), F.col(size).alias("to"))
    d = d.withColumn(take, F.explode(F.concat(F.array_repeat(whole, F.col(passes).cast("int")), F.col(runs))))
    some = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first, last = F.col(take)["from"].cast("int"), F.col(take)["to"].cast("int")
    cut = F.when((first == 0) & (last == F.col(size)), text).otherwise(F.array_join(F.slice(some, first + 1, last - first), " "))
    new = {"text": cut.alias("text"), "n_chars": F.length(cut).cast("long").alias("n_chars")}
    return d.select(*[new.get(c, col(c)) for c in docs.columns])


def oracle_sql(seed: int = 20, share: float = 1.5, most: float = 2.0, block: int = 4, shard_docs: int = 20_000) -> str:
    """DuckDB: the same mix, with all quotients ranked instead of those near the rounding."""
    filled = "ORDER BY lim / weight, key"

    def hashed(*parts: str) -> str:
        return f"CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)) AS BIGINT)"

    return f"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  coalesce(concat('=', source), '') AS key, {hashed(f"'{seed}'", "CAST(doc_id AS VARCHAR)")} AS h FROM documents),
src AS (SELECT CASE WHEN source IS NULL THEN '' ELSE concat('=', source) END AS key, source, CAST(sum(size) AS BIGINT) AS z, count(*) AS nd FROM sized GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, {most}e0 * z AS lim FROM src),
lv AS (SELECT *, row_number() OVER ({filled}) AS place, ({share}e0 * sum(z) OVER () - coalesce(sum(lim) OVER ({filled} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({filled} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lam AS (SELECT arg_min(level, place) AS level FROM lv WHERE level * weight <= lim),
aims AS MATERIALIZED (SELECT key, z, CAST(ceil(nd / {shard_docs}e0) AS BIGINT) AS shards, coalesce(least(lim, lam.level * weight), lim) AS target FROM lv CROSS JOIN lam),
total AS (SELECT CAST(round(sum(target) / {block}) AS BIGINT) AS seats FROM aims),
q AS (SELECT key, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, k, key) AS turn FROM (SELECT key, target, unnest(range(0, (SELECT seats FROM total))) AS k FROM aims WHERE target > 0)),
won AS (SELECT key, count(*) AS seats FROM q WHERE turn <= (SELECT seats FROM total) GROUP BY key),
d AS MATERIALIZED (SELECT s.*, a.z, a.target, a.shards, s.h % a.shards AS shard, coalesce(won.seats, 0) AS seats FROM sized s JOIN aims a ON a.key = s.key LEFT JOIN won ON won.key = s.key),
sh AS (SELECT key, shard, CAST(sum(size) AS BIGINT) AS sz, max(seats) AS seats FROM d GROUP BY key, shard),
q2 AS (SELECT key, shard, seats, row_number() OVER (PARTITION BY key ORDER BY sz * 1e0 / (2 * k + 1) DESC, k, shard) AS turn FROM (SELECT key, shard, sz, seats, unnest(range(0, seats)) AS k FROM sh WHERE sz > 0)),
quota AS (SELECT sh.key, sh.shard, sz, least(coalesce(n, 0) * {block}, CAST(round({most}e0 * sz) AS BIGINT)) AS words FROM sh LEFT JOIN (
  SELECT key, shard, count(*) AS n FROM q2 WHERE turn <= seats GROUP BY key, shard) AS c ON c.key = sh.key AND c.shard = sh.shard),
laid AS (SELECT d.*, q.words, q.sz, CAST(sum(size) OVER (PARTITION BY d.key, d.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c1 FROM d JOIN quota q ON q.key = d.key AND q.shard = d.shard),
pos AS (SELECT *, c1 - size AS c0, greatest(sz, 1) AS has, words % greatest(sz, 1) AS rest,
  {hashed("'start'", f"'{seed}'", "key", "CAST(shard AS VARCHAR)")} % (CAST(floor((greatest(sz, 1) - 1) / {block}e0) AS BIGINT) + 1) * {block} AS start FROM laid)
SELECT doc_id, size, z AS source_size, target, CAST(floor(words * 1e0 / has) AS BIGINT) * size + greatest(least(c1, start + rest) - greatest(c0, start), 0)
  + greatest(least(c1, start + rest - sz) - greatest(c0, start - sz), 0) AS taken FROM pos"""
