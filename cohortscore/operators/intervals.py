"""Interval joins, near-identical structural events and their components."""

from cohortscore.plans.relation import relation

#: As-of lookup without a theta join: block starts and positions in one sorted run per chromosome.
#: Blocks do not overlap and their ids rise with their starts, so the last one begun is the largest so far.
ld_block_join = relation("ld_block_join", """
WITH runs AS (SELECT chrom, block_start AS place, 0 AS kind, block_id, block_end, CAST(NULL AS BIGINT) AS variant_id FROM {blocks}
  UNION ALL SELECT chrom, pos, 1, NULL, NULL, variant_id FROM {variants}),
filled AS (SELECT chrom, variant_id, place, kind,
  max(block_id) OVER (PARTITION BY chrom ORDER BY place, kind ROWS UNBOUNDED PRECEDING) AS block_id,
  max(block_end) OVER (PARTITION BY chrom ORDER BY place, kind ROWS UNBOUNDED PRECEDING) AS block_end FROM runs),
hit AS (SELECT chrom, variant_id, CASE WHEN place < block_end THEN block_id END AS block_id FROM filled WHERE kind = 1),
loose AS (SELECT chrom, count(*) AS n FROM hit WHERE block_id IS NULL GROUP BY chrom),
firsts AS (SELECT chrom, (SELECT count(*) FROM {blocks}) + sum(n) OVER (ORDER BY chrom) - n AS before FROM loose)
SELECT variant_id, block_id FROM hit WHERE block_id IS NOT NULL
UNION ALL SELECT h.variant_id, f.before + row_number() OVER (PARTITION BY h.chrom ORDER BY h.variant_id) - 1 FROM hit h JOIN firsts f ON f.chrom = h.chrom WHERE h.block_id IS NULL""",
    check="""
WITH hit AS (SELECT v.chrom, v.variant_id, b.block_id FROM {variants} v LEFT JOIN {blocks} b ON b.chrom = v.chrom AND v.pos >= b.block_start AND v.pos < b.block_end)
SELECT variant_id, CASE WHEN block_id IS NOT NULL THEN block_id ELSE (SELECT count(*) FROM {blocks}) + row_number() OVER (PARTITION BY block_id IS NULL ORDER BY chrom, variant_id) - 1 END AS block_id FROM hit""")
validate_blocks = relation("validate_blocks", """
SELECT chrom, count(*) AS n, count(*) FILTER (WHERE block_end <= block_start) AS n_empty, count(*) FILTER (WHERE chrom < 1 OR chrom > 22) AS n_bad_chrom, count(*) FILTER (WHERE block_start < before) AS n_overlap
FROM (SELECT *, lag(block_end) OVER (PARTITION BY chrom ORDER BY block_start) AS before FROM {blocks}) AS b GROUP BY chrom""")
events_sv = relation("events_sv", """
SELECT variant_id, chrom, variant_class, pos, pos + greatest(CAST([[bround(length)|round_even(length, 0)]] AS BIGINT), 1) AS span_end, length, support,
  row_number() OVER (PARTITION BY chrom, variant_class ORDER BY pos, pos + greatest(CAST([[bround(length)|round_even(length, 0)]] AS BIGINT), 1), variant_id) AS rn
FROM {variants} WHERE variant_class NOT IN ('snv', 'small_indel')""")
#: Starts within 50 bp: equal or neighbouring buckets of 51, an equi-join; at most 50 neighbours in sorted order.
sv_event_edges = relation("sv_event_edges", """
SELECT a.variant_id AS a, b.variant_id AS b
FROM (SELECT e.*, CAST(floor(pos / (:near + 1e0)) AS BIGINT) + d.d AS bucket FROM {events_sv} e CROSS JOIN (VALUES (0), (1)) AS d(d)) AS a
JOIN (SELECT *, CAST(floor(pos / (:near + 1e0)) AS BIGINT) AS bucket FROM {events_sv}) AS b
  ON a.chrom = b.chrom AND a.variant_class = b.variant_class AND a.bucket = b.bucket
WHERE b.rn > a.rn AND b.rn - a.rn <= :neighbours AND b.pos - a.pos <= :near
  AND greatest(least(a.span_end, b.span_end) - greatest(a.pos, b.pos), 0) >= :overlap * greatest(a.span_end - a.pos, b.span_end - b.pos)
  AND abs(a.support - b.support) <= :support * greatest(a.support, b.support)""", near=50, neighbours=50, overlap=0.9, support=0.2)
restore_order = relation("restore_order", """
SELECT v.variant_id, c.before + row_number() OVER (PARTITION BY v.chrom ORDER BY v.pos, v.variant_id) AS ordinal FROM {variants} v
JOIN (SELECT chrom, sum(n) OVER (ORDER BY chrom) - n AS before FROM (SELECT chrom, count(*) AS n FROM {variants} GROUP BY chrom) AS n) AS c ON c.chrom = v.chrom""",
    check="SELECT variant_id, row_number() OVER (ORDER BY chrom, pos, variant_id) AS ordinal FROM {variants}")
region_filter = relation("region_filter", "SELECT variant_id, chrom, pos FROM {variants} WHERE chrom = :chrom AND pos BETWEEN :first AND :last", chrom=3, first=1100, last=1400)
split_regions = relation("split_regions", """
SELECT chrom, part, 1 + CAST(floor(part * size / 4e0) AS BIGINT) AS region_start, CAST(floor((part + 1) * size / 4e0) AS BIGINT) AS region_end
FROM (SELECT chrom, max(pos) AS size FROM {variants} GROUP BY chrom) AS c CROSS JOIN (VALUES (0), (1), (2), (3)) AS p(part)""")
