"""Duplicate and recoded variants by canonical signatures, and what depends on the groups.

Columns tie if standardization makes them equal up to sign.  With all of the states 0, 1 and 2 that is
equality or the complement (2 - dosage); of two states only the split of the samples counts, whatever
the states are; columns of one state all tie, missing calls or not.  Otherwise missing calls must agree.
A signature orders the states that occur and lists, for each, how many samples have it and two sums
of 60-bit hashes of them: one row of constant size a variant, summed on the map side.  A column and its
mirror share the lesser spelling, so no pairs are compared and no graph is walked.

The checks spell out the whole columns.
"""

from cohortscore.plans.relation import relation

_HASH = "CAST([[conv(substr(md5(CAST(sample_id AS STRING)), {at}, 15), 16, 10)|CAST(concat('0x', substr(md5(CAST(sample_id AS VARCHAR)), {at}, 15)) AS BIGINT)]] AS DECIMAL(38, 0))"
_A, _B = _HASH.format(at=1), _HASH.format(at=17)
_WHEN = {"2": "dosage = 2", "1": "dosage = 1", "m": "dosage IS NULL"}
_SUMS = ", ".join(f"count(CASE WHEN {w} THEN 1 END) AS n{k}, coalesce(sum(CASE WHEN {w} THEN a END), 0) AS a{k}, coalesce(sum(CASE WHEN {w} THEN b END), 0) AS b{k}" for k, w in _WHEN.items())
_STATES = "n0, a0, b0, n1, a1, b1, n2, a2, b2, nm, am, bm"
#: Sites without calls are all 0.
states = relation("states", f"""
SELECT variant_id, n - n2 - n1 - nm AS n0, a - a2 - a1 - am AS a0, b - b2 - b1 - bm AS b0, n1, a1, b1, n2, a2, b2, nm, am, bm FROM (
  SELECT s.variant_id, {', '.join(f'coalesce({x}{k}, 0) AS {x}{k}' for k in _WHEN for x in 'nab')} FROM {{sites}} s LEFT JOIN (
    SELECT variant_id, {_SUMS} FROM (SELECT variant_id, dosage, {_A} AS a, {_B} AS b FROM {{calls}}) AS c GROUP BY variant_id) AS c ON c.variant_id = s.variant_id) AS v
CROSS JOIN (SELECT count(*) AS n, sum({_A}) AS a, sum({_B}) AS b FROM {{samples}}) AS t""")
#: All variants, with a copy (+1000) and the complement (+2000) of each.
tied_states = relation("tied_states", f"""
SELECT variant_id, {_STATES} FROM {{states}} UNION ALL SELECT variant_id + 1000, {_STATES} FROM {{states}}
UNION ALL SELECT variant_id + 2000, n2, a2, b2, n1, a1, b1, n0, a0, b0, nm, am, bm FROM {{states}}""")
_SPELL = "concat_ws('/', n{k}, a{k}, b{k})"
_LOW = f"CASE WHEN n0 > 0 THEN {_SPELL.format(k=0)} ELSE {_SPELL.format(k=1)} END"
_HIGH = f"CASE WHEN n2 > 0 THEN {_SPELL.format(k=2)} ELSE {_SPELL.format(k=1)} END"
signatures = relation("signatures", f"""
SELECT variant_id, support, CASE WHEN k <= 1 THEN 'one' ELSE concat_ws(' ', k, low, middle, high, missing) END AS plain, CASE WHEN k <= 1 THEN 'one' ELSE concat_ws(' ', k, high, middle, low, missing) END AS flipped
FROM (SELECT variant_id, n1 + n2 AS support, CAST(n0 > 0 AS INT) + CAST(n1 > 0 AS INT) + CAST(n2 > 0 AS INT) AS k, {_LOW} AS low, {_HIGH} AS high,
  CASE WHEN n0 > 0 AND n1 > 0 AND n2 > 0 THEN {_SPELL.format(k=1)} ELSE '' END AS middle, {_SPELL.format(k='m')} AS missing FROM {{tied_states}}) AS s""")
#: Whole columns as text: each state's place among those that occur, and "-" for missing.
relation("dense_columns", """
WITH d AS (SELECT s.sample_id, v.variant_id, CASE WHEN c.sample_id IS NULL THEN 0 ELSE c.dosage END AS d FROM {samples} s CROSS JOIN {sites} v LEFT JOIN {calls} c ON c.sample_id = s.sample_id AND c.variant_id = v.variant_id),
t AS (SELECT variant_id, sample_id, d FROM d UNION ALL SELECT variant_id + 1000, sample_id, d FROM d UNION ALL SELECT variant_id + 2000, sample_id, 2 - d FROM d),
r AS (SELECT t.*, CASE WHEN d IS NOT NULL THEN dense_rank() OVER (PARTITION BY variant_id ORDER BY d NULLS LAST) - 1 END AS place FROM t),
k AS (SELECT variant_id, count(DISTINCT d) AS k, count(*) FILTER (WHERE d > 0) AS support FROM t GROUP BY variant_id)
SELECT r.variant_id, k.support, CASE WHEN max(k.k) <= 1 THEN 'one' ELSE string_agg(coalesce(CAST(place AS VARCHAR), '-'), '' ORDER BY sample_id) END AS plain,
  CASE WHEN max(k.k) <= 1 THEN 'one' ELSE string_agg(coalesce(CAST(k.k - 1 - place AS VARCHAR), '-'), '' ORDER BY sample_id) END AS flipped
FROM r JOIN k ON k.variant_id = r.variant_id GROUP BY r.variant_id, k.support""")
_SIDED = "SELECT variant_id, support, least(plain, flipped) AS canonical, CASE WHEN plain <= flipped THEN 1 ELSE -1 END AS side FROM {{{source}}}"
_MAP = """
SELECT variant_id, support, min(variant_id) OVER (PARTITION BY canonical) AS group_id, side, first_value(side) OVER (PARTITION BY canonical ORDER BY variant_id) AS lead_side
FROM (""" + _SIDED + """) AS s"""
_OWN = _SIDED.format(source="signatures")
#: A group's lead is an aggregate, summed on the map side, so the one group of all monomorphic variants is no task's alone.
tie_map = relation("tie_map", f"""
SELECT s.variant_id, s.support, g.group_id, s.side, g.lead_side FROM ({_OWN}) AS s JOIN (
  SELECT canonical, min(variant_id) AS group_id, min_by(side, variant_id) AS lead_side FROM ({_OWN}) AS o GROUP BY canonical) AS g ON g.canonical = s.canonical""", check=_MAP.format(source="dense_columns"))
tie_groups = relation("tie_groups", "SELECT variant_id, group_id, side * lead_side AS sign, CASE WHEN variant_id = group_id THEN 1 ELSE 0 END AS is_representative FROM {tie_map}")
#: Groups break where neighbours of equal support on a chromosome are more than ``window`` bases apart.
tie_groups_windowed = relation("tie_groups_windowed", """
SELECT variant_id, group_id, support, CAST(sum(gap) OVER (PARTITION BY group_id, support ORDER BY pos, variant_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part
FROM (SELECT variant_id, group_id, support, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY group_id, support ORDER BY pos, variant_id) > :window THEN 1 ELSE 0 END AS gap
  FROM (SELECT variant_id, group_id, support, variant_id * 60 AS pos FROM {tie_map}) AS a) AS b""", window=100_000)
#: A group's class is its members' if they agree; ``membership`` is each class's share of them.
collapse_ties = relation("collapse_ties", """
SELECT t.group_id, sum(t.n) AS members, min(t.pos) AS pos, round(sum(t.length) / sum(t.n), 6) AS length, round(sum(t.allele_frequency) / sum(t.n), 6) AS allele_frequency,
  CASE WHEN count(*) = 1 THEN min(t.variant_class) ELSE 'other_complex_sv' END AS variant_class,
  [[array_join(sort_array(collect_list(concat(t.variant_class, '=', CAST(CAST(round(t.n * 1e6 / t.total) AS BIGINT) AS STRING)))), ',')|string_agg(concat(t.variant_class, '=', CAST(CAST(round(t.n * 1e6 / t.total) AS BIGINT) AS VARCHAR)), ',' ORDER BY t.variant_class)]] AS membership
FROM (SELECT t.group_id, e.variant_class, count(*) AS n, min(e.pos) AS pos, sum(e.length) AS length, sum(e.allele_frequency) AS allele_frequency, sum(count(*)) OVER (PARTITION BY t.group_id) AS total
  FROM {tie_map} t JOIN {effects} e ON e.variant_id = t.variant_id % 1000 GROUP BY t.group_id, e.variant_class) AS t GROUP BY t.group_id""")
tie_weights = relation("tie_weights", """
SELECT t.variant_id, t.group_id, round(v / greatest(sum(v) OVER (PARTITION BY t.group_id), 1e-12), 6) AS weight
FROM (SELECT t.variant_id, t.group_id, e.beta_variance * (1 + t.variant_id / 1e3) AS v FROM {tie_map} t JOIN {effects} e ON e.variant_id = t.variant_id % 1000) AS t""")
#: A member's effect is the group's times its weight and sign; its variance takes the weight squared.
expand_coefficients = relation("expand_coefficients", """
SELECT t.variant_id, round(e.beta * w.weight * t.side * t.lead_side, 6) + 0e0 AS beta, round(e.beta_variance * w.weight * w.weight, 6) AS beta_variance
FROM {tie_map} t JOIN {tie_weights} w ON w.variant_id = t.variant_id JOIN {effects} e ON e.variant_id = t.group_id % 1000""")
