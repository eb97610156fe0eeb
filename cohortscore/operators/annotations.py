"""Prior designs from annotation tables whose columns and levels are not known beforehand, and INFO fields of any key.

Two passes: the first tells each column's kind and gathers the dictionary of its levels, the second turns cells
into sparse (variant, feature, value) rows by it.  Nothing is pivoted; centring and scaling are two numbers a feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.plans.relation import relation

#: Features of a design at most: their Gram matrix is the driver's.
MOST_FEATURES = 4096


def typed_info(info: Column) -> Column:
    """INFO text as a map from key to values of (whole, number, text), each in the first form that fits.

    A flag has no values; '.' is a null value; the last of repeated keys counts; '.' alone is an empty map.
    """
    def value(x: Column) -> Column:
        x = F.nullif(x, F.lit("."))
        whole = F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("long"))
        number = F.when(whole.isNull(), x.try_cast("double"))
        return F.when(x.isNotNull(), F.struct(whole.alias("whole"), number.alias("number"), F.when(whole.isNull() & number.isNull(), x).alias("text")))

    items = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    key = lambda x: F.regexp_extract(x, "^([^=]*)", 1)
    last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: key(y) == key(x)))
    values = F.transform(last, lambda x: F.when(x.contains("="), F.transform(F.split(F.regexp_replace(x, "^[^=]*=", ""), ","), value)).otherwise(F.array().cast("array<struct<whole:long,number:double,text:string>>")))
    return F.map_from_arrays(F.transform(last, key), values)


def info_entries(records: DataFrame) -> DataFrame:
    """``chrom, pos, key, place, whole, number, text``: one row a value; a flag is one row without place."""
    keyed = records.select("chrom", "pos", F.explode(typed_info(F.col("info"))).alias("key", "values"))
    return keyed.select("chrom", "pos", "key", F.posexplode_outer("values").alias("place", "x")).select("chrom", "pos", "key", "place", "x.whole", "x.number", "x.text")


# Designs


def _levels(text: Column, kind: Column) -> Column:
    """(depth, level, value) of a cell, by its column's kind; null depth for a number."""
    none = F.lit(None).cast("string")
    one = lambda depth, level, v: F.struct(F.lit(depth).cast("int").alias("depth"), level.alias("level"), v.cast("double").alias("value"))
    yes = F.lower(text).isin("1", "true", "t", "yes")

    def path(parts: Column, v: Column) -> Column:
        clean = F.transform(F.split(parts, ">"), lambda s: F.trim(s))
        return F.transform(clean, lambda _, i: F.struct(i.cast("int").alias("depth"), F.array_join(F.slice(clean, 1, i + 1), ">").alias("level"), v.cast("double").alias("value")))

    def weighted(item: Column) -> tuple[Column, Column]:
        return F.trim(F.regexp_extract(item, "^([^=]*)", 1)), F.regexp_extract(item, "=(.*)$", 1).try_cast("double")

    items = F.filter(F.split(text, ","), lambda s: F.trim(s) != "")
    return (
        F.when(kind == "bool", F.when(yes, F.array(one(0, F.lit("true"), F.lit(1)))).otherwise(F.array(one(0, F.lit("false"), F.lit(1)))))
        .when(kind == "float", F.array(one(None, none, text.try_cast("double"))))
        .when(kind == "weighted", F.flatten(F.transform(items, lambda s: path(weighted(s)[0], weighted(s)[1]))))
        .when(kind == "nested", path(text, F.lit(1)))
        .otherwise(F.array(one(0, text, F.lit(1))))
    )


def memberships(annotations: DataFrame) -> DataFrame:
    """``variant_id, name, depth, level, value`` of every non-blank cell of every column but variant_id."""
    names = [c for c in annotations.columns if c != "variant_id"]
    long = annotations.select("variant_id", *[F.col(c).cast("string").alias(c) for c in names]).unpivot("variant_id", names, "name", "text").select("variant_id", "name", F.trim("text").alias("text")).where("text <> ''")
    kinds = long.groupBy("name").agg(
        F.when(F.bool_and(F.lower("text").isin("1", "0", "true", "false", "t", "f", "yes", "no")), "bool").when(F.bool_and(F.col("text").try_cast("double").isNotNull()), "float")
        .when(F.bool_and(F.col("text").contains("=")), "weighted").when(F.bool_and(F.col("text").contains(">")), "nested").otherwise("categorical").alias("kind")
    )
    cells = long.join(kinds, "name").select("variant_id", "name", F.explode(_levels(F.col("text"), F.col("kind"))).alias("x"))
    return cells.select("variant_id", "name", "x.*").where("value IS NOT NULL").groupBy("variant_id", "name", "depth", "level").agg(F.sum("value").alias("value"))


def design_cells(annotations: DataFrame, knots: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``variant_id, feature, value``: the stored cells of the design; absent ones are 0.

    Levels: of each column and depth, all but the first in order (the reference).  Numbers: the value, and what it
    exceeds each knot by, knots being quantiles of the column's own values.
    """
    m = memberships(annotations)
    seen = m.where("depth IS NOT NULL").select("name", "depth", "level").distinct()
    first = seen.groupBy("name", "depth").agg(F.min("level").alias("reference"))
    levels = m.join(first, ["name", "depth"]).where("level <> reference")
    named = levels.select("variant_id", F.concat_ws("::", F.lit("level"), "name", F.col("depth").cast("string"), "level").alias("feature"), "value")
    own = m.where("depth IS NULL")
    cuts = own.groupBy("name").agg(F.percentile("value", [float(k) for k in knots]).alias("cuts"))
    bases = F.concat(F.array(F.col("value")), F.transform("cuts", lambda c: F.greatest(F.col("value") - c, F.lit(0.0))))
    spline = own.join(cuts, "name").select("variant_id", "name", F.posexplode(bases).alias("basis", "value"))
    curves = spline.select("variant_id", F.concat_ws("::", F.lit("curve"), "name", F.col("basis").cast("string")).alias("feature"), "value")
    return named.unionByName(curves).where("value <> 0")


def feature_scales(cells: DataFrame, n: int) -> DataFrame:
    """``feature, n_cells, mean, rms`` over all ``n`` variants: a cell's standardized value is (value - mean) / rms."""
    mean = F.sum("value") / n
    rms = F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0)))
    return cells.groupBy("feature").agg(F.count("*").alias("n_cells"), mean.alias("mean"), rms.alias("rms"))


def independent_features(cells: DataFrame, n: int, least: float = 1e-8) -> list[str]:
    """Features, most cells first, that are no combination of those before them, by pivots of their correlation matrix.

    The matrix is summed by a join of each variant's own cells; no cell of all variants reaches the driver.
    """
    scales = {r["feature"]: r for r in feature_scales(cells, n).collect()}
    if len(scales) > MOST_FEATURES:
        raise ValueError(f"a design of {len(scales)} features; {MOST_FEATURES} at most")
    names = sorted((f for f, r in scales.items() if r["rms"] > 1e-9), key=lambda f: (-scales[f]["n_cells"], f))
    at = {f: i for i, f in enumerate(names)}
    other = cells.select("variant_id", F.col("feature").alias("other"), F.col("value").alias("w"))
    products = cells.join(other, "variant_id").groupBy("feature", "other").agg(F.sum(F.col("value") * F.col("w")).alias("s")).collect()
    mean, rms = (np.array([scales[f][k] for f in names]) for k in ("mean", "rms"))
    gram = np.zeros((len(names),) * 2)
    for r in products:
        if r["feature"] in at and r["other"] in at:
            gram[at[r["feature"]], at[r["other"]]] = r["s"] / n
    left = (gram - np.outer(mean, mean)) / np.outer(rms, rms) if names else gram
    kept = []
    for j in range(len(names)):
        if left[j, j] > least:
            kept.append(names[j])
            left -= np.outer(left[:, j], left[j]) / left[j, j]
    return kept


def dense_design(annotations: DataFrame, variants: list[str]) -> tuple[np.ndarray, list[str]]:
    """Centred columns of unit RMS, independent, for the (few) variants that are fitted, and their names."""
    spark = annotations.sparkSession
    asked = spark.createDataFrame([(v, i) for i, v in enumerate(variants)], "variant_id string, at int")
    mine = annotations.withColumn("variant_id", F.col("variant_id").cast("string")).join(asked.select("variant_id"), "variant_id", "left_semi")
    cells = design_cells(mine).persist()
    names = independent_features(cells, len(variants))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(variants), len(names)))
    for r in cells.join(asked, "variant_id").select("at", "feature", "value").toLocalIterator():
        if r["feature"] in at:
            x[r["at"], at[r["feature"]]] = r["value"]
    cells.unpersist()
    x -= x.mean(axis=0)
    return x / np.sqrt((x**2).mean(axis=0)), names


relation("info_rows", """SELECT p_brand AS chrom, p_partkey AS pos, concat(replace(p_name, ' ', '_'), '=', p_size, ';', p_brand, ';', p_type, '=', p_retailprice, ',', p_size, ',.,', p_name, ';K', p_size % 5, '=', p_size / 4e0, CASE WHEN p_size % 7 = 0 THEN ';DB;.' ELSE '' END) AS info FROM {part}""")
relation("info_entries_oracle", """
WITH items AS (SELECT chrom, pos, unnest(string_split(info, ';')) AS item, generate_subscripts(string_split(info, ';'), 1) AS nth FROM {info_rows}),
keyed AS (SELECT chrom, pos, nth, split_part(item, '=', 1) AS key, CASE WHEN contains(item, '=') THEN string_split(substr(item, strpos(item, '=') + 1), ',') END AS vals FROM items WHERE item NOT IN ('', '.')),
lasts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY chrom, pos, key ORDER BY nth DESC) = 1),
cells AS (SELECT chrom, pos, key, unnest(vals) AS v, generate_subscripts(vals, 1) - 1 AS place FROM lasts WHERE vals IS NOT NULL
  UNION ALL SELECT chrom, pos, key, NULL, NULL FROM lasts WHERE vals IS NULL),
typed AS (SELECT *, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN try_cast(v AS BIGINT) END AS whole, CASE WHEN NOT regexp_full_match(v, '[+-]?[0-9]+') THEN try_cast(nullif(v, '.') AS DOUBLE) END AS number FROM cells)
SELECT chrom, pos, key, CAST(place AS INT) AS place, whole, number, CASE WHEN whole IS NULL AND number IS NULL THEN nullif(v, '.') END AS text FROM typed""")
#: Columns of all kinds; which they are, and their levels, the design finds out.
relation("annotation_table", """SELECT variant_id, flag_text AS flag, number_text AS size, weighted_text AS mix, path_text AS path, level_text AS tongue, concat(tone, '>', level_text, '=0.25,x=0.75') AS blend FROM (SELECT *, CASE WHEN variant_id % 2 = 0 THEN 'low' ELSE 'high' END AS tone FROM {annotations}) AS a""")
_CELLS = """
long AS (SELECT variant_id, name, trim(text) AS text FROM (SELECT variant_id, flag, CAST(size AS VARCHAR) AS size, mix, path, tongue, blend FROM {annotation_table}) UNPIVOT (text FOR name IN (flag, size, mix, path, tongue, blend)) WHERE trim(text) <> ''),
w AS (SELECT variant_id, name, trim(split_part(item, '=', 1)) AS way, try_cast(split_part(item, '=', 2) AS DOUBLE) AS value FROM (SELECT variant_id, name, unnest(string_split(text, ',')) AS item FROM long WHERE name IN ('mix', 'blend')) AS i),
ways AS (SELECT variant_id, name, way, value FROM w UNION ALL SELECT variant_id, name, text, 1e0 FROM long WHERE name = 'path'),
parts AS (SELECT variant_id, name, value, list_transform(string_split(way, '>'), lambda s: trim(s)) AS p FROM ways),
deep AS (SELECT variant_id, name, value, p, unnest(range(0, len(p))) AS depth FROM parts),
m AS (SELECT variant_id, name, depth, array_to_string(p[1:depth + 1], '>') AS level, value FROM deep
  UNION ALL SELECT variant_id, name, 0, CASE WHEN lower(text) IN ('1', 'true', 't', 'yes') THEN 'true' ELSE 'false' END, 1e0 FROM long WHERE name = 'flag'
  UNION ALL SELECT variant_id, name, 0, text, 1e0 FROM long WHERE name = 'tongue'),
s AS (SELECT variant_id, name, depth, level, sum(value) AS value FROM m WHERE value IS NOT NULL GROUP BY variant_id, name, depth, level),
r AS (SELECT name, depth, min(level) AS reference FROM s GROUP BY name, depth),
n AS (SELECT variant_id, name, CAST(text AS DOUBLE) AS value FROM long WHERE name = 'size'),
k AS (SELECT 0 AS basis, CAST(NULL AS DOUBLE) AS cut UNION ALL SELECT 1, quantile_cont(value, 0.25) FROM n UNION ALL SELECT 2, quantile_cont(value, 0.5) FROM n UNION ALL SELECT 3, quantile_cont(value, 0.75) FROM n),
c AS (SELECT variant_id, concat('level::', s.name, '::', s.depth, '::', s.level) AS feature, value FROM s JOIN r ON r.name = s.name AND r.depth = s.depth WHERE s.level <> r.reference
  UNION ALL SELECT variant_id, concat('curve::', name, '::', basis), CASE WHEN cut IS NULL THEN value ELSE greatest(value - cut, 0) END FROM n CROSS JOIN k)"""
relation("design_cells_oracle", f"WITH {_CELLS} SELECT variant_id, feature, round(value, 6) AS value FROM c WHERE value <> 0")
relation("design_features_oracle", f"""WITH {_CELLS}, t AS (SELECT count(*) AS n FROM {{annotation_table}})
SELECT feature, count(*) AS n_cells, round(sum(value) / any_value(n), 6) AS mean, round(sqrt(greatest(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)), 0)), 4) AS rms FROM c CROSS JOIN t WHERE value <> 0 GROUP BY feature""")
