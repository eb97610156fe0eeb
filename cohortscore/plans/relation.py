"""Named relations: one declarative text, planned by Catalyst, and checked by another engine.

A relation is a SQL query over other relations, written as ``{name}``.  On Spark the names are bound
to DataFrames (``build``), so any operator runs on any input of the right columns.  ``cte`` spells the
same query for DuckDB.  Where the dialects differ the text says ``[[spark|duckdb]]``.  Thresholds and
the like are named parameters (``:name``) with defaults.  A relation may have a second, independent text
(``check``) that the oracle takes instead: dense and plain where the operator is sparse and folded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from cohortscore.operators import components

_NAME = re.compile(r"\{(\w+)\}")
_CHOICE = re.compile(r"\[\[(.*?)\|(.*?)\]\]", re.S)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return repr(value) if "e" in repr(value) else f"{value!r}e0"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Relation:
    """An operator: a query text, the relations it reads and its parameters' defaults."""

    name: str
    text: str
    params: dict[str, object] = field(default_factory=dict)
    check: str | None = None
    inputs: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "inputs", tuple(dict.fromkeys(_NAME.findall(self.text))))

    def __call__(self, spark: SparkSession, params: dict[str, object] | None = None, **inputs: DataFrame) -> DataFrame:
        """Apply the operator to DataFrames."""
        if unknown := set(params or {}) - set(self.params):
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        return spark.sql(_CHOICE.sub(r"\1", self.text), args=self.params | (params or {}), **{k: inputs[k] for k in self.inputs})

    @property
    def check_inputs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(_NAME.findall(self.check or self.text)))

    def duckdb(self, names: dict[str, str]) -> str:
        text = _CHOICE.sub(r"\2", self.check or self.text)
        for k, v in self.params.items():
            text = re.sub(rf"(?<![:\w]):{k}\b", lambda _, v=v: _literal(v), text)
        return _NAME.sub(lambda m: names.get(m[1], m[1]), text)


RELATIONS: dict[str, Relation] = {}


#: Rows of a range at least, and ranges at most.
RANGE_ROWS, RANGES = 50_000, 1024


@dataclass(frozen=True)
class Ranged(Relation):
    """The rows of a relation with ``bucket``, their place among ranges of about equally many rows in the order of
    ``key``, and ``before``, the sum of ``n`` in all lower buckets: running sums over all rows go by bucket.

    The cuts are approximate quantiles, which one job gets before the query is planned; however the values are spread,
    a range holds about as many rows as others (rows of equal key stay together).  A window over the ranges' sums is
    one task.  Few rows are one range, without a join.
    """

    source: str = ""
    key: str = ""
    n: str = "1"

    def __call__(self, spark: SparkSession, params: dict[str, object] | None = None, **inputs: DataFrame) -> DataFrame:
        # Read for the cuts, and by each of the relations over it for rows and for sums: made once for all of them.
        if inputs[self.source] not in _MADE:
            _MADE[inputs[self.source]] = components.kept(inputs[self.source])
        own = {self.source: _MADE[inputs[self.source]]}
        kept = self._cuts(spark, own[self.source])
        if not kept:
            return spark.sql(f"SELECT x.*, 0 AS bucket, ({self.n}) * 0 AS before FROM {{{self.source}}} x", **own)
        # Binary search: the number of cuts below the key.
        steps = ", ".join(str(1 << i) for i in reversed(range(len(kept).bit_length())))
        array = ", ".join(f"{c!r}D" if "e" in repr(c) or "." in repr(c) else f"{c!r}e0" for c in kept)
        bucket = f"aggregate(array({steps}), 0, (a, s) -> CASE WHEN a + s <= {len(kept)} AND get(array({array}), a + s - 1) < {self.key} THEN a + s ELSE a END)"
        marked = spark.sql(f"SELECT x.*, {bucket} AS bucket FROM {{{self.source}}} x", **own)
        return spark.sql(f"""
SELECT x.*, o.before FROM {{marked}} x JOIN (SELECT bucket, sum(n) OVER (ORDER BY bucket) - n AS before FROM (
  SELECT bucket, sum({self.n}) AS n FROM {{marked}} x GROUP BY bucket) AS z) AS o ON o.bucket = x.bucket""", marked=marked)


    def _cuts(self, spark: SparkSession, source: DataFrame) -> list[float]:
        """Up to ``RANGES`` - 1 cuts; relations over one DataFrame by one key, up or down, share a job."""
        plain = self.key.removeprefix("-")
        known = _CUTS.setdefault(source, {})
        if plain not in known:
            shares = ", ".join(repr(i / RANGES) for i in range(1, RANGES))
            rows, cuts = spark.sql(f"SELECT count(k), percentile_approx(k, array({shares})) FROM (SELECT {plain} AS k FROM {{source}} x) AS k", source=source).first()
            ranges = min(RANGES, -(-rows // RANGE_ROWS))
            known[plain] = sorted({float(cuts[RANGES * i // ranges - 1]) for i in range(1, ranges)}) if ranges > 1 else []
        return known[plain] if plain == self.key else [-c for c in reversed(known[plain])]


_CUTS: WeakKeyDictionary[DataFrame, dict[str, list[float]]] = WeakKeyDictionary()
_MADE: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def ranged(name: str, source: str, key: str, n: str = "1") -> Relation:
    """A ``Ranged`` relation over ``source``; its text, for checks, has one range."""
    RELATIONS[name] = Ranged(name, f"SELECT x.*, 0 AS bucket, ({n}) * 0 AS before FROM {{{source}}} x", source=source, key=key, n=n)
    return RELATIONS[name]


def relation(name: str, text: str, check: str | None = None, **params: object) -> Relation:
    RELATIONS[name] = Relation(name, text, params, check)
    return RELATIONS[name]


def build(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The relation over the tables in ``sf_dir``; shared inputs are built once."""
    made = {} if made is None else made
    if name not in made:
        if name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            r = RELATIONS[name]
            made[name] = r(spark, **{k: build(spark, sf_dir, k, made) for k in r.inputs})
    return made[name]


def oracle(name: str) -> str:
    """DuckDB SQL of a relation, its inputs as common table expressions."""
    steps: dict[str, str] = {}

    def visit(n: str) -> None:
        if n in TABLES or n in steps:
            return
        for k in RELATIONS[n].check_inputs:
            visit(k)
        steps[n] = RELATIONS[n].duckdb({k: k if k in TABLES else f"rel_{k}" for k in RELATIONS[n].check_inputs})

    visit(name)
    last = steps.pop(name)
    head = ", ".join(f"rel_{k} AS MATERIALIZED ({v})" for k, v in steps.items())
    return f"WITH {head} SELECT * FROM ({last})" if head else last
