import hashlib
import os
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cohortscore.llm import jaccard, mixing
from cohortscore.llm.common import stored

from ..conftest import SF
from .conftest import ROWS


def _stages(spark, docs, sf):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), name))
    return out


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, known, lines, near, mixed, packed = _stages(spark, docs, SF)
    for d in (known, lines, near, mixed):
        assert d.columns == docs.columns
    assert known.where("text IS NULL").count() == 0
    # nothing that is left after the join is close to anything else
    left = jaccard.join(near).where("component_id <> doc_id").count()
    assert left == 0
    assert near.select("doc_id").distinct().count() == near.count()
    words = near.agg(F.sum(mixing.words(F.col("text")))).first()[0]
    assert abs(mixed.agg(F.sum(mixing.words(F.col("text")))).first()[0] - 1.5 * words) < 200
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select(*cols).collect())
    b = Counter(tuple(r) for r in _stages(spark, docs, SF)[-1].select(*cols).collect())
    assert a == b


def test_odd_rows_and_empty_tables(spark, odd, empty):
    out = _stages(spark, odd, SF)
    for d in out[1:-1]:
        assert d.columns == odd.columns
    ids = [r["doc_id"] for r in out[1].collect()]
    assert len(ids) == len(ROWS) - 4 and not {3, 4, 5, 6} & set(ids)
    assert _stages(spark, empty, SF)[-1].count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_near_duplicates_leave_no_large_shuffle(spark, monkeypatch):
    """The third stage's tables keep none of the shuffles of tokens, texts and sets that made them."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}
    left = {}

    def spied(df, name):
        before, table, deadline = files(), stored(df, name), time.time() + 2
        while True:
            left[name] = sum(os.path.getsize(x) for x in files() - before if os.path.exists(x))
            if not left[name] or time.time() > deadline:
                return table
            time.sleep(0.1)

    monkeypatch.setattr(jaccard, "stored", spied)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 600)) for _ in range(200)]
    rows = [(n, t, "en", "a") for n, t in enumerate([*texts, *(x + " end" for x in texts)])]
    near = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "")
    assert {r["doc_id"] for r in near.select("doc_id").collect()} == set(range(200))
    assert {"stars", "cells"} <= set(left) and not any(left.values()), left
