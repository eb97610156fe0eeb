"""Connected components of event edges, and the representatives of the clusters."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> None:
    """Checkpoints go to the session's folder; on a local master without one, to one of our own."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/cohortscore-checkpoints")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder in one go and read back: what follows reads it without making it again."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def min_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each component.

    Each round takes the least label among neighbours, then the label's own label (pointer jumping),
    so the number of rounds is logarithmic in a component's diameter.  The lineage is cut by
    checkpoints, which survive lost executors.
    """
    shared_dir(nodes.sparkSession)
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).checkpoint()
    labels = nodes.select("node", F.col("node").alias("label")).checkpoint()
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        done = moved.join(jump, F.col("to") == F.col("at"), "left").select("node", F.least("to", "further").alias("label")).checkpoint()
        settled = done.join(labels.withColumnRenamed("label", "before"), "node").where(F.col("label") != F.col("before")).isEmpty()
        labels = done
        if settled:
            return labels


def clusters(events: DataFrame, edges: DataFrame) -> DataFrame:
    """``variant_id, cluster, representative``: most support first, then the smallest id."""
    labels = min_label(events.select(F.col("variant_id").alias("node")), edges)
    joined = events.join(labels, F.col("variant_id") == F.col("node"))
    best = joined.groupBy("label").agg(F.max_by("variant_id", F.struct("support", -F.col("variant_id"))).alias("representative"))
    return joined.join(best, "label").select("variant_id", F.col("label").alias("cluster"), "representative")
