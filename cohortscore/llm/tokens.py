"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Documents are encoded once, each worker keeping a partial histogram; what is shuffled is one
row for each length and task.  From then on everything is sums over the histogram: its number
of rows is at most the longest encoded length, however many documents there are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 4096


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to a numpy array of ids, for a ``.tiktoken`` ranks file or a ``.json`` tokenizer.

    ``byte_bpe_50k.json`` is read through the ranks file beside it if there is one: same ids, six
    times the speed.  The end-of-text string becomes id 50256, as the ``.json`` file has it.
    Text that the fast regular expression gives up on goes through the ``.json`` tokenizer.
    """
    import os

    import public_tokenizers
    import tiktoken

    ranks_path = path.removesuffix(".json") + ".tiktoken" if path.endswith(".json") else path
    exact = None
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        exact = Tokenizer.from_file(path)
        if not os.path.exists(ranks_path):
            return lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256} if exact else {}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except BaseException as e:  # the regular expression's stack, on extreme white space
            if exact is None or isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each encoded length.

    Null or empty text has length 0; very long texts are encoded whole, one at a time; repeated rows count
    as often as they occur; an empty table gives an empty histogram; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        seen: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                n = len(encode(t)) if (t := text.as_py()) else 0
                seen[n] = seen.get(n, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    parts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: documents and tokens beyond it, and totals.

    Sums run within blocks of 4096 lengths, and then over the blocks, so no window holds more
    than 4096 rows (or one row for each block).  The histogram is written to the shared folder first,
    so what makes it runs once, though both sums read it.
    ``truncated_tokens`` is the sum of min(length, limit).
    """
    h = stored(histogram, "lengths").select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).cast("long").alias("block"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = (
        h.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
            F.sum("d").over(everything).alias("all_docs"),
            F.sum("t").over(everything).alias("all_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_after") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_longer"),
    )
    return beyond.select(
        "n_tokens", "n_docs", "docs_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"),
        F.col("all_tokens").alias("total_tokens"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_longer, truncated_tokens`` for any limits, whether or not a length equals them.

    Takes the largest length within the limit; the documents beyond it are cut at the limit.
    """
    n, found = F.col("n_tokens"), []
    for limit in limits:
        inside = F.max(F.when(n <= limit, F.struct(n, "docs_longer", "truncated_tokens")))
        every = F.max(F.col("docs_longer") + F.col("docs_within"))
        found.append(F.struct(F.lit(limit).cast("long").alias("context_limit"), inside.alias("at"), every.alias("docs")))
    got = sums.agg(F.array(*found).alias("xs")).select(F.explode("xs").alias("x")).select("x.*")
    longer = F.coalesce(F.col("at.docs_longer"), F.col("docs"), F.lit(0))
    cut = F.coalesce(F.col("at.truncated_tokens"), F.lit(0)) + longer * (F.col("context_limit") - F.coalesce(F.col("at.n_tokens"), F.lit(0)))
    return got.select("context_limit", longer.alias("docs_longer"), cut.alias("truncated_tokens"))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """``q, n_tokens``: the least length that at least that share of documents do not exceed."""
    found = [F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in qs]
    return sums.agg(F.array(*found).alias("xs")).select(F.explode("xs").alias("x")).select("x.*")
