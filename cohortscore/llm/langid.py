"""Language identification: the family first, then one-versus-one linear SVMs within it.

Features are counts of hashed byte 1-, 2-, 3- and 4-grams of the whole lower-cased text (square
root, unit length).  The classifier is fitted on a bounded sample of labelled rows, balanced
over languages; ``sample_rows`` is that bound.  Everything else reads every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

DIM = 4096
UND = "und"
#: Language families of ISO 639-1 codes.  A label that is not here is its own family.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "finnic": "fi et",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "turkic": "tr az uz kk ky tk",
    "dravidian": "ta te kn ml",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), f"own:{lang}")


def features(text: str) -> np.ndarray:
    """Unit vector of hashed n-gram counts; zero for an empty text."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    out = np.zeros(DIM)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :]
        out += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(out)
    norm = np.sqrt(out @ out)
    return (out / norm if norm else out).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Dual coordinate descent for the L2-loss linear SVM; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / diag[i], 0.0)
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


@dataclass
class Vote:
    """One-versus-one machines over some classes; one class needs none."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Vote:
        classes = sorted(set(labels))
        pairs = list(combinations(range(len(classes)), 2))
        weights = [svm(x[at], np.where(labels[at] == classes[a], 1.0, -1.0)) for a, b in pairs if len(at := np.flatnonzero((labels == classes[a]) | (labels == classes[b])))]
        return cls(classes, pairs, np.array(weights, np.float32).reshape(len(pairs), DIM + 1))

    def proba(self, x: np.ndarray) -> np.ndarray:
        """Rows of class probabilities, from products of the machines' sigmoids."""
        log = np.zeros((len(x), len(self.classes)))
        if self.pairs:
            margin = np.clip(3.0 * (x @ self.weights[:, :-1].T + self.weights[:, -1]), -30, 30).astype(np.float64)
            for k, (a, b) in enumerate(self.pairs):
                log[:, a] -= np.log1p(np.exp(-margin[:, k]))
                log[:, b] -= np.log1p(np.exp(margin[:, k]))
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


@dataclass
class Model:
    family: Vote
    within: dict[str, Vote]

    def predict(self, x: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """Family, language and the product of both probabilities."""
        p = self.family.proba(x)
        best = p.argmax(1)
        family = [self.family.classes[k] for k in best]
        score = p[np.arange(len(x)), best]
        lang = [""] * len(x)
        for name in set(family):
            at = np.flatnonzero([f == name for f in family])
            q = self.within[name].proba(x[at])
            k = q.argmax(1)
            score[at] *= q[np.arange(len(at)), k]
            for i, j in zip(at, k, strict=True):
                lang[i] = self.within[name].classes[j]
        return family, lang, score


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder 0 by 5 (a null id too: nothing is learned from it)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample_rows: int = 1024) -> Model | None:
    """Fit on at most ``sample_rows`` labelled rows (8 a language at least) that are not held out.

    The sample is balanced over languages and picked by a hash of the id.  Ids and labels are
    scanned first; texts are read only up to each language's threshold.  None if nothing is labelled.
    """
    known = docs.select(F.col("doc_id"), F.col("lang"), F.col("text").cast("string").alias("text")).where(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(17)))
    langs = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not langs:
        return None
    each = max(8, sample_rows // len(langs))
    order = Window.partitionBy("lang").orderBy("h")
    edge = known.select("lang", "h").withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).groupBy("lang").agg(F.max("h").alias("edge"))
    near = known.join(F.broadcast(edge), "lang").where(F.col("h") <= F.col("edge"))  # one row for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(0), b.column(1), pa.array([features(t.as_py()).tobytes() for t in b.column(2)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "h", "x"])

    made = near.select("lang", "h", "text").mapInArrow(run, "lang string, h long, x binary")
    rows = made.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))).where(F.col("r") <= each).collect()
    rows.sort(key=lambda r: (r["lang"], r["r"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    labels = np.array([r["lang"] for r in rows], object)
    del rows
    families = np.array([family_of(s) for s in labels], object)
    return Model(Vote.fit(x, families), {f: Vote.fit(x[families == f], labels[families == f]) for f in set(families)})


def identify(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, family_pred`` of every whole text.

    ``und`` with score 0 if the text is null or holds no letter, or if there is no model.  Equal scores go to
    the first language in order.  Very long texts are counted whole, one at a time, into a vector of fixed
    size; repeated rows stay repeated; an empty table gives no rows.  With
    ``keep``, ``row`` is a struct of all columns of ``docs``, so that their names clash with none here,
    and ``has_letter`` says whether the text is not null and holds a letter, with or without a model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            texts = b.column(2).field(place) if keep else b.column(2)
            lang, family, score, letter = [UND] * n, [UND] * n, np.zeros(n), np.zeros(n, bool)
            for lo in range(0, n, 256):
                at, x = [], []
                for i in range(lo, min(n, lo + 256)):
                    t = texts[i].as_py()
                    letter[i] = bool(t) and any(c.isalpha() for c in t)
                    if m and letter[i]:
                        at.append(i)
                        x.append(features(t))
                if at:
                    f, s, p = m.predict(np.array(x))
                    for i, a, c, q in zip(at, f, s, p, strict=True):
                        family[i], lang[i], score[i] = a, c, q
            cols = [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(family, pa.string()), *([b.column(2), pa.array(letter)] if keep else [])]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([(f"c{i}", c.type) for i, c in enumerate(cols)]))

    # The text travels once: as itself, or within the row.
    place = docs.columns.index("text")
    text = F.col("text").cast("string").alias("text")
    sent = F.struct(*[text if c == "text" else col(c) for c in docs.columns]).alias("row") if keep else text
    source = docs.select("doc_id", held_out().alias("held_out"), sent)
    kinds = [source.schema["doc_id"].dataType, T.BooleanType(), T.StringType(), T.DoubleType(), T.StringType(), *([source.schema["row"].dataType, T.BooleanType()] if keep else [])]
    named = source.mapInArrow(run, T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)]))
    return named.toDF("doc_id", "held_out", "lang_pred", "score", "family_pred", *(["row", "has_letter"] if keep else []))
