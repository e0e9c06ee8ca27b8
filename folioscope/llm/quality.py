"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is described by the shape of its writing: kinds of characters, sequences of three runs of
such kinds, how often words and lines repeat, how long words are. The weighted counts of a bounded
labelled sample span a latent space (SVD); its vectors are handed to every task. Each document
is projected, its cosine to every labelled vector is computed exactly, block by block, and the
nearest labels vote by similarity.
"""

from __future__ import annotations

from collections.abc import Sequence
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_PER_LABEL = 1_000     # bound of the labelled rows of each label that the model is fitted on
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8                # a neighbour's weight is its cosine to this power
CUT = 0.3
_BLOCK = 256                 # documents described at a time

_KINDS = 20
_KIND = np.full(256, 17, np.int64)
_KIND[ord("a"):ord("z") + 1] = 0
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("0"):ord("9") + 1] = 2
_KIND[[32, 9, 11, 12, 13]] = 3
_KIND[10] = 4
for _k, _chars in enumerate((".", ",", "!", "|", "*", "#", "$", "%", "&", "'\"", "()[]{}<>", "-_"), 5):
    for _c in _chars:
        _KIND[ord(_c)] = _k
_KIND[128:192] = 18          # the later bytes of a character beyond ASCII
_KIND[192:] = 19             # its first byte
_SHAPES = _KINDS + _KINDS ** 3
_BINS = 11
_MEASURES = 6
COLUMNS = _SHAPES + _BINS * _MEASURES


def _measures(text: str) -> list[float]:
    """Shares between 0 and 1: repeated neighbours, words at a distance of two, distinct words,
    distinct lines, long words, words per line."""
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    return [sum(map(eq, words, words[1:])) / n, sum(map(eq, words, words[2:])) / n, len(set(words)) / n,
            len(set(lines)) / max(1, len(lines)), min(1.0, len(text) / n / 20), min(1.0, n / max(1, len(lines)) / 40)]


def describe(texts: Sequence[str | None]) -> np.ndarray:
    """Counts of each text's shapes and one mark for the bin of each measure; all 0 for a text
    without characters."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(raw)
    lengths = np.array([len(b) for b in raw], np.int64)
    owner = np.repeat(np.arange(n), lengths)
    kind = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    out = np.bincount(owner * COLUMNS + kind, minlength=n * COLUMNS).astype(np.float32)
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    runs, of = kind[first], owner[first]
    if len(runs) >= 3:
        same = of[2:] == of[:-2]
        code = _KINDS + (runs[:-2] * _KINDS + runs[1:-1]) * _KINDS + runs[2:]
        out += np.bincount((of[2:] * COLUMNS + code)[same], minlength=n * COLUMNS)
    out = out.reshape(n, COLUMNS)
    for i, t in enumerate(texts):
        if t:
            for m, share in enumerate(_measures(t)):
                out[i, _SHAPES + m * _BINS + int(share * (_BINS - 1))] = 1
    return out


class LatentSpace:
    """Column weights, projection, labelled vectors and their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> None:
        seen = (counts > 0).sum(0)
        self.columns = np.flatnonzero(seen >= min(2, len(counts)))
        self.idf = np.log((1 + len(counts)) / (1 + seen[self.columns])).astype(np.float32) + 1
        weighted = self._weighted(counts)
        k = min(dimensions, *weighted.shape) if weighted.size else 0
        self.projection = np.linalg.svd(weighted, full_matrices=False)[2][:k].T.astype(np.float32) if k else np.zeros((len(self.columns), 0), np.float32)
        self.vectors, self.labels = self.place(counts), labels.astype(np.float64)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts[:, :_KINDS].sum(1, keepdims=True), 1)
        used = counts[:, self.columns]
        share = np.where(self.columns < _SHAPES, np.sqrt(used / total), used * np.float32(0.5))
        return share * self.idf

    def place(self, counts: np.ndarray) -> np.ndarray:
        at = self._weighted(counts) @ self.projection
        length = np.linalg.norm(at, axis=1, keepdims=True)
        return np.where(length > 0, at / np.where(length > 0, length, 1), 0)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Between 0 and 1; one half where no neighbour has a positive cosine."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.place(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, best, 1).astype(np.float64), 0, 1) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[best]).sum(1) / np.where(total > 0, total, 1), 0.5)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as empty text. Fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_label: int = SAMPLE_PER_LABEL) -> LatentSpace:
    """A model of at most `per_label` rows of each label outside fold 0, chosen by a digest of
    their id. A label that is null or neither 0 nor 1 is passed over; of an id labelled twice
    the lower label holds; of an id with several texts the least text is read."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 0))
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label")))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(per_label).unionByName(known.filter("label = 1").orderBy(*order).limit(per_label))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")   # 2 * per_label rows at most

    def counted(batches):
        for pdf in batches:
            for k in range(0, len(pdf), _BLOCK):
                part = pdf.iloc[k:k + _BLOCK]
                yield pd.DataFrame({"id": part["id"].astype(str), "label": part["label"], "text": [t or "" for t in part["text"]],
                                    "counts": [np.asarray(c).astype("<u4").tobytes() for c in describe(part["text"].tolist())]})

    rows = (texts.mapInPandas(counted, "id string, label int, text string, counts binary").withColumn("digest", F.sha2("text", 256)).drop("text")
            .groupBy("id", "label").agg(F.min_by("counts", "digest").alias("counts")).collect())
    rows.sort(key=lambda r: r["id"])
    counts = np.array([np.frombuffer(r["counts"], "<u4") for r in rows], np.float32).reshape(len(rows), COLUMNS)
    return LatentSpace(counts, np.array([r["label"] for r in rows]))


def score_column(spark, model: LatentSpace, text: Column) -> Column:
    """The score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)      # 2 * SAMPLE_PER_LABEL short vectors and one projection

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        blocks = [shared.value.vote(describe(texts.iloc[k:k + _BLOCK].tolist())) for k in range(0, len(texts), _BLOCK)]
        return pd.Series(np.concatenate(blocks) if blocks else np.zeros(0))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  cut: float = CUT) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Null and empty texts, and every text where nothing is labelled, score one half. Rows that
    repeat come out as often as they come in. Other columns are not read: a score depends on the
    text alone.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), (fold(id_col) == 0).alias("held_out"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0).cast("int"))
