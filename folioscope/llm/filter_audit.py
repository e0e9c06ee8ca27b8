"""Filter interaction audit: what each filter of a chain does at each place of each order.

Which filters a document fails is a mask. A mask decides all outcomes of the document: for each of
the orders of the filters and each step, whether it is kept, removed, or fails a filter after it was
removed. Those outcomes are ones in the fields of one wide integer, 64 bits a field, so a part's
counts for all orders at once are the sum of its documents' integers. No field can run over into the
next, since a part never has 2^63 documents. Equal masks are counted first, so what is summed is an
integer times its count.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scale import join_known
from .common import WORD, held

COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
REPEATED = "E"             # the filter that fails for a text that a smaller id has too
_GOOD, _TOXIC = 1, 2
_FIELD = 8                 # bytes of a field


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text only, by letter."""
    n = F.size(words)
    return {"A": n < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def _bits(conditions: Mapping[str, Column], letters: str) -> Column:
    out = F.lit(0)
    for letter, fails in conditions.items():
        out = out + F.when(fails, 1 << letters.index(letter)).otherwise(0)
    return out


@lru_cache(maxsize=4)
def _packed(n: int) -> list[int]:
    """For mask + (flags << n), flags of good and toxic, the integer whose fields are the outcomes at
    [order, step, count], then one field for each filter: whether only that one fails."""
    orders = list(permutations(range(n)))
    out = []
    for flags in range(4):
        for mask in range(1 << n):
            field = np.zeros((len(orders), n, len(COUNTS)), "<u8")
            for o, order in enumerate(orders):
                stays = True
                for step, f in enumerate(order):
                    fails = bool(mask >> f & 1)
                    removed = stays and fails
                    field[o, step, 1:] = removed, fails and not stays, removed and bool(flags & _GOOD), removed and bool(flags & _TOXIC)
                    stays = stays and not fails
                    field[o, step, 0] = stays
            alone = np.array([mask == 1 << f for f in range(n)], "<u8")
            out.append(int.from_bytes(field.tobytes() + alone.tobytes(), "little"))
    return out


def _unpacked(total: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts at [order, step, count], and those of documents failing one filter only."""
    orders = len(list(permutations(range(n))))
    size = orders * n * len(COUNTS)
    fields = np.frombuffer(total.to_bytes((size + n) * _FIELD, "little"), "<u8").astype(np.int64)
    return fields[:size].reshape(orders, n, len(COUNTS)), fields[size:]


def _report(letters: str):
    n = len(letters)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        packed = _packed(n)
        total = sum(packed[c] * k for c, k in zip(rows["outcome"].tolist(), rows["n"].tolist()))
        counts, alone = _unpacked(total, n)
        orders = np.array(list(permutations(range(n))))
        filters = orders.ravel()
        out = pd.DataFrame(counts.reshape(-1, len(COUNTS)), columns=list(COUNTS))
        out.insert(0, "part", rows["part"].iloc[0])
        out.insert(1, "filter_order", np.repeat(["".join(letters[f] for f in o) for o in orders], n))
        out.insert(2, "step", np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))
        out["unique_fails"] = alone[filters]
        out["shapley"] = out["removed"].groupby(filters).transform("sum")
        return out
    return run


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", letters: str = "ABCDE") -> DataFrame:
    """(id, part, mask, digest) of each document: the filters of one text that it fails, as bits in
    the order of `letters`, and the digest of its text. A null text counts as empty, a null part as ''."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = held(rows, "words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    conditions = {k: c for k, c in text_filters(F.col("text"), F.col("words")).items() if k in letters}
    return rows.select("id", "part", _bits(conditions, letters).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept (after the step), removed
    (there), redundant (fails the step's filter, removed earlier), good_lost and toxic_lost (removed
    there and labelled so), unique_fails (fails the step's filter only), shapley (removed by the
    filter, summed over all orders).

    Null texts are empty texts; a null part is ''. Of rows with equal texts those
    with the least id pass filter E, so rows that repeat an id and a text pass or fail alike; a row with a null id has no smaller
    one and passes, and has no label. A document is good, or toxic, if any of its labels says so; null
    labels say nothing. No documents give no rows. Other columns are not read.

    Moved are narrow rows: by id to the labels, by digest to the other rows of a text. A text or part that
    very many rows share is counted before it moves; one part is at most 4 x 2^filters rows.
    """
    rows = failures(docs, id_col, text_col, part_col, letters)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, _GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, _TOXIC).otherwise(0)).alias("toxic"))
    flags = F.coalesce(F.col("good") + F.col("toxic"), F.lit(0))
    rows = join_known(rows, known, ["id"], ["digest", "part", "mask"]).select(
        "id", "part", "digest", (F.col("mask") + F.shiftleft(flags, len(letters))).alias("outcome"))
    same = ["digest", "part", "outcome"]
    # Rows of one id first, then the least id of each text with the number of its rows.
    rows = rows.groupBy("id", *same).agg(F.count(F.lit(1)).alias("n"))
    texts = rows.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
                                    F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    texts = texts.withColumn("least", least).select("part", "outcome", "n", (F.col("unnamed") + first).alias("passing"))
    if REPEATED in letters:
        fails = F.col("outcome") + (1 << letters.index(REPEATED))
        both = F.array(F.struct("outcome", F.col("passing").alias("n")), F.struct(fails.alias("outcome"), (F.col("n") - F.col("passing")).alias("n")))
        texts = texts.select("part", F.inline(both)).filter("n > 0")
    counted = texts.groupBy("part", "outcome").agg(F.sum("n").alias("n"))
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "unique_fails", "shapley"))
    return counted.groupBy("part").applyInPandas(_report(letters), f"part string, filter_order string, step int, {counts}")
