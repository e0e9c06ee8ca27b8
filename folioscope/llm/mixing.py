"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 48-bit position, a digest of its id. A source that needs a part of its
words takes the documents below a threshold position. The threshold is found by histograms: words
summed by source and the leading bits of the position give the bucket in which the budget is
met; only that bucket is summed again by the next bits, and so on. Nothing is sorted, what moves
is a sum for each source and bucket, and a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, stored

LEVEL_BITS = 12
LEVELS = 4
_BROADCAST_SOURCES = 100_000


def position(id_col: str = "doc_id") -> Column:
    """0 .. 2^48 - 1 by the digest of the id as text; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """(source, source_size, target) from (source, size): all words shared by weight, a source's
    share cut at `max_repeat` times its words and the excess shared again by weight, until none
    is above. Weights repeat over the sources by code point, null last.

    In the order of (limit / weight) the cut sources come first, so the common level of the others
    is the greatest of (words left) / (weights left) over all starts; no loop is needed."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    own = own.select("source", "source_size", w.alias("w"), (max_repeat * F.col("source_size")).alias("limit"))
    everyone = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
             / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    own = own.withColumn("level", level).withColumn("level", F.max("level").over(everyone))
    return own.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    `taken` is size times the whole repeats of its source, plus one more for the documents below
    the source's threshold. The document at the threshold is taken if that comes nearer to the
    target. Null texts and texts without words have size 0 and take 0; a null source is a source
    of its own; rows that repeat an id share a position and are taken together; no rows give no
    rows. Other columns of `docs` are not read.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), position(id_col).alias("at"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    plan = source_targets(sized, weights, max_repeat)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(plan.withColumn("repeats", repeats).withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")))
    # A row for each source goes to every task if the sources were counted to be few; a hot one is then not gathered.
    near = F.broadcast if plan.count() <= _BROADCAST_SOURCES else lambda df: df
    below = _thresholds(sized, plan.select("source", "budget"), near)
    plan = plan.join(below, plan["source"].eqNullSafe(below["of"]), "left").drop("of")
    plan = plan.withColumnRenamed("source", "of")
    extra = F.when(F.col("at") < F.coalesce("below", F.lit(0)), 1).otherwise(0)
    return (sized.join(near(plan), sized["source"].eqNullSafe(plan["of"]))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("repeats") + extra)).alias("taken")))


def _thresholds(sized: DataFrame, budgets: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(of, below): for each source the position below which its documents meet the budget best."""
    # The open bucket of each source: its number at this level, and the words before it.
    opened = budgets.select(F.col("source").alias("of"), "budget", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    width = LEVEL_BITS * LEVELS
    for level in range(LEVELS):
        wide, fine = width - level * LEVEL_BITS, width - (level + 1) * LEVEL_BITS
        here = sized.withColumn("bucket", F.shiftrightunsigned("at", wide))
        inside = here.join(near(opened.withColumnRenamed("bucket", "open")), here["source"].eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("open")))
        sums = (inside.groupBy("of", "budget", "before", F.shiftrightunsigned("at", fine).alias("bucket"))
                .agg(F.sum("size").alias("words")))
        run = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(run))
        met = sums.filter(F.col("upto") >= F.col("budget"))
        first = met.groupBy("of", "budget").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        opened = first.select("of", "budget", F.col("b.bucket").alias("bucket"), (F.col("b.upto") - F.col("b.words")).alias("before"),
                              F.col("b.words").alias("words"))
        if level < LEVELS - 1:
            opened = stored(opened.drop("words"))
    over, short = F.col("before") + F.col("words") - F.col("budget"), F.col("budget") - F.col("before")
    return opened.select("of", F.when((short > 0) & (over <= short), F.col("bucket") + 1).otherwise(F.col("bucket")).alias("below"))
