"""Numbering, running totals and joins that hold up when one key has most of the rows.

A window partitioned by a key puts that key's rows in one task. The helpers here order the
rows with a range partitioning on (key, order) instead, so a large key is spread over many
partitions, and carry the totals of earlier partitions forward through a small table of
(key, partition) totals.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

_ROW = "__scale_row"
_PART = "__scale_part"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A session without one gets a folder only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def pinned(df: DataFrame) -> DataFrame:
    """`df` written once to the checkpoint folder, so several readers see the same rows and
    a lost executor costs a re-read, not a re-computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As `pinned`, as Parquet: texts take a third to a half of the disk, and `released` can remove it. Shuffle files of the steps that made it go."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Removes what `written` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    return pinned(df.repartitionByRange(*by).sortWithinPartitions(*by)
                  .withColumn(_ROW, F.monotonically_increasing_id())
                  .withColumn(_PART, F.shiftright(F.col(_ROW), 33)))


def _with_parts(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the totals of their (key, partition); a null key is a key like any other."""
    on = [*keys, _PART]
    named = parts.withColumnsRenamed({k: f"__scale_k{i}" for i, k in enumerate(on)})
    match = [rows[k].eqNullSafe(named[f"__scale_k{i}"]) for i, k in enumerate(on)]
    return rows.join(named, match).drop(*[f"__scale_k{i}" for i in range(len(on))])


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  name: str = "n") -> DataFrame:
    """`df` with `name` = 1, 2, 3, ... inside each key. `order` must be total within a key."""
    rows = _ordered(df, keys, order)
    parts = rows.groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias("__scale_n"),
                                          F.min(_ROW).alias("__scale_first"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, _PART, "__scale_first",
                         F.coalesce(F.sum("__scale_n").over(before), F.lit(0)).alias("__scale_before"))
    return (_with_parts(rows, parts, keys)
            .withColumn(name, F.col(_ROW) - F.col("__scale_first") + F.col("__scale_before") + 1)
            .drop(_ROW, _PART, "__scale_first", "__scale_before"))


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 totals: Mapping[str, tuple[str, Column]], *, inclusive: bool = True) -> DataFrame:
    """`df` with running totals inside each key, up to and including the row, or before it.

    `totals` maps a new column to ("sum" | "max" | "min", value). Sums start at 0; a running
    max or min is null until it has met a value.
    """
    values = {name: f"__scale_v{i}" for i, name in enumerate(totals)}
    rows = _ordered(df.select("*", *[c.alias(values[n]) for n, (_, c) in totals.items()]), keys, order)
    parts = rows.groupBy(*keys, _PART).agg(
        *[_COMBINE[how](values[n]).alias(values[n]) for n, (how, _) in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, _PART, *[_COMBINE[how](values[n]).over(earlier).alias(f"__scale_b_{values[n]}")
                                         for n, (how, _) in totals.items()])
    end = 0 if inclusive else -1
    local = (Window.partitionBy(*keys, _PART).orderBy(_ROW)
             .rowsBetween(Window.unboundedPreceding, end))
    joined = _with_parts(rows, parts, keys)
    out = {}
    for n, (how, _) in totals.items():
        here, prior = _COMBINE[how](values[n]).over(local), F.col(f"__scale_b_{values[n]}")
        if how == "sum":
            out[n] = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        else:
            out[n] = F.greatest(here, prior) if how == "max" else F.least(here, prior)
    return (joined.withColumns(out)
            .drop(_ROW, _PART, *values.values(), *[f"__scale_b_{v}" for v in values.values()]))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """`df` with values of rows before inside each key: `values` maps a new column to (value, how many rows back), null at the
    beginning. Most rows find theirs in their own partition; the first few of each (key, partition) among the last few of the ones before."""
    most = max(back for _, back in values.values())
    held = {name: f"__scale_v{i}" for i, name in enumerate(values)}
    rows = _ordered(df.select("*", *[c.alias(held[n]) for n, (c, _) in values.items()]), keys, order)
    local = Window.partitionBy(*keys, _PART).orderBy(_ROW)
    lags = {n: F.lag(held[n], back) for n, (_, back) in values.items()}
    inner = rows.withColumns({n: lag.over(local) for n, lag in lags.items()} | {"__scale_i": F.row_number().over(local)})
    ends = F.row_number().over(Window.partitionBy(*keys, _PART).orderBy(F.desc(_ROW)))
    near = rows.select(*keys, _PART, _ROW, *held.values()).withColumn("__scale_i", F.row_number().over(local)).withColumn("__scale_e", ends)
    near = near.filter((F.col("__scale_i") <= most) | (F.col("__scale_e") <= most))          # a few rows for each key and partition
    whole = Window.partitionBy(*keys).orderBy(_ROW)
    seen = near.withColumns({f"__scale_w_{n}": lag.over(whole) for n, lag in lags.items()}).filter(F.col("__scale_i") <= most)
    seen = seen.select(F.col(_ROW).alias("__scale_of"), *[f"__scale_w_{n}" for n in values])
    heads = inner.filter(F.col("__scale_i") <= most).join(seen, F.col(_ROW) == F.col("__scale_of")).drop("__scale_of")
    heads = heads.withColumns({n: F.col(f"__scale_w_{n}") for n in values}).drop(*[f"__scale_w_{n}" for n in values])
    out = inner.filter(F.col("__scale_i") > most).unionByName(heads)
    return out.drop(_ROW, _PART, "__scale_i", *held.values())


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
             rank: str = "rank") -> DataFrame:
    """The first `k` rows of each key, ranked. `k` is a bound of the operator itself, and the
    rank filter is applied before the shuffle too (WindowGroupLimit), so a large key sends
    at most `k` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Join where a key of `left` may be very large and each key of `right` is small: left
    rows go to one of `salts` copies of their key's right rows, chosen by hashing `spread`."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", salt).join(copies, [*on, "__salt"], how).drop("__salt")


def join_known(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], tasks: int = 1024) -> DataFrame:
    """Left join where a key of many left rows may be null. Such rows match nothing, but all
    would go to one task; here they are dealt out by hashing `spread`."""
    unknown = F.lit(False)
    for k in on:
        unknown = unknown | F.col(k).isNull()
    dealt = left.withColumn("__scale_deal", F.when(unknown, F.pmod(F.xxhash64(*spread), F.lit(tasks)).cast("int")).otherwise(-1))
    return dealt.join(right.withColumn("__scale_deal", F.lit(-1)), [*on, "__scale_deal"], "left").drop("__scale_deal")
