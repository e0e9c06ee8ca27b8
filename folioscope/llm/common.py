"""What the operators share: reading a table, tables written once, word classes, groups of links."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scale import ensure_checkpoint_dir

#: A word is a run of anything but these: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: several readers see the
    same rows, lineage ends, and a lost executor costs a re-read. Removed when Spark ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(*tables: DataFrame) -> None:
    """Removes what `stored` wrote for these tables, when nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of steps that have ended go when the driver collects its garbage; between large steps it is asked to."""
    gc.collect()
    spark._jvm.System.gc()


def repeats_ids(docs: DataFrame, id_col: str) -> bool:
    return docs.select(id_col).distinct().count() < docs.count()


def own_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with a number `__key` for each row, in the order of id and text, null ids last.
    Rows become one only if their id, not null, and their text are both equal."""
    named = docs.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    rows = named.unionByName(docs.filter(F.col(id_col).isNull()))
    return stored(rows.orderBy(F.asc_nulls_last(id_col), text_col).withColumn("__key", F.monotonically_increasing_id()))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once for each row. The optimizer merges projections, and
    a lambda that refers to a merged column would compute it again for each element; it does not
    merge across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected groups of the links (a, b) between long ids: (id, root), root the least id of
    the group, for every id that has a link to another.

    Rounds of two steps until nothing changes. First every node hands its least smaller neighbour
    to its other smaller neighbours; then every node hands its own least neighbour to its larger
    ones. The number of rounds is logarithmic in the longest path. There are never more rows than
    links: a node with very many links is reduced before the shuffle, and its rows are only
    looked up, never paired.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
        edges = stored(_to_larger(_to_smaller(edges)))
    roots = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _to_smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return moved.filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()


def _to_larger(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
