"""The helpers that keep large keys spread out, on lopsided data."""

import random

from pyspark.sql import functions as F

from folioscope.scale import best_per, salted_join, with_position, with_previous, with_running


def lopsided(spark, n=4000):
    """A third of all rows under one key."""
    rng = random.Random(7)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 200), rng.randrange(50), i, rng.randrange(9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, t int, id int, v int")


def test_positions_are_dense_and_ordered(spark):
    rows, df = lopsided(spark)
    got = {(r.k, r.id): r.n for r in with_position(df.repartition(13), ["k"], [F.desc("t"), "id"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[(k, r[2])] = n
    assert got == want


def test_a_large_key_is_numbered_in_many_tasks(spark):
    _, df = lopsided(spark)
    placed = df.repartitionByRange(8, "k", "t", "id").withColumn("p", F.spark_partition_id())
    assert placed.filter("k = 0").select("p").distinct().count() > 1


def test_running_totals(spark):
    rows, df = lopsided(spark, 1500)
    for inclusive in (True, False):
        out = with_running(df, ["k"], ["t", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "lo": ("min", F.when(F.col("v") > 4, F.col("v")))}, inclusive=inclusive)
        got = {(r.k, r.id): (r.s, r.m, r.lo) for r in out.collect()}
        for k in {r[0] for r in rows}:
            total, top, low = 0, None, None
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
                before = (total, top, low)
                total, top = total + r[3], r[3] if top is None else max(top, r[3])
                if r[3] > 4:
                    low = r[3] if low is None else min(low, r[3])
                assert got[(k, r[2])] == ((total, top, low) if inclusive else before)


def test_salted_join_equals_a_plain_one(spark):
    _, df = lopsided(spark)
    small = spark.createDataFrame([(k, f"s{k}") for k in range(0, 150)], "k int, name string")
    for how in ("inner", "left"):
        a = salted_join(df, small, ["k"], ["id"], how).select("id", "name")
        b = df.join(small, "k", how).select("id", "name")
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_best_per_filters_before_the_shuffle(spark):
    _, df = lopsided(spark)
    top = best_per(df, ["k"], [F.desc("v"), F.col("id")], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] <= 2


def test_values_of_rows_before(spark):
    df = spark.range(500).selectExpr("IF(id % 10 < 7, 1, id % 10) AS k", "pmod(id * 7919, 500) AS at", "concat('v', pmod(id * 7919, 500)) AS v").unionByName(
        spark.range(3).selectExpr("NULL AS k", "id AS at", "concat('n', id) AS v"))
    got = with_previous(df.repartition(5), ["k"], ["at"], {"one": (F.col("v"), 1), "three": (F.col("v"), 3)}).collect()
    rows = sorted((str(r.k), r.at, r.v) for r in df.collect())
    own = {}
    for k, at, v in rows:
        own.setdefault(k, []).append(v)
    want = sorted((k, v, str(vs[i - 1] if i else None), str(vs[i - 3] if i > 2 else None)) for k, vs in own.items() for i, v in enumerate(vs))
    assert sorted((str(r.k), r.v, str(r.one), str(r.three)) for r in got) == want
