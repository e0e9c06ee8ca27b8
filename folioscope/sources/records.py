"""Writing the record tables, reading their JSON columns, and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import TABLES

# Tables read by a part of them: events by day, passages and members by library.
_PARTS = {"run_events": "day", "corpus_members": "corpus"}


def conform(df: DataFrame, table: str) -> DataFrame:
    """`df` with a table's columns and types; columns it lacks become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].schema()])


def append(df: DataFrame, table: str, root: str) -> None:
    rows = conform(df, table)
    if table == "run_events":
        rows = rows.withColumn("day", F.to_date("created_at"))
    writer = rows.write.mode("append")
    if table in _PARTS:
        writer = writer.partitionBy(_PARTS[table])
    writer.parquet(f"{root}/{table}")


def read(spark: SparkSession, table: str, root: str) -> DataFrame:
    schema = TABLES[table].schema()
    if table == "run_events":
        schema = schema.add("day", "date")
    return spark.read.schema(schema).parquet(f"{root}/{table}")


CONFIG = ("struct<libraries:string,corpus:string,fetch_library:string,agents:array<struct<id:string,libraries:array<string>>>,"
          "max_turns:string,word_limit:string,time_limit_minutes:string>")


def experiment_config(config: Column) -> Column:
    """The settings of an experiment that other operators read, from its JSON: `libraries`
    is an array whether the JSON has a list or one name."""
    c = F.from_json(config, CONFIG)
    raw = c["libraries"]
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
    return F.struct(listed.alias("libraries"), c["corpus"].alias("corpus"), c["fetch_library"].alias("fetch_library"), c["agents"].alias("agents"))


def payload_fields(payload: Column) -> Column:
    """An open-ended JSON column as a variant, for `variant_get` and `variant_explode`."""
    return F.try_parse_json(payload)


def citation_export(entries: DataFrame, by: list[str], heading: Column) -> DataFrame:
    """A numbered list (`n`, `text`, `url`) as the lines of its text file, heading first."""
    from ..operators.citations import list_line
    lines = entries.select(*by, F.col("n").cast("long").alias("n"), list_line(F.col("n"), F.col("text"), F.col("url")).alias("line"))
    heads = entries.select(*by).distinct().select(*by, F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("n"), heading.alias("line")), F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("line")))).alias("h")).select(*by, "h.*")
    return heads.unionByName(lines)


def write_text(lines: DataFrame, by: list[str], path: str) -> None:
    """Lines written as text under one folder per list. Rows are range-partitioned by list
    and number, so the files of a long list follow one another in name order."""
    ordered = lines.repartitionByRange(*by, "n").sortWithinPartitions(*by, "n")
    ordered.select(*by, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)
