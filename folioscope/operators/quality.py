"""Schema constraints as queries that return the rows breaking them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

# The words each checked column may hold.
ALLOWED = {
    "mode": ("document_analysis", "agentic_workflow", "roleplay"),
    "run_status": ("pending", "running", "succeeded", "failed", "cancelled"),
    "event_type": ("llm_call", "tool_call", "retrieval", "node_enter", "node_exit", "memory_write", "error", "note"),
    "verdict": ("grounded", "unsupported", "unchecked"),
    "crawl_status": ("running", "stopping", "finished", "stopped", "failed", "interrupted"),
    "memory_kind": ("summary", "fact", "observation"),
    "user_status": ("pending", "active", "disabled"),
    "user_role": ("admin", "researcher", "viewer"),
}


def value_violations(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """How many rows hold each value a column may not hold."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(c).isin(*ok).alias("ok"))
        for c, ok in rules.items()])).alias("x")).select("x.*")
    return (cells.filter(~F.coalesce("ok", F.lit(True))).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("rows")))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of `child` whose reference names no row of `parent` (null references aside)."""
    named = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    held = child
    for c in on:
        held = held.filter(F.col(c).isNotNull())
    return held.join(named, list(on), "left_anti")


def documents_without_passages(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.join(chunks.select("document_id"), "document_id", "left_anti")
