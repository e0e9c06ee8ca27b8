"""The record tables, with the rules their rows keep."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from .operators import quality

_TYPES = {"text": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "real": T.FloatType(),
          "bool": T.BooleanType(), "time": T.TimestampType(), "json": T.StringType(), "vector": T.ArrayType(T.FloatType())}


@dataclass(frozen=True)
class Table:
    """A table's columns, key, allowed words and references to other tables."""
    columns: str
    key: tuple[str, ...]
    words: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    refers: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        out = []
        for part in self.columns.split(","):
            name, kind = part.split()
            out.append(T.StructField(name, _TYPES[kind], name not in self.key))
        return T.StructType(out)


_W = quality.ALLOWED
TABLES = {
    "experiments": Table("id text, name text, mode text, description text, config json, owner_id text, created_at time, deleted_at time",
                         ("id",), {"mode": _W["mode"]}, {"owner_id": ("users", "id")}),
    "runs": Table("id text, experiment_id text, status text, config_snapshot json, inputs json, result json, error text, launched_by text, "
                  "started_at time, finished_at time, created_at time", ("id",), {"status": _W["run_status"]},
                  {"experiment_id": ("experiments", "id"), "launched_by": ("users", "id")}),
    "run_events": Table("id long, run_id text, seq int, agent_id text, node text, event_type text, payload json, thinking text, queue_wait_ms int, "
                        "eval_ms int, prompt_tokens int, output_tokens int, host text, created_at time", ("run_id", "seq"),
                        {"event_type": _W["event_type"]}, {"run_id": ("runs", "id")}),
    "citations": Table("id long, run_id text, event_id long, quoted_text text, source_label text, chunk_id long, document_id long, corpus text, "
                       "corpus_version int, context text, similarity real, verdict text, source_url text, retrieved_at time, fingerprint text, "
                       "excerpt text, created_at time", ("id",), {"verdict": _W["verdict"]}, {"run_id": ("runs", "id")}),
    "documents": Table("id long, corpus text, title text, source_uri text, doc_type text, metadata json, sha256 text, added_by text, created_at time, "
                       "removed_at time, replaced_by long", ("id",), {}, {"replaced_by": ("documents", "id"), "added_by": ("users", "id")}),
    "corpus_versions": Table("corpus text, version int, documents long, change text, changed_by text, created_at time", ("corpus", "version"), {},
                             {"changed_by": ("users", "id")}),
    "corpus_members": Table("corpus text, version int, document_id long", ("corpus", "version", "document_id"), {}, {"document_id": ("documents", "id")}),
    "run_libraries": Table("run_id text, position short, corpus text, version int, documents int", ("run_id", "corpus"), {}, {"run_id": ("runs", "id")}),
    "library_settings": Table("corpus text, hidden bool, changed_by text, changed_at time", ("corpus",), {}, {"changed_by": ("users", "id")}),
    "crawls": Table("id text, corpus text, start_url text, host text, status text, max_pages int, rules json, total int, done int, added int, "
                    "message text, version int, started_by text, created_at time, finished_at time", ("id",), {"status": _W["crawl_status"]},
                    {"started_by": ("users", "id")}),
    "crawl_results": Table("crawl_id text, position int, link text, status text, detail text, document_id long, title text, secs real",
                           ("crawl_id", "position"), {}, {"crawl_id": ("crawls", "id")}),
    "library_renames": Table("id long, old_name text, new_name text, renamed_by text, renamed_at time", ("id",), {}, {"renamed_by": ("users", "id")}),
    "chunks": Table("id long, document_id long, ordinal int, content text, page_start int, page_end int, embedding vector, created_at time",
                    ("document_id", "ordinal"), {}, {"document_id": ("documents", "id")}),
    "memory_messages": Table("id long, run_id text, agent_id text, role text, content text, archived bool, created_at time", ("id",), {}, {"run_id": ("runs", "id")}),
    "memory_long_term": Table("id long, run_id text, agent_id text, kind text, content text, embedding vector, source_event_id long, source_chunk_id long, "
                              "created_at time", ("id",), {"kind": _W["memory_kind"]}, {"run_id": ("runs", "id")}),
    "users": Table("id text, subject text, email text, email_verified bool, name text, identity_provider text, status text, role text, affiliation text, "
                   "request_reason text, requested_role text, requested_at time, decision_note text, approved_by text, approved_at time, "
                   "created_at time, last_login_at time", ("id",), {"status": _W["user_status"], "role": _W["user_role"]}, {"approved_by": ("users", "id")}),
    "audit_log": Table("id long, at time, user_id text, action text, target text, detail json", ("id",), {}, {"user_id": ("users", "id")}),
}


def table_report(frames: Mapping[str, DataFrame]) -> DataFrame:
    """How many rows of each given table break a rule: words, keys, references."""
    parts = []

    def add(table, rule, df):
        parts.append(df.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "broken"))

    for name, df in frames.items():
        t = TABLES[name]
        for c, ok in t.words.items():
            add(name, f"{c} in its words", df.filter(F.col(c).isNotNull() & ~F.col(c).isin(*ok)))
        add(name, f"{', '.join(t.key)} unique", quality.repeated_keys(df, t.key))
        for c, (parent, key) in t.refers.items():
            if parent in frames:
                add(name, f"{c} in {parent}", quality.orphans(df, frames[parent], {c: key}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
