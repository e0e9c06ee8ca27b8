"""The given tables as the tables the operators work on.

Each adapter is written twice from one rule: as a DataFrame here and as SQL in `view(...)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from .registry import view

MARKS = r"\[(\d{1,3}(?:\s*,\s*\d{1,3})*)\]"


WIDE = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. A text table that comes as fewer pieces than there are cores (one small
    file, say) is dealt out to them, since the work on a row of text outweighs moving it."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in WIDE and not df.isStreaming:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    return df


# ------------------------------------------------------------------ documents and libraries

def documents(spark, sf) -> DataFrame:
    """Library documents, current and removed. The library is the source."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("corpus"),
        F.substring(F.split("text", "\n")[0], 1, 80).alias("title"),
        F.col("text").alias("content"), F.sha2("text", 256).alias("sha256"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/doc/"), "doc_id").alias("source_uri"),
        F.when(F.col("doc_id") % 3 == 0, "PDF").when(F.col("doc_id") % 3 == 1, "web page")
         .otherwise("text").alias("doc_type"),
        F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
        (F.col("doc_id") % 7 == 0).alias("removed"),
        F.when(F.col("doc_id") % 21 == 0, F.col("doc_id") + 1).alias("replaced_by"))


view("v_documents", """
SELECT doc_id AS document_id, source AS corpus, left(split_part(text, chr(10), 1), 80) AS title,
  text AS content, sha256(text) AS sha256,
  'https://' || source || '.example.org/doc/' || doc_id AS source_uri,
  CASE doc_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'web page' ELSE 'text' END AS doc_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at,
  doc_id % 7 = 0 AS removed, CASE WHEN doc_id % 21 = 0 THEN doc_id + 1 END AS replaced_by
FROM documents""")


def change_log(spark, sf) -> DataFrame:
    """What happened to each document: added, then removed or replaced, some put back and
    some retitled. `event_no` orders the changes of a document."""
    d = documents(spark, sf).select("document_id", "corpus", "title", "sha256", "created_at", "replaced_by")
    fields = ["document_id", "corpus", "title", "sha256", "created_at"]
    i = F.col("document_id")
    acts = F.array_compact(F.array(
        F.struct(F.lit(0).alias("no"), F.lit("added").alias("action"), F.lit(None).cast("long").alias("to")),
        F.when((i % 7 == 0), F.struct(F.lit(1).alias("no"), F.when(i % 21 == 0, "replaced").otherwise("removed")
               .alias("action"), F.col("replaced_by").alias("to"))),
        F.when(i % 49 == 0, F.struct(F.lit(2).alias("no"), F.lit("restored").alias("action"),
               F.lit(None).cast("long").alias("to"))),
        F.when(i % 11 == 0, F.struct(F.lit(3).alias("no"), F.lit("retitled").alias("action"),
               F.lit(None).cast("long").alias("to")))))
    return (d.select(*fields, F.explode(acts).alias("a"))
            .select("document_id", "corpus",
                    F.when(F.col("a.action") == "retitled", F.concat(F.lit("New "), "title"))
                     .otherwise(F.col("title")).alias("title"),
                    "sha256", "created_at", (i * 10 + F.col("a.no")).alias("event_no"),
                    F.col("a.action").alias("action"), F.col("a.to").alias("replaced_by")))


def versions(spark, sf) -> DataFrame:
    """Recorded contents of each library, one row per version and document: version 1 holds
    every document, version 2 those whose id is no multiple of seven."""
    d = documents(spark, sf).select("corpus", "document_id")
    return d.select("corpus", "document_id", F.explode(
        F.when(F.col("document_id") % 7 != 0, F.array(F.lit(1), F.lit(2)))
         .otherwise(F.array(F.lit(1)))).alias("version"))


view("v_versions", """
SELECT source AS corpus, doc_id AS document_id, 1 AS version FROM documents
UNION ALL SELECT source, doc_id, 2 FROM documents WHERE doc_id % 7 <> 0""")


def pages_of_text(spark, sf) -> DataFrame:
    """Each line of a document as one page."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")) \
            .withColumn("page", F.col("page") + 1)


view("v_pages_of_text", """
SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS page,
  unnest(string_split(text, chr(10))) AS text FROM documents""")


def paragraphed(spark, sf) -> DataFrame:
    """Documents with every line as a paragraph."""
    return table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


# ------------------------------------------------------------------ passages and queries

def chunks(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i.alias("chunk_id"), F.floor(i / 5).alias("document_id"), (i % 5).cast("int").alias("ordinal"),
        F.concat(F.lit("c"), F.col("label")).alias("corpus"),
        F.concat(F.lit("Document "), F.floor(i / 5)).alias("title"),
        F.concat(F.lit("text "), i % 400).alias("content"),
        (i % 7 + 1).cast("int").alias("page_start"), (i % 7 + 1 + i % 2).cast("int").alias("page_end"),
        F.col("embedding"))


view("v_chunks", """
SELECT vec_id AS chunk_id, vec_id // 5 AS document_id, vec_id % 5 AS ordinal, 'c' || label AS corpus,
  'Document ' || (vec_id // 5) AS title, 'text ' || (vec_id % 400) AS content,
  vec_id % 7 + 1 AS page_start, vec_id % 7 + 1 + vec_id % 2 AS page_end,
  CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""")


def questions(spark, sf) -> DataFrame:
    """Every fiftieth vector asks a question; two at a time belong to one run."""
    e = table(spark, sf, "embeddings").filter(F.col("vec_id") % 50 == 0)
    return e.select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 100).alias("run_id"),
                    F.concat(F.lit("c"), F.col("label")).alias("corpus"), "embedding")


view("v_questions", """
SELECT vec_id AS query_id, vec_id // 100 AS run_id, 'c' || label AS corpus,
  CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id % 50 = 0""")


def chunk_versions(spark, sf) -> DataFrame:
    """Recorded contents of the passage libraries."""
    d = chunks(spark, sf).select("corpus", "document_id").distinct()
    return d.select("corpus", "document_id", F.explode(
        F.when(F.col("document_id") % 7 != 0, F.array(F.lit(1), F.lit(2)))
         .otherwise(F.array(F.lit(1)))).alias("version"))


view("v_chunk_versions", """
SELECT DISTINCT corpus, document_id, 1 AS version FROM v_chunks
UNION ALL SELECT DISTINCT corpus, document_id, 2 FROM v_chunks WHERE document_id % 7 <> 0""")


def pins(spark, sf) -> DataFrame:
    """The libraries a run searches, in order, each pinned to a version: odd runs search
    three libraries at version 2, even runs two at version 1."""
    runs = questions(spark, sf).select("run_id").distinct()
    n = F.when(F.col("run_id") % 2 == 1, 3).otherwise(2)
    return runs.select("run_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("position"),
                       F.when(F.col("run_id") % 2 == 1, 2).otherwise(1).alias("version")).select(
        "run_id", "position", F.concat(F.lit("c"), (F.col("run_id") + F.col("position") * 3) % 10).alias("corpus"),
        "version")


view("v_pins", """
SELECT run_id, position, 'c' || ((run_id + position * 3) % 10) AS corpus,
  CASE WHEN run_id % 2 = 1 THEN 2 ELSE 1 END AS version
FROM (SELECT run_id, unnest(range(0, CASE WHEN run_id % 2 = 1 THEN 3 ELSE 2 END)) AS position
      FROM (SELECT DISTINCT run_id FROM v_questions))""")


# ------------------------------------------------------------------ traces

def run_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for x in (
        "purchase", "llm_call", "click", "tool_call", "view", "retrieval", "error", "error",
        "signup", "note")])[F.col("event_type")]
    call = F.col("event_type") == "purchase"
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").alias("run_id"), "event_id", "ts", kind.alias("event_type"),
        F.when(call | (F.col("event_type") == "click"), F.floor(F.col("value") * 10)).alias("eval_ms"),
        F.when(call, k * 10).alias("queue_wait_ms"),
        F.when(call, F.col("event_id") % 1000).alias("prompt_tokens"),
        F.when(call, F.col("event_id") % 200).alias("output_tokens"),
        F.when(call, F.concat(F.lit("h"), F.col("event_id") % 2)).alias("host"),
        F.when(F.col("event_type") == "signup", F.lit("speak")).otherwise("act").alias("node"),
        k.alias("k"), "value", "props")


view("v_run_events", """
SELECT user_id AS run_id, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'llm_call' WHEN 'click' THEN 'tool_call'
    WHEN 'view' THEN 'retrieval' WHEN 'error' THEN 'error' ELSE 'note' END AS event_type,
  CASE WHEN event_type IN ('purchase', 'click') THEN CAST(floor(value * 10) AS BIGINT) END AS eval_ms,
  CASE WHEN event_type = 'purchase' THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) * 10 END AS queue_wait_ms,
  CASE WHEN event_type = 'purchase' THEN event_id % 1000 END AS prompt_tokens,
  CASE WHEN event_type = 'purchase' THEN event_id % 200 END AS output_tokens,
  CASE WHEN event_type = 'purchase' THEN 'h' || (event_id % 2) END AS host,
  CASE WHEN event_type = 'signup' THEN 'speak' ELSE 'act' END AS node,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, value, props FROM events""")


def crawl_results(spark, sf) -> DataFrame:
    """One link of a crawl per event, in order of `event_id`. `http_status` is set on errors."""
    e = table(spark, sf, "events")
    status = F.create_map(*[F.lit(x) for x in (
        "error", "error", "signup", "exists", "view", "refused", "click", "added",
        "purchase", "unreadable")])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("crawl_id"), F.col("event_id").alias("position"), "ts",
                    status.alias("status"), F.col("value").alias("secs"),
                    F.when(F.col("event_type") == "error",
                           F.when(k % 25 == 0, 429).when(k % 25 == 1, 503).when(k % 3 == 0, 404)
                           .otherwise(500)).alias("http_status"), k.alias("k"))


view("v_crawl_results", """
SELECT user_id AS crawl_id, event_id AS position, ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'exists' WHEN 'view' THEN 'refused'
    WHEN 'click' THEN 'added' ELSE 'unreadable' END AS status, value AS secs,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 25 = 0 THEN 429 WHEN k % 25 = 1 THEN 503
    WHEN k % 3 = 0 THEN 404 ELSE 500 END END AS http_status, k
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""")


# ------------------------------------------------------------------ transcripts and answers

def transcript(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), "turn", F.col("role").alias("agent_id"),
        F.initcap("role").alias("name"), F.col("text").alias("content"))


view("v_transcript", """
SELECT conv_id AS run_id, turn, role AS agent_id, upper(left(role, 1)) || substr(role, 2) AS name,
  text AS content FROM conversations""")


def answers(spark, sf) -> DataFrame:
    """Generated text with citation markers. A run has one answer per turn."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), "turn",
        F.concat("text", F.lit(" ["), F.col("turn") % 4 + 1, F.lit(", "), F.col("turn") % 3 + 2,
                 F.lit("] ["), F.col("conv_id") % 9 + 1, F.lit("]")).alias("content"))


view("v_answers", """
SELECT conv_id AS run_id, turn, text || ' [' || (turn % 4 + 1) || ', ' || (turn % 3 + 2) || '] ['
  || (conv_id % 9 + 1) || ']' AS content FROM conversations""")


def handed_out(spark, sf) -> DataFrame:
    """What each turn's search returned, in rank order: passages of the embeddings table
    picked by rule. Every third passage was read online and not kept."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), "turn")
    p = chunks(spark, sf).drop("embedding", "ordinal")
    picks = c.select("run_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).withColumn(
        "chunk_id", (F.col("run_id") * 7919 + F.col("turn") * F.col("rank") * 104729) % p.count())
    kept = F.col("chunk_id") % 3 != 0
    return (picks.join(p, "chunk_id")
            .withColumn("similarity", 0.9 - F.col("rank") * 0.1 - (F.col("chunk_id") % 10) * 0.001)
            .withColumn("kept", kept).withColumn("version", F.when(kept, F.col("turn") % 2 + 1))
            .withColumn("url", F.when(~kept, F.concat(F.lit("https://web.example.org/"), "chunk_id")))
            .withColumn("retrieved_at", F.when(~kept, F.lit("2024-05-06")))
            .withColumn("fingerprint", F.when(~kept, F.sha2("content", 256))))


view("v_handed_out", """
SELECT p.run_id, p.turn, p.rank, c.chunk_id, c.document_id, c.corpus, c.title, c.content, c.page_start,
  c.page_end, CAST(0.9 - p.rank * 0.1 - (c.chunk_id % 10) * 0.001 AS DOUBLE) AS similarity,
  c.chunk_id % 3 <> 0 AS kept, CASE WHEN c.chunk_id % 3 <> 0 THEN p.turn % 2 + 1 END AS version,
  CASE WHEN c.chunk_id % 3 = 0 THEN 'https://web.example.org/' || c.chunk_id END AS url,
  CASE WHEN c.chunk_id % 3 = 0 THEN '2024-05-06' END AS retrieved_at,
  CASE WHEN c.chunk_id % 3 = 0 THEN sha256(c.content) END AS fingerprint
FROM (SELECT conv_id AS run_id, turn, rank, (conv_id * 7919 + turn * rank * 104729) % (SELECT count(*) FROM embeddings) AS pick
      FROM conversations, (SELECT unnest([1, 2, 3]) AS rank)) p JOIN v_chunks c ON c.chunk_id = p.pick""")


# ------------------------------------------------------------------ experiments, runs, users

def experiments(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    i = F.col("c_custkey")
    return c.select(i.alias("experiment_id"), F.col("c_name").alias("name"),
                    F.when(i % 3 == 0, "roleplay").when(i % 3 == 1, "document_analysis")
                     .otherwise("agentic_workflow").alias("mode"),
                    F.expr("timestampadd(MINUTE, c_custkey, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
                    F.when(i % 10 == 0, F.expr(
                        "timestampadd(DAY, c_custkey % 365, TIMESTAMP_NTZ'2024-06-01 00:00:00')")).alias("deleted_at"),
                    F.col("c_mktsegment").alias("segment"))


view("v_experiments", """
SELECT c_custkey AS experiment_id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'roleplay'
    WHEN 1 THEN 'document_analysis' ELSE 'agentic_workflow' END AS mode,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(c_custkey AS INTEGER)) AS created_at,
  CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-06-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) END AS deleted_at,
  c_mktsegment AS segment FROM customer""")


def runs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    i = F.col("o_orderkey")
    ntz = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(i.alias("run_id"), F.col("o_custkey").alias("experiment_id"),
                    F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running")
                     .otherwise("pending").alias("status"), ntz.alias("created_at"),
                    F.when(F.col("o_orderstatus") != "P", ntz).alias("started_at"),
                    F.when(F.col("o_orderstatus") == "F",
                           F.expr("timestampadd(SECOND, o_orderkey % 9000, cast(o_orderdate as timestamp_ntz))"))
                     .alias("finished_at"), (i % 100).alias("launched_by"), F.col("o_totalprice").alias("price"))


view("v_runs", """
SELECT o_orderkey AS run_id, o_custkey AS experiment_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded'
    WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(CAST(o_orderkey % 9000 AS INTEGER)) END AS finished_at,
  o_orderkey % 100 AS launched_by, o_totalprice AS price FROM orders""")


def run_libraries(spark, sf) -> DataFrame:
    """Libraries each run pinned: one to three of the document libraries."""
    r = runs(spark, sf).select("run_id", "status")
    libs = table(spark, sf, "documents").select(F.col("source").alias("corpus")).distinct()
    libs = libs.withColumn("slot", F.try_to_number(F.regexp_extract("corpus", "([0-9]+)", 1), F.lit("999")).cast("int"))
    want = r.select("run_id", F.explode(F.sequence(F.lit(0), (F.col("run_id") % 3).cast("int"))).alias("position"))
    return (want.withColumn("slot", ((F.col("run_id") + F.col("position") * 5) % 20).cast("int"))
            .join(libs, "slot").select("run_id", "position", "corpus", (F.col("run_id") % 2 + 1).cast("int").alias("version")))


view("v_run_libraries", """
SELECT w.run_id, w.position, l.corpus, w.run_id % 2 + 1 AS version
FROM (SELECT o_orderkey AS run_id, unnest(range(0, o_orderkey % 3 + 1)) AS position FROM orders) w
JOIN (SELECT DISTINCT source AS corpus, TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS slot
      FROM documents) l ON l.slot = (w.run_id + w.position * 5) % 20""")


def users(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    i = F.col("s_suppkey")
    return s.select(i.alias("user_id"), F.when(i % 4 != 0, F.col("s_name")).otherwise("").alias("name"),
                    F.concat(F.lit("User"), i, F.lit("@"), F.when(i % 3 == 0, "lab.example.edu")
                             .when(i % 3 == 1, "mail.example.com").otherwise("other.example.org")).alias("email"),
                    F.when(i % 5 == 0, "pending").when(i % 11 == 0, "disabled").otherwise("active").alias("status"),
                    F.when(i % 7 == 0, "admin").when(i % 2 == 0, "viewer").otherwise("researcher").alias("role"),
                    F.when(i % 5 != 0, F.floor(i / 2)).alias("approved_by"),
                    (i % 4 != 1).alias("verified"),
                    F.when(i % 6 == 0, "password").otherwise("google").alias("provider"),
                    F.expr("timestampadd(HOUR, s_suppkey, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"))


view("v_users", """
SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE '' END AS name,
  'User' || s_suppkey || '@' || CASE s_suppkey % 3 WHEN 0 THEN 'lab.example.edu' WHEN 1 THEN 'mail.example.com'
    ELSE 'other.example.org' END AS email,
  CASE WHEN s_suppkey % 5 = 0 THEN 'pending' WHEN s_suppkey % 11 = 0 THEN 'disabled' ELSE 'active' END AS status,
  CASE WHEN s_suppkey % 7 = 0 THEN 'admin' WHEN s_suppkey % 2 = 0 THEN 'viewer' ELSE 'researcher' END AS role,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey // 2 END AS approved_by, s_suppkey % 4 <> 1 AS verified,
  CASE WHEN s_suppkey % 6 = 0 THEN 'password' ELSE 'google' END AS provider,
  TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey AS INTEGER)) AS created_at FROM supplier""")


def web_pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")
