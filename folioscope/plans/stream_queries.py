"""Queries that run a streaming job over the given files to its end and read the result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import pacing
from ..scale import ensure_checkpoint_dir
from ..streaming import streams as st
from . import adapters as ad
from .registry import query
from .trace_queries import _METRICS, _SHARE


def _room(spark) -> tuple[str, str]:
    """A new folder for a job's output and one for its place, where executors can reach them."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/place"


def _stream(spark, sf, name):
    # A table is one file or a folder of parts; its own path stands for both.
    return st.landed(spark, f"{sf}/{name}.parquet", ad.table(spark, sf, name).schema)


class _Streamed:
    """Stands in for the folder reader in the adapters, so that one rule maps both."""

    def __init__(self, spark):
        self._spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path):
        folder, _, name = path.rpartition("/")
        return _stream(self._spark, folder, name.removesuffix(".parquet"))


def _live(spark):
    return _Streamed(spark)


@query("x1_trace_tail", "SELECT run_id, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM v_run_events GROUP BY 1")
def _(spark, sf):
    out, place = _room(spark)
    st.tail(ad.run_events(_live(spark), sf), out, place).awaitTermination()
    return spark.read.parquet(out).groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum"))


@query("x2_running_metrics", f"SELECT *, {_SHARE} FROM ({_METRICS})")
def _(spark, sf):
    out, place = _room(spark)
    st.running_metrics(ad.run_events(_live(spark), sf), out, place).awaitTermination()
    return st.latest(spark, out, ["run_id"])


@query("x3_hourly_volume", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, host, count(*) AS events, CAST(sum(eval_ms) AS BIGINT) AS eval_ms FROM v_run_events WHERE host IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    out, place = _room(spark)
    e = ad.run_events(_live(spark), sf).filter("host is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    st.volume(e, out, place, "1 hour", late="40 days").awaitTermination()
    return st.latest(spark, out, ["start", "host"]).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "host", "events", "eval_ms")


@query("x3_sliding_volume", """
SELECT strftime(date_trunc('day', ts) - to_days(CAST(d AS INTEGER)), '%Y-%m-%d') AS day, host, count(*) AS events, CAST(sum(eval_ms) AS BIGINT) AS eval_ms
FROM v_run_events, (SELECT unnest([0, 1]) AS d) WHERE host IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    out, place = _room(spark)
    e = ad.run_events(_live(spark), sf).filter("host is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    st.volume(e, out, place, "2 days", "1 day", late="40 days").awaitTermination()
    return st.latest(spark, out, ["start", "host"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "host", "events", "eval_ms")


@query("x3_sessions", """
WITH e AS (SELECT run_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts)) > 1800 * 1000000::BIGINT, true) AS new FROM v_run_events),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY run_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS events FROM s GROUP BY run_id, n""")
def _(spark, sf):
    out, place = _room(spark)
    e = ad.run_events(_live(spark), sf).withColumn("ts", F.col("ts").cast("timestamp"))
    st.sessions(e, out, place).awaitTermination()
    s = st.every(spark, out).unionByName(st.open_sessions(spark, place))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)      # noqa: E731
    return s.select("run_id", at("start"), at("end"), "events")


@query("x4_streamed_documents", """
SELECT doc_id AS document_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source, sha256(text)) AND doc_id % 10 <> 0 THEN 'added'
  WHEN EXISTS (SELECT 1 FROM documents h WHERE h.doc_id % 10 = 0 AND h.source = d.source AND h.text = d.text) THEN 'duplicate'
  WHEN doc_id = min(doc_id) OVER (PARTITION BY source, sha256(text)) THEN 'added' ELSE 'duplicate' END AS status FROM documents d WHERE doc_id % 10 <> 0""")
def _(spark, sf):
    out, place = _room(spark)
    held = ad.table(spark, sf, "documents").filter("doc_id % 10 = 0").select(F.col("source").alias("corpus"), F.sha2("text", 256).alias("sha256"))
    def arriving(d):
        return d.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("document_id"), F.col("source").alias("corpus"), F.sha2("text", 256).alias("sha256"),
                                                   F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP'2024-01-01 00:00:00')").alias("arrived"))
    st.add_documents(arriving(_stream(spark, sf, "documents")), held, out, place).awaitTermination()
    return st.add_statuses(arriving(ad.table(spark, sf, "documents")), st.every(spark, out)).select("document_id", "status")


_MESSAGE_TOKENS = """m AS (SELECT run_id, agent_id, message_id, content, row_number() OVER w AS i, sum(tokens) OVER w AS upto FROM (
    SELECT conv_id AS run_id, CASE turn % 2 WHEN 0 THEN 'first' ELSE 'second' END AS agent_id, turn AS message_id, role || ': ' || text AS content,
      greatest(1, CAST(floor(length(text) / 3.5) AS BIGINT)) AS tokens FROM conversations)
  WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY message_id)),
f AS (SELECT run_id, agent_id, i, 0::BIGINT AS gone, 0::BIGINT AS folds, 0::BIGINT AS n FROM m WHERE i = 1
  UNION ALL SELECT f.run_id, f.agent_id, f.i + 1, CASE WHEN over THEN f.gone + fold ELSE f.gone END, CASE WHEN over THEN f.folds + 1 ELSE f.folds END, CASE WHEN over THEN fold ELSE 0 END
  FROM (SELECT f.*, m.upto - coalesce(b.upto, 0) > 300 AND m.i - f.gone >= 2 AS over, greatest(2, CAST(floor((m.i - f.gone) * 0.5) AS BIGINT)) AS fold
    FROM f JOIN m ON f.run_id = m.run_id AND f.agent_id = m.agent_id AND f.i + 1 = m.i LEFT JOIN m b ON b.run_id = f.run_id AND b.agent_id = f.agent_id AND b.i = f.gone) f)"""


def _memory_stream(spark, sf):
    """Each conversation is a run with two agents, who take its turns by turns."""
    return _stream(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.when(F.col("turn") % 2 == 0, "first").otherwise("second").alias("agent_id"), "role",
        F.col("turn").alias("message_id"), F.col("text").alias("content"))


@query("x5_streamed_compaction", f"""
WITH RECURSIVE {_MESSAGE_TOKENS}
SELECT f.run_id, f.agent_id, f.folds AS summary_no, f.n AS messages, string_agg(m.content, chr(10) ORDER BY m.i) AS excerpt
FROM f JOIN m ON f.run_id = m.run_id AND f.agent_id = m.agent_id AND m.i > f.gone - f.n AND m.i <= f.gone WHERE f.n > 0 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    out, place = _room(spark)
    st.compaction(_memory_stream(spark, sf), out, place, budget=300).awaitTermination()
    return st.every(spark, out)


@query("x5_buffers_held", f"""
WITH RECURSIVE {_MESSAGE_TOKENS},
e AS (SELECT run_id, agent_id, max(gone) AS gone FROM f GROUP BY 1, 2)
SELECT m.run_id, m.agent_id, m.message_id FROM m JOIN e ON m.run_id = e.run_id AND m.agent_id = e.agent_id WHERE m.i > e.gone""")
def _(spark, sf):
    out, place = _room(spark)
    st.compaction(_memory_stream(spark, sf), out, place, budget=300).awaitTermination()
    return st.buffers(spark, place).select("run_id", "agent_id", "message_id")


@query("x6_streamed_halts", """
WITH n AS (SELECT *, status = 'error' AND coalesce(lag(status) OVER w = 'error', false) AND coalesce(lag(status, 2) OVER w = 'error', false) AS third,
    status = 'error' AND http_status IN (429, 503) AS busy FROM v_crawl_results WINDOW w AS (PARTITION BY crawl_id ORDER BY position))
SELECT crawl_id, min(position) AS position, CASE WHEN arg_min(busy, position) THEN 'busy' ELSE 'three in a row' END AS reason FROM n WHERE third OR busy GROUP BY 1""")
def _(spark, sf):
    out, place = _room(spark)
    st.crawl_halts(ad.crawl_results(_live(spark), sf).select("crawl_id", "position", "status", "http_status"), out, place).awaitTermination()
    return st.every(spark, out)


_PACED = """
WITH r AS (SELECT 'p' || user_id AS source, event_id AS request_id, epoch_us(ts) / 1000000.0::DOUBLE AS at_s, event_type = 'error' AND value < 20 AS limited FROM events),
w AS (SELECT *, max(CASE WHEN limited THEN at_s END) OVER p AS last_limited, max(at_s) OVER p AS last FROM r
  WINDOW p AS (PARTITION BY source ORDER BY at_s, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, request_id, coalesce(at_s - last_limited < 1800, false) AS cooling, coalesce(at_s - last < 60, false) AS too_soon FROM w"""


def _requests(reader, sf):
    e = ad.table(reader, sf, "events")
    return e.select(F.concat(F.lit("p"), "user_id").alias("source"), F.col("event_id").alias("request_id"),
                    (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at_s"), ((F.col("event_type") == "error") & (F.col("value") < 20)).alias("limited"))


@query("x7_cooldowns", _PACED)
def _(spark, sf):
    return pacing.cooldowns(_requests(spark, sf), 1800, 60).select("source", "request_id", "cooling", "too_soon")


@query("x7_streamed_cooldowns", _PACED)
def _(spark, sf):
    out, place = _room(spark)
    st.cooldowns(_requests(_live(spark), sf), out, place, 1800, 60).awaitTermination()
    return st.every(spark, out)


@query("x8_turn_deadlines", """
WITH n AS (SELECT user_id AS run_id, event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'opened' ELSE 'replied' END AS kind FROM events),
l AS (SELECT *, lead(kind) OVER w AS next_kind, lead(ts) OVER w AS next_ts FROM n WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id))
SELECT run_id, event_id, CASE WHEN next_kind = 'replied' AND epoch_us(next_ts) - epoch_us(ts) < 36001 * 1000000::BIGINT THEN 'answered' ELSE 'passed over' END AS outcome FROM l WHERE kind = 'opened'""")
def _(spark, sf):
    e = ad.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", F.when(
        F.col("event_type").isin("click", "view"), "opened").otherwise("replied").alias("kind"))
    return pacing.turn_deadlines(e, 600).select("run_id", "event_id", "outcome")


@query("x8_streamed_deadlines", """
WITH n AS (SELECT user_id AS run_id, event_id AS turn, epoch_ms(ts) AS ms, CASE WHEN event_type IN ('click', 'view') THEN 'opened' ELSE 'replied' END AS kind FROM events),
l AS (SELECT *, lead(kind) OVER w AS next_kind, lead(ms) OVER w AS next_ms FROM n WINDOW w AS (PARTITION BY run_id ORDER BY ms, turn))
SELECT run_id, turn, CASE WHEN next_kind = 'replied' AND next_ms - ms <= 36000000 THEN 'answered' WHEN next_ms IS NULL AND ms + 36000000 > (SELECT max(ms) FROM n) - 60000 THEN 'open'
  ELSE 'passed over' END AS outcome FROM l WHERE kind = 'opened'""")
def _(spark, sf):
    out, place = _room(spark)
    e = _stream(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("ts"), F.when(
        F.col("event_type").isin("click", "view"), "opened").otherwise("replied").alias("kind"))
    st.turn_deadlines(e, out, place, 600).awaitTermination()
    return st.every(spark, out).unionByName(st.open_turns(spark, place).select("run_id", "turn", F.lit("open").alias("outcome")))


@query("x8_past_time_limit", """
WITH b AS (SELECT user_id, min(ts) AS began FROM events GROUP BY 1)
SELECT e.user_id AS run_id, count(*) AS events FROM events e JOIN b USING (user_id)
WHERE epoch_us(e.ts) - epoch_us(b.began) >= ((e.user_id % 7 * 1440 + 5) * 60 + 1) * 1000000::BIGINT GROUP BY 1""")
def _(spark, sf):
    e = ad.run_events(spark, sf).select("run_id", "ts")
    limits = e.select("run_id").distinct().withColumn("limit_minutes", F.col("run_id") % 7 * 1440 + 5)
    return pacing.past_limit(limits, e).groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))


@query("x9_versions_on_change", """
SELECT corpus, 1 AS version, count(*) AS documents FROM v_state WHERE live GROUP BY corpus""")
def _(spark, sf):
    out, place = _room(spark)
    st.record_versions(ad.change_log(_live(spark), sf), out, place).awaitTermination()
    m = spark.read.option("basePath", f"{out}/members").parquet(f"{out}/members")
    return m.groupBy("corpus", "version").agg(F.count(F.lit(1)).alias("documents"))
