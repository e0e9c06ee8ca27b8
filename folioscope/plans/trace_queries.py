"""Queries over runs, traces and schema rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import quality as qa, trace as op
from . import adapters as ad
from .document_queries import cut, squeeze
from .registry import query

_METRICS = """SELECT run_id, count(*) FILTER (WHERE event_type = 'llm_call') AS model_calls,
  count(*) FILTER (WHERE event_type = 'tool_call') AS tool_calls,
  count(*) FILTER (WHERE event_type = 'retrieval') AS retrievals, count(*) FILTER (WHERE event_type = 'error') AS errors,
  CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(eval_ms), 0) AS BIGINT) AS total_eval_ms, CAST(coalesce(sum(queue_wait_ms), 0) AS BIGINT) AS total_queue_wait_ms,
  CAST(coalesce(max(queue_wait_ms), 0) AS BIGINT) AS max_queue_wait_ms FROM v_run_events GROUP BY run_id"""
_SHARE = "round_even(CAST(total_queue_wait_ms AS DOUBLE) / greatest(1, total_queue_wait_ms + total_eval_ms), 3) AS queue_share"


@query("e1_run_metrics", _METRICS)
def _(spark, sf):
    return op.run_metrics(ad.run_events(spark, sf)).drop("queue_share")


@query("e2_queue_share", f"SELECT run_id, {_SHARE} FROM ({_METRICS})")
def _(spark, sf):
    return op.run_metrics(ad.run_events(spark, sf)).select("run_id", "queue_share")


@query("e3_host_calls", "SELECT run_id, host, count(*) AS calls FROM v_run_events WHERE host IS NOT NULL GROUP BY run_id, host")
def _(spark, sf):
    return op.host_calls(ad.run_events(spark, sf))


def _listed(where, order):
    return f"""
SELECT e.experiment_id, e.name, e.mode, coalesce(r.n, 0) AS run_count, strftime(r.last_run, '%Y-%m-%d') AS last_run,
  row_number() OVER (ORDER BY {order} DESC, e.experiment_id DESC) AS place
FROM v_experiments e LEFT JOIN (SELECT experiment_id, count(*) AS n, max(created_at) AS last_run FROM v_runs GROUP BY 1) r
  USING (experiment_id) WHERE {where}"""


def _placed(df, by):
    from ..scale import with_position
    return with_position(df.withColumn("__all", F.lit(0)), ["__all"], [F.desc(by), F.desc("experiment_id")], "place").select(
        "experiment_id", "name", "mode", "run_count", F.date_format("last_run", "yyyy-MM-dd").alias("last_run"), "place")


@query("e4_experiment_list", _listed("e.deleted_at IS NULL", "e.created_at"))
def _(spark, sf):
    return _placed(op.experiment_list(ad.experiments(spark, sf), ad.runs(spark, sf)), "created_at")


@query("e4_trash_list", _listed("e.deleted_at IS NOT NULL", "e.deleted_at"))
def _(spark, sf):
    return _placed(op.experiment_list(ad.experiments(spark, sf), ad.runs(spark, sf), trashed=True), "deleted_at")


@query("e5_latest_runs", """
SELECT r.run_id, e.name AS experiment_name, e.mode, r.status FROM v_runs r JOIN v_experiments e USING (experiment_id)
WHERE e.deleted_at IS NULL ORDER BY r.created_at DESC, r.run_id DESC LIMIT 50""")
def _(spark, sf):
    return op.latest_runs(ad.runs(spark, sf), ad.experiments(spark, sf)).select("run_id", "experiment_name", "mode", "status")


@query("e5_run_detail", """
SELECT r.run_id, e.name AS experiment_name, e.mode, coalesce(nullif(u.name, ''), u.email) AS launched_by_name,
  coalesce(l.libs, '') AS libraries
FROM v_runs r JOIN v_experiments e USING (experiment_id) LEFT JOIN v_users u ON u.user_id = r.launched_by
LEFT JOIN (SELECT run_id, string_agg(corpus || ' v' || version, ', ' ORDER BY position) AS libs FROM v_run_libraries GROUP BY 1) l
  ON l.run_id = r.run_id""")
def _(spark, sf):
    d = op.run_detail(ad.runs(spark, sf), ad.experiments(spark, sf), ad.users(spark, sf), ad.run_libraries(spark, sf))
    libs = F.array_join(F.transform("libraries", lambda x: F.concat(x["corpus"], F.lit(" v"), x["version"])), ", ")
    return d.select("run_id", "experiment_name", "mode", "launched_by_name", F.coalesce(libs, F.lit("")).alias("libraries"))


_PLAN = """
plan AS (SELECT e.*, EXISTS (SELECT 1 FROM v_runs r WHERE r.experiment_id = e.experiment_id AND r.status IN ('pending', 'running')) AS busy
         FROM v_experiments e)"""


@query("e6_trash_plan", f"""WITH {_PLAN}
SELECT experiment_id, busy, CASE WHEN busy THEN 'refused' WHEN deleted_at IS NULL THEN 'may be trashed' ELSE 'may be deleted' END AS action FROM plan""")
def _(spark, sf):
    return op.trash_plan(ad.experiments(spark, sf), ad.runs(spark, sf)).select("experiment_id", "busy", "action")


@query("e6_after_trash", f"""WITH {_PLAN}
SELECT experiment_id, CASE WHEN experiment_id % 4 < 2 THEN CASE WHEN busy THEN 'refused' ELSE 'trashed' END WHEN experiment_id % 4 = 2 THEN 'restored' ELSE 'unchanged' END AS outcome,
  strftime(CASE WHEN experiment_id % 4 < 2 AND NOT busy THEN coalesce(deleted_at, TIMESTAMP '2025-01-01') WHEN experiment_id % 4 = 2 THEN NULL ELSE deleted_at END, '%Y-%m-%d') AS deleted FROM plan""")
def _(spark, sf):
    e = ad.experiments(spark, sf)
    i = F.col("experiment_id")
    asked = e.select("experiment_id", F.when(i % 4 < 2, "trash").when(i % 4 == 2, "restore").alias("ask")).filter("ask is not null")
    out = op.moved_to_trash(e, ad.runs(spark, sf), asked, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("experiment_id", "outcome", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted"))


@query("e6_empty_trash", f"""WITH {_PLAN}, gone AS (SELECT experiment_id FROM plan WHERE NOT busy AND deleted_at IS NOT NULL),
left_runs AS (SELECT run_id FROM v_runs WHERE experiment_id NOT IN (SELECT experiment_id FROM gone))
SELECT 'experiments' AS "table", count(*) AS rows FROM v_experiments WHERE experiment_id NOT IN (SELECT experiment_id FROM gone)
UNION ALL SELECT 'runs', count(*) FROM left_runs
UNION ALL SELECT 'run_libraries', count(*) FROM v_run_libraries WHERE run_id IN (SELECT run_id FROM left_runs)""")
def _(spark, sf):
    # Orders are never finished for long here, so only finished runs count as this experiment's.
    left = op.empty_trash(ad.experiments(spark, sf), ad.runs(spark, sf), run_libraries=ad.run_libraries(spark, sf))
    counts = [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, d in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("e7_launch_settings", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN least(100, greatest(2, c_custkey % 300)) WHEN 1 THEN 60 ELSE 100 END AS max_turns,
  CASE WHEN c_custkey % 4 IN (0, 1) THEN greatest(40, least(c_nationkey * 100, 2000)) ELSE 2000 END AS word_limit,
  CASE WHEN c_custkey % 4 = 2 THEN greatest(5, least(c_nationkey * 90, 1440)) ELSE 120 END AS time_limit_minutes,
  CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS settings FROM customer""")
def _(spark, sf):
    c = ad.table(spark, sf, "customer")
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    none = F.expr("cast(map() as map<string,string>)")
    config = (F.when(i % 4 < 2, F.create_map(F.lit("max_turns"), F.lit("60"), F.lit("word_limit"), (n * 100).cast("string")))
              .when(i % 4 == 2, F.create_map(F.lit("time_limit_minutes"), (n * 90).cast("string"))).otherwise(none))
    inputs = F.when(i % 4 == 0, F.create_map(F.lit("max_turns"), (i % 300).cast("string"))).otherwise(none)
    s = op.launch_settings(config, inputs)
    return c.select("c_custkey", s["max_turns"].alias("max_turns"), s["word_limit"].alias("word_limit"),
                    s["time_limit_minutes"].alias("time_limit_minutes"), F.size(s["merged"]).alias("settings"))


@query("e8_turns_spoken", """
SELECT run_id, count(*) AS turns FROM v_run_events WHERE node = 'speak' AND event_type = 'note' AND k % 3 <> 0
GROUP BY run_id""")
def _(spark, sf):
    e = ad.run_events(spark, sf)
    e = e.withColumn("spoken", F.when(F.col("k") % 3 != 0, F.col("k")))
    return op.turns_spoken(e, e.select("run_id").distinct())


_ELAPSED = """CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min' ELSE (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' END"""


@query("e9_run_rows", f"""
WITH r AS (SELECT run_id, status, started_at, finished_at, run_id % 3 = 0 AS roleplay, run_id % 40 AS turns,
    date_diff('second', started_at, coalesce(finished_at, TIMESTAMP '2002-01-01')) AS s FROM v_runs)
SELECT run_id, status IN ('pending', 'running') AS active,
  CASE WHEN started_at IS NULL THEN '—' WHEN finished_at IS NOT NULL THEN {_ELAPSED} ELSE {_ELAPSED} || ' so far' END AS took,
  CASE WHEN status <> 'succeeded' AND roleplay THEN 'In progress: ' || turns || ' of up to 100 turns so far'
    WHEN status = 'pending' THEN 'Starting' WHEN status = 'running' THEN 'In progress'
    WHEN roleplay THEN turns || ' turns · Settled.' ELSE 'Settled.' END AS summary,
  CASE WHEN started_at IS NULL THEN '—' ELSE strftime(started_at, '%b %-d, %H:%M') END AS started FROM r""")
def _(spark, sf):
    r = ad.runs(spark, sf).select(
        "run_id", "status", "started_at", "finished_at", F.when(F.col("run_id") % 3 == 0, "roleplay").otherwise("document_analysis").alias("mode"),
        (F.col("run_id") % 40).alias("turns"), F.lit(100).alias("max_turns"), F.lit("*Settled.*").alias("answer"),
        F.lit(None).cast("string").alias("error"))
    return op.run_rows(r, F.expr("TIMESTAMP_NTZ'2002-01-01 00:00:00'")).select("run_id", "active", "took", "summary", "started")


@query("e10_call_rates", """
SELECT run_id, event_id, coalesce(round_even(CASE WHEN eval_ms > 0 THEN output_tokens / (eval_ms / 1000.0::DOUBLE) END, 1), 0.0) AS tokens_per_s,
  k % 10 = 0 AS truncated FROM v_run_events WHERE event_type = 'llm_call'""")
def _(spark, sf):
    e = ad.run_events(spark, sf).withColumn("done_reason", F.when(F.col("k") % 10 == 0, "length").otherwise("stop"))
    return op.call_rates(e).select("run_id", "event_id", "tokens_per_s", "truncated")


@query("e11_latency_table", """
WITH c AS (SELECT user_id % 5 AS level, event_id, value, event_type = 'error' AS failed, event_id % 200 AS tokens,
    epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY value, event_id) AS pos, count(*) OVER (PARTITION BY level) AS n FROM c)
SELECT level, count(*) - count(*) FILTER (WHERE failed) AS ok, count(*) FILTER (WHERE failed) AS errors, CAST(sum(tokens) AS BIGINT) AS tokens,
  round_even(max(s + value) - min(s), 2) AS wall_s, round_even(sum(tokens) / (max(s + value) - min(s)), 4) AS tokens_per_s,
  round_even(median(value), 4) AS p50, round_even(max(value) FILTER (WHERE pos = least(n, n * 95 // 100 + 1)), 4) AS p95
FROM p GROUP BY level""")
def _(spark, sf):
    e = ad.table(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    return op.latency_table(e.select(
        (F.col("user_id") % 5).alias("level"), F.col("event_id").alias("call_id"), F.col("value").alias("latency_s"),
        (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 200).alias("tokens"), start.alias("start_s")))


@query("e12_retrieval_trace", """
SELECT run_id, turn, string_agg(chunk_id || ':' || document_id || ':' || printf('%.4f', similarity), ' ' ORDER BY rank) AS hits
FROM v_handed_out GROUP BY run_id, turn""")
def _(spark, sf):
    hit = lambda h: F.concat_ws(":", h["chunk_id"].cast("string"), h["document_id"].cast("string"),
                                F.format_string("%.4f", h["similarity"]))
    return op.retrieval_trace(ad.handed_out(spark, sf)).select(
        "run_id", "turn", F.array_join(F.transform("hits", hit), " ").alias("hits"))


@query("e13_sequence", "SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM v_run_events")
def _(spark, sf):
    return op.sequence_numbers(ad.run_events(spark, sf).select("run_id", "event_id", "ts")).drop("ts")


@query("e14_activity", """
SELECT run_id, event_id, event_type, node, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM v_run_events""")
def _(spark, sf):
    return op.activity(ad.run_events(spark, sf), "run_id", "event_id", "event_type", "node")


@query("e14_trace_text_cuts", """
SELECT doc_id, left(text, 2000) AS prompt, sha256(left(text, 8000)) AS response_sha, sha256(left(text, 50000)) AS tool_result_sha FROM documents""")
def _(spark, sf):
    c = op.TRACE_CUTS
    return ad.table(spark, sf, "documents").select(
        "doc_id", F.substring("text", 1, c["prompt"]).alias("prompt"),
        F.sha2(F.substring("text", 1, c["response"]), 256).alias("response_sha"),
        F.sha2(F.substring("text", 1, c["tool_result"]), 256).alias("tool_result_sha"))


@query("e15_research_plan", f"""
WITH q AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '. '), lambda x: {squeeze('x')}), lambda x: x <> '')[1:8] AS qs,
    CASE turn % 3 WHEN 0 THEN 'src1' WHEN 1 THEN 'web' ELSE 'databases' END AS place, text FROM conversations)
SELECT conv_id, turn, id, question, look_in, libraries FROM (
  SELECT conv_id, turn, 'Q' || CAST(unnest(range(1, len(qs) + 1)) AS BIGINT) AS id, unnest(qs) AS question,
    CASE WHEN place = 'databases' THEN '' ELSE place END AS look_in, CASE WHEN place = 'src1' THEN 'src2,src1' ELSE 'src2' END AS libraries FROM q)""")
def _(spark, sf):
    c = ad.table(spark, sf, "conversations")
    place = F.when(F.col("turn") % 3 == 0, "src1").when(F.col("turn") % 3 == 1, "web").otherwise("databases")
    subs = F.transform(F.split("text", r"\. "), lambda q: F.struct(
        q.alias("question"), F.array(place, F.lit("nowhere"), place).alias("look_in")))
    plans = c.select("conv_id", "turn", F.lit("").alias("question"), F.col("text").alias("brief"), subs.alias("sub_questions"),
                     F.array(F.lit("src2"), F.lit("elsewhere")).alias("libraries"))
    d = op.normalize_plan(plans, ["src1", "src2", "src3"], databases=False, web=True)
    return d.select("conv_id", "turn", F.array_join("libraries", ",").alias("libraries"), F.explode("sub_questions").alias("q")).select(
        "conv_id", "turn", "q.id", "q.question", F.array_join("q.look_in", ",").alias("look_in"), "libraries")


@query("e15_research_settings", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false ELSE c_custkey % 2 = 0 END AS choose_libraries,
  CASE WHEN c_custkey % 5 = 0 THEN false ELSE c_custkey % 7 = 0 END AS use_databases, c_custkey % 4 = 0 AS use_web,
  CASE WHEN c_custkey % 6 = 0 THEN 120 ELSE greatest(5, least(c_custkey, 1440)) END AS time_limit_minutes,
  CASE WHEN c_custkey % 2 = 0 THEN 'a task' ELSE 'about ' || c_name END AS brief,
  CASE WHEN c_custkey % 3 = 0 THEN 'Kept pages' ELSE 'Fetched: ' || c_name END AS fetch_library FROM customer""")
def _(spark, sf):
    c = ad.table(spark, sf, "customer")
    i = F.col("c_custkey")
    s = op.research_settings({
        "choose_libraries": F.when(i % 3 < 2, i % 3 == 0), "use_databases": F.when(i % 5 == 0, False), "use_web": F.when(i % 4 == 0, True),
        "allow_network": F.when(i % 7 == 0, True), "named": F.when(i % 2 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("src1"))),
        "time_limit_minutes": F.when(i % 6 == 0, "soon").otherwise(i.cast("string"))})
    return c.select("c_custkey", *[v.alias(k) for k, v in s.items()],
                    op.brief_of(F.concat(F.lit(" about "), "c_name"), F.when(i % 2 == 0, " a task ").otherwise(" ")).alias("brief"),
                    op.fetch_library(F.when(i % 3 == 0, "  Kept   pages").when(i % 3 == 1, " "), F.col("c_name")).alias("fetch_library"))


# ------------------------------------------------------------------ schema rules

@query("q1_value_checks", """
SELECT 'event_type' AS "column", event_type AS value, count(*) AS rows FROM events WHERE event_type <> 'error' GROUP BY event_type
UNION ALL SELECT 'mapped', event_type, count(*) FROM v_run_events WHERE event_type = 'retrieval' GROUP BY event_type""")
def _(spark, sf):
    allowed = qa.ALLOWED["event_type"]
    raw = qa.value_violations(ad.table(spark, sf, "events"), {"event_type": allowed})
    mapped = ad.run_events(spark, sf).withColumnRenamed("event_type", "mapped")
    return raw.unionByName(qa.value_violations(mapped, {"mapped": [a for a in allowed if a != "retrieval"]}))


@query("q2_repeated_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return qa.repeated_keys(ad.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q2_repeated_live_text", """
SELECT corpus, sha256, count(*) AS rows FROM v_documents WHERE NOT removed GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return qa.repeated_keys(ad.documents(spark, sf).filter("not removed"), ["corpus", "sha256"])


@query("q3_orphans", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""")
def _(spark, sf):
    done = ad.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return qa.orphans(ad.table(spark, sf, "lineitem"), done, {"l_orderkey": "o_orderkey"}).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("q3_documents_without_passages", """
SELECT document_id, corpus FROM v_documents WHERE document_id NOT IN (SELECT document_id FROM v_chunks)""")
def _(spark, sf):
    return qa.documents_without_passages(ad.documents(spark, sf), ad.chunks(spark, sf)).select("document_id", "corpus")
