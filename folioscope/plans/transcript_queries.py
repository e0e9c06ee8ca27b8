"""Queries over transcripts, memory and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import transcripts as op
from . import adapters as ad
from .document_queries import wc
from .registry import query, view

view("v_messages", """
SELECT conv_id AS run_id, role AS agent_id, role, conv_id * 100000 + turn AS message_id, text AS content, (conv_id + turn) % 5 = 0 AS archived,
  greatest(1, CAST(floor(length(text) / 3.5) AS BIGINT)) AS tokens FROM conversations""")
view("v_buffer", "SELECT *, row_number() OVER (PARTITION BY run_id, agent_id ORDER BY message_id) AS n FROM v_messages WHERE NOT archived")


def _messages(spark, sf):
    c = ad.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("role").alias("agent_id"), "role",
                    (F.col("conv_id") * 100000 + F.col("turn")).alias("message_id"), F.col("text").alias("content"),
                    ((F.col("conv_id") + F.col("turn")) % 5 == 0).alias("archived"))


@query("m1_short_term", "SELECT run_id, agent_id, message_id, n, tokens FROM v_buffer")
def _(spark, sf):
    return op.short_term(_messages(spark, sf)).select("run_id", "agent_id", "message_id", "n", "tokens")


@query("m1_buffer_totals", "SELECT run_id, agent_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_buffer GROUP BY 1, 2")
def _(spark, sf):
    return op.buffer_totals(_messages(spark, sf))


view("v_fold", """
SELECT b.run_id, b.agent_id, b.message_id, b.n, b.role || ': ' || b.content AS line FROM v_buffer b JOIN (
  SELECT run_id, agent_id, greatest(2, CAST(floor(count(*) * 0.5) AS BIGINT)) AS fold FROM v_buffer GROUP BY 1, 2 HAVING sum(tokens) > 300 AND count(*) >= 2) f
  ON f.run_id = b.run_id AND f.agent_id = b.agent_id AND b.n <= f.fold""")


@query("m2_compaction_plan", "SELECT run_id, agent_id, message_id, n, line FROM v_fold")
def _(spark, sf):
    return op.compaction_plan(_messages(spark, sf), budget=300).select("run_id", "agent_id", "message_id", "n", "line")


@query("m2_after_compaction", """
SELECT run_id, agent_id, count(*) AS messages FROM v_buffer b WHERE NOT EXISTS (SELECT 1 FROM v_fold f WHERE f.message_id = b.message_id) GROUP BY 1, 2""")
def _(spark, sf):
    m = _messages(spark, sf)
    return op.buffer_totals(op.archive(m, op.compaction_plan(m, budget=300))).drop("tokens")


@query("m3_prompt", """
WITH q AS (SELECT DISTINCT run_id, agent_id FROM v_messages), p AS (
  SELECT run_id, agent_id, 0 AS s, 0 AS pos, 'system' AS role, 'Be brief.' || CASE WHEN run_id % 2 = 0 THEN chr(10) || chr(10) || 'Relevant memory from earlier in this matter:' || chr(10) || '- first' || chr(10) || '- second' ELSE '' END AS content FROM q
  UNION ALL SELECT run_id, agent_id, 1, message_id, role, content FROM v_buffer UNION ALL SELECT run_id, agent_id, 2, 0, 'user', 'And now?' FROM q)
SELECT run_id, agent_id, role, content, row_number() OVER (PARTITION BY run_id, agent_id ORDER BY s, pos) AS n FROM p""")
def _(spark, sf):
    m = _messages(spark, sf)
    asked = m.select("run_id", "agent_id").distinct().withColumns({"system_prompt": F.lit("Be brief."), "query": F.lit("And now?")})
    known = asked.filter("run_id % 2 = 0").select("run_id", "agent_id", F.explode(F.array(
        F.struct(F.lit(2).alias("rank"), F.lit("second").alias("content")), F.struct(F.lit(1).alias("rank"), F.lit("first").alias("content")))).alias("x"))
    return op.prompts(asked, known.select("run_id", "agent_id", "x.*"), op.short_term(m)).select("run_id", "agent_id", "role", "content", "n")


@query("r5_memory_list", """
SELECT 'c' || label AS agent_id, vec_id AS memory_id, CASE WHEN vec_id % 4 = 0 THEN 'fact' ELSE 'summary' END AS kind, vec_id * 2 AS source_event_id,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings""")
def _(spark, sf):
    c = ad.chunks(spark, sf)
    m = c.select(F.lit(1).alias("run_id"), F.col("corpus").alias("agent_id"), F.col("chunk_id").alias("memory_id"), F.when(
        F.col("chunk_id") % 4 == 0, "fact").otherwise("summary").alias("kind"), "content", (F.col("chunk_id") * 2).alias("source_event_id"),
        F.lit(None).cast("long").alias("source_chunk_id"))
    return op.long_term(m).select("agent_id", "memory_id", "kind", "source_event_id", "n")


_SEATS = [("user", 0), ("assistant", 1), ("system", 2), ("observer", 3)]
view("v_roster", "SELECT run_id, agent_id, seat FROM (SELECT DISTINCT run_id FROM v_transcript), (VALUES ('user', 0), ('assistant', 1), ('system', 2), ('observer', 3)) x(agent_id, seat)")


def _roster(spark, sf, seats=4):
    runs = ad.transcript(spark, sf).select("run_id").distinct()
    return runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(a).alias("agent_id"), F.lit(s).alias("seat"), F.lit(a.title()).alias("name"))
                                                     for a, s in _SEATS[:seats]])).alias("x")).select("run_id", "x.*")


@query("m4_speaking_counts", """
SELECT r.run_id, r.agent_id, count(t.turn) AS turns FROM v_roster r LEFT JOIN v_transcript t ON t.run_id = r.run_id AND t.agent_id = r.agent_id GROUP BY 1, 2""")
def _(spark, sf):
    return op.speaking_counts(_roster(spark, sf), ad.transcript(spark, sf)).select("run_id", "agent_id", "turns")


@query("m5_speakers", f"""
WITH s AS (SELECT run_id, agent_id, count(*) AS turns, CAST(sum({wc('content')}) AS BIGINT) AS words, CAST(sum(turn % 3) AS BIGINT) AS cited, CAST(sum(turn % 2) AS BIGINT) AS disclosed,
    min(turn) AS first FROM v_transcript GROUP BY 1, 2),
j AS (SELECT coalesce(r.run_id, s.run_id) AS run_id, coalesce(r.agent_id, s.agent_id) AS agent_id, coalesce(seat, 1000000) AS seat, coalesce(first, 0) AS first,
    turns, words, cited, disclosed FROM (SELECT * FROM v_roster WHERE agent_id IN ('user', 'observer')) r FULL JOIN s ON s.run_id = r.run_id AND s.agent_id = r.agent_id)
SELECT run_id, agent_id, coalesce(turns, 0) AS turns, coalesce(words, 0) AS words, coalesce(cited, 0) AS cited, coalesce(disclosed, 0) AS disclosed,
  (row_number() OVER (PARTITION BY run_id ORDER BY seat, first, agent_id) - 1) % 8 + 1 AS color FROM j""")
def _(spark, sf):
    t = ad.transcript(spark, sf).withColumns({"cited": F.col("turn") % 3, "disclosed": F.col("turn") % 2})
    cast = _roster(spark, sf).filter(F.col("agent_id").isin("user", "observer"))
    return op.speakers(cast, t).select("run_id", "agent_id", "turns", "words", "cited", "disclosed", "color")


@query("m6_unanswered", """
SELECT r.run_id, r.agent_id AS reader, t.turn FROM v_roster r JOIN v_transcript t ON t.run_id = r.run_id
WHERE t.turn > coalesce((SELECT max(turn) FROM v_transcript x WHERE x.run_id = r.run_id AND x.agent_id = r.agent_id), -1)""")
def _(spark, sf):
    return op.unanswered(_roster(spark, sf), ad.transcript(spark, sf)).select("run_id", "reader", "turn")


view("v_asked", """
SELECT *, CASE WHEN turn % 5 = 2 THEN 'assistant' ELSE 'nobody' END AS question_for,
  CASE (run_id + turn) % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'system' ELSE 'nobody' END AS suggested FROM v_transcript""")


def _asked(spark, sf):
    p = (F.col("run_id") + F.col("turn")) % 4
    return ad.transcript(spark, sf).withColumns({
        "question_for": F.when(F.col("turn") % 5 == 2, "assistant").otherwise("nobody"),
        "suggested": F.when(p == 0, "user").when(p == 1, "assistant").when(p == 2, "system").otherwise("nobody")})


@query("m7_next_speakers", """
WITH c AS (SELECT a.run_id, a.turn, a.question_for, a.suggested, r.agent_id AS id, r.seat,
    (SELECT count(*) FROM v_transcript t WHERE t.run_id = a.run_id AND t.turn < a.turn AND t.agent_id = r.agent_id) AS n,
    (SELECT arg_max(agent_id, turn) FROM v_transcript t WHERE t.run_id = a.run_id AND t.turn < a.turn) AS prev
  FROM v_asked a JOIN v_roster r ON r.run_id = a.run_id AND r.seat < 3),
d AS (SELECT *, CASE WHEN prev IS NULL THEN seat ELSE (seat - CASE prev WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END + 3) % 3 END AS dist, prev IS NULL OR id <> prev AS other FROM c),
g AS (SELECT run_id, turn, any_value(question_for) AS q, any_value(suggested) AS s, any_value(prev) AS prev, arg_min(id, n * 100 + dist) FILTER (WHERE other) AS quietest,
    min(n) FILTER (WHERE other) AS fewest, max(n) FILTER (WHERE other AND id = suggested) AS picked FROM d GROUP BY 1, 2)
SELECT run_id, turn, CASE WHEN q <> 'nobody' AND q IS DISTINCT FROM prev THEN q WHEN picked IS NULL OR picked - fewest >= 2 THEN quietest ELSE s END AS speaker,
  CASE WHEN q <> 'nobody' AND q IS DISTINCT FROM prev THEN 'answering a direct question' WHEN picked IS NULL THEN 'round-robin (moderator''s pick was unusable)'
    WHEN picked - fewest >= 2 THEN 'balancing speaking time' ELSE 'moderator''s choice' END AS rule FROM g""")
def _(spark, sf):
    return op.next_speakers(_roster(spark, sf, 3), _asked(spark, sf))


@query("m8_may_conclude", """
SELECT a.run_id, a.turn, min((SELECT count(*) FROM v_transcript t WHERE t.run_id = a.run_id AND t.turn <= a.turn AND t.agent_id = r.agent_id)) >= 2 AS may_conclude
FROM v_transcript a JOIN v_roster r ON r.run_id = a.run_id AND r.seat < 2 GROUP BY 1, 2""")
def _(spark, sf):
    return op.may_conclude(_roster(spark, sf, 2), ad.transcript(spark, sf))


# Stalls of a run come from its trace: errors, at the number of the event in the run.
_STEPS = """
WITH RECURSIVE e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn, event_type FROM events),
st AS (SELECT run_id, turn, greatest(4, 2 * (run_id % 5 + 1)) AS gap FROM e WHERE event_type = 'error'),
pick(run_id, gap, turn, number) AS (
  SELECT run_id, gap, min(turn), CAST(1 AS BIGINT) FROM st WHERE turn >= gap GROUP BY 1, 2
  UNION ALL SELECT * FROM (SELECT p.run_id, p.gap, (SELECT min(s.turn) FROM st s WHERE s.run_id = p.run_id AND s.turn >= p.turn + p.gap) AS turn, p.number + 1 AS number FROM pick p) WHERE turn IS NOT NULL)
SELECT run_id, turn, number, (number - 1) % 3 AS technique FROM pick"""


def _stalls(spark, sf):
    from ..scale import with_position
    e = ad.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type")
    n = with_position(e, ["run_id"], ["event_id"], "turn").filter("event_type = 'error'")
    return n.select("run_id", "turn", (F.col("run_id") % 5 + 1).alias("agents"))


@query("m9_interventions", _STEPS)
def _(spark, sf):
    return op.interventions(_stalls(spark, sf))


@query("m9_interventions_of_long_runs", _STEPS)
def _(spark, sf):
    """The same from stalls that come in any order over many partitions."""
    return op.interventions(_stalls(spark, sf).repartition(32))


_SEGMENTS = """
WITH RECURSIVE e AS (SELECT run_id, turn, greatest(1, CAST(floor(length(content) / 3.5) AS BIGINT)) AS tokens, row_number() OVER (PARTITION BY run_id ORDER BY turn) AS i,
    count(*) OVER (PARTITION BY run_id) AS entries, CAST(sum(greatest(1, CAST(floor(length(content) / 3.5) AS BIGINT))) OVER (PARTITION BY run_id) AS BIGINT) AS total FROM v_transcript),
f(run_id, i, size, segment) AS (SELECT run_id, i, tokens + 20, CAST(1 AS BIGINT) FROM e WHERE i = 1
  UNION ALL SELECT e.run_id, e.i, CASE WHEN f.size + e.tokens + 20 > 400 THEN e.tokens + 20 ELSE f.size + e.tokens + 20 END,
    CASE WHEN f.size + e.tokens + 20 > 400 THEN f.segment + 1 ELSE f.segment END FROM f JOIN e ON e.run_id = f.run_id AND e.i = f.i + 1)
SELECT e.run_id, e.turn, e.tokens + 20 AS cost, CASE WHEN e.total > 500 AND e.i <= e.entries - 1 THEN f.segment END AS segment FROM e JOIN f ON f.run_id = e.run_id AND f.i = e.i"""


@query("m10_segments", _SEGMENTS)
def _(spark, sf):
    return op.segments(ad.transcript(spark, sf), 400, direct=500, keep_last=1).select("run_id", "turn", "cost", "segment")


@query("m10_segments_of_long_runs", _SEGMENTS)
def _(spark, sf):
    """The same from entries that come in any order over many partitions."""
    return op.segments(ad.transcript(spark, sf).repartition(32, F.xxhash64("content")), 400, direct=500, keep_last=1).select("run_id", "turn", "cost", "segment")


@query("m11_over_length", f"SELECT run_id, turn, {wc('content')} AS words FROM v_transcript WHERE {wc('content')} > 100 * 1.15::DOUBLE")
def _(spark, sf):
    return op.over_length(ad.transcript(spark, sf), 100).select("run_id", "turn", "words")


@query("m12_rendered", r"""
SELECT run_id, turn, CASE WHEN turn % 5 = 4 THEN '[moderator, after turn ' || turn || '] ' ELSE '[turn ' || turn || '] ' || name || ': ' END
  || CASE WHEN len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) <= 12 THEN content
     ELSE array_to_string(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')[1:12], ' ') || ' ...' END AS line FROM v_transcript""")
def _(spark, sf):
    t = ad.transcript(spark, sf).withColumn("agent_id", F.when(F.col("turn") % 5 == 4, op.MODERATOR).otherwise(F.col("agent_id")))
    return op.rendered(t, 12).select("run_id", "turn", "line")


_POLICY = ", ".join(f"('{k}', '{p}', '{r}')" for k, ps in op.VISIBILITY.items() for p, r in ps.items())
_KINDS = list(op.VISIBILITY)


@query("m13_visible_records", f"""
WITH rec AS (SELECT run_id, turn, agent_id AS owner, ([{', '.join(f"'{k}'" for k in _KINDS)}])[(turn + run_id) % 10 + 1] AS kind FROM v_transcript)
SELECT rec.run_id, rec.turn, rec.kind, v.viewer FROM rec, (VALUES ('user', 'speaker'), ('assistant', 'speaker'), ('moderator', 'moderator'), ('assessor', 'assessor')) v(viewer, part),
  (VALUES {_POLICY}) p(kind, part, rule) WHERE p.kind = rec.kind AND p.part = v.part AND (rule = 'all' OR (rule = 'own' AND rec.owner = v.viewer))""")
def _(spark, sf):
    t = ad.transcript(spark, sf)
    rec = t.select("run_id", "turn", F.col("agent_id").alias("owner"), F.element_at(
        F.array(*[F.lit(k) for k in _KINDS]), ((F.col("turn") + F.col("run_id")) % 10 + 1).cast("int")).alias("kind"))
    viewers = t.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.struct(F.lit(v).alias("viewer"), F.lit(p).alias("part")) for v, p in (
        ("user", "speaker"), ("assistant", "speaker"), ("moderator", "moderator"), ("assessor", "assessor"))])).alias("x")).select("run_id", "x.*")
    return op.visible_records(rec, viewers).select("run_id", "turn", "kind", "viewer")


@query("m13_public_entries", """
SELECT t.run_id, t.turn, t.name, coalesce((SELECT string_agg('S' || rank || '=E' || n, ' ' ORDER BY n) FROM v_exhibits e WHERE e.run_id = t.run_id AND e.turn = t.turn), '') AS markers FROM v_turns t""")
def _(spark, sf):
    from .citation_queries import _exhibits, _turns
    return op.public_entries(_turns(spark, sf), _exhibits(spark, sf)).select("run_id", "turn", "name", "markers")


@query("m13_private_briefs", """
SELECT c_custkey, '- ' || c_name || ': ' || concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'bottom line: ' || c_nationkey END, CASE WHEN c_custkey % 3 = 0 THEN 'confidential: ' || c_mktsegment END,
  CASE WHEN c_custkey % 5 = 0 THEN 'own case files: src1, src2' END) AS brief FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0""")
def _(spark, sf):
    i = F.col("c_custkey")
    a = ad.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(i % 2 == 0, F.col("c_nationkey").cast("string")).alias("bottom_line"),
                                               F.when(i % 3 == 0, F.col("c_mktsegment")).alias("confidential"), F.when(i % 5 == 0, F.array(F.lit("src1"), F.lit("src2"))).alias("libraries"))
    return op.private_briefs(a).select("c_custkey", "brief")


@query("m14_compacted_results", """
WITH m AS (SELECT run_id, turn AS position, CASE WHEN turn % 2 = 1 THEN 'tool' ELSE 'assistant' END AS role,
    'Read it.' || chr(10) || chr(10) || '[3] Title A, p. 4' || chr(10) || content || chr(10) || '[5] Title B' || chr(10) || '[3] Title C' AS content FROM v_transcript),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, role ORDER BY position DESC) AS k FROM m)
SELECT run_id, position, role, CASE WHEN role = 'tool' AND k > 1 AND length(content) > 300 THEN
  'Read it. … (shortened to save room; your notes say what it showed; its passages, still citable by number:' || chr(10) || '[3] Title C' || chr(10) || '[5] Title B)' ELSE content END AS content FROM k""")
def _(spark, sf):
    m = ad.transcript(spark, sf).select("run_id", F.col("turn").alias("position"), F.when(F.col("turn") % 2 == 1, "tool").otherwise("assistant").alias("role"),
                                        F.concat(F.lit("Read it.\n\n[3] Title A, p. 4\n"), "content", F.lit("\n[5] Title B\n[3] Title C")).alias("content"))
    return op.compact_tool_results(m, 1).select("run_id", "position", "role", "content")


view("v_agents", """
SELECT c_nationkey AS cast_id, c_custkey AS seat, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'a' || (c_custkey % 40) END AS agent_id,
  CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'P' || (c_custkey % 60) END AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'goal ' || (c_custkey % 30) END AS goal,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'r' END AS role, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'b' END AS bottom_line, CASE WHEN c_custkey % 7 = 0 THEN 'person' ELSE '' END AS played_by FROM customer""")


def _agents(spark, sf):
    i = F.col("c_custkey")

    def unless(n, value):
        return F.when(i % n == 0, "").otherwise(value)

    return ad.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("cast_id"), i.alias("seat"), unless(13, F.concat(F.lit("a"), i % 40)).alias("agent_id"),
        unless(17, F.concat(F.lit("P"), i % 60)).alias("name"), unless(3, F.concat(F.lit(" Goal  "), i % 30)).alias("goal"), unless(4, F.lit("r")).alias("role"),
        unless(5, F.lit("b")).alias("bottom_line"), F.lit(None).cast("string").alias("system_prompt"), F.when(i % 7 == 0, "person").otherwise("").alias("played_by"))


@query("m15_cast_checks", """
WITH a AS (SELECT *, coalesce(nullif(name, ''), nullif(agent_id, ''), 'An unnamed agent') AS label FROM v_agents),
own AS (SELECT * FROM a WHERE played_by <> 'person'), i AS (
SELECT cast_id, 'error' AS level, agent_id AS agent, label || ' has no short id.' AS message FROM a WHERE agent_id = ''
UNION ALL SELECT cast_id, 'error', agent_id, 'Two agents share the id "' || agent_id || '". Each agent needs its own, because the id is what keeps its memory private.'
  FROM (SELECT *, row_number() OVER (PARTITION BY cast_id, agent_id ORDER BY seat) AS k FROM a WHERE agent_id <> '') WHERE k > 1
UNION ALL SELECT cast_id, 'warning', agent_id, 'Agent "' || agent_id || '" has no name.' FROM a WHERE name = ''
UNION ALL SELECT cast_id, 'warning', agent_id, 'Two agents are both named "' || name || '". The others will not be able to tell them apart.'
  FROM (SELECT *, row_number() OVER (PARTITION BY cast_id, lower(name) ORDER BY seat) AS k FROM a WHERE name <> '') WHERE k > 1
UNION ALL SELECT cast_id, 'warning', agent_id, label || ' has no objective, so they have nothing to argue for.' FROM own WHERE goal = ''
UNION ALL SELECT cast_id, 'warning', agent_id, first || ' and ' || label || ' have the same objective. Was one agent copied from another?'
  FROM (SELECT *, row_number() OVER w AS k, first_value(label) OVER w AS first FROM own WHERE goal <> '' WINDOW w AS (PARTITION BY cast_id, goal ORDER BY seat)) WHERE k > 1
UNION ALL SELECT cast_id, 'warning', agent_id, label || ' has no role.' FROM own WHERE role = ''
UNION ALL SELECT cast_id, 'suggestion', agent_id, label || ' has no bottom line. Without a point where they would rather walk away, agents tend to argue in circles or give in too easily.' FROM own WHERE bottom_line = ''
UNION ALL SELECT n_nationkey + 25, 'error', '', 'Add at least two agents to the cast.' FROM nation)
SELECT cast_id, level, nullif(agent, '') AS agent, message FROM i""")
def _(spark, sf):
    nations = ad.table(spark, sf, "nation").select(F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 25)).alias("cast_id"))
    return op.check_cast(_agents(spark, sf), nations)


@query("m16_seating", """
SELECT o_orderkey AS run_id, a.agent_id, CASE WHEN a.agent_id = 'a' AND o_orderkey % 4 = 0 THEN o_custkey WHEN a.agent_id = 'b' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN o_orderkey % 100 END AS player,
  CASE WHEN a.agent_id = 'a' THEN CASE WHEN o_orderkey % 4 <> 0 THEN 'size' || (o_orderkey % 60) END
    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'size7' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'size3' END END AS model,
  CASE WHEN a.agent_id = 'a' AND o_orderkey % 4 <> 0 AND 'size' || (o_orderkey % 60) NOT IN (SELECT 'size' || p_size FROM part)
    THEN 'A is set to be played by size' || (o_orderkey % 60) || ', which is not one of the lab''s role-play models.' END AS error
FROM orders, (VALUES ('a'), ('b')) a(agent_id)""")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    agents = o.select(k.alias("run_id"), F.explode(F.array(
        F.struct(F.lit("a").alias("agent_id"), F.lit("A").alias("name"), F.lit("").alias("played_by"), F.concat(F.lit("size"), k % 60).alias("model")),
        F.struct(F.lit("b").alias("agent_id"), F.lit("B").alias("name"), F.when(k % 5 == 0, "person").otherwise("").alias("played_by"), F.lit("size3").alias("model"))))
        .alias("x")).select("run_id", "x.*")
    players = o.filter(k % 4 == 0).select(k.alias("run_id"), F.lit("a").alias("agent_id"), F.col("o_custkey").alias("user_id"))
    models = o.filter(k % 3 == 0).select(k.alias("run_id"), F.lit("b").alias("agent_id"), F.lit("size7").alias("model"))
    installed = ad.table(spark, sf, "part").select(F.concat(F.lit("size"), "p_size").alias("name"))
    launchers = o.select(k.alias("run_id"), (k % 100).alias("launched_by"))
    return op.seat_cast(agents, players, models, installed, launchers).select("run_id", "agent_id", "player", "model", "error")


@query("m17_model_offer", """
WITH m AS (SELECT DISTINCT l_suppkey % 5 AS host, l_partkey % 400 AS k FROM lineitem WHERE (l_suppkey + l_partkey % 400) % 37 <> 5)
SELECT 'm' || k || CASE WHEN k % 10 = 0 THEN '-UNCENSORED' ELSE '' END AS model, k % 3 = 2 AS thinking, k % 3 = 2 AS tools, k = 1 AS is_default
FROM m WHERE k % 3 <> 0 AND k % 10 <> 0 GROUP BY k HAVING count(*) = (SELECT count(DISTINCT host) FROM m)""")
def _(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    k = F.col("l_partkey") % 400
    m = li.filter((F.col("l_suppkey") + k) % 37 != 5).select(
        (F.col("l_suppkey") % 5).alias("host"), F.concat(F.lit("m"), k, F.when(k % 10 == 0, "-UNCENSORED").otherwise("")).alias("model"),
        F.when(k % 3 == 0, F.array(F.lit("embedding"))).when(k % 3 == 1, F.array(F.lit("completion")))
        .otherwise(F.array(F.lit("completion"), F.lit("thinking"), F.lit("tools"))).alias("capabilities"))
    return op.model_offer(m, "m1")
