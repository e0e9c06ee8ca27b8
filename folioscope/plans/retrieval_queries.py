"""Queries that score passages against questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as op
from . import adapters as ad
from .registry import query, view

COS = "list_cosine_similarity(q.embedding, c.embedding)"


def _r4(df):
    return df.withColumn("similarity", F.bround("similarity", 4))


@query("r1_cosine", f"""
SELECT q.query_id, c.chunk_id, round_even({COS}, 4) AS similarity FROM v_chunks c JOIN v_questions q ON q.query_id = c.chunk_id // 50 * 50""")
def _(spark, sf):
    c = ad.chunks(spark, sf).select("chunk_id", (F.floor(F.col("chunk_id") / 50) * 50).alias("query_id"), F.col("embedding").alias("v"))
    j = c.join(ad.questions(spark, sf).select("query_id", "embedding"), "query_id")
    return _r4(j.select("query_id", "chunk_id", op.cosine(F.col("embedding"), F.col("v")).alias("similarity")))


def _topk(k, floor, where="true", extra=""):
    return f"""SELECT query_id, chunk_id, round_even(s, 4) AS similarity, rank FROM (
  SELECT q.query_id, c.chunk_id, {COS} AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY {COS} DESC, c.chunk_id{extra}) AS rank
  FROM v_questions q, v_chunks c WHERE {where} AND {COS} >= {floor}) WHERE rank <= {k}"""


@query("r2_top_passages", _topk(6, 0.35))
def _(spark, sf):
    return _r4(op.top_passages(ad.chunks(spark, sf), ad.questions(spark, sf)))


@query("r2_top_passages_low_floor", _topk(6, 0.1))
def _(spark, sf):
    return _r4(op.top_passages(ad.chunks(spark, sf), ad.questions(spark, sf), floor=0.1))


@query("r2_top_passages_of_library", _topk(6, 0.05, "q.corpus = c.corpus"))
def _(spark, sf):
    return _r4(op.top_passages(ad.chunks(spark, sf), ad.questions(spark, sf), floor=0.05,
                               scope=F.col("corpus"), query_scope=F.col("corpus")))


@query("r2_top_passages_in_blocks", _topk(6, 0.05, "q.corpus = c.corpus"))
def _(spark, sf):
    """The same search by the way taken when the questions are too many to share."""
    return _r4(op.top_passages(ad.chunks(spark, sf), ad.questions(spark, sf), floor=0.05,
                               scope=F.col("corpus"), query_scope=F.col("corpus"), shared_bytes=0))


view("v_found", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY r0) AS same FROM (
    SELECT q.query_id, q.run_id, c.chunk_id, c.document_id, c.corpus, c.title, c.content, c.page_start, c.page_end, p.version, {COS} AS s,
      row_number() OVER (PARTITION BY q.query_id ORDER BY {COS} DESC, c.chunk_id) AS r0,
      (SELECT count(*) FROM v_pins x WHERE x.run_id = q.run_id AND EXISTS (SELECT 1 FROM v_chunk_versions y WHERE y.corpus = x.corpus AND y.version = x.version)) AS pins
    FROM v_questions q JOIN v_pins p USING (run_id) JOIN v_chunk_versions v ON v.corpus = p.corpus AND v.version = p.version
    JOIN v_chunks c ON c.corpus = v.corpus AND c.document_id = v.document_id WHERE {COS} >= 0.02)
  WHERE r0 <= CASE WHEN pins > 1 THEN 12 ELSE 6 END) WHERE same = 1) WHERE rank <= 6""")


def _found(spark, sf, k=6, floor=0.02):
    return op.search_libraries(ad.chunks(spark, sf), ad.questions(spark, sf), ad.pins(spark, sf), ad.chunk_versions(spark, sf), k, floor)


@query("r3_search_pinned_libraries", """
SELECT query_id, rank, chunk_id, document_id, corpus, CAST(version AS BIGINT) AS version, round_even(s, 4) AS similarity FROM v_found""")
def _(spark, sf):
    return _r4(_found(spark, sf)).select("query_id", "rank", "chunk_id", "document_id", "corpus", F.col("version").cast("long").alias("version"), "similarity")


@query("r4_fused_questions", f"""
WITH f AS (SELECT * FROM (SELECT q.query_id, q.run_id, c.chunk_id, round({COS}, 12) AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY {COS} DESC, c.chunk_id) AS rank
    FROM v_questions q, v_chunks c WHERE {COS} >= 0.0) WHERE rank <= 4),
m AS (SELECT run_id, chunk_id, max(s) AS s, min(query_id * 10 + rank) AS first FROM f GROUP BY 1, 2)
SELECT run_id, chunk_id, round_even(s, 4) AS similarity, place FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, first) AS place FROM m) WHERE place <= 12""")
def _(spark, sf):
    q = ad.questions(spark, sf)
    found = op.top_passages(ad.chunks(spark, sf), q, 4, 0.0).join(q.select("query_id", "run_id"), "query_id")
    return _r4(op.fuse(found))


@query("r5_memory_recall", f"""
SELECT query_id, chunk_id AS memory_id, round_even(s, 4) AS similarity, rank FROM (
  SELECT q.query_id, c.chunk_id, {COS} AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY {COS} DESC, c.chunk_id) AS rank
  FROM v_questions q JOIN v_chunks c ON q.corpus = c.corpus AND q.query_id % 3 = c.chunk_id % 3 WHERE {COS} >= 0.01) WHERE rank <= 4""")
def _(spark, sf):
    c, q = ad.chunks(spark, sf), ad.questions(spark, sf)
    found = op.top_passages(c, q, 4, 0.01, scope=F.concat_ws("/", "corpus", F.col("chunk_id") % 3),
                            query_scope=F.concat_ws("/", "corpus", F.col("query_id") % 3))
    return _r4(found).withColumnRenamed("chunk_id", "memory_id")


@query("r6_best_of_document", f"""
SELECT query_id, chunk_id, round_even(s, 4) AS similarity, rank FROM (
  SELECT q.query_id, c.chunk_id, {COS} AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY {COS} DESC, c.chunk_id DESC) AS rank
  FROM v_questions q JOIN v_chunks c ON c.document_id = q.query_id // 5 + 1) WHERE rank <= 4""")
def _(spark, sf):
    q = ad.questions(spark, sf)
    return _r4(op.top_passages(ad.chunks(spark, sf), q, 4, None, scope=F.col("document_id"),
                               query_scope=F.floor(F.col("query_id") / 5) + 1, later_wins=True))


@query("r7_approximate_top")
def _(spark, sf):
    return _r4(op.approximate_top(ad.chunks(spark, sf), ad.questions(spark, sf), 6, 0.05))


@query("r7_recall", f"""
SELECT query_id, count(*) AS exact, true AS within FROM (
  SELECT q.query_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {COS} DESC, c.chunk_id) AS rank FROM v_questions q, v_chunks c WHERE {COS} >= 0.05) WHERE rank <= 6 GROUP BY query_id""")
def _(spark, sf):
    """Whether the index finds some of the exact best passages of each question, and no others at a better place."""
    exact = op.top_passages(ad.chunks(spark, sf), ad.questions(spark, sf), 6, 0.05)
    near = op.approximate_top(ad.chunks(spark, sf), ad.questions(spark, sf), 6, 0.05).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.max("similarity").alias("top"))
    best = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("exact"), F.max("similarity").alias("best")).join(near, "query_id", "left")
    return best.select("query_id", "exact", (F.col("found").between(1, F.col("exact")) & (F.col("top") <= F.col("best"))).alias("within"))


@query("r8_private_and_shared", f"""
SELECT query_id, private, chunk_id, round_even(s, 4) AS similarity, rank FROM (
  SELECT q.query_id, p.private, c.chunk_id, {COS} AS s, row_number() OVER (PARTITION BY q.query_id, p.private ORDER BY {COS} DESC, c.chunk_id) AS rank
  FROM v_questions q, (SELECT unnest([true, false]) AS private) p, v_chunks c
  WHERE c.corpus = CASE WHEN p.private THEN 'c' || (q.query_id % 7) ELSE 'c9' END AND {COS} >= 0.0) WHERE rank <= 4""")
def _(spark, sf):
    q = ad.questions(spark, sf)
    places = q.select("query_id", "embedding", F.explode(F.array(
        F.struct(F.lit(True).alias("private"), F.concat(F.lit("c"), F.col("query_id") % 7).alias("library")),
        F.struct(F.lit(False).alias("private"), F.lit("c9").alias("library")))).alias("p"))
    asked = places.select((F.col("query_id") * 2 + F.col("p.private").cast("int")).alias("query_id"), "embedding", "p.library")
    found = op.top_passages(ad.chunks(spark, sf), asked, 4, 0.0, scope=F.col("corpus"), query_scope=F.col("library"))
    return _r4(found.withColumn("private", F.col("query_id") % 2 == 1).withColumn("query_id", F.floor(F.col("query_id") / 2)))


_LABEL = "c.title || CASE WHEN c.page_start <> c.page_end THEN ', pp. ' || c.page_start || '-' || c.page_end ELSE ', p. ' || c.page_start END"
_LIB = "'“' || c.corpus || '”' || coalesce(' v' || c.version, '')"


def _labelled(df):
    return df.withColumns({"label": op.cite_label(F.col("title"), F.col("page_start"), F.col("page_end")),
                           "library": op.library_label(F.col("corpus"), F.col("version"))})


@query("r9_labels", f"SELECT run_id, turn, rank, {_LABEL} AS label, {_LIB} AS library FROM v_handed_out c")
def _(spark, sf):
    return _labelled(ad.handed_out(spark, sf)).select("run_id", "turn", "rank", "label", "library")


@query("r10_context_block", f"""
SELECT query_id, string_agg('[' || rank || '] ' || {_LABEL} || ' (library ' || {_LIB} || ')' || chr(10) || c.content, chr(10) || chr(10) ORDER BY rank) AS block
FROM v_found c GROUP BY query_id""")
def _(spark, sf):
    return op.context_blocks(_labelled(_found(spark, sf)).withColumn("kept", F.lit(True)), "query_id", "rank")


_HITS = """SELECT conv_id AS run_id, turn AS search_no, p AS provider_no, n AS position, 'Hit ' || turn || '.' || p || '.' || n AS title,
  'https://s' || p || '.example.org/' || conv_id || '/' || n AS url FROM conversations, (SELECT unnest([1, 2, 3]) AS p), (SELECT unnest([1, 2]) AS n)"""
view("v_hits", f"SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY search_no, provider_no, position) AS n FROM ({_HITS})")


def _hits(spark, sf):
    c = ad.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("search_no"))

    def of(p):
        h = c.select("run_id", "search_no", F.lit(p).alias("provider_no"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
        return h.withColumns({"title": F.concat(F.lit("Hit "), "search_no", F.lit(f".{p}."), "position"),
                              "url": F.concat(F.lit(f"https://s{p}.example.org/"), "run_id", F.lit("/"), "position")})

    return of(1).unionByName(of(2)).unionByName(of(3))


@query("r11_numbered_hits", "SELECT run_id, search_no, provider_no, position, 'W' || n AS marker FROM v_hits")
def _(spark, sf):
    return op.numbered_hits(_hits(spark, sf)).select("run_id", "search_no", "provider_no", "position", "marker")


@query("r11_search_record", "SELECT run_id, search_no, string_agg('W' || n || ' ' || title, '; ' ORDER BY n) AS results FROM v_hits GROUP BY 1, 2")
def _(spark, sf):
    r = op.search_record(op.numbered_hits(_hits(spark, sf)))
    return r.select("run_id", "search_no", F.array_join(F.transform("results", lambda x: F.concat(F.lit("W"), x["n"], F.lit(" "), x["title"])), "; ").alias("results"))


@query("r12_embed_chunks")
def _(spark, sf):
    from ..operators.documents import chunk
    c = chunk(ad.paragraphed(spark, sf)).select("doc_id", "ordinal", "content")
    e = op.embed(c, "content", op.hashing_encoder(64))
    return e.select("doc_id", "ordinal", F.size("embedding").alias("dims"),
                    F.bround(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("length"))


@query("r13_search_preview", f"""
SELECT query_id, rank, document_id, {_LABEL} AS label, content, round_even(s, 3) AS similarity FROM (
  SELECT q.query_id, c.*, {COS} AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY {COS} DESC, c.chunk_id) AS rank
  FROM v_questions q JOIN v_chunks c ON q.corpus = c.corpus WHERE {COS} >= 0.0) c WHERE rank <= 6""")
def _(spark, sf):
    c = ad.chunks(spark, sf)
    found = op.top_passages(c, ad.questions(spark, sf), 6, 0.0, scope=F.col("corpus"), query_scope=F.col("corpus"))
    j = found.join(c.drop("embedding"), "chunk_id").withColumn("version", F.lit(None).cast("int"))
    return _labelled(j).select("query_id", "rank", "document_id", "label", "content", F.bround("similarity", 3).alias("similarity"))


@query("l30_trial_search", f"""
SELECT corpus, round_even(max(s), 2) AS match, string_agg(title, '; ' ORDER BY rank) AS closest FROM (
  SELECT corpus, title, s, rank, row_number() OVER (PARTITION BY corpus, title ORDER BY rank) AS k FROM (
    SELECT c.corpus, c.title, {COS} AS s, row_number() OVER (PARTITION BY c.corpus ORDER BY {COS} DESC, c.chunk_id) AS rank
    FROM v_questions q, v_chunks c WHERE q.query_id = 0 AND {COS} >= 0.0) WHERE rank <= 3) WHERE k = 1 GROUP BY corpus""")
def _(spark, sf):
    """A trial search of every library for one brief, as a planner's profile of them shows."""
    from ..operators.libraries import profiles
    c = ad.chunks(spark, sf)
    libs = c.select("corpus").distinct().withColumn("query_id", F.regexp_extract("corpus", "([0-9]+)", 1).cast("long"))
    brief = ad.questions(spark, sf).filter("query_id = 0").select("embedding", F.lit(1).alias("one"))
    asked = libs.withColumn("one", F.lit(1)).join(brief, "one")
    found = op.top_passages(c, asked, 3, 0.0, scope=F.col("corpus"), query_scope=F.col("corpus"))
    matches = found.join(c.drop("embedding"), "chunk_id")
    docs = c.groupBy("document_id", "corpus").agg(F.first("title").alias("title")).withColumns(
        {"provider": F.lit(None).cast("string"), "doc_type": F.lit("text")})
    p = profiles(docs, matches)
    return p.filter("closest is not null").select("corpus", "match", F.array_join("closest", "; ").alias("closest"))
