"""Queries over versioned libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import libraries as op
from ..scale import with_position
from . import adapters as ad
from .registry import query, view

view("v_state", """
SELECT document_id, corpus, CASE WHEN document_id % 11 = 0 THEN 'New ' || title ELSE title END AS title, sha256, created_at,
  document_id % 7 <> 0 OR document_id % 49 = 0 AS live,
  CASE WHEN document_id % 21 = 0 AND document_id % 49 <> 0 THEN document_id + 1 END AS replaced_by FROM v_documents""")
view("v_live", "SELECT * FROM v_state WHERE live")
view("v_manifest", "SELECT corpus, version, count(*) AS documents FROM v_versions GROUP BY 1, 2")


def _log(spark, sf):
    return ad.change_log(spark, sf)


def _manifest(spark, sf):
    return op.manifest_of(ad.versions(spark, sf)).drop("digest")


def _all(df):
    return df.withColumn("__all", F.lit(0))


@query("l1_live_contents", "SELECT document_id, corpus, title, sha256 FROM v_live")
def _(spark, sf):
    return op.live(_log(spark, sf)).select("document_id", "corpus", "title", "sha256")


@query("l1_document_state", "SELECT document_id, corpus, live, replaced_by FROM v_state")
def _(spark, sf):
    return op.current_state(_log(spark, sf)).select("document_id", "corpus", "live", "replaced_by")


# New arrivals: every document again, half of them for one library, so that texts repeat
# inside the batch and against what the library holds.
view("v_arrivals", """
SELECT doc_id + 1000000000 AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'src0' ELSE source END AS corpus,
  CASE WHEN doc_id % 5 = 0 THEN text || ' revised' WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS text,
  CASE WHEN doc_id % 17 = 0 THEN 'HTTP 500' END AS error, doc_id // 12 AS batch_id, doc_id % 12 AS position FROM documents""")


def _arrivals(spark, sf):
    d = ad.table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select((i + 1_000_000_000).alias("document_id"), F.when(i % 2 == 0, "src0").otherwise(F.col("source")).alias("corpus"),
                    F.when(i % 5 == 0, F.concat("text", F.lit(" revised"))).when(i % 13 == 0, "  ").otherwise(F.col("text")).alias("text"),
                    F.when(i % 17 == 0, "HTTP 500").alias("error"), F.floor(i / 12).alias("batch_id"), (i % 12).alias("position"))


_ADDED = """document_id = min(document_id) OVER (PARTITION BY corpus, sha256)
  AND NOT EXISTS (SELECT 1 FROM v_live h WHERE h.corpus = a.corpus AND h.sha256 = a.sha256)"""


@query("l2_add_with_dedup", f"""
SELECT document_id, corpus, CASE WHEN {_ADDED} THEN 'added' ELSE 'duplicate' END AS status
FROM (SELECT document_id, corpus, sha256(text) AS sha256 FROM v_arrivals) a""")
def _(spark, sf):
    a = _arrivals(spark, sf).select("document_id", "corpus", F.sha2("text", 256).alias("sha256"))
    return op.add_status(a, op.live(_log(spark, sf))).drop("sha256")


@query("l3_ingest_report", f"""
WITH asked AS (SELECT * FROM v_arrivals), good AS (
  SELECT document_id, CASE WHEN {_ADDED} THEN 'ingested' ELSE 'duplicate' END AS status
  FROM (SELECT document_id, corpus, sha256(text) AS sha256 FROM asked WHERE error IS NULL AND trim(text) <> '') a)
SELECT batch_id, coalesce(g.status, CASE WHEN error IS NOT NULL THEN 'error' ELSE 'empty' END) AS status, count(*) AS items
FROM asked LEFT JOIN good g USING (document_id) GROUP BY 1, 2""")
def _(spark, sf):
    r = op.ingest_report(_arrivals(spark, sf), op.live(_log(spark, sf)))
    return r.groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("items"))


# Held documents with the link they came from, and a new reading of every link.
view("v_linked", """SELECT document_id, corpus, title, sha256, live,
  CASE WHEN document_id % 4 <> 0 THEN 'https://example.org/' || document_id END AS link FROM v_state""")
view("v_reads", """SELECT 'https://example.org/' || doc_id AS link,
  CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN text || ' changed'
    WHEN doc_id % 8 = 3 THEN lead(text, 1, text) OVER (PARTITION BY source ORDER BY doc_id) ELSE text END AS text,
  CASE WHEN doc_id % 9 = 0 THEN 'The website returned an error.' END AS error FROM documents""")


def _linked(spark, sf):
    s = op.current_state(_log(spark, sf))
    return s.select("document_id", "corpus", "title", "sha256", "live", "created_at", F.when(
        F.col("document_id") % 4 != 0, F.concat(F.lit("https://example.org/"), "document_id")).alias("link"))


def _reads(spark, sf):
    d = ad.table(spark, sf, "documents")
    i = F.col("doc_id")
    # What the next document of the source says: a join on its number in the source.
    n = with_position(d.select("source", "doc_id", "text"), ["source"], ["doc_id"], "n")
    after = n.select("source", (F.col("n") - 1).alias("n"), F.col("text").alias("next"))
    d = n.join(after, ["source", "n"], "left")
    text = (F.when(i % 9 == 0, None).when(i % 5 == 0, F.concat("text", F.lit(" changed")))
            .when(i % 8 == 3, F.coalesce("next", "text")).otherwise(F.col("text")))
    return d.select(F.concat(F.lit("https://example.org/"), i).alias("link"), text.alias("text"),
                    F.when(i % 9 == 0, "The website returned an error.").alias("error"))


@query("l4_add_links", """
WITH q AS (SELECT doc_id // 24 AS request_id, doc_id % 24 AS position, source AS corpus,
    'https://example.org/' || (doc_id * 3 % (SELECT count(*) FROM documents)) AS link FROM documents),
h AS (SELECT * FROM v_linked WHERE live),
r AS (SELECT q.*, d.text, d.error, sha256(d.text) AS sha256,
    EXISTS (SELECT 1 FROM h WHERE h.corpus = q.corpus AND h.link = q.link) AS by_link,
    EXISTS (SELECT 1 FROM h WHERE h.corpus = q.corpus AND h.sha256 = sha256(d.text)) AS by_text
  FROM q LEFT JOIN v_reads d USING (link)),
f AS (SELECT *, NOT by_link AND error IS NULL AND NOT by_text AS could FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY corpus, sha256, could ORDER BY request_id, position) AS k FROM f)
SELECT request_id, position, link, CASE WHEN by_link THEN 'exists by link' WHEN error IS NOT NULL THEN 'error'
  WHEN by_text THEN 'exists by text' WHEN k = 1 THEN 'added' ELSE 'exists by text' END AS status FROM w""")
def _(spark, sf):
    d = ad.table(spark, sf, "documents")
    total = d.count()
    i = F.col("doc_id")
    asked = d.select(F.floor(i / 24).alias("request_id"), (i % 24).alias("position"), F.col("source").alias("corpus"),
                     F.concat(F.lit("https://example.org/"), i * 3 % total).alias("link"))
    return op.link_report(asked, _reads(spark, sf), _linked(spark, sf).filter("live")).select("request_id", "position", "link", "status")


_REFRESH = """
SELECT h.document_id, h.corpus, h.title, h.link, h.sha256, r.text, CASE WHEN h.link IS NULL THEN 'not_a_link' WHEN NOT h.live THEN 'error'
    WHEN r.error IS NOT NULL THEN 'error' WHEN sha256(r.text) = h.sha256 THEN 'unchanged' WHEN t.title IS NOT NULL THEN 'error' ELSE 'updated' END AS status,
  CASE WHEN h.link IS NULL THEN 'This document was not added from a web link.'
    WHEN NOT h.live THEN 'This copy is no longer in the library, so it is not checked.'
    WHEN r.error IS NOT NULL THEN r.error || ' The text already stored is kept.' WHEN sha256(r.text) = h.sha256 THEN 'No change since it was last read.'
    WHEN t.title IS NOT NULL THEN 'The page now matches “' || t.title || '”, already in this library, so it was not re-read.'
    ELSE 'The page had changed; re-read.' END AS detail
FROM v_linked h LEFT JOIN v_reads r USING (link)
LEFT JOIN (SELECT corpus, sha256, arg_min(title, document_id) AS title FROM v_linked WHERE live GROUP BY 1, 2) t
  ON t.corpus = h.corpus AND t.sha256 = sha256(r.text)"""
view("v_refresh", _REFRESH)


def _refresh(spark, sf):
    return op.refresh_status(_linked(spark, sf), _reads(spark, sf))


@query("l5_refresh_status", "SELECT document_id, status, detail FROM v_refresh")
def _(spark, sf):
    return _refresh(spark, sf).select("document_id", "status", "detail")


@query("l5_checked_metadata", """
SELECT document_id, CASE WHEN status = 'error' THEN detail END AS check_error,
  CASE WHEN status = 'updated' THEN '2024-07-01' WHEN document_id % 2 = 0 THEN '2024-05-05' END AS changed_at, '2024-07-01' AS checked_at, 'a' AS site FROM v_refresh""")
def _(spark, sf):
    old = F.create_map(F.lit("site"), F.lit("a"), F.lit("check_error"), F.lit("old"))
    old = F.when(F.col("document_id") % 2 == 0, F.map_concat(old, F.create_map(F.lit("changed_at"), F.lit("2024-05-05")))).otherwise(old)
    r = _refresh(spark, sf)
    m = op.checked_metadata(old, F.col("status"), F.col("detail"), F.lit("2024-07-01"))
    return r.select("document_id", m.alias("m")).select("document_id", *[F.col("m")[k].alias(k) for k in (
        "check_error", "changed_at", "checked_at", "site")])


@query("l6_replace_with_history", """
WITH u AS (SELECT *, row_number() OVER (ORDER BY document_id) + 4999999 AS new_id FROM v_refresh WHERE status = 'updated')
SELECT document_id, corpus, title, sha256, 'replaced' AS action, new_id AS replaced_by FROM u
UNION ALL SELECT new_id, corpus, title, sha256(text), 'added', NULL FROM u""")
def _(spark, sf):
    changes = op.replacements(_refresh(spark, sf).filter("status = 'updated'"), 5_000_000, F.lit(10_000_000_000))
    return changes.select("document_id", "corpus", "title", "sha256", "action", "replaced_by")


@query("l7_refresh_summary", """
SELECT corpus, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'updated') AS updated,
  count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'not_a_link') AS not_a_link,
  count(*) FILTER (WHERE status = 'updated') > 0 AS new_version FROM v_refresh GROUP BY corpus""")
def _(spark, sf):
    return op.refresh_summary(_refresh(spark, sf))


@query("l8_record_version", """
WITH was AS (SELECT corpus, document_id FROM v_versions WHERE version = 2), now AS (SELECT corpus, document_id FROM v_live),
diff AS (SELECT coalesce(n.corpus, w.corpus) AS corpus, count(*) FILTER (WHERE n.document_id IS NULL OR w.document_id IS NULL) AS changes,
    count(n.document_id) AS documents FROM now n FULL JOIN was w ON n.corpus = w.corpus AND n.document_id = w.document_id GROUP BY 1)
SELECT corpus, 3 AS version, documents, (SELECT CAST(sum(document_id) AS BIGINT) FROM now n WHERE n.corpus = d.corpus) AS id_sum
FROM diff d WHERE changes > 0""")
def _(spark, sf):
    new, members = op.next_versions(op.live(_log(spark, sf)), ad.versions(spark, sf), op.manifest_of(ad.versions(spark, sf)))
    return new.drop("digest").join(members.groupBy("corpus").agg(F.sum("document_id").alias("id_sum")), "corpus")


_NOTE = """
WITH before AS (SELECT corpus, document_id, title, replaced_by FROM v_documents WHERE document_id % 5 <> 0),
after AS (SELECT corpus, document_id, title FROM v_documents WHERE document_id % 7 <> 0),
gone AS (SELECT b.corpus, b.document_id, b.title, b.replaced_by, n.corpus AS new_corpus, a.title AS successor
  FROM before b LEFT JOIN v_documents n ON n.document_id = b.replaced_by LEFT JOIN after a ON a.corpus = b.corpus AND a.document_id = b.replaced_by
  WHERE NOT EXISTS (SELECT 1 FROM after x WHERE x.corpus = b.corpus AND x.document_id = b.document_id)),
ev AS (SELECT corpus, document_id, CASE WHEN new_corpus <> corpus THEN 3 WHEN successor IS NOT NULL THEN 2 ELSE 4 END AS place,
    CASE WHEN new_corpus <> corpus THEN new_corpus ELSE '' END AS target, CASE WHEN new_corpus = corpus AND successor IS NOT NULL THEN successor ELSE title END AS title FROM gone
  UNION ALL SELECT a.corpus, a.document_id, 1, '', a.title FROM after a
  WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.corpus = a.corpus AND b.document_id = a.document_id)
    AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.corpus = a.corpus AND g.replaced_by = a.document_id AND g.successor IS NOT NULL)),
rk AS (SELECT *, row_number() OVER (PARTITION BY corpus, place, target ORDER BY title, document_id) AS k FROM ev),
parts AS (SELECT corpus, place, target, CASE place WHEN 1 THEN 'Added' WHEN 2 THEN 'Updated' WHEN 3 THEN 'Moved' ELSE 'Removed' END || ' ' || count(*)
    || CASE WHEN place = 3 THEN ' to “' || target || '”' ELSE '' END || ': “' || string_agg(title, '”; “' ORDER BY k) FILTER (WHERE k <= 3) || '”'
    || CASE WHEN count(*) > 3 THEN '; and ' || (count(*) - 3) || ' more' ELSE '' END AS part FROM rk GROUP BY corpus, place, target)
SELECT corpus, 'Nightly check. ' || CASE WHEN corpus = 'src10' THEN (SELECT 'First recorded version: ' || count(*) || ' documents.' FROM after a WHERE a.corpus = x.corpus) ELSE coalesce(string_agg(part, '. ' ORDER BY place, target) || '.', 'No change.') END AS change
FROM (SELECT corpus FROM before UNION SELECT corpus FROM after) x LEFT JOIN parts USING (corpus) GROUP BY corpus"""


@query("l9_change_note", _NOTE)
def _(spark, sf):
    d = ad.documents(spark, sf).select("document_id", "corpus", "title", "replaced_by")
    before, after = d.filter("document_id % 5 <> 0"), d.filter("document_id % 7 <> 0")
    owner = d.select(F.col("document_id").alias("replaced_by"), F.col("corpus").alias("new_corpus"))
    links = before.filter("replaced_by is not null").select("document_id", "replaced_by").join(owner, "replaced_by")
    notes = d.select("corpus").distinct().withColumn("note", F.lit("Nightly check."))
    return op.describe_changes(before, after, links, notes.filter("corpus <> 'src10'"), notes)


@query("l10_version_list", """
SELECT m.corpus, m.version, m.documents, coalesce(nullif(u.name, ''), u.email) AS changed_by_name, coalesce(r.runs, 0) AS runs,
  m.version = max(m.version) OVER (PARTITION BY m.corpus) AS latest
FROM v_manifest m LEFT JOIN v_users u ON u.user_id = m.version * 4
LEFT JOIN (SELECT corpus, version, count(*) AS runs FROM v_run_libraries GROUP BY 1, 2) r ON r.corpus = m.corpus AND r.version = m.version""")
def _(spark, sf):
    m = _manifest(spark, sf)
    v = op.list_versions(m.withColumn("changed_by", (F.col("version") * 4).cast("long")), ad.run_libraries(spark, sf), ad.users(spark, sf))
    last = op.latest_versions(m).withColumn("latest", F.lit(True))
    return v.join(last, ["corpus", "version"], "left").select(
        "corpus", "version", "documents", "changed_by_name", "runs", F.coalesce("latest", F.lit(False)).alias("latest"))


@query("l11_versions_holding", """
SELECT document_id, string_agg(CAST(version AS VARCHAR), ',' ORDER BY version) AS versions FROM v_versions GROUP BY document_id""")
def _(spark, sf):
    held = op.versions_holding(ad.versions(spark, sf), ad.documents(spark, sf))
    # A document sits in at most every version of its one library; here versions are few.
    return held.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("version").cast("string"))), ",").alias("versions"))


@query("l12_version_documents", """
SELECT v.corpus, v.document_id, d.title, d.live FROM v_versions v JOIN v_state d USING (document_id) WHERE v.version = 1""")
def _(spark, sf):
    at = _manifest(spark, sf).filter("version = 1")
    m = op.members_at(ad.versions(spark, sf), at)
    return m.join(op.current_state(_log(spark, sf)).drop("corpus"), "document_id").select("corpus", "document_id", "title", "live")


_PLAN = """
plan AS (SELECT corpus, document_id, title, 'put_back' AS action FROM v_state s WHERE NOT live AND EXISTS (
    SELECT 1 FROM v_versions v WHERE v.corpus = s.corpus AND v.document_id = s.document_id AND v.version = t.version)
  UNION ALL SELECT corpus, document_id, title, 'take_out' FROM v_live s WHERE NOT EXISTS (
    SELECT 1 FROM v_versions v WHERE v.corpus = s.corpus AND v.document_id = s.document_id AND v.version = t.version))"""


def _targets(spark, sf):
    """Odd libraries go back to version 1, the others to version 2."""
    odd = F.try_to_number(F.substring("corpus", 4, 9), F.lit("999")).cast("int") % 2 == 1
    return _manifest(spark, sf).filter(F.col("version") == F.when(odd, 1).otherwise(2)).select("corpus", "version")


view("v_targets", """SELECT DISTINCT corpus, CASE WHEN TRY_CAST(substr(corpus, 4) AS INTEGER) % 2 = 1 THEN 1 ELSE 2 END AS version FROM v_versions""")
view("v_revert", """
SELECT s.corpus, s.document_id, s.title, CASE WHEN s.live THEN 'take_out' ELSE 'put_back' END AS action
FROM v_state s JOIN v_targets t USING (corpus)
WHERE s.live <> EXISTS (SELECT 1 FROM v_versions v WHERE v.corpus = s.corpus AND v.document_id = s.document_id AND v.version = t.version)""")


@query("l13_revert_plan", """
SELECT corpus, document_id, action, row_number() OVER (PARTITION BY corpus, action ORDER BY lower(title), document_id) AS place FROM v_revert""")
def _(spark, sf):
    plan = op.revert_plan(op.current_state(_log(spark, sf)), ad.versions(spark, sf), _targets(spark, sf))
    plan = plan.select("corpus", "document_id", "action", F.lower("title").alias("t"))
    return with_position(plan, ["corpus", "action"], ["t", "document_id"], "place").drop("t")


@query("l14_revert", """
SELECT v.corpus, count(*) AS documents, CAST(sum(v.document_id) AS BIGINT) AS id_sum
FROM v_versions v JOIN v_targets t ON t.corpus = v.corpus AND t.version = v.version GROUP BY v.corpus""")
def _(spark, sf):
    log = op.revert(_log(spark, sf), ad.versions(spark, sf), _targets(spark, sf), 10_000_000_000)
    return op.live(log).groupBy("corpus").agg(F.count(F.lit(1)).alias("documents"), F.sum("document_id").alias("id_sum"))


@query("l15_remove_documents", """
SELECT corpus, count(*) AS documents, (SELECT count(*) FROM v_live g WHERE g.corpus = l.corpus AND g.document_id % 13 = 0) AS removed
FROM v_live l WHERE document_id % 13 <> 0 GROUP BY corpus""")
def _(spark, sf):
    ids = ad.documents(spark, sf).filter("document_id % 13 = 0").select("corpus", "document_id")
    log, gone = op.remove(_log(spark, sf), ids, 10_000_000_000)
    left = op.live(log).groupBy("corpus").agg(F.count(F.lit(1)).alias("documents"))
    taken = gone.groupBy("corpus").agg(F.count(F.lit(1)).alias("removed"))
    return left.join(taken, "corpus", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))


_MOVES = """
WITH m AS (SELECT s.*, 'src' || (document_id % 3) AS target,
    EXISTS (SELECT 1 FROM v_live h WHERE h.corpus = 'src' || (s.document_id % 3) AND h.sha256 = s.sha256) AS held FROM v_state s WHERE document_id % 4 = 1),
c AS (SELECT *, live AND target <> corpus AND NOT held AS can FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY target, sha256, can ORDER BY document_id) AS k FROM c),
moves AS (SELECT *, CASE WHEN NOT live THEN 'not in its library' WHEN target = corpus THEN 'already there' WHEN can AND k = 1 THEN 'moved' ELSE 'same text there' END AS status FROM k)"""


def _moves(spark, sf):
    asked = ad.documents(spark, sf).filter("document_id % 4 = 1").select(
        "document_id", F.concat(F.lit("  src"), F.col("document_id") % 3, F.lit(" ")).alias("target"))
    return op.move_status(op.current_state(_log(spark, sf)), asked)


@query("l16_move_status", f"{_MOVES} SELECT document_id, target, status FROM moves")
def _(spark, sf):
    return _moves(spark, sf).select("document_id", "target", "status")


@query("l16_move_documents", f"""{_MOVES},
n AS (SELECT *, row_number() OVER (ORDER BY document_id) + 6999999 AS new_id FROM moves WHERE status = 'moved')
SELECT n.document_id, n.new_id, n.target, count(p.page) AS passages, min(p.k) + 7999999 AS first_chunk
FROM n JOIN (SELECT p.doc_id, p.page, row_number() OVER (ORDER BY n.new_id, p.page) AS k FROM v_pages_of_text p JOIN n ON n.document_id = p.doc_id) p ON p.doc_id = n.document_id
GROUP BY 1, 2, 3""")
def _(spark, sf):
    pages = ad.pages_of_text(spark, sf).select(F.col("doc_id").alias("document_id"), F.col("page").cast("long").alias("chunk_id"), F.col("text").alias("content"))
    changes, carried = op.move(_moves(spark, sf), pages, 7_000_000, 8_000_000, 10_000_000_000)
    old = changes.filter("action = 'moved'").select("document_id", F.col("replaced_by").alias("new_id"))
    new = changes.filter("action = 'added'").select(F.col("document_id").alias("new_id"), F.col("corpus").alias("target"))
    n = carried.groupBy(F.col("document_id").alias("new_id")).agg(F.count(F.lit(1)).alias("passages"), F.min("chunk_id").alias("first_chunk"))
    return old.join(new, "new_id").join(n, "new_id")


@query("l17_retitle", """
SELECT document_id, CASE WHEN document_id % 10 = 0 THEN 'Case ' || document_id ELSE title END AS title, live FROM v_state""")
def _(spark, sf):
    titles = ad.documents(spark, sf).filter("document_id % 5 = 0").select("document_id", F.when(
        F.col("document_id") % 10 == 0, F.concat(F.lit(" Case \n "), "document_id")).otherwise("   ").alias("title"))
    return op.current_state(op.retitle(_log(spark, sf), titles, 10_000_000_000)).select("document_id", "title", "live")


@query("l18_delete_library", """
SELECT 'documents' AS "table", count(*) AS rows FROM v_documents WHERE corpus NOT IN ('src1', 'src2')
UNION ALL SELECT 'versions', count(*) FROM v_versions WHERE corpus NOT IN ('src1', 'src2')
UNION ALL SELECT 'was_current', count(*) FROM v_live WHERE corpus IN ('src1', 'src2')""")
def _(spark, sf):
    now = op.live(_log(spark, sf))
    names = ad.documents(spark, sf).filter(F.col("corpus").isin("src1", "src2")).select("corpus").distinct()
    left = op.delete_libraries(names, documents=ad.documents(spark, sf), versions=ad.versions(spark, sf))
    out = now.join(names, "corpus", "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("was_current").alias("table"), "rows")
    for n, t in left.items():
        out = out.unionByName(t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows"))
    return out


# Experiment settings: a list of libraries, the older single name, none, or case files.
view("v_configs", """
SELECT experiment_id, mode, deleted_at,
  CASE WHEN experiment_id % 4 = 0 THEN ['src1', ' src' || (experiment_id % 20) || ' ', 'src1'] END AS libraries,
  CASE WHEN experiment_id % 4 = 1 THEN 'src' || (experiment_id % 20) END AS corpus,
  CASE WHEN experiment_id % 6 = 0 THEN 'src' || (experiment_id % 7) END AS fetch_library,
  CASE WHEN experiment_id % 4 = 3 THEN ['src' || (experiment_id % 20), 'src5'] END AS files FROM v_experiments""")


def _configs(spark, sf):
    e = ad.experiments(spark, sf)
    i = F.col("experiment_id")

    def src(n):
        return F.concat(F.lit("src"), i % n)

    return e.select("experiment_id", "mode", "deleted_at",
                    F.when(i % 4 == 0, F.array(F.lit("src1"), F.concat(F.lit(" "), src(20), F.lit(" ")), F.lit("src1"))).alias("libraries"),
                    F.when(i % 4 == 1, src(20)).alias("corpus"), F.when(i % 6 == 0, src(7)).alias("fetch_library"),
                    F.when(i % 4 == 3, F.array(
                        F.struct(F.lit("a").alias("id"), F.array(src(20)).alias("libraries")),
                        F.struct(F.lit("b").alias("id"), F.array(F.lit("src5")).alias("libraries")))).alias("agents"))


@query("l19_rename_cascade", """
SELECT 'documents' AS "table", count(*) AS rows FROM v_documents WHERE corpus = 'src5'
UNION ALL SELECT 'corpus_versions', count(*) FROM v_versions WHERE corpus = 'src5'
UNION ALL SELECT 'run_libraries', count(*) FROM v_run_libraries a WHERE corpus = 'src5' AND NOT EXISTS (SELECT 1 FROM v_run_libraries b WHERE b.run_id = a.run_id AND b.corpus = 'src10')
UNION ALL SELECT 'library_settings', (SELECT count(*) FROM events WHERE user_id % 25 = 5)
UNION ALL SELECT 'experiments', count(*) FROM v_configs WHERE list_contains(list_transform(libraries, lambda x: trim(x)), 'src5') OR corpus = 'src5' OR fetch_library = 'src5' OR list_contains(files, 'src5')
UNION ALL SELECT 'after:documents', count(*) FROM v_documents WHERE corpus IN ('src5', 'src10')
UNION ALL SELECT 'after:settings', count(*) FROM events WHERE user_id % 25 = 5
UNION ALL SELECT 'after:experiments', count(*) FROM v_configs WHERE list_contains(list_transform(libraries, lambda x: trim(x)), 'src5') OR corpus IN ('src5', 'src10') OR fetch_library = 'src5' OR list_contains(files, 'src5')""")
def _(spark, sf):
    tables, counts = op.rename_library("src5", " src10 ", {
        "documents": ad.documents(spark, sf).select("corpus", "document_id"), "corpus_versions": ad.versions(spark, sf),
        "run_libraries": ad.run_libraries(spark, sf), "library_settings": _settings(spark, sf), "experiments": _configs(spark, sf)})

    def n(name, df):
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"after:{name}").alias("table"), "rows")

    e = tables["experiments"]
    uses = F.coalesce(F.array_contains("libraries", "src10"), F.lit(False)) | F.coalesce(F.col("corpus") == "src10", F.lit(False)) \
        | F.coalesce(F.col("fetch_library") == "src10", F.lit(False)) | F.coalesce(
            F.exists("agents", lambda a: F.array_contains(a["libraries"], "src10")), F.lit(False))
    return (counts.unionByName(n("documents", tables["documents"].filter("corpus = 'src10'")))
            .unionByName(n("settings", tables["library_settings"].filter("corpus = 'src10'")))
            .unionByName(n("experiments", e.filter(uses))))


@query("l20_current_names", """
WITH RECURSIVE r AS (SELECT 'lib' || s_suppkey AS old_name, CASE WHEN s_suppkey % 10 <> 9 THEN 'lib' || (s_suppkey + 1) ELSE 'lib' || (s_suppkey - 9) END AS new_name
  FROM supplier WHERE s_suppkey % 10 <> 9 OR (s_suppkey // 10) % 3 = 0),
walk(old_name, name, seen, n) AS (SELECT old_name, new_name, [old_name], 1 FROM r
  UNION ALL SELECT w.old_name, r.new_name, list_append(w.seen, w.name), n + 1 FROM walk w JOIN r ON r.old_name = w.name WHERE NOT list_contains(w.seen, w.name))
SELECT old_name, arg_max(name, n) AS new_name FROM walk GROUP BY old_name""")
def _(spark, sf):
    s = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    real = s.filter((k % 10 != 9) | (F.floor(k / 10) % 3 == 0)).select(
        (k + 1_000_000).alias("rename_id"), F.concat(F.lit("lib"), k).alias("old_name"),
        F.concat(F.lit("lib"), F.when(k % 10 != 9, k + 1).otherwise(k - 9)).alias("new_name"))
    # An earlier rename of the same name, which the later one overrides.
    earlier = real.select((F.col("rename_id") - 1_000_000).alias("rename_id"), "old_name", F.lit("elsewhere").alias("new_name"))
    return op.current_names(real.unionByName(earlier))


def _settings(spark, sf):
    e = ad.table(spark, sf, "events")
    return e.select(F.concat(F.lit("src"), F.col("user_id") % 25).alias("corpus"), (F.col("event_type") == "click").alias("hidden"),
                    F.struct("ts", "event_id").alias("changed_at"))


view("v_settings", """SELECT 'src' || (user_id % 25) AS corpus, event_type = 'click' AS hidden, ts, event_id FROM events""")
view("v_doc_chunks", "SELECT doc_id AS document_id, page AS ordinal, text AS content FROM v_pages_of_text WHERE text <> ''")
view("v_uses", """
SELECT DISTINCT experiment_id, corpus FROM (
  SELECT experiment_id, unnest(libraries) AS corpus FROM v_configs WHERE deleted_at IS NULL
  UNION ALL SELECT experiment_id, coalesce(corpus, CASE WHEN mode <> 'roleplay' THEN 'default' END) FROM v_configs WHERE deleted_at IS NULL AND libraries IS NULL
  UNION ALL SELECT experiment_id, unnest(files) FROM v_configs WHERE deleted_at IS NULL) WHERE corpus IS NOT NULL""")


def _doc_chunks(spark, sf):
    return ad.pages_of_text(spark, sf).filter("text <> ''").select(
        F.col("doc_id").alias("document_id"), F.col("page").alias("ordinal"), F.col("text").alias("content"))


@query("l21_library_list", """
WITH now AS (SELECT * FROM v_live WHERE corpus <> 'src3'), size AS (
  SELECT corpus, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS chunks, max(created_at) AS last_added FROM now
  LEFT JOIN (SELECT document_id, count(*) AS n FROM v_doc_chunks GROUP BY 1) USING (document_id) GROUP BY corpus)
SELECT n.corpus, coalesce(s.documents, 0) AS documents, coalesce(s.chunks, 0) AS chunks, strftime(s.last_added, '%Y-%m-%d %H:%M') AS last_added,
  m.version, CASE WHEN s.corpus IS NULL THEN 0 ELSE coalesce(u.n, 0) END AS experiments, coalesce(h.hidden, contains(lower(n.corpus), 'test')) AS hidden
FROM (SELECT corpus FROM now UNION SELECT corpus FROM v_manifest) n LEFT JOIN size s USING (corpus)
LEFT JOIN (SELECT corpus, max(version) AS version FROM v_manifest GROUP BY 1) m USING (corpus)
LEFT JOIN (SELECT corpus, count(DISTINCT experiment_id) AS n FROM v_uses GROUP BY 1) u USING (corpus)
LEFT JOIN (SELECT corpus, arg_max(hidden, (ts, event_id)) AS hidden FROM v_settings GROUP BY 1) h USING (corpus)""")
def _(spark, sf):
    now = op.live(_log(spark, sf)).filter("corpus <> 'src3'")
    return op.library_list(now, _doc_chunks(spark, sf), _manifest(spark, sf), op.experiment_libraries(_configs(spark, sf)),
                           _settings(spark, sf)).withColumn("last_added", F.date_format("last_added", "yyyy-MM-dd HH:mm"))


@query("l22_library_stats", """
SELECT corpus, count(DISTINCT document_id) AS documents, count(ordinal) AS chunks FROM v_live LEFT JOIN v_doc_chunks USING (document_id) GROUP BY corpus""")
def _(spark, sf):
    return op.library_stats(op.live(_log(spark, sf)), _doc_chunks(spark, sf)).drop("last_added")


@query("l23_document_sizes", """
SELECT document_id, corpus, count(ordinal) AS chunk_count, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS chars
FROM v_live LEFT JOIN v_doc_chunks USING (document_id) GROUP BY 1, 2""")
def _(spark, sf):
    return op.documents_with_sizes(op.live(_log(spark, sf)), _doc_chunks(spark, sf)).select("document_id", "corpus", "chunk_count", "chars")


@query("l24_visibility", """
WITH l AS (SELECT DISTINCT CASE WHEN TRY_CAST(substr(source, 4) AS INTEGER) % 6 = 5 THEN 'My Test ' || source ELSE source END AS corpus FROM documents)
SELECT corpus, coalesce(h.hidden, contains(lower(corpus), 'test')) AS hidden FROM l
LEFT JOIN (SELECT corpus, arg_max(hidden, (ts, event_id)) AS hidden FROM v_settings GROUP BY 1) h USING (corpus)""")
def _(spark, sf):
    n = F.try_to_number(F.substring("source", 4, 9), F.lit("999")).cast("int")
    libs = ad.table(spark, sf, "documents").select("source").distinct().select(
        F.when(n % 6 == 5, F.concat(F.lit("My Test "), "source")).otherwise(F.col("source")).alias("corpus"))
    return op.with_visibility(libs, _settings(spark, sf))


@query("l25_experiments_using", "SELECT corpus, experiment_id FROM v_uses")
def _(spark, sf):
    return op.experiment_libraries(_configs(spark, sf)).select("corpus", "experiment_id")


# Runs with their own choices over the experiment's settings.
view("v_choices", """
SELECT r.run_id, c.mode, c.libraries, c.corpus, c.files, CASE WHEN r.run_id % 5 = 0 THEN ['src2', '', 'src' || (r.run_id % 20)] END AS in_libraries,
  CASE WHEN r.run_id % 5 = 1 THEN 'src4' END AS in_corpus FROM v_runs r JOIN v_configs c USING (experiment_id)""")
view("v_run_names", """
SELECT run_id, list_aggregate(list_distinct_ordered, 'string_agg', ',') AS names, list_distinct_ordered AS listed FROM (
SELECT run_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM (
SELECT run_id, list_concat(CASE WHEN in_libraries IS NOT NULL THEN list_filter(in_libraries, lambda x: x <> '') WHEN in_corpus IS NOT NULL THEN [in_corpus]
  WHEN libraries IS NOT NULL THEN list_transform(libraries, lambda x: trim(x)) WHEN corpus IS NOT NULL THEN [corpus]
  WHEN mode = 'roleplay' THEN [] ELSE ['default'] END, CASE WHEN mode = 'roleplay' AND files IS NOT NULL THEN files ELSE [] END) AS a FROM v_choices))""")


def _choices(spark, sf):
    r = ad.runs(spark, sf).select("run_id", "experiment_id").join(_configs(spark, sf), "experiment_id")
    i = F.col("run_id")
    return r.withColumns({
        "in_libraries": F.when(i % 5 == 0, F.array(F.lit("src2"), F.lit(" "), F.concat(F.lit("src"), i % 20))),
        "in_corpus": F.when(i % 5 == 1, F.lit("src4")), "in_agents": F.expr("cast(null as array<struct<id:string,libraries:array<string>>>)")})


@query("l26_run_library_names", "SELECT run_id, coalesce(names, '') AS names FROM v_run_names")
def _(spark, sf):
    return op.run_library_names(_choices(spark, sf)).select("run_id", F.array_join("names", ",").alias("names"))


view("v_wanted", """
SELECT run_id, listed, CASE WHEN run_id % 3 = 0 AND list_contains(listed, 'src2') THEN CASE WHEN run_id % 2 = 0 THEN 1 ELSE 7 END END AS src2,
  CASE WHEN run_id % 3 = 1 AND len(listed) = 1 AND run_id % 4 <> 0 THEN 1 END AS one,
  CASE WHEN run_id % 3 = 1 AND len(listed) = 1 AND run_id % 4 = 0 THEN 'version ''x'' of the library “' || listed[1] || '” is not a number' END AS error FROM v_run_names""")


def _wanted(spark, sf):
    i = F.col("run_id")
    c = op.run_library_names(_choices(spark, sf)).withColumns({
        "library_versions": F.when(i % 3 == 0, F.create_map(F.lit("src2"), F.when(i % 2 == 0, "1").otherwise("7"), F.lit("nowhere"), F.lit("3"))),
        "corpus_version": F.when(i % 3 == 1, F.when(i % 4 == 0, "x").otherwise("1"))})
    return op.wanted_versions(c)


@query("l27_wanted_versions", """
SELECT run_id, coalesce('src2=' || src2, listed[1] || '=' || one, '') AS wanted, error FROM v_wanted""")
def _(spark, sf):
    w = _wanted(spark, sf)
    pairs = F.array_join(F.transform(F.map_entries("wanted"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return w.select("run_id", F.when(F.col("error").isNotNull(), "").otherwise(pairs).alias("wanted"), "error")


@query("l28_pin_libraries", """
WITH n AS (SELECT run_id, src2, one, unnest(listed) AS corpus, unnest(range(0, len(listed))) AS position FROM v_wanted WHERE error IS NULL),
a AS (SELECT *, CASE WHEN corpus = 'src2' AND src2 IS NOT NULL THEN src2 ELSE one END AS asked FROM n),
g AS (SELECT a.*, coalesce(asked, (SELECT max(version) FROM v_manifest m WHERE m.corpus = a.corpus)) AS version FROM a)
SELECT g.run_id, g.position, g.corpus, g.version, m.documents, CASE WHEN asked IS NOT NULL AND m.corpus IS NULL THEN 'the library “' || g.corpus || '” has no version ' || asked END AS error
FROM g LEFT JOIN v_manifest m ON m.corpus = g.corpus AND m.version = g.version""")
def _(spark, sf):
    return op.pin_libraries(_wanted(spark, sf).filter("error is null"), _manifest(spark, sf)).select(
        "run_id", "position", "corpus", "version", "documents", "error")


@query("l29_runs_that_searched", """
SELECT l.corpus, l.version, r.run_id, r.status, e.name AS experiment_name FROM v_run_libraries l JOIN v_runs r USING (run_id) JOIN v_experiments e USING (experiment_id)""")
def _(spark, sf):
    return op.runs_that_searched(ad.run_libraries(spark, sf), ad.runs(spark, sf), ad.experiments(spark, sf)).select(
        "corpus", "version", "run_id", "status", "experiment_name")


@query("l30_library_profiles", """
WITH k AS (SELECT corpus, kind, count(*) AS n FROM (SELECT corpus, CASE WHEN document_id % 5 = 0 THEN 'courtlistener' ELSE doc_type END AS kind FROM v_documents) GROUP BY 1, 2),
t AS (SELECT corpus, title, row_number() OVER (PARTITION BY corpus ORDER BY document_id) AS k FROM v_documents)
SELECT corpus, CAST(sum(n) AS BIGINT) AS documents, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds,
  (SELECT string_agg(title, '; ' ORDER BY k) FROM t WHERE t.corpus = k.corpus AND t.k <= 25) AS titles FROM k GROUP BY corpus""")
def _(spark, sf):
    d = ad.documents(spark, sf).withColumn("provider", F.when(F.col("document_id") % 5 == 0, F.lit("courtlistener")))
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return op.profiles(d).select("corpus", "documents", kinds.alias("kinds"), F.array_join("titles", "; ").alias("titles"))


@query("l31_libraries_in_use", """
WITH r AS (SELECT corpus, count(*) AS runs FROM v_run_libraries JOIN v_runs USING (run_id) WHERE status IN ('pending', 'running') GROUP BY 1),
c AS (SELECT 'src' || (user_id % 20) AS corpus, count(*) AS crawls FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT coalesce(r.corpus, c.corpus) AS corpus, coalesce(runs, 0) AS runs, coalesce(crawls, 0) AS crawls FROM r FULL JOIN c ON r.corpus = c.corpus""")
def _(spark, sf):
    crawls = ad.table(spark, sf, "events").select(
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("corpus"),
        F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "stopping").otherwise("finished").alias("status"))
    return op.in_use(ad.run_libraries(spark, sf), ad.runs(spark, sf), crawls)
