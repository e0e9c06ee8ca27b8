"""Queries that read payloads, files' text and records. The payloads are made from the given
tables, one per document."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import citations as cit
from ..schemas import table_report
from ..scale import ensure_checkpoint_dir, released
from ..sources import agents as cast_files, files as scans, providers as pv, records
from . import adapters as ad
from .citation_queries import _cited_documents
from .registry import query, view



def _i():
    return F.col("doc_id")


def _docs(spark, sf):
    return ad.table(spark, sf, "documents")


def _payload(docs, result, path="results"):
    """Documents with a search answer that holds one result, as JSON text."""
    body = F.struct(F.array(result).alias("results")) if path == "results" else F.struct(F.struct(F.array(result).alias("hits")).alias("hits"))
    return docs.select("doc_id", F.to_json(body).alias("payload"))


@query("s1_text_files", """
WITH f AS (SELECT source || '-' || (doc_id % 16) AS title, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1)
SELECT title, 'added' AS status, length(text) AS chars, sha256(text) AS text_sha FROM f""")
def _(spark, sf):
    """The documents written as text files, sixteen for each source, in the shared folder, and scanned as uploads."""
    folder = f"{ensure_checkpoint_dir(spark)}/uploads-{uuid.uuid4().hex}"
    name = F.concat("source", F.lit("-"), F.col("doc_id") % 16)
    parts = _docs(spark, sf).select(name.alias("name"), "doc_id", "text")
    # All lines of a file in one task; there are sixteen times as many files as sources, so none is much of the whole.
    parts.repartition("name").sortWithinPartitions("name", "doc_id").select("name", "text").write.partitionBy("name").text(folder)
    held = spark.createDataFrame([], "corpus string, sha256 string")
    # The upload's name is its folder here, since Spark names the files themselves.
    files = scans.text_files(spark, folder).withColumn("title", F.regexp_extract("path", "name=([^/]+)/", 1)).withColumns({"corpus": F.lit("uploads"), "document_id": F.xxhash64("path")})
    out = scans.ingest_split(files, held)
    return out.select("title", "status", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha"))


def _hits(df):
    return df.select("doc_id", "provider", "ref", "title", "snippet", "url", "date", "badge")


def _opinions():
    def op(i, kind, key):
        return F.struct(i.alias("id"), kind.alias("type"), key.alias("ordering_key"), F.concat(F.lit("<b>"), "text", F.lit("</b>")).alias("snippet"))
    null_key, null_id = F.lit(None).cast("int"), F.lit(None).cast("long")
    return F.array(op(_i() * 10, F.lit("040dissent"), F.lit(1)), op(null_id, F.lit("010combined"), F.lit(0)),
                   op(_i() * 10 + 1, F.when(_i() % 3 == 0, F.lit("lead-opinion")).when(_i() % 3 == 1, F.lit("concurrence")), null_key),
                   op(_i() * 10 + 2, F.when(_i() % 2 == 0, F.lit("020lead")).otherwise(F.lit("Plurality")), F.when(_i() % 4 == 0, 2)))


_LEAD = """CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN doc_id * 10 + 2 WHEN doc_id % 3 = 0 THEN doc_id * 10 + 1 ELSE doc_id * 10 + 2 END"""


# A marked-up text as plain lines, as far as a hit shows it.
_SAID = r"left(regexp_replace(regexp_replace(regexp_replace(' ' || text || ' ', '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g'), 400)"


@query("s3_case_law_hits", rf"""
SELECT doc_id, 'courtlistener' AS provider, CAST({_LEAD} AS VARCHAR) AS ref, CASE WHEN doc_id % 5 = 0 THEN 'Opinion ' || ({_LEAD}) ELSE 'Case ' || doc_id END AS title,
  {_SAID} AS snippet, 'https://www.courtlistener.com/o/' || doc_id AS url, '2001-02-03' AS date, 'D. Mont.' AS badge FROM documents""")
def _(spark, sf):
    r = F.struct(F.when(_i() % 5 != 0, F.concat(F.lit("Case "), _i())).otherwise("").alias("caseName"), F.concat(F.lit("/o/"), _i()).alias("absolute_url"),
                 F.lit("2001-02-03").alias("dateFiled"), F.lit("D. Mont.").alias("court"), _opinions().alias("opinions"))
    return _hits(pv.case_law_hits(_payload(_docs(spark, sf), r), keep=("doc_id",)))


@query("s8_lead_opinion", f"SELECT doc_id, {_LEAD} AS opinion_id FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", pv.pick_lead(_opinions())["id"].alias("opinion_id"))


@query("s4_rulemaking_hits", """
SELECT doc_id, 'federal_register' AS provider, '2024-' || doc_id AS ref, CASE WHEN doc_id % 4 = 0 THEN '2024-' || doc_id ELSE 'Rule ' || doc_id END AS title, left(text, 400) AS snippet,
  'https://fr.example.org/' || doc_id AS url, '2024-03-04' AS date, CASE WHEN doc_id % 2 = 0 THEN 'Rule' ELSE 'EPA, DOT' END AS badge FROM documents""")
def _(spark, sf):
    names = F.array(*[F.struct(F.lit(a).alias("name")) for a in ("EPA", "DOT", "SEC")])
    r = F.struct(F.when(_i() % 4 != 0, F.concat(F.lit("Rule "), _i())).alias("title"), F.concat(F.lit("2024-"), _i()).alias("document_number"),
                 F.lit("2024-03-04").alias("publication_date"), F.concat(F.lit("https://fr.example.org/"), _i()).alias("html_url"), F.col("text").alias("abstract"),
                 F.when(_i() % 2 == 0, "Rule").alias("type"), names.alias("agencies"))
    return _hits(pv.rulemaking_hits(_payload(_docs(spark, sf), r), keep=("doc_id",)))


@query("s5_code_hits", f"""
SELECT doc_id, 'ecfr' AS provider, CASE WHEN doc_id % 3 = 0 THEN '{{"title":"40","part":"' || (doc_id % 90) || '","section":"' || doc_id || '.1"}}' ELSE '{{"title":"40","chapter":"I","part":"' || (doc_id % 90) || '"}}' END AS ref,
  '40 CFR ' || CASE WHEN doc_id % 3 = 0 THEN '§ ' || doc_id || '.1' ELSE 'Part ' || (doc_id % 90) END || ' Hazardous waste' AS title, {_SAID} AS snippet,
  'https://www.ecfr.gov/current/title-40/' || CASE WHEN doc_id % 3 = 0 THEN 'section-' || doc_id || '.1' ELSE 'chapter-I/part-' || (doc_id % 90) END AS url, '2017-01-01' AS date, 'Protection' AS badge FROM documents""")
def _(spark, sf):
    h = F.struct(F.lit("40").alias("title"), F.when(_i() % 3 != 0, "I").otherwise("").alias("chapter"), (_i() % 90).cast("string").alias("part"),
                 F.when(_i() % 3 == 0, F.concat(_i().cast("string"), F.lit(".1"))).alias("section"))
    r = F.struct(h.alias("hierarchy"), F.struct(F.lit(" Protection ").alias("title"), F.lit("Hazardous <strong>waste</strong>").alias("section")).alias("hierarchy_headings"),
                 F.concat(F.lit("<strong>"), "text", F.lit("</strong>")).alias("full_text_excerpt"), F.lit("2017-01-01").alias("starts_on"))
    return _hits(pv.code_hits(_payload(_docs(spark, sf), r), keep=("doc_id",)))


@query("s6_publication_hits", f"""
SELECT doc_id, 'govinfo' AS provider, ref, 'Act ' || doc_id AS title, {_SAID} AS snippet, 'https://www.govinfo.gov/app/details/' || ref AS url, '2023-01-02' AS date, 'USCODE' AS badge
FROM (SELECT doc_id, 'PKG-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/g' || (doc_id % 9) ELSE '' END AS ref, text FROM documents)""")
def _(spark, sf):
    r = F.struct(F.concat(F.lit("PKG-"), _i()).alias("packageId"), F.when(_i() % 2 == 0, F.concat(F.lit("g"), _i() % 9)).alias("granuleId"), F.concat(F.lit("Act "), _i()).alias("title"),
                 F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("summary"), F.lit("2023-01-02T00:00:00Z").alias("dateIssued"), F.lit("USCODE").alias("collectionCode"))
    return _hits(pv.publication_hits(_payload(_docs(spark, sf), r), keep=("doc_id",)))


@query("s7_filing_hits", """
SELECT doc_id, 'sec_edgar' AS provider, '0001-24-' || doc_id || ':a.htm' AS ref, CASE WHEN doc_id % 6 = 0 THEN 'Unknown filer' ELSE 'Firm ' || doc_id END || ' — 10-K' AS title, '' AS snippet,
  'https://www.sec.gov/Archives/edgar/data/' || CASE WHEN doc_id % 6 = 0 THEN '' ELSE ltrim('000' || doc_id, '0') END || '/000124' || doc_id || '/a.htm' AS url, '2024-02-01' AS date, '10-K' AS badge FROM documents""")
def _(spark, sf):
    known = _i() % 6 != 0
    source = F.struct(F.when(known, F.array(F.concat(F.lit("Firm "), _i(), F.lit("  (CIK 1)")))).alias("display_names"), F.lit("10-K").alias("file_type"),
                      F.lit("2024-02-01").alias("file_date"), F.when(known, F.array(F.concat(F.lit("000"), _i()))).alias("ciks"))
    r = F.struct(F.concat(F.lit("0001-24-"), _i(), F.lit(":a.htm")).alias("_id"), source.alias("_source"))
    return _hits(pv.filing_hits(_payload(_docs(spark, sf), r, "hits"), keep=("doc_id",)))


@query("s9_case_law_documents", """
WITH o AS (SELECT doc_id, doc_id // 4 AS cluster_id, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 4 END AS rank, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Opinion text ' || doc_id END AS text FROM documents),
b AS (SELECT o.*, (SELECT arg_min(s.doc_id, s.rank) FROM o s WHERE s.cluster_id = o.cluster_id AND s.doc_id <> o.doc_id AND s.text <> '' AND (o.text = '' OR s.rank < o.rank)) AS other FROM o),
u AS (SELECT doc_id, cluster_id, CASE WHEN (rank > 2 OR text = '') AND other IS NOT NULL THEN other ELSE doc_id END AS used FROM b),
t AS (SELECT u.*, o.text FROM u JOIN o ON o.doc_id = u.used)
SELECT CAST(doc_id AS VARCHAR) AS ref, CASE WHEN text = '' THEN 'Hit ' || doc_id ELSE 'Case ' || cluster_id END AS title, CASE WHEN text = '' THEN 'Hit ' || doc_id || chr(10) || 'court 2001' || chr(10) || chr(10) || 'a snippet' ELSE text END AS text,
  CASE WHEN text = '' THEN 'opinion_snippet' ELSE 'opinion' END AS doc_type, CASE WHEN used <> doc_id AND text <> '' THEN CAST(doc_id AS VARCHAR) END AS requested FROM t""")
def _(spark, sf):
    d = _docs(spark, sf)
    said = F.concat(F.lit("Opinion text "), _i())
    ops = d.select(_i().alias("id"), F.floor(_i() / 4).alias("cluster_id"), F.when(_i() % 4 == 0, "040dissent").when(_i() % 4 == 1, "020lead").when(_i() % 4 == 3, "concurrence").alias("type"),
                   _i().alias("position"), F.when((_i() % 7 != 0) & (_i() % 2 == 0), said).otherwise("").alias("plain_text"), F.lit(None).cast("string").alias("html_with_citations"),
                   F.when((_i() % 7 != 0) & (_i() % 2 == 1), F.concat(F.lit("<p>"), said, F.lit("</p>"))).alias("html"), F.lit("").alias("html_lawbox"),
                   F.lit(None).cast("string").alias("html_columbia"), F.lit(None).cast("string").alias("xml_harvard"), F.concat(F.lit("/o/"), _i()).alias("absolute_url"))
    requests = d.select(_i().cast("string").alias("ref"), F.concat(F.lit("Hit "), _i()).alias("hit_title"), F.lit("2001").alias("hit_date"), F.lit("court").alias("hit_badge"),
                        F.lit(" a snippet ").alias("hit_snippet"), F.lit("https://hit.example.org").alias("hit_url"))
    clusters = ops.select("cluster_id").distinct().withColumns({"case_name": F.concat(F.lit("Case "), "cluster_id"), "date_filed": F.lit("2001-02-03")})
    out = pv.case_law_documents(requests, ops, clusters)
    return out.select("ref", "title", "text", "doc_type", F.col("metadata")["requested_opinion_id"].alias("requested"))


@query("s10_other_documents", """
SELECT 'federal_register' AS provider, '2024-' || doc_id AS ref, 'Rule ' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'a < b' WHEN 1 THEN 'plain ' || doc_id ELSE 'the abstract' END AS text,
  'https://www.federalregister.gov/api/v1/documents/2024-' || doc_id || '.json' AS source_uri FROM documents
UNION ALL SELECT 'ecfr', '{"title":"' || (doc_id % 50 + 1) || '","section":"' || doc_id || '.1"}', 'Head ' || doc_id, 'Head ' || doc_id || chr(10) || chr(10) || 'Body', 'https://www.ecfr.gov/current/title-' || (doc_id % 50 + 1) || '/section-' || doc_id || '.1' FROM documents
UNION ALL SELECT 'govinfo', 'P-' || doc_id || '/g', 'Act ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'html text' ELSE 'plain text' END, 'https://www.govinfo.gov/app/details/P-' || doc_id || '/g' FROM documents
UNION ALL SELECT 'sec_edgar', '0001-24-' || doc_id || ':f.htm', 'Firm 10-K (2024-01-02)', 'filed ' || doc_id, 'https://www.sec.gov/Archives/edgar/data/77/000124' || doc_id || '/f.htm' FROM documents""")
def _(spark, sf):
    d, none = _docs(spark, sf), F.lit(None).cast("string")
    rules = d.select(F.concat(F.lit("2024-"), _i()).alias("ref"), F.concat(F.lit("Rule "), _i()).alias("title"), F.lit("the abstract").alias("abstract"), none.alias("html_url"),
                     F.lit("2024-03-04").alias("publication_date"), F.lit("Rule").alias("type"), F.when(_i() % 3 != 2, "u").alias("raw_text_url"),
                     F.when(_i() % 3 == 0, "<html><pre>a &lt; b</pre></html>").when(_i() % 3 == 1, F.concat(F.lit("<p>plain "), _i(), F.lit("</p>"))).alias("raw_text"))
    code = d.select(F.concat(F.lit('{"title":"'), _i() % 50 + 1, F.lit('","section":"'), _i(), F.lit('.1"}')).alias("ref"),
                    F.concat(F.lit("<DIV><HEAD>Head "), _i(), F.lit("</HEAD><P>Body</P></DIV>")).alias("xml"))
    titles = d.select((_i() % 50 + 1).alias("number")).distinct().withColumn("latest_issue_date", F.lit("2024-07-01"))
    acts = d.select(F.concat(F.lit("P-"), _i(), F.lit("/g")).alias("ref"), F.concat(F.lit("Act "), _i()).alias("title"), F.lit("USCODE").alias("collection"), F.lit("2023-01-02").alias("date_issued"),
                    F.when(_i() % 2 == 0, "<p>html text</p>").alias("htm"), F.lit("plain text").alias("txt"))
    filings = d.select(F.concat(F.lit("0001-24-"), _i(), F.lit(":f.htm")).alias("ref"), F.lit("0077").alias("cik"), F.lit("Firm").alias("company"), F.lit("10-K").alias("form"),
                       F.lit("2024-01-02").alias("filed"), F.concat(F.lit("<div>filed "), _i(), F.lit("</div>")).alias("body"))
    every = pv.all_documents(pv.rulemaking_documents(rules), pv.code_documents(code, titles).filter("error is null"), pv.publication_documents(acts), pv.filing_documents(filings))
    return every.select("provider", "ref", "title", "text", "source_uri")


def _cast_text(spark, sf):
    """A cast file per document: two people, the second in bold, and for every fourth file
    the experiment around them."""
    first = F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z ]", " "), r"\s+", " ")
    head = F.when(_i() % 4 == 0, F.concat(F.lit("# Scenario\nA dispute over "), _i(), F.lit(".\n\n# Settings\n- Max turns: 1,0"), _i() % 10, F.lit("\nWords per turn: 300\n\n# Source\nLink: https://example.org/a\n\n"))).otherwise("")
    return _docs(spark, sf).select(F.format_string("f%09d.md", _i()).alias("file"), F.concat(
        F.lit("<!-- how to use -->\n"), head, F.lit("# Dana Reyes "), _i(), F.lit("\n## Objectves\n"), first, F.lit("\n## Tendencies\n- listens\n  and waits\n- argues\n## Leverage\nmuch\n"
              "\n**Lee Park**\n## Role\nbuyer\nModel: Default\n## Case files\nNone\n## Played by\nA person.\n")).alias("text"))


@query("s11_cast_files", r"""
WITH d AS (SELECT doc_id, printf('f%09d.md', doc_id) AS file, trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), '\s+', ' ', 'g')) AS goal FROM documents)
SELECT file, 'Dana Reyes ' || doc_id AS name, 'dana-reyes-' || doc_id AS agent_id, NULL AS role, nullif(goal, '') AS goal, 'listens and waits|argues' AS tendencies, 'Leverage: much' AS notes, NULL AS model, NULL AS played_by FROM d
UNION ALL SELECT file, 'Lee Park', CASE WHEN row_number() OVER (ORDER BY file) = 1 THEN 'lee-park' ELSE 'lee-park-' || row_number() OVER (ORDER BY file) END, 'buyer' || chr(10) || 'Model: Default', NULL, NULL, NULL, NULL, 'person' FROM d""")
def _(spark, sf):
    cast = cast_files.agents(cast_files.file_lines(_cast_text(spark, sf)))
    people = cast_files.with_ids(cast)
    released(cast)
    return people.select("file", "name", "agent_id", "role", "goal", F.array_join("tendencies", "|").alias("tendencies"), "notes", "model", "played_by")


@query("s11_experiment_file", """
SELECT 'f000000000.md' AS file, 'A dispute over 0.' AS scenario, 100 AS max_turns, 300 AS word_limit, 'https://example.org/a' AS source_url FROM documents WHERE doc_id = 0""")
def _(spark, sf):
    return cast_files.experiment(cast_files.file_lines(_cast_text(spark, sf))).select("file", "scenario", "max_turns", "word_limit", "source_url")


def _records(spark, sf):
    """The given tables as record tables."""
    e = ad.experiments(spark, sf).select(F.col("experiment_id").cast("string").alias("id"), "name", F.when(
        F.col("experiment_id") % 50 == 7, "debate").otherwise(F.col("mode")).alias("mode"), (F.col("experiment_id") % 120).cast("string").alias("owner_id"))
    r = ad.runs(spark, sf).select(F.col("run_id").cast("string").alias("id"), (F.col("experiment_id") + F.col("run_id") % 2 * 3).cast("string").alias("experiment_id"), "status")
    u = ad.users(spark, sf).select(F.col("user_id").cast("string").alias("id"), "status", "role", (F.col("approved_by") * 3).cast("string").alias("approved_by"))
    d = ad.documents(spark, sf).select(F.col("document_id").alias("id"), "corpus", "title", "sha256", "replaced_by")
    m = ad.versions(spark, sf)
    li = ad.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"))
    return {n: records.conform(df, n) for n, df in (("experiments", e), ("runs", r), ("users", u), ("documents", d), ("corpus_members", m), ("chunks", li))}


@query("s12_table_rules", """
SELECT 'experiments' AS "table", 'mode in its words' AS rule, count(*) FILTER (WHERE c_custkey % 50 = 7) AS broken FROM customer
UNION ALL SELECT 'experiments', 'id unique', 0
UNION ALL SELECT 'experiments', 'owner_id in users', count(*) FROM customer WHERE c_custkey % 120 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'runs', 'status in its words', 0 UNION ALL SELECT 'runs', 'id unique', 0
UNION ALL SELECT 'runs', 'experiment_id in experiments', count(*) FROM orders WHERE o_custkey + o_orderkey % 2 * 3 NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'runs', 'launched_by in users', 0
UNION ALL SELECT 'users', 'status in its words', 0 UNION ALL SELECT 'users', 'role in its words', 0 UNION ALL SELECT 'users', 'id unique', 0
UNION ALL SELECT 'users', 'approved_by in users', count(*) FROM v_users WHERE approved_by * 3 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'documents', 'id unique', 0 UNION ALL SELECT 'documents', 'replaced_by in documents', count(*) FROM v_documents WHERE replaced_by NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents', 'added_by in users', 0
UNION ALL SELECT 'corpus_members', 'corpus, version, document_id unique', 0 UNION ALL SELECT 'corpus_members', 'document_id in documents', 0
UNION ALL SELECT 'chunks', 'document_id, ordinal unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'chunks', 'document_id in documents', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)""")
def _(spark, sf):
    return table_report(_records(spark, sf))


@query("s13_json_columns", """
SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, true AS has_k, false AS has_spoken FROM events""")
def _(spark, sf):
    e = ad.table(spark, sf, "events").select("event_id", records.payload_fields(F.col("props")).alias("v"))
    return e.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"), F.variant_get("v", "$.k", "string").isNotNull().alias("has_k"),
                    F.try_variant_get("v", "$.spoken", "string").isNotNull().alias("has_spoken"))


@query("s13_experiment_config", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'src1,src2' WHEN 1 THEN 'src' || c_custkey END AS libraries, CASE WHEN c_custkey % 3 = 2 THEN 'src9' END AS corpus,
  CASE WHEN c_custkey % 3 = 2 THEN 'a' END AS agent, CASE WHEN c_custkey % 3 = 2 THEN 'src3' END AS file FROM customer""")
def _(spark, sf):
    c = ad.table(spark, sf, "customer")
    i = F.col("c_custkey")
    text = (F.when(i % 3 == 0, '{"libraries": ["src1", "src2"], "model": {"a": 1}}').when(i % 3 == 1, F.concat(F.lit('{"libraries": "src'), i, F.lit('"}')))
            .otherwise('{"corpus": "src9", "agents": [{"id": "a", "libraries": ["src3"]}]}'))
    x = records.experiment_config(text)
    return c.select("c_custkey", F.array_join(x["libraries"], ",").alias("libraries"), x["corpus"].alias("corpus"),
                    F.get(x["agents"], F.lit(0))["id"].alias("agent"), F.get(F.get(x["agents"], F.lit(0))["libraries"], F.lit(0)).alias("file"))


@query("s14_citation_export", """
WITH l AS (SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY lower(text), document_id) AS n, text || CASE WHEN url <> '' THEN ' ' || url ELSE '' END AS t FROM v_forms)
SELECT corpus, n, n || '. ' || t AS line FROM l UNION ALL SELECT DISTINCT corpus, -1, 'Citation list: ' || corpus || ' (current contents)' FROM l UNION ALL SELECT DISTINCT corpus, 0, '' FROM l""")
def _(spark, sf):
    entries = cit.citation_list(_cited_documents(spark, sf), ["corpus"])
    return records.citation_export(entries, ["corpus"], F.concat(F.lit("Citation list: "), "corpus", F.lit(" (current contents)")))
