"""Queries that trace citations to their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as op
from . import adapters as ad
from .document_queries import cut, squeeze, wc
from .registry import query, view
from .retrieval_queries import _LABEL

_GROUPS = r"regexp_extract_all({0}, '\[({1}\d{{1,3}}(?:\s*,\s*{1}\d{{1,3}})*)\]', 1)"


def marks(text, prefix=""):
    """SQL for the numbers in a text's markers, in order, each once."""
    parts = f"flatten(list_transform({_GROUPS.format(text, prefix)}, lambda g: string_split(g, ',')))"
    nums = f"list_transform({parts}, lambda p: CAST(regexp_replace(p, '[^0-9]', '', 'g') AS BIGINT))"
    return f"list_filter({nums}, lambda x, i: list_position({nums}, x) = i)"


view("v_marks", f"SELECT run_id, turn, unnest(ns) AS n FROM (SELECT run_id, turn, {marks('content')} AS ns FROM v_answers)")
view("v_ledger", """
SELECT run_id, chunk_id, row_number() OVER (PARTITION BY run_id ORDER BY first, chunk_id) AS n
FROM (SELECT run_id, chunk_id, min(turn * 10 + rank) AS first FROM v_handed_out GROUP BY 1, 2)""")
view("v_passages", """
SELECT l.n, h.* EXCLUDE (turn, rank) FROM v_ledger l JOIN (
  SELECT *, row_number() OVER (PARTITION BY run_id, chunk_id ORDER BY turn, rank) AS k FROM v_handed_out) h
ON h.run_id = l.run_id AND h.chunk_id = l.chunk_id AND h.k = 1""")
_EXC = cut("trim(c.content)", 1500, " …")
view("v_links", f"""
SELECT m.run_id, m.turn, m.n, 'Turn ' || m.turn AS context, '[' || m.n || ']' AS quoted_text,
  CASE WHEN c.chunk_id IS NULL THEN 'unsupported' ELSE 'grounded' END AS verdict, CASE WHEN c.chunk_id IS NOT NULL THEN {_LABEL} END AS source_label,
  CASE WHEN c.kept THEN c.chunk_id END AS chunk_id, CASE WHEN c.kept THEN c.document_id END AS document_id, CASE WHEN c.kept THEN c.corpus END AS corpus,
  CASE WHEN c.kept THEN c.version END AS corpus_version, round_even(c.similarity, 4) AS similarity, c.url AS source_url, c.retrieved_at, c.fingerprint,
  CASE WHEN NOT c.kept THEN {_EXC} END AS excerpt FROM v_marks m LEFT JOIN v_passages c ON c.run_id = m.run_id AND c.n = m.n""")


def _answers(spark, sf):
    return ad.answers(spark, sf)


def _passages(spark, sf):
    return op.passage_facts(ad.handed_out(spark, sf), ["turn", "rank"])


def _links(spark, sf):
    return op.link_citations(_answers(spark, sf), _passages(spark, sf), ["run_id"],
                             context=F.concat(F.lit("Turn "), "turn"))


@query("c1_markers", f"SELECT run_id, turn, array_to_string({marks('content')}, ',') AS numbers FROM v_answers")
def _(spark, sf):
    return _answers(spark, sf).select("run_id", "turn", F.array_join(op.cited_numbers(F.col("content")).cast("array<string>"), ",").alias("numbers"))


@query("c1_prefixed_markers", f"SELECT run_id, turn, array_to_string({marks('tagged', 'S')}, ',') AS numbers FROM (SELECT run_id, turn, replace(content, '[', '[S') AS tagged FROM v_answers)")
def _(spark, sf):
    x = F.replace("content", F.lit("["), F.lit("[S"))
    return _answers(spark, sf).select("run_id", "turn", F.array_join(op.cited_numbers(x, "S").cast("array<string>"), ",").alias("numbers"))


@query("c2_linked_citations", "SELECT * FROM v_links")
def _(spark, sf):
    return _links(spark, sf).withColumn("similarity", F.bround("similarity", 4))


@query("c3_passage_numbers", "SELECT run_id, chunk_id, n FROM v_ledger")
def _(spark, sf):
    return op.number_passages(ad.handed_out(spark, sf), ["turn", "rank"])


@query("c4_rekeyed_passages", """
SELECT run_id, chunk_id, n FROM v_ledger UNION ALL SELECT run_id, chunk_id + 1000, n FROM v_ledger WHERE chunk_id % 3 = 0""")
def _(spark, sf):
    ledger = op.number_passages(ad.handed_out(spark, sf), ["turn", "rank"])
    kept = ledger.filter("chunk_id % 3 = 0").select("run_id", F.col("chunk_id").alias("old_id"), (F.col("chunk_id") + 1000).alias("new_id"))
    known = kept.filter("old_id = 3").select("run_id", "old_id", F.col("old_id").alias("new_id"))
    return op.rekeyed(ledger, kept.unionByName(known))


@query("c5_sources_handed_out", f"""
SELECT c.run_id, CAST(c.n AS VARCHAR) AS marker, {_LABEL} AS label, c.corpus, c.version, CASE WHEN kept THEN document_id END AS document_id,
  CASE WHEN kept THEN chunk_id END AS chunk_id, round_even(similarity, 3) AS similarity, m.n IS NOT NULL AS cited, kept, url, retrieved_at, fingerprint,
  CASE WHEN NOT kept AND m.n IS NOT NULL THEN {_EXC} END AS excerpt
FROM v_passages c LEFT JOIN (SELECT DISTINCT run_id, n FROM v_marks) m ON m.run_id = c.run_id AND m.n = c.n""")
def _(spark, sf):
    cited = _answers(spark, sf).select("run_id", F.explode(op.cited_numbers(F.col("content"))).alias("n"))
    return op.sources_handed_out(_passages(spark, sf), cited)


# Answers that cite search results. Result w of a run was read when (run + w) % 3 <> 0.
@query("c6_result_markers", """
WITH a AS (SELECT conv_id AS run_id, turn, turn % 4 + 1 AS a, turn % 3 + 2 AS b, conv_id % 9 + 1 AS c FROM conversations),
f AS (SELECT *, (run_id + a) % 3 <> 0 AS ra, (run_id + b) % 3 <> 0 AS rb, (run_id + c) % 3 <> 0 AS rc FROM a)
SELECT run_id, turn, 'See ' || CASE WHEN ra AND rb THEN CASE WHEN a = b THEN '[' || (a * 10) || ']' ELSE '[' || (a * 10) || ', ' || (b * 10) || ']' END
    ELSE '[W' || a || ', W' || b || ']' END || ' and ' || CASE WHEN rc THEN '[' || (c * 10) || ']' ELSE '[W' || c || ']' END || '.' AS content,
  concat_ws(',', CASE WHEN NOT ra THEN a END, CASE WHEN NOT rb THEN b END, CASE WHEN NOT rc THEN c END) AS unread FROM f""")
def _(spark, sf):
    c = ad.table(spark, sf, "conversations")
    texts = c.select(F.col("conv_id").alias("run_id"), "turn", F.concat(
        F.lit("See [W"), F.col("turn") % 4 + 1, F.lit(", W"), F.col("turn") % 3 + 2, F.lit("] and [W"), F.col("conv_id") % 9 + 1, F.lit("].")).alias("content"))
    runs = c.select(F.col("conv_id").alias("run_id")).distinct()
    reads = runs.withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(9)))).filter("(run_id + w) % 3 <> 0")
    reads = reads.select("run_id", "w", F.explode(F.array((F.col("w") * 10 + 1).cast("long"), (F.col("w") * 10).cast("long"))).alias("n"))
    return op.resolve_result_markers(texts, reads, ["run_id", "turn"]).select(
        "run_id", "turn", "content", F.array_join(F.col("unread").cast("array<string>"), ",").alias("unread"))


# Citation rows as stored: those of even turns keep only their passage, as older rows did.
view("v_stored", """
SELECT run_id, turn * 1000 + n AS position, quoted_text, context, verdict, source_label, chunk_id, CASE WHEN turn % 2 = 1 THEN document_id END AS document_id,
  CASE WHEN turn % 2 = 1 THEN corpus END AS corpus, CASE WHEN turn % 2 = 1 THEN corpus_version END AS corpus_version, source_url, retrieved_at, fingerprint FROM v_links""")
view("v_doc_owner", "SELECT document_id, min(corpus) AS corpus FROM v_chunks GROUP BY 1")
view("v_run_pins", "SELECT DISTINCT run_id, 'c' || (run_id % 10) AS corpus, 5 AS version FROM v_links")
view("v_resolved", """
SELECT s.*, coalesce(s.document_id, ch.document_id) AS doc_id, coalesce(s.corpus, d.corpus) AS library, coalesce(s.corpus_version, rl.version) AS library_version
FROM v_stored s LEFT JOIN v_chunks ch ON s.document_id IS NULL AND ch.chunk_id = s.chunk_id LEFT JOIN v_doc_owner d ON d.document_id = ch.document_id
LEFT JOIN v_run_pins rl ON rl.run_id = s.run_id AND rl.corpus = coalesce(s.corpus, d.corpus)""")


def _resolved(spark, sf):
    odd = F.col("turn") % 2 == 1
    s = _links(spark, sf).withColumns({
        "position": F.col("turn") * 1000 + F.col("n"), **{c: F.when(odd, F.col(c)) for c in ("document_id", "corpus", "corpus_version")}})
    c = ad.chunks(spark, sf).select("chunk_id", "document_id", "corpus")
    owner = c.groupBy("document_id").agg(F.min("corpus").alias("corpus"))
    pins = _answers(spark, sf).select("run_id").distinct().select(
        "run_id", F.concat(F.lit("c"), F.col("run_id") % 10).alias("corpus"), F.lit(5).alias("version"))
    return op.resolve_rows(s, c, owner, pins)


@query("c7_resolved_rows", "SELECT run_id, position, verdict, doc_id, library, library_version FROM v_resolved")
def _(spark, sf):
    return _resolved(spark, sf).select("run_id", "position", "verdict", "doc_id", "library", "library_version")


view("v_refs", """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first) AS n, doc_id IS NULL AS read_online,
  CASE WHEN doc_id IS NULL THEN '' ELSE coalesce('“' || library || '”' || coalesce(' v' || library_version, ''), '') END AS library_text FROM (
  SELECT run_id, key, min(position) AS first, count(*) AS uses, arg_min(doc_id, position) AS doc_id, arg_min(source_label, position) AS source_label,
    arg_min(source_url, position) AS source_url, (array_agg(library ORDER BY position))[1] AS library, (array_agg(library_version ORDER BY position))[1] AS library_version,
    arg_min(retrieved_at, position) AS retrieved_at
  FROM (SELECT *, CASE WHEN verdict = 'grounded' AND doc_id IS NOT NULL THEN 'd' || doc_id WHEN verdict = 'grounded' AND source_url IS NOT NULL THEN 'u' || source_url END AS key FROM v_resolved)
  WHERE key IS NOT NULL GROUP BY run_id, key)""")


@query("c8_references", "SELECT run_id, n, doc_id, source_label, source_url, uses, library_text, read_online FROM v_refs")
def _(spark, sf):
    refs, _ = op.references(_resolved(spark, sf))
    return refs.select("run_id", "n", "doc_id", "source_label", "source_url", "uses", "library_text", "read_online")


@query("c8_by_library", """
SELECT run_id, CASE WHEN read_online THEN 'read online, not kept' WHEN library_text <> '' THEN library_text ELSE 'no library' END AS library, count(*) AS documents
FROM v_refs GROUP BY 1, 2""")
def _(spark, sf):
    return op.references_by_library(op.references(_resolved(spark, sf))[0])


@query("c9_reference_list", """
WITH u AS (SELECT run_id, CASE WHEN verdict = 'grounded' AND doc_id IS NOT NULL THEN 'd' || doc_id WHEN verdict = 'grounded' AND source_url IS NOT NULL THEN 'u' || source_url END AS key,
    position, verdict, trim(quoted_text || ' ' || context) AS said FROM v_resolved)
SELECT r.run_id, 1 AS section, r.n, r.n || '. ' || r.source_label || coalesce(' ' || r.source_url, '') || chr(10) || CASE WHEN r.read_online THEN '   Read online on ' || r.retrieved_at
    || '; no copy kept (the page may have changed since). Cited: ' ELSE '   Searched in library ' || CASE WHEN library_text <> '' THEN library_text ELSE '(unknown)' END || '. Cited: ' END
  || (SELECT string_agg(said, '; ' ORDER BY position) FROM u WHERE u.run_id = r.run_id AND u.key = r.key) || '.' AS line FROM v_refs r
UNION ALL SELECT run_id, 2, 1, 'Markers that name no passage the model was given (unsupported):' || chr(10) || string_agg(said, '; ' ORDER BY position) FROM u WHERE verdict = 'unsupported' GROUP BY run_id""")
def _(spark, sf):
    rows = _resolved(spark, sf)
    refs, uses = op.references(rows)
    named = refs.withColumns({"text": F.col("source_label"), "url": F.col("source_url")})
    return op.reference_lines(named, uses, op.unsupported(rows))


_META = """map([{0}], [{1}])"""
view("v_cited_documents", """
SELECT document_id, corpus, title, CASE document_id % 8 WHEN 6 THEN 'brief.pdf' WHEN 7 THEN NULL ELSE source_uri END AS source_uri, doc_type,
  strftime(created_at, '%B %-d, %Y') AS read_on, document_id % 8 AS form FROM v_documents""")
_T = "rtrim(regexp_replace(trim(title), '\\s+', ' ', 'g'), '.,;')"
_FORMS = f"""CASE form
 WHEN 0 THEN trim(regexp_replace(trim(title), '\\s+', ' ', 'g')) || ' (D. Mont., November 18, 1994). CourtListener, opinion no. ' || document_id || ', retrieved May 6, 2024.'
 WHEN 1 THEN '40 CFR § 262.20 — ' || {_T} || '. eCFR, current as of July 1, 2024, retrieved ' || read_on || '.'
 WHEN 2 THEN {_T} || '. Federal Register document 2024-' || document_id || ' (Rule, published March 4, 2024), abstract only, retrieved ' || read_on || '.'
 WHEN 3 THEN {_T} || '. govinfo, USCODE, issued January 2, 2023, package P-' || document_id || ', retrieved ' || read_on || '.'
 WHEN 4 THEN {_T} || '. SEC EDGAR, accession no. 0001-' || document_id || ', retrieved ' || read_on || '.'
 WHEN 5 THEN {_T} || '. Web page, published soon' || CASE WHEN doc_type = 'PDF' THEN ', PDF' ELSE '' END || ', retrieved ' || read_on || '.'
 WHEN 6 THEN {_T} || '. Uploaded file brief.pdf, retrieved ' || read_on || '.'
 ELSE {_T} || '. Retrieved ' || read_on || '.' END"""
view("v_forms", f"SELECT document_id, corpus, {_FORMS} AS text, CASE WHEN form < 6 THEN source_uri ELSE '' END AS url FROM v_cited_documents")


def _cited_documents(spark, sf):
    d = ad.documents(spark, sf)
    i = F.col("document_id")

    def facts(**kv):
        return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])

    meta = (F.when(i % 8 == 0, facts(provider="courtlistener", court="D. Mont.", date_filed="1994-11-18",
                                     opinion_id=i.cast("string"), retrieved_at="2024-05-06T10:00:00"))
            .when(i % 8 == 1, facts(provider="ecfr", citation="40 CFR § 262.20", as_of="2024-07-01"))
            .when(i % 8 == 2, facts(provider="federal_register", document_number=F.concat(F.lit("2024-"), i), type="Rule",
                                    publication_date="2024-03-04", abstract_only="true"))
            .when(i % 8 == 3, facts(provider="govinfo", collection="USCODE", date_issued="2023-01-02", package_id=F.concat(F.lit("P-"), i)))
            .when(i % 8 == 4, facts(provider="sec_edgar", accession=F.concat(F.lit("0001-"), i)))
            .when(i % 8 == 5, facts(link="https://example.org/x", published="soon"))
            .otherwise(F.expr("cast(map() as map<string,string>)")))
    return d.withColumns({"metadata": meta, "source_uri": F.when(i % 8 == 6, "brief.pdf").when(i % 8 == 7, None).otherwise(F.col("source_uri")),
                          "title": F.when(i % 8 == 1, F.concat(F.lit("§ 262.20 "), "title")).otherwise(F.col("title"))})


@query("c10_citation_forms", "SELECT document_id, text, url FROM v_forms")
def _(spark, sf):
    text, url = op.citation(F.col("title"), F.col("source_uri"), F.col("doc_type"), F.col("metadata"), F.col("created_at"))
    return _cited_documents(spark, sf).select("document_id", text.alias("text"), url.alias("url"))


@query("c11_citation_list", """
SELECT corpus, document_id, text, url, row_number() OVER (PARTITION BY corpus ORDER BY lower(text), document_id) AS n FROM v_forms""")
def _(spark, sf):
    return op.citation_list(_cited_documents(spark, sf), ["corpus"])


@query("c12_verdict_rollup", """
SELECT run_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'grounded') AS grounded, count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported,
  0 AS unchecked, round_even(count(*) FILTER (WHERE verdict = 'grounded') / count(*), 3) AS grounded_rate FROM v_links GROUP BY run_id""")
def _(spark, sf):
    return op.verdict_rollup(_links(spark, sf))


# Role-play turns cite their own sources and exhibits on record.
view("v_turns", """SELECT run_id, turn, agent_id, name, 'I rely on [S' || (turn % 3 + 1) || '] and [S' || ((turn + run_id) % 4 + 1) || '] and [E' || (turn % 4 + 1) || ']. ' || content AS content FROM v_transcript""")
view("v_exhibits", f"""
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn, pos) AS n FROM (
  SELECT c.run_id, c.chunk_id, t.turn, t.agent_id, t.name, t.pos, c.rank, {_LABEL} AS label, c.content, c.rank = 2 AS private,
    row_number() OVER (PARTITION BY c.run_id, c.chunk_id ORDER BY t.turn, t.pos) AS k
  FROM (SELECT DISTINCT run_id, turn, agent_id, name, p AS pos, CASE p WHEN 0 THEN turn % 3 + 1 ELSE (turn + run_id) % 4 + 1 END AS rank
        FROM v_turns, (SELECT unnest([0, 1]) AS p)) t JOIN v_handed_out c ON c.run_id = t.run_id AND c.turn = t.turn AND c.rank = t.rank) WHERE k = 1""")


def _turns(spark, sf):
    t, r = F.col("turn"), F.col("run_id")
    return ad.transcript(spark, sf).withColumn("content", F.concat(
        F.lit("I rely on [S"), t % 3 + 1, F.lit("] and [S"), (t + r) % 4 + 1, F.lit("] and [E"), t % 4 + 1, F.lit("]. "), "content"))


def _exhibits(spark, sf):
    return op.disclosures(_turns(spark, sf), ad.handed_out(spark, sf).withColumn("private", F.col("rank") == 2))


@query("c13_disclosures", "SELECT run_id, 'E' || n AS marker, chunk_id, turn, agent_id, 'S' || rank AS from_marker, label, private FROM v_exhibits")
def _(spark, sf):
    return _exhibits(spark, sf).select("run_id", "marker", "chunk_id", "turn", "agent_id", "from_marker", "label", "private")


@query("c14_exhibit_citations", """
SELECT t.run_id, t.turn, t.turn % 4 + 1 AS n, CASE WHEN e.n IS NULL THEN 'unsupported' ELSE 'grounded' END AS verdict, e.label AS source_label, e.chunk_id
FROM v_turns t LEFT JOIN v_exhibits e ON e.run_id = t.run_id AND e.n = t.turn % 4 + 1 AND e.turn < t.turn""")
def _(spark, sf):
    return op.exhibit_citations(_turns(spark, sf), _exhibits(spark, sf))


@query("c15_exhibit_entries", f"""
SELECT run_id, n, '[E' || n || '] ' || label || ' (disclosed by ' || name || ' in turn ' || turn || CASE WHEN private THEN ', from their case file)' ELSE ')' END
  || CASE WHEN n > max(n) OVER (PARTITION BY run_id) - 8 THEN chr(10) || content ELSE '' END AS entry FROM v_exhibits""")
def _(spark, sf):
    return op.exhibit_entries(_exhibits(spark, sf))


view("v_seen", f"""
SELECT run_id, n, heading, row_number() OVER (PARTITION BY run_id ORDER BY first DESC) AS from_last, greatest(count(*) OVER (PARTITION BY run_id) - 5, 0) AS left_out FROM (
  SELECT c.run_id, l.n, arg_max({_LABEL}, c.turn * 10 + c.rank) AS heading, min(c.turn * 10 + c.rank) AS first
  FROM v_handed_out c JOIN v_ledger l ON l.run_id = c.run_id AND l.chunk_id = c.chunk_id GROUP BY 1, 2)""")


def _seen(spark, sf):
    h = ad.handed_out(spark, sf)
    n = op.number_passages(h, ["turn", "rank"])
    from ..operators.retrieval import cite_label
    label = cite_label(F.col("title"), F.col("page_start"), F.col("page_end"))
    heads = h.join(n, ["run_id", "chunk_id"]).select("run_id", "turn", "rank", F.concat(F.lit("["), "n", F.lit("] "), label, F.lit("\n"), "content").alias("b"))
    results = heads.groupBy("run_id", F.col("turn").alias("position")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "\n\n").alias("content"))
    return op.passages_seen(results, ["run_id"], limit=5)


@query("c16_passages_seen", "SELECT run_id, n, heading, from_last, left_out FROM v_seen WHERE from_last <= 5")
def _(spark, sf):
    return _seen(spark, sf)


@query("c16_cite_notes", """
SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'If you are still researching, continue with the tools. If you are done, give ' ELSE 'Give ' END ||
  'your findings again, citing the passage numbers [n] that support each claim. Passages you have been given:' || chr(10) ||
  CASE WHEN max(left_out) > 0 THEN '(' || max(left_out) || ' earlier passages, not shown)' || chr(10) ELSE '' END || string_agg('[' || n || '] ' || heading, chr(10) ORDER BY from_last DESC) AS note
FROM v_seen WHERE from_last <= 5 GROUP BY run_id""")
def _(spark, sf):
    return op.cite_note(_seen(spark, sf), ["run_id"], F.col("run_id") % 2 == 0)


@query("c16_findings_without_citations", """
SELECT run_id, turn FROM v_answers WHERE turn % 2 = 0""")
def _(spark, sf):
    a = _answers(spark, sf).withColumn("content", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[2024] "), F.regexp_replace("content", r"\[[0-9, ]*\]", "")))
                                       .otherwise(F.col("content")))
    return op.without_citations(a).select("run_id", "turn")


@query("c17_cited_digest", f"""
WITH m AS (SELECT DISTINCT run_id, n FROM v_marks), l AS (
  SELECT c.run_id, c.n, '[' || c.n || '] ' || {_LABEL} || ': ' || left({squeeze('c.content')}, 700) AS line FROM m JOIN v_passages c ON c.run_id = m.run_id AND c.n = m.n),
u AS (SELECT *, sum(length(line)) OVER (PARTITION BY run_id ORDER BY n) AS used FROM l)
SELECT run_id, n, line FROM u WHERE used <= 120
UNION ALL SELECT run_id, 1000000, '(and ' || ((SELECT count(*) FROM m WHERE m.run_id = u.run_id) - count(*) FILTER (WHERE used <= 120)) || ' more passages, not shown for room)'
FROM u GROUP BY run_id HAVING max(used) > 120""")
def _(spark, sf):
    cited = _answers(spark, sf).select("run_id", F.explode(op.cited_numbers(F.col("content"))).alias("n"))
    return op.cited_digest(cited, _passages(spark, sf), 120)
