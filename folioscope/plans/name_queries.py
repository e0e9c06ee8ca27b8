"""Queries that put made-up names in place of real ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names as op
from . import adapters as ad
from .document_queries import squeeze
from .registry import query, view

# Every document is given a sentence that names people, a body and a firm.
_LEAD = ("Gov. Alan Brook met Nora Finch of Cobalt Logistics at the Montana Supreme Court. Cobalt and Finch argued; "
         "Brook’s aide, Ann Lee-Price, agreed. ")


def _sources(spark, sf):
    d = ad.table(spark, sf, "documents")
    who = F.concat(F.lit("Number"), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij"))
    return d.select("doc_id", F.concat(F.lit(_LEAD), F.lit("So did Dr. Jo "), who, F.lit(". "), "text").alias("text"), who.alias("who"))


def _labels(spark, sf):
    rows = [("Alan Brook", "person", "Piers Reed"), ("Nora Finch", "person", "Joan"), ("Cobalt", "company", "Vertex Freight"),
            ("Montana Supreme Court", "company", "Some Court"), ("Supreme Court", "company", "Other Court")]
    return _sources(spark, sf).select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(k).alias("kind"), F.lit(i).alias("invented"))
                                                                     for a, k, i in rows])).alias("pos", "x")).select("doc_id", "pos", "x.*")


def _pairs(spark, sf):
    s = _sources(spark, sf)
    return op.substitutions(_labels(spark, sf), s, s.select("doc_id", F.concat(F.lit("Jo "), "who").alias("name")))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WHO = "'Number' || translate(CAST(doc_id AS VARCHAR), '0123456789', 'abcdefghij')"
view("v_named", f"SELECT doc_id, '{_LEAD}So did Dr. Jo ' || {_WHO} || '. ' || text AS text FROM documents")
# The character before a name is part of the match here, as there is no look-behind.
_PHRASE = (r"(?:^|[^\pL\pM\p{Nd}\p{Pc}’''.-])((?:[A-Z]\.|[A-Z][A-Za-z’''-]+)(?:[ \t]+(?:(?:of|and|for|the|de|del|van|von|la|du)[ \t]+)?(?:[A-Z]\.|[A-Z][A-Za-z’''-]+)){0,7})")
view("v_phrases", f"SELECT doc_id, unnest(found) AS phrase, CAST(unnest(range(0, len(found))) AS BIGINT) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{_PHRASE}', 1) AS found FROM v_named)")


def _is_title(word: str) -> str:
    return f"list_contains({_list(op.TITLES)}, lower(regexp_replace({word}, '^[.,]+|[.,]+$', '', 'g')))"


view("v_tidy", rf"""
SELECT *, regexp_split_to_array(p, '\s+') AS w FROM (SELECT doc_id, n, trim(regexp_replace(regexp_replace(phrase, '[’'']s$', ''), '^(?:The|A|An)\s+', '')) AS p FROM v_phrases)
WHERE p <> '' AND (contains(p, ' ') OR (NOT list_contains({_list(op.NOT_NAMES)}, p) AND length(p) >= 3))""")
view("v_cores", f"""
SELECT *, CASE WHEN run > 3 THEN 2 WHEN run = 3 AND len(w) > 3 AND NOT {_is_title('w[len(w) - 3]')} THEN 2 ELSE run END AS take FROM (
  SELECT *, len(w) - list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN NOT regexp_matches(w[i], '^\\p{{Lu}}') OR {_is_title('w[i]')} THEN i ELSE 0 END)) AS run FROM v_tidy)""")
view("v_candidates", """
SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS pos FROM (SELECT doc_id, name, min(n) AS first FROM (
  SELECT doc_id, p AS name, 2 * n AS n FROM v_cores UNION ALL SELECT doc_id, array_to_string(w[len(w) - take + 1:], ' '), 2 * n + 1 FROM v_cores WHERE len(w) > 2 AND take >= 2) GROUP BY 1, 2)""")


def _public(phrase: str) -> str:
    bare = f"list_transform(regexp_split_to_array(trim({phrase}), '\\s+'), lambda x: regexp_replace(x, '^[.,’'']+|[.,’'']+$', '', 'g'))"
    return (f"CASE WHEN list_has_any({bare}, {_list(op.PUBLIC_WORDS)}) THEN true WHEN list_contains({_list(op.PRIVATE_SUFFIXES)}, ({bare})[-1]) THEN false "
            f"ELSE list_has_any({bare}, {_list(op.PLACE_WORDS)}) END")


def _fallback(name: str) -> str:
    digits = f"list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256({name}), i, 1)) - 1)"
    rest = f"list_reduce({digits}, lambda a, d: (a * 16 + d) % 1940)"
    return f"({_list(op.FIRST_NAMES)})[{rest} % 20 + 1] || ' ' || ({_list(op.SURNAMES)})[{rest} // 97 + 1]"


# What the labels and the forced person of a document come to: one labelled name gets a single word and so a fallback, two are no private names.
view("v_renamed", f"""
SELECT doc_id, real, invented, contains(real, ' ') AS "full" FROM (
  SELECT doc_id, unnest(['Alan Brook', 'Brook', 'Nora Finch', 'Finch', 'Cobalt Logistics', 'Cobalt', 'Jo ' || who, who]) AS real,
    unnest(['Piers Reed', 'Reed', nora, split_part(nora, ' ', 2), 'Vertex Freight', 'Vertex', jo, split_part(jo, ' ', 2)]) AS invented
  FROM (SELECT doc_id, {_WHO} AS who, {_fallback("'Jo ' || " + _WHO)} AS jo, {_fallback("'Nora Finch'")} AS nora FROM documents))""")


@query("g1_name_candidates", "SELECT doc_id, pos, name FROM v_candidates")
def _(spark, sf):
    found = _sources(spark, sf).select("doc_id", F.posexplode(op.name_candidates(F.col("text"))).alias("pos", "name"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query("g2_public_names", f"""
WITH p AS (SELECT DISTINCT doc_id, phrase, {_public('phrase')} AS public FROM v_phrases),
h AS (SELECT c.doc_id, c.name, p.phrase = c.name OR NOT p.public AS own FROM v_candidates c JOIN p ON p.doc_id = c.doc_id AND contains(p.phrase, c.name)
  AND regexp_matches(' ' || p.phrase || ' ', '[^\\pL\\pM\\p{{Nd}}\\p{{Pc}}]' || regexp_escape(c.name) || '[^\\pL\\pM\\p{{Nd}}\\p{{Pc}}]')),
i AS (SELECT doc_id, name, NOT bool_or(own) AS inside_only FROM h GROUP BY 1, 2)
SELECT c.doc_id, c.name, {_public('c.name')} AS public, coalesce(inside_only, false) AS inside_only FROM v_candidates c LEFT JOIN i ON i.doc_id = c.doc_id AND i.name = c.name""")
def _(spark, sf):
    s = _sources(spark, sf).select("doc_id", op.phrases(F.col("text")).alias("found"))
    c = s.select("doc_id", "found", F.explode(op.candidates_of(F.col("found"))).alias("name"))
    return c.select("doc_id", "name", op.is_public_or_place(F.col("name")).alias("public"),
                    op.only_inside_public_names(F.col("name"), F.col("found"), F.lit(False)).alias("inside_only"))


@query("g3_substitutions", "SELECT doc_id, real, invented, \"full\" FROM v_renamed")
def _(spark, sf):
    return _pairs(spark, sf)


@query("g3_fallback_names", f"SELECT c_custkey, {_fallback('c_name')} AS invented FROM customer")
def _(spark, sf):
    return ad.table(spark, sf, "customer").select("c_custkey", op.fallback_name(F.col("c_name")).alias("invented"))


@query("g4_renamed_texts", f"""
WITH t AS (SELECT d.doc_id, 'Gov. Piers Reed met ' || nora || ' of Vertex Freight at the Montana Supreme Court. Vertex and ' || split_part(nora, ' ', 2) ||
    ' argued; Reed’s aide, Ann Lee-Price, agreed. So did Dr. ' || jo || '. ' || text AS text FROM documents d
  JOIN (SELECT doc_id, max(invented) FILTER (real = 'Nora Finch') AS nora, max(invented) FILTER (starts_with(real, 'Jo ')) AS jo FROM v_renamed GROUP BY 1) r ON r.doc_id = d.doc_id)
SELECT doc_id, left(text, 200) AS beginning, sha256(text) AS text_sha FROM t""")
def _(spark, sf):
    return op.apply_substitutions(_sources(spark, sf).drop("who"), _pairs(spark, sf)).select(
        "doc_id", F.substring("text", 1, 200).alias("beginning"), F.sha2("text", 256).alias("text_sha"))


@query("g5_names_used", f"""
WITH a AS (SELECT doc_id, unnest(range(0, 3)) AS agent_id, unnest([split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2), 'Zed Nowhere', 'Single']) AS name FROM documents
  WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+ '))
SELECT a.doc_id, a.agent_id, a.name FROM a JOIN documents d USING (doc_id) WHERE contains(a.name, ' ') AND regexp_matches({squeeze('d.text')}, '(?i)\\b' || a.name || '\\b')""")
def _(spark, sf):
    d = ad.table(spark, sf, "documents").filter(F.col("text").rlike("^[A-Za-z]+ [A-Za-z]+ "))
    w = F.split("text", " ")
    agents = d.select("doc_id", F.posexplode(F.array(F.concat(w[0], F.lit(" "), w[1]), F.lit("Zed Nowhere"), F.lit("Single"))).alias("agent_id", "name"))
    return op.names_used(agents.withColumn("agent_id", F.col("agent_id").cast("long")), d)


@query("g5_shown_substitutions", "SELECT doc_id, real, invented FROM v_renamed WHERE \"full\"")
def _(spark, sf):
    return op.renamed_for_display(_pairs(spark, sf))


@query("g6_name_in_context", """
WITH t AS (SELECT doc_id, regexp_extract(text, '[A-Z][a-z]+') AS name, text FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+')),
p AS (SELECT *, strpos(text, name) AS pos FROM t),
s AS (SELECT *, CASE WHEN contains(left(text, pos - 1), '. ') THEN pos - 1 - (strpos(reverse(left(text, pos - 1)), ' .') - 1) ELSE 0 END AS sentence FROM p)
SELECT doc_id, name, trim(regexp_replace(substr(text, greatest(sentence, pos - 101) + 1, 200), '\\s+', ' ', 'g')) AS context FROM s
WHERE regexp_matches(substr(' ' || text, pos, 1), '[ \\n]') AND regexp_matches(substr(text || ' ', pos + length(name), 1), '[ .,]')""")
def _(spark, sf):
    d = ad.table(spark, sf, "documents").withColumn("name", F.regexp_extract("text", "[A-Z][a-z]+", 0)).filter("name <> ''")
    at = F.expr("instr(text, name)")
    whole = F.substring(F.concat(F.lit(" "), "text"), at, F.lit(1)).rlike(r"[ \n]") & F.substring(
        F.concat("text", F.lit(" ")), at + F.length("name"), F.lit(1)).rlike("[ .,]")
    return d.filter(whole).select("doc_id", "name", op.name_in_context(F.col("text"), F.col("name")).alias("context"))
