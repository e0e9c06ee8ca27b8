"""Queries over landed web pages and crawl logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx, urls
from ..operators import libraries as lib, web as op
from . import adapters as ad
from .document_queries import squeeze
from .library_queries import _log
from .registry import query, view

HOST = r"regexp_replace(regexp_extract({0}, '^https?://([^/:?#]+)', 1), '^www\.', '')"
PATH = r"regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1)"
_NAME = r"lower(regexp_extract(" + PATH + r", '([^/]*)$', 1))"
KIND = r"""CASE WHEN contains({n}, '.') THEN CASE regexp_extract({n}, '(\.[^.]*)$', 1) WHEN '.pdf' THEN 'pdf' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text'
  WHEN '.html' THEN 'page' WHEN '.htm' THEN 'page' WHEN '.xhtml' THEN 'page' WHEN '.php' THEN 'page' WHEN '.asp' THEN 'page' WHEN '.aspx' THEN 'page'
  WHEN '.jsp' THEN 'page' WHEN '.cfm' THEN 'page' WHEN '.shtml' THEN 'page' ELSE '' END ELSE 'page' END"""


def host(e):
    return HOST.format(e)


def path(e):
    return PATH.format(e)


def kind(e):
    return KIND.format(n=_NAME.format(e))


def folder(e):
    return f"regexp_replace(CASE WHEN {path(e)} = '' THEN '/' ELSE {path(e)} END, '[^/]*$', '')"


def bare(e):
    return f"{host(e)} || regexp_replace({path(e)}, '(/|\\.html?)$', '') || '?' || regexp_extract({e}, '^[^?#]*\\?([^#]*)', 1)"


@query("s2_landed_pages", f"""
SELECT page_id, {host('url')} AS site, length(html) AS n_chars, 'text/html' AS content_type FROM pages""")
def _(spark, sf):
    from ..sources.files import landed_pages
    return landed_pages(ad.web_pages(spark, sf)).select("page_id", urls.host(F.col("url")).alias("site"), F.length("body").alias("n_chars"),
                                                       F.col("headers")["content-type"].alias("content_type"))


# Each page's links, and one link of each kept kind that the adapter puts at the end.
_EXTRA = ("<a href=\"paper.pdf\">PDF</a><a href=\"notes.txt#top\">notes</a><a href=\"https://other.example.net/x\">x</a>"
          "<a href=\"mailto:a@b.c\">m</a><a href=\"#here\">h</a><a href=\"pic.png\">p</a>")


def _pages(spark, sf):
    return ad.web_pages(spark, sf).withColumn("html", F.concat("html", F.lit(_EXTRA)))


view("v_hrefs", rf"""
SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link, i FROM (
  SELECT page_id, url, unnest(hs) AS href, CAST(unnest(range(0, len(hs))) AS BIGINT) AS i
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages))
UNION ALL SELECT page_id, url, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || f, 1000 + k FROM pages, (VALUES ('paper.pdf', 0), ('notes.txt', 1)) x(f, k)""")
view("v_page_links", f"""
SELECT page_id, url AS page_url, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY i) AS k FROM v_hrefs WHERE {kind('link')} <> '' AND {bare('link')} <> {bare('url')}) WHERE k = 1""")


@query("w1_page_links", "SELECT page_id, position, link FROM v_page_links")
def _(spark, sf):
    return op.extract_links(_pages(spark, sf)).select("page_id", "position", "link")


@query("w2_url_parts", f"""
SELECT page_id, {host('url')} AS host, {folder('url')} AS folder, {kind('url')} AS kind, {bare('url')} AS bare,
  {host('url')} || rtrim(regexp_replace({path('url')}, '\\.[A-Za-z0-9]{{1,5}}$', ''), '/') AS stem FROM pages""")
def _(spark, sf):
    u = F.col("url")
    return ad.web_pages(spark, sf).select("page_id", urls.host(u).alias("host"), urls.folder(u).alias("folder"), urls.kind(u).alias("kind"),
                                          urls.bare(u).alias("bare"), urls.stem(u).alias("stem"))


@query("w3_narrowed_links", f"""
SELECT page_id, link FROM v_page_links WHERE {kind('link')} IN ('pdf', 'text') AND starts_with({path('link')}, {folder('page_url')})""")
def _(spark, sf):
    links = op.extract_links(_pages(spark, sf))
    return links.filter(op.narrow(F.col("link"), F.col("page_url"), ["pdf", "text"], same_folder=True)).select("page_id", "link")


@query("w4_link_names")
def _(spark, sf):
    return op.link_names(_pages(spark, sf))


_NOTICE = (r"(?i)(?:[^.\n]|\.[^\s]){0,160}(?:licen[cs]ed under|creative commons|public domain|all rights reserved|for free distribution|"
           r"copyright|©)(?:[^.\n]|\.[^\s]){0,220}\.?")


@query("w5_licence_notice", rf"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN said <> '' THEN left(said || ' (https://creativecommons.org/licenses/by/4.0/)', 400)
    ELSE 'Licence: https://creativecommons.org/licenses/by/4.0/' END ELSE left(said, 400) END AS notice
FROM (SELECT doc_id, regexp_replace({squeeze(f"regexp_extract(text, '{_NOTICE}')")}, '\s+([.,;:])', '\1', 'g') AS said FROM documents)""")
def _(spark, sf):
    link = F.when(F.col("doc_id") % 3 == 0, F.lit("https://creativecommons.org/licenses/by/4.0/"))
    return ad.table(spark, sf, "documents").select("doc_id", op.licence_notice(F.col("text"), link).alias("notice"))


# Robots files by the length of the host's name; some sites do not answer.
_ROBOTS = {
    0: "# rules\nUser-agent: *\nDisallow: /t\nAllow: /the\nCrawl-delay: 5\nCrawl-delay: soon\n",
    1: "User-agent: GPTBot\nUser-agent: ClaudeBot # and others\nDisallow: /a\nDisallow:\nno colon here\n",
    2: "<!DOCTYPE html><html>not a robots file</html>",
    3: "Disallow: /ignored\nUser-agent: LabBot/2.0\nDisallow: /*e$\nDisallow: /z\ncrawl-delay: 90\n\nUser-agent: *\nDisallow: /\n",
}
_SITE = r"regexp_extract(url, '^https?://([^/:?#]+)', 1)"
view("v_sites", f"""SELECT DISTINCT {_SITE} AS site, length({_SITE}) % 4 AS form,
  CASE WHEN length({_SITE}) % 7 = 0 THEN 503 WHEN length({_SITE}) % 11 = 0 THEN 404 ELSE 200 END AS http_status FROM pages""")
view("v_lines", """
SELECT site, grp, key, value FROM v_sites s JOIN (VALUES (0, 1, 'user-agent', '*'), (0, 1, 'disallow', '/t'), (0, 1, 'allow', '/the'), (0, 1, 'crawl-delay', '5'),
  (1, 1, 'user-agent', 'gptbot'), (1, 1, 'user-agent', 'claudebot'), (1, 1, 'disallow', '/a'), (3, 1, 'user-agent', 'labbot'), (3, 1, 'disallow', '/*e$'),
  (3, 1, 'disallow', '/z'), (3, 1, 'crawl-delay', '90'), (3, 2, 'user-agent', '*'), (3, 2, 'disallow', '/')) l(form, grp, key, value) USING (form) WHERE http_status = 200""")


def _robots(spark, sf):
    s = ad.web_pages(spark, sf).select(urls.hostname(F.col("url")).alias("site")).distinct()
    n = F.length("site")
    body = F.coalesce(*[F.when(n % 4 == k, F.lit(v)) for k, v in _ROBOTS.items()])
    code = F.when(n % 7 == 0, 503).when(n % 11 == 0, 404).otherwise(200)
    return s.select("site", code.alias("http_status"), body.alias("body")).withColumn(
        "status", op.robots_status(F.col("http_status"), F.col("body")))


def _rules(spark, sf):
    files = _robots(spark, sf)
    packed = op.packed_rules(op.robots_lines(files.filter("status = 'read'")))
    return files.select("site", "status").join(packed, "site", "left")


@query("w7_robots_rules", "SELECT site, CAST(grp AS BIGINT) AS grp, key, value FROM v_lines")
def _(spark, sf):
    files = _robots(spark, sf).filter("status = 'read'")
    return op.robots_lines(files).select("site", "grp", "key", "value")


view("v_judged", f"""
SELECT l.page_id, l.link, l.page_url, form, http_status, {path('link')} AS p FROM v_page_links l JOIN v_sites s ON s.site = {_SITE.replace('url', 'l.link', 1)}""")
_ALLOWED = """CASE WHEN http_status <> 200 THEN true WHEN form = 0 THEN NOT starts_with(p, '/t') OR starts_with(p, '/the')
  WHEN form = 3 THEN NOT (p LIKE '%e' OR starts_with(p, '/z')) ELSE true END"""


def _judged(spark, sf):
    links = op.extract_links(_pages(spark, sf))
    d = op.with_site_rules(links, _rules(spark, sf)).withColumn("target", urls.target(F.col("link")))
    return d.withColumn("judged", op.decisions(F.col("sets"), F.col("target"))).drop("sets")


@query("w8_robots_decision", f"SELECT page_id, link, {_ALLOWED} AS allowed FROM v_judged")
def _(spark, sf):
    return _judged(spark, sf).select("page_id", "link", op.allows(F.col("agents"), F.col("judged"), "labbot").alias("allowed"))


_REFUSED = f"""CASE WHEN http_status = 503 THEN 'the site''s robots.txt could not be read (the site did not answer properly)'
  WHEN NOT ({_ALLOWED}) THEN 'the site''s robots.txt does not allow this lab''s agents to read it'
  WHEN http_status = 200 AND form = 1 AND starts_with(p, '/a') THEN 'the site''s robots.txt turns AI agents away from it (GPTBot, ClaudeBot)' ELSE '' END"""


def _refused(spark, sf):
    d = _judged(spark, sf)
    return d.withColumns({"refusal": op.refusal(F.col("status"), F.col("agents"), F.col("judged"), "labbot", F.lit("")),
                          "delay": op.crawl_delay(F.col("delays"), F.col("agents"), "labbot")})


@query("w9_refusals", f"SELECT page_id, link, {_REFUSED} AS refusal FROM v_judged")
def _(spark, sf):
    return _refused(spark, sf).select("page_id", "link", "refusal")


_DELAY = "CASE WHEN http_status = 200 AND form = 0 THEN 5.0 WHEN http_status = 200 AND form = 3 THEN 30.0 ELSE 2.0 END"


@query("w10_crawl_delay", f"SELECT site, CAST({_DELAY} AS DOUBLE) AS delay FROM v_sites")
def _(spark, sf):
    return _rules(spark, sf).select("site", op.crawl_delay(F.col("delays"), F.col("agents"), "labbot").alias("delay"))


@query("w6_crawl_plan", f"""
WITH j AS (SELECT *, {_REFUSED} = '' AS ok, {kind('link')} AS kind, CAST({_DELAY} AS DOUBLE) AS delay, starts_with(p, {folder('page_url')}) AS inside FROM v_judged)
SELECT page_id, count(*) AS found, count(*) FILTER (WHERE ok) AS allowed, count(*) FILTER (WHERE NOT ok) AS disallowed, count(*) FILTER (WHERE ok AND inside) AS in_folder,
  count(*) FILTER (WHERE ok AND kind IN ('page', 'pdf')) AS chosen, least(count(*) FILTER (WHERE ok AND kind IN ('page', 'pdf')), 6) AS take,
  count(*) FILTER (WHERE ok AND kind = 'pdf') AS pdf_allowed, count(*) FILTER (WHERE ok AND kind = 'page') AS page_allowed, count(*) FILTER (WHERE ok AND kind = 'text') AS text_allowed,
  greatest(1, CAST(round_even(least(count(*) FILTER (WHERE ok AND kind IN ('page', 'pdf')), 6) * (max(delay) + 3) / 60, 0) AS BIGINT)) AS minutes FROM j GROUP BY page_id""")
def _(spark, sf):
    links = _refused(spark, sf).withColumn("allowed", F.col("refusal") == "")
    return op.crawl_plan(links, ["page", "pdf"], max_pages=6).drop("delay", "limit", "ok")


@query("w11_tdm_reservation", f"""
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN '' WHEN p LIKE '/en/%' THEN 'the site reserves its text-and-data-mining rights for this page (/.well-known/tdmrep.json); its licensing terms are at https://x.org/p'
  WHEN p LIKE '/fr/%' THEN '' WHEN p LIKE '%.html' AND page_id % 2 = 0 THEN 'the site reserves its text-and-data-mining rights for this page (/.well-known/tdmrep.json)' ELSE '' END AS reservation
FROM (SELECT page_id, {path('url')} AS p FROM pages)""")
def _(spark, sf):
    rules = ('[{"location": "/en/*", "tdm-reservation": 1, "tdm-policy": "https://x.org/p"}, {"location": "fr/", "tdm-reservation": "0"}, '
             '{"other": 1}, {"location": "*.html$", "tdm-reservation": %s}]')
    i = F.col("page_id")
    file = F.when(i % 4 == 3, "not json").when(i % 2 == 0, rules % "1").otherwise(rules % "0")
    return ad.web_pages(spark, sf).select("page_id", op.tdm_reservation(file, urls.target(F.regexp_replace("url", r"[?#].*$", ""))).alias("reservation"))


@query("w12_page_opt_out", """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'the page says it is not for AI use (X-Robots-Tag: noai)' WHEN 1 THEN 'the page says it is not for AI use (X-Robots-Tag: noai)'
  WHEN 3 THEN 'the site reserves its text-and-data-mining rights for this page (tdm-reservation header)' WHEN 4 THEN 'the page says it is not for AI use (robots meta tag: noai)'
  WHEN 5 THEN 'the site reserves its text-and-data-mining rights for this page (tdm-reservation meta tag)' ELSE '' END AS refusal FROM pages""")
def _(spark, sf):
    i = F.col("page_id")

    def head(name, *values):
        return F.create_map(F.lit(name), F.array(*[F.lit(v) for v in values]))

    headers = (F.when(i % 8 == 0, head("x-robots-tag", "noindex", "NoAI, noarchive")).when(i % 8 == 1, head("x-robots-tag", "labbot: noai"))
               .when(i % 8 == 2, head("x-robots-tag", "otherbot: noai", "unavailable_after: noon")).when(i % 8 == 3, head("tdm-reservation", " 1 "))
               .when(i % 8 == 6, head("content-type", "application/pdf")).otherwise(head("content-type", "text/html")))
    meta = (F.when(i % 8 == 4, "<META name='robots' content=\"noindex, noai\">").when(i % 8 == 5, "<meta content=1 name=tdm-reservation>")
            .when(i % 8 == 7, "<meta name=\"other\" content=\"noai\">").otherwise(""))
    body = F.when(i % 8 == 6, F.lit("<meta name=robots content=noai>")).otherwise(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), meta)))
    return ad.web_pages(spark, sf).select("page_id", op.page_refusal(headers, body, "labbot").alias("refusal"))


@query("w13_keep_rights", f"""
SELECT page_id, page_id % 5 IN (0, 1, 2) AS allowed, CASE page_id % 5 WHEN 0 THEN 'a public filing on SEC EDGAR' WHEN 1 THEN 'a page on uscourts.gov, a listed US federal site'
  WHEN 2 THEN 'the page marks the open license CC BY-SA 4.0' ELSE 'its rights could not be confirmed (it is not from a public legal database or a listed federal site, and it marks no open license)' END AS reason,
  CASE WHEN page_id % 5 = 2 THEN 'https://creativecommons.org/licenses/by-sa/4.0/' ELSE '' END AS license_url FROM pages""")
def _(spark, sf):
    i = F.col("page_id")
    url = F.when(i % 5 == 1, F.concat(F.lit("https://www.Ca9.USCourts.gov/op/"), i)).when(i % 5 == 3, "https://notuscourts.gov/x").otherwise(F.col("url"))
    body = F.when(i % 5 == 2, F.concat("html", F.lit('<a class=x rel="license noopener" href="https://creativecommons.org/licenses/by-sa/4.0/">l</a>'))).when(
        i % 5 == 4, F.concat("html", F.lit('see <a href="https://creativecommons.org/licenses/by/4.0/">a licence</a>'))).otherwise(F.col("html"))
    ok, why, lic = op.keep_check(F.when(i % 5 == 0, "sec_edgar").otherwise("web"), url, body, F.lit("text/html"))
    return ad.web_pages(spark, sf).select("page_id", ok.alias("allowed"), why.alias("reason"), lic.alias("license_url"))


@query("w14_open_license", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://creativecommons.org/publicdomain/zero/1.0/' WHEN 1 THEN 'http://www.creativecommons.org/licenses/by/4.0/' ELSE '' END AS license,
  CASE page_id % 4 WHEN 0 THEN 'CC0 1.0' WHEN 1 THEN 'CC BY 4.0' ELSE '' END AS name FROM pages""")
def _(spark, sf):
    i = F.col("page_id")
    add = (F.when(i % 4 == 0, '<script>{"@type": "x", "license": "https://creativecommons.org/publicdomain/zero/1.0/"}</script>')
           .when(i % 4 == 1, "<link href=http://www.creativecommons.org/licenses/by/4.0/ rel=license>").otherwise("under creativecommons.org/licenses/by/4.0"))
    d = ad.web_pages(spark, sf).select("page_id", op.open_license(F.concat("html", add), F.when(i % 4 == 3, "text/plain").otherwise("")).alias("license"))
    return d.withColumn("name", op.license_name(F.col("license")))


_PASTED = "'See https://a' || (doc_id % 7) || '.example.org/p, www.b.org; c' || (doc_id % 5) || '.org/x. and (https://a' || (doc_id % 7) || '.example.org/p) '"


@query("w15_pasted_links", """
SELECT doc_id, pos, CASE pos WHEN 0 THEN 'https://a' || (doc_id % 7) || '.example.org/p' WHEN 1 THEN 'https://www.b.org' ELSE 'https://c' || (doc_id % 5) || '.org/x' END AS link
FROM documents, (SELECT unnest([0, 1, 2]) AS pos)""")
def _(spark, sf):
    d = ad.table(spark, sf, "documents")
    i = F.col("doc_id")
    pasted = F.concat(F.lit("See https://a"), i % 7, F.lit(".example.org/p, www.b.org; c"), i % 5, F.lit(".org/x. and (https://a"), i % 7,
                      F.lit(".example.org/p) "), F.col("text"))
    return d.select("doc_id", F.posexplode(op.parse_links(pasted)).alias("pos", "link"))


@query("w16_brief_addresses", """
SELECT doc_id, 'https://a.org/' || (doc_id % 3) || ',http://b.org/x' AS in_text, 'https://l.org/' || doc_id AS in_list FROM documents""")
def _(spark, sf):
    d = ad.table(spark, sf, "documents")
    brief = F.concat(F.lit("Read https://a.org/"), F.col("doc_id") % 3, F.lit("! Then (http://b.org/x), https://a.org/"), F.col("doc_id") % 3, F.lit(". "), "text")
    listed = F.array(F.concat(F.lit("  https://l.org/"), "doc_id"), F.lit("ftp://no"), F.concat(F.lit("https://l.org/"), "doc_id"))
    return d.select("doc_id", F.array_join(op.urls_in(brief), ",").alias("in_text"), F.array_join(op.clean_urls(listed), ",").alias("in_list"))


@query("w17_public_addresses", """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'That link points to a private or internal network address, which this server will not fetch.'
  WHEN 1 THEN 'Only web links that start with http:// or https:// can be read.' WHEN 2 THEN 'Links with a user name or password in them are not read.'
  WHEN 3 THEN 'That link has no website address in it.' WHEN 4 THEN 'That does not look like a web link.'
  WHEN 5 THEN 'That link points to a private or internal network address, which this server will not fetch.' ELSE '' END AS error FROM pages""")
def _(spark, sf):
    i = F.col("page_id")
    u = (F.when(i % 9 == 0, F.concat(F.lit("http://10.1.2."), i % 256, F.lit("/x"))).when(i % 9 == 1, "ftp://example.org/x")
         .when(i % 9 == 2, "https://user:pw@example.org/").when(i % 9 == 3, "https:///path").when(i % 9 == 4, "https://example.org:99999/")
         .when(i % 9 == 5, "http://[::1]/admin").when(i % 9 == 6, F.concat(F.lit("http://8.8.8."), i % 256, F.lit(":8080/")))
         .otherwise(F.col("url")))
    return ad.web_pages(spark, sf).select("page_id", op.public_url_error(u).alias("error"))


@query("w17_ipv6_addresses", """
SELECT page_id, page_id % 7 NOT IN (1, 3, 6) AS private FROM pages""")
def _(spark, sf):
    i = F.col("page_id")
    part = F.lower(F.hex(i % 65536))
    host = (F.when(i % 7 == 0, F.concat(F.lit("fd00::"), part)).when(i % 7 == 1, F.concat(F.lit("2606:4700::"), part, F.lit(":1")))
            .when(i % 7 == 2, F.concat(F.lit("::ffff:10.0.0."), i % 256)).when(i % 7 == 3, F.concat(F.lit("::ffff:8.8.8."), i % 256))
            .when(i % 7 == 4, F.concat(F.lit("2001:db8:"), part, F.lit("::"))).when(i % 7 == 5, F.concat(F.lit("fe80::"), part, F.lit("%25eth0")))
            .otherwise(F.concat(F.lit("2001:4:112:"), part, F.lit(":0:0:0:1"))))
    error = op.public_url_error(F.concat(F.lit("http://["), host, F.lit("]/x")))
    return ad.web_pages(spark, sf).select("page_id", F.contains(error, F.lit("private")).alias("private"))


view("v_crawls", """
SELECT crawl_id, 'src' || (crawl_id % 20) AS corpus, CASE crawl_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'finished' ELSE 'stopping' END AS status, crawl_id % 100 AS started_by,
  min(ts) AS created_at, CASE WHEN crawl_id % 3 = 1 THEN max(ts) END AS finished_at, count(*) AS done, count(*) + crawl_id % 17 AS total,
  CASE WHEN crawl_id % 2 = 0 THEN 7.0::DOUBLE END AS delay_s FROM v_crawl_results GROUP BY crawl_id""")


def _crawls(spark, sf):
    i = F.col("crawl_id")
    return ad.crawl_results(spark, sf).groupBy("crawl_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("done")).select(
        "crawl_id", F.concat(F.lit("src"), i % 20).alias("corpus"), F.when(i % 3 == 0, "running").when(i % 3 == 1, "finished").otherwise("stopping").alias("status"),
        (i % 100).alias("started_by"), "created_at", F.when(i % 3 == 1, F.col("last")).alias("finished_at"), "done", (F.col("done") + i % 17).alias("total"),
        F.when(i % 2 == 0, F.lit(7.0)).alias("delay_s"))


@query("w18_crawl_timing", """
SELECT c.crawl_id, date_diff('second', c.created_at, coalesce(c.finished_at, TIMESTAMP '2024-02-01')) AS elapsed_s,
  round_even(coalesce(avg(secs) FILTER (WHERE r.status <> 'exists'), coalesce(c.delay_s, 2.0) + 3), 1) AS pace_s,
  CASE WHEN c.status = 'finished' THEN 0 ELSE CAST(round_even((c.total - c.done) * coalesce(avg(secs) FILTER (WHERE r.status <> 'exists'), coalesce(c.delay_s, 2.0) + 3), 0) AS BIGINT) END AS eta_s,
  count(*) FILTER (WHERE r.status = 'added') AS added, count(*) FILTER (WHERE r.status = 'exists') AS exists, count(*) FILTER (WHERE r.status = 'error') AS error
FROM v_crawls c JOIN v_crawl_results r USING (crawl_id) GROUP BY c.crawl_id, c.created_at, c.finished_at, c.delay_s, c.status, c.total, c.done""")
def _(spark, sf):
    t = op.crawl_timing(_crawls(spark, sf), ad.crawl_results(spark, sf), F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'"))
    # Whole seconds between the two clock readings, as the comparison counts them.
    a, b = F.date_trunc("second", "created_at"), F.date_trunc("second", F.coalesce("finished_at", F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")))
    return t.select("crawl_id", F.timestamp_diff("SECOND", a, b).alias("elapsed_s"), "pace_s", "eta_s", "added", "exists", "error")


@query("w19_halted_crawls", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY position) AS n FROM v_crawl_results),
f AS (SELECT *, status = 'error' AND coalesce(lag(status) OVER w = 'error', false) AND coalesce(lag(status, 2) OVER w = 'error', false) AS third,
    status = 'error' AND http_status IN (429, 503) AS busy FROM n WINDOW w AS (PARTITION BY crawl_id ORDER BY position)),
s AS (SELECT crawl_id, min(n) AS stop_at FROM f WHERE third OR busy GROUP BY 1)
SELECT f.crawl_id, f.position, f.status, CASE WHEN s.stop_at IS NULL THEN 'finished' ELSE 'stopped' END AS outcome,
  (SELECT CASE WHEN x.busy THEN 'The site answered HTTP ' || x.http_status || ' (it is busy or asking crawlers to slow down), so the crawl stopped.'
     ELSE 'Three requests in a row got no answer or an error, so the crawl stopped.' END FROM f x WHERE x.crawl_id = s.crawl_id AND x.n = s.stop_at) AS message
FROM f LEFT JOIN s USING (crawl_id) WHERE s.stop_at IS NULL OR f.n <= s.stop_at""")
def _(spark, sf):
    return op.halted(ad.crawl_results(spark, sf)).select("crawl_id", "position", "status", "outcome", "message")


# A crawl of every document's link: some known, some failing, some refused.
view("v_crawl_links", """
SELECT doc_id // 30 AS crawl_id, doc_id % 30 AS position, source AS corpus, 'https://example.org/' || (doc_id + doc_id % 3) AS link,
  CASE doc_id % 19 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END AS http_status, CASE WHEN doc_id % 23 = 3 THEN 'the page says no' ELSE '' END AS refusal,
  CASE WHEN doc_id % 29 = 4 THEN ' ' WHEN doc_id % 6 = 5 THEN 'fresh text ' || (doc_id % 50) ELSE text END AS text FROM documents""")
view("v_outcomes", """
SELECT *, CASE WHEN known THEN 'exists' WHEN http_status >= 400 THEN 'error' WHEN refusal <> '' THEN 'refused' WHEN blank THEN 'unreadable' WHEN could AND k = 1 THEN 'added' ELSE 'exists' END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus, sha, could ORDER BY crawl_id, position) AS k FROM (
    SELECT *, NOT known AND http_status < 400 AND refusal = '' AND NOT blank AND NOT held AS could FROM (
      SELECT c.*, sha256(c.text) AS sha, trim(c.text) = '' AS blank, EXISTS (SELECT 1 FROM v_linked l WHERE l.live AND l.corpus = c.corpus AND l.link = c.link) AS known,
        EXISTS (SELECT 1 FROM v_live l WHERE l.corpus = c.corpus AND l.sha256 = sha256(c.text)) AS held FROM v_crawl_links c)))""")


def _crawl_links(spark, sf):
    d = ad.table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(F.floor(i / 30).alias("crawl_id"), (i % 30).alias("position"), F.col("source").alias("corpus"),
                    F.concat(F.lit("https://example.org/"), i + i % 3).alias("link"),
                    F.when(i % 19 == 0, 404).when(i % 19 == 1, 403).when(i % 19 == 2, 500).otherwise(200).alias("http_status"),
                    F.when(i % 23 == 3, "the page says no").otherwise("").alias("refusal"),
                    F.when(i % 29 == 4, " ").when(i % 6 == 5, F.concat(F.lit("fresh text "), i % 50)).otherwise(F.col("text")).alias("text"))


def _outcomes(spark, sf):
    from .library_queries import _linked
    return op.crawl_outcomes(_crawl_links(spark, sf), _linked(spark, sf).filter("live"))


@query("w20_crawl_outcomes", """
SELECT crawl_id, position, status, CASE WHEN known THEN 'Already in this library.'
  WHEN http_status = 403 THEN 'The website would not let this server read that page (it may need a login or subscription, or block automated readers). Copy the text and paste it instead.'
  WHEN http_status = 404 THEN 'That page was not found. Check the link.' WHEN http_status >= 400 THEN 'The website returned an error (HTTP ' || http_status || '). Try again later, or paste the text instead.'
  WHEN refusal <> '' THEN 'Not kept: the page says no.' WHEN blank THEN 'Downloaded, but it has no text.' WHEN status = 'added' THEN '' ELSE 'The same text is already in this library.' END AS detail FROM v_outcomes""")
def _(spark, sf):
    return _outcomes(spark, sf).select("crawl_id", "position", "status", "detail")


@query("w20_resumed_crawl", """
SELECT crawl_id, position FROM v_crawl_links c WHERE NOT EXISTS (SELECT 1 FROM v_outcomes o WHERE o.corpus = c.corpus AND o.link = c.link AND o.status IN ('added', 'exists'))""")
def _(spark, sf):
    return op.still_to_read(_crawl_links(spark, sf), _outcomes(spark, sf)).select("crawl_id", "position")


@query("w21_recent_crawls", """
SELECT c.crawl_id, c.corpus, c.status, c.done, coalesce(nullif(u.name, ''), u.email) AS started_by_name FROM (
  SELECT * FROM v_crawls ORDER BY created_at DESC, crawl_id DESC LIMIT 8) c LEFT JOIN v_users u ON u.user_id = c.started_by""")
def _(spark, sf):
    return op.recent_crawls(_crawls(spark, sf), ad.users(spark, sf)).select("crawl_id", "corpus", "status", "done", "started_by_name")


@query("w21_interrupted_crawls", """
SELECT crawl_id, 'interrupted' AS status, 'The server restarted while this crawl ran; what was read is kept.' AS message FROM v_crawls WHERE status IN ('running', 'stopping') AND crawl_id % 5 <> 0""")
def _(spark, sf):
    beats = _crawls(spark, sf).filter("crawl_id % 5 = 0").select("crawl_id")
    return op.interrupted(_crawls(spark, sf), beats).select("crawl_id", "status", "message")


# Reads of a run: each tool call names a search result or an address.
view("v_reads_of_runs", """
SELECT user_id AS run_id, event_id AS position, k, CASE WHEN event_id % 2 = 0 THEN ' [w' || (k % 5 + 1) || ']' ELSE 'https://s.example.org/' || (k % 5 + 1) END AS source,
  'https://s.example.org/' || (k % 5 + 1) AS key FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE event_type = 'click')""")


def _reads_of_runs(spark, sf):
    e = ad.run_events(spark, sf).filter("event_type = 'tool_call'")
    n = F.col("k") % 5 + 1
    return e.select("run_id", F.col("event_id").alias("position"), "k", F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit(" [w"), n, F.lit("]"))).otherwise(F.concat(F.lit("https://s.example.org/"), n)).alias("source"))


def _run_hits(spark, sf):
    runs = ad.run_events(spark, sf).select("run_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    address = F.concat(F.lit("https://s.example.org/"), "n")
    return runs.select("run_id", "n", F.when(F.col("n") % 2 == 0, address).alias("hit_url"), F.when(F.col("n") % 2 == 1, address).alias("hit_source"),
                       F.lit("ecfr").alias("provider"), F.col("n").cast("string").alias("ref"))


@query("w22_read_ledger", """
WITH r AS (SELECT run_id, key, count(*) AS times, min(position) AS position, arg_min(k, position) AS k FROM v_reads_of_runs GROUP BY 1, 2),
w AS (SELECT run_id, key, min(position) AS at FROM v_reads_of_runs WHERE k % 4 = 0 GROUP BY 1, 2)
SELECT r.run_id, r.key, r.times, r.position, 'Page ' || r.k AS title, coalesce(r.k % 3 <> 0 AND w.at + 1 > r.position, false) AS kept,
  CASE WHEN r.k % 3 <> 0 AND w.at + 1 > r.position THEN 'useful' ELSE '' END AS kept_because FROM r LEFT JOIN w USING (run_id, key)""")
def _(spark, sf):
    reads = _reads_of_runs(spark, sf).withColumns({
        "title": F.concat(F.lit("Page "), "k"), "fingerprint": F.sha2(F.col("k").cast("string"), 256), "keep_allowed": F.col("k") % 3 != 0,
        "keep_reason": F.lit("a listed site")}).drop("k")
    keeps = _reads_of_runs(spark, sf).filter("k % 4 = 0").select("run_id", (F.col("position") + 1).alias("position"), "source", F.lit(" useful ").alias("why"))
    return op.read_ledger(reads, _run_hits(spark, sf), keeps).select("run_id", "key", "times", "position", "title", "kept", "kept_because")


@query("w22_turned_away", """
SELECT run_id, key AS url, 'reason ' || arg_min(k, position) AS reason FROM v_reads_of_runs WHERE k % 3 = 0 GROUP BY 1, 2""")
def _(spark, sf):
    r = _reads_of_runs(spark, sf).filter("k % 3 = 0")
    return op.turned_away(r.select("run_id", F.concat(F.lit("https://s.example.org/"), F.col("k") % 5 + 1).alias("url"),
                                   F.concat(F.lit("reason "), "k").alias("reason"), "position"))
