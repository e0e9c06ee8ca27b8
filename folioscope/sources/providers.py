"""Search and full-text payloads of legal sources, landed as JSON text, as hits and documents.

A hit is `provider, ref, title, snippet, url, date, badge, full_text, position`; a document
is `provider, ref, title, text, source_uri, doc_type, metadata` (a map of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..operators.documents import strip_markup, unescape

HIT = ("provider", "ref", "title", "snippet", "url", "date", "badge", "full_text", "position")
DOCUMENT = ("provider", "ref", "title", "text", "source_uri", "doc_type", "metadata")


def _or(*options: Column) -> Column:
    """The first that is neither null nor empty, else ""."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _results(payloads: DataFrame, schema: str, limit: int | None, keep: tuple[str, ...], path: str = "results") -> DataFrame:
    parsed = payloads.select(*keep, F.from_json("payload", schema).alias("p"))
    every = F.col(f"p.{path}")
    return parsed.select(*keep, F.posexplode(every if limit is None else F.slice(every, 1, limit)).alias("position", "r"))


def _hits(rows: DataFrame, keep: tuple[str, ...], provider: str, **columns: Column) -> DataFrame:
    defaults = {"provider": F.lit(provider), "full_text": F.lit(True), "position": F.col("position")}
    return rows.select(*keep, *[(columns.get(c) if c in columns else defaults[c]).alias(c) for c in HIT])


# ------------------------------------------------------------------ case law

# Words of an opinion's type, best standing first.
_STANDING = (("lead", "majority"), ("combined", "unanim", "unamim", "per curiam", "percuriam"), ("plurality",),
             ("merits", "trial", "addendum", "remittitur", "rehearing"), ("concur",), ("dissent",))


def opinion_rank(kind: Column) -> Column:
    """How well an opinion stands for its case: 0 is the court's own; untyped ranks 3."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    rank = None
    for n, names in enumerate(_STANDING):
        hit = F.lit(False)
        for w in names:
            hit = hit | k.contains(w)
        rank = F.when(hit, n) if rank is None else rank.when(hit, n)
    return rank.otherwise(3)


def pick_lead(opinions: Column) -> Column:
    """The opinion (struct with `id`, `type`, `ordering_key`) that stands for a case."""
    usable = F.filter(opinions, lambda o: o["id"].isNotNull())
    return F.array_min(F.transform(usable, lambda o, i: F.struct(
        opinion_rank(o["type"]).alias("rank"), F.coalesce(o["ordering_key"], F.lit(1_000_000)).alias("key"), i.alias("at"), o.alias("opinion"))))["opinion"]


_CASES = ("results array<struct<caseName:string,caseNameFull:string,absolute_url:string,dateFiled:string,court:string,"
          "court_citation_string:string,opinions:array<struct<id:bigint,type:string,ordering_key:int,snippet:string>>>>")


def case_law_hits(payloads: DataFrame, limit: int | None = None, keep: tuple[str, ...] = (), full_text: bool = False) -> DataFrame:
    """One hit per case, for its lead opinion."""
    r = _results(payloads, _CASES, limit, keep).withColumn("op", pick_lead(F.col("r.opinions"))).filter(F.col("op").isNotNull())
    ref = F.col("op.id").cast("string")
    return _hits(r, keep, "courtlistener", ref=ref, title=F.coalesce(
        F.nullif("r.caseName", F.lit("")), F.nullif("r.caseNameFull", F.lit("")), F.concat(F.lit("Opinion "), ref)),
        snippet=F.substring(strip_markup(F.coalesce("op.snippet", F.lit(""))), 1, 400),
        url=F.concat(F.lit("https://www.courtlistener.com"), F.coalesce("r.absolute_url", F.lit(""))), date=F.coalesce("r.dateFiled", F.lit("")),
        badge=_or(F.col("r.court_citation_string"), F.col("r.court")), full_text=F.lit(full_text))


_TEXTS = ("html_with_citations", "html", "html_lawbox", "html_columbia", "xml_harvard")


def opinion_text(row: str = "") -> Column:
    """The cleanest text an opinion carries; markup is stripped from all but the plain one."""
    marked = F.coalesce(*[F.nullif(F.col(row + c), F.lit("")) for c in _TEXTS], F.lit(""))
    return F.coalesce(F.nullif(F.col(row + "plain_text"), F.lit("")), strip_markup(marked))


def case_law_documents(requests: DataFrame, opinions: DataFrame, clusters: DataFrame) -> DataFrame:
    """The document of each requested opinion (`ref`, `hit_title`, `hit_date`, `hit_badge`,
    `hit_snippet`, `hit_url`). A separate writing, or one without text, gives way to the
    best-ranked sibling of its cluster that has text; with no text anywhere the search
    snippet stands in. A cluster holds a handful of opinions, listed by `position`."""
    ops = opinions.withColumns({"rank": opinion_rank(F.col("type")), "text": opinion_text(), "id": F.col("id").cast("string")})
    facts = F.struct("id", "type", "rank", "text", "absolute_url", "cluster_id")
    asked = requests.join(ops.select(F.col("id").alias("ref"), facts.alias("own")), "ref", "left")
    sibling = ops.filter("text <> ''").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "position", "id", facts.alias("op")))).alias("siblings"))
    j = asked.join(sibling, asked["own.cluster_id"] == sibling["cluster_id"], "left").drop("cluster_id")
    # Only a better-ranked sibling replaces an opinion that has text of its own.
    better = F.filter("siblings", lambda s: (s["id"] != F.col("ref")) & ((F.col("own.text") == "") | (s["rank"] < F.col("own.rank"))))
    separate = (F.col("own.rank") > 2) | (F.col("own.text") == "")
    used = F.when(separate, F.coalesce(F.try_element_at(better, F.lit(1))["op"], F.col("own"))).otherwise(F.col("own"))
    j = j.withColumn("op", used).join(clusters.select(F.col("cluster_id").alias("__c"), "case_name", "date_filed"), F.col("op.cluster_id") == F.col("__c"), "left")
    text = F.coalesce(F.nullif("op.text", F.lit("")), F.lit(""))
    has = text != ""
    title = F.coalesce(F.nullif("case_name", F.lit("")), F.nullif("hit_title", F.lit("")), F.concat(F.lit("CourtListener opinion "), "ref"))
    snippet_title = F.coalesce(F.nullif("hit_title", F.lit("")), F.concat(F.lit("CourtListener opinion "), "ref"))
    snippet = F.concat(snippet_title, F.lit("\n"), F.coalesce("hit_badge", F.lit("")), F.lit(" "), F.coalesce("hit_date", F.lit("")), F.lit("\n\n"), tx.strip(F.col("hit_snippet")))
    api = F.concat(F.lit("https://www.courtlistener.com/api/rest/v4/opinions/"), "ref", F.lit("/"))
    page = F.when(F.coalesce("op.absolute_url", F.lit("")) != "", F.concat(F.lit("https://www.courtlistener.com"), "op.absolute_url")).otherwise(api)
    used_id = F.coalesce("op.id", "ref")
    meta = F.map_from_entries(F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit("")).alias("value"))) for k, v, cond in (
        ("provider", F.lit("courtlistener"), F.lit(True)), ("opinion_id", F.when(has, used_id).otherwise(F.col("ref")), F.lit(True)),
        ("opinion_type", F.col("op.type"), has), ("date_filed", _or(F.when(has, F.col("date_filed")), F.col("hit_date")), F.lit(True)),
        ("requested_opinion_id", F.col("ref"), has & (used_id != F.col("ref"))), ("snippet_only", F.lit("true"), ~has), ("court", F.col("hit_badge"), ~has))])))
    got = has | (F.coalesce(tx.strip(F.col("hit_snippet")), F.lit("")) != "")
    return j.select(F.lit("courtlistener").alias("provider"), "ref", F.when(has, title).otherwise(snippet_title).alias("title"),
                    F.when(has, text).when(got, snippet).otherwise("").alias("text"),
                    F.when(has, page).otherwise(_or(F.col("hit_url"), api)).alias("source_uri"),
                    F.when(has, "opinion").otherwise("opinion_snippet").alias("doc_type"), meta.alias("metadata"))


# ------------------------------------------------------------------ rulemaking

_RULES = ("results array<struct<title:string,document_number:string,publication_date:string,html_url:string,abstract:string,"
          "type:string,agencies:array<struct<name:string>>>>")


def rulemaking_hits(payloads: DataFrame, limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    r = _results(payloads, _RULES, limit, keep)
    agencies = F.array_join(F.transform(F.slice(F.coalesce("r.agencies", F.expr("cast(array() as array<struct<name:string>>)")), 1, 2),
                                        lambda a: F.coalesce(a["name"], F.lit(""))), ", ")
    return _hits(r, keep, "federal_register", ref=F.col("r.document_number"), title=_or(F.col("r.title"), F.col("r.document_number")),
                 snippet=F.substring(F.coalesce("r.abstract", F.lit("")), 1, 400), url=F.coalesce("r.html_url", F.lit("")),
                 date=F.coalesce("r.publication_date", F.lit("")), badge=_or(F.col("r.type"), agencies))


def rulemaking_documents(rows: DataFrame) -> DataFrame:
    """Documents from landed records (`ref`, `title`, `abstract`, `html_url`, `publication_date`,
    `type`, `raw_text_url`, `raw_text`): the body of <pre> as it is, else stripped text, else
    the abstract."""
    raw = F.coalesce("raw_text", F.lit(""))
    pre = F.regexp_extract(raw, r"(?is)<pre>(.*?)</pre>", 1)
    body = F.when(raw.rlike("(?is)<pre>.*?</pre>"), unescape(pre)).otherwise(strip_markup(raw))
    text = F.when(tx.strip(body) != "", body).otherwise(F.coalesce("abstract", F.lit("")))
    none = F.coalesce("raw_text_url", F.lit("")) == ""
    meta = F.create_map(*[x for k, v in (("provider", F.lit("federal_register")), ("document_number", F.col("ref")), ("publication_date", F.col("publication_date")),
                                         ("type", F.col("type")), ("abstract_only", F.when(none, "true").otherwise("false"))) for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    return rows.select(F.lit("federal_register").alias("provider"), "ref", _or(F.col("title"), F.col("ref")).alias("title"), text.alias("text"),
                       _or(F.col("html_url"), F.concat(F.lit("https://www.federalregister.gov/api/v1/documents/"), "ref", F.lit(".json"))).alias("source_uri"),
                       F.lit("regulation").alias("doc_type"), meta.alias("metadata"))


# ------------------------------------------------------------------ code of regulations

_LEVELS = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "section")
_CODE = ("results array<struct<hierarchy:struct<" + ",".join(f"{k}:string" for k in _LEVELS) + ">,hierarchy_headings:struct<title:string,section:string>,"
         "headings:struct<section:string>,full_text_excerpt:string,starts_on:string>>")


def _present(h: str) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"{h}.{k}"), F.lit("")) != "", F.struct(F.lit(k).alias("key"), F.col(f"{h}.{k}").alias("value")))
                                     for k in _LEVELS]))


def code_citation(h: str, missing: str) -> Column:
    section = F.coalesce(F.col(f"{h}.section"), F.lit(""))
    return F.concat(F.coalesce(F.col(f"{h}.title"), F.lit("?")), F.lit(" CFR "), F.when(section != "", F.concat(F.lit("§ "), section)).otherwise(
        F.concat(F.lit("Part "), F.coalesce(F.col(f"{h}.part"), F.lit(missing)))))


def code_url(h: str) -> Column:
    section = F.coalesce(F.col(f"{h}.section"), F.lit(""))
    head = F.concat(F.lit("https://www.ecfr.gov/current/title-"), F.coalesce(F.col(f"{h}.title"), F.lit("")), F.lit("/"))
    rest = F.filter(_present(h), lambda e: e["key"] != "title")
    return F.concat(head, F.when(section != "", F.concat(F.lit("section-"), section)).otherwise(
        F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit("-"), e["value"])), "/")))


def code_hits(payloads: DataFrame, limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    r = _results(payloads, _CODE, limit, keep).withColumn("h", F.col("r.hierarchy"))
    heading = strip_markup(_or(F.col("r.headings.section"), F.col("r.hierarchy_headings.section")))
    return _hits(r, keep, "ecfr", ref=F.to_json(F.map_from_entries(_present("h"))), title=F.trim(F.concat(code_citation("h", "?"), F.lit(" "), heading)),
                 snippet=F.substring(strip_markup(F.coalesce("r.full_text_excerpt", F.lit(""))), 1, 400), url=code_url("h"),
                 date=F.coalesce("r.starts_on", F.lit("")), badge=F.trim(F.coalesce("r.hierarchy_headings.title", F.lit(""))))


def code_documents(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Documents from landed XML (`ref` as JSON of levels, `xml`) and the titles' latest issue
    dates (`number`, `latest_issue_date`). A title that is not published is an error."""
    d = rows.withColumn("h", F.from_json("ref", "struct<" + ",".join(f"{k}:string" for k in _LEVELS) + ">"))
    t = titles.select(F.col("number").cast("string").alias("__n"), F.col("latest_issue_date").alias("as_of"))
    d = d.join(t, F.col("h.title") == F.col("__n"), "left")
    heading = strip_markup(F.regexp_extract("xml", "(?s)<HEAD>(.*?)</HEAD>", 1))
    cite = code_citation("h", "")
    meta = F.create_map(F.lit("provider"), F.lit("ecfr"), F.lit("citation"), cite, F.lit("as_of"), F.coalesce("as_of", F.lit("")))
    error = F.when(F.col("h.title").isNull(), "eCFR reference is missing a title number").when(
        F.col("as_of").isNull(), F.concat(F.lit("eCFR does not publish a title "), "h.title"))
    return d.select(F.lit("ecfr").alias("provider"), "ref", _or(heading, cite).alias("title"), strip_markup(F.col("xml")).alias("text"),
                    code_url("h").alias("source_uri"), F.lit("regulation").alias("doc_type"), meta.alias("metadata"), error.alias("error"))


# ------------------------------------------------------------------ government publications

_PUBLICATIONS = "results array<struct<packageId:string,granuleId:string,title:string,summary:string,dateIssued:string,collectionCode:string>>"


def publication_hits(payloads: DataFrame, limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    r = _results(payloads, _PUBLICATIONS, limit, keep)
    pkg, gran = F.coalesce("r.packageId", F.lit("")), F.coalesce("r.granuleId", F.lit(""))
    ref = F.when(gran != "", F.concat(pkg, F.lit("/"), gran)).otherwise(pkg)
    return _hits(r, keep, "govinfo", ref=ref, title=_or(F.col("r.title"), pkg), snippet=F.substring(strip_markup(F.coalesce("r.summary", F.lit(""))), 1, 400),
                 url=F.concat(F.lit("https://www.govinfo.gov/app/details/"), ref), date=F.substring(F.coalesce("r.dateIssued", F.lit("")), 1, 10),
                 badge=F.coalesce("r.collectionCode", F.lit("")))


def publication_documents(rows: DataFrame) -> DataFrame:
    """Documents from landed summaries and bodies (`ref`, `title`, `collection`, `date_issued`,
    `htm`, `txt`): the page's text, else the plain file."""
    htm = F.coalesce("htm", F.lit(""))
    text = F.when(tx.strip(htm) != "", strip_markup(htm)).otherwise(F.coalesce("txt", F.lit("")))
    meta = F.create_map(F.lit("provider"), F.lit("govinfo"), F.lit("package_id"), F.split("ref", "/")[0], F.lit("granule_id"),
                        F.when(F.contains("ref", F.lit("/")), F.regexp_replace("ref", "^[^/]*/", "")).otherwise(""),
                        F.lit("collection"), F.coalesce("collection", F.lit("")), F.lit("date_issued"), F.coalesce("date_issued", F.lit("")))
    return rows.select(F.lit("govinfo").alias("provider"), "ref", _or(F.col("title"), F.col("ref")).alias("title"), text.alias("text"),
                       F.concat(F.lit("https://www.govinfo.gov/app/details/"), "ref").alias("source_uri"), F.lit("statute").alias("doc_type"), meta.alias("metadata"))


# ------------------------------------------------------------------ company filings

_FILINGS = ("hits struct<hits:array<struct<_id:string,_source:struct<display_names:array<string>,form:string,file_type:string,"
            "file_description:string,file_date:string,ciks:array<string>>>>>")


def filing_url(ref: Column, cik: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(cik, F.lit("0")), F.lit("/"),
                    F.replace(F.substring_index(ref, ":", 1), F.lit("-"), F.lit("")), F.lit("/"), F.regexp_replace(ref, "^[^:]*:?", ""))


def filing_hits(payloads: DataFrame, limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    r = _results(payloads, _FILINGS, limit, keep, "hits.hits").withColumn("s", F.col("r._source"))
    name = F.get("s.display_names", F.lit(0))
    form = _or(F.col("s.form"), F.col("s.file_type"))
    company = F.when(name.isNull(), "Unknown filer").otherwise(F.substring_index(name, "  (", 1))
    return _hits(r, keep, "sec_edgar", ref=F.col("r._id"), title=F.concat(company, F.lit(" — "), form), snippet=F.coalesce("s.file_description", F.lit("")),
                 url=filing_url(F.col("r._id"), F.coalesce(F.get("s.ciks", F.lit(0)), F.lit("0"))), date=F.coalesce("s.file_date", F.lit("")), badge=form)


def filing_documents(rows: DataFrame) -> DataFrame:
    """Documents from landed filings (`ref`, `cik`, `company`, `form`, `filed`, `body`)."""
    title = F.trim(F.concat(_or(F.col("company"), F.lit("SEC filing")), F.lit(" "), F.coalesce("form", F.lit("")), F.lit(" ("), F.coalesce("filed", F.lit("")), F.lit(")")))
    meta = F.create_map(*[x for k, v in (("provider", F.lit("sec_edgar")), ("accession", F.substring_index("ref", ":", 1)), ("cik", F.col("cik")),
                                         ("form", F.col("form")), ("filed", F.col("filed"))) for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    return rows.select(F.lit("sec_edgar").alias("provider"), "ref", title.alias("title"), strip_markup(F.col("body")).alias("text"),
                       filing_url(F.col("ref"), F.coalesce("cik", F.lit("0"))).alias("source_uri"), F.lit("filing").alias("doc_type"), meta.alias("metadata"))


def all_documents(*parts: DataFrame) -> DataFrame:
    """Documents of several providers as one table."""
    out = parts[0].select(*DOCUMENT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*DOCUMENT))
    return out
