"""Citation provenance: from markers in generated text to passages, documents, libraries
and versions, or to "unsupported"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..scale import best_per, join_known, with_position, with_running
from .retrieval import cite_label, library_label


def cited_numbers(text: Column, prefix: str = "") -> Column:
    """The numbers of [n], [n, m] or [<prefix>n] markers in order, each once; numbers of
    more than three digits are not markers."""
    groups = F.regexp_extract_all(text, F.lit(rf"(?U)\[({prefix}\d{{1,3}}(?:\s*,\s*{prefix}\d{{1,3}})*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return F.array_distinct(F.transform(parts, lambda p: F.regexp_replace(p, r"[^0-9]", "").cast("int")))


def cited_single(text: Column, count: Column, prefix: str = "S") -> Column:
    """The numbers of [S1] .. [S<count>] markers standing alone, in order, each once."""
    ns = F.transform(F.regexp_extract_all(text, F.lit(rf"\[{prefix}(\d+)\]"), F.lit(1)), lambda p: p.try_cast("int"))
    return F.array_distinct(F.filter(ns, lambda n: (n >= 1) & (n <= count)))


# ------------------------------------------------------------------ numbers of passages

def number_passages(found: DataFrame, order: list[str], run: str = "run_id", passage: str = "chunk_id") -> DataFrame:
    """Run-wide numbers: a passage gets the next one the first time a search returns it."""
    first = found.groupBy(run, passage).agg(F.min(F.struct(*order)).alias("__at"))
    return with_position(first, [run], ["__at", passage], "n").drop("__at")


def rekeyed(ledger: DataFrame, aliases: DataFrame) -> DataFrame:
    """The ledger with passages also under the ids they got when their page was kept
    (`run_id`, `old_id`, `new_id`): one number, both ids."""
    new = ledger.withColumnRenamed("chunk_id", "old_id").join(aliases, ["run_id", "old_id"])
    new = new.select("run_id", F.col("new_id").alias("chunk_id"), "n")
    known = ledger.select("run_id", "chunk_id")
    return ledger.select("run_id", "chunk_id", "n").unionByName(new.join(known, ["run_id", "chunk_id"], "left_anti"))


def passage_facts(found: DataFrame, order: list[str]) -> DataFrame:
    """One row per run and passage with the facts of its first return, and its number."""
    fields = ["document_id", "title", "content", "page_start", "page_end", "similarity", "kept", "corpus", "version",
              "url", "retrieved_at", "fingerprint"]
    facts = found.groupBy("run_id", "chunk_id").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("p"),
                                                   F.min(F.struct(*order)).alias("__at"))
    n = with_position(facts.select("run_id", "chunk_id", "__at"), ["run_id"], ["__at", "chunk_id"], "n").drop("__at")
    return facts.join(n, ["run_id", "chunk_id"]).select("run_id", "chunk_id", "n", "p.*")


def link_citations(texts: DataFrame, passages: DataFrame, keys: list[str], *, prefix: str = "",
                   text: str = "content", context: Column | None = None, number: str = "n") -> DataFrame:
    """One row per distinct marker of each text: the passage it names, or unsupported.
    `passages` has one row per (`keys`, number)."""
    where = context if context is not None else F.lit("")
    marks = texts.withColumn("context", where).withColumn(number, F.explode(F.sort_array(cited_numbers(F.col(text), prefix)))).drop(text)
    p = passages.select(*keys, F.col(number).cast("int").alias(number), F.struct(
        "chunk_id", "document_id", "title", "content", "page_start", "page_end", "similarity", "kept", "corpus", "version", "url",
        "retrieved_at", "fingerprint").alias("p"))
    j = marks.join(p, [*keys, number], "left")
    known, kept = F.col("p").isNotNull(), F.col("p.kept")
    online = known & ~kept
    return j.select(
        *[c for c in marks.columns], F.concat(F.lit(f"[{prefix}"), F.col(number).cast("string"), F.lit("]")).alias("quoted_text"),
        F.when(known, "grounded").otherwise("unsupported").alias("verdict"),
        F.when(known, cite_label(F.col("p.title"), F.col("p.page_start"), F.col("p.page_end"))).alias("source_label"),
        F.when(kept, F.col("p.chunk_id")).alias("chunk_id"), F.when(kept, F.col("p.document_id")).alias("document_id"),
        F.when(kept, F.col("p.corpus")).alias("corpus"), F.when(kept, F.col("p.version")).alias("corpus_version"),
        F.col("p.similarity").alias("similarity"), F.when(online, F.col("p.url")).alias("source_url"),
        F.when(online, F.col("p.retrieved_at")).alias("retrieved_at"), F.when(online, F.col("p.fingerprint")).alias("fingerprint"),
        F.when(online, tx.excerpt(F.col("p.content"))).alias("excerpt"))


def sources_handed_out(passages: DataFrame, cited: DataFrame) -> DataFrame:
    """Every passage a run was given, numbered, with whether its markers (`run_id`, `n`)
    cite it. One read online and not kept is stored by address, and quoted only if cited."""
    marks = cited.select("run_id", F.col("n").cast("long").alias("n"), F.lit(True).alias("__c")).distinct()
    j = passages.join(marks, ["run_id", "n"], "left").withColumn("cited", F.coalesce("__c", F.lit(False)))
    kept = F.col("kept")
    return j.select(
        "run_id", F.col("n").cast("string").alias("marker"), cite_label(F.col("title"), F.col("page_start"), F.col("page_end")).alias("label"),
        "corpus", "version", F.when(kept, F.col("document_id")).alias("document_id"), F.when(kept, F.col("chunk_id")).alias("chunk_id"),
        F.bround("similarity", 3).alias("similarity"), "cited", "kept", F.when(~kept, F.col("url")).alias("url"),
        F.when(~kept, F.col("retrieved_at")).alias("retrieved_at"), F.when(~kept, F.col("fingerprint")).alias("fingerprint"),
        F.when(~kept & F.col("cited"), tx.excerpt(F.col("content"))).alias("excerpt"))


# Fixed value: the form of an online citation marker.
_W_MARK = r"(?U)\[(W\d{1,3}(?:\s*,\s*W?\d{1,3})*)\]"


def resolve_result_markers(texts: DataFrame, reads: DataFrame, keys: list[str], run: str = "run_id", text: str = "content") -> DataFrame:
    """`text` with [W2], [W1, W3] turned into the first passage number read from each result
    (`reads`: run, `w`, `n`); a marker with any unread result stays, and `unread` lists those
    results. Only the numbers a text mentions are brought to it."""
    def numbers(mark):
        return F.transform(F.split(mark, ","), lambda x: F.regexp_replace(x, "[^0-9]", "").cast("int"))

    marked = texts.withColumn("__marks", F.transform(F.regexp_extract_all(F.col(text), F.lit(_W_MARK), F.lit(1)), numbers))
    asked = marked.select(*keys, run, F.explode(F.array_distinct(F.flatten("__marks"))).alias("w")) if run not in keys else \
        marked.select(*keys, F.explode(F.array_distinct(F.flatten("__marks"))).alias("w"))
    first = reads.groupBy(run, F.col("w").cast("int").alias("w")).agg(F.min("n").alias("n"))
    got = asked.join(first, [run, "w"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("__to"))
    j = marked.join(got, keys, "left")
    to = F.coalesce("__to", F.expr("cast(map() as map<int,bigint>)"))
    j = j.withColumn("__to", to)
    pieces = F.split(F.col(text), _W_MARK)
    raw = F.regexp_extract_all(F.col(text), F.lit(_W_MARK), F.lit(0))

    def swapped(ns, i):
        found = F.filter(F.transform(ns, lambda n: F.col("__to")[n]), lambda x: x.isNotNull())
        whole = (F.size(found) == F.size(ns)) & (F.size(ns) > 0)
        return F.when(whole, F.concat(F.lit("["), F.array_join(F.transform(F.array_distinct(found), lambda x: x.cast("string")), ", "),
                                      F.lit("]"))).otherwise(F.element_at(raw, i + 1))

    rebuilt = F.array_join(F.zip_with(pieces, F.transform("__marks", swapped),
                                      lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    unread = F.filter(F.flatten("__marks"), lambda n: F.col("__to")[n].isNull())
    return j.withColumns({text: rebuilt, "unread": unread}).drop("__marks", "__to")


def resolve_rows(citations: DataFrame, chunks: DataFrame, documents: DataFrame, run_libraries: DataFrame) -> DataFrame:
    """Citation rows with the document, library and version they point to; rows from before
    those were stored are resolved through their passage and the run's pins."""
    c = chunks.select("chunk_id", F.col("document_id").alias("__doc"))
    r = join_known(citations, c, ["chunk_id"], ["run_id", "position"]).withColumn("__doc", F.when(F.col("document_id").isNull(), F.col("__doc")))
    r = r.withColumn("doc_id", F.coalesce("document_id", "__doc"))
    d = documents.select(F.col("document_id").alias("__doc"), F.col("corpus").alias("__corpus"))
    r = join_known(r, d, ["__doc"], ["run_id", "position"]).withColumn("library", F.coalesce("corpus", "__corpus"))
    pins = run_libraries.select("run_id", F.col("corpus").alias("library"), F.col("version").alias("__pin"))
    return (join_known(r, pins, ["run_id", "library"], ["run_id", "position"])
            .withColumn("library_version", F.coalesce("corpus_version", "__pin")).drop("__doc", "__corpus", "__pin"))


# ------------------------------------------------------------------ references of a run

def references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A run's references in order of first citation, and every use of each. `rows` are
    resolved citation rows with a `position`. A page read online is a reference by address."""
    online = (F.col("verdict") == "grounded") & F.col("doc_id").isNull() & F.col("source_url").isNotNull()
    kept = (F.col("verdict") == "grounded") & F.col("doc_id").isNotNull()
    key = F.when(kept, F.concat(F.lit("d"), "doc_id")).when(online, F.concat(F.lit("u"), "source_url"))
    used = rows.withColumn("key", key).filter(F.col("key").isNotNull())
    refs = used.groupBy("run_id", "key").agg(
        F.min("position").alias("first"), F.count(F.lit(1)).alias("uses"), F.min_by(F.struct(
            "doc_id", "source_label", "source_url", "library", "library_version", "retrieved_at", "fingerprint"), "position").alias("r"))
    refs = with_position(refs, ["run_id"], ["first"], "n").select("run_id", "n", "key", "uses", "r.*").withColumn(
        "read_online", F.col("doc_id").isNull())
    refs = refs.withColumn("library_text", F.when(F.col("read_online"), "").otherwise(library_label(F.col("library"), F.col("library_version"))))
    uses = used.select("run_id", "key", "position", "quoted_text", "context", "source_label")
    return refs, uses


def unsupported(rows: DataFrame) -> DataFrame:
    return rows.filter("verdict = 'unsupported'").select("run_id", "position", "quoted_text", "context")


def references_by_library(refs: DataFrame) -> DataFrame:
    name = F.when(F.col("read_online"), "read online, not kept").when(F.col("library_text") != "", F.col("library_text")).otherwise("no library")
    return refs.groupBy("run_id", name.alias("library")).agg(F.count(F.lit(1)).alias("documents"))


def _joined_uses(uses: DataFrame, keys: list[str], piece: int = 1000) -> DataFrame:
    """All uses under a key as one line of text, put together in pieces so that no task
    holds more than a piece before the line itself."""
    said = tx.strip(F.concat("quoted_text", F.lit(" "), F.coalesce("context", F.lit(""))))
    numbered = with_position(uses.select(*keys, "position", said.alias("said")), keys, ["position"], "__k")
    parts = numbered.withColumn("__piece", F.floor((F.col("__k") - 1) / piece)).groupBy(*keys, "__piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "said"))), lambda x: x["said"]), "; ").alias("part"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("__piece", "part"))), lambda x: x["part"]), "; ").alias("cited"))


def reference_lines(refs: DataFrame, uses: DataFrame, missing: DataFrame) -> DataFrame:
    """The reference list as text lines (`run_id`, `section`, `n`, `line`), one entry a row,
    `text` and `url` of a reference taken from columns of those names."""
    cited = _joined_uses(uses, ["run_id", "key"])
    j = refs.join(cited, ["run_id", "key"])
    head = F.concat(F.col("n").cast("string"), F.lit(". "), "text", F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit(" "), "url")).otherwise(""))
    tail = F.when(F.col("read_online"), F.concat(
        F.lit("   Read online"), F.when(F.coalesce("retrieved_at", F.lit("")) != "", F.concat(F.lit(" on "), "retrieved_at")).otherwise(""),
        F.lit("; no copy kept (the page may have changed since). Cited: "), "cited", F.lit("."))).otherwise(F.concat(
            F.lit("   Searched in library "), F.when(F.col("library_text") != "", F.col("library_text")).otherwise("(unknown)"),
            F.lit(". Cited: "), "cited", F.lit(".")))
    lines = j.select("run_id", F.lit(1).alias("section"), "n", F.concat(head, F.lit("\n"), tail).alias("line"))
    rest = _joined_uses(missing, ["run_id"]).select(
        "run_id", F.lit(2).alias("section"), F.lit(1).cast("long").alias("n"),
        F.concat(F.lit("Markers that name no passage the model was given (unsupported):\n"), "cited").alias("line"))
    return lines.unionByName(rest)


# ------------------------------------------------------------------ citation forms

def _sentence(*parts: Column, sep: str = ", ") -> Column:
    tidy = F.filter(F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: F.regexp_replace(tx.strip(p), "[.,;]+$", "")),
                    lambda p: p != "")
    text = F.array_join(tidy, sep)
    return F.when(text == "", "").otherwise(F.concat(text, F.lit(".")))


def _paren(*parts: Column) -> Column:
    inner = F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), ", ")
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" ("), inner, F.lit(")")))


def citation(title: Column, source_uri: Column, doc_type: Column, metadata: Column, created_at: Column) -> tuple[Column, Column]:
    """A document's reference (text, url): what it is, then where it came from and when it
    was read. One form per provider; metadata is a map of text."""
    def m(key):
        return F.coalesce(metadata[key], F.lit(""))

    def have(value, text):
        return F.when(value != "", text).otherwise("")

    def dated(word, key):
        return have(m(key), F.concat(F.lit(f"{word} "), tx.long_date(m(key))))

    title = tx.squeeze(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")))
    address = F.coalesce(F.nullif(source_uri, F.lit("")), m("link"))
    url = F.when(address.startswith("http://") | address.startswith("https://"), address).otherwise("")
    when = F.coalesce(F.nullif(m("retrieved_at"), F.lit("")), F.date_format(created_at, "yyyy-MM-dd"), F.lit(""))
    read = have(when, F.concat(F.lit("retrieved "), tx.long_date(when)))
    provider = m("provider")
    heading = F.when(m("citation") != "", tx.strip(F.regexp_replace(title, r"(?U)^§+\s*[\w.-]+\s*", ""))).otherwise(title)
    plain = _sentence(title)
    what = (F.when(provider == "courtlistener", _sentence(F.concat(title, _paren(tx.strip(m("court")), tx.long_date(m("date_filed"))))))
            .when(provider == "ecfr", _sentence(F.array_join(F.filter(F.array(m("citation"), heading), lambda p: p != ""), " — ")))
            .otherwise(plain))
    upload = (F.coalesce(source_uri, F.lit("")) != "") & (url == "")
    where = (F.when(provider == "courtlistener", _sentence(
                F.lit("CourtListener"), have(m("opinion_id"), F.concat(F.lit("opinion no. "), m("opinion_id"))),
                F.when(m("snippet_only").isin("true", "True"), "search snippet only").otherwise(""), read))
             .when(provider == "ecfr", _sentence(F.lit("eCFR"), dated("current as of", "as_of"), read))
             .when(provider == "federal_register", _sentence(
                 F.concat(tx.strip(F.concat(F.lit("Federal Register document "), m("document_number"))),
                          _paren(m("type"), dated("published", "publication_date"))),
                 F.when(m("abstract_only").isin("true", "True"), "abstract only").otherwise(""), read))
             .when(provider == "govinfo", _sentence(
                 F.lit("govinfo"), m("collection"), dated("issued", "date_issued"),
                 have(m("package_id"), F.concat(F.lit("package "), m("package_id"))), read))
             .when(provider.isin("edgar", "sec_edgar"), _sentence(
                 F.lit("SEC EDGAR"), have(m("accession"), F.concat(F.lit("accession no. "), m("accession"))), read))
             .when(m("link") != "", _sentence(
                 F.coalesce(F.nullif(m("site"), F.lit("")), F.lit("Web page")), dated("published", "published"),
                 F.when(doc_type == "PDF", "PDF").otherwise(""), read))
             .when(upload, _sentence(F.concat(F.lit("Uploaded file "), source_uri), read))
             .otherwise(_sentence(F.concat(F.upper(F.substring(read, 1, 1)), F.substring(read, 2, 1000)))))
    return tx.strip(F.concat(what, F.lit(" "), where)), url


def citation_list(documents: DataFrame, by: list[str]) -> DataFrame:
    """Numbered references of each library or version, in order of their text."""
    text, url = citation(F.col("title"), F.col("source_uri"), F.col("doc_type"), F.col("metadata"), F.col("created_at"))
    d = documents.select(*by, "document_id", text.alias("text"), url.alias("url"))
    return with_position(d.withColumn("__lower", F.lower("text")), by, ["__lower", "document_id"], "n").drop("__lower")


def list_line(n: Column, text: Column, url: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(". "), text, F.when(url != "", F.concat(F.lit(" "), url)).otherwise(""))


def verdict_rollup(citations: DataFrame) -> DataFrame:
    def n(v):
        return F.count_if(F.col("verdict") == v)
    r = citations.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), n("grounded").alias("grounded"),
                                        n("unsupported").alias("unsupported"), n("unchecked").alias("unchecked"))
    return r.withColumn("grounded_rate", F.when(F.col("total") > 0, F.bround(F.col("grounded") / F.col("total"), 3)))


# ------------------------------------------------------------------ exhibits of a role-play

def disclosures(turns: DataFrame, sources: DataFrame) -> DataFrame:
    """Exhibits: each passage the first time a turn cites it ([S n] among that turn's
    sources), numbered E1, E2, ... per run in turn and cite order."""
    sizes = sources.groupBy("run_id", "turn").agg(F.max("rank").alias("__count"))
    t = turns.join(sizes, ["run_id", "turn"]).select("run_id", "turn", "agent_id", "name", F.posexplode(
        cited_single(F.col("content"), F.col("__count"))).alias("pos", "rank"))
    c = t.join(sources, ["run_id", "turn", "rank"])
    first = c.groupBy("run_id", "chunk_id").agg(F.min_by(
        F.struct("turn", "pos", "rank", "agent_id", "name", "title", "page_start", "page_end", "content", "corpus", "version",
                 "private", "document_id", "similarity", "kept", "url", "retrieved_at", "fingerprint"),
        F.struct("turn", "pos")).alias("x")).select("run_id", "chunk_id", "x.*")
    e = with_position(first, ["run_id"], ["turn", "pos"], "n")
    return e.withColumns({"marker": F.concat(F.lit("E"), "n"), "from_marker": F.concat(F.lit("S"), "rank"),
                          "label": cite_label(F.col("title"), F.col("page_start"), F.col("page_end")),
                          "content": tx.truncate_words(F.col("content"), 220)}).drop("pos", "rank")


def exhibit_citations(turns: DataFrame, exhibits: DataFrame) -> DataFrame:
    """[E n] markers of each turn: grounded when that exhibit was on record before the turn."""
    marks = turns.select("run_id", "turn", F.explode(F.sort_array(cited_numbers(F.col("content"), "E")).cast("array<bigint>")).alias("n"))
    e = exhibits.select("run_id", "n", F.col("turn").alias("__since"), "label", "chunk_id")
    j = marks.join(e, ["run_id", "n"], "left").withColumn("__on", F.col("__since") < F.col("turn"))
    on = F.coalesce("__on", F.lit(False))
    return j.select("run_id", "turn", "n", F.when(on, "grounded").otherwise("unsupported").alias("verdict"),
                    F.when(on, F.col("label")).alias("source_label"), F.when(on, F.col("chunk_id")).alias("chunk_id"))


def exhibit_entries(exhibits: DataFrame, in_full: int = 8, words: int = 160) -> DataFrame:
    """Each exhibit as listed to the speakers: the last `in_full` of a run with their text."""
    size = exhibits.groupBy("run_id").agg(F.max("n").alias("__last"))
    head = F.concat(F.lit("["), "marker", F.lit("] "), "label", F.lit(" (disclosed by "), "name", F.lit(" in turn "),
                    F.col("turn").cast("string"), F.when(F.col("private"), ", from their case file)").otherwise(")"))
    full = F.concat(head, F.lit("\n"), tx.truncate_words(F.col("content"), words))
    return exhibits.join(size, "run_id").select("run_id", "n", F.when(F.col("n") > F.col("__last") - in_full, full).otherwise(head).alias("entry"))


# ------------------------------------------------------------------ findings

# Fixed value: the heading of a finding.
_HEAD = r"(?m)^\[(\d+)\] (.+)$"


def passages_seen(results: DataFrame, keys: list[str], text: str = "content", limit: int = 120) -> DataFrame:
    """The passages tool results handed out, by number with their headings: the last
    `limit` numbers by first appearance for each of `keys`, in that order, and how many are `left_out` before them."""
    ns = F.regexp_extract_all(F.col(text), F.lit(_HEAD), F.lit(1))
    heads = F.regexp_extract_all(F.col(text), F.lit(_HEAD), F.lit(2))
    seen = results.select(*keys, "position", F.posexplode(F.arrays_zip(ns.alias("n"), heads.alias("heading"))).alias("at", "x"))
    one = seen.groupBy(*keys, F.col("x.n").cast("int").alias("n")).agg(
        F.min(F.struct("position", "at")).alias("first"),
        F.max_by(F.substring(tx.strip(F.col("x.heading")), 1, 200), F.struct("position", "at")).alias("heading"))
    totals = one.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("left_out"))
    return best_per(one, keys, [F.desc("first")], limit, "from_last").drop("first").join(totals, keys)


def cite_note(seen: DataFrame, keys: list[str], still_researching: Column) -> DataFrame:
    """What an agent whose report cites no passages is told (`note`), from its `passages_seen`: one line for each, newest last,
    after a line that counts those left out. A note has at most as many lines as passages are shown."""
    # The words of the note.
    begin = F.when(still_researching, "If you are still researching, continue with the tools. If you are done, give ").otherwise("Give ")
    ask = "your findings again, citing the passage numbers [n] that support each claim. Passages you have been given:\n"
    lines = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("from_last")).alias("at"), F.concat(F.lit("["), "n", F.lit("] "), "heading").alias("line")))).alias("lines"),
                                    F.max("left_out").alias("left_out"))
    more = F.when(F.col("left_out") > 0, F.concat(F.lit("("), F.col("left_out").cast("string"), F.lit(" earlier passages, not shown)\n"))).otherwise("")
    return lines.select(*keys, F.concat(begin, F.lit(ask), more, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("note"))


def without_citations(findings: DataFrame, text: str = "content") -> DataFrame:
    return findings.filter(F.size(cited_numbers(F.col(text))) == 0)


def cited_digest(cited: DataFrame, passages: DataFrame, limit_chars: int = 60_000) -> DataFrame:
    """The passages a run's findings cite (`run_id`, `n`), each cut to 700 characters, until
    `limit_chars`, then a line that counts the rest."""
    numbers = cited.select("run_id", F.col("n").cast("long").alias("n")).distinct()
    total = numbers.groupBy("run_id").agg(F.count(F.lit(1)).alias("numbers"))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), cite_label(F.col("title"), F.col("page_start"), F.col("page_end")),
                    F.lit(": "), F.substring(tx.squeeze(F.col("content")), 1, 700))
    lines = numbers.join(passages, ["run_id", "n"]).select("run_id", "n", line.alias("line"))
    run = with_running(lines, ["run_id"], ["n"], {"used": ("sum", F.length("line").cast("long"))})
    shown = run.filter(F.col("used") <= limit_chars).select("run_id", "n", "line")
    over = run.filter(F.col("used") > limit_chars).select("run_id").distinct()
    count = shown.groupBy("run_id").agg(F.count(F.lit(1)).alias("shown"))
    rest = over.join(total, "run_id").join(count, "run_id", "left").select("run_id", F.lit(1_000_000).cast("long").alias("n"), F.concat(
        F.lit("(and "), (F.col("numbers") - F.coalesce("shown", F.lit(0))).cast("string"), F.lit(" more passages, not shown for room)")).alias("line"))
    return shown.unionByName(rest)
