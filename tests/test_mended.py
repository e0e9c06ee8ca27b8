"""Long texts, hostile patterns and many equal names."""

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import documents, names, web


def test_word_cap_on_very_long_texts(spark):
    df = spark.createDataFrame([(n, "  " + " \n".join(f"w{i}" for i in range(n))) for n in (3, 12_000, 13_000, 110_000)] + [(0, " \n "), (1, "")], "n int, t string")
    got = {r.n: r.x for r in df.select("n", tx.first_words(F.col("t"), 12_000).alias("x")).collect()}
    assert got[3] == "  w0 \nw1 \nw2" and got[0] == "" == got[1]
    for n in (12_000, 13_000, 110_000):
        assert got[n].split() == [f"w{i}" for i in range(min(n, 12_000))] and got[n].startswith("  w0 \nw1")


def test_patterns_that_hold_expression_marks(spark):
    rules = ["/x\\E(", "/a*b", "/q?(z", "/end$", "/[z", "/\\Qx", "/$5*"]
    df = spark.createDataFrame([(r, t) for r in rules for t in ("/x\\E(y", "/aXXb", "/q?(z1", "/end", "/end2", "/[z]", "/\\Qx", "/$5x")], "r string, t string")
    hits = {(r.r, r.t) for r in df.filter(F.rlike("t", web.pattern_regex(F.col("r")))).collect()}
    assert hits == {("/x\\E(", "/x\\E(y"), ("/a*b", "/aXXb"), ("/q?(z", "/q?(z1"), ("/end$", "/end"), ("/[z", "/[z]"), ("/\\Qx", "/\\Qx"), ("/$5*", "/$5x")}
    name = spark.createDataFrame([("A\\E(B", "so A\\E(B said")], "n string, t string")
    assert name.filter(F.rlike("t", names._whole(F.col("n")))).count() == 1


def _rule(slugs):
    used, out = set(), []
    for base in slugs:
        own, k = base, 2
        while own in used:
            own, k = f"{base}-{k}", k + 1
        used.add(own)
        out.append(own)
    return out


def test_ids_with_many_collisions(spark):
    for many in (8, 800):
        people = ["x", "x-2", "x-3", "y"] * many + ["x-2-2", "x-5", "x-07", "x"] * 3
        df = spark.createDataFrame([(1, i, n) for i, n in enumerate(people)], "cast_id int, seat int, name string")
        got = [r.agent_id for r in documents.assign_ids(df, ["cast_id"], ["seat"]).orderBy("seat").collect()]
        assert got == _rule(people)


def test_a_document_of_very_many_pages(spark):
    n = 20_000
    pages = spark.range(n).selectExpr("1 AS doc_id", "cast(id AS int) AS page", "concat('Page number ', id, ' holds enough readable words to be kept here.') AS text")
    row = documents.pages_to_documents(pages).first()
    starts, at = [], 0
    for i in range(n):
        starts.append(at)
        at += len(f"Page number {i} holds enough readable words to be kept here.") + 2
    assert row.pages_kept == n and [m.start for m in row.page_map] == starts and len(row.text) == at - 2


def test_starts_of_very_many_chunks(spark):
    df = spark.createDataFrame([(1, "\n\n".join("w" * 30 for _ in range(3000))), (2, ""), (3, "one")], "doc_id int, text string")
    rows = documents.chunk(df, 40, 5).orderBy("doc_id", "ordinal").collect()
    at = 0
    for r in rows:
        at = 0 if r.ordinal == 0 else at
        assert r.start == at
        at += len(r.content)
    assert len(rows) > 2000


def _given(spark, folder, name, rows, schema):
    from folioscope.plans import load
    from folioscope.plans.registry import QUERIES
    load()
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return QUERIES


def test_a_mean_that_ends_in_a_half_is_rounded_to_the_even_tenth(spark):
    from folioscope.operators import web
    secs = [12.97, 97.31, 75.9, 0.42]              # their mean is 46.65, as a sum of doubles 46.650000000000006
    crawls = spark.createDataFrame([(1, "running", 7.0, 14, 4), (2, "running", 7.0, 14, 4), (3, "stopping", None, 5, 4)],
                                   "crawl_id long, status string, delay_s double, total long, done long").withColumns({"created_at": F.timestamp_seconds(F.lit(0)), "finished_at": F.timestamp_seconds(F.lit(9))})
    results = spark.createDataFrame([(1, "added", x) for x in secs] + [(2, "error", x) for x in secs[::-1]] + [(3, "exists", 1.0)], "crawl_id long, status string, secs double")
    got = {r.crawl_id: (r.elapsed_s, r.pace_s, r.eta_s, r.estimated) for r in web.crawl_timing(crawls, results.coalesce(1), F.timestamp_seconds(F.lit(0))).collect()}
    assert got == {1: (9, 46.6, 466, True), 2: (9, 46.6, 466, True), 3: (9, 5.0, 5, False)}


def test_queries_take_closed_references_alone(spark, tmp_path):
    html = "<html><head><title>A &amp;&amp</title></head><body><article><h1>A</h1><p>One &amp; two &amp;&copy &lt;b&gt; &#x27; &amp</p></article></body></html>"
    queries = _given(spark, tmp_path, "pages", [(1, "http://a.example.org/x", html)], "page_id long, url string, html string")
    assert queries["t6_main_article"](spark, str(tmp_path)).first().text == "One & two &&copy <b> ' &amp"
    assert queries["t7_page_metadata"](spark, str(tmp_path)).first().title == "A &&amp"
    assert queries["t5_strip_markup"](spark, str(tmp_path)).first().text.endswith("One & two &&copy <b> ' &amp")


def test_interventions_of_runs_with_few_stalls_are_not_left_out(spark, tmp_path):
    rows = [(i, run, "error") for run in (0, 5) for i in range(run * 100, run * 100 + (9 if run else 30))]
    queries = _given(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string")
    got = {r.run_id for r in queries["m9_interventions_of_long_runs"](spark, str(tmp_path)).collect()}
    assert got == {0, 5}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_and_line_forms_are_computed_once(spark):
    from folioscope.sources import agents
    df = spark.range(1).select(F.col("id").cast("string").alias("said"))
    assert _plan(df.select(web.public_url_error(F.col("said")))).count("said#") < 40
    assert _plan(df.select(agents.line_form(F.col("said")).alias("f")).select("f.*")).count("said#") < 20
    assert _plan(df.select(agents.section_of(F.col("said")))).count("levenshtein(regexp") == 0


def test_pages_are_read_in_pieces(spark):
    from folioscope.functions import markup
    size = markup.AT_ONCE // 4
    pages = spark.createDataFrame([(i, "https://a.org/d/", f'<a href="p{i}.pdf">{"w" * (size * (1 + i % 7))}</a>' if i % 5 else None) for i in range(40)], "page_id long, url string, html string")
    links = web.read_links(pages)
    assert "MapInArrow" in _plan(links) and "ArrowEvalPython" not in _plan(links)
    got = {r.page_id: [(k.url, len(k.text)) for k in r.links] for r in links.collect()}
    assert got == {i: [(f"https://a.org/d/p{i}.pdf", size * (1 + i % 7))] if i % 5 else [] for i in range(40)}
    assert web.read_links(pages.limit(0)).count() == 0


def test_ids_of_people_are_given_out_without_their_texts(spark, monkeypatch):
    import os

    from folioscope import scale
    from folioscope.operators import documents
    from folioscope.sources import agents

    text = "# Dana Reyes\n## Goal\n\\# keep the house\n- and the car\n\n**Lee Park**\n## Role\nbuyer\n"
    files = spark.createDataFrame([("a.md", text), ("b.md", text), ("c.md", None), ("d.md", "")], "file string, text string")
    real, wrote = scale.pinned, []
    for module in (scale, documents):
        monkeypatch.setattr(module, "pinned", lambda df: wrote.append(set(df.columns)) or real(df))
    lines = agents.file_lines(files)
    folders = {f.rpartition("/")[0].removeprefix("file:").replace("//", "/") for f in lines.inputFiles()}
    assert folders and all(map(os.path.isdir, folders)) and {r.text for r in lines.collect()} >= {"\\# keep the house", "and the car"}
    cast = agents.agents(lines)
    people = agents.with_ids(cast)
    scale.released(cast)
    got = sorted((r.file, r.name, r.agent_id, r.goal, r.role) for r in people.collect())
    goal = "# keep the house\n- and the car"
    assert got == [("a.md", "Dana Reyes", "dana-reyes", goal, None), ("a.md", "Lee Park", "lee-park", None, "buyer"),
                   ("b.md", "Dana Reyes", "dana-reyes-2", goal, None), ("b.md", "Lee Park", "lee-park-2", None, "buyer")]
    assert wrote and not any("goal" in columns for columns in wrote) and not any(map(os.path.exists, folders))
