import numpy as np
from pyspark.sql import functions as F

from folioscope.operators import citations as cit, retrieval as ret

PASSAGE = ("run_id int, n long, chunk_id long, document_id long, title string, content string, page_start int, page_end int, similarity double, "
           "kept boolean, corpus string, version int, url string, retrieved_at string, fingerprint string")


def numbers(spark, text, prefix=""):
    return spark.createDataFrame([(text,)], "t string").select(cit.cited_numbers(F.col("t"), prefix).alias("n")).first().n


def test_markers(spark):
    assert numbers(spark, "See [3] and [1, 3][2]; in [2024] and [x1] nothing.") == [3, 1, 2]
    assert numbers(spark, "[S2] then [S1, S2] but not [4]", "S") == [2, 1]
    assert numbers(spark, "none") == []


def test_links_are_grounded_or_unsupported(spark):
    passages = spark.createDataFrame([
        (1, 1, 10, 5, "Act", "text", 4, 6, 0.8, True, "Case law", 3, None, None, None),
        (1, 2, -1, 0, "Page", "words " * 400, None, None, 0.7, False, None, None, "https://e.org", "2024-05-06", "ff")], PASSAGE)
    texts = spark.createDataFrame([(1, "A [2] b [1] c [7]")], "run_id int, content string")
    a, b, c = cit.link_citations(texts, passages, ["run_id"]).orderBy("n").collect()
    assert (a.verdict, a.source_label, a.corpus, a.corpus_version) == ("grounded", "Act, pp. 4-6", "Case law", 3)
    assert (b.verdict, b.document_id, b.source_url, b.fingerprint) == ("grounded", None, "https://e.org", "ff")
    assert len(b.excerpt) <= 1502 and b.excerpt.endswith(" …")
    assert (c.verdict, c.quoted_text, c.source_label) == ("unsupported", "[7]", None)


def test_a_passage_keeps_its_number_over_searches(spark):
    found = spark.createDataFrame([(1, 1, 1, 50), (1, 1, 2, 40), (1, 2, 1, 40), (1, 2, 2, 60), (2, 1, 1, 60)], "run_id int, search int, rank int, chunk_id long")
    got = {(r.run_id, r.chunk_id): r.n for r in cit.number_passages(found, ["search", "rank"]).collect()}
    assert got == {(1, 50): 1, (1, 40): 2, (1, 60): 3, (2, 60): 1}


def test_result_markers(spark):
    texts = spark.createDataFrame([(1, "By [W2], [W1, W3] and [W9]. [W1, W2]")], "run_id int, content string")
    reads = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 2, 6), (1, 3, 5)], "run_id int, w int, n long")
    r = cit.resolve_result_markers(texts, reads, ["run_id"]).first()
    assert r.content == "By [6], [5] and [W9]. [5, 6]" and r.unread == [9]


def form(spark, title, uri, kind, meta):
    df = spark.createDataFrame([(title, uri, kind, meta)], "t string, u string, k string, m map<string,string>").withColumn("c", F.lit(None).cast("timestamp"))
    text, url = cit.citation(F.col("t"), F.col("u"), F.col("k"), F.col("m"), F.col("c"))
    return tuple(df.select(text.alias("x"), url.alias("y")).first())


def test_citation_forms(spark):
    assert form(spark, "Doe v. Roe", "https://c.org/1", "opinion", {"provider": "courtlistener", "court": "10th Cir.", "date_filed": "1994-11-18", "opinion_id": "7",
                                                                     "retrieved_at": "2026-09-12T10:00:00+00:00"}) == (
        "Doe v. Roe (10th Cir., November 18, 1994). CourtListener, opinion no. 7, retrieved September 12, 2026.", "https://c.org/1")
    assert form(spark, "§ 262.20 General requirements.", "https://e.gov", "regulation", {"provider": "ecfr", "citation": "40 CFR § 262.20"})[0] == (
        "40 CFR § 262.20 — General requirements. eCFR.")
    assert form(spark, "Notes", "notes.txt", "text", {}) == ("Notes. Uploaded file notes.txt.", "")
    assert form(spark, None, None, "other", {})[0] == "Untitled."


def test_exhibits_are_numbered_once_and_cited_only_after(spark):
    turns = spark.createDataFrame([(1, 1, "a", "Ann", "I rely on [S2] and [S9]. [E1]"), (1, 2, "b", "Bo", "[S1] again, and [E1] [E2]"), (1, 3, "a", "Ann", "[S1] [E2]")],
                                  "run_id int, turn int, agent_id string, name string, content string")
    src = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 2, 20), (1, 2, 1, 20), (1, 3, 1, 30)], "run_id int, turn int, rank int, chunk_id long").select(
        "*", F.lit("T").alias("title"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit("text").alias("content"),
        F.lit("L").alias("corpus"), F.lit(1).alias("version"), F.lit(True).alias("private"), F.lit(1).alias("document_id"), F.lit(0.5).alias("similarity"),
        F.lit(True).alias("kept"), *[F.lit("").alias(c) for c in ("url", "retrieved_at", "fingerprint")])
    ex = cit.disclosures(turns, src)
    assert [(r.marker, r.chunk_id, r.turn, r.from_marker) for r in ex.orderBy("n").collect()] == [("E1", 20, 1, "S2"), ("E2", 30, 3, "S1")]
    got = {(r.turn, r.n): r.verdict for r in cit.exhibit_citations(turns, ex).collect()}
    assert got == {(1, 1): "unsupported", (2, 1): "grounded", (2, 2): "unsupported", (3, 2): "unsupported"}


def vectors(spark, n=400, dim=8, seed=1, scopes=3):
    rng = np.random.default_rng(seed)
    return [(i, f"s{i % scopes}", [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]


def test_top_passages_against_brute_force_both_ways(spark):
    c, q = vectors(spark), vectors(spark, 12, seed=2)
    c[5] = (5, "s2", [0.0] * 8)
    cd = spark.createDataFrame(c, "chunk_id long, scope string, embedding array<float>").repartition(5)
    qd = spark.createDataFrame(q, "query_id long, scope string, embedding array<float>")
    want = {}
    for qi, qs, qv in q:
        sims = []
        for ci, cs, cv in c:
            a, b = np.array(qv, np.float32).astype(float), np.array(cv, np.float32).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            s = float(a @ b / norm) if norm else 0.0
            if cs == qs and s >= 0.1:
                sims.append((-round(s, 12), ci))
        want[qi] = [ci for _, ci in sorted(sims)[:5]]
    for shared in (1 << 20, 0):
        found = ret.top_passages(cd, qd, 5, 0.1, scope=F.col("scope"), query_scope=F.col("scope"), shared_bytes=shared)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_blocks_of_one_large_scope(spark, monkeypatch):
    monkeypatch.setattr(ret, "CELL_BYTES", 64 * 50)
    c, q = vectors(spark, 300, scopes=1), vectors(spark, 20, seed=5, scopes=1)
    cd = spark.createDataFrame(c, "chunk_id long, scope string, embedding array<float>")
    qd = spark.createDataFrame(q, "query_id long, scope string, embedding array<float>")
    one = ret.top_passages(cd, qd, 4, None).orderBy("query_id", "rank").collect()
    many = ret.top_passages(cd, qd, 4, None, shared_bytes=0).orderBy("query_id", "rank").collect()
    assert one == many and len(one) == 80


def test_repeated_text_is_found_once(spark):
    e = [[1.0, 0.0], [0.9, 0.1], [0.5, 0.5]]
    chunks = spark.createDataFrame([(1, 1, "A", "same", e[0]), (2, 2, "B", "same", e[1]), (3, 3, "B", "other", e[2])],
                                   "chunk_id long, document_id long, corpus string, content string, embedding array<float>")
    q = spark.createDataFrame([(1, 1, [1.0, 0.0])], "query_id long, run_id long, embedding array<float>")
    pins = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "B", 1), (1, 2, "Empty", None)], "run_id long, position int, corpus string, version int")
    members = spark.createDataFrame([("A", 1, 1), ("B", 1, 2), ("B", 1, 3)], "corpus string, version int, document_id long")
    got = ret.search_libraries(chunks, q, pins, members, 2, 0.1).orderBy("rank").collect()
    assert [(r.chunk_id, r.corpus, r.version) for r in got] == [(1, "A", 1), (3, "B", 1)]


def test_approximate_search_finds_most_of_the_best(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 16)) * 3
    c = [(i, [float(x) for x in centres[i % 20] + rng.standard_normal(16) * 0.3]) for i in range(600)]
    cd = spark.createDataFrame(c, "chunk_id long, embedding array<float>")
    qd = spark.createDataFrame(c[:20], "query_id long, embedding array<float>")
    exact = {(r.query_id, r.chunk_id) for r in ret.top_passages(cd, qd, 5, 0.3).collect()}
    near = {(r.query_id, r.chunk_id) for r in ret.approximate_top(cd, qd, 5, 0.3, probes=0.5, least_probes=1).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    whole = {(r.query_id, r.chunk_id) for r in ret.approximate_top(cd, qd, 5, 0.3, probes=1.0).collect()}
    assert whole == exact


def test_index_of_the_given_vectors(spark):
    """Mean recall against the exact search, and cells by the number of rows."""
    from folioscope.plans import adapters as ad
    sf = "/root/testdata/sf0.1"
    c, q = ad.chunks(spark, sf), ad.questions(spark, sf)
    centres = ret.fit_cells(c)
    assert len(centres) == c.count() // ret.INDEX_CELL and len(ret.fit_cells(c.limit(300))) == 2 and len(ret.fit_cells(c.limit(0))) == 1
    exact = {(r.query_id, r.chunk_id) for r in ret.top_passages(c, q, 6, 0.05).collect()}
    near = {(r.query_id, r.chunk_id) for r in ret.approximate_top(c, q, 6, 0.05, centres=centres).collect()}
    assert len(exact & near) / len(exact) >= 0.9
