import pytest
from pyspark.sql import functions as F

from folioscope.operators import transcripts, web
from folioscope.plans import adapters as ad
from folioscope.schemas import TABLES
from folioscope.sources import agents as cast, files, providers as pv, records
from folioscope.streaming import streams as st

CAST = """<!-- notes -->
# Scenario
A dispute.

# Settings
Max turns: 1,000
Words per turn: 300

# Dana Reyes
Loose words.
## Objectiv
Win the case.
## Tendencies
- listens
  and waits
2. argues
## Leverage
much

**Lee Park**
## Role
buyer
## Case files
None
## Model
small
## Played by
A person.
"""


def test_cast_file(spark):
    d = spark.createDataFrame([("a.md", CAST), ("b.md", "# Scenario\nAnother.\n# Dana Reyes\n## Role\nx")], "file string, text string")
    lines = cast.file_lines(d)
    people = {(r.file, r.name): r for r in cast.with_ids(cast.agents(lines)).collect()}
    dana, lee, other = people["a.md", "Dana Reyes"], people["a.md", "Lee Park"], people["b.md", "Dana Reyes"]
    assert dana.goal == "Win the case." and dana.tendencies == ["listens and waits", "argues"] and dana.notes == "Leverage: much\n\nLoose words."
    assert (dana.agent_id, other.agent_id) == ("dana-reyes", "dana-reyes-2")
    assert lee.role == "buyer" and lee.libraries is None and lee.played_by == "person" and lee.model is None
    e = cast.experiment(lines).first()
    assert (e.file, e.scenario, e.max_turns, e.word_limit) == ("a.md", "A dispute.", 1000, 300)


def test_forms_of_lines(spark):
    lines = ["# Ann Lee", "#Ann", "#1 concern", "## Role ##", "###### x", "####### x", "**Goal**:", "__Goal__", "** **", "---", "* * *", "- a", "12) b", "-", "  ", "a: b", r"\# no head", "# "]
    got = spark.createDataFrame([(x,) for x in lines], "raw string").select("raw", cast.line_form(F.col("raw")).alias("f")).collect()
    assert {r.raw: (r.f.kind, r.f.text) for r in got} == {
        "# Ann Lee": ("person", "Ann Lee"), "#Ann": ("person", "Ann"), "#1 concern": ("plain", "#1 concern"), "## Role ##": ("section", "Role"), "###### x": ("section", "x"),
        "####### x": ("plain", "####### x"), "**Goal**:": ("bold", "Goal"), "__Goal__": ("bold", "Goal"), "** **": ("rule", ""), "---": ("rule", ""), "* * *": ("rule", ""),
        "- a": ("item", "a"), "12) b": ("item", "b"), "-": ("plain", "-"), "  ": ("blank", ""), "a: b": ("plain", "a: b"), r"\# no head": ("plain", r"\# no head"), "# ": ("person", "")}


def test_cast_file_paragraphs_and_labels(spark):
    text = ("before any name\n# Ann Lee\nRole: buyer\n**Objective:** two\nFree line.\n\nAnother: one\n## Background\n\nFirst.\nSecond.\n\n\n\n---\nThird \\# part.\n\\- no entry\n\n"
            "## Habits\nloose one\nloose two\n\n## Interests\n## What\nline a\nline b\n### Full promt\nx\n")
    people = cast.agents(cast.file_lines(spark.createDataFrame([("a.md", text)], "file string, text string"))).collect()
    (ann,) = people
    assert (ann.name, ann.role, ann.goal, ann.backstory) == ("Ann Lee", "buyer", "two", "First.\nSecond.\n\nThird \\# part.\n- no entry")
    assert ann.tendencies == ["loose one", "loose two"] and ann.priorities is None and ann.system_prompt is None
    assert ann.notes == "What:\nline a\nline b\n\nFull promt: x\n\nFree line.\nAnother: one"


def test_lead_opinion(spark):
    ops = [{"id": 1, "type": "040dissent", "ordering_key": 1}, {"id": None, "type": "010combined"}, {"id": 3, "type": None}, {"id": 2, "type": "lead-opinion"}]
    d = spark.createDataFrame([(ops,)], "o array<struct<id:bigint,type:string,ordering_key:int>>")
    assert d.select(pv.pick_lead(F.col("o"))["id"].alias("x")).first().x == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "a note.md").write_text("Hello.")
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 ok")
    (tmp_path / "same.txt").write_text("Hello.")
    (tmp_path / "blank.txt").write_text(" ")
    (tmp_path / "x.docx").write_bytes(b"PK")
    f = files.text_files(spark, str(tmp_path))
    f = f.withColumn("document_id", F.when(F.col("source_uri") == "a note.md", 1).otherwise(F.pmod(F.xxhash64("source_uri"), F.lit(1000003)) + 2)).withColumn("corpus", F.lit("L"))
    held = spark.createDataFrame([], "corpus string, sha256 string")
    got = {r.source_uri: (r.status, r.title, r.text) for r in files.ingest_split(f, held).collect()}
    assert got["a note.md"] == ("added", "a note", "Hello.") and got["same.txt"][0] == "refused" and got["blank.txt"][0] == "refused"
    assert got["bad.txt"][0] == "added" and got["bad.txt"][2] == "caf� ok" and got["x.docx"][0] == "unsupported"


def test_records_round_trip(spark, tmp_path):
    root = str(tmp_path)
    e = spark.createDataFrame([("r1", 1, "note", "2024-01-02 03:04:05")], "run_id string, seq int, event_type string, created_at string")
    records.append(e, "run_events", root)
    back = records.read(spark, "run_events", root)
    assert back.count() == 1 and str(back.first().day) == "2024-01-02"
    assert len(TABLES) >= 15 and all(t.schema().fieldNames() for t in TABLES.values())


def test_text_export(spark, tmp_path):
    entries = spark.createDataFrame([("L", n, f"t{n}", "") for n in range(1, 30)], "corpus string, n long, text string, url string")
    lines = records.citation_export(entries, ["corpus"], F.lit("Heading"))
    records.write_text(lines, ["corpus"], str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "corpus=L").glob("part-*"))
    got = "".join(p.read_text() for p in parts).splitlines()
    assert got == ["Heading", ""] + [f"{n}. t{n}" for n in range(1, 30)]


def parts_of(df, path, n, order):
    """`df` as n files that land one after another."""
    rows = df.orderBy(order).toPandas()
    for i in range(n):
        part = rows.iloc[i * len(rows) // n:(i + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return path


def test_streamed_halts_equal_the_batch_over_many_batches(spark, tmp_path):
    results = ad.crawl_results(spark, "/root/testdata/sf0.001").select("crawl_id", "position", "status", "http_status")
    src = parts_of(results, str(tmp_path / "in"), 4, "position")
    st.crawl_halts(st.landed(spark, src, results.schema, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "place")).awaitTermination()
    got = {r.crawl_id: r.position for r in st.every(spark, str(tmp_path / "out")).collect()}
    batch = web.halted(results).filter("outcome = 'stopped'").groupBy("crawl_id").agg(F.max("position").alias("p"))
    assert got == {r.crawl_id: r.p for r in batch.collect()} and got


def test_streamed_metrics_equal_the_batch_over_many_batches(spark, tmp_path):
    from folioscope.operators import trace
    events = ad.run_events(spark, "/root/testdata/sf0.001").drop("ts")
    src = parts_of(events, str(tmp_path / "in"), 3, "event_id")
    st.running_metrics(st.landed(spark, src, events.schema, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "place")).awaitTermination()
    got = st.latest(spark, str(tmp_path / "out"), ["run_id"])
    want = trace.run_metrics(events)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_streamed_documents_over_many_batches(spark, tmp_path):
    rows = [(i, "L", f"s{i % 5}", f"2024-01-01 00:00:{i:02d}") for i in range(20)] + [(20, "L", "held", "2024-01-01 00:01:00")]
    d = spark.createDataFrame(rows, "document_id long, corpus string, sha256 string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    src = parts_of(d, str(tmp_path / "in"), 3, "document_id")
    held = spark.createDataFrame([("L", "held")], "corpus string, sha256 string")
    held.write.parquet(str(tmp_path / "held"))
    held = spark.read.parquet(str(tmp_path / "held"))
    job = st.add_documents(st.landed(spark, src, d.schema, files_per_trigger=1), held, str(tmp_path / "out"), str(tmp_path / "place"))
    job.awaitTermination()
    out = st.every(spark, str(tmp_path / "out"))
    assert sorted(r.document_id for r in out.collect()) == [0, 1, 2, 3, 4]
    assert [p["numInputRows"] for p in job.recentProgress if p["numInputRows"]] == [7, 7, 7]      # its own files, nothing of earlier batches
    statuses = {r.document_id: r.status for r in st.add_statuses(d, out).collect()}
    assert statuses[20] == "duplicate" and sum(s == "added" for s in statuses.values()) == 5


def test_streamed_versions(spark, tmp_path):
    log = spark.createDataFrame([(1, "L", "A", "s1", "t", 1, "added", None), (2, "L", "B", "s2", "t", 2, "added", None), (1, "L", "A", "s1", "t", 3, "removed", None)],
                                "document_id long, corpus string, title string, sha256 string, created_at string, event_no long, action string, replaced_by long")
    src = parts_of(log, str(tmp_path / "in"), 2, "event_no")
    st.record_versions(st.landed(spark, src, log.schema, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "place")).awaitTermination()
    m = spark.read.parquet(str(tmp_path / "out" / "manifest"))
    assert sorted((r.version, r.documents) for r in m.collect()) == [(1, 1), (2, 1)]


def test_streamed_compaction_keeps_the_buffer_under_budget(spark, tmp_path):
    rows = [(1, "a", "user", i, "w" * 350) for i in range(12)]
    m = spark.createDataFrame(rows, "run_id long, agent_id string, role string, message_id long, content string")
    src = parts_of(m, str(tmp_path / "in"), 3, "message_id")
    st.compaction(st.landed(spark, src, m.schema, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "place"), budget=500).awaitTermination()
    folds = st.every(spark, str(tmp_path / "out")).orderBy("summary_no").collect()
    assert [f.messages for f in folds] == [3, 3, 3]
    plan = transcripts.compaction_plan(m.withColumn("archived", F.lit(False)), budget=500)
    assert plan.count() == 6
    held = [r.message_id for r in st.buffers(spark, str(tmp_path / "place")).orderBy("message_id").collect()]
    assert held == [9, 10, 11]


@pytest.fixture
def small_frames(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    yield
    spark.conf.set(name, before)


def folded(rows, budget, fraction=0.5):
    """The folds of one buffer, message by message."""
    buffer, out = [], []
    for i, role, text in sorted(rows):
        buffer.append((f"{role}: {text}", max(1, int(len(text) / 3.5))))
        if sum(t for _, t in buffer) > budget and len(buffer) >= 2:
            n = max(2, int(len(buffer) * fraction))
            out.append((n, "\n".join(line for line, _ in buffer[:n])))
            buffer = buffer[n:]
    return out


def test_streamed_compaction_of_one_key_with_most_rows(spark, tmp_path, small_frames):
    rows = [(1, "a", "user", (i * 7919) % 600, "w" * (i % 90)) for i in range(600)] + [(k, "b", "user", i, "x" * 40) for k in range(2, 6) for i in range(5)]
    m = spark.createDataFrame(rows, "run_id long, agent_id string, role string, message_id long, content string")
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    st.compaction(st.landed(spark, str(tmp_path / "in"), m.schema), str(tmp_path / "out"), str(tmp_path / "place"), budget=60).awaitTermination()
    out = st.every(spark, str(tmp_path / "out")).collect()
    for key in {(r[0], r[1]) for r in rows}:
        got = [(r.messages, r.excerpt) for r in sorted(out, key=lambda r: r.summary_no) if (r.run_id, r.agent_id) == key]
        assert got == folded([r[3:4] + (r[2], r[4]) for r in rows if (r[0], r[1]) == key], 60)
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(str(tmp_path / "place"))
    assert waiting.count() == 0


def test_streamed_cooldowns_and_halts_of_one_key_with_most_rows(spark, tmp_path, small_frames):
    from folioscope.operators import pacing
    r = spark.range(400).selectExpr("IF(id % 10 = 0, 'q', 'p') AS source", "id AS request_id", "pmod(id * 7919, 400) * 7.0D AS at_s", "id % 37 = 0 AS limited")
    r.repartition(2).write.parquet(str(tmp_path / "in"))
    st.cooldowns(st.landed(spark, str(tmp_path / "in"), r.schema), str(tmp_path / "out"), str(tmp_path / "place"), 30, 8).awaitTermination()
    got = st.every(spark, str(tmp_path / "out")).select("source", "request_id", "cooling", "too_soon")
    want = pacing.cooldowns(r, 30, 8).select("source", "request_id", "cooling", "too_soon")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    c = spark.range(300).selectExpr("id % 2 AS crawl_id", "pmod(id * 7919, 300) AS position", "IF(pmod(id * 7919, 300) IN (200, 201, 202, 204, 206, 208, 210), 'error', 'added') AS status", "500 AS http_status")
    c.write.parquet(str(tmp_path / "in2"))
    st.crawl_halts(st.landed(spark, str(tmp_path / "in2"), c.schema), str(tmp_path / "out2"), str(tmp_path / "place2")).awaitTermination()
    got = {r.crawl_id: r.position for r in st.every(spark, str(tmp_path / "out2")).collect()}
    want = {r.crawl_id: r.p for r in web.halted(c).filter("outcome = 'stopped'").groupBy("crawl_id").agg(F.max("position").alias("p")).collect()}
    assert got == want and got


def test_streamed_deadlines_over_batches(spark, tmp_path):
    at = lambda m: f"2024-01-01 {10 + m // 60}:{m % 60:02d}:00"      # noqa: E731
    rows = [(1, 1, at(0), "opened"), (1, 1, at(20), "replied"), (1, 2, at(30), "opened"), (2, 1, at(5), "opened"),          # run 1 answers, then keeps silent
            (2, 1, at(45), "replied"), (3, 1, at(50), "opened"), (3, 2, at(55), "opened"),                                    # late; opened twice
            (3, 2, at(84), "replied"), (4, 1, at(85), "opened")]                                                             # in time; open at the end
    d = spark.createDataFrame(rows, "run_id long, turn long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = parts_of(d, str(tmp_path / "in"), 3, "ts")
    st.turn_deadlines(st.landed(spark, src, d.schema, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "place"), 30).awaitTermination()
    got = sorted((r.run_id, r.turn, r.outcome) for r in st.every(spark, str(tmp_path / "out")).collect())
    assert got == [(1, 1, "answered"), (1, 2, "passed over"), (2, 1, "passed over"), (3, 1, "passed over"), (3, 2, "answered")]
    assert [(r.run_id, r.turn) for r in st.open_turns(spark, str(tmp_path / "place")).collect()] == [(4, 1)]


def test_sessions_closed_and_open(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-01 15:00:00")]
    e = spark.createDataFrame(rows, "run_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = parts_of(e, str(tmp_path / "in"), 2, "ts")
    st.sessions(st.landed(spark, src, e.schema, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "place")).awaitTermination()
    closed = sorted((r.run_id, r.events) for r in st.every(spark, str(tmp_path / "out")).collect())
    still = sorted((r.run_id, r.events) for r in st.open_sessions(spark, str(tmp_path / "place")).collect())
    assert closed == [(1, 1), (1, 2)] and still == [(2, 1)]


def test_streamed_queries_over_a_table_in_parts(spark, tmp_path):
    from folioscope.plans import load
    from folioscope.plans.registry import QUERIES
    load()
    talk = spark.createDataFrame([(c, t, "user", "w" * 350) for c in (1, 2) for t in range(24)], "conv_id long, turn long, role string, text string")
    talk.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    docs = spark.createDataFrame([(i, f"text {i % 8}", "en", "a", 6) for i in range(1, 30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    folds = QUERIES["x5_streamed_compaction"](spark, str(tmp_path)).collect()
    held = QUERIES["x5_buffers_held"](spark, str(tmp_path)).count()
    assert len(folds) > 0 and sum(f.messages for f in folds) + held == 48
    assert sum(r.documents for r in QUERIES["x9_versions_on_change"](spark, str(tmp_path)).collect()) == 25       # those removed and not put back are out
    # Held: 10 and 20, of texts 2 and 4; of the others' texts the first of each.
    added = sorted(r.document_id for r in QUERIES["x4_streamed_documents"](spark, str(tmp_path)).collect() if r.status == "added")
    assert added == [1, 3, 5, 6, 7, 8]


def test_the_first_to_arrive_is_added_in_any_order_of_reading(spark, tmp_path):
    rows = [(i, "L", f"s{i % 40}", f"2024-01-01 {9 - i // 40:02d}:00:00") for i in range(400)]
    d = spark.createDataFrame(rows, "document_id long, corpus string, sha256 string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    d.repartition(7).write.parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([], "corpus string, sha256 string")
    st.add_documents(st.landed(spark, str(tmp_path / "in"), d.schema), held, str(tmp_path / "out"), str(tmp_path / "place")).awaitTermination()
    assert sorted(r.document_id for r in st.every(spark, str(tmp_path / "out")).collect()) == list(range(360, 400))
