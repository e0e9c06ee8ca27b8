from pyspark.sql import functions as F

from folioscope.operators import names, pacing, transcripts as op

TEXT = ("Gov. Alan Brook met Nora Finch from Cobalt Logistics at the Montana Supreme Court. Cobalt argued that Finch knew the true costs. "
        "Brook’s aide spoke. The Department of Environmental Quality listened near Green River. Mary Ann Smith left.")


def turns(spark, *rows):
    return spark.createDataFrame([(1, i, a, a.title(), c, q, s) for i, (a, c, q, s) in enumerate(rows, 1)],
                                 "run_id int, turn int, agent_id string, name string, content string, question_for string, suggested string")


def roster(spark, *ids):
    return spark.createDataFrame([(1, a, i) for i, a in enumerate(ids)], "run_id int, agent_id string, seat int")


def test_next_speaker_rules(spark):
    t = turns(spark, ("a", "x", "nobody", "a"), ("b", "x", "a", "c"), ("c", "x", "b", "b"), ("a", "x", "nobody", "c"), ("a", "x", "nobody", "a"),
              ("b", "x", "nobody", "b"), ("a", "x", "nobody", "a"))
    got = {r.turn: (r.speaker, r.rule) for r in op.next_speakers(roster(spark, "a", "b", "c"), t).collect()}
    assert got[1] == ("a", "moderator's choice")
    assert got[2] == ("c", "moderator's choice")                  # the one asked has just spoken
    assert got[4] == ("a", "round-robin (moderator's pick was unusable)")
    assert got[5] == ("b", "round-robin (moderator's pick was unusable)")
    assert got[7] == ("c", "balancing speaking time")


def test_speaking_counts_keep_zeros_and_scenes_need_two_turns_each(spark):
    t = turns(spark, ("a", "x", "", ""), ("b", "x", "", ""), ("a", "x", "", ""), ("b", "x", "", ""))
    assert {r.agent_id: r.turns for r in op.speaking_counts(roster(spark, "a", "b", "c"), t).collect()} == {"a": 2, "b": 2, "c": 0}
    assert [r.may_conclude for r in op.may_conclude(roster(spark, "a", "b"), t).orderBy("turn").collect()] == [False, False, False, True]
    left = {(r.reader, r.turn) for r in op.unanswered(roster(spark, "a", "c"), t).collect()}
    assert left == {("a", 4), ("c", 1), ("c", 2), ("c", 3), ("c", 4)}


def test_interventions_wait_for_every_agent_twice(spark):
    rows = [(1, t, 2) for t in (2, 4, 5, 9, 10, 12, 13, 30)] + [(2, t, 3) for t in range(1, 60)] + [(3, t, 1) for t in range(3, 10)]
    df = spark.createDataFrame(rows, "run_id int, turn int, agents int")
    got = sorted((r.run_id, r.turn, r.number, r.technique) for r in op.interventions(df).collect())
    assert [x[1] for x in got if x[0] == 1] == [4, 9, 13, 30] and [x[1] for x in got if x[0] == 2] == list(range(6, 60, 6)) and [x[1] for x in got if x[0] == 3] == [4, 8]
    assert [x[2:] for x in got if x[0] == 1] == [(1, 0), (2, 1), (3, 2), (4, 0)]


def test_segments_of_a_run(spark):
    words = [40, 900, 10, 10, 300, 2000, 5, 5, 5, 5, 700, 20]
    t = turns(spark, *[("a", "x" * w, "", "") for w in words])
    for limit in (150, 400):
        a = [r.segment for r in op.segments(t, limit, direct=0, keep_last=2).orderBy("turn").collect()]
        size, n, want = 0, 0, []
        for w in words[:-2]:
            cost = max(1, int(w / 3.5)) + 20
            if n == 0 or size + cost > limit:
                n, size = n + 1, 0
            size += cost
            want.append(n)
        assert a == want + [None, None]


def test_who_sees_what(spark):
    rec = spark.createDataFrame([(1, k, "a") for k in op.VISIBILITY], "run_id int, kind string, owner string")
    who = spark.createDataFrame([(1, "a", "speaker"), (1, "b", "speaker"), (1, "m", "moderator"), (1, "z", "assessor")], "run_id int, viewer string, part string")
    got = {(r.viewer, r.kind) for r in op.visible_records(rec, who).collect()}
    assert ("a", "bottom_line") in got and ("b", "bottom_line") not in got and ("m", "bottom_line") not in got and ("z", "bottom_line") in got
    assert ("b", "exhibit") in got and ("m", "exhibit") not in got and ("b", "case_file_passage") not in got


def test_name_candidates(spark):
    d = spark.createDataFrame([(TEXT,)], "t string")
    got = d.select(names.name_candidates(F.col("t")).alias("n")).first().n
    for n in ("Alan Brook", "Nora Finch", "Cobalt Logistics", "Cobalt", "Finch", "Brook", "Department of Environmental Quality", "Green River"):
        assert n in got, n
    assert "The" not in got and len(got) == len(set(got))
    core = {n: d.select(names.person_core(F.lit(n)).alias("c")).first().c for n in ("Gov. Alan Brook", "Public Instruction Ruth Ellison", "Mary Ann Smith", "Brook")}
    assert core == {"Gov. Alan Brook": "Alan Brook", "Public Instruction Ruth Ellison": "Ruth Ellison", "Mary Ann Smith": "Mary Ann Smith", "Brook": ""}


def test_substitutions(spark):
    src = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, "Nora Finch", "person", "Joan Ames"), (1, 1, "Cobalt", "company", "Vertex"), (1, 2, "Montana Supreme Court", "company", "Some Court"),
                                    (1, 3, "Environmental Quality", "company", "Fake Agency"), (1, 4, "Alan Brook", "person", "")],
                                   "doc_id long, pos int, label string, kind string, invented string")
    forced = spark.createDataFrame([(1, "Alan Brook")], "doc_id long, name string")
    pairs = names.substitutions(labels, src, forced)
    got = {r.real: (r.invented, r.full) for r in pairs.collect()}
    assert got["Nora Finch"] == ("Joan Ames", True) and got["Finch"] == ("Ames", False)
    assert got["Cobalt"] == ("Vertex", False) and got["Cobalt Logistics"] == ("Vertex Logistics", True)
    assert "Montana Supreme Court" not in got and "Environmental Quality" not in got
    made = got["Alan Brook"][0]
    assert len(made.split()) == 2 and got["Brook"][0] == made.split()[1]
    text = names.apply_substitutions(src, pairs).first().text
    assert "Finch" not in text and "Brook" not in text and "Vertex Logistics" in text and "Montana Supreme Court" in text and "true costs" in text
    assert {r.real for r in names.renamed_for_display(pairs).collect()} == {"Nora Finch", "Alan Brook", "Cobalt Logistics"}


def test_fallback_names_follow_the_digest(spark):
    import hashlib
    for real in ("Alan Brook", "Ann Lee"):
        h = int(hashlib.sha256(real.encode()).hexdigest(), 16)
        want = f"{names.FIRST_NAMES[h % 20]} {names.SURNAMES[(h // 97) % 20]}"
        assert spark.range(1).select(names.fallback_name(F.lit(real)).alias("x")).first().x == want


def test_cooldowns(spark):
    rows = [("p", 1, 0.0, True), ("p", 2, 100.0, False), ("p", 3, 180.0, False), ("p", 4, 180.5, True), ("q", 5, 1.0, False)]
    got = {r.request_id: (r.cooling, r.too_soon) for r in pacing.cooldowns(spark.createDataFrame(rows, "source string, request_id int, at_s double, limited boolean")).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, False), 4: (False, True), 5: (False, False)}
