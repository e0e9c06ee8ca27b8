"""Transcripts, agents' memory and the cast of a role-play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..scale import best_per, pinned, with_position, with_running
from ..settings import DEFAULTS

MODERATOR = "moderator"


# ------------------------------------------------------------------ memory

def short_term(messages: DataFrame) -> DataFrame:
    """The messages of each (run, agent) still in its buffer, in order, with their tokens."""
    m = messages.filter(~F.coalesce("archived", F.lit(False))).withColumn("tokens", tx.estimate_tokens(F.col("content")))
    return with_position(m, ["run_id", "agent_id"], ["message_id"], "n")


def buffer_totals(messages: DataFrame) -> DataFrame:
    m = messages.filter(~F.coalesce("archived", F.lit(False)))
    return m.groupBy("run_id", "agent_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(tx.estimate_tokens(F.col("content"))).alias("tokens"))


def compaction_plan(messages: DataFrame, budget: int = DEFAULTS.short_term_token_budget,
                    fraction: float = DEFAULTS.compact_fraction) -> DataFrame:
    """The messages to fold into a summary where a buffer is over budget: the oldest half,
    two at least, as "role: text" lines in order."""
    over = buffer_totals(messages).filter((F.col("tokens") > budget) & (F.col("messages") >= 2))
    fold = over.select("run_id", "agent_id", F.greatest(F.lit(2), F.floor(F.col("messages") * fraction)).alias("fold"))
    numbered = short_term(messages).join(fold, ["run_id", "agent_id"])
    return numbered.filter(F.col("n") <= F.col("fold")).withColumn("line", F.concat("role", F.lit(": "), "content")).drop("fold", "tokens")


def archive(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """The messages with the planned ones out of the buffer."""
    gone = plan.select("run_id", "agent_id", "message_id", F.lit(True).alias("__gone"))
    return messages.join(gone, ["run_id", "agent_id", "message_id"], "left").withColumn(
        "archived", F.coalesce("archived", F.lit(False)) | F.coalesce("__gone", F.lit(False))).drop("__gone")


def long_term(memories: DataFrame) -> DataFrame:
    """The long-term memories of each (run, agent) in the order they were made, with the
    event or passage each came from."""
    m = memories.select("run_id", "agent_id", "memory_id", "kind", "content", "source_event_id", "source_chunk_id")
    return with_position(m, ["run_id", "agent_id"], ["memory_id"], "n")


def prompts(requests: DataFrame, recalled: DataFrame, buffer: DataFrame) -> DataFrame:
    """The messages of a prompt in order: system text with recalled memories (a few, by
    `rank`), the buffer, the new message. `requests` has `system_prompt` and `query`."""
    keys = ["run_id", "agent_id"]
    r = recalled.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))),
                                                             lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("memo"))
    j = requests.join(r, keys, "left")
    # How recalled memories are introduced.
    memo = F.when(F.col("memo").isNotNull(), F.concat(F.lit("Relevant memory from earlier in this matter:\n"), "memo"))
    system = F.array_join(F.array_compact(F.array(F.nullif("system_prompt", F.lit("")), memo)), "\n\n")
    head = j.select(*keys, F.lit(0).alias("section"), F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), system.alias("content")).filter("content <> ''")
    said = buffer.join(requests.select(*keys), keys, "left_semi").select(*keys, F.lit(1).alias("section"), F.col("message_id").cast("long").alias("at"), "role", "content")
    new = j.select(*keys, F.lit(2).alias("section"), F.lit(0).cast("long").alias("at"), F.lit("user").alias("role"), F.col("query").alias("content"))
    return with_position(head.unionByName(said).unionByName(new), keys, ["section", "at"], "n").drop("section", "at")


# ------------------------------------------------------------------ who spoke

def speaking_counts(roster: DataFrame, transcript: DataFrame) -> DataFrame:
    said = transcript.groupBy("run_id", "agent_id").agg(F.count(F.lit(1)).alias("turns"))
    return roster.join(said, ["run_id", "agent_id"], "left").withColumn("turns", F.coalesce("turns", F.lit(0)))


def speakers(roster: DataFrame, transcript: DataFrame, palette: int = 8) -> DataFrame:
    """Each speaker's turns, words, cited passages and disclosures, with a colour by seat;
    speakers outside the cast come after it in order of their first turn."""
    said = transcript.filter(F.col("agent_id") != MODERATOR).groupBy("run_id", "agent_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(tx.word_count(F.col("content"))).alias("words"), F.sum("cited").alias("cited"),
        F.sum("disclosed").alias("disclosed"), F.min("turn").alias("__first"), F.max_by("name", "turn").alias("__name"))
    j = roster.join(said, ["run_id", "agent_id"], "full")
    order = F.struct(F.coalesce("seat", F.lit(1_000_000)).alias("seat"), F.coalesce("__first", F.lit(0)).alias("first"), F.col("agent_id"))
    j = with_position(j.withColumn("__order", order), ["run_id"], ["__order"], "slot")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("turns", "words", "cited", "disclosed")}
    return j.withColumns({**zero, "color": (F.col("slot") - 1) % palette + 1, "speaker": F.coalesce("__name", "name", "agent_id")}).drop(
        "__order", "__first", "__name", "name")


def unanswered(roster: DataFrame, transcript: DataFrame) -> DataFrame:
    """For each agent, the entries after its own last turn. The cast of a run is a handful."""
    last = transcript.groupBy("run_id", "agent_id").agg(F.max("turn").alias("__last"))
    mine = roster.select("run_id", "agent_id").join(last, ["run_id", "agent_id"], "left").select(
        "run_id", F.col("agent_id").alias("reader"), F.coalesce("__last", F.lit(-1)).alias("__last"))
    return transcript.join(mine, "run_id").filter(F.col("turn") > F.col("__last")).drop("__last")


def _standing(roster: DataFrame, transcript: DataFrame, inclusive: bool) -> DataFrame:
    """Per turn, how often each of the cast had spoken (before it, or with it), as an array
    by seat, and who spoke last. Rows are turn by seat, keyed by agent for the running count."""
    seats = roster.select("run_id", F.col("agent_id").alias("seat_of"), "seat")
    grid = transcript.select("run_id", "turn", "agent_id").join(seats, "run_id")
    spoke = F.when(F.col("agent_id") == F.col("seat_of"), 1).otherwise(0)
    last = F.when(F.col("agent_id") != MODERATOR, F.struct("turn", "agent_id"))
    run = with_running(grid, ["run_id", "seat_of"], ["turn"], {"spoken": ("sum", spoke), "last": ("max", last)}, inclusive=inclusive)
    return run.groupBy("run_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("seat", F.col("seat_of").alias("id"), "spoken"))).alias("cast"),
        F.max(F.col("last.agent_id")).alias("previous"))


def next_speakers(roster: DataFrame, transcript: DataFrame) -> DataFrame:
    """Who should have spoken at each turn and by which rule: an asked question is answered;
    a pick that cannot stand goes to the quietest, as does one two turns ahead of it; else
    the moderator's pick. `transcript` has `question_for` and `suggested`."""
    s = _standing(roster, transcript, inclusive=False).join(
        transcript.select("run_id", "turn", "question_for", "suggested"), ["run_id", "turn"])
    ids = F.transform("cast", lambda c: c["id"])
    others = F.filter("cast", lambda c: F.col("previous").isNull() | (c["id"] != F.col("previous")))
    s = s.withColumn("others", F.when(F.size(others) > 0, others).otherwise(F.col("cast")))
    s = s.withColumn("before", F.array_position(ids, F.coalesce("previous", F.lit(""))))
    distance = lambda c: F.when(F.col("before") == 0, F.array_position(ids, c["id"]) - 1).otherwise(
        F.pmod(F.array_position(ids, c["id"]) - F.col("before"), F.size("cast")))
    quietest = F.array_min(F.transform("others", lambda c: F.struct(
        c["spoken"].alias("n"), distance(c).alias("d"), c["id"].alias("id"))))
    s = s.withColumn("quietest", quietest["id"])
    fewest = F.array_min(F.transform("others", lambda c: c["spoken"]))
    other_ids = F.transform("others", lambda c: c["id"])
    picked = F.try_element_at(F.filter("others", lambda c: c["id"] == F.col("suggested")), F.lit(1))["spoken"]
    asked = F.coalesce(F.array_contains(ids, F.col("question_for")) & ~F.coalesce(F.col("question_for") == F.col("previous"), F.lit(False)), F.lit(False))
    usable = F.coalesce(F.array_contains(other_ids, F.col("suggested")), F.lit(False))
    ahead = picked - fewest >= 2
    # The rules by name.
    return s.select("run_id", "turn", F.when(asked, F.col("question_for")).when(~usable | ahead, F.col("quietest")).otherwise(F.col("suggested")).alias("speaker"),
                    F.when(asked, "answering a direct question").when(~usable, "round-robin (moderator's pick was unusable)")
                    .when(ahead, "balancing speaking time").otherwise("moderator's choice").alias("rule"))


def may_conclude(roster: DataFrame, transcript: DataFrame) -> DataFrame:
    """Whether, with each turn, everyone has spoken at least twice."""
    s = _standing(roster, transcript, inclusive=True)
    return s.select("run_id", "turn", (F.array_min(F.transform("cast", lambda c: c["spoken"])) >= 2).alias("may_conclude"))


# ------------------------------------------------------------------ greedy choices along a run

def _chosen_from(first: DataFrame, jumps: DataFrame) -> DataFrame:
    """All steps reached from the first of each run by following `jumps` (`run_id`, `i`,
    `j`). Jumps double in length each round, so a chain of n steps takes log2(n) rounds of
    joins on (run, step), which no single run can make lopsided."""
    reached = pinned(first.select("run_id", "i"))
    jumps = pinned(jumps.filter("j is not null"))
    while True:
        more = reached.join(jumps, ["run_id", "i"]).select("run_id", F.col("j").alias("i"))
        further = jumps.alias("a").join(jumps.alias("b"), (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.j") == F.col("b.i"))) \
            .select(F.col("a.run_id").alias("run_id"), F.col("a.i").alias("i"), F.col("b.j").alias("j"))
        reached, jumps = pinned(reached.unionByName(more).distinct()), pinned(further)
        if jumps.isEmpty():
            return reached


def _first_at_or_after(points: DataFrame, wants: DataFrame, strictly: bool) -> DataFrame:
    """For each want (`run_id`, `i`, `at`), the smallest point `j` (`run_id`, `at`, `j`) whose
    `at` is not below (or is above) it. Points rise with `j`."""
    point_side, want_side = (0, 1) if not strictly else (1, 0)
    both = points.select("run_id", "at", F.lit(point_side).alias("side"), "j", F.lit(None).cast("long").alias("i")).unionByName(
        wants.select("run_id", "at", F.lit(want_side).alias("side"), F.lit(None).cast("long").alias("j"), "i"))
    seen = with_running(both.withColumn("__id", F.coalesce("i", "j")), ["run_id"], [F.desc("at"), "side", F.desc("__id")], {"next": ("min", F.col("j"))})
    return seen.filter("i is not null").select("run_id", "i", F.col("next").alias("j"))


def intervention_gap(agents: Column) -> Column:
    """The turns between two interventions: room for each of the agents to answer twice, four at least."""
    return F.greatest(F.lit(4), 2 * agents)


def interventions(stalls: DataFrame) -> DataFrame:
    """The stalls (`run_id`, `turn`, `agents`, how many take part) a moderator steps in at: each at least the
    gap after the last, counted from turn 0, with the number of the intervention and its
    technique (they rotate by three). The first stall after each gap is found by a running minimum, and the chosen ones by jumps."""
    many = stalls.withColumn("gap", intervention_gap(F.col("agents")))
    turn = F.col("turn").cast("long")
    points = many.select("run_id", turn.alias("at"), turn.alias("j"))
    wants = many.select("run_id", turn.alias("i"), (F.col("turn") + F.col("gap")).cast("long").alias("at"))
    first = many.filter(F.col("turn") >= F.col("gap")).groupBy("run_id").agg(F.min("turn").cast("long").alias("i"))
    chosen = _chosen_from(first, _first_at_or_after(points, wants, False)).withColumnRenamed("i", "turn")
    n = with_position(chosen, ["run_id"], ["turn"], "number")
    return n.withColumn("technique", ((F.col("number") - 1) % 3).cast("int"))


def segments(transcript: DataFrame, max_tokens: int, direct: int = 60_000, keep_last: int = 6) -> DataFrame:
    """Each entry with the segment it is summarised in: consecutive runs of entries whose
    cost (tokens + 20) stays under `max_tokens`. Runs of at most `direct` tokens are given
    whole (segment null), as are the last `keep_last` entries of any run."""
    cost = transcript.withColumn("cost", (tx.estimate_tokens(F.col("content")) + 20).cast("long"))
    totals = cost.groupBy("run_id").agg(F.sum(F.col("cost") - 20).alias("__tokens"), F.count(F.lit(1)).alias("__entries"))
    numbered = pinned(with_position(cost.join(totals, "run_id"), ["run_id"], ["turn"], "i"))
    cut = numbered.filter((F.col("__tokens") > direct) & (F.col("i") <= F.col("__entries") - keep_last))
    p = with_running(cut.select("run_id", "i", "cost"), ["run_id"], ["i"], {"upto": ("sum", F.col("cost"))})
    # An entry opens a segment when the sum since the last opening passes the limit.
    points = p.select("run_id", F.col("upto").alias("at"), F.col("i").alias("j"))
    wants = p.select("run_id", "i", (F.col("upto") - F.col("cost") + max_tokens).alias("at"))
    jumps = _first_at_or_after(points, wants, True)
    # An entry dearer than the limit stands alone: the next opens after it.
    jumps = jumps.filter("j is not null").withColumn("j", F.greatest("j", F.col("i") + 1)).join(p.select("run_id", F.col("i").alias("j")), ["run_id", "j"], "left_semi").select("run_id", "i", "j")
    starts = _chosen_from(p.filter("i = 1").select("run_id", "i"), jumps)
    opened = starts.withColumn("__open", F.lit(1))
    marked = numbered.join(opened, ["run_id", "i"], "left")
    run = with_running(marked, ["run_id"], ["i"], {"segment": ("sum", F.coalesce("__open", F.lit(0)))})
    inside = (F.col("__tokens") > direct) & (F.col("i") <= F.col("__entries") - keep_last)
    return run.withColumn("segment", F.when(inside, F.col("segment"))).drop("__open", "__tokens", "__entries", "i")


def over_length(transcript: DataFrame, limit: int) -> DataFrame:
    words = transcript.withColumn("words", tx.word_count(F.col("content")))
    return words.filter(F.col("words") > limit * 1.15)


def rendered(transcript: DataFrame, max_words: int | None = None) -> DataFrame:
    """Each entry as one line of a transcript."""
    said = tx.truncate_words(F.col("content"), max_words) if max_words else F.col("content")
    line = F.when(F.col("agent_id") == MODERATOR, F.concat(F.lit("[moderator, after turn "), F.col("turn").cast("string"), F.lit("] "), said)).otherwise(
        F.concat(F.lit("[turn "), F.col("turn").cast("string"), F.lit("] "), "name", F.lit(": "), said))
    return transcript.withColumn("line", line)


# ------------------------------------------------------------------ who may see what

# Who sees each kind of record. "own" is the person it belongs to.
VISIBILITY = {
    "scenario": {"speaker": "all", "moderator": "all", "assessor": "all"},
    "transcript": {"speaker": "all", "moderator": "all", "assessor": "all"},
    "profile": {"speaker": "all", "moderator": "all", "assessor": "none"},
    "background": {"speaker": "own", "moderator": "none", "assessor": "none"},
    "bottom_line": {"speaker": "own", "moderator": "none", "assessor": "all"},
    "confidential": {"speaker": "own", "moderator": "none", "assessor": "all"},
    "private_notes": {"speaker": "own", "moderator": "none", "assessor": "none"},
    "case_file_passage": {"speaker": "own", "moderator": "none", "assessor": "all"},
    "exhibit": {"speaker": "all", "moderator": "none", "assessor": "all"},
    "moderator_note": {"speaker": "own", "moderator": "all", "assessor": "none"},
}


def visible_records(records: DataFrame, viewers: DataFrame) -> DataFrame:
    """Records (`run_id`, `kind`, `owner`) each viewer (`run_id`, `viewer`, `part`) may see.
    A run has a handful of viewers."""
    rule = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("part") == part), F.lit(r))
                        for k, parts in VISIBILITY.items() for part, r in parts.items()], F.lit("none"))
    j = records.join(viewers, "run_id").withColumn("__rule", rule)
    return j.filter((F.col("__rule") == "all") | ((F.col("__rule") == "own") & (F.col("owner") == F.col("viewer")))).drop("__rule")


def public_entries(transcript: DataFrame, exhibits: DataFrame) -> DataFrame:
    """What was said aloud: no private columns, and what each of a turn's own markers became
    on record ("S2=E1"). A turn discloses a handful of passages."""
    own = exhibits.groupBy("run_id", "turn", "agent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("n", "from_marker", "marker"))), lambda x: F.concat(x["from_marker"], F.lit("="), x["marker"])), " ").alias("markers"))
    e = transcript.select("run_id", "turn", "agent_id", "name", "content").join(own, ["run_id", "turn", "agent_id"], "left")
    return e.withColumn("markers", F.coalesce("markers", F.lit("")))


def private_briefs(agents: DataFrame) -> DataFrame:
    """Bottom line, confidential facts and case files of each agent that has any."""
    files = F.array_join("libraries", ", ")
    bits = F.array_compact(F.array(
        F.when(F.coalesce("bottom_line", F.lit("")) != "", F.concat(F.lit("bottom line: "), "bottom_line")),
        F.when(F.coalesce("confidential", F.lit("")) != "", F.concat(F.lit("confidential: "), "confidential")),
        F.when(files != "", F.concat(F.lit("own case files: "), files))))
    return agents.withColumn("brief", F.concat(F.lit("- "), "name", F.lit(": "), F.array_join(bits, "; "))).filter(F.size(bits) > 0)


def compact_tool_results(messages: DataFrame, keep: int) -> DataFrame:
    """Messages with all but the last `keep` tool results over 300 characters cut to their
    first line and the headings of the passages they gave."""
    from .citations import _HEAD
    last = best_per(messages.filter("role = 'tool'").select("run_id", "position"), ["run_id"], [F.desc("position")], keep, "__k") if keep else None
    content = F.col("content")
    ns = F.regexp_extract_all(content, F.lit(_HEAD), F.lit(1))
    heads = F.regexp_extract_all(content, F.lit(_HEAD), F.lit(2))
    # A number met twice stands where it first came, with the heading it had last.
    lines = F.transform(F.array_distinct(ns), lambda n: F.concat(
        F.lit("["), n, F.lit("] "), F.substring(tx.strip(F.element_at(F.filter(heads, lambda h, i: F.get(ns, i) == n), F.lit(-1))), 1, 200)))
    first = F.substring(F.split(tx.strip(content), "\n")[0], 1, 240)
    short = F.concat(first, F.lit(" … (shortened to save room; your notes say what it showed"), F.when(
        F.size(ns) > 0, F.concat(F.lit("; its passages, still citable by number:\n"), F.array_join(lines, "\n"), F.lit(")"))).otherwise(")"))
    m = messages
    if last is not None:
        m = m.join(last.select("run_id", "position", F.lit(True).alias("__kept")), ["run_id", "position"], "left")
    else:
        m = m.withColumn("__kept", F.lit(None).cast("boolean"))
    old = (F.col("role") == "tool") & F.col("__kept").isNull() & (F.length("content") > 300)
    return m.withColumn("content", F.when(old, short).otherwise(content)).drop("__kept")


# ------------------------------------------------------------------ the cast

def check_cast(agents: DataFrame, casts: DataFrame) -> DataFrame:
    """Problems of each cast a person can fix: `level`, the agent, and the message."""
    a = agents.withColumns({c: tx.strip(F.coalesce(c, F.lit(""))) for c in (
        "agent_id", "name", "goal", "role", "bottom_line", "system_prompt", "played_by")})
    label = F.coalesce(F.nullif("name", F.lit("")), F.nullif("agent_id", F.lit("")), F.lit("An unnamed agent"))
    a = a.withColumns({"label": label, "__name": F.lower("name"), "__goal": tx.squeeze(F.lower("goal"))})

    def issue(df, level, message):
        return df.select("cast_id", F.lit(level).alias("level"), F.nullif("agent_id", F.lit("")).alias("agent"), message.alias("message"))

    def later(df, key):
        """Holders of a value after its first holder in the cast, and that one's label."""
        first = df.groupBy("cast_id", key).agg(F.min("seat").alias("__first"), F.min_by("label", "seat").alias("__by"))
        return df.join(first, ["cast_id", key]).filter(F.col("seat") > F.col("__first"))

    sizes = casts.join(agents.groupBy("cast_id").agg(F.count(F.lit(1)).alias("n")), "cast_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = a.filter((F.col("system_prompt") == "") & (F.col("played_by") != "person"))
    # The messages as they are shown.
    parts = [
        sizes.filter("n < 2").select("cast_id", F.lit("error").alias("level"), F.lit(None).cast("string").alias("agent"), F.when(
            F.col("n") == 1, "A role-play needs at least two agents.").otherwise("Add at least two agents to the cast.").alias("message")),
        issue(a.filter("agent_id = ''"), "error", F.concat("label", F.lit(" has no short id."))),
        issue(later(a.filter("agent_id <> ''"), "agent_id"), "error", F.concat(
            F.lit('Two agents share the id "'), "agent_id", F.lit('". Each agent needs its own, because the id is what keeps its memory private.'))),
        issue(a.filter("name = ''"), "warning", F.concat(F.lit('Agent "'), "agent_id", F.lit('" has no name.'))),
        issue(later(a.filter("name <> ''"), "__name"), "warning", F.concat(
            F.lit('Two agents are both named "'), "name", F.lit('". The others will not be able to tell them apart.'))),
        issue(own.filter("goal = ''"), "warning", F.concat("label", F.lit(" has no objective, so they have nothing to argue for."))),
        issue(later(own.filter("goal <> ''"), "__goal"), "warning", F.concat(
            "__by", F.lit(" and "), "label", F.lit(" have the same objective. Was one agent copied from another?"))),
        issue(own.filter("role = ''"), "warning", F.concat("label", F.lit(" has no role."))),
        issue(own.filter("bottom_line = ''"), "suggestion", F.concat("label", F.lit(
            " has no bottom line. Without a point where they would rather walk away, agents tend to argue in circles or give in too easily."))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seat_cast(agents: DataFrame, players: DataFrame, models: DataFrame, installed: DataFrame, launchers: DataFrame) -> DataFrame:
    """Who plays each role of each run (`run_id`, `agent_id`, `played_by`, `model`): the run's
    person, else the run's model, else the cast's own choice; a role kept for a person with
    nobody named goes to whoever launched the run. A model nobody has installed is an error."""
    keys = ["run_id", "agent_id"]
    j = (agents.join(players.select(*keys, F.col("user_id").alias("__who")), keys, "left")
         .join(models.select(*keys, F.col("model").alias("__model"), F.lit(True).alias("__chose")), keys, "left")
         .join(launchers.select("run_id", "launched_by"), "run_id", "left"))
    person = F.col("__who").isNotNull() | ((F.coalesce("played_by", F.lit("")) == "person") & F.col("__chose").isNull())
    model = F.when(~person, F.nullif(F.when(F.col("__chose"), F.col("__model")).otherwise(F.col("model")), F.lit("")))
    j = j.withColumns({"player": F.when(person, F.coalesce("__who", "launched_by")), "model": model})
    have = installed.select(F.col("name").alias("model")).distinct().withColumn("__have", F.lit(True))
    j = j.join(have, "model", "left")
    return j.withColumn("error", F.when(F.col("model").isNotNull() & F.col("__have").isNull(), F.concat(
        "name", F.lit(" is set to be played by "), "model", F.lit(", which is not one of the lab's role-play models.")))).drop(
        "__who", "__model", "__chose", "__have", "launched_by", "played_by")


def model_offer(host_models: DataFrame, default: str, hidden: tuple[str, ...] = ("uncensored", "abliterated")) -> DataFrame:
    """Models every reachable host has (`host`, `model`, `capabilities`), not hidden and able
    to chat, the default first."""
    hosts = host_models.agg(F.count_distinct("host").alias("hosts"))
    have = host_models.groupBy("model").agg(F.count_distinct("host").alias("on_hosts"), F.min_by("capabilities", "host").alias("capabilities"))
    total = hosts.first()["hosts"]             # one number
    shown = have.filter((F.col("on_hosts") == total) & F.array_contains("capabilities", "completion"))
    for h in hidden:
        shown = shown.filter(~F.lower("model").contains(h.lower()))
    return shown.select("model", F.array_contains("capabilities", "thinking").alias("thinking"), F.array_contains("capabilities", "tools").alias("tools"),
                        (F.col("model") == default).alias("is_default"))
