"""Run traces: metrics, latency, run lists and what a run was launched with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..scale import with_position
from ..settings import DEFAULTS


def run_metrics(events: DataFrame) -> DataFrame:
    """Calls, tokens and times per run, with the share of time spent queueing."""
    def count(kind):
        return F.count_if(F.col("event_type") == kind)

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0))

    m = events.groupBy("run_id").agg(
        count("llm_call").alias("model_calls"), count("tool_call").alias("tool_calls"),
        count("retrieval").alias("retrievals"), count("error").alias("errors"),
        total("prompt_tokens").alias("prompt_tokens"), total("output_tokens").alias("output_tokens"),
        total("eval_ms").alias("total_eval_ms"), total("queue_wait_ms").alias("total_queue_wait_ms"),
        F.coalesce(F.max("queue_wait_ms"), F.lit(0)).alias("max_queue_wait_ms"))
    return m.withColumn("queue_share", queue_share(F.col("total_queue_wait_ms"), F.col("total_eval_ms")))


def queue_share(wait: Column, evaluation: Column) -> Column:
    return F.bround(wait / F.greatest(F.lit(1), wait + evaluation), 3)


def host_calls(events: DataFrame) -> DataFrame:
    return events.filter(F.col("host").isNotNull()).groupBy("run_id", "host").agg(F.count(F.lit(1)).alias("calls"))


def experiment_list(experiments: DataFrame, runs: DataFrame, trashed: bool = False) -> DataFrame:
    """Experiments in use, or in the trash, with how many runs each has and the last."""
    last = runs.groupBy(F.col("experiment_id")).agg(F.count(F.lit(1)).alias("run_count"),
                                                    F.max("created_at").alias("last_run"))
    gone = F.col("deleted_at").isNotNull()
    return (experiments.filter(gone if trashed else ~gone).join(last, "experiment_id", "left")
            .withColumn("run_count", F.coalesce("run_count", F.lit(0))))


def latest_runs(runs: DataFrame, experiments: DataFrame, limit: int = 50) -> DataFrame:
    """The latest runs of experiments in use. The limit is what a run list shows."""
    in_use = experiments.filter("deleted_at is null").select("experiment_id", F.col("name").alias("experiment_name"), "mode")
    return (runs.join(in_use, "experiment_id")
            .orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit))


def run_detail(runs: DataFrame, experiments: DataFrame, users: DataFrame, run_libraries: DataFrame) -> DataFrame:
    """Runs with experiment, launcher and pinned libraries in order. A run pins a handful of
    libraries, so they fit one array."""
    pins = run_libraries.groupBy("run_id").agg(F.array_sort(F.collect_list(
        F.struct("position", "corpus", "version"))).alias("libraries"))
    who = users.select(F.col("user_id").alias("launched_by"),
                       F.coalesce(F.nullif("name", F.lit("")), F.col("email")).alias("launched_by_name"))
    named = experiments.select("experiment_id", F.col("name").alias("experiment_name"), "mode")
    return (runs.join(named, "experiment_id").join(who, "launched_by", "left").join(pins, "run_id", "left"))


ACTIVE = ("pending", "running")


def trash_plan(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """What may happen to each experiment: to the trash, or deleted for good when it is in
    the trash already; neither while a run is active."""
    busy = runs.filter(F.col("status").isin(*ACTIVE)).select("experiment_id").distinct().withColumn("busy", F.lit(True))
    e = experiments.join(busy, "experiment_id", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
    return e.withColumn("action", F.when(F.col("busy"), "refused").when(F.col("deleted_at").isNull(), "may be trashed")
                        .otherwise("may be deleted"))


def moved_to_trash(experiments: DataFrame, runs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The experiments after what was asked for some of them (`experiment_id`, `ask`, "trash" or "restore"): one in the trash keeps its time,
    one with an active run stays where it is and its `outcome` is refused; the others' is trashed, restored or unchanged."""
    e = trash_plan(experiments, runs).join(asked.select("experiment_id", "ask"), "experiment_id", "left")
    outcome = F.when((F.col("ask") == "trash") & F.col("busy"), "refused").when(F.col("ask") == "trash", "trashed").when(F.col("ask") == "restore", "restored").otherwise("unchanged")
    after = F.when(outcome == "trashed", F.coalesce("deleted_at", now)).when(outcome == "restored", F.lit(None)).otherwise(F.col("deleted_at"))
    return e.withColumns({"outcome": outcome, "deleted_at": after}).drop("busy", "action", "ask")


def empty_trash(experiments: DataFrame, runs: DataFrame, **dependents: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting every trashed experiment without an active run: rows of
    `dependents` (keyed by `run_id`) go with their runs."""
    gone = trash_plan(experiments, runs).filter("action = 'may be deleted'").select("experiment_id")
    gone_runs = runs.join(gone, "experiment_id", "left_semi").select("run_id")
    out = {"experiments": experiments.join(gone, "experiment_id", "left_anti"),
           "runs": runs.join(gone, "experiment_id", "left_anti")}
    return out | {n: d.join(gone_runs, "run_id", "left_anti") for n, d in dependents.items()}


def launch_settings(config: Column, inputs: Column) -> dict[str, Column]:
    """What a run starts from: its inputs over the experiment's settings (both maps of
    text), clamped to what is allowed."""
    merged = F.map_concat(F.map_filter(config, lambda k, _: ~F.array_contains(F.map_keys(inputs), k)), inputs)

    def number(name, default, low, high):
        return tx.clamp(F.coalesce(merged[name].try_cast("int"), F.lit(default)), low, high)

    return {"snapshot": config, "merged": merged,
            "max_turns": number("max_turns", DEFAULTS.default_max_turns, 2, DEFAULTS.max_turns_limit),
            "word_limit": number("word_limit", DEFAULTS.default_word_limit, 40, DEFAULTS.word_limit_max),
            "time_limit_minutes": number("time_limit_minutes", DEFAULTS.time_limit_min, 5, DEFAULTS.time_limit_max)}


def turns_spoken(events: DataFrame, runs_active: DataFrame) -> DataFrame:
    """Turns spoken so far in runs in progress: notes of the speaking step that say so."""
    spoken = events.filter((F.col("node") == "speak") & (F.col("event_type") == "note") & F.col("spoken").isNotNull())
    return spoken.join(runs_active, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("turns"))


def run_rows(runs: DataFrame, now: Column) -> DataFrame:
    """Start, duration and a one-line summary of each run. Needs `mode`, and `answer`,
    `error`, `turns`, `max_turns` where known."""
    active = F.col("status").isin(*ACTIVE)

    def secs(a, b):
        return F.timestamp_diff("SECOND", a, b)

    took = (F.when(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(),
                   tx.elapsed_text(secs(F.col("started_at"), F.col("finished_at"))))
            .when(F.col("started_at").isNotNull() & active,
                  F.concat(tx.elapsed_text(secs(F.col("started_at"), now)), F.lit(" so far"))).otherwise("—"))
    text = tx.snippet(F.col("answer"))
    so_far = F.concat(F.lit("In progress: "), "turns", F.lit(" of up to "), "max_turns", F.lit(" turns so far"))
    first_line = F.split(tx.strip(F.coalesce("error", F.lit("unknown error"))), "\n")[0]
    turns = F.concat(F.coalesce("turns", F.lit(0)).cast("string"), F.lit(" turns"))
    summary = (F.when(F.col("status") == "failed", F.concat(F.lit("Failed: "), tx.snippet(first_line, 140)))
               .when(active & (F.col("mode") == "roleplay") & F.col("turns").isNotNull(), so_far)
               .when(F.col("status") == "pending", "Starting").when(active, "In progress")
               .when((F.col("mode") == "roleplay") & (text != ""), F.concat(turns, F.lit(" · "), text))
               .when(F.col("mode") == "roleplay", turns)
               .when(text != "", text).otherwise("Finished, with no answer text"))
    return runs.withColumns({
        "active": active, "took": took, "summary": summary,
        "started": F.coalesce(F.date_format("started_at", "MMM d, HH:mm"), F.lit("—"))})


def call_rates(events: DataFrame) -> DataFrame:
    """Output tokens per second of each model call, and whether it was cut short."""
    rate = F.coalesce(F.when(F.col("eval_ms") > 0, F.col("output_tokens") / (F.col("eval_ms") / 1000)), F.lit(0.0))
    return events.filter(F.col("event_type") == "llm_call").withColumns({
        "tokens_per_s": F.bround(rate, 1), "truncated": F.col("done_reason") == "length"})


def latency_table(calls: DataFrame) -> DataFrame:
    """Per concurrency level: ok, errors, tokens per second over the wall time, median and
    p95 (the item at min(n - 1, int(0.95 n)) of the sorted latencies, counted from 0).
    Positions come from a range-sorted numbering, so a level of any size is spread out."""
    placed = with_position(calls.select("level", "latency_s", "call_id"), ["level"], ["latency_s", "call_id"], "at")
    sizes = calls.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors"), F.sum("tokens").alias("tokens"),
        (F.max(F.col("start_s") + F.col("latency_s")) - F.min("start_s")).alias("wall_s"))
    n = F.col("n")
    wanted = placed.join(sizes.select("level", "n"), "level").filter(
        F.col("at").isin(-1) | (F.col("at") == F.floor((n + 1) / 2)) | (F.col("at") == F.floor(n / 2) + 1)
        | (F.col("at") == F.least(n, F.floor(n * 95 / 100) + 1)))
    picked = wanted.groupBy("level").agg(
        F.avg(F.when((F.col("at") == F.floor((n + 1) / 2)) | (F.col("at") == F.floor(n / 2) + 1), F.col("latency_s"))).alias("p50"),
        F.max(F.when(F.col("at") == F.least(n, F.floor(n * 95 / 100) + 1), F.col("latency_s"))).alias("p95"))
    return sizes.join(picked, "level").select(
        "level", (n - F.col("errors")).alias("ok"), "errors", F.col("tokens"),
        F.bround("wall_s", 2).alias("wall_s"), F.bround(F.col("tokens") / F.col("wall_s"), 4).alias("tokens_per_s"),
        F.bround("p50", 4).alias("p50"), F.bround("p95", 4).alias("p95"))


def retrieval_trace(handed_out: DataFrame) -> DataFrame:
    """Each search with its hits in rank order; a search returns at most a few passages."""
    return handed_out.groupBy("run_id", "turn").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "chunk_id", "document_id", F.bround("similarity", 4).alias("similarity")))).alias("hits"))


def sequence_numbers(events: DataFrame) -> DataFrame:
    """`seq` = 1, 2, ... per run in order of arrival."""
    return with_position(events, ["run_id"], ["ts", "event_id"], "seq")


# How much of each text a trace keeps.
TRACE_CUTS = {"prompt": 2000, "response": 8000, "tool_result": 50_000}


def activity(events: DataFrame, *fields: str) -> DataFrame:
    """Events as an activity panel reads them: chosen fields, times in ISO form."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events.select(*fields, iso.alias("created_at"))


def normalize_plan(plans: DataFrame, candidates: list[str], databases: bool, web: bool,
                   max_questions: int = DEFAULTS.max_sub_questions) -> DataFrame:
    """Research plans as a run uses them: sub-questions (array of `question`, `look_in`)
    tidied, capped and numbered; places checked; libraries joined with those looked in."""
    places = [*candidates, *(["databases"] if databases else []), *(["web"] if web else [])]
    allowed = F.array(*[F.lit(p) for p in places]) if places else F.expr("cast(array() as array<string>)")
    known = F.array(*[F.lit(c) for c in candidates]) if candidates else F.expr("cast(array() as array<string>)")
    tidy = F.filter(F.transform("sub_questions", lambda q: F.struct(
        tx.squeeze(q["question"]).alias("question"),
        F.array_distinct(F.filter(q["look_in"], lambda x: F.array_contains(allowed, x))).alias("look_in"))),
        lambda q: q["question"] != "")
    capped = F.transform(F.slice(tidy, 1, max_questions), lambda q, i: F.struct(
        F.concat(F.lit("Q"), (i + 1).cast("string")).alias("id"), q["question"].alias("question"), q["look_in"].alias("look_in")))
    fallback = F.array(F.struct(F.lit("Q1").alias("id"), F.substring("brief", 1, 500).alias("question"),
                                F.expr("cast(array() as array<string>)").alias("look_in")))
    d = plans.withColumn("sub_questions", F.when(F.size(capped) > 0, capped).otherwise(fallback))
    looked = F.flatten(F.transform("sub_questions", lambda q: q["look_in"]))
    named = F.filter(F.array_union(F.col("libraries"), looked), lambda x: F.array_contains(known, x))
    question = tx.squeeze(F.coalesce("question", F.lit("")))
    return d.withColumns({"libraries": named, "question": F.when(question != "", question).otherwise(
        F.substring("brief", 1, 500)), "use_databases": F.lit(databases), "use_web": F.lit(web)})


def research_settings(config: dict[str, Column]) -> dict[str, Column]:
    """What a research run may use, from its merged settings: `choose_libraries`,
    `use_databases`, `use_web`, the older `allow_network`, `named` libraries and
    `time_limit_minutes`."""
    legacy = F.coalesce(config["allow_network"], F.lit(False))
    minutes = F.coalesce(F.nullif(config["time_limit_minutes"].try_cast("int"), F.lit(0)), F.lit(DEFAULTS.time_limit_min))
    return {"choose_libraries": F.coalesce(config["choose_libraries"], F.size(config["named"]) == 0),
            "use_databases": F.coalesce(config["use_databases"], legacy), "use_web": F.coalesce(config["use_web"], F.lit(False)),
            "time_limit_minutes": tx.clamp(minutes, 5, DEFAULTS.time_limit_max)}


def brief_of(description: Column, task: Column) -> Column:
    """The research brief: a run's own task, else the experiment's description."""
    return F.coalesce(F.nullif(tx.strip(task), F.lit("")), tx.strip(description), F.lit(""))


def fetch_library(chosen: Column, experiment: Column) -> Column:
    """The library a run saves what it reads into: the one chosen, or one of its own."""
    own = F.concat(F.lit("Fetched: "), experiment)
    return tx.tidy_name(F.when(tx.strip(F.coalesce(chosen, F.lit(""))) != "", chosen).otherwise(own))
