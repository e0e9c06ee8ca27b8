"""The moving parts of a run's record as Structured Streaming jobs.

Each job reads files as they land and keeps its place in a checkpoint. Jobs whose result
changes write each micro-batch under its number; a re-run of a batch overwrites the same
folder, and the latest batch of a key wins when the result is read back.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import libraries, trace
from ..settings import DEFAULTS


def landed(spark: SparkSession, path: str, schema: T.StructType, name: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files that land in a folder, or of one file."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(path))


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str) -> StreamingQuery:
    """The job with its state in RocksDB. A query takes the session's settings when it starts."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKSDB)
    try:
        return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
                .trigger(availableNow=True).start())
    finally:
        conf.set(_STORE, before)


def _state(spark: SparkSession, checkpoint: str, variable: str | None = None, **options: str) -> DataFrame:
    """What a job's stateful operator holds after its last batch."""
    if variable:
        options["stateVarName"] = variable
    return spark.read.format("statestore").options(**options).load(checkpoint)


def _keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last value written for each key by a job that keeps its batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("v"))
    return best.select(*keys, "v.*")


def every(spark: SparkSession, path: str) -> DataFrame:
    """All rows a job that keeps its batches has written."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")


# ------------------------------------------------------------------ traces

def tail(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """New events as they come, each once; the checkpoint stands in for the last number seen."""
    return (events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
            .option("path", path).trigger(availableNow=True).start())


def running_metrics(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run metrics kept current: each batch writes the runs it changed."""
    return _start(trace.run_metrics(events), checkpoint, _keep_batches(path), "update")


def volume(events: DataFrame, path: str, checkpoint: str, size: str, slide: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Events and model time per host in tumbling or sliding windows of event time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = (events.withWatermark("ts", late).groupBy(w, "host").agg(F.count(F.lit(1)).alias("events"), F.sum("eval_ms").alias("eval_ms"))
           .select(F.col("window.start").alias("start"), "host", "events", "eval_ms"))
    return _start(agg, checkpoint, _keep_batches(path), "update")


def sessions(events: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", late: str = "1 hour") -> StreamingQuery:
    """Sessions of activity of each run, written once they are over; `open_sessions` has the others."""
    agg = (events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "run_id").agg(F.count(F.lit(1)).alias("events"))
           .select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"))
    return _start(agg, checkpoint, _keep_batches(path), "append")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions of a `sessions` job that may still go on, read from its state."""
    return _state(spark, checkpoint).select("value.run_id", F.col("value.session_window.start").alias("start"), F.col("value.session_window.end").alias("end"),
                                            F.col("value.count").alias("events"))


# ------------------------------------------------------------------ libraries

def _least(frames: Iterator[pd.DataFrame], keys: list[str], order: list[str]) -> Iterator[pd.DataFrame]:
    """The first row of each key by `order`. Rows are put together once there are as many new ones as are kept."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        kept.append(frame)
        if len(kept) > 1 and sum(map(len, kept[1:])) >= len(kept[0]):
            kept = [pd.concat(kept).sort_values(order, kind="stable").drop_duplicates(keys)]
    if kept:
        yield pd.concat(kept).sort_values(order, kind="stable").drop_duplicates(keys)


def add_documents(documents: DataFrame, held: DataFrame, path: str, checkpoint: str, arrived: str = "arrived", within: str = "30 days") -> StreamingQuery:
    """Arriving documents that are added: a text is added to a library once, whether
    it was held before, came in an earlier batch, or comes twice in one.

    Texts that arrived `within` this time before are known by state, which holds their digests for so long and is dropped after it; those
    of before by `held`, which a stream-static join reads. No batch reads what earlier ones wrote. Of equal texts in one batch the first to
    arrive is added, of those at one time the one with the least `document_id`, in however many files and parts they are read.
    """
    keys, order = ["corpus", "sha256"], [arrived, "document_id"]
    first = documents.repartition(*keys).mapInPandas(lambda frames: _least(frames, keys, order), documents.schema)
    new = first.withWatermark(arrived, within).dropDuplicatesWithinWatermark(keys)
    new = new.join(held.select("corpus", "sha256").distinct(), ["corpus", "sha256"], "left_anti")
    return _start(new, checkpoint, _keep_batches(path), "append")


def add_statuses(documents: DataFrame, added: DataFrame) -> DataFrame:
    """The status of documents that have arrived, by what `add_documents` has added."""
    known = added.select(F.col("document_id"), F.lit("added").alias("status"))
    return documents.join(known, "document_id", "left").withColumn("status", F.coalesce("status", F.lit("duplicate")))


def record_versions(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One version per library and batch of its change log, when its contents differ from
    the last. Log, manifest and members are kept by batch under `path`."""
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={number}")

        touched = batch.select("corpus").distinct()

        def kept(name, upto):
            rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").filter(F.col("batch") <= upto).drop("batch")
            return rows.join(touched, "corpus", "left_semi")

        now = libraries.live(kept("log", number))
        members = spark.createDataFrame([], "corpus string, version int, document_id long")
        # The manifest says what the last versions hold, by digest; their members are not read.
        manifest = kept("manifest", number - 1) if number else spark.createDataFrame([], "corpus string, version int, documents long, digest string")
        new, rows = libraries.next_versions(now, members, manifest)
        rows.select("corpus", "version", "document_id").write.mode("overwrite").parquet(f"{path}/members/batch={number}")
        new.write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")

    return _start(changes, checkpoint, write, "append")


# ------------------------------------------------------------------ state per key
#
# State lies in RocksDB and is small by rule: a buffer under its token budget, a streak, a pair of
# times. The rows of a key come in frames of at most `spark.sql.execution.arrow.maxRecordsPerBatch`
# rows, and only one of these is in memory at a time.

class _InOrder(StatefulProcessor):
    """Takes the rows of a key in a batch by number. One frame is sorted where it is. When there are more, their
    rows are put in a map of the state store, each under its number, and taken out again by number, so that
    what is in memory of a key with most rows of a batch are numbers."""

    number: str
    fields: tuple[str, ...]
    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "number long, place long", self.schema)

    def in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        first = next(frames, None)
        second = next(frames, None)
        if first is None:
            return
        if second is None:
            yield from first.sort_values(self.number, kind="stable")[list(self.fields)].itertuples(index=False, name=None)
            return
        numbers = []
        for place, frame in enumerate(chain((first, second), frames)):
            values = frame[list(self.fields)].astype(object).where(frame[list(self.fields)].notna(), None)
            for at, (number, row) in enumerate(zip(frame[self.number].tolist(), values.itertuples(index=False, name=None))):
                self.waiting.updateValue((int(number), place * len(first) + at), row)
            numbers.append(np.column_stack([frame[self.number].to_numpy(np.int64), place * len(first) + np.arange(len(frame))]))
        first = second = None
        both = np.concatenate(numbers)
        for key in both[np.lexsort((both[:, 1], both[:, 0]))]:
            key = (int(key[0]), int(key[1]))
            yield tuple(self.waiting.getValue(key))
            self.waiting.removeKey(key)


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, time: str = "None") -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "append", time)


class _Compaction(_InOrder):
    number, fields, schema = "message_id", ("message_id", "role", "content"), "message_id long, role string, content string"

    def __init__(self, budget: int, fraction: float) -> None:
        self.budget, self.fraction = budget, fraction

    def init(self, handle):
        super().init(handle)
        self.buffer = handle.getListState("buffer", "message_id long, line string, tokens long")
        self.folds = handle.getValueState("folds", "folds long")

    def handleInputRows(self, key, rows, timerValues):
        buffer = deque((int(i), line, int(t)) for i, line, t in self.buffer.get())
        total, folds = sum(t for _, _, t in buffer), int(self.folds.get()[0]) if self.folds.exists() else 0
        out = []
        for number, role, content in self.in_order(rows):
            tokens = max(1, int(len(content) / 3.5))
            buffer.append((int(number), f"{role}: {content}", tokens))
            total += tokens
            if total > self.budget and len(buffer) >= 2:
                n = max(2, int(len(buffer) * self.fraction))
                gone = [buffer.popleft() for _ in range(n)]
                folds, total = folds + 1, total - sum(t for _, _, t in gone)
                out.append((*key, folds, n, "\n".join(line for _, line, _ in gone)))
        self.buffer.put(list(buffer)) if buffer else self.buffer.clear()
        self.folds.update((folds,))
        yield pd.DataFrame(out, columns=["run_id", "agent_id", "summary_no", "messages", "excerpt"])


def compaction(messages: DataFrame, path: str, checkpoint: str, budget: int = DEFAULTS.short_term_token_budget,
               fraction: float = DEFAULTS.compact_fraction) -> StreamingQuery:
    """The buffer of each (run, agent) as messages come: over budget, its oldest part is
    folded and written. Messages of a batch are taken in the order of their ids."""
    folded = _stateful(messages, ["run_id", "agent_id"], _Compaction(budget, fraction), "run_id long, agent_id string, summary_no long, messages long, excerpt string")
    return _start(folded, checkpoint, _keep_batches(path), "append")


def buffers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The messages now in each buffer of a `compaction` job, read from its state."""
    rows = _state(spark, checkpoint, "buffer", flattenCollectionTypes="true")
    return rows.select("key.run_id", "key.agent_id", "list_element.message_id", "list_element.line", "list_element.tokens")


class _Halts(_InOrder):
    number, fields, schema = "position", ("position", "status", "http_status"), "position long, status string, http_status int"

    def init(self, handle):
        super().init(handle)
        self.streak = handle.getValueState("streak", "failures int, halted boolean")

    def handleInputRows(self, key, rows, timerValues):
        failures, halted = self.streak.get() if self.streak.exists() else (0, False)
        out = []
        for position, status, http_status in self.in_order(rows):
            if halted:
                continue                       # what waits is still taken out
            failures = failures + 1 if status == "error" else 0
            busy = status == "error" and http_status in (429, 503)
            halted = busy or failures >= 3
            if halted:
                out.append((key[0], int(position), "busy" if busy else "three in a row"))
        self.streak.update((int(failures), bool(halted)))
        yield pd.DataFrame(out, columns=["crawl_id", "position", "reason"])


def crawl_halts(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Where each crawl has to stop, as its results come: at a 429 or 503, or at the third
    failed request in a row."""
    halts = _stateful(results, ["crawl_id"], _Halts(), "crawl_id long, position long, reason string")
    return _start(halts, checkpoint, _keep_batches(path), "append")


class _Pace(_InOrder):
    number, fields = "at_us", ("request_id", "at_us", "limited")
    schema = "request_id long, at_us long, limited boolean"

    def __init__(self, cooldown: float, spacing: float) -> None:
        self.cooldown, self.spacing = cooldown, spacing

    def init(self, handle):
        super().init(handle)
        self.clock = handle.getValueState("clock", "last long, limited long")

    def handleInputRows(self, key, rows, timerValues):
        last, limited = self.clock.get() if self.clock.exists() else (None, None)
        out = []
        for request, at, was_limited in self.in_order(rows):
            since = lambda t: None if t is None else (at - t) / 1e6      # noqa: B023, E731
            out.append((key[0], int(request), limited is not None and since(limited) < self.cooldown, last is not None and since(last) < self.spacing))
            last, limited = int(at), int(at) if was_limited else limited
        self.clock.update((last, limited))
        yield pd.DataFrame(out, columns=["source", "request_id", "cooling", "too_soon"])


def cooldowns(requests: DataFrame, path: str, checkpoint: str, cooldown: float = DEFAULTS.cooldown_s, spacing: float = DEFAULTS.spacing_s) -> StreamingQuery:
    """Requests (`source`, `request_id`, `at_s`, `limited`) made while a source was cooling
    down after a 429, or less than the spacing after the one before."""
    rows = requests.select("source", "request_id", F.round(F.col("at_s") * 1_000_000).cast("long").alias("at_us"), "limited")
    paced = _stateful(rows, ["source"], _Pace(cooldown, spacing), "source string, request_id long, cooling boolean, too_soon boolean")
    return _start(paced, checkpoint, _keep_batches(path), "append")


class _Deadlines(_InOrder):
    number, fields, schema = "at_ms", ("turn", "at_ms", "kind"), "turn long, at_ms long, kind string"

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle):
        super().init(handle)
        self.handle = handle
        self.open = handle.getValueState("open", "turn long, opened_ms long")

    def handleInputRows(self, key, rows, timerValues):
        turn, opened = self.open.get() if self.open.exists() else (None, None)
        before, out = opened, []
        for number, at, kind in self.in_order(rows):
            if turn is not None and (at - opened > self.limit or kind == "opened"):
                out.append((key[0], int(turn), "passed over"))
                turn = None
            if kind == "opened":
                turn, opened = int(number), int(at)
            elif turn is not None:
                out.append((key[0], int(turn), "answered"))
                turn = None
        if before is not None and (turn is None or opened != before):
            self.handle.deleteTimer(int(before) + self.limit)
        if turn is None:
            self.open.clear()
        else:
            self.open.update((turn, opened))
            if opened != before:
                self.handle.registerTimer(int(opened) + self.limit)
        yield _outcomes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        turn = self.open.get()[0] if self.open.exists() else None
        self.open.clear()
        yield _outcomes([] if turn is None else [(key[0], int(turn), "passed over")])


def _outcomes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["run_id", "turn", "outcome"])


def turn_deadlines(turns: DataFrame, path: str, checkpoint: str, minutes: int = DEFAULTS.reply_minutes_default, late: str = "1 minute") -> StreamingQuery:
    """Turns (`run_id`, `turn`, `ts`, `kind` of opened or replied): answered in time, or
    passed over when a timer finds event time past the deadline. A run has one turn open at a time; `open_turns` has
    those still open."""
    rows = turns.withWatermark("ts", late).select("run_id", "turn", "ts", F.unix_millis("ts").alias("at_ms"), "kind")
    done = _stateful(rows, ["run_id"], _Deadlines(minutes * 60_000), "run_id long, turn long, outcome string", "eventtime")
    return _start(done, checkpoint, _keep_batches(path), "append")


def open_turns(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The turns that wait for a reply in a `turn_deadlines` job, read from its state."""
    return _state(spark, checkpoint, "open").select("key.run_id", "value.turn", F.timestamp_millis("value.opened_ms").alias("opened"))
