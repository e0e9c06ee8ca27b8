"""Libraries as versioned sets of documents.

Documents are never edited: an append-only change log (`document_id`, `corpus`, `title`,
`sha256`, `event_no`, `action`, `replaced_by`) is the record, and the current state is the
latest change of each document. A version is its member rows (`corpus`, `version`,
`document_id`) and one manifest row, so a library of any size stays a table and an emptied
one can still have a version. Membership tests are joins on (library, document), which
spread a large library over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..scale import best_per, join_known, pinned, with_position
from ..settings import DEFAULTS

LIFE = ("added", "removed", "restored", "replaced", "moved")


# ------------------------------------------------------------------ state

def current_state(log: DataFrame) -> DataFrame:
    """Each document as its latest changes left it."""
    life = F.col("action").isin(*LIFE)
    order = F.struct("event_no", F.col("action"))
    s = log.groupBy("document_id").agg(
        F.max_by(F.struct("corpus", "title", "sha256", "created_at"), order).alias("d"),
        F.max_by(F.when(life, F.struct("action", "replaced_by")), F.when(life, order)).alias("l"))
    return s.select("document_id", "d.*", F.col("l.action").isin("added", "restored").alias("live"),
                    F.when(~F.col("l.action").isin("added", "restored"), F.col("l.replaced_by")).alias("replaced_by"))


def live(log: DataFrame) -> DataFrame:
    return current_state(log).filter("live").drop("live", "replaced_by")


def _changes(docs: DataFrame, action: str, event_no: Column, replaced_by: Column | None = None) -> DataFrame:
    to = replaced_by if replaced_by is not None else F.lit(None).cast("long")
    return docs.select("document_id", "corpus", "title", "sha256", "created_at", event_no.alias("event_no"),
                       F.lit(action).alias("action"), to.alias("replaced_by"))


# ------------------------------------------------------------------ adding

def add_status(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Which incoming documents (`document_id`, `corpus`, `sha256`) a library takes: the
    first of each text in a batch, unless the library already holds that text."""
    first = incoming.groupBy("corpus", "sha256").agg(F.min("document_id").alias("document_id"))
    new = first.join(held.select("corpus", "sha256"), ["corpus", "sha256"], "left_anti")
    taken = new.select("document_id", F.lit(True).alias("__taken"))
    return (incoming.join(taken, "document_id", "left")
            .withColumn("status", F.when(F.col("__taken"), "added").otherwise("duplicate")).drop("__taken"))


def ingest_report(items: DataFrame, held: DataFrame, batch_cap: int | None = None) -> DataFrame:
    """Per fetched item of a batch: error, empty, duplicate or ingested. Items (`batch_id`,
    `position`, `document_id`, `corpus`, `text`, `error`) past a batch cap are told as such."""
    if batch_cap is not None:
        items = with_position(items, ["batch_id"], ["position"], "__rank")
        over = items.filter(F.col("__rank") > batch_cap).drop("__rank")
        within = ingest_report(items.filter(F.col("__rank") <= batch_cap).drop("__rank"), held)
        return within.unionByName(over.withColumn("sha256", tx.fingerprint(F.col("text"))).withColumn("status", F.lit("past the cap")))
    items = items.withColumn("sha256", tx.fingerprint(F.col("text")))
    bad = (F.when(F.col("error").isNotNull(), "error")
           .when(tx.strip(F.coalesce("text", F.lit(""))) == "", "empty"))
    items = items.withColumn("__bad", bad)
    good = add_status(items.filter(F.col("__bad").isNull()), held)
    good = good.withColumn("status", F.when(F.col("status") == "added", "ingested").otherwise("duplicate"))
    return good.unionByName(items.filter(F.col("__bad").isNotNull()).withColumn("status", F.col("__bad"))).drop("__bad")


def link_report(requests: DataFrame, reads: DataFrame, held: DataFrame,
                cap: int | None = None) -> DataFrame:
    """What became of each link someone asked to add (`request_id`, `position`, `corpus`,
    `link`): already known by link, failed, already held by text, or added; past a cap, that."""
    if cap is not None:
        requests = with_position(requests, ["request_id"], ["position"], "__rank")
        over = requests.filter(F.col("__rank") > cap).drop("__rank")
        within = link_report(requests.filter(F.col("__rank") <= cap).drop("__rank"), reads, held)
        return within.unionByName(over.withColumn("status", F.lit("past the cap")), allowMissingColumns=True)
    known = held.filter(F.col("link").isNotNull()).groupBy("corpus", "link").agg(
        F.min("document_id").alias("by_link"))
    texts = held.groupBy("corpus", "sha256").agg(F.min("document_id").alias("by_text"))
    r = (requests.join(known, ["corpus", "link"], "left").join(reads, "link", "left")
         .withColumn("sha256", tx.fingerprint(F.col("text"))))
    r = join_known(r, texts, ["corpus", "sha256"], ["request_id", "position"])
    could = F.col("by_link").isNull() & F.col("error").isNull() & F.col("by_text").isNull()
    # One text asked for twice is added once; ids order the requests.
    r = r.withColumn("order", F.struct("request_id", "position"))
    firsts = r.filter(could).groupBy("corpus", "sha256").agg(F.min("order").alias("order")).select(
        F.col("order.request_id").alias("request_id"), F.col("order.position").alias("position"), F.lit(True).alias("__first"))
    r = r.join(firsts, ["request_id", "position"], "left")
    return r.withColumn("status", F.when(F.col("by_link").isNotNull(), "exists by link")
                        .when(F.col("error").isNotNull(), "error").when(F.col("by_text").isNotNull(), "exists by text")
                        .when(F.col("__first"), "added").otherwise("exists by text")).drop("__first", "order")


# ------------------------------------------------------------------ refreshing links

def refresh_status(held: DataFrame, reads: DataFrame) -> DataFrame:
    """Documents against a new reading of their links: unchanged, updated, error (with the
    detail), or not a link. `held` has `live`, `link` and `sha256`; `reads` has `link`,
    `text`, `error`."""
    texts = held.filter("live").groupBy("corpus", F.col("sha256").alias("new_sha")).agg(
        F.min_by("title", "document_id").alias("same_as"))
    d = join_known(held, reads.select("link", "text", "error"), ["link"], ["document_id"])
    d = join_known(d.withColumn("new_sha", tx.fingerprint(F.col("text"))), texts, ["corpus", "new_sha"], ["document_id"])
    # What is said about each outcome.
    status = (F.when(F.col("link").isNull(), "not_a_link").when(~F.col("live"), "error")
              .when(F.col("error").isNotNull() | F.col("text").isNull(), "error")
              .when(F.col("new_sha") == F.col("sha256"), "unchanged")
              .when(F.col("same_as").isNotNull(), "error").otherwise("updated"))
    detail = (F.when(F.col("link").isNull(), "This document was not added from a web link.")
              .when(~F.col("live"), "This copy is no longer in the library, so it is not checked.")
              .when(F.col("error").isNotNull() | F.col("text").isNull(), F.concat(F.coalesce(
                  "error", F.lit("Could not read it.")), F.lit(" The text already stored is kept.")))
              .when(F.col("new_sha") == F.col("sha256"), "No change since it was last read.")
              .when(F.col("same_as").isNotNull(), F.concat(
                  F.lit("The page now matches “"), "same_as", F.lit("”, already in this library, so it was not re-read.")))
              .otherwise("The page had changed; re-read."))
    return d.withColumns({"status": status, "detail": detail})


def checked_metadata(metadata: Column, status: Column, detail: Column, now: Column) -> Column:
    """A document's metadata (a map of text) after a check: when, and the error if any."""
    kept = F.map_filter(metadata, lambda k, _: ~k.isin("checked_at", "check_error", "changed_at"))
    kept = F.map_concat(kept, F.create_map(F.lit("checked_at"), now))
    changed = F.when(status == "updated", now).otherwise(metadata["changed_at"])
    out = F.when(status == "error", F.map_concat(kept, F.create_map(F.lit("check_error"), detail))).otherwise(kept)
    return F.when(changed.isNotNull(), F.map_concat(out, F.create_map(F.lit("changed_at"), changed))).otherwise(out)


def replacements(updated: DataFrame, first_new_id: int, event_no: Column) -> DataFrame:
    """Change-log rows that put a new document in the place of each updated one. The new
    document keeps the title; ids follow the highest in use."""
    numbered = with_position(updated.withColumn("__all", F.lit(0)), ["__all"], ["document_id"], "__k")
    numbered = numbered.withColumn("new_id", F.col("__k") + (first_new_id - 1)).drop("__k", "__all")
    old = _changes(numbered, "replaced", event_no, F.col("new_id"))
    new = _changes(numbered.withColumn("document_id", F.col("new_id")).withColumn("sha256", F.col("new_sha")),
                   "added", event_no)
    return old.unionByName(new)


def refresh_summary(report: DataFrame) -> DataFrame:
    """Counts per status for each library, and whether it gets a new version."""
    return report.groupBy("corpus").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "updated", "error", "not_a_link")]).withColumn(
        "new_version", F.col("updated") > 0)


# ------------------------------------------------------------------ versions

def latest_versions(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("corpus").agg(F.max("version").alias("version"))


def set_digest(key: str = "document_id") -> Column:
    """Of a group's keys, each once, a digest that does not depend on their order: their number and the parity of two hashes
    of each. It is summed where the rows are, so a set moves as one row a task."""
    n, one, two = F.count(F.lit(1)), F.bit_xor(F.xxhash64(key)), F.bit_xor(F.xxhash64(F.lit("set"), key))
    return F.concat_ws("-", n.cast("string"), F.lower(F.hex(one)), F.lower(F.hex(two)))


def manifest_of(members: DataFrame) -> DataFrame:
    return members.groupBy("corpus", "version").agg(F.count(F.lit(1)).alias("documents"), set_digest().alias("digest"))


def members_at(members: DataFrame, at: DataFrame) -> DataFrame:
    """The member rows of the versions named in `at` (`corpus`, `version`), removed since or not."""
    return members.join(at.select("corpus", "version"), ["corpus", "version"])


def next_versions(current: DataFrame, members: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New manifest and member rows for the libraries whose contents differ from their last
    version. A library with neither documents nor history gets none; an emptied one gets an
    empty version.

    Contents are told apart by `digest`, which the manifest keeps with each version; a manifest without it has them made
    from `members`. So a library that has not changed moves no member row."""
    if "digest" not in manifest.columns:
        manifest = manifest.join(manifest_of(members).drop("documents"), ["corpus", "version"], "left")
    last = manifest.groupBy("corpus").agg(F.max("version").alias("version"), F.max_by("digest", "version").alias("was"))
    now = current.select("corpus", "document_id")
    sizes = now.groupBy("corpus").agg(F.count(F.lit(1)).alias("documents"), set_digest().alias("digest"))
    empty = F.col("documents").isNull()
    both = sizes.join(last, "corpus", "full").withColumn("digest", F.when(~empty, F.col("digest")))
    # An empty set has no digest, nor has the last version of a library that was empty then.
    new = both.filter(~F.col("digest").eqNullSafe(F.col("was"))).select(
        "corpus", (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"), F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), "digest")
    new = pinned(new)                          # a row for each changed library
    return new, now.join(new.select("corpus", "version"), "corpus")


def describe_changes(before: DataFrame, after: DataFrame, links: DataFrame, history: DataFrame,
                     notes: DataFrame | None = None) -> DataFrame:
    """The change note of each library from its documents before and after (`corpus`,
    `document_id`, `title`). `history` names the libraries with an earlier version (`corpus`),
    which may have been empty; the others get a first version. `links` says what replaced a document: `document_id`,
    `replaced_by`, `new_corpus`. Titles shown are the first three by name; a library's note
    has one part per kind of change and per library moved to."""
    # Only libraries whose sets of documents differ are compared row by row.
    sets = before.groupBy("corpus").agg(set_digest().alias("was")).join(after.groupBy("corpus").agg(set_digest().alias("is")), "corpus", "full")
    changed = pinned(sets.filter(~F.col("was").eqNullSafe(F.col("is"))).select("corpus"))
    b = before.select("corpus", "document_id", F.col("title").alias("old_title"), F.lit(True).alias("was")).join(changed, "corpus", "left_semi")
    a = after.select("corpus", "document_id", F.col("title").alias("new_title"), F.lit(True).alias("is")).join(changed, "corpus", "left_semi")
    both = b.join(a, ["corpus", "document_id"], "full")
    gone = both.filter(F.col("is").isNull()).join(
        links.select("document_id", "replaced_by", "new_corpus"), "document_id", "left")
    successor = after.select("corpus", F.col("document_id").alias("replaced_by"), F.col("title").alias("successor"))
    gone = join_known(gone, successor, ["corpus", "replaced_by"], ["document_id"])
    kind = (F.when(F.col("replaced_by").isNotNull() & (F.col("new_corpus") != F.col("corpus")), "Moved")
            .when(F.col("successor").isNotNull(), "Updated").otherwise("Removed"))
    gone = gone.withColumn("kind", kind)
    came_for_old = gone.filter("kind = 'Updated'").select("corpus", F.col("replaced_by").alias("document_id")).distinct()
    added = both.filter(F.col("was").isNull()).join(came_for_old, ["corpus", "document_id"], "left_anti")
    rows = gone.select("corpus", "kind", F.when(F.col("kind") == "Moved", F.col("new_corpus")).otherwise("").alias("target"),
                       F.when(F.col("kind") == "Updated", F.col("successor")).otherwise(F.col("old_title")).alias("title"),
                       "document_id").unionByName(
        added.select("corpus", F.lit("Added").alias("kind"), F.lit("").alias("target"), F.col("new_title").alias("title"), "document_id"))
    keys = ["corpus", "kind", "target"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shown = best_per(rows, keys, [F.col("title"), F.col("document_id")], 3).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("top"))
    parts = counts.join(shown, keys).select(
        "corpus", F.when(F.col("kind") == "Added", 1).when(F.col("kind") == "Updated", 2).when(F.col("kind") == "Moved", 3)
        .otherwise(4).alias("place"), "target", F.concat(
            "kind", F.lit(" "), F.col("n").cast("string"),
            F.when(F.col("kind") == "Moved", F.concat(F.lit(" to “"), "target", F.lit("”"))).otherwise(""), F.lit(": “"),
            F.array_join(F.transform("top", lambda t: t["title"]), "”; “"), F.lit("”"),
            F.when(F.col("n") > 3, F.concat(F.lit("; and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")).alias("part"))
    text = parts.groupBy("corpus").agg(F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "target", "part"))), lambda p: p["part"]), ". "), F.lit(".")).alias("text"))
    names = before.select("corpus").union(after.select("corpus")).distinct()
    counted = after.groupBy("corpus").agg(F.count(F.lit(1)).alias("__now"))
    had = history.select("corpus").distinct().withColumn("__had", F.lit(True))
    out = (names.join(text, "corpus", "left").join(counted, "corpus", "left").join(had, "corpus", "left"))
    first = F.concat(F.lit("First recorded version: "), F.coalesce("__now", F.lit(0)).cast("string"),
                     F.when(F.col("__now") == 1, " document.").otherwise(" documents."))
    change = F.when(F.col("__had").isNull(), first).otherwise(F.coalesce("text", F.lit("No change.")))
    if notes is not None:
        out = out.join(notes.select("corpus", "note"), "corpus", "left")
        change = F.concat(F.when(F.col("note") != "", F.concat("note", F.lit(" "))).otherwise(""), change)
    return out.select("corpus", change.alias("change"))


def list_versions(manifest: DataFrame, run_libraries: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Versions with their size, author and how many runs searched them."""
    used = run_libraries.groupBy("corpus", "version").agg(F.count(F.lit(1)).alias("runs"))
    out = manifest.join(used, ["corpus", "version"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    if users is not None:
        who = users.select(F.col("user_id").alias("changed_by"),
                           F.coalesce(F.nullif("name", F.lit("")), F.col("email")).alias("changed_by_name"))
        out = out.join(who, "changed_by", "left")
    return out


def versions_holding(members: DataFrame, documents: DataFrame) -> DataFrame:
    """The versions of its own library that hold each document."""
    return members.join(documents.select("corpus", "document_id"), ["corpus", "document_id"])


# ------------------------------------------------------------------ changing a library

def revert_plan(state: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """What reverting each library of `targets` (`corpus`, `version`) would put back and
    take out."""
    ids = members_at(members, targets).select("document_id", F.col("corpus").alias("__of"))
    back = state.filter("not live").join(ids, "document_id").withColumn("corpus", F.col("__of")).drop("__of")
    listed = members_at(members, targets).select("corpus", "document_id")
    mine = state.filter("live").join(targets.select("corpus").distinct(), "corpus", "left_semi")
    out = mine.join(listed, ["corpus", "document_id"], "left_anti")
    fields = ["corpus", "document_id", "title", "sha256", "created_at"]
    return back.select(*fields, F.lit("put_back").alias("action")).unionByName(
        out.select(*fields, F.lit("take_out").alias("action")))


def revert(log: DataFrame, members: DataFrame, targets: DataFrame, event_no: int) -> DataFrame:
    """The change log after a revert. Earlier versions stay as they were."""
    plan = revert_plan(current_state(log), members, targets)
    out = _changes(plan.filter("action = 'take_out'"), "removed", F.lit(event_no).cast("long"))
    back = _changes(plan.filter("action = 'put_back'"), "restored", F.lit(event_no + 1).cast("long"))
    return log.unionByName(out).unionByName(back)


def remove(log: DataFrame, ids: DataFrame, event_no: int) -> tuple[DataFrame, DataFrame]:
    """The log after taking documents (`corpus`, `document_id`) out, and those removed: only
    live documents of that library."""
    gone = live(log).join(ids.select("corpus", "document_id").distinct(), ["corpus", "document_id"], "left_semi")
    return log.unionByName(_changes(gone, "removed", F.lit(event_no).cast("long"))), gone


def move_status(state: DataFrame, moves: DataFrame) -> DataFrame:
    """What comes of each asked move (`document_id`, `target`): moved, refused because the
    text is there already, not in its library any more, or already there. The first of two
    copies of a text gets in."""
    asked = moves.withColumn("target", tx.tidy_name(F.col("target"))).join(state, "document_id")
    there = state.filter("live").groupBy(F.col("corpus").alias("target"), "sha256").agg(F.lit(True).alias("held"))
    asked = asked.join(there, ["target", "sha256"], "left")
    can = F.col("live") & (F.col("target") != F.col("corpus")) & F.col("held").isNull()
    first = asked.filter(can).groupBy("target", "sha256").agg(F.min("document_id").alias("document_id")).select(
        "target", "document_id", F.lit(True).alias("__first"))
    asked = asked.join(first, ["target", "document_id"], "left")
    return asked.withColumn("status", F.when(~F.col("live"), "not in its library").when(
        F.col("target") == F.col("corpus"), "already there").when(F.col("__first"), "moved")
        .otherwise("same text there")).drop("held", "__first")


def move(moved: DataFrame, chunks: DataFrame, first_document_id: int, first_chunk_id: int,
         event_no: int) -> tuple[DataFrame, DataFrame]:
    """Change-log rows and copied passages for the documents of `move_status` that moved."""
    going = moved.filter("status = 'moved'").withColumn("__all", F.lit(0))
    ids = with_position(going.select("__all", "document_id"), ["__all"], ["document_id"], "__k").select(
        "document_id", (F.col("__k") + (first_document_id - 1)).alias("new_id"))
    going = going.join(ids, "document_id")
    old = _changes(going, "moved", F.lit(event_no).cast("long"), F.col("new_id"))
    new = _changes(going.withColumn("document_id", F.col("new_id")).withColumn("corpus", F.col("target")),
                   "added", F.lit(event_no).cast("long"))
    carried = chunks.join(going.select("document_id", "new_id"), "document_id").withColumn("__all", F.lit(0))
    carried = with_position(carried.drop("document_id").withColumnRenamed("new_id", "document_id"),
                            ["__all"], ["document_id", "chunk_id"], "__k")
    carried = carried.withColumn("chunk_id", F.col("__k") + (first_chunk_id - 1)).drop("__k", "__all")
    return old.unionByName(new), carried


def retitle(log: DataFrame, titles: DataFrame, event_no: int) -> DataFrame:
    """The log with new titles (`document_id`, `title`), tidied; an empty one is refused."""
    wanted = titles.select("document_id", tx.tidy_name(F.col("title"), 300).alias("__new")).filter("__new <> ''")
    docs = current_state(log).join(wanted, "document_id").withColumn("title", F.col("__new"))
    return log.unionByName(_changes(docs, "retitled", F.lit(event_no).cast("long")))


def delete_libraries(names: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without every row of the named libraries."""
    return {n: t.join(names.select("corpus"), "corpus", "left_anti") for n, t in tables.items()}


def rename_library(old: str, new: str, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table with library `old` called `new`, and how many rows of each changed. A run
    that searched both keeps its row for the other; a setting left under the new name goes."""
    new = " ".join(new.split())[:120]
    if not new or new == old:
        raise ValueError("a library needs a new name")
    out, counts = {}, []
    hit = F.col("corpus") == old
    for name, t in tables.items():
        if name == "library_settings":
            t = t.filter(F.col("corpus") != new)
        if name == "run_libraries":
            clash = t.filter(F.col("corpus") == new).select("run_id").distinct().withColumn("__clash", F.lit(True))
            t = t.join(clash, "run_id", "left").withColumn("__hit", hit & F.col("__clash").isNull()).drop("__clash")
        elif name == "experiments":
            t = t.withColumn("__hit", _config_names(old))
        else:
            t = t.withColumn("__hit", F.coalesce(hit, F.lit(False)))
        counts.append(t.agg(F.count_if("__hit").alias("rows")).select(F.lit(name).alias("table"), "rows"))
        if name == "experiments":
            out[name] = rename_in_config(t, old, new).drop("__hit")
        else:
            out[name] = t.withColumn("corpus", F.when(F.col("__hit"), new).otherwise(F.col("corpus"))).drop("__hit")
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return out, total


def _config_names(name: str) -> Column:
    def has(arr):
        return F.coalesce(F.exists(arr, lambda x: tx.squeeze(x) == name), F.lit(False))

    agents = F.coalesce(F.exists("agents", lambda a: has(a["libraries"])), F.lit(False))
    return (has(F.col("libraries")) | F.coalesce(tx.squeeze(F.col("corpus")) == name, F.lit(False))
            | F.coalesce(tx.squeeze(F.col("fetch_library")) == name, F.lit(False)) | agents)


def rename_in_config(configs: DataFrame, old: str, new: str) -> DataFrame:
    """Experiment settings with the library renamed wherever they name it."""
    def swap(arr):
        return F.array_distinct(F.transform(arr, lambda x: F.when(tx.squeeze(x) == old, new).otherwise(x)))

    def one(c):
        return F.when(tx.squeeze(F.col(c)) == old, new).otherwise(F.col(c))

    return configs.withColumns({
        "libraries": swap(F.col("libraries")), "corpus": one("corpus"), "fetch_library": one("fetch_library"),
        "agents": F.transform("agents", lambda a: F.struct(a["id"].alias("id"), swap(a["libraries"]).alias("libraries")))})


def _followed(steps: DataFrame, names: int) -> tuple[DataFrame, DataFrame]:
    """Chains of (`name`, `to`), each name once, followed by pointer doubling: every round a name takes over where the
    name it points at has come to, so a chain of n steps takes log2(n) rounds, each of one join. Names that have come to an end are not
    joined again. First come the names with their `end`; then those that are still on their way after as many
    steps as there are names, which lead into a cycle, with the name on it that they have come to."""
    step = pinned(steps.select("name", "to", F.lit(True).alias("live")))
    ended = step.filter("not live").select("name", F.col("to").alias("end"))
    for _ in range(max(names, 1).bit_length()):
        ahead = step.select(F.col("name").alias("to"), F.col("to").alias("beyond"), F.col("live").alias("goes_on"))
        joined = step.filter("live").join(ahead, "to", "left").select(
            "name", F.coalesce("beyond", "to").alias("to"), F.coalesce("goes_on", F.lit(False)).alias("live"))
        step = pinned(joined.unionByName(step.filter("not live")))
        ended = step.filter("not live").select("name", F.col("to").alias("end"))
        if step.filter("live").isEmpty():
            break
    return ended, step.filter("live").select("name", F.col("to").alias("end"))


def current_names(renames: DataFrame) -> DataFrame:
    """Each former name and the name it goes by now. The last rename of a name counts; a
    chain that comes back to a name it has passed stops there.

    Chains into a cycle are those that have no end. The names they have come to after as many steps as there are names are all of the
    cycles'; those go by themselves again, and the others by the first of them they meet, which following once more with the
    cycles taken out finds."""
    last = pinned(renames.groupBy(F.col("old_name").alias("name")).agg(F.max_by("new_name", "rename_id").alias("to")))
    names = last.count()
    ended, looping = _followed(last, names)
    on_cycle = pinned(looping.select(F.col("end").alias("name")).distinct())
    if not on_cycle.isEmpty():
        toward = last.join(looping.select("name"), "name", "left_semi").join(on_cycle, "name", "left_anti")
        first, _ = _followed(toward, names)
        ended = ended.unionByName(first).unionByName(on_cycle.select("name", F.col("name").alias("end")))
    return ended.select(F.col("name").alias("old_name"), F.col("end").alias("new_name"))


# ------------------------------------------------------------------ lists and sizes

def chunk_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("content")).alias("chars"))


def documents_with_sizes(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = documents.join(chunk_sizes(chunks), "document_id", "left")
    return d.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "chars": F.coalesce("chars", F.lit(0))})


def document_passages(chunks: DataFrame, anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The passages of the wanted documents (`doc_id`) in the order they are read: `n` from 1, content and pages."""
    mine = chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").join(anchors, ["doc_id", "ordinal"], "left")
    return mine.select("doc_id", (F.col("ordinal") + 1).alias("n"), "content", "page_start", "page_end")


def library_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and passages of each library. Passages are counted per document first, so
    the join is one row to one."""
    return documents_with_sizes(documents, chunks).groupBy("corpus").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chunk_count").alias("chunks"), F.max("created_at").alias("last_added"))


def library_list(documents: DataFrame, chunks: DataFrame, manifest: DataFrame, uses: DataFrame,
                 settings: DataFrame) -> DataFrame:
    """Every library with size, version and use; emptied libraries stay while they have
    versions."""
    sizes = library_stats(documents, chunks)
    names = sizes.select("corpus").union(manifest.select("corpus")).distinct()
    used = uses.groupBy("corpus").agg(F.count_distinct("experiment_id").alias("experiments"))
    out = (names.join(sizes, "corpus", "left").join(latest_versions(manifest), "corpus", "left")
           .join(used, "corpus", "left"))
    out = out.withColumns({"experiments": F.when(F.col("documents").isNull(), 0).otherwise(F.coalesce("experiments", F.lit(0))),
                           "documents": F.coalesce("documents", F.lit(0)), "chunks": F.coalesce("chunks", F.lit(0))})
    return with_visibility(out, settings)


def with_visibility(libraries: DataFrame, settings: DataFrame) -> DataFrame:
    """`hidden`: the last setting made, else whether the name contains "test"."""
    last = settings.groupBy("corpus").agg(F.max_by("hidden", "changed_at").alias("__set"))
    return libraries.join(last, "corpus", "left").withColumn(
        "hidden", F.coalesce("__set", F.lower("corpus").contains("test"))).drop("__set")


# ------------------------------------------------------------------ experiments and runs

def names_of(libraries: Column, corpus: Column, mode: Column) -> Column:
    """The libraries a config names, tidied, in order, each once: its list, else the single
    older name, else "default" except in a role-play."""
    listed = F.filter(F.transform(libraries, lambda x: tx.tidy_name(x)), lambda x: x != "")
    one = tx.strip(F.coalesce(corpus, F.lit("")))
    old = (F.when(one != "", F.array(tx.tidy_name(one)))
           .when(mode == "roleplay", F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("default"))))
    return F.array_distinct(F.when(libraries.isNotNull(), listed).otherwise(old))


def case_files(agents: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(agents, F.expr("cast(array() as array<struct<id:string,libraries:array<string>>>)")),
                                 lambda a: F.coalesce(a["libraries"], F.expr("cast(array() as array<string>)"))))


def experiment_libraries(configs: DataFrame) -> DataFrame:
    """One row per experiment in use and library it draws on, case files included."""
    named = F.when(F.col("libraries").isNotNull(), F.col("libraries")).otherwise(F.array_compact(F.array(F.coalesce(
        "corpus", F.when(F.col("mode") != "roleplay", F.lit("default"))))))
    every = F.array_distinct(F.concat(named, case_files(F.col("agents"))))
    return (configs.filter(F.col("deleted_at").isNull())
            .select("experiment_id", "mode", F.explode(every).alias("corpus")).filter(F.col("corpus").isNotNull()))


def run_library_names(run: DataFrame) -> DataFrame:
    """`names`: what a run names, its own choice over the experiment's (columns `libraries`,
    `corpus`, `agents` and their `in_...` forms), with a role-play's case files after."""
    own = F.col("in_libraries").isNotNull() | F.col("in_corpus").isNotNull()
    base = F.when(own, names_of(F.col("in_libraries"), F.col("in_corpus"), F.col("mode"))).otherwise(
        names_of(F.col("libraries"), F.col("corpus"), F.col("mode")))
    files = F.filter(F.transform(case_files(F.coalesce("in_agents", "agents")), lambda x: tx.tidy_name(x)), lambda x: x != "")
    return run.withColumn("names", F.when(F.col("mode") == "roleplay", F.array_distinct(F.concat(base, files))).otherwise(base))


def wanted_versions(run: DataFrame) -> DataFrame:
    """`wanted` (library to version) and `error`: versions asked for by name, or the older
    single version when the run names one library."""
    asked = F.when(F.size(F.coalesce("library_versions", F.expr("cast(map() as map<string,string>)"))) > 0, F.col("library_versions")) \
        .when((F.coalesce("corpus_version", F.lit("")) != "") & (F.size("names") == 1),
              F.create_map(F.col("names")[0], F.col("corpus_version"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    mine = F.map_filter(asked, lambda k, v: F.array_contains(F.col("names"), k) & v.isNotNull() & (v != ""))
    bad = F.try_element_at(F.map_keys(F.map_filter(mine, lambda k, v: v.try_cast("int").isNull())), F.lit(1))
    return run.withColumns({
        "wanted": F.transform_values(mine, lambda k, v: v.try_cast("int")),
        "error": F.when(bad.isNotNull(), F.concat(F.lit("version '"), mine[bad], F.lit("' of the library “"), bad, F.lit("” is not a number")))})


def pin_libraries(run: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each library a run names at the version asked for, or its latest. A version that does
    not exist is an error; a library without documents or versions is pinned to none."""
    names = run.select("run_id", "wanted", F.posexplode("names").alias("position", "corpus"))
    last = latest_versions(manifest).select("corpus", F.col("version").alias("latest"))
    asked = names.select("run_id", "position", "corpus", F.col("wanted")[F.col("corpus")].alias("asked")).join(last, "corpus", "left")
    got = asked.withColumn("version", F.coalesce("asked", "latest")).join(
        manifest.select("corpus", "version", "documents"), ["corpus", "version"], "left")
    missing = F.col("asked").isNotNull() & F.col("documents").isNull()
    return got.withColumn("error", F.when(missing, F.concat(F.lit("the library “"), "corpus", F.lit("” has no version "),
                                                            F.col("asked").cast("string"))))


def runs_that_searched(run_libraries: DataFrame, runs: DataFrame, experiments: DataFrame) -> DataFrame:
    return (run_libraries.join(runs.select("run_id", "experiment_id", "status", "created_at"), "run_id")
            .join(experiments.select("experiment_id", F.col("name").alias("experiment_name")), "experiment_id"))


def profiles(documents: DataFrame, matches: DataFrame | None = None, titles: int = 25) -> DataFrame:
    """What a planner is told of each library: size, kinds of document, first titles, and
    the best match of a trial search (`corpus`, `title`, `similarity`, `rank`)."""
    kind = F.coalesce("provider", F.nullif("doc_type", F.lit("")), F.lit("document"))
    kinds = documents.groupBy("corpus", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("corpus").agg(F.sum("n").alias("documents"),
                                        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    first = best_per(documents.select("corpus", "document_id", "title"), ["corpus"], [F.col("document_id")], titles).groupBy(
        "corpus").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda t: t["title"]).alias("titles"))
    out = kinds.join(first, "corpus")
    if matches is not None:
        close = matches.groupBy("corpus").agg(
            F.bround(F.max("similarity"), 2).alias("match"),
            F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda t: t["title"])).alias("closest"))
        out = out.join(close, "corpus", "left").withColumn("match", F.coalesce("match", F.lit(0.0)))
    return out


def in_use(run_libraries: DataFrame, runs: DataFrame, crawls: DataFrame) -> DataFrame:
    """Libraries that may not change now, with how many runs and crawls hold them."""
    busy = run_libraries.join(runs.filter(F.col("status").isin("pending", "running")).select("run_id"), "run_id", "left_semi")
    r = busy.groupBy("corpus").agg(F.count(F.lit(1)).alias("runs"))
    c = crawls.filter(F.col("status").isin("running", "stopping")).groupBy("corpus").agg(F.count(F.lit(1)).alias("crawls"))
    return r.join(c, "corpus", "full").select("corpus", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("crawls", F.lit(0)).alias("crawls"))
