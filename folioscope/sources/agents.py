"""Cast files: Markdown that describes the people of a role-play, and perhaps the whole
experiment.

Files are cut into lines; headings open people and sections; everything else is grouping.
Windows here run over the lines of one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..scale import written

# What a section's heading says, and the field it stands for.
SECTIONS = {
    "role": "role", "position": "role", "title": "role", "party": "role",
    "objective": "goal", "objectives": "goal", "goal": "goal", "goals": "goal", "aim": "goal", "aims": "goal", "what they want": "goal",
    "background": "backstory", "backstory": "backstory", "back story": "backstory", "history": "backstory", "experience": "backstory",
    "biography": "backstory", "bio": "backstory", "background and history": "backstory",
    "demeanor": "demeanor", "demeanour": "demeanor", "temperament": "demeanor", "manner": "demeanor", "style": "demeanor",
    "personality": "demeanor", "tone": "demeanor",
    "tendencies": "tendencies", "behavioral tendencies": "tendencies", "behavioural tendencies": "tendencies", "behavior": "tendencies",
    "behaviour": "tendencies", "behaviors": "tendencies", "behaviours": "tendencies", "habits": "tendencies", "tactics": "tendencies",
    "priorities": "priorities", "interests": "priorities", "what they care about": "priorities", "what they care about most": "priorities",
    "concerns": "priorities", "values": "priorities",
    "bottom line": "bottom_line", "walk away point": "bottom_line", "walkaway point": "bottom_line", "walk away": "bottom_line",
    "reservation point": "bottom_line", "reservation price": "bottom_line", "batna": "bottom_line", "red lines": "bottom_line", "limits": "bottom_line",
    "confidential information": "confidential", "confidential": "confidential", "private information": "confidential", "private facts": "confidential",
    "secrets": "confidential", "secret information": "confidential", "what only they know": "confidential", "hidden information": "confidential",
    "model": "model", "language model": "model", "llm": "model", "ai model": "model", "played by model": "model",
    "case files": "libraries", "libraries": "libraries", "case file": "libraries", "own case files": "libraries", "library": "libraries",
    "private libraries": "libraries", "own sources": "libraries", "private sources": "libraries", "evidence": "libraries", "documents": "libraries",
    "played by": "played_by", "player": "played_by", "human": "played_by", "human player": "played_by", "participant type": "played_by",
    "additional notes": "notes", "notes": "notes", "other notes": "notes", "extra notes": "notes",
    "full prompt": "system_prompt", "system prompt": "system_prompt", "custom prompt": "system_prompt",
    "short id": "id", "id": "id",
}
FIELDS = tuple(dict.fromkeys(SECTIONS.values()))
LISTS = ("tendencies", "libraries")
# Headings that belong to the experiment, its settings and its source.
RESERVED = {
    "scenario": "scenario", "the scenario": "scenario",
    "settings": "settings", "role play settings": "settings", "roleplay settings": "settings", "experiment settings": "settings", "pacing": "settings",
    "source": "source", "drafted from": "source", "source material": "source",
    "cast": "cast", "the cast": "cast", "participants": "cast", "agents": "cast",
}
SETTINGS = {
    "max turns": "max_turns", "maximum turns": "max_turns", "turn limit": "max_turns", "maximum number of turns": "max_turns", "turns": "max_turns",
    "words per turn": "word_limit", "max words per turn": "word_limit", "maximum words per turn": "word_limit", "word limit": "word_limit", "words": "word_limit",
}
SOURCE = {
    "title": "title", "link": "url", "url": "url", "web address": "url", "address": "url", "site": "site", "website": "site", "publisher": "site",
    "published": "published", "publication date": "published", "date published": "published",
    "retrieved": "retrieved_at", "read": "retrieved_at", "accessed": "retrieved_at", "date read": "retrieved_at",
    "words": "words", "kind": "kind", "type": "kind", "shortened": "truncated", "truncated": "truncated",
    "sha 256": "sha256", "sha256": "sha256", "fingerprint": "sha256",
}
NONE_WORDS = ("none", "no", "n/a", "na", "nil", "-", "no case files")
DEFAULT_WORDS = (*NONE_WORDS, "default", "the default", "lab default", "default model")
PERSON_WORDS = ("person", "a person", "human", "a human", "human player", "a human player", "yes", "player", "participant", "a participant")
# The marks at the beginning of a list entry, and those around bold text.
ENTRY = r"[-*+•‣◦]|\d{1,3}[.)]"
BOLD = ("**", "__")


def _among(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def key_of(label: Column) -> Column:
    """A heading as a lookup key: "Walk-away point (private):" is "walk away point"."""
    outside = F.replace(F.lower(F.regexp_replace(label, r"\([^)]*\)", " ")), F.lit("&"), F.lit(" and "))
    return tx.squeeze(F.regexp_replace(outside, "[^a-z0-9]+", " "))


def section_of(label: Column) -> Column:
    """The field a heading stands for, forgiving a small typo; the full prompt only exactly."""
    forgiving = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("f")) for n, f in SECTIONS.items() if f != "system_prompt" and len(n) >= 6])

    def found(key):
        near = F.filter(forgiving, lambda e: F.startswith(key, e["n"]) | ((F.abs(F.length(key) - F.length(e["n"])) <= 2) & (F.levenshtein(key, e["n"], 2) >= 0)))
        return F.coalesce(_among(SECTIONS, key), F.when(F.length(key) >= 6, F.try_element_at(near, F.lit(1))["f"]))
    return tx.once(key_of(label), found)


def bare(c: Column) -> Column:
    """A heading's or name's own text, without marks of bold around it and colons behind it."""
    t = tx.strip(c)
    for mark in BOLD:
        t = tx.once(t, lambda t: F.when(t.startswith(mark) & t.endswith(mark) & (F.length(t) >= 4), tx.strip(F.substring(t, F.lit(3), F.length(t) - 4))).otherwise(t))      # noqa: B023
    return tx.strip(F.rtrim(t, F.lit(":")))


def line_form(raw: Column) -> Column:
    """What a line is: its `kind` (person, section, bold, rule, item, blank or plain), for a heading its level, and
    the text it carries."""
    def seen(x):
        t, level, uncoloned = x["t"], x["level"], x["uncoloned"]
        bold = F.lit(False)
        for mark in BOLD:
            bold = bold | (uncoloned.startswith(mark) & uncoloned.endswith(mark) & (F.length(uncoloned) > 4))
        kind = (F.when(level == 1, "person").when(level > 1, "section").when(t == "", "blank").when(t.rlike(r"^([-*_])(\s*\1){2,}$"), "rule")
                .when(bold, "bold").when(t.rlike(rf"^({ENTRY})\s"), "item").otherwise("plain"))
        return tx.once(kind, lambda kind: formed(t, level, uncoloned, kind))

    def formed(t, level, uncoloned, kind):
        heading = tx.strip(F.regexp_replace(F.substring(raw, level + 1, F.length(raw)), r"\s*#*\s*$", ""))
        text = F.when(level > 0, heading).when(kind == "rule", "").when(kind == "bold", F.substring(uncoloned, F.lit(3), F.length(uncoloned) - 4)).when(
            kind == "item", F.regexp_replace(t, rf"^({ENTRY})\s+", "")).otherwise(t)
        # A mark at the beginning that is not to be read as one has a backslash before it.
        said = F.when(kind == "rule", "").otherwise(F.regexp_replace(t, r"^\\(?=[#*_+-])", ""))
        return F.struct(kind.alias("kind"), level.alias("level"), text.alias("text"), said.alias("said"), (kind.isin("section", "bold") & t.endswith(":")).alias("colon"))

    level = F.length(F.regexp_extract(raw, r"^(#{1,6})(?=\s|[A-Za-z])", 1))
    return tx.once(tx.strip(raw), lambda t: tx.once(F.struct(t.alias("t"), level.alias("level"), F.when(t.endswith(":"), F.regexp_replace(t, r"\s*:$", "")).otherwise(t).alias("uncoloned")), seen))


def label_and_value(line: Column) -> Column:
    """Of a line "Label: value", the label perhaps in bold: `label` and `value`, or nulls."""
    marks = r"^(\*\*|__)|(\*\*|__)$"

    def judged(x):
        right = F.length(x["label"]).between(2, 40) & ~x["label"].rlike("[*_]") & (x["value"] != "")
        return F.struct(F.when(right, x["label"]).alias("label"), F.when(right, x["value"]).alias("value"))

    label = tx.strip(F.regexp_replace(tx.strip(F.substring_index(line, ":", 1)), marks, ""))
    value = tx.strip(F.regexp_replace(tx.strip(F.regexp_replace(line, r"^[^:]*:", "")), r"^(\*\*|__)", ""))
    return F.when(line.contains(":"), tx.once(F.struct(label.alias("label"), value.alias("value")), judged))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once for each row: the optimizer merges projections, but not across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def file_lines(files: DataFrame) -> DataFrame:
    """The lines of each file (`file`, `text`) by their form, with the person and section they stand in:
    `h1` and `title` or `block`, `sec`, `heading`."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"(?s)<!--.*?-->", ""), r"\r\n?", "\n")
    rows = files.select("file", F.posexplode(F.split(clean, "\n")).alias("pos", "raw"))
    rows = _held(rows, "form", line_form(F.col("raw"))).select("file", "pos", "form.*")
    # A line's text is mostly what it says, and is then carried once.
    rows = rows.withColumn("text", F.when(~F.col("text").eqNullSafe(F.col("said")), F.col("text")).otherwise(F.lit(None)))
    rows = rows.repartition("file").withColumn("text", F.coalesce("text", "said"))
    w = Window.partitionBy("file").orderBy("pos")
    known = _among(SECTIONS, key_of(bare(F.col("text"))))
    rows = rows.withColumn("field", F.when(F.col("kind").isin("section", "bold"), known))
    # A bold line or lower heading that reads as a name, with a section behind it, opens a person. Where people have headings of
    # their own, only before a role.
    rows = rows.withColumns({
        "has_people": F.max(F.col("kind") == "person").over(Window.partitionBy("file")),
        "next": F.first(F.when(F.col("kind") != "blank", F.struct("field")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))["field"]})
    name = bare(F.col("text"))
    is_name = (F.col("kind").isin("section", "bold") & ~F.col("colon") & tx.word_count(name).between(2, 8) & ~name.endswith(".") & F.col("field").isNull()
               & F.col("next").isNotNull() & ((F.col("next") == "role") | ~F.col("has_people")))
    rows = rows.withColumn("kind", F.when(F.coalesce(is_name, F.lit(False)), "person").otherwise(F.col("kind")))
    rows = rows.withColumn("is_h1", F.col("kind") == "person").withColumn("h1", F.sum(F.col("is_h1").cast("int")).over(w))
    per = Window.partitionBy("file", "h1").orderBy("pos")
    rows = rows.withColumn("title", F.first(F.when(F.col("is_h1"), bare(F.col("text"))), ignorenulls=True).over(per))
    rows = rows.withColumn("block", _among(RESERVED, key_of(F.col("title"))))
    opens = F.col("block").isNull() & ((F.col("kind") == "section") | ((F.col("kind") == "bold") & F.col("field").isNotNull()))
    rows = rows.withColumn("opens", opens).withColumn("sec", F.sum(F.col("opens").cast("int")).over(per))
    inside = Window.partitionBy("file", "h1", "sec").orderBy("pos")
    rows = rows.withColumn("heading", F.first(F.when(F.col("opens"), bare(F.col("text"))), ignorenulls=True).over(inside))
    # Every reader below goes through the lines several times.
    rows = rows.filter(F.col("h1") > 0).withColumn("other", F.when(F.col("text") != F.col("said"), F.col("text")))
    kept = written(rows.select("file", "pos", "kind", "other", "said", "is_h1", "h1", "title", "block", "opens", "sec", "heading"))
    return kept.withColumn("text", F.coalesce("other", "said")).select("file", "pos", "kind", "text", "said", "is_h1", "h1", "title", "block", "opens", "sec", "heading")


def joined_text(lines: DataFrame, keys: list[str], name: str, paragraphs: Column | None = None) -> DataFrame:
    """The lines of each group in one text `name`, with the first `pos`. Of blank lines between others one stays, where there
    are to be paragraphs."""
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos"))
    before = F.when(gap.isNull(), "").when((gap > 1) if paragraphs is None else (gap > 1) & paragraphs, "\n\n").otherwise("\n")
    parts = lines.filter("said <> ''").withColumn("part", F.concat(before, "said"))
    return parts.groupBy(*keys).agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias(name))


def entries(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The list entries of each group as `items`: a line without a mark goes on with the entry before it, and is one by itself
    where no marked one is before it."""
    w = Window.partitionBy(*keys).orderBy("pos")
    some = lines.filter("said <> ''").withColumn("marked", F.sum((F.col("kind") == "item").cast("int")).over(w))
    some = some.withColumn("entry", F.sum(((F.col("kind") == "item") | (F.col("marked") == 0)).cast("int")).over(w))
    part = F.when(F.col("kind") == "item", F.regexp_replace("text", r"^\\(?=[#*_+-])", "")).otherwise(F.col("said"))
    whole = some.groupBy(*keys, "entry").agg(tx.squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), " ")).alias("item"))
    return whole.filter("item <> ''").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "item"))), lambda x: x["item"]).alias("items"))


def agent_fields(lines: DataFrame) -> DataFrame:
    """One row per person and field (`file`, `h1`, `title`, `field`, `value`, `items`), in the
    order the file gives them; text that fits no section is kept under notes."""
    keys = ["file", "h1", "title", "seg"]
    body = lines.filter("block is null and not is_h1 and not opens")
    # Only lines before the sections are asked for a label.
    body = _held(body, "pair", F.when(F.col("sec") == 0, label_and_value(F.col("said"))))
    body = body.withColumns({"own": F.when(_among(SECTIONS, key_of(F.col("pair.label"))).isNotNull(), F.col("pair.label")), "value": F.col("pair.value")})
    # The lines of a section are a segment, each labelled line before the sections is one, and what else stands there is the last.
    seg = F.when(F.col("sec") > 0, F.col("sec")).when(F.col("own").isNotNull(), -1 - F.col("pos")).otherwise(0)
    body = body.select("file", "h1", "title", "pos", "kind", "text", seg.alias("seg"), F.coalesce("own", F.when(F.col("sec") > 0, F.col("heading"))).alias("label"),
                       F.when(F.col("own").isNotNull(), F.col("value")).otherwise(F.col("said")).alias("said"))
    field = section_of(F.col("label"))
    labels = body.groupBy(*keys).agg(F.max("label").alias("label")).withColumn("field", field)
    rows = joined_text(body, keys, "said", F.col("seg") > 0).join(labels, keys)
    listed = body.join(labels.filter(F.col("field").isin(*LISTS)).select(*keys), keys, "left_semi")
    rows = rows.join(entries(listed, keys), keys, "left")
    kept_as_note = F.when(F.col("label").isNull(), F.col("said")).when(F.contains("said", F.lit("\n")), F.concat("label", F.lit(":\n"), "said")).otherwise(
        F.concat("label", F.lit(": "), "said"))
    return rows.select("file", "h1", "title", F.when(F.col("seg") == 0, 2_000_000_000).otherwise(F.col("pos")).alias("pos"), F.coalesce("field", F.lit("notes")).alias("field"),
                       F.when(F.col("field").isNull(), kept_as_note).otherwise(F.col("said")).alias("value"), "items", F.col("field").isNull().alias("unknown"), "label")


def agents(lines: DataFrame, default_model: str = "") -> DataFrame:
    """One row per person with every field as a column, tidied: "None" and "Default" mean
    leaving a field out, "a person" under "Played by" a human player."""
    keys = ["file", "h1", "title"]
    # Written, so that what was dealt out for it goes, and dealt out once for both steps below.
    f = written(agent_fields(lines)).repartition(*keys)
    per = f.groupBy(*keys, "field").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "\n\n").alias("value"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "items"))), lambda x: F.coalesce(x["items"], F.expr("cast(array() as array<string>)")))).alias("items"))
    people = lines.filter("block is null and is_h1").select(*keys).distinct()
    cols = [F.max(F.when(F.col("field") == n, F.col("items" if n in LISTS else "value"))).alias(n) for n in FIELDS]
    wide = people.join(per.groupBy(*keys).agg(*cols), keys, "left")

    def word(c):
        return F.regexp_replace(tx.squeeze(F.lower(c)), r"\.+$", "")

    named = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Unnamed agent "), "h1"))
    model = F.when(word(F.col("model")).isin(*DEFAULT_WORDS), None).otherwise(
        F.when(F.regexp_replace("model", "^.*/", "").contains(":"), tx.squeeze(F.col("model"))).otherwise(F.concat(tx.squeeze(F.col("model")), F.lit(":latest"))))
    person = F.when(word(F.col("played_by")).isin(*PERSON_WORDS), "person")
    libs = F.filter("libraries", lambda x: ~word(x).isin(*NONE_WORDS))
    model = F.when(person.isNull(), F.nullif(model, F.lit(default_model)))
    return wide.withColumns({"name": named, "model": model, "played_by": person,
                             "libraries": F.when(F.size(libs) > 0, libs)}).drop("title")


def with_ids(people: DataFrame) -> DataFrame:
    """People of all files as one cast with ids of their own. They are written before the ids are given out, by their names alone."""
    from ..operators.documents import assign_ids
    base = written(people.withColumn("__row", F.monotonically_increasing_id()))
    named = base.select("__row", "file", "h1", F.coalesce("id", "name").alias("id_or_name"), F.lit(0).alias("cast_id"))
    ids = assign_ids(named, ["cast_id"], ["file", "h1"], "id_or_name").select("__row", "agent_id")
    return base.join(ids, "__row").drop("__row", "id")


def experiment(lines: DataFrame) -> DataFrame:
    """Scenario, settings and source of the first experiment file by name."""
    blocks = lines.filter("block is not null and not is_h1")
    firsts = lines.filter("block in ('scenario', 'settings', 'source')").agg(F.min("file").alias("file"))
    b = blocks.join(firsts, "file")
    scenario = joined_text(b.filter("block = 'scenario'"), ["file", "h1"], "t").groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h1", "t"))), lambda x: x["t"]), "\n\n").alias("scenario"))
    pairs = _held(b.filter(F.col("block").isin("settings", "source")), "pair", label_and_value(F.when(F.col("kind") == "item", F.col("text")).otherwise(F.col("said"))))
    pairs = pairs.select("file", "block", "pos", key_of(F.col("pair.label")).alias("key"), F.col("pair.value").alias("value")).filter("value is not null")
    number = F.replace(F.regexp_extract("value", r"(\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("int")
    settings = pairs.filter("block = 'settings'").select("file", "pos", _among(SETTINGS, F.col("key")).alias("k"), number.alias("n")).filter("k is not null and n is not null")
    source = pairs.filter("block = 'source'").withColumn("k", _among(SOURCE, F.col("key"))).filter(F.col("k").isNotNull() & (
        (F.col("k") != "url") | F.lower("value").rlike("^https?://")))
    s = settings.groupBy("file").agg(*[F.max_by("n", F.when(F.col("k") == k, F.col("pos"))).alias(k) for k in dict.fromkeys(SETTINGS.values())])
    o = source.groupBy("file").agg(*[F.max_by("value", F.when(F.col("k") == k, F.col("pos"))).alias(f"source_{k}") for k in dict.fromkeys(SOURCE.values())])
    return firsts.join(scenario, "file", "left").join(s, "file", "left").join(o, "file", "left")
