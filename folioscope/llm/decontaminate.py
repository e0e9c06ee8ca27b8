"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question with other numbers has the
same template. Windows of template words of the benchmark items are hash-joined with windows of
the documents at every word; at each place found, the document is laid beside the whole item,
word by word. Runs of equal template words are judged each by itself: an item's value must stand
for one value of the document, but for a single slot or in a run that is nearly word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import held, own_keys, repeats_ids, stored

WINDOW = 8                 # words of a window
LITERAL = 4                # words of a window that must not be placeholders, at least
SHARE = 0.5                # of an item's words that a document must hold, or
LONG = 20                  # equal words in one run
VERBATIM = 0.8             # of a run's words that are equal: it counts whatever its slots
_BROADCAST_ROWS = 500_000
#: Units after a number.
UNITS = ("km/h", "mph", "km", "kg", "mg", "cm", "mm", "ml", "lb", "lbs", "oz", "ft", "kb", "mb", "gb", "hz", "kw", "m", "g", "l", "s", "h", "usd", "eur", "dollars", "dollar", "euros",
         "euro", "cents", "pounds", "percent", "meters", "metres", "miles", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "degrees", "liters", "litres", "grams")
_NUMBER = r"[0-9]+(?:[.,:][0-9]+)*"
_NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;]\x20.)\p{L}*"
_SPLIT = r"[\x00\x05-\x2F\x3A-\x40\x5B-\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\u2000-\u206F\u3000-\u3002]+"
_MARK = r"[\u0001-\u0003]"


def template_words(text: Column, *, values: bool) -> Column:
    """The words of a text: lower case, or a mark of its type for a number (1), unit (2) or name
    (3, a capital inside a sentence). With `values`, a mark is followed by what it stands for.
    Texts without digits, the most, are not searched for numbers and units."""
    unit = "|".join(u.replace("/", r"\/") for u in UNITS)
    text = F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, " \u0003$0 " if values else " \u0003 ")
    numbers = F.regexp_replace(text, _NUMBER, " \u0001$0 ")
    numbers = F.regexp_replace(numbers, rf"(?<=[0-9]\x20)\x20?(?i:({unit})(?![\p{{L}}\p{{N}}])|(%))", "\u0002$1$2 " if values else "\u0002 ")
    # A value is one word: what joins its digits becomes a letter.
    numbers = F.regexp_replace(numbers, r"(?<=[0-9])[.,:](?=[0-9])", "p") if values else F.regexp_replace(numbers, rf"(?<=\u0001){_NUMBER}", "")
    text = F.when(text.rlike("[0-9]"), numbers).otherwise(text)
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


def _template(word: Column) -> Column:
    return F.when(word.rlike(rf"^{_MARK}"), F.substring(word, 1, 1)).otherwise(word)


def _windows(words: Column, width: int) -> Column:
    """(at, h) of the windows of `width` words at each word."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, width)).alias("h"))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW, share: float = SHARE, long: int = LONG) -> DataFrame:
    """(id, item_id, n_words, n_found, n_slots): the documents that hold at least `share` of an
    item's template words in its order, or `long` of its words in one run, once for each item.

    A run is `window` or more template words in a row, wherever it stands; an item shorter than a
    window is looked for as a whole. A run counts if at most one of its slots has a second value,
    or if most of its words are equal to the letter. Beside it count words in shorter runs whose
    slots do not contradict it. An item or document without words, or with a null text, matches nothing, and so does
    an item that is nearly all placeholders. Rows that repeat an id, null or not, are documents of their own if
    their texts differ, and each is returned. No documents or no items give no rows. Other columns are not read.
    """
    if docs.filter(F.col(id_col).isNull()).limit(1).count() or repeats_ids(docs, id_col):
        keyed = own_keys(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
        found = contaminated(keyed, benchmark, "__key", "__text", item_col, item_text_col, window, share, long).withColumnRenamed("__key", "__of")
        return found.join(keyed.select("__key", "__id"), F.col("__of") == F.col("__key")).select(F.col("__id").alias(id_col), item_col, "n_words", "n_found", "n_slots")
    items = benchmark.select(F.col(item_col).alias("item_id"), template_words(F.col(item_text_col), values=True).alias("item"))
    items = stored(items.filter(F.size("item") > 0).withColumn("n_words", F.size("item")))
    widths = [r["w"] for r in items.select(F.least("n_words", F.lit(window)).alias("w")).distinct().collect()]     # at most `window` numbers
    found = None
    for width in sorted(widths):
        here = items.filter(F.least("n_words", F.lit(window)) == width).select("item_id", F.transform("item", _template).alias("words"))
        here = held(here, "own", F.col("words"))
        keys = here.select("item_id", "own", F.explode(_windows(F.col("own"), width)).alias("w")).select(
            "item_id", F.col("w.at").alias("item_at"), F.col("w.h").alias("h"), F.slice("own", F.col("w.at") + 1, F.lit(width)).alias("in_it"))
        literal = F.size(F.filter("in_it", lambda w: ~w.rlike(rf"^{_MARK}")))
        keys = stored(keys.filter(literal >= min(LITERAL, max(1, width - 1))).select("item_id", "item_at", "h"))
        places = held(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "words", template_words(F.col("text"), values=False))
        places = places.select("id", F.explode(_windows(F.col("words"), width)).alias("w"))
        places = places.select("id", F.col("w.at").alias("at"), F.col("w.h").alias("h"))
        keys = F.broadcast(keys) if keys.count() <= _BROADCAST_ROWS else keys
        some = places.join(keys, "h").select("id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        found = some if found is None else found.unionByName(some)
    kind = docs.schema[id_col].dataType.simpleString()
    if found is None:
        return items.select(F.expr(f"cast(null as {kind})").alias(id_col), F.col("item_id").alias(item_col), "n_words", F.lit(0).alias("n_found"), F.lit(0).alias("n_slots")).limit(0)
    found = stored(found.distinct())
    rows = found.count()
    near = found.withColumnRenamed("id", "__id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    laid = texts.join(F.broadcast(near) if rows <= _BROADCAST_ROWS else near, texts["id"].eqNullSafe(F.col("__id"))).drop("__id")
    laid = held(laid.join(items, "item_id"), "words", template_words(F.col("text"), values=True))
    at = lambda k: F.when(k + F.col("shift") >= 0, F.get("words", k + F.col("shift")))                            # noqa: E731
    cells = F.transform("item", lambda w, k: F.struct(k.alias("k"), w.alias("ours"), at(k).alias("theirs")))
    same = F.filter(cells, lambda c: _template(c["ours"]) == _template(c["theirs"]))
    laid = held(laid, "same", same).select("id", "item_id", "n_words", "shift", "same")
    # Cells next to each other differ as much in k as in their place among the equal ones.
    of_run = laid.select("id", "item_id", "n_words", "shift", F.posexplode("same").alias("i", "c"))
    slot = F.col("c.ours").rlike(rf"^{_MARK}")
    runs = of_run.groupBy("id", "item_id", "n_words", "shift", (F.col("c.k") - F.col("i")).alias("run")).agg(
        F.collect_list("c").alias("cells"), F.count(F.lit(1)).alias("n"), F.sum((F.col("c.ours") == F.col("c.theirs")).cast("int")).alias("equal"),
        F.collect_set(F.when(slot, F.struct(F.col("c.ours").alias("a"), F.col("c.theirs").alias("b")))).alias("slots"))
    second = F.size("slots") - F.size(F.array_distinct(F.transform("slots", lambda p: p["a"])))
    whole = F.col("n") >= F.least("n_words", F.lit(window))
    runs = runs.withColumn("good", F.when(whole, (second <= 1) | (F.col("equal") >= F.col("n") * VERBATIM)))
    good = F.col("good").eqNullSafe(F.lit(True))
    places = runs.groupBy("id", "item_id", "n_words", "shift").agg(
        F.flatten(F.collect_list(F.when(good, F.col("cells")))).alias("cells"), F.flatten(F.collect_list(F.when(F.col("good").isNull(), F.col("cells")))).alias("more"),
        F.array_distinct(F.flatten(F.collect_list(F.when(good, F.col("slots"))))).alias("slots"), F.max(F.when(good, F.col("equal"))).alias("longest"))
    places = places.filter(F.size("cells") > 0)
    agrees = lambda c: ~F.exists("slots", lambda p: (p["a"] == c["ours"]) & (p["b"] != c["theirs"]))                   # noqa: E731
    ks = F.transform(F.concat("cells", F.filter("more", agrees)), lambda c: c["k"])
    counted = places.select("id", "item_id", "n_words", "longest", F.size("slots").alias("n_slots"), F.explode(ks).alias("k"))
    counted = counted.groupBy("id", "item_id", "n_words").agg(F.count_distinct("k").cast("int").alias("n_found"), F.max("n_slots").alias("n_slots"), F.max("longest").alias("longest"))
    enough = (F.col("n_found") >= F.col("n_words") * share) | (F.col("longest") >= long)
    return counted.filter(enough).select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "n_words", "n_found", "n_slots")
