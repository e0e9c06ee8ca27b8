"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

One first-order model is trained on samples labelled as secrets, one on ordinary identifiers. A
token is a secret if random strings explain its characters better by a margin for each character.
Everything is a column expression; the two models meet the texts as one array of ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import held

#: The patterns, in the order of their kinds. A match counts from so many characters of its group on.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
WORD_SAMPLE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{3,}"
SAMPLE_ROWS = 4_000          # about so many documents give the labelled samples
PRIOR = 16.0                 # weight of the characters' own frequencies, in pairs seen
MARGIN = 0.5                 # nats for each character
KINDS = (*[p[0] for p in PATTERNS], "markov")
_N = len(ALPHABET) + 1       # state 0: before the first character


def _sum(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def with_matches(df: DataFrame, text: Column, patterns: tuple, name: str) -> DataFrame:
    """`df` with `name`: for each pattern its leftmost non-overlapping matches that are long
    enough, as an array of (start, kind, end, value) in code points; all in one array by start,
    then kind.

    The parts between matches and the matches take turns, so places are running sums of their
    lengths. The sums go in two levels, so that a text with very many matches stays cheap.
    """
    df = held(df, "__hits", F.struct(*[text.rlike(pattern).alias(f"hit{k}") for k, (_, pattern, _, _) in enumerate(patterns)]))
    cut = []
    for k, (_, pattern, group, _) in enumerate(patterns):
        hit = F.col(f"__hits.hit{k}")
        found = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        own = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else found
        lens = F.zip_with(F.split(text, pattern, -1), F.concat(F.array(F.lit("")), found), lambda between, before: (F.length(between) + F.length(before)).cast("long"))
        cut += [found.alias(f"found{k}"), own.alias(f"own{k}"), F.when(hit, lens).alias(f"lens{k}")]
    df = held(df, "__cut", F.struct(*cut))
    df = held(df, "__sums", F.struct(*[_block_sums(F.col(f"__cut.lens{k}")).alias(f"sums{k}") for k in range(len(patterns))]))
    spans = [_spans(F.col(f"__cut.found{k}"), F.col(f"__cut.own{k}"), F.col(f"__cut.lens{k}"), F.col(f"__sums.sums{k}"), k, least)
             for k, (_, _, _, least) in enumerate(patterns)]
    return held(df, name, F.array_sort(F.concat(*spans))).drop("__hits", "__cut", "__sums")


def _blocks(lens: Column) -> tuple[Column, Column]:
    """The size of a block of the lengths, and the numbers of the blocks."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lens).cast("double"))).cast("int"))
    return step, F.sequence(F.lit(0), F.ceil(F.size(lens) / step).cast("int") - 1)


def _block_sums(lens: Column) -> Column:
    step, blocks = _blocks(lens)
    return F.when(lens.isNotNull(), F.transform(blocks, lambda b: _sum(F.slice(lens, b * step + 1, step))))


def _spans(found: Column, own: Column, lens: Column, sums: Column, kind: int, least: int) -> Column:
    step, blocks = _blocks(lens)
    starts = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.sequence(F.lit(1), F.least(step, F.size(lens) - b * step)),
        lambda n: _sum(F.slice(sums, F.lit(1), b)) + _sum(F.slice(lens, b * step + 1, n)))))
    marks = F.transform(F.arrays_zip(F.slice(starts, F.lit(1), F.size(found)).alias("start"), found.alias("found"), own.alias("value")), lambda s: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["found"])).cast("long").alias("end"), s["value"].alias("value")))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)")
    return F.when(found.isNotNull(), F.filter(marks, lambda s: F.length(s["value"]) >= least)).otherwise(none)


def labelled_samples(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(token, secret) from about `rows` documents, chosen by a digest of their text: values of
    the fixed patterns, and words of the texts without any."""
    share = max(1, docs.count() // rows)
    some = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(share)) == 0)
    some = with_matches(some, F.col("t"), PATTERNS, "spans")
    words = F.when(F.size("spans") == 0, F.array_distinct(F.regexp_extract_all("t", F.lit(WORD_SAMPLE), F.lit(0))))
    return (some.select(F.explode(F.transform("spans", lambda s: s["value"])).alias("token"), F.lit(True).alias("secret"))
            .unionByName(some.select(F.explode(words).alias("token"), F.lit(False).alias("secret"))))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of each pair (state, next character), secrets over identifiers, from
    (token, secret). After a state that was seldom seen, a character is as likely as it is anywhere
    in the model's samples; every character counts one more than it was seen there, so that without
    samples both models are uniform. The result has a fixed size."""
    chars = F.filter(F.split("token", ""), lambda c: c != "")
    pairs = samples.filter("token IS NOT NULL AND secret IS NOT NULL").select("secret", F.explode(
        F.transform(chars, lambda c, i: F.struct(F.coalesce(F.get(chars, i - 1), F.lit("")).alias("a"), c.alias("b")))).alias("p"))
    counts = {(r["secret"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("secret", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.length("a") <= 1).filter((F.col("a") == "") | F.lit(ALPHABET).contains(F.col("a"))).filter(F.lit(ALPHABET).contains(F.col("b"))).collect()}
    states = ["", *ALPHABET]
    logs = {}
    for s in (True, False):
        alone = {b: 1 + sum(counts.get((s, a, b), 0) for a in states) for b in ALPHABET}
        every = sum(alone.values())
        for a in states:
            seen = sum(counts.get((s, a, b), 0) for b in ALPHABET)
            for b in ALPHABET:
                logs[s, a, b] = math.log((counts.get((s, a, b), 0) + PRIOR * alone[b] / every) / (seen + PRIOR))
    out = [0.0] * (_N * _N)
    for i, a in enumerate(states):
        for j, b in enumerate(ALPHABET, 1):
            out[i * _N + j] = round(logs[True, a, b] - logs[False, a, b], 4)
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """The summed log-likelihood ratio of a token of the alphabet."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")          # folded to one constant
    state = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))            # noqa: E731
    return F.aggregate(F.sequence(F.lit(1), F.length(token)), F.lit(0.0), lambda acc, i: acc + F.get(
        table, F.when(i > 1, state(i - 1)).otherwise(0) * _N + state(i)))


def find_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per document: id and `secrets`, an array of (start, kind, end, value) by start,
    then kind. Kind 3 is the model's: a token of 16 or more characters that meets no span of the
    fixed patterns, holds a letter and a digit, and has a ratio of `margin` for each
    of its characters. Places are code points, end exclusive. A null text is empty and has none;
    rows that repeat come out as often as they come in; other columns are not read.
    """
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = with_matches(found, F.col("__text"), (*PATTERNS, ("markov", TOKEN, 0, 16)), "__spans").drop("__text")
    kind = len(PATTERNS)
    found = held(found, "__base", F.filter("__spans", lambda s: s["kind"] < kind))
    free = lambda t: (~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))                  # noqa: E731
                      & t["value"].rlike("[0-9]") & t["value"].rlike("[A-Za-z]") & (ratio(t["value"], model) >= F.length(t["value"]) * margin))
    return found.select(F.col(id_col), F.filter("__spans", lambda t: F.when(t["kind"] < kind, True).otherwise(free(t))).alias("secrets"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each kind, the digest of the fixed patterns' spans, and all spans as text."""
    found = held(found, "secrets_", F.col("secrets")).drop("secrets").withColumnRenamed("secrets_", "secrets")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")     # noqa: E731
    base = F.filter("secrets", lambda s: s["kind"] < len(PATTERNS))
    return found.select(id_col, *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
