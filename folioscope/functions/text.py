"""Column functions over text. Everything stays in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..settings import DEFAULTS

# List words, file-name endings and scanner labels that are no title.
JUNK_TITLE = (
    r"(?iU)^(untitled|document\d*|microsoft word\b.*|.*\.(docx?|pdf|rtf|odt|indd|qxd|tmp)|"
    r"pdf|download|click here|here|link|view|open|read( more)?|full text|\[?pdf icon\]?|"
    r"\d+(\.\d+)? ?[km]b|scan\w*|img\w*|[\W\d_]*)$")
# Words that open a licence or copyright statement.
LICENCE_SENTENCE = (
    r"(?i)(?:[^.\n]|\.(?=\S)){0,160}(?:licen[cs]ed under|creative commons|public domain|"
    r"all rights reserved|for free distribution|copyright|©)(?:[^.\n]|\.(?=\S)){0,220}\.?")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once for a row. Named by itself in a lambda, or several times, it would be
    computed again for each element and each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """One line, single spaces."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """The white-space separated words; an empty array for blank text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def without_nul(c: Column) -> Column:
    return F.translate(c, "\x00", "")


def normalize(c: Column) -> Column:
    """Line ends to LF, zero-width spaces and NULs gone, single spaces, one blank line
    between paragraphs."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.translate(c, "​\x00", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"(?U)\n[ \t]*\n\s*", "\n\n"))


def is_readable(c: Column) -> Column:
    """Whether a page's text is text, and not what a font without a character map gives."""
    t = strip(c)
    n = F.length(t)
    controls = F.length(F.regexp_replace(t, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    solid = F.length(F.regexp_replace(t, r"(?U)\s+", ""))
    return (F.when(n < 40, True)
            .when((controls / n > 0.02) | t.contains("(cid:"), False)
            .when(solid / F.greatest(word_count(t), F.lit(1)) > 18, False)
            .otherwise(letters / n > 0.35))


def strip_tags(c: Column) -> Column:
    """Markup flattened to text with paragraph breaks. Entities are left as they are; see
    `operators.documents.unescape` for those."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/head)\s*/?>", "\n\n")
    return F.regexp_replace(c, r"<[^>]+>", " ")


def closed_references(c: Column) -> Column:
    """Markup in which only character references that end with a semicolon are references; a lone & is written out."""
    return F.regexp_replace(c, r"&(?!(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def tidy_lines(c: Column) -> Column:
    """Single spaces, each line stripped, at most one blank line in a row."""
    c = F.regexp_replace(c, r"[ \t\r\f\x0b]+", " ")
    c = F.regexp_replace(c, r"(?mU)^[^\S\n]+|[^\S\n]+$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fingerprint(c: Column) -> Column:
    return F.sha2(without_nul(c), 256)


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / F.lit(3.5)).cast("int"))


def usable_title(c: Column) -> Column:
    """The title tidied, or "" if it says nothing about the document."""
    t = F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, 300)
    return F.when((F.length(t) < 3) | t.rlike(JUNK_TITLE), "").otherwise(t)


def title_from_url(path: Column) -> Column:
    """A name from the last segment of a URL's path, first letter capital."""
    seg = F.try_url_decode(F.regexp_extract(path, r"([^/]*)/*$", 1))
    stem = F.when(seg.rlike(r"^.+\.[^.]+$"), F.regexp_replace(seg, r"\.[^.]*$", "")).otherwise(seg)
    t = F.lower(strip(F.regexp_replace(stem, "[-_]+", " ")))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))


def first_words(c: Column, limit: int) -> Column:
    """The first `limit` words with the breaks between them as they were; "" for blank text.
    Words and breaks take turns, so a text of any number of words is put together in one go."""
    body = strip(c)
    breaks = F.regexp_extract_all(body, F.lit(r"(?U)\s+"), F.lit(0))
    parts = F.zip_with(F.concat(F.array(F.regexp_extract(c, r"(?U)^\s*", 0)), F.slice(breaks, 1, limit - 1)), F.slice(F.split(body, r"(?U)\s+"), 1, limit), lambda gap, word: F.concat(gap, word))
    return F.when(body == "", "").otherwise(F.array_join(parts, ""))


def quoted(c: Column) -> Column:
    """The text as a regular expression that matches itself, whatever it holds."""
    return F.regexp_replace(c, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def truncate_words(c: Column, limit: int) -> Column:
    return F.when(word_count(c) <= limit, c).otherwise(
        F.concat(F.array_join(F.slice(words(c), 1, limit), " "), F.lit(" ...")))


def cut_at_word(c: Column, limit: int, ellipsis: str) -> Column:
    """Cut to `limit` characters, back to the last space, with an ellipsis."""
    head = F.substring(c, 1, limit)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit(ellipsis)))


def excerpt(c: Column, limit: int = DEFAULTS.excerpt_chars) -> Column:
    return cut_at_word(strip(c), limit, " …")


def snippet(c: Column, width: int = 170) -> Column:
    """The start of a marked-up answer as one plain line."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"),
                     lambda x: ~F.ltrim(x).startswith("#"))
    plain = squeeze(F.regexp_replace(F.array_join(lines, " "), "[*_`]+", ""))
    return cut_at_word(plain, width, "…")


def unsort_title(c: Column) -> Column:
    """"Title, The (…)" as "The Title (…)"."""
    return F.regexp_replace(c, r"^(.+?), (The|A|An)(\s*\(.*)?$", "$2 $1$3")


def slug(c: Column) -> Column:
    """A lower-case ASCII id of at most 40 characters."""
    # Latin letters with marks and their plain forms.
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
    s = F.regexp_replace(F.translate(c, marked, plain), r"[^\x00-\x7f]", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9_]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 40), "^-+|-+$", "")
    return F.when(s == "", "agent").otherwise(s)


def tidy_name(c: Column, limit: int = 120) -> Column:
    return F.substring(squeeze(c), 1, limit)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def long_date(c: Column) -> Column:
    """"1994-11-18…" as "November 18, 1994"; anything else unchanged."""
    d = F.try_to_date(F.substring(strip(c), 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else \
        F.to_date(F.try_to_timestamp(F.substring(strip(c), 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(d, "MMMM d, yyyy"), strip(c), F.lit(""))


def licence_sentence(c: Column) -> Column:
    """The first sentence stating a licence or copyright, tidied, or ""."""
    found = F.regexp_extract(c, LICENCE_SENTENCE, 0)
    return F.regexp_replace(squeeze(found), r"\s+([.,;:])", "$1")


def elapsed_text(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("bigint"))
    minutes = F.floor(s / 60)
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
            .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "),
                                F.pmod(minutes, F.lit(60)).cast("string"), F.lit(" min"))))


def block_step(lens: Column) -> Column:
    """The block size of `running_before`: the root of the number of elements."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lens).cast("double"))).cast("int"))


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def block_sums(lens: Column) -> Column:
    """Sums of the blocks of an array column of numbers."""
    step = block_step(lens)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(lens) / step).cast("int")), lambda b: _total(F.slice(lens, b * step + 1, step)))


def running_before(lens: Column, sums: Column) -> Column:
    """For each element the sum of those before it. `lens` and `sums` (its `block_sums`) are columns
    of the row, not expressions, so that a step reads them and does not make them again."""
    step = block_step(lens)
    return F.transform(lens, lambda _, i: _total(F.slice(sums, F.lit(1), F.floor(i / step).cast("int")))
                       + _total(F.slice(lens, F.floor(i / step).cast("int") * step + 1, i % step)))
