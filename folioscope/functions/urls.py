"""Column functions over web addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name endings of links worth reading.
PAGE_ENDINGS = ("", ".html", ".htm", ".xhtml", ".php", ".asp", ".aspx", ".jsp", ".cfm", ".shtml")
TEXT_ENDINGS = (".txt", ".md")


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def hostname(c: Column) -> Column:
    """Lower-case host without user, port or brackets."""
    bare = F.regexp_replace(authority(c), "^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1))
                   .otherwise(F.regexp_replace(bare, r":\d*$", "")))


def host(c: Column) -> Column:
    """The host without a leading "www."."""
    return F.regexp_replace(hostname(c), r"^www\.", "")


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_string(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def without_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def same_site(a: Column, b: Column) -> Column:
    return (host(a) != "") & (host(a) == host(b))


def folder(c: Column) -> Column:
    """"/lib/" for /lib/list.html."""
    p = F.when(path(c) == "", "/").otherwise(path(c))
    return F.regexp_replace(p, "[^/]*$", "")


def kind(c: Column) -> Column:
    """pdf, page or text by the path's ending; "" for a link that is not kept."""
    name = F.lower(F.regexp_extract(path(c), "([^/]*)$", 1))
    end = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return (F.when(end == ".pdf", "pdf").when(end.isin(*TEXT_ENDINGS), "text")
            .when(end.isin(*PAGE_ENDINGS), "page").otherwise(""))


def bare(c: Column) -> Column:
    """Host, path without a trailing slash or .html, and query: one key per page."""
    return F.concat(host(c), F.regexp_replace(path(c), r"(/|\.html?)$", ""), F.lit("?"), query_string(c))


def stem(c: Column) -> Column:
    """The address without its file ending: one key per document."""
    return F.concat(host(c), F.regexp_replace(F.regexp_replace(path(c), r"\.[A-Za-z0-9]{1,5}$", ""), "/+$", ""))


def target(c: Column) -> Column:
    """Decoded path and query, as site rules match them."""
    p = F.when(path(c) == "", "/").otherwise(path(c))
    q = query_string(c)

    def decoded(x):
        # A plus sign is a plus sign in a path.
        safe = F.replace(x, F.lit("+"), F.lit("%2B"))
        return F.coalesce(F.try_url_decode(safe), x)

    return F.concat(decoded(p), F.when(q != "", F.concat(F.lit("?"), decoded(q))).otherwise(""))


def normalize_link(c: Column) -> Column:
    """A scheme put in front of a bare domain."""
    link = F.trim(c)
    bare_domain = ~link.contains("://") & link.rlike(r"^[\w-]+(\.[\w-]+)+(:\d+)?(/|$)")
    return F.when(bare_domain, F.concat(F.lit("https://"), link)).otherwise(link)
