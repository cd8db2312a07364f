"""Links of web pages, by Spark's own expressions.

A page is cut into tags once comments and elements whose contents are no markup
are gone; attributes are read in order, so that an address within another
attribute's value is none. Addresses are resolved against the page's, or against
that of its `base`, as RFC 3986 says. All of it is one projection of a page: no
shuffle, and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# White space in HTML, as it stands in a class of a regular expression.
SPACE = " \\t\\n\\f\\r"
# Elements whose contents are text, whatever they look like.
RAW = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"]
# Characters that have a name in HTML, the ampersand last.
NAMED = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"),
    ("&#34;", '"'), ("&#x22;", '"'), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"),
    ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"),
]


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


def _raw(name: str) -> str:
    name = _any_case(name)
    return f"<{name}(?:[{SPACE}/][^>]*)?>.*?(?:</{name}[{SPACE}/>]|\\z)"


# What holds no tags: comments, and elements of text. One that is not closed goes on to the end.
NO_MARKUP = "(?s)<!--.*?(?:-->|\\z)|" + "|".join(map(_raw, RAW))
TAG = f"<(?:[aA]|{_any_case('area')}|{_any_case('base')})[{SPACE}/][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>"
ATTRIBUTE = (
    f"[^{SPACE}/>\"'=<]+[{SPACE}]*(?:=[{SPACE}]*(?:\"[^\"]*\"|'[^']*'|[^{SPACE}>\"']+))?"
)
# The name of an attribute with an address, and its value in one of three groups.
ADDRESS = f"^{_any_case('href')}[{SPACE}]*=[{SPACE}]*(?:\"([^\"]*)\"|'([^']*)'|([^{SPACE}>\"']+))"
# Scheme, authority, path and query of an address (RFC 3986, appendix B).
PARTS = "(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def _addresses(tags: Column) -> Column:
    """The addresses of tags, in order; tags without one have none.

    One `transform` after the other, so that each step works on values and not on
    the expressions they come from.
    """

    def own(tag: Column) -> Column:
        attributes = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
        return F.get(F.filter(attributes, lambda a: a.rlike(ADDRESS)), F.lit(0))

    def plain(value: Column) -> Column:
        for name, sign in NAMED:
            value = F.replace(value, F.lit(name), F.lit(sign))
        return F.trim(F.translate(value, "\t\n\r\f", ""))

    found = F.filter(F.transform(tags, own), F.isnotnull)
    return F.transform(F.transform(found, lambda a: F.regexp_replace(a, ADDRESS, "$1$2$3")), plain)


def _parts(address: Column) -> Column:
    """scheme, authority, path and query; empty where there is none. Scheme and authority in lower case."""
    of = [F.regexp_extract(address, PARTS, i) for i in (1, 2, 3, 4)]
    return F.struct(
        F.lower(of[0]).alias("scheme"), F.lower(of[1]).alias("authority"),
        of[2].alias("path"), of[3].alias("query"),
    )


def _without_dots(segments: Column) -> Column:
    """A path of segments, each after a slash, with `.` and `..` worked out."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", done)
            .when(segment == "..", F.regexp_replace(done, "/[^/]*$", ""))
            .otherwise(F.concat(done, F.lit("/"), segment))
        )

    last = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.aggregate(segments, F.lit(""), step), last)


def resolved(addresses: Column, base: Column) -> Column:
    """The parts of addresses seen from the parts `base`; null for those that do not lead to a web host.

    The fragment goes, an empty query is none, and an empty path is `/`.
    """

    def seen(own: Column) -> Column:
        path, here = own["path"], (own["scheme"] == "") & (own["authority"] == "")
        folder = F.regexp_replace(base["path"], "[^/]*$", "")
        merged = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
        same = here & (path == "")
        return F.struct(
            F.when(own["scheme"] == "", base["scheme"]).otherwise(own["scheme"]).alias("scheme"),
            F.when(here, base["authority"]).otherwise(own["authority"]).alias("authority"),
            F.when(same, F.when(base["path"] == "", F.lit("/")).otherwise(base["path"]))
            .when(path == "", F.lit("/"))
            .alias("path"),
            F.split(F.when(path.startswith("/"), path).otherwise(merged), "/").alias("segments"),
            F.when(same & (own["query"] == ""), base["query"]).otherwise(own["query"]).alias("query"),
        )

    def finished(own: Column) -> Column:
        segments = F.slice(own["segments"], F.lit(2), F.size(own["segments"]))
        path = F.when(own["path"].isNull(), _without_dots(segments)).otherwise(own["path"])
        found = F.struct(own["scheme"], own["authority"], path.alias("path"), own["query"])
        return F.when(own["scheme"].isin("http", "https") & (own["authority"] != ""), found)

    return F.transform(F.transform(F.transform(addresses, _parts), seen), finished)


def _written(parts: Column) -> Column:
    query = F.when(parts["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), parts["query"]))
    return F.concat(parts["scheme"], F.lit("://"), parts["authority"], parts["path"], query)


def host_of(authority: Column) -> Column:
    """The host of an authority, without user and port."""
    return F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")


def with_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with `host`, the page's own, and `links`: (target, host) in the order they stand in.

    Links are the addresses of `a` and `area` that lead to a web host. The first
    `base` with an address counts for all of them. A page without a web address
    has no host, and of its links only the absolute ones. Null or empty HTML has none.
    """
    markup = F.regexp_replace(F.coalesce(html, F.lit("")), NO_MARKUP, "")
    is_base = lambda tag: tag.rlike(f"^<{_any_case('base')}[{SPACE}/]")
    one = lambda value: F.get(value, F.lit(0))
    nothing = F.struct(*[F.lit("").alias(n) for n in ("scheme", "authority", "path", "query")])
    own = one(resolved(F.array(F.trim(F.coalesce(url, F.lit("")))), nothing))
    found = pages.withColumns({"_tags": F.regexp_extract_all(markup, F.lit(TAG), F.lit(0)), "_own": own})
    here = F.coalesce("_own", nothing)
    moved = one(resolved(F.slice(_addresses(F.filter("_tags", is_base)), 1, 1), here))
    found = found.withColumn("_base", F.coalesce(moved, here))
    found = found.withColumn("_links", resolved(_addresses(F.filter("_tags", lambda t: ~is_base(t))), F.col("_base")))
    links = F.transform(
        F.filter("_links", F.isnotnull),
        lambda t: F.struct(_written(t).alias("target"), host_of(t["authority"]).alias("host")),
    )
    found = found.withColumns({"links": links, "host": host_of(F.col("_own")["authority"])})
    return found.drop("_tags", "_own", "_base", "_links")


def exploded(linked: DataFrame) -> DataFrame:
    """The rows of `with_links`, once for each link, with `at`, its place from 0, and `link`.

    The outer form, because from the other one Spark infers a filter on the number of
    links, which it pushes down to the scan: all links would be looked for twice.
    """
    return linked.select("*", F.posexplode_outer("links").alias("at", "link")).where("at is not null")


def host_pairs(linked: DataFrame) -> DataFrame:
    """from_host, to_host, n_links, n_pages over the rows of `with_links`, a page's repeats counted once.

    Pages need no second shuffle to be counted: a link knows whether it is its
    page's first to that host. A host with a third of all links is added up per task.
    """
    hosts = F.transform("links", lambda link: link["host"])
    each = exploded(linked.select(F.col("host").alias("from_host"), "links", hosts.alias("hosts")))
    first = F.array_position("hosts", F.col("link.host")) == F.col("at") + 1
    return each.groupBy("from_host", F.col("link.host").alias("to_host")).agg(
        F.count(F.lit(1)).alias("n_links"), F.sum(first.cast("bigint")).alias("n_pages")
    )
