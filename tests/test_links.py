"""Links of pages: against RFC 3986, a parser of the standard library, and SQL on odd pages."""

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import oracle_sql
from millrace.operators.hyperlinks import exploded, host_pairs, with_links
from millrace.plans.web import links_between_hosts, links_of_pages

SCHEMA = "page_id bigint, url string, html string"


def targets(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA)
    found = {}
    for r in with_links(df).collect():
        found.setdefault(r.page_id, []).extend(link.target for link in r.links)
    return found


# RFC 3986, sections 5.4.1 and 5.4.2, for the base http://a/b/c/d;p?q, without fragments.
EXAMPLES = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g",
}


def test_addresses_as_the_standard_resolves_them(spark):
    html = "".join(f'<a href="{reference}">x</a>' for reference in EXAMPLES)
    assert targets(spark, [(1, "http://a/b/c/d;p?q", html)]) == {1: list(EXAMPLES.values())}


ODD = [
    '<a href=x>1</a><A HREF = "Y">2</A><a\nhref=\'z\'>3</a><a class=k href=w/>4</a>',
    '<!-- <a href="no"> --><a href="yes"><script>"<a href=no>"</script><style>a{}</style><textarea><a href=no></textarea>',
    '<a title="a > b href=no" href="yes">x</a><a data-href="no">x</a><a href>x</a><a href="">x</a><abbr href="no">',
    '<a href="?a=1&amp;b=2&amp;lt;">x</a><a href=" /sp ace \n">x</a><a href="&#47;e&#x2f;f">',
    '<a href="mailto:a@b.c">m</a><a href="javascript:void(0)">j</a><a href="HTTPS://U:P@Host.Example:8080/P?q#f">h</a>',
    '<base target=x><base href="//other.example/dir/page"><base href="http://no/"><a href="rel">r</a><a href="/abs">a</a>',
    '<a href="a//b/../c/./d/..">x</a><area href="../../../up?x=../y"><a href="http:">x</a><a href="http:///x">',
    '<script>never closed <a href="no">', '<!-- never closed <a href="no">', '<a href="never closed', "", None, "plain text",
    '<a href="twice" href="no">x</a>' * 3 + '<a href="é/ü?ö">x</a><scripty><a href="yes"></scripty>',
    "<a href='" + "x" * 20000 + "'>long</a>" + "<a " + 'data-k="v>" ' * 200 + 'href="end">',
]
URLS = ["http://Host.Example/dir/page?q=1#f", "https://u@h.example:81", "not an address", None, " http://x.example/a/b/ ", "//h/x"]


class Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base, self.found = None, []

    def handle_starttag(self, tag, attributes):
        href = next((v for k, v in attributes if k == "href"), None)
        if href is not None and tag == "base" and self.base is None:
            self.base = href
        elif href is not None and tag in ("a", "area"):
            self.found.append(href)


def test_like_the_parser_of_the_standard_library(spark):
    """Pages without raw elements that the two treat differently, and references that both resolve alike."""
    url = "http://host.example/dir/page?q=1"
    pages = [(i, url, ODD[i]) for i in (0, 2, 3, 5, 13)]
    got = targets(spark, pages)
    for i, _, html in pages:
        parser = Tags()
        parser.feed(html)
        base = urljoin(url, parser.base) if parser.base else url
        want = [urljoin(base, h.strip().replace("\n", "")) for h in parser.found if h.strip()]
        assert [t for t in got[i] if t != url] == want, i


def test_odd_pages(spark):
    url = "http://host.example/dir/page"
    got = targets(spark, [(i, url, html) for i, html in enumerate(ODD)])
    d = "http://host.example/dir/"
    assert got[0] == [d + "x", d + "Y", d + "z", d + "w/"]
    assert got[1] == [d + "yes"] and got[2] == [d + "yes", url]
    assert got[3] == [url + "?a=1&b=2&lt;", "http://host.example/sp ace", "http://host.example/e/f"]
    assert got[4] == ["https://u:p@host.example:8080/P?q"]
    assert got[5] == ["http://other.example/dir/rel", "http://other.example/abs"]
    assert got[6] == [d + "a//c/", "http://host.example/up?x=../y"]
    assert [got[i] for i in range(7, 13)] == [[]] * 6
    assert got[13] == [d + "twice"] * 3 + [d + "é/ü?ö", d + "yes"]
    assert got[14] == [d + "x" * 20000, d + "end"]


def folder_of(tmp_path, pages):
    ids, urls, htmls = zip(*pages) if pages else ((), (), ())
    table = pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(htmls, pa.string())})
    pq.write_table(table, tmp_path / "pages.parquet")
    return tmp_path


@pytest.mark.parametrize("name,query", [("links_of_pages", links_of_pages), ("links_between_hosts", links_between_hosts)])
def test_same_as_sql_on_odd_pages(spark, duck, rows, tmp_path, name, query):
    pages = [(None if i % 7 == 0 else i, url, html) for i, (url, html) in enumerate((u, h) for u in URLS for h in ODD)]
    # A third of the pages is one page, and two thirds of the links lead to one host.
    pages += [(5, URLS[0], ODD[0])] * (len(pages) // 2)
    folder = folder_of(tmp_path, pages)
    assert rows(query(spark, str(folder))) == duck(oracle_sql()[name], folder)


def test_no_pages(spark, tmp_path):
    folder = folder_of(tmp_path, [])
    assert links_of_pages(spark, str(folder)).count() == 0 and links_between_hosts(spark, str(folder)).count() == 0


def test_hosts_and_repeats(spark):
    pages = [(1, "http://a.x/", '<a href="p"><a href="http://u:p@B.x:1/q"><a href="r">'), (1, "http://a.x/", '<a href="p">'), (2, None, '<a href="p"><a href="http://a.x">')]
    got = sorted(map(tuple, host_pairs(with_links(spark.createDataFrame(pages, SCHEMA))).collect()), key=repr)
    assert got == sorted([("a.x", "a.x", 3, 2), ("a.x", "b.x", 1, 1), (None, "a.x", 1, 1)], key=repr)
    assert urlsplit("http://u:p@B.x:1/q").hostname == "b.x"


def test_plan(spark):
    """Links are one projection of the scan; host pairs are added up before their only shuffle."""
    folder = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    links, pairs = plan(links_of_pages(spark, folder)), plan(links_between_hosts(spark, folder))
    assert "Exchange" not in links and "Python" not in links + pairs and pairs.count("Exchange ") == 1
    # The tags are looked for once.
    assert links.count("regexp_extract_all(regexp_replace(coalesce(html") == 1
    clashing = spark.createDataFrame([(1, "http://a/", '<a href="x">', "at", 3)], SCHEMA + ", kind string, place int")
    assert [r.link.target for r in exploded(with_links(clashing)).collect()] == ["http://a/x"]
