import duckdb
import pytest
from pyspark.sql import functions as F

from kerbline.llm import license_scan, queries, url_filter, wrappers
from kerbline.llm.license_templates import TEMPLATES
from tests.conftest import MIDDLE, SMALL
from tests.llm.fixtures import ODD, docs, prose

PAGES = "page_id bigint, url string, html string, host string, wrapper string, key string, rule string, verdict string"
RULES = queries.ADDRESS_RULES


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "w", "k", "r", "v") for r in rows], PAGES)


URLS = [
    ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("https://EXAMPLE.org/en/123?q", "example.org", "/en/123", "example.org/en/1", "block"), ("http://example.org", "example.org", "", None, "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://x.com/de/?a=/fr/", "x.com", "/de/", "com/de/", "block"), ("http://x.com/DE/", "x.com", "/DE/", None, "allow"), ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("://org/x", "org", "/x", "org/", "allow"), ("http://x.net/login?x", "x.net", "/login", None, "block"),
    ("http://com/de/x://y.org/z", "com", "/de/x:", "com/de/", "block"), ("http://x.org:80/", "x.org:80", "/", None, "allow"), ("http://ÄÖ.org/é", "ÄÖ.org", "/é", "org/", "allow"),
    ("http://org\n/x", "org\n", "/x", None, "allow")]


def test_urls_of_all_kinds(spark):
    rows = [(i, u, None) for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], None)] * 2 + [(None, URLS[1][0], None)]
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, rows), RULES + url_filter.DEFAULT_PATTERNS).collect()]
    expected = [(i, *rest) for i, (_, *rest) in enumerate(URLS)]
    expected[13] = (13, "com", "/de/x:", "com/de/", "block")
    expected[13] = (13, "com", "/de/x://y.org/z", "com/de/", "block")
    assert sorted(found, key=str) == sorted(expected + [expected[0]] * 2 + [(None, *expected[1][1:])], key=str)
    assert url_filter.judge_urls(pages(spark, []), RULES).count() == 0


def test_a_rule_is_keyed_by_its_rarest_token(spark):
    urls = spark.createDataFrame([("http://example.org/en/",)] * 5 + [("http://a.org/es/",)] * 3 + [("http://b.com/es/",)], "url string")
    keys = {r.rule: r.key for r in url_filter.rule_index(urls, RULES).collect()}
    assert keys == {"org/": "org", "example.org/es/": "es", "example.org/en/1": "en", "com/fr/": "fr", "com/de/": "de"}


def test_patterns(spark):
    rules = tuple(url_filter.pattern_rule(p, v) for p, v in (("^ads.", "block"), ("/good^", "allow"), ("a*z", "block"), ("q=1", "block")))
    assert [r.tokens for r in rules] == [("ads",), ("good",), (), ()]
    urls = ["http://ads.x/", "http://x/ads", "http://ads.x/good/", "http://x/abcz", "http://x/AZ", "http://x/?Q=12", "http://x/"]
    found = {r.url: r.verdict for r in url_filter.judge_urls(pages(spark, [(1, u, None) for u in urls]), rules).collect()}
    assert [found[u] for u in urls] == ["block", "allow", "allow", "block", "block", "block", "allow"]
    with pytest.raises(ValueError):
        url_filter.pattern_rule("**", "block")
    with pytest.raises(ValueError):
        url_filter.address_rule("nohost", "block")


def sql_of(query, folder):
    db = duckdb.connect()
    for name in ("pages", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return sorted(map(str, db.execute(queries.ORACLE[query]).fetchall()))


@pytest.mark.parametrize("name", ["op3_url_filter", "op10_license_scan"])
def test_native_queries_equal_sql_and_run_no_python(spark, name):
    frame = queries.QUERIES[name](spark, MIDDLE)
    assert not any(w in frame._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Arrow", "Pandas"))
    assert sorted(str(tuple(r)) for r in frame.collect()) == sql_of(name, MIDDLE)


def test_licenses_in_documents(spark):
    mit = "\n".join(w for licence, name, w in TEMPLATES if licence == "MIT" and name in ("grant", "warranty"))
    rows = [(10, f"{prose(1, 20)}\nReleased under the MIT License.\n{prose(2, 20)}"), (11, "released UNDER the (MIT) license"),
            (12, f"{prose(3, 10)}\n\n{TEMPLATES[15][2].replace('IN NO', 'IN' + chr(10) + 'NO')}\n\n{prose(4, 10)}"), (13, mit), (14, prose(5, 300)),
            (15, "the license"), (16, "This work is licensed under the GNU General Public License, version 3")]
    found = sorted((r.doc_id, r.kind, r.number, r.license, r.template) for r in license_scan.scan_licenses(docs(spark, rows + ODD)).collect())
    assert found == [(10, "line", 1, "MIT", "released"), (11, "line", 0, "MIT", "released"), (12, "paragraph", 1, "MIT", "warranty"), (12, "text", 0, "MIT", "warranty"),
                     (13, "line", 0, "MIT", "grant"), (13, "line", 1, "MIT", "warranty"), (16, "line", 0, "GPL-3.0", "work")]
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_bounds_lose_nothing(spark):
    """Against the plain coefficient of every line and every template."""
    import random
    drawn = random.Random(1)
    lines = []
    for k in range(300):
        words = drawn.choice(TEMPLATES)[2].split()
        for _ in range(drawn.randrange(len(words))):
            words[drawn.randrange(len(words))] = drawn.choice(["the", "license", "x", "of", "software"])
        lines.append(" ".join(words[drawn.randrange(3):]))
    expected = []
    for n, line in enumerate(lines):
        own = set(license_scan.template_bigrams(line))
        scores = [(round(-2 * len(own & set(b)) / (len(own) + len(b)), 6), a, c) for a, c, w in TEMPLATES for b in [license_scan.template_bigrams(w)]]
        if own and min(scores)[0] <= -0.8:
            expected.append((n, *min(scores)[1:]))
    found = [(r.doc_id, r.license, r.template) for r in license_scan.scan_licenses(docs(spark, list(enumerate(lines)))).collect()]
    assert sorted(found) == sorted(expected) and len(found) > 20


def site(n, body, shape=0):
    menu = "".join(f"<li><a href='/{k}'>entry {k}</a></li>" for k in range(4))
    inner = {0: f"<div class='post-body'>{body}</div>", 1: f"<article>{body}</article>"}[shape]
    return (f"<!doctype html><html><head><title>t {n}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
            f"<nav><ul>{menu}</ul></nav><div class='wrap'><div class='crumbs'>You are here</div>{inner}<p>Share this story with friends</p></div>"
            f"<div class='sidebar'>links {n}</div><form><p>Search {n}</p></form><!-- x --><div id='cookie-notice'>We use cookies</div>"
            f"<section class='comments'><p>comment {n} by a reader</p></section><footer>&copy; {n}</footer>")


def body(n):
    return (f"<h1>Title {n} &amp; more</h1><p>{prose(n, 25)} <b>bo<i>ld</i></b>{n}.<p>x&nbsp;y<br>z {prose(n + 50, 30)}"
            f"<ul><li>one {n}<li>two {n}</ul><div class='ad'>buy {n}</div><header>by</header>")


def expected(n):
    return f"Title {n} & more {prose(n, 25)} bold{n}. x y z {prose(n + 50, 30)} one {n} two {n}"


@pytest.mark.parametrize("shape", [0, 1])
def test_articles_of_a_site(spark, shape):
    rows = [(n, f"http://s{n % 2}.example/{n}", site(n, body(n), shape)) for n in range(30)]
    rows += [(100, None, site(1, body(1), 1)), (101, "http://s0.example/none", None), (102, "http://s0.example/e", ""), (0, rows[0][1], rows[0][2])]
    found = wrappers.extract_pages(pages(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert {n: texts[n] for n in range(30)} == {n: expected(n) for n in range(30)}
    assert texts[100] == expected(1) and texts[101] == texts[102] == ""


def test_constant_nodes_of_the_region_are_template_but_copies_are_not():
    region = [site(n, body(n) + "<p>Written for the example site</p>", 1) for n in range(10)]
    wrapper = wrappers.induce(region)
    assert wrapper["path"][-1] == "article" and wrappers.extract(region[0], wrapper) == expected(0)
    assert "Written" in wrappers.extract(region[0], wrappers.induce(region[:5]))  # too few to tell
    same = [site(1, body(1), 1).replace("links 1", f"links {n}").replace("Title 1", f"Title {n}") for n in range(10)]
    same[1:1] = same[1:2]
    assert wrappers.extract(same[1], wrappers.induce(same)) == expected(1)


def test_all_pages_of_a_host_are_compared(spark):
    """Hosts of eight pages and of mostly one page under many URLs, and hosts of two layouts, lose no template."""
    note = "<p class='byline'>Written for the example site</p>"
    rows = [(n, f"http://few.example/{n}", site(n, body(n) + note, 1)) for n in range(8)]
    rows += [(100 + n, f"http://same.example/{n}", site(n if n < 10 else 9, body(n if n < 10 else 9) + note, 0)) for n in range(60)]
    rows += [(200 + n, f"http://two.example/{n}", site(n, body(n) + (note if n % 2 else ""), n % 2)) for n in range(40)]
    rows += [(300 + n, f"http://less.example/{n}", site(n, body(n) + note, 1)) for n in range(7)]
    texts = {r.page_id: r.text for r in wrappers.extract_pages(pages(spark, rows)).collect()}
    assert [texts[n] for n in range(8)] == [expected(n) for n in range(8)]
    assert [texts[100 + n] for n in range(60)] == [expected(min(n, 9)) for n in range(60)]
    assert [texts[200 + n] for n in range(40)] == [expected(n) for n in range(40)]
    assert all("Written" in texts[300 + n] for n in range(7))  # too few to tell


def test_tree_matching_pairs_the_most_nodes():
    def tree(label, *children):
        node = wrappers.Folded(label, label)
        node.children = {c.label: c for c in children}
        return node
    a = tree("r", tree("a"), tree("b", tree("x"), tree("y")), tree("c"))
    b = tree("r", tree("b", tree("y")), tree("a"), tree("c"))
    size, pairs = wrappers.align(a, b)
    assert size == 4 and sorted(x.label for x, _ in pairs) == ["b", "c", "r", "y"]
    assert wrappers.align(a, tree("q")) == (0, [])


@pytest.mark.parametrize("page", ["<", "<p", "<p <b>x", "a<!-- b", "<script>x", "</p></div>x", "<td>x<td>y", "&#0;&amp;&bogus;", "<p>" * 3000 + "deep", "<div>" * 3000 + "x",
                                  "<a b='c>d</a>", "x" * 100_000, "<![CDATA[x]]>y"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(wrappers.extract(page, wrappers.induce([page])), str)


@pytest.mark.parametrize("opening", ["<div>" * 250, "<font>" * 100_000])
def test_deep_pages_keep_their_article(opening):
    closing = "</div>" * opening.count("<div>")
    page = f"<div id=wrap><article><p>lead</p>{opening}x{closing}<nav>menu</nav><p>tail</p></article></div>"
    for wrapper in (None, wrappers.induce([page]), wrappers.induce([page, page.replace("x", "y")])):
        assert wrappers.extract(page, wrapper) == "lead x tail"


def test_query_eight_takes_the_articles(spark):
    import html, re
    found = {r.page_id: r.text for r in queries.op8_html_extraction(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", F.col("html").alias("h")).collect():
        inner = re.search(r"<article>(.*?)</article>", r.h, re.S)[1]
        parts = (html.unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", inner))
        assert found[r.page_id] == " ".join(" ".join(parts).split())
