import time
from collections import defaultdict

import pytest

from lorekeep.llm import html_extract as hx


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>a &amp; b&nbsp;c</p><p>d</p>", "a & b c\n\nd"),
        ("<html><head><title>t</title><script>var a='</p>';</script><style>p{}</style></head><body><nav><a>x</a></nav><article><h1>T</h1><p><b>one<br><p>two <i>three</i></article><footer>f</footer>", "T\n\none\n\ntwo three"),
        ("<body><header>h</header><main><p>x</p><aside>s</aside><form>f</form><div class='comments'><p>c</p></div></main>", "x"),
        ("<div class='cookie-notice'>c</div><div id='content'><p>x</p><div class='ad'>y</div></div><div class=sidebar>z</div>", "x"),
        ("<article><header><h1>T</h1></header><p>x<!-- c --></p><p hidden>h</p></article><article class=comment>no</article>", "T\n\nx"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>a < b", "a\n\nb\n\nc d\n\na < b"),
        ("<p>unclosed <b>x", "unclosed x"),
        ("<p>a</p><script>never closed", "a"),
        ("<p title=\"a>b\">x</p>", "x"),
        ("plain", "plain"),
    ],
)
def test_main_text(html, text):
    assert hx.main_text(html) == text


def test_templates_of_a_host_go(spark):
    rows = [(i, f"https://user@Site.example:8080/{i}", f"<body><div><div>Site <b>name</b></div><div>links links</div></div><div><p>text {i}</p><p>shared line</p></div>") for i in range(30)]
    rows += [(100 + i, "http://other.example/", f"<body><div>Site <b>name</b></div><p>other {i}") for i in range(2)]
    rows += [(200, None, None), (201, "x", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, page string")
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert got[3] == "text 3"  # what recurs across the host is gone, the page's own text stays
    assert got[100] == "Site name\n\nother 0"  # too few pages to call it a template
    assert got[200] == got[201] == ""
    assert hx.extract(df).count() == len(rows)
    assert hx.extract(df.limit(0)).collect() == []


def test_repeated_text_in_articles_stays(spark):
    rows = [(i, "http://h.example/", f"<article><h1>same</h1><p>common passage</p><p>{i}</p><div class='x'>share this page</div></article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text.startswith("same\n\ncommon passage\n\n") for r in hx.extract(df).collect())


@pytest.mark.parametrize("body", ["<article>{}</article>", "<div class='content'>{}</div>", "{}", "<div><div>{}</div></div>"])
def test_copies_of_a_page_are_one_page(spark, body):
    text = "<h1>Title</h1><p>a long first part of the text</p><div><p>a table of figures</p></div><p>a long last part of the text</p>"
    pages = [body.format(text)] * 12 + [body.format(f"<p>page {i} has a text of its own</p>") for i in range(12)]
    rows = [(i, f"http://h.example/?session={i}", f"<body><div>menu <b>entry</b></div>{page}<script>{i}</script></body>") for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert {got[i] for i in range(12)} == {"Title\n\na long first part of the text\n\na table of figures\n\na long last part of the text"}
    assert got[15] == "page 3 has a text of its own"  # without the menu


def test_templates_hold_less_than_half_of_the_main_text(spark):
    rows = [(i, "http://h.example/", f"<body><div>menu</div><div><p>the text of all pages, which differ in their numbers</p></div><i>{i}</i></body>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in hx.extract(df).collect()} == {f"the text of all pages, which differ in their numbers\n\n{i}" for i in range(20)}


def test_join_by_host_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/", f"<div>menu menu</div><p>text {i}</p>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(map(tuple, hx.extract(df).collect()))
    monkeypatch.setattr(hx, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, hx.extract(df).collect())) == first


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page has-sidebar"><article>x</article></div>',
        '<div class="no-sidebar share"><main>x</main></div>',
        '<article><div class="post-content social-ready">x</div></article>',
        '<article><div class="entry social"><p>x</div></article>',
        '<form id="aspnet"><article>x</article></form>',
        '<header><main>x</main></header>',
        '<div class="related"><article>other</article></div><aside><article>other</article></aside><article>x</article>',
        '<article>x<section class="post-comments"><p>a comment longer than the text</p></section></article>',
        '<div class="content-sidebar-wrap"><div id="content"><p>x</div><div id="sidebar">y</div></div>',
        '<body style="display:none"><div class="siteHeader menu">a b c</div><p>x</body>',
        '<table><tr><td class="sidebar">y<td class="content">x</table>',
    ],
)
def test_what_holds_the_article_stays(page):
    assert hx.main_text(page) == "x"


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<main>" * 50_000, "<a " * 100_000 + '"', "<tr><td>" * 50_000, "<b>" * 50_000 + "<div></div>" * 50_000, "<p " * 100_000, "<!" * 100_000])
def test_long_and_deep_pages_take_linear_time(page):
    start = time.monotonic()
    assert hx.main_text(page + "x") in ("", "x")
    assert time.monotonic() - start < 20  # about a second; the square of the length would take hours


LONG = "a sentence about the sponsor of the race, who pays for the prizes and the winners' journey home"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><p>intro</p><article><p>A1</p></article><p>outro</p></main>", "intro\n\nA1\n\noutro"),
        ("<main><h1>Headline</h1><article><p>A1</p></article><nav>n</nav><aside>s</aside></main><footer>f</footer>", "Headline\n\nA1"),
        ("<main><article><p>A1</p></article><article><p>A2</p></article></main>", "A1\n\nA2"),
        ("<article><p>x</p><p class='social'>social studies</p><p class='share'>market share rose</p></article>", "x\n\nsocial studies\n\nmarket share rose"),
        (f"<article><p>x x x x {LONG} {LONG}</p><div class='sponsor'><p>{LONG}</p></div></article>", f"x x x x {LONG} {LONG}\n\n{LONG}"),
        ("<article><p>x</p><p class='share'><a>mail</a> <a>print</a></p><div class='share'><p>Share this page</p></div></article>", "x"),
        (f"<article><p>x {LONG}</p><div class='related'><p><a>{LONG}</a></p></div><div class='notice'><p>{LONG}</p></div></article>", f"x {LONG}"),
        (f"<article><p>x</p><p class='advert'>buy</p><p class='share-comments'>c</p><div class='ad sponsor'><p>{LONG}</p></div></article>", "x"),
    ],
)
def test_text_beside_articles_and_of_a_subject_stays(page, text):
    assert hx.main_text(page) == text


@pytest.mark.parametrize("label", ["share", "sponsor", "related social"])
def test_deep_containers_of_a_subject_take_linear_time(label):
    start = time.monotonic()
    text = f"<p>{LONG}</p>"
    assert hx.main_text("<article>" + f"<div class='{label}'>" * 50_000 + text).startswith("a sentence")
    assert time.monotonic() - start < 20


def counted_templates(rows):
    """Templates of each host by plain counting."""
    pages = [(url.split("/")[2], hx.Page(html)) for _, url, html in rows]
    bodies, on = defaultdict(set), defaultdict(set)
    for host, page in pages:
        bodies[host].add(page.text())
        for h in page.candidates():
            on[host, h].add(page.text())
    found = defaultdict(set)
    for (host, h), texts in on.items():
        if len(texts) >= hx.TEMPLATE_PAGES and len(texts) >= hx.TEMPLATE_SHARE * len(bodies[host]):
            found[host].add(h)
    return found


def site(n_hosts=3, n_pages=30):
    rows = []
    for i in range(n_hosts * n_pages):
        menu = "".join(f"<li><a href='/{i + j}'>entry {i * j}</a>" for j in range(2 + i % 5))
        ad = f"<div class=x{i % n_hosts}>offer {i}: words that are new on every page {i * 7}</div>" if i % 3 else ""
        body = "".join(f"<p>Paragraph {j} of page {i}. " + "More words of it. " * (j + i % 4) for j in range(1 + i % 6))
        rows.append((i, f"http://h{i % n_hosts}.example/{i}", f"<body><div class=top><ul>{menu}</ul></div>{ad}<div><h1>Page {i}</h1>{body}</div><div id=end{i}>copyright {i}</div></body>"))
    return rows


def test_query_equals_plain_counting(spark):
    rows = site()
    known = counted_templates(rows)
    expected = {i: hx.main_text(html, frozenset(known[url.split("/")[2]])) for i, url, html in rows}
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected
    for i, _, _ in rows:  # menus, offers and ends go by their shape, though no two have the same text
        assert got[i].startswith(f"Page {i}\n\nParagraph 0 of page {i}.") and "offer" not in got[i] and "entry" not in got[i] and "copyright" not in got[i]


def test_templates_alone_give_the_text_of_the_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    known = counted_templates(rows)
    large = [(i, html, frozenset(known[url.split("/")[2]])) for i, url, html in rows if known[url.split("/")[2]]]
    assert large
    for _, html, templates in large:
        assert hx.main_text(html, templates, by_kind=False) == hx.main_text(html, templates)
        assert hx.main_text(html, templates, by_kind=False) != hx.main_text(html, by_kind=False)


def test_null_pages_and_hot_hosts(spark):
    rows = [(i, None if i % 2 else "http://hot.example/", None if i % 7 == 0 else f"<div class=a><a href={i}>menu {i}</a></div><p>text {i}</p>") for i in range(60)]
    df = spark.createDataFrame([*rows, *rows], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in hx.extract(df).collect())
    assert got == sorted((i, t := "" if html is None else f"text {i}", len(t)) for i, _, html in rows * 2)
