"""Main text of pages: planted articles read back, boilerplate gone, edge rows."""

import html
import re

import pytest

from veilframe.llm.html_text import Line, extract_pages, lines_of, main_lines, main_text, weights

CASES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<div>1 < 2 &amp; 3</div>", "1 < 2 & 3"),
    ("<p>a<p>b<ul><li>x<li>y</ul>", "a\nb\nx\ny"), ("<p>a<br>b</p>", "a b"),
    ("<p>a<br><br>b</p>", "a\nb"), ("<p>a\n\t b&nbsp;c</p>", "a b c"),
    ("<script>var t='</p>';</script>ok", "ok"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<nav>menu</nav><p>body</p><footer>f</footer>", "body"),
    ("<article><header><h1>T</h1></header><p>b</p><aside>n</aside></article>", "T\nb"),
    ("<article><p>b</p><section class='comments'><p>first!</p></section></article>", "b"),
    ("<article><p>b</p><div id=comments><div>x</div><p>c</p></div><p>d</p></article>", "b\nd"),
    ("<body><header><h1>Site</h1></header><div class='sidebar'>s</div><div><h1>T</h1><p>Long "
     "enough to surge here.</p></div><div class='cookie-notice'>We use</div></body>",
     "T\nLong enough to surge here."),
    ("<div class='layout has-sidebar'><p>kept text of the page</p></div>", "kept text of the page"),
    ("<article>a<p>b &lt;i&gt; &#233;&eacute;</p><form><input><p>x</p></form>", "a\nb <i> éé"),
    ("<div id='readerComments'><p>c</p></div><p>body of the page</p>", "body of the page"),
    ("<div><a href=/>Home</a></div><div><a>News</a></div><h1>T</h1><p>See <a>this</a> and the "
     "rest of it.</p><p><a>More</a></p>", "T\nSee this and the rest of it.\nMore"),
    ("<p>cut off in a <b", "cut off in a"), ("<p>cut &am", "cut &am"),
    ("<article><table><tr><td>1</td><td>2</td></tr></table></article>", "1\n2"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert main_text(page) == text


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for r in pages.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [
            re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip()
            for b in re.split(r"</?(?:p|h1|br)>", article)
        ]
        text = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (text, len(text))


def test_surge_and_dive():
    gap = [Line("")] * 3
    text, link = Line("x" * 30), Line("link", linked=True)
    lines = [Line("menu"), *gap, text, link, Line("y", prose=True), text, *gap, Line("end")]
    assert main_lines(lines) == ["x" * 30, "link", "y", "x" * 30]
    assert main_lines([Line("ab"), *gap, Line("abc")]) == ["abc"]
    assert main_lines([]) == []
    links = [Line("one", linked=True), Line("two", linked=True)]
    assert main_lines([*links, text, *links]) == ["x" * 30]
    assert main_lines(links) == ["one", "two"]
    # Short lines: many bare ones are a menu, one is part of the text, prose always is.
    short = [Line(f"item {i}") for i in range(5)]
    assert main_lines([*short, text, *short]) == ["x" * 30]
    assert main_lines([short[0], text]) == ["item 0", "x" * 30]
    prose = [x._replace(prose=True) for x in short]
    assert main_lines([*prose, text]) == [x.text for x in [*prose, text]]
    # What weighs nothing is left out wherever it stands, and parts no text.
    advert = Line("z" * 50, weighs=False)
    assert main_lines([advert, text, advert, text, advert]) == ["x" * 30] * 2
    # The level follows the page: lines that would surge on a page of titles do not here.
    long = Line("w" * 900)
    assert main_lines([Line("About our company and us")] * 4 + [long]) == ["w" * 900]
    assert len(main_lines([Line("About our company and us")] * 4)) == 4


def test_table_edges(spark):
    rows = [(1, "u", "<p>a</p>", 0), (1, "u", "<p>a</p>", 0), (None, None, None, 0),
            (2, "v", "<p>" + "word " * 200_000 + "</p>", 0), (3, "w", "<nav>only</nav>", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract_pages(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 999_999), (3, 0)]
    assert extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<head><title>x</title><body><p>text</p></body>", "<html><head><meta charset=a><p>text</p>",
     "<head><title>x</title><style>p{}</style></head><body><p>text</p>",
     "<head><script>'<p>no'</script><div>text</div>", "<head><template><p>no</p></template><p>text"],
)
def test_head_without_end_tag(page):
    assert main_text(page) == "text"


def test_short_lines_beside_removed_elements():
    long = "A paragraph that is long enough to surge."
    ad = "<div class='advert'>Buy</div>"
    assert main_text(f"<h1>Old news</h1><div class='share'>x</div><p>{long}</p>") == f"Old news\n{long}"
    page = f"<p>{long}</p>{ad}<p>He agreed.</p>{ad}<p>{long}</p><form>f</form><p>End.</p>"
    assert main_text(page) == f"{long}\nHe agreed.\n{long}\nEnd."
    links = "<div><a>one</a></div>" * 4
    page = f"<p>{long}</p>{links}<p>He agreed.</p>{links}<p>{long}</p>"
    assert main_text(page) == f"{long}\nHe agreed.\n{long}"


def test_story_outside_the_named_elements():
    story = [f"Paragraph {i} of the story, long enough to surge." for i in range(4)]
    body = "".join(f"<p>{s}</p>" for s in story)
    teaser = "<article><p>Teaser</p></article>"
    got = main_text(f"<div class='story'>{body}</div>{teaser}{teaser}").split("\n")
    assert got[:4] == story


STORY = [f"Paragraph {i} of the story, which is long enough to make the text surge." for i in range(4)]


def page_of(before="", after="", wrap="<div>{}</div>", tag="p"):
    return "<body>" + before + wrap.format("".join(f"<{tag}>{x}</{tag}>" for x in STORY)) + after + "</body>"


@pytest.mark.parametrize("tag", ["p", "div", "section"])
def test_menus_and_footers_of_plain_elements(tag):
    """Nothing but the lengths of the lines tells these from the article."""
    menu = "".join(f"<div>{x}</div>" for x in ("Home", "News", "Sports", "About us", "Contact"))
    foot = "".join(f"<div>{x}</div>" for x in ("Imprint", "Privacy", "Terms", "Jobs"))
    page = page_of(menu + "<h1>Title</h1>", foot, tag=tag)
    lines = lines_of(page)
    assert len(lines) == 14 and all(weights(lines, 3, 20))  # the markup has decided nothing
    assert main_text(page).split("\n") == ["Title", *STORY]


def test_blocks_and_markup_disagree():
    """An article element with a teaser; the story stands in plain elements beside it."""
    teaser = "<article><div>Read more</div></article>"
    page = page_of(teaser + "<div>a</div><div>b</div><div>c</div>", "", tag="div")
    assert main_text(page).split("\n") == ["Read more", *STORY]
    inside = page_of("<div>Site name</div>", "<div>Imprint</div>", "<article>{}</article>")
    assert main_text(inside).split("\n") == STORY


@pytest.mark.parametrize(
    "part",
    ["<section class='related-work'><p>Earlier papers.</p></section>", "<p class='legal'>By law.</p>",
     "<p id='search'>The search.</p>", "<div class='side by side'><p>Two views.</p></div>",
     "<ul class='toc'><li>One</li><li>Two</li></ul>", "<div class='search'><p>They searched.</p></div>"],
)
def test_names_do_not_lose_content(part):
    words = re.sub("<[^>]*>", "\n", part).split("\n")
    expected = [w for w in words if w]
    for wrap in ("<article>{}</article>",):
        page = wrap.format("".join(f"<p>{x}</p>" for x in STORY[:2]) + part + f"<p>{STORY[2]}</p>")
        assert main_text(page).split("\n") == [*STORY[:2], *expected, STORY[2]]
    if "class='search'" not in part and "related" not in part:
        page = f"<div><p>{STORY[0]}</p>{part}<p>{STORY[1]}</p></div>"
        assert main_text(page).split("\n") == [STORY[0], *expected, STORY[1]]


def test_links_that_are_text():
    head = "<h1><a href=/x>The title</a></h1>"
    single = "<p><a href=/y>A sentence that is one link.</a></p>"
    page = page_of(head, "", "<div>" + "<p>{}</p>".format(STORY[0]) + single + "{}</div>")
    assert main_text(page).split("\n") == ["The title", STORY[0], "A sentence that is one link.", *STORY]
    links = "<p><a>one</a></p><p><a>two</a></p><p><a>three</a></p>"
    assert main_text(page_of("", links + "<p>End.</p>")).split("\n") == [*STORY, "End."]


def test_boilerplate_weighs_nothing_on_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()
    for r in rows:
        lines = lines_of(r.html)
        kept = main_lines(lines)
        assert 0 < len(kept) < len(lines)  # menus, adverts and footers are lines, left out by weight


def test_deep_nesting_is_linear():
    import time

    for tag in ("div", "b", "a", "li", "p"):
        started = time.perf_counter()
        page = f"<{tag}>" * 16_000 + "some text" + f"</{tag}>" * 16_000
        assert main_text(page) == "some text"
        assert time.perf_counter() - started < 2
    started = time.perf_counter()
    main_text("<div><i>x" * 20_000 + "</b></p>" * 20_000)
    assert time.perf_counter() - started < 4
