import random
import re

from scorelane.llm import html
from scorelane.llm.html import BLOCK, aligned, extract, main_text, match, tree

SCHEMA = "page_id bigint, url string, html string, host string, part string, text string"

PAGE = """<!DOCTYPE html><html><head><title>Title {i}</title><style>p{{}}</style></head><body>
<div id="cookie-notice">We use them</div><header><h1>The site</h1></header>
<div class="wrap"><ul class="menu"><li><a href=x>One {i}</a><li><a href=y>Two</a></ul>
<div class="post"><h2>Head {i}</h2><p>Number {i} is here &amp; there.<p>second   para
 <i>it</i>alic &eacute; &#x41;<div class="motto">Always the same</div>
<blockquote>quote {i}</blockquote><form><input name=q>Search</form>{more}</div>
<div class="sidebar">side {i}</div></div><div class="ad">buy {i}</div>
<div class="comments"><p>nice {i}</div><footer>&copy; site {i}</footer><script>var t="</p>{i}";</script>"""


def body(i, more=""):
    return f"Head {i}\nNumber {i} is here & there.\nsecond para italic é A\nquote {i}{more}"


def test_template_and_content():
    pages = [PAGE.format(i=i, more=f"<p>extra {i}</p>" if i % 2 else "") for i in range(9)]
    assert extract(pages) == [body(i, f"\nextra {i}" if i % 2 else "") for i in range(9)]


def test_a_page_alone_is_read_by_its_names():
    assert extract([PAGE.format(i=3, more="")]) == [body(3).replace("\nquote", "\nAlways the same\nquote")]


def test_articles_with_unclosed_markup():
    page = (
        "<html><body><nav><ul><li><a href=/a>a</a></li></ul></nav><article><h1>{0}</h1><p><b>{0} bold.<br>"
        "<p>Next {0}.</p><p>Last</p></article><footer>f</footer>"
    )
    assert extract([page.format(i) for i in range(3)]) == [f"{i}\n{i} bold.\nNext {i}.\nLast" for i in range(3)]


def test_equal_first_paragraphs_are_not_template():
    """Blocks in a run of their like are content, also if a passage starts every page."""
    page = "<title>{0}</title><article><h1>{0}</h1><p>A passage that all pages have.</p><p>Own {0}</p></article>"
    assert extract([page.format(i) for i in range(5)]) == [
        f"{i}\nA passage that all pages have.\nOwn {i}" for i in range(5)
    ]


def test_odd_pages():
    pages = ["plain text only", "", None, "<p>a<p>b", "<b>x<i>y</b>z</i> &lt;", "<", "<p", "<!-- x", "a<br>b", "</p></div>c"]
    assert extract(pages) == ["plain text only", "", "", "a\nb", "xyz <", "<", "<p", "", "a b", "c"]
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    assert extract([deep])[0] == "deep"


def test_names_are_read_in_their_context():
    page = (
        '<body class="has-sidebar"><div class="content with-sidebar"><article class="post"><header class="entry-header">'
        "<h1>Head {0}</h1></header><p>Text {0}</p><div class='share-buttons'>Share</div></article>"
        '<section id="comments"><article class="comment"><p>nice {0}</p></article></section></div>'
        '<div role="complementary">side {0}</div>'
    )
    assert extract([page.format(i) for i in range(4)]) == [f"Head {i}\nText {i}" for i in range(4)]
    assert extract(["<div class=widget><p>all there is</div>"]) == ["all there is"]
    main = "<main><p>Intro</p><article><h1>H</h1><p>" + "long text " * 9 + "</p></article></main>"
    assert extract([main])[0].startswith("H\nlong text")


def test_links_of_the_article_stay():
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>"
    page = (
        "<title>{0}</title>" + menu + "<div><h1>Head {0}</h1>" + menu + "<p>Text {0} of some length, with more words</p>"
        "<table><tr><td><a href=x>Entry {0}</a></td></tr></table><div><a name=part>Part {0}<p>More {0}<p>Most {0}</div>"
        "<ol><li><a href=s>Source {0}</a></li><li><a href=t>Second {0}</a></li></ol></div>"
    )
    assert extract([page.format(i) for i in range(5)]) == [
        f"Head {i}\nText {i} of some length, with more words\nEntry {i}\nPart {i}\nMore {i}\nMost {i}\nSource {i}\nSecond {i}"
        for i in range(5)
    ]
    alone = "<article><p>Text</p><ul><li><a href=s>Source</a></li></ul></article>"
    assert extract([alone]) == ["Text\nSource"]


def test_a_form_around_the_page_is_its_body():
    page = (
        "<title>{0}</title><body><form id=aspnetForm><div class=menu>Menu</div><div><h1>Head {0}</h1><p>Text {0} is here</p>"
        "</div><form-note>x</form-note></form><div>Small {0}</div>"
    )
    assert all(t.startswith(f"Head {i}\nText {i} is here") and "Menu" not in t for i, t in enumerate(extract([page.format(i) for i in range(4)])))
    assert "Text 1 is here" in extract([page.format(1)])[0]
    search = "<body><div><p>" + "Long text. " * 9 + "</p></div><form>Search here</form>"
    assert extract([search]) == [("Long text. " * 9).strip()]


def test_what_a_few_pages_share_is_not_template():
    page = "<title>{0}</title><article><h1>{0}</h1><p>Own {0}</p>{1}<p>More {0}</p></article>"
    pages = [page.format(i, "<blockquote>A passage of three pages</blockquote>" if i < 3 else "") for i in range(9)]
    assert extract(pages) == [f"{i}\nOwn {i}{chr(10) + 'A passage of three pages' if i < 3 else ''}\nMore {i}" for i in range(9)]


def test_template_without_titles():
    for title in ("", "<title>The site</title>"):
        page = title + "<body><div id=top>Welcome</div><div><p>Text {0} of this page<p>More {0}</div><div id=x>All pages say this</div>"
        assert extract([page.format(i) for i in range(4)]) == [f"Text {i} of this page\nMore {i}" for i in range(4)]
    page = "<article><h1>{0}</h1><div>All pages say this</div><p>Text {0}</p></article>"
    assert extract([page.format(i) for i in range(4)]) == [f"{i}\nText {i}" for i in range(4)]


def test_tree_matching_counts_shared_nodes():
    one = tree("<div><h1>a</h1><p>b</p><ul><li>c</li></ul></div>")[0]
    two = tree("<div><p>x</p><table><tr><td>y</td></tr></table><ul><li>z</li><li>z</li></ul></div>")[0]
    assert match(one, two, {})[0] == 5
    named = {node.tag for node in aligned(one, two).values()}
    assert named == {"", "div", "p", "ul", "li"}


def by_pattern(html):
    """The article of this table's pages, by its own markup."""
    found = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(re.sub("<[^>]*>", "", b).replace("&quot;", '"').replace("&lt;", "<").replace("&gt;", ">")
                       .replace("&#x27;", "'").replace("&amp;", "&").split()) for b in re.split("</?(?:p|h1)>", found)]
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    found = main_text(pages).collect()
    assert {r.page_id: r.text for r in found} == {i: by_pattern(h) for i, h in html.items()}
    assert all(r.n_chars == len(r.text) for r in found)


def test_no_page_of_a_large_host_is_left_alone(spark, monkeypatch):
    monkeypatch.setattr(html, "HOT_PART", 1)
    for count in (BLOCK + 1, 2 * BLOCK, 2 * BLOCK + 2):
        rows = [(i, "http://large.example/x", PAGE.format(i=i, more="")) for i in range(count)]
        found = main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert sorted((r.page_id, r.text) for r in found) == [(i, body(i)) for i in range(count)]


def test_odd_table_and_hot_host(spark):
    chance = random.Random(1)
    rows = [(i, "http://hot.example/x", PAGE.format(i=i, more="")) for i in range(3 * BLOCK + 5)]
    rows += [(i % 3, chance.choice(["http://a.example", "no url", None, ""]), h) for i, h in enumerate([None, "", "x", None, "x"])]
    rows.append((None, "http://a.example", "<p>é"))
    rows.append(rows[0])
    frame = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], SCHEMA)
    found = sorted((r.page_id if r.page_id is not None else -1, r.text) for r in main_text(frame).collect())
    expected = [(i, body(i)) for i in range(3 * BLOCK + 5)] + [(0, body(0)), (-1, "é"), (0, ""), (1, ""), (2, "x"), (0, ""), (1, "x")]
    assert found == sorted(expected)
    assert main_text(frame.limit(0)).count() == 0


PROBES = {
    '<h2 id="related-work">Related {0}</h2><p>t {0}</p>': "Related {0}\nt {0}",
    '<section id="search-methods"><p>m {0}</p></section><p>t {0}</p>': "m {0}\nt {0}",
    '<p id="comments-policy">cp {0}</p><p class="notice">t {0}</p>': "cp {0}\nt {0}",
    '<p>a <span class="notice">seen</span> b {0}</p>': "a seen b {0}",
    "<p>x {0}</p><button>Share<p>rest {0}</p>": "x {0}\nrest {0}",
    "<p>x {0}</p><button>Share</button><p>rest {0}</p>": "x {0}\nrest {0}",
    "<p>sum <math><mi>a</mi><mo>+</mo><annotation>a+b</annotation></math> is {0}</p>": "sum a+ is {0}",
    "<object data=a><object data=b>in {0}</object>fall {0}</object><p>t {0}</p>": "in {0}\nfall {0}\nt {0}",
    "<select><option>one<option>two</select><p>t {0}</p><svg><title>i</title><text>q</text></svg><p>u {0}</p>": "t {0}\nu {0}",
    "<noscript><p>t {0}</p>": "t {0}",
}


def test_names_and_controls_take_no_article_text():
    """Anchors, marked words, formulas, open controls and nested objects, on many pages and on one."""
    for inner, text in PROBES.items():
        page = "<title>{0}</title><article><h1>T {0}</h1>" + inner + "</article>"
        expected = [f"T {i}\n" + text.format(i) for i in range(5)]
        assert extract([page.format(i) for i in range(5)]) == expected
        assert extract([page.format(2)]) == expected[2:3]


def test_shared_headings_stay_between_the_text():
    page = (
        "<title>{0}</title><div><ul class=menu><li><a href=/>Home</a></ul><article><p>From the kitchen</p><h1>{0}</h1>"
        "<h2>Ingredients</h2><p>Flour {0}</p><h2>Method</h2><p>Stir {0}</p><blockquote>A proverb</blockquote><p>End {0}</p>"
        "<pre>All rights reserved</pre></article></div>"
    )
    assert extract([page.format(i) for i in range(6)]) == [
        f"{i}\nIngredients\nFlour {i}\nMethod\nStir {i}\nA proverb\nEnd {i}" for i in range(6)
    ]


def test_readers_and_boxes_are_left_out_by_whole_names():
    page = (
        "<title>{0}</title><article><h1>{0}</h1><p>Text {0}</p><div class='comments'><p>" + "long comment {0} " * 30
        + "</p></div><div class='share-buttons'>Share {0}</div><ol class='comment-list'><li>nice {0}</ol></article>"
    )
    assert extract([page.format(i) for i in range(4)]) == [f"{i}\nText {i}" for i in range(4)]


def test_deep_pages_keep_their_regions():
    page = "<div>" * 3000 + "<nav>menu</nav><p>deep {0}</p>" + "</div>" * 3000
    assert extract([page.format(i) for i in range(3)]) == [f"deep {i}" for i in range(3)]


def by_dynamic_programming(left, right, weights):
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, a in enumerate(left, 1):
        for j, b in enumerate(right, 1):
            both = best[i - 1][j - 1] + weights[a].get(b, 0)
            best[i][j] = max(best[i - 1][j], best[i][j - 1], both)
    return best[-1][-1]


def test_alignments_are_worth_most(monkeypatch):
    """Also where they are cut in halves for want of memory; in pieces they lose little."""
    chance = random.Random(6)
    for table, cells in ((10**6, 10**9), (20, 10**9), (1, 10**9), (20, 300)):
        monkeypatch.setattr(html, "TABLE", table)
        monkeypatch.setattr(html, "CELLS", cells)
        for _ in range(40):
            left = [chance.randrange(6) for _ in range(chance.randrange(1, 40))]
            right = [chance.randrange(6) for _ in range(chance.randrange(1, 40))]
            weights = {a: {b: chance.randrange(1, 5) for b in {*right} if (a + b) % 3 == 0} for a in range(6)}
            pairs = html._alignment(tuple(left), tuple(right), weights)
            assert all(x < y and z < w for (x, z), (y, w) in zip(pairs, pairs[1:], strict=False))
            worth = sum(weights[left[i]].get(right[j], 0) for i, j in pairs)
            best = by_dynamic_programming(left, right, weights)
            assert worth == best if cells == 10**9 else worth <= best


def test_pages_of_thousands_of_unlike_blocks():
    chance = random.Random(8)

    def page(number):
        tags = [chance.choice(["h2", "p", "ul", "blockquote", "pre"]) for _ in range(4000)]
        return "<article>" + "".join(f"<{t}>{number} {k}</{t}>" for k, t in enumerate(tags)) + "</article>"

    found = extract([page(i) for i in range(4)])
    assert [len(text.split("\n")) for text in found] == [4000] * 4


def test_alignments_do_not_depend_on_size(monkeypatch):
    """The same pairs, all that are worth most, whatever part of the table is kept."""
    chance = random.Random(9)
    for _ in range(40):
        left = tuple(chance.randrange(6) for _ in range(chance.randrange(30, 60)))
        right = tuple(chance.randrange(6) for _ in range(chance.randrange(30, 60)))
        weights = {a: {b: chance.randrange(1, 5) for b in {*right} if (a + b) % 3 == 0} for a in range(6)}
        found = []
        for table, cells in ((10**6, 10**9), (20, 10**9), (1, 10**9), (20, 300)):
            monkeypatch.setattr(html, "TABLE", table)
            monkeypatch.setattr(html, "CELLS", cells)
            found.append(html._alignment(left, right, weights))
        assert found.count(found[0]) == 4
        worth = sum(weights[left[i]].get(right[j], 0) for i, j in found[0])
        assert worth == by_dynamic_programming(left, right, weights)


def test_many_unlike_shapes_are_matched_in_depth():
    """Every part of one page lies in the other, with a line behind: all of it is found there."""

    def page(count, more):
        parts = []
        for k in range(count):
            tag = ("section", "blockquote")[k % 2]
            inner = "".join("<ul></ul>" + ("<p>a</p>" if k >> bit & 1 else "<pre>a</pre>") for bit in range(8))
            parts.append(f"<{tag}>{inner}{more}</{tag}>")
        return html.tree(f"<div>{more}{''.join(parts)}{more}</div>")[0]

    for count in (20, 240):
        shapes = html.Shapes()
        one, two = page(count, ""), page(count, "<h2>b</h2>")
        assert html.match(one, two, shapes)[0] == shapes.counts[one.shape]
