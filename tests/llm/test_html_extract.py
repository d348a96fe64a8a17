import html
import random
import re
import time

import pyarrow.parquet as pq

from callweave.llm import html_extract, queries
from tests.llm.helpers import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Site name</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to give you a better time, and you can turn them off at any time.</p></div>
<div id="sidebar"><p>Popular: something else that is quite long, so that its ratio of text to tags is high as well.</p></div>
{article}
<form><p>Write to us about whatever you like in this long and winding form.</p><input name=a></form>
<section id="comments"><article class="comment"><p>A reader says a lot of things in this long comment that is not the article.</p></article></section>
<div class="ad">Buy this thing now, it is very good and it has a long text as well.</div>
<footer>&copy; someone &middot; all the rest</footer></body></html>"""
BLOCKS = ["Heading &amp; more", "First <b>bold</b> and\n  <i>slanted</i>&nbsp;text &lt;tag&gt; caf&eacute; &#x1F642;.", "Es.", "A third one that is long enough to look like a paragraph of an article, with words.", "Last."]
WANT = "Heading & more\nFirst bold and slanted text <tag> café 🙂.\nEs.\nA third one that is long enough to look like a paragraph of an article, with words.\nLast."


def test_articles_in_several_templates():
    inner = f"<h1>{BLOCKS[0]}</h1>" + "".join(f"<p>{b}</p>" for b in BLOCKS[1:])
    for article in (
        f"<article>{inner}</article>",
        f"<main><div>{inner}</div></main>",
        f"<div class=content>{inner}</div>",
        f"<article><header><h1>{BLOCKS[0]}</h1></header>" + "".join(f"<p>{b}" for b in BLOCKS[1:]) + "<aside>Aside</aside></article>",
        f'<div role="main"><h1>{BLOCKS[0]}</h1><ul>' + "".join(f"<li>{b}" for b in BLOCKS[1:]) + "</ul></div>",
    ):
        assert html_extract.main_text(PAGE.format(article=article)) == WANT, article


def test_unclosed_tags_and_breaks():
    assert html_extract.main_text("<article><p><b>One<br><p>Two<br/>three</article><footer>no") == "One\nTwo three"
    assert html_extract.main_text("plain text\n only") == "plain text only"
    assert html_extract.main_text("<nav>menu</nav>") == html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<article>" + "<p>x</p>" * 5000 + "</article>") == "\n".join("x" * 5000)
    assert html_extract.main_text("<p>a" * 2000) == "\n".join("a" * 2000)


def test_one_dominant_block_without_an_article_tag():
    long, short = "many words " * 180 + "end", "a few words " * 8 + "end"
    for first, second in ((f"<p>{long}</p>", f"<p>{short}</p>"), (f"<div>{long}</div>", f"<div>{short}</div>"), (f"<p><span>{long}</span></p>", f"<ul><li><b>{short}</b></ul>")):
        inner = f"<h1>Title</h1>{first}{second}"
        for page in (f"<body>{inner}</body>", f"<body><nav>Menu</nav><div><section>{inner}</section></div><footer>foot</footer></body>", inner):
            assert html_extract.main_text(page) == f"Title\n{long}\n{short}", page


LONG = "A paragraph of an article has many words between two tags, as this one has, and goes on for a while."
UNMARKED = """<body><div><ul>{menu}</ul></div><div><div>{a}</div><div>{a}</div><div>Short.</div><div>{a}</div></div>
<div><p><a href=/>Terms</a></p><p><a href=/>Privacy</a></p><p><a href=/>Imprint</a></p><p>2020</p></div></body>"""


def test_clusters_decide_without_any_mark(monkeypatch):
    """No article, no list word: the method alone tells text from menus. Without any of its steps the result is another."""
    page = UNMARKED.format(menu="".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(12)), a=LONG)
    want = "\n".join([LONG, LONG, "Short.", LONG])
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "content_lines", lambda lines, flags, sigma: {i for i, x in enumerate(lines) if not flags[x.element] & html_extract.DROP})
    assert html_extract.main_text(page) != want


def test_each_step_counts(monkeypatch):
    def chosen(page):
        lines = html_extract.Lines()
        lines.feed(page)
        lines.close()
        lines.flush()
        return [lines.lines[i].text for i in sorted(html_extract.content_lines(lines.lines, lines.flags, 1.0))]

    menu = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(12))
    page = UNMARKED.format(menu=menu, a=LONG)
    assert chosen(page) == [LONG, LONG, "Short.", LONG, "Terms"]
    with monkeypatch.context() as m:  # without smoothing the short line is lost
        m.setattr(html_extract, "smoothed", lambda ratios, sigma: ratios)
        assert chosen(page) == [LONG, LONG, LONG]
    with monkeypatch.context() as m:  # without the threshold nothing is
        m.setattr(html_extract.math, "sqrt", lambda x: -1.0)
        assert len(chosen(page)) == 20
    # the ratio is one of text to tags: a line of many tags and as much text is no content
    tagged = "".join(f"<b>{w}</b> " for w in LONG.split())
    assert tagged.count("<b>") > 15 and chosen(f"<div>{LONG}</div>" * 4 + f"<p>{tagged}</p>" * 6)[-1] == LONG


def test_words_of_classes_inside_an_article():
    page = """<article><h2 class="widget-title">Heading</h2><p>{a}</p><section id="search"><p>{a}</p></section><label>Kept</label><p class="related">{a}</p>
    <ul class="related">{menu}</ul><div class="ad">{a}</div></article>"""
    got = html_extract.main_text(page.format(a=LONG, menu="".join(f"<li><a href=/{k}>See {k}</a></li>" for k in range(15))))
    lines = got.split("\n")
    assert lines[0] == "Heading" and lines.count(LONG) == 3 and "Kept" in lines
    assert not any(f"See {k}" in lines for k in range(2, 15))


def test_deep_and_long_markup_takes_linear_time():
    for unit in ("<div>", "<b><p>", "<b>x<p>y</b>", "<li><td>", "<a>", "</b></div>", "<i><div></i>"):
        began = time.time()
        html_extract.main_text(f"<body>{'<b>' * 5000}{unit * 40_000}text</body>")
        assert time.time() - began < 5, unit


def test_dropped_elements_within_a_line():
    """Scripts, styles, buttons, forms, adverts and hidden parts, in a paragraph and between paragraphs."""
    inside = '<p>Say <button>go</button> <script>var x=1</script><style>.a</style> <span hidden>hid</span> <span class="advert">buy</span> end</p>'
    assert html_extract.main_text(f"<article>{inside}</article>") == "Say end"
    for between in ("<script>var x=1;</script>", '<span class="advert">Buy now</span>', "<style>.b{}</style>", "<template>t</template>", '<b style="display: none">no</b>', "<svg><text>no</text></svg>", "<select><option>no</select>", "<textarea>no</textarea>", "<noscript>no</noscript>", '<span hidden>a<div>b</div>c</span>', '<label hidden>x</label>', "<form>no</form>"):
        assert html_extract.main_text(f"<article><p>{LONG}</p>{between}<p>{LONG}</p></article>") == f"{LONG}\n{LONG}", between
        if "<div>" not in between:  # a block ends the paragraph, and what is open in it
            assert html_extract.main_text(f"<article><p>One {between} two</p></article>") in ("One two", "One\ntwo"), between
        assert html_extract.main_text(f"<body><div><p>{LONG}</p>{between}<p>{LONG}</p></div></body>") == f"{LONG}\n{LONG}", between
    assert html_extract.main_text("<article>Text <span hidden>hid <div>block</div></span> end</article>") == "Text\nend"


def test_words_that_are_parts_of_names():
    """Paragraphs of an article may have any class; containers are dropped for a whole word."""
    for name in ('class="share-price"', 'class="social"', 'class="navigation-theory"', 'id="comments-on-law"', 'id="ad"', 'class="notice-of-war"'):
        page = f"<article><p>{LONG}</p><p {name}>{LONG} Kept.</p><p>{LONG}</p></article>"
        assert html_extract.main_text(page) == f"{LONG}\n{LONG} Kept.\n{LONG}", name
    for mark in ('div class="ad"', 'div class="x comments"', 'section id="share"', 'ul class="social"'):
        assert html_extract.main_text(f"<article><p>{LONG}</p><{mark}>{LONG}</{mark.split()[0]}></article>") == LONG, mark
    assert html_extract.main_text(f'<article><p>{LONG}</p><div class="notice-of-war"><p>{LONG}</p></div></article>') == f"{LONG}\n{LONG}"


def test_clusters_decide_within_an_article(monkeypatch):
    """An unmarked list of links in an article goes, a single link and one amid text stay; without the method it stays."""
    share = "<div><a href=/f>One</a></div><div><a href=/t>Two</a></div><div><a href=/m>Three</a></div>"
    page = f'<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG} <a href="/x">a link</a></p><p>{LONG}</p>{share}</article>'
    want = "\n".join(["Title", LONG, LONG, LONG + " a link", LONG])
    assert html_extract.main_text(page) == want
    assert html_extract.main_text(page.replace(share, "<p><a href=/s>Source</a></p>")) == want + "\nSource"
    monkeypatch.setattr(html_extract, "content_lines", lambda lines, flags, sigma: {i for i, x in enumerate(lines) if not flags[x.element] & html_extract.DROP})
    assert html_extract.main_text(page) != want


def test_clusters_decide_on_given_pages_without_their_marks(monkeypatch):
    """With plain containers and no classes most given pages still give the same text; without the clusters none does."""
    pages = [r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    bare = lambda x: re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section|form)\b", r"<\1div", x))
    plain, want = [bare(x) for x in pages], [html_extract.main_text(x) for x in pages]
    same = lambda: sum(html_extract.main_text(x) == w for x, w in zip(plain, want, strict=True)) / len(pages)
    assert same() > 0.5
    monkeypatch.setattr(html_extract, "content_lines", lambda lines, flags, sigma: {i for i, x in enumerate(lines) if not flags[x.element] & html_extract.DROP})
    assert same() < 0.05


def test_notices():
    assert html_extract.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p><p>Copyright 2020</p></div></body>") == f"{LONG}\n{LONG}"
    assert html_extract.main_text(f"<article><p>{LONG}</p><p>Copyright is a right.</p></article>") == f"{LONG}\nCopyright is a right."


def test_tags_that_never_end():
    for unit in ("<a ", '<p x="', "<!--", "<![CDATA[", "<?x ", "</a ", "<!x ", "<b x='", "<a <b>", "<", "< a", "<a/", "&", "&#", "&amp"):
        began = time.time()
        html_extract.main_text("<p>text</p>" + unit * 30_000)
        assert time.time() - began < 5, unit
    assert html_extract.main_text("<p>one</p><p>two <a href") == "one\ntwo" and html_extract.main_text("1 < 2 and 3 > 2, a<") == "1 < 2 and 3 > 2, a<"


def test_pages_against_a_plain_reading(spark):
    """Articles of the test pages have no nested blocks, so a few patterns read them too."""
    got = {r["page_id"]: r for r in queries.op4_html(spark, SF).collect()}
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"<h1>|</h1>|<p>|</p>", article)
        text = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks]
        assert got[r["page_id"]]["text"] == "\n".join(t for t in text if t)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_odd_rows(spark):
    rng = random.Random(2)
    junk = ["".join(rng.choice(["<p>", "</p>", "<b", "<!--", "&", "&#0;", "<![CDATA[", "a", "<div class=>", "</", "<script>", "'", '"', "<?x", ">"]) for _ in range(60)) for _ in range(200)]
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "", None), (2, "u", "<p>" + "long " * 60_000, "x")] + [(i, "u", j, "x") for i, j in enumerate(junk)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert html_extract.extract(df).count() == len(rows)
    assert html_extract.extract(spark.createDataFrame([], df.schema)).collect() == []
