import re
import time

import pytest

from tabwright.llm import html_text
from tabwright.llm.html_text import extract_text, joined, main_text, op4_html_text, regions, threshold

SENTENCE = "The quick brown fox jumps over the lazy dog while the band plays on. "

CASES = {
    "plain article": ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>One  two\n three</p><p>Four</p></article><footer>&copy; me</footer></body>", "Title\nOne two three\nFour"),
    "references": ("<article><p>a &amp; b &#38;amp; &eacute;&#x41; &lt;p&gt; &nbsp;x&hellip;</p></article>", "a & b &amp; éA <p> x…"),
    "script and style": (f"<body><script>var a='</p>{SENTENCE}';</script><style>p{{}}</style><article><p>kept</p></article></body>", "kept"),
    "comment with markup": ("<article><!-- <p>no</p> --><p>yes</p></article>", "yes"),
    "unclosed paragraphs": ("<article><h1>T</h1><p>one<p><b>two<br>three<p>four</article><footer>no", "T\none\ntwo\nthree\nfour"),
    "aside in the article": ("<article><p>a b c</p><aside>related things</aside><p>d e f</p></article>", "a b c\nd e f"),
    "advert by class": (f"<div class='ad'>{SENTENCE * 9}</div><article><p>short</p></article>", "short"),
    "reader comments": (f"<article><p>{SENTENCE * 3}</p></article><div id='comments'><p>{SENTENCE * 9}</p></div>", SENTENCE.strip() + (" " + SENTENCE.strip()) * 2),
    "header in the article": ("<header>Site name</header><article><header class='entry-header'><h1>Title</h1></header><p>text</p></article>", "Title\ntext"),
    "title in a marked block": ("<article><div class='post-header'><h1>Title</h1></div><p>text</p><div class='post-share'>share me</div></article>", "Title\ntext"),
    "no article element": (f"<div class=menu><a>x</a></div><div><p>{SENTENCE}</p><p>So.</p><p>{SENTENCE}</p></div><div class='site-footer'>{SENTENCE}</div>", f"{SENTENCE.strip()}\nSo.\n{SENTENCE.strip()}"),
    "a marked wrapper around all": (f"<body><div class='has-sidebar'><p>{SENTENCE}</p></div></body>", SENTENCE.strip()),
    "advert between paragraphs": (f"<nav>x</nav><div id='content'><p>{SENTENCE * 3}</p><div class='ad'>buy</div><p>So it ends.</p></div><footer>me</footer>", SENTENCE.strip() + (" " + SENTENCE.strip()) * 2 + "\nSo it ends."),
    "form": ("<article><p>before</p><form><p>name</p><input></form><p>after</p></article>", "before\nafter"),
    "list and table": ("<main><p>p</p><ul><li>one</li><li>two</li></ul><table><tr><td>c1<td>c2</table></main>", "p\none\ntwo\nc1\nc2"),
    "inline links": ("<article><p>see <a href=x>the <i>page</i></a> now</p></article>", "see the page now"),
    "empty": ("", ""),
    "null": (None, ""),
    "no text": ("<html><body><nav>menu</nav></body></html>", ""),
    "plain text": ("just  words", "just words"),
    "loose signs": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    "quoted bracket": ("<article><p title='a > b'>text</p></article>", "text"),
    "upper case": ("<ARTICLE><P>Text</P><ASIDE>no</ASIDE></ARTICLE>", "Text"),
    "hidden": ("<article><p hidden>no</p><p style='display:none'>no</p><p>yes</p></article>", "yes"),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_query(spark, sf_dir):
    """The made pages hold one article between a menu, an advert and a footer: nothing else may come along."""
    rows = op4_html_text(spark, sf_dir).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    assert len(rows) == len(pages)
    import html

    for p, url, h in zip(pages.page_id, pages.url, pages.html, strict=True):
        body = re.sub(r"<br\s*/?>|</?(?:p|h1|div|li|ul|blockquote)\b[^>]*>", "\0", re.search(r"<article>(.*)</article>", h, re.S)[1])
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in body.split("\0")]
        assert rows.text[p] == "\n".join(x for x in want if x) and rows.n_chars[p] == len(rows.text[p]) and rows.url[p] == url


def test_awkward(spark):
    rows = [(1, "u", None, 1, "t"), (1, None, "", 2, None), (None, "u", "<p>x", 3, "t"), (2, "u", "<article><p>" + "word " * 400_000, 4, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = {(r.page_id, r.url): (r.text[:3], r.n_chars) for r in extract_text(df).collect()}
    assert got == {(1, "u"): ("", 0), (1, None): ("", 0), (None, "u"): ("x", 1), (2, "u"): ("wor", 1_999_999)}
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<", "<p", "<a b='", "<!--", "<script>", "</p>", "<div>", "&", "<p class=\"", "<x y", "<b><p>", "'\">"])
def test_time_is_linear(part):
    """Pages of one broken piece repeated take time in proportion to their length."""
    begin = time.time()
    main_text("<article>" + part * 30_000)
    assert time.time() - begin < 10


def test_regions():
    assert regions([5, 5, 0, 5], [False, False, True, False], window=2) == [(0, 4)]
    assert regions([5, 0, 0, 5], [False, True, True, False], window=2) == [(0, 1), (3, 4)]
    assert regions([], []) == []
    # A dive lasts for a window, what is low for less stays; a surge begins with a line that has weight.
    assert regions([0, 2, 90, 90, 3, 3, 3, 3], [False] * 8, 10) == [(1, 4)]
    assert regions([90, 90, 3, 3], [False] * 4, 10) == [(0, 4)]
    assert joined([(0, 2), (5, 7)], [90, 90, 3, 3, 3, 90, 90], [False] * 7) == [(0, 7)]
    assert joined([(0, 2), (5, 7)], [90, 90, 3, 0, 3, 90, 90], [False] * 7) == [(0, 2), (5, 7)]


def test_threshold():
    assert threshold([]) == threshold([0, 0, 7]) == threshold([5, 5, 5]) == 0
    assert threshold([100, 150, 200, 240]) == 0  # one kind of lines
    assert 105 < threshold([0] * 38 + [570, 1035, 1000, 535] + [105] * 18 + [70, 35]) < 535


MENU = "".join(f"<div><a href='/{k}'>menu entry {k}</a></div>" for k in range(40))
LEGAL = "".join(f"<div>Acme {k}, reg. no. {k}{k}, printed in Ulm</div>" for k in range(20))
PLAIN = {
    "menu, paragraphs, small print": (f"{MENU}<div>{SENTENCE * 7}</div><div>{SENTENCE * 8}</div>{LEGAL}", [SENTENCE * 7, SENTENCE * 8]),
    "a heading and a short end": (f"{MENU}<div>A heading</div><div>{SENTENCE * 7}</div><div>{SENTENCE * 8}</div><div>The end.</div>", ["A heading", SENTENCE * 7, SENTENCE * 8, "The end."]),
    "two parts around a menu": (f"<div>{SENTENCE * 7}</div>{MENU}<div>{SENTENCE * 6}</div><div>{SENTENCE * 5}</div>{LEGAL}", [SENTENCE * 7, SENTENCE * 6, SENTENCE * 5]),
    "short lines amid long ones": (f"<div>{SENTENCE * 7}</div><div>Yes.</div><div>No.</div><div>Why?</div><div>So.</div><div>{SENTENCE * 8}</div>{MENU}", [SENTENCE * 7, "Yes.", "No.", "Why?", "So.", SENTENCE * 8]),
    "lines of one kind": ("".join(f"<div>line {k} of a poem that goes on</div>" for k in range(30)), [f"line {k} of a poem that goes on" for k in range(30)]),
    "copyright": (f"<div>{SENTENCE * 7}</div><div>{SENTENCE}</div><div>Copyright 2024 Acme</div><div>&copy; Acme, all rights reserved</div>", [SENTENCE * 7, SENTENCE]),
    "unlike articles around a menu": (f"<article><p>{SENTENCE * 8}</p></article><nav>x</nav><article><p>{SENTENCE}</p><p>{SENTENCE}</p></article>", [SENTENCE * 8, SENTENCE, SENTENCE]),
    "names of paragraphs": (f"<article><p class='social-history'>{SENTENCE}</p><p class='alert-level'>b</p><section class='discussion'>c</section><p class='ad'>no</p><div class='comments-area'>no</div></article>", [SENTENCE, "b", "c"]),
    "teasers outside": (f"<article><p>short</p></article><div>{SENTENCE}</div>", [SENTENCE]),
}


@pytest.mark.parametrize("name", PLAIN)
def test_the_distribution_decides(name):
    page, want = PLAIN[name]
    assert main_text(f"<html><body>{page}</body></html>").split("\n") == [x.strip() for x in want]


INSIDE = {
    "heading and note around a nested article": (f"<main><h1>Title</h1><article><p>{SENTENCE * 9}</p></article><p>closing note</p></main>", ["Title", SENTENCE * 9, "closing note"]),
    "two articles": (f"<article><p>{SENTENCE * 20}</p></article><article><p>short one</p></article>", [SENTENCE * 20, "short one"]),
    "an article in another": (f"<article><p>{SENTENCE * 20}</p><article><p>inner</p></article><p>end</p></article>", [SENTENCE * 20, "inner", "end"]),
    "dropped elements in a row": (f"<article><p>{SENTENCE * 20}</p><div class='ad'>buy</div><aside>x</aside><form>y</form><nav>z</nav><p>The end.</p></article>", [SENTENCE * 20, "The end."]),
    "a dropped article in another": (f"<article><p>{SENTENCE * 20}</p><article class='comment'>no</article><p>The end.</p></article><p>{SENTENCE}</p>", [SENTENCE * 20, "The end."]),
}


@pytest.mark.parametrize("name", INSIDE)
def test_all_of_an_article_stays(name):
    page, want = INSIDE[name]
    assert main_text(page).split("\n") == [x.strip() for x in want]


LONG, END = f"<p>{SENTENCE * 9}</p>", "<div>(c) 2024 Acme</div>"
WRAPPED = {
    **{f"article in {name}": (f"<div class='{name}'><article>{LONG}</article></div>{END}", SENTENCE * 9) for name in ("content has-sidebar", "with-ads", "no-sidebar", "page-header-fixed", "comments-open", "widget")},
    "main in a form": (f"<form id='all'><main>{LONG}</main></form>{END}", SENTENCE * 9),
    "text without an article": (f"<div class='content has-sidebar'>{LONG}<p>So.</p></div><nav>x</nav>{END}", SENTENCE * 8 + SENTENCE.strip() + "\nSo."),
    "wrapper in a wrapper": (f"<div class='has-sidebar'><div class='with-ads'><article>{LONG}</article></div></div>{END}", SENTENCE * 9),
    "deep wrappers": ("<div class='has-sidebar'>" * 20 + f"<article>{LONG}</article>" + "</div>" * 20 + END, SENTENCE * 9),
    "what a wrapper drops": (f"<div class='has-sidebar'><article>{LONG}</article><div id='comments'><article>{LONG * 3}</article></div><div class='sidebar'><p>{SENTENCE}</p></div></div>{END}", SENTENCE * 9),
    "long comments": (f"<div><p>{SENTENCE}</p></div><div id='comments'><article>{LONG * 3}</article></div>", SENTENCE),
    "teasers": (f"<div><p>{SENTENCE * 9}</p></div><div class='sidebar'><article>{SENTENCE}</article></div>", SENTENCE * 9),
    "hidden in a value": (f"<div data-title='A hidden gem' data-id='sidebar' title='class=ad'><article>{LONG}</article></div>{END}", SENTENCE * 9),
    "hidden in a value, inside": (f"<article><p title='the hidden one'>{SENTENCE}</p><p HIDDEN=''>no</p><p aria-hidden=true>no</p><p>b</p></article>", SENTENCE.strip() + "\nb"),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_marked_wrappers(name):
    page, want = WRAPPED[name]
    assert main_text(page) == want.strip()


PROBES = {
    "a title and a short end": (f"<h1>Title</h1><p>by A. Writer</p><p>{SENTENCE * 9}</p><p>{SENTENCE * 8}</p><p>{SENTENCE * 9}</p><p>Yes.</p><p>No, she said.</p><p>The end.</p>", ["Title", "by A. Writer", SENTENCE * 9, SENTENCE * 8, SENTENCE * 9, "Yes.", "No, she said.", "The end."]),
    "a list of steps": (f"<p>{SENTENCE * 12}</p><ul>{''.join(f'<li>Step {k}</li>' for k in range(12))}</ul>", [SENTENCE * 12, *(f"Step {k}" for k in range(12))]),
    "dialogue": (f"<p>{SENTENCE * 9}</p><p>{SENTENCE * 9}</p>" + "".join(f"<p>So, {k}.</p>" for k in range(10)), [SENTENCE * 9, SENTENCE * 9, *(f"So, {k}." for k in range(10))]),
    "names with other words": (f"<article><p>{SENTENCE}</p><section class='ad-astra'><p>a</p></section><div class='comment-free'>b</div><p class='share'>c</p><div class='share-buttons'>no</div></article>", [SENTENCE, "a", "b", "c"]),
    "an advert under many wrappers": ("<div class='has-sidebar'>" * 12 + f"<article>{LONG}<div class='ad'>buy</div>{LONG}</article>" + "</div>" * 12 + END, [SENTENCE * 9, SENTENCE * 9]),
}


@pytest.mark.parametrize("name", PROBES)
def test_nothing_is_lost(name):
    page, want = PROBES[name]
    assert main_text(f"<html><body>{MENU}{page}</body></html>").split("\n") == [x.strip() for x in want]


def test_regions_decide(spark, sf_dir, monkeypatch):
    """Menus, adverts and footers are among the lines: without surges and dives they would come along, on nearly all pages."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    before = [main_text(h) for h in pages]
    monkeypatch.setattr(html_text, "regions", lambda weights, *_, **__: [(0, len(weights))])
    assert sum(main_text(h) != t for h, t in zip(pages, before, strict=True)) > 0.9 * len(pages)
