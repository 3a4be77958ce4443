import html
import re

import pytest

from graphloom.llm import html as operator
from graphloom.llm.html import extract_main_text, main_text, op6_tag_path_ratio


def test_generated_pages(spark, sf_dir):
    """The pages' template is known: their article's headline and paragraphs, and nothing else."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op6_tag_path_ratio(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)(</article>|\Z)", pages[r.page_id].html)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", article))]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_the_ratio_alone_gives_the_same(spark, sf_dir):
    """With the article's tag made a div, nothing but the ratio finds the text."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").where("html IS NOT NULL").collect()]
    assert [main_text(re.sub(r"<(/?)article\b", r"<\1div", x)) for x in pages] == [main_text(x) for x in pages]


BODY = "<p>First, a sentence; with marks.</p><p>Second\n\t one,  here &amp; <b>there</b>: it ends.</p><ul><li>Item one, yes.<li>Item two, no.</ul>"
WANT = "First, a sentence; with marks.\nSecond one, here & there: it ends.\nItem one, yes.\nItem two, no."


@pytest.mark.parametrize(
    "page",
    [
        "<html><body><nav><a>Home</a> <a>About us, all of us.</a></nav><article>{}</article><footer>Footer, c.</footer></body></html>",
        "<div class='menu'><ul><li>One</li><li>Two</li></ul></div><div id='content'><div class=body>{}</div></div><div class='sidebar'><p>Related, stuff.</p></div>",
        "<header><h2>Site, name.</h2></header><main><article>{}<aside><p>An aside, by the way.</p></aside></article></main>",
        "<body><div>{}</div><div class='comments'><p>First, comment; long and bad, with many words, and marks.</p></div><form><p>Your name, please.</p></form></body>",
        "<body><script>var x = '<p>no, no.</p>';</script><style>p {{}}</style><!-- <p>hidden, too.</p> --><section>{}</section><div class='cookie-notice'>We use cookies, sorry.</div>",
        "<article>{}</article><article class='comment'><p>Reader, says.</p></article>",
        "<article>{}<div hidden><p>unseen, text.</p></div><div style='display:none'>unseen</div><noscript><p>No, script.</p></noscript></article>",
    ],
)
def test_what_is_left_out(page):
    assert main_text(page.format(BODY)) == WANT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p", ""), ("<!-- open", ""), ("<script>x", ""), ("plain text, no markup", "plain text, no markup"),
        ("<article><p>One, two.<p>Three &lt;four&gt; &#233;&eacute; &amp;amp;", "One, two.\nThree <four> éé &amp;"),
        ("<article><p><b>Bold, open.<br><p>Next, one.", "Bold, open.\nNext, one."),
        ("<article><p a='>'>x &nbsp; y, z.</p></article>", "x y, z."),
        ("<article><p>a < b, and 1 <2.</p></article>", "a < b, and 1 <2."),
        ("</div></p><article><p>Stray, ends.</p></b></article>", "Stray, ends."),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


def test_headline_before_the_text():
    assert main_text(f"<body><div class=top-menu>x</div><div id=w><h1>Title</h1><div>{BODY}</div></div></body>") == "Title\n" + WANT


@pytest.mark.parametrize(
    "page",
    [
        "<body><nav><a>Home</a></nav><div class='layout has-sidebar'><article>{}</article><div class=sidebar><p>Aside, text.</p></div></div></body>",
        "<body><div class='content no-comments'>{}</div><div class='comments'><p>First, comment; with marks.</p></div></body>",
        "<body><div class='page with_sidebar' id=layout--no-nav>{}</div></body>",
        "<body><div class='sidebar'><article>{}</article></div></body>",
        "<body><div class='widget'>{}<div class='share-buttons'><p>Share, this; now.</p></div></div></body>",
        "<body><div class=related><article><p>Other, story.</p></article></div><article>{}</article></body>",
        "<body><article>{}</article><div class='comments'><article><p>Reader, says; a lot, and with marks.</p></article></div></body>",
    ],
)
def test_marked_wrappers(page):
    assert main_text(page.format(BODY)) == WANT


def test_a_marked_section_of_the_article():
    related = "<section class='related-work'><h2>Related work</h2><p>Others, too, did this; and they wrote of it.</p></section>"
    for tag in ("article", "div"):
        page = f"<body><{tag}><section><p>{LONG}</p></section>{related}<section><p>{LONG}</p></section></{tag}></body>"
        assert main_text(page) == f"{LONG.strip()}\nRelated work\nOthers, too, did this; and they wrote of it.\n{LONG.strip()}"


LONG = "A long, full sentence; with marks, and with many more words than others have. " * 12
SHORT = "A short, full sentence; with marks, and words of its own, here and there. " * 3


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class=post><p>{s}</p><div class=body><p>{l}</p><p>{l}</p></div><p>{s}</p></div></body>",
        "<body><div id=w><div><h2>One</h2><p>{s}</p></div><div><h2>Two</h2><p>{l}</p><p>{l}</p></div><div><h2>Three</h2><p>{s}</p></div></div></body>",
        "<body><table><tr><td><p>{s}</p></td></tr><tr><td><p>{l}</p><p>{l}</p></td></tr><tr><td><p>{s}</p></td></tr></table></body>",
        "<body><article><p>{l}</p><p>{l}</p></article><article><p>{s}</p></article></body>",
    ],
)
def test_unequal_containers(page):
    page = page.format(s=SHORT, l=LONG)
    assert main_text(page).split("\n") == [t for x in re.split(r"<[^>]+>", page) if (t := x.strip())]
    menu = "<div><a href=x>Home</a></div><div><a href=x>All</a></div><div><a href=x>Us</a></div>"
    assert "Home" not in main_text(page.replace("<body>", f"<body>{menu}"))


#: Nothing in these pages is marked: only length, links and punctuation of the paths tell menus, adverts and footers from the text.
UNMARKED = [
    "<body><div><a href=a>Home</a> <a href=b>News</a></div><div>{}</div><div>Buy now</div><div>Example Inc, all rights reserved.</div></body>",
    "<body><article><div><a href=a>Home</a> <a href=b>News</a></div>{}<div>Buy now</div></article></body>",
    "<body><div id=w><div>Home News</div>{}<div>Buy now</div></div></body>",
    "<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><table><tr><td>Top</td><td>{}</td><td><a href=x>More, of this</a></td></tr></table><div>Terms</div></body>",
    "<body><div>Site name</div><main>{}</main><div>Write to us, soon.</div></body>",
    "<body><p>Welcome</p><div class=story>{}</div><p>Imprint</p></body>",
]


@pytest.mark.parametrize("page", UNMARKED)
def test_unmarked_boilerplate(page):
    text = f"<h1>A headline</h1><p>{LONG}</p><p>{SHORT}</p><ul><li>Item one, yes.<li>Item two, no.</ul><p>{LONG}</p>"
    assert main_text(page.format(text)) == "\n".join(["A headline", LONG.strip(), SHORT.strip(), "Item one, yes.", "Item two, no.", LONG.strip()])


def test_without_the_ratio_it_stays(monkeypatch):
    """With one ratio for all paths the same pages keep what is no part of the text: it is the ratio that tells."""
    monkeypatch.setattr(operator, "ratios", lambda page, found: {path: 1.0 for _, path, _, _ in found})
    text = f"<p>{LONG}</p><p>{SHORT}</p>"
    kept = [main_text(p.format(text)) != f"{LONG.strip()}\n{SHORT.strip()}" for p in UNMARKED]
    assert sum(kept) >= 5


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "post social-policy", "layout-with-nav", "notice-of-meeting", "related", "sidebar"])
def test_a_wrapper_of_all_text_stays(name):
    for tag in ("div", "section", "form", "aside"):
        assert main_text(f"<body><{tag} class='{name}'><p>{LONG}</p><p>{SHORT}</p></{tag}></body>") == f"{LONG.strip()}\n{SHORT.strip()}"


def test_a_page_without_text_beside_an_advert():
    assert main_text("<body><div class=ad>Buy this, now.</div><article><p></p></article></body>") == ""
    assert main_text("<body><nav><a>Home</a></nav><div class=ad>Buy this, now; it is good.</div><article><h1>One</h1><p>Word.</p></article><footer>Our, long, footer.</footer></body>") == "One\nWord."


def test_long_and_deep_pages_end():
    many = "".join(f"<p>Paragraph {i}, with some words.</p>" for i in range(20_000))
    assert main_text(f"<article>{many}</article>").count("\n") == 19_999
    assert main_text("<div>" * 20_000 + "<p>Deep, text.") == "Deep, text."
    assert main_text("<a href='" * 3000) == ""


def test_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a, b.", "old", 2), (2, None, None, None)], "page_id long, html string, Text string, extra int")
    assert sorted(map(tuple, extract_main_text(pages).collect()), key=str) == [(1, 2, "a, b.", 5), (2, None, "", 0)]
    assert extract_main_text(pages.limit(0)).isEmpty()
