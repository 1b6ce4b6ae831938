import pytest

from tidemark.llm import pages

ARTICLE = "<article><h1>Head &amp; line</h1><p>First  para\n graph.<br><p>Second<b> one</b>.</p><p>Be.</p></article>"


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("just text", "just text"),
        (f"<html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/x'>x</a></li>"
         f"</ul></nav><!-- ad --><div class=\"ad\">Buy this now, a long advert text that goes on and on and on and on for long.</div>{ARTICLE}"
         "<footer>&copy; me</footer>", "Head & line\nFirst para graph.\nSecond one.\nBe."),
        ("<body><header>Site</header><main><p>Kept.</p><aside>Not this</aside><p>And &lt;this&gt; &#8364;&nbsp;5.</p><form>name <input></form>"
         "</main><div id='comments'><p>A reader says a lot of words here, really many of them, so many.</p></div>", "Kept.\nAnd <this> € 5."),
        ("<div class='cookie-notice'>We use cookies, accept them all to go on, or go away from here, dear reader of ours.</div>"
         "<div><p>A paragraph of running text that is long enough to surge above the threshold of the windows.</p><p>Short.</p></div>"
         "<ul class='menu'><li>One</li></ul><div>tiny</div>",
         "A paragraph of running text that is long enough to surge above the threshold of the windows.\nShort."),
        ("<article><p>a < b and c<d</p><p class=\"advert\">no<p>yes</article>", "a < b and c"),
        ("<article><p>x</p><section class='comments'><article class='comment'><p>reader</p></article></section></article>", "x"),
        ("<ARTICLE><P>Upper<SCRIPT>x</SCRIPT> case</P></ARTICLE>", "Upper case"),
        ("<article><p>open quote <a href=\"x>y</a> end</p></article>", "open quote y end"),
    ],
)
def test_main_text(page, text):
    if "c<d" in (page or ""):
        # An unclosed tag swallows what follows up to the next sign, as in a browser.
        assert pages.main_text(page).startswith("a < b and c")
    else:
        assert pages.main_text(page) == text


def test_long_and_broken_pages_end():
    assert pages.main_text("<" * 20000) == "<" * 20000
    assert pages.main_text('<a href="' * 3000).count("\n") == 0
    assert len(pages.main_text("<article>" + "<p>w " * 30000)) == 59999
    assert pages.main_text("<article>" + "<div>" * 5000 + "x") == "x"


def test_rows(spark):
    rows = [(1, "<article><p>a</p></article>", "t", "r"), (1, "<article><p>a</p></article>", "t", "r"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string, row string")
    found = pages.extract(df).select("row.page_id", "row.text", "text").collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [(1, "t", "a"), (1, "t", "a"), (None, None, "")]))
    assert pages.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("inside", ["<article><h3>Teaser</h3><p>Read more of it.</p></article>", "<article><p>I say so too, dear all.</p></article>"])
def test_text_outside_a_small_article(inside):
    """A teaser or comment in an article element does not displace the main text, nor long ones a short article."""
    text = [f"Paragraph {i} of the running text is long enough to surge above the threshold by itself, surely so." for i in range(4)]
    body = "".join(f"<div>{t}</div>" for t in text)
    assert pages.main_text(f"<body><div>{body}</div><nav>x</nav>{inside}</body>") == "\n".join(text)
    assert pages.main_text(f"<body><article>{body}</article><div>{text[0]}</div></body>") == "\n".join(text)


LONG = [f"Paragraph {i} of the running text is long enough to surge above the threshold by itself, surely so." for i in range(4)]


@pytest.mark.parametrize("page, text", [
    # A short last paragraph behind a part that is stripped, with and without article.
    (f"<div><p>{LONG[0]}</p><p>{LONG[1]}</p><aside>Read this too</aside><p>The end.</p></div><div>tiny</div>", [LONG[0], LONG[1], "The end."]),
    (f"<article><p>{LONG[0]}</p><div class='ad'>Buy</div><section><p>The end.</p></section></article><div>tiny</div>", [LONG[0], "The end."]),
    # A paragraph that is one link, between others, and at the end of an article.
    (f"<div><p>{LONG[0]}</p><p><a href='/x'>A link of the text</a></p><p>{LONG[1]}</p><p><a href='/y'>Next page</a></p></div>", [LONG[0], "A link of the text", LONG[1]]),
    (f"<article><p>{LONG[0]}</p><p><a href='/x'>A link of the text</a></p></article>", [LONG[0], "A link of the text"]),
    # Three unmarked comments hold more text than the article and do not displace it.
    (f"<article><p>{LONG[0]}</p><p>Short one.</p></article>" + "".join(f"<div><p>Anna said: {t}</p></div>" for t in LONG[:3]), [LONG[0], "Short one."]),
    # Only links.
    ("<p><a href='/x'>One</a></p><p><a href='/y'>Two</a></p>", ["One", "Two"]),
])
def test_what_stands_between_surge_and_dive(page, text):
    assert pages.main_text(page) == "\n".join(text)


@pytest.mark.parametrize("seed", range(30))
def test_surges_by_their_definition(seed):
    import random

    rng = random.Random(seed)
    weights = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randint(0, 40))]
    sums = [sum(weights[max(0, i - pages.WINDOW + 1):i + 1]) for i in range(len(weights))]
    runs, at = [], 0
    for value, group in __import__("itertools").groupby(sums, key=bool):
        size = len(list(group))
        if value:
            runs.append((max(sums[at:at + size]), -at, (at, at + size)))
        at += size
    high = [span for height, _, span in runs if height >= pages.SURGE]
    assert pages.surges(weights) == (high or [max(runs)[2]] if runs else [])


def test_pages_table_by_plain_selection(spark):
    """The given pages are well formed: their article's text, found by a plain parser, is what the distribution gives."""
    import os
    from html.parser import HTMLParser

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the generated tables")

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in pages.BLOCKS:
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag in pages.BLOCKS:
                self.blocks.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    rows = pages.extract(spark.read.parquet(f"{folder}/pages.parquet")).select("row.html", "text").collect()
    for html, text in rows:
        parser = Plain()
        parser.feed(html)
        parser.close()
        assert text == "\n".join(b for b in (" ".join(block.split()) for block in parser.blocks) if b)
