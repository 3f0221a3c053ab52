import itertools
import re

import pytest

from posteria.llm import html_main as h
from tests.conftest import SF_DIR

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page has-sidebar"><header><h1>Site</h1>menu words</header>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies a lot of them</div><!-- <p>hidden words here</p> -->
<div class=content><article><h1>Big  Title</h1><p class=byline>By someone</p><script>var t="</p><p>no no no</p>";</script>
<p>First para &lt;with&gt; some words &amp; more&nbsp;words &#233;.</p><ul><li>one</li><li>two <b>wo</b>rds</li></ul><div class="ad">buy now</div>
<p>Second <i>para</i>graph with <a href="/x>y">a link</a><br>and more words here to see it</p><table><tr><td>a</td><td>b</td></tr></table><p>end here</article>
<section class="comments"><p>I like it very much thanks for the thing</p></section><form><label>Email please</label></form></div>
<aside>Other things to read</aside><footer>copy right 2020 all rights</footer></body>"""
WANT = ("Big Title\nBy someone\nFirst para <with> some words & more words é.\none\ntwo words\n"
        "Second paragraph with a link and more words here to see it\na\nb\nend here")  # fmt: skip


@pytest.fixture(scope="module")
def learned(spark):
    docs = SF_DIR.replace("0.001", "0.01")
    pages, documents = spark.read.parquet(docs + "/pages.parquet"), spark.read.parquet(docs + "/documents.parquet")
    return h.fit(h.labelled_sample(pages, documents))


def test_weights_have_the_signs_of_the_method(learned):
    assert learned.word > 0 and learned.tags and all(v < 0 for v in learned.tags.values())
    assert learned.parts["article"] > h.FOR and learned.parts[".ad"] < -3 and learned.parts["nav"] < -3 and learned.parts["footer"] < -3


@pytest.mark.parametrize("source", ["learned", "default"])
def test_a_page_of_another_kind(learned, source):
    weights = learned if source == "learned" else h.Weights(0.3)
    assert h.main_text(PAGE, weights) == WANT


def test_best_run_equals_brute_force():
    for scores in itertools.product([-2.0, -0.5, 0.0, 1.0], repeat=6):
        best = max([(sum(scores[a:b]), -a, -b) for a in range(6) for b in range(a + 1, 7)], default=None)
        a, b = h.best_run(list(scores))
        assert sum(scores[a:b]) == max(best[0], 0.0)


def articles(page):
    """The text of the article element of the table's own pages, read by rule."""
    import html

    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_every_page_of_the_table(spark, learned):
    pages = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/pages.parquet")
    want = {r["page_id"]: articles(r["html"]) for r in pages.collect()}
    out = h.extract(pages, learned).collect()
    assert len(out) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in out)


ODD = [None, "", "   ", "<", "plain words only", "<p>unclosed", "<div class='ad'>x y z", "<script>never ends", "a<b", "<!-- open", "<nav>only menu</nav>",
       "<p>" + "word " * 200000, "<b>" * 20000 + "deep words", "<a href=\"" * 3000]


def test_odd_pages(spark, learned):
    df = spark.createDataFrame([(i, None, p, 1) for i, p in enumerate(ODD)] + [(4, "u", ODD[4], 1)], "page_id long, url string, html string, text int")
    out = h.extract(df, learned).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(ODD) + 1 and all(by[i] == "" for i in (0, 1, 2, 7, 9, 10))
    assert by[4] == "plain words only" and by[5] == "unclosed" and by[12] == "deep words" and len(by[11].split()) == 200000
    assert h.extract(df.limit(0), learned).collect() == []


def test_no_labelled_page(spark):
    pages = spark.createDataFrame([(1, "http://x/none", PAGE)], "page_id long, url string, html string")
    documents = spark.createDataFrame([(1, "other")], "doc_id long, text string")
    assert h.fit(h.labelled_sample(pages, documents)) == h.Weights()
    assert h.fit(h.labelled_sample(pages.limit(0), documents.limit(0))) == h.Weights()


@pytest.mark.parametrize("tag", ["<svg/>", "<svg viewBox='0 0 1 1'/>", "<SVG a=b />", '<svg a=0/>', '<svg aria-label="x > y"/>', "<title-bar>Bar</title-bar>",
                                 '<script src="x.js"/>', "<script src=x/>no words</script>", "<svg/><svg a='b'><text>no</text></svg>", "<svg><text>no</text></svg>",
                                 "<object data=a/><object>no</object>", "<svg-icon></svg-icon>", '<script src="x"/><script>no</script>'])
def test_empty_and_longer_named_tags_swallow_nothing(tag):
    page = f"<html><body>{tag}<article><h1>Big Title</h1><p>rest of the page</p></article></body></html>"
    words = " ".join(t.text for t in h.tokens(page) if not t.kind).split()
    assert words == (["Bar"] if "Bar" in tag else []) + "Big Title rest of the page".split()
    inline = "".join(t.text for t in h.tokens(f"<p>one {tag}two</p>") if not t.kind).split()
    assert inline[0] == "one" and inline[-1].endswith("two")


def test_without_the_lists_of_names(spark, monkeypatch):
    """What the table's own pages have is learned; the lists are for what they do not have."""
    monkeypatch.setattr(h, "ASIDE_TAGS", frozenset())
    monkeypatch.setattr(h, "ASIDE_NAMES", frozenset())
    folder = SF_DIR.replace("0.001", "0.01")
    pages, documents = spark.read.parquet(folder + "/pages.parquet"), spark.read.parquet(folder + "/documents.parquet")
    weights = h.fit(h.labelled_sample(pages, documents))
    rows = pages.collect()
    right = sum(h.main_text(r["html"], weights) == articles(r["html"]) for r in rows)
    assert right >= 0.95 * len(rows)
    blind = sum(h.main_text(r["html"], h.Weights(weights.word)) == articles(r["html"]) for r in rows)
    assert blind < 0.9 * len(rows)  # the learned weights decide


BODY = "<p>" + "</p><p>".join(" ".join(f"word{i}{j}" for j in range(40)) for i in range(5)) + "</p>"


@pytest.mark.parametrize("page,want", [
    (f'<body><nav>menu of things</nav><div class="post related-posts-none"><h1>The Title</h1>{BODY}</div><footer>end</footer></body>', "The Title"),
    (f'<body><main><div class="alert-page">{BODY}</div></main><footer>copy right</footer></body>', ""),
    (f"<body><header>site</header><article><header><h1>The Title</h1></header>{BODY}</article></body>", "The Title"),
    (f'<body><article><h1>The Title</h1>{BODY}<div class="ad">buy this now</div>{BODY}</article></body>', "The Title"),
    (f'<body><article><h1>The Title</h1>{BODY}</article><section class="comments">{"<p>I like it so much</p>" * 60}</section></body>', "The Title"),
    (f'<body><div id="page"><div class="text"><h1>The Title</h1>{BODY}</div><div class="sidebar"><p>{"other things " * 30}</p></div></div></body>', "The Title"),
])
def test_parts_that_names_speak_against(learned, page, want):
    blocks = [" ".join(b.split()) for b in re.split("</?p>", BODY) if b.strip()]
    blocks = blocks * page.count(BODY)
    for weights in (learned, h.Weights(0.3)):
        assert h.main_text(page, weights).split("\n") == ([want] if want else []) + blocks


def test_the_sample_is_one_page_for_a_number(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i % 3}", f"<p>page {i}</p>") for i in range(30)], "page_id long, url string, html string")
    documents = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z"), (2, "w")], "doc_id long, text string")
    some = sorted((r["html"], r["text"]) for r in h.labelled_sample(pages.repartition(4), documents, 2).collect())
    assert some == [("<p>page 0</p>", "x"), ("<p>page 10</p>", "y")]
