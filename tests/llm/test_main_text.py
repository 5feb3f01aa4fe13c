import re
from html import unescape

from pyspark.sql import functions as F

from recordloom.llm.main_text import main_text


def article(html):
    """The given pages keep their text in one article element: its blocks by plain splitting."""
    inner = re.search("<article>(.*?)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1|br)>", inner))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted((p.page_id, p.url, article(p.html), len(article(p.html))) for p in pages.collect())
    assert sorted(map(tuple, main_text(pages).collect())) == want


LAYOUT = """<!doctype html><html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<div id="cookie-notice"><p>We use cookies on this site, please accept them all right now.</p></div>
<div class="site-nav"><ul><li><a href=/a>One</a><li><a href="/b">Two</a></ul></div>
<div class="wrap"><div class="post post-{n}"><h2>Title {n}</h2><p>First   paragraph of page {n}, long enough &amp; <b>bo</b>ld.
<p>Second&nbsp;one &lt;here&gt; with a <a href="x">link</a>, and more text to count.<ul><li>a point<li>another</ul>
<form><input name=q><button>Go</button></form><div class="ad-box ad"><p>Buy this product now, it is very cheap today.</p></div>
<table><tr><td>cell one<td>cell two</table></div>
<div class="comments"><p>A reader says a lot of things about this article, a lot.</p><p>And one more reader.</p></div></div>
<aside><p>Sidebar text that is fairly long as well, with many words.</p></aside><footer><p>Imprint</p></footer></body></html>"""


def test_layout_without_an_article_element(spark):
    pages = spark.createDataFrame([(n, f"http://h.example/{n}", LAYOUT.format(n=n)) for n in range(5)], "page_id bigint, url string, html string")
    for r in main_text(pages).collect():
        assert r.text == (f"Title {r.page_id}\nFirst paragraph of page {r.page_id}, long enough & bold.\n"
                          "Second one <here> with a link, and more text to count.\na point\nanother\ncell one\ncell two")


def test_hosts_outvote_a_page(spark):
    """A page whose long link list would win alone is read by its host's path."""
    plain = "<body><div class=story><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(n, "http://h.example/x", plain.format("words of the story " * 20, "short")) for n in range(6)]
    rows.append((9, "http://h.example/y", plain.format("a story of fair length, told here " * 3, "extra words " * 30)))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9].startswith("a story") and "extra words" not in got[9]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain text only"), (4, "http://a.b/", "<p>a < b && c > d<p>x &#233; &bogus;"),
            (4, "http://a.b/", "<p>a < b && c > d<p>x &#233; &bogus;"), (5, "http://a.b/", "<nav><p>menu</p></nav><script>x"),
            (None, "http://a.b/", "<div " * 3000 + "<p>" * 3000 + "deep " * 100_000), (7, "http://a.b/", "<p title='>\">t</p><!-- no end"),
            (8, "http://a.b/", "<div>" * 5000 + "<p>deep</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("paths", F.lit(1))
    got = [(r.page_id, r.text) for r in main_text(pages).collect()]
    texts = dict(got)
    assert len(got) == len(rows)
    assert texts[1] == texts[2] == texts[5] == "" and texts[3] == "plain text only"
    assert texts[4] == "a < b && c > d\nx é &bogus;" and texts[8] == "deep"
    assert main_text(pages.where("false")).collect() == []


def texts_of(spark, *htmls):
    rows = [(n, f"http://h{n}.example/", html) for n, html in enumerate(htmls)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    return [got[n] for n in range(len(htmls))]


def test_loose_signs_do_not_drop_the_text(spark):
    story = "<p>" + "words of the story " * 20 + "</p>"
    text = ("words of the story " * 20).strip()
    wrapped = [f"<body><div {attrs}><article>{story}</article></div><footer>imprint</footer></body>" for attrs in (
        "class='overflow-hidden'", "aria-hidden='false'", "class='layout has-sidebar'", "class='elementor-widget x'",
        "class='post-header'", "class=widget", "data-x='hidden'")]
    wrapped += [f"<body><form id=aspnet>{story}</form></body>", f"<body><div class=banner>{story}</div></body>",
                f"<body><svg width='1'/><article>{story}</article></body>"]
    assert texts_of(spark, *wrapped) == [text] * len(wrapped)
    kept = f"<body><article>{story}<figure><img src=a><figcaption>a caption</figcaption></figure></article></body>"
    dropped = f"<body><article>{story}</article><div hidden>{story}</div><div class=comments><article>{story * 2}</article></div></body>"
    assert texts_of(spark, kept, dropped, "<div hidden>gone</div>") == [f"{text}\na caption", text, ""]


def test_heading_and_lead_outside_the_inner_body(spark):
    body = "<p>" + "long text of the body " * 40 + "</p>"
    want = "A title\nA lead\n" + ("long text of the body " * 40).strip()
    links = "<ul>" + "<li><a href=x>another page</a></li>" * 9 + "</ul>"
    head = "<h1>A title</h1><p>A lead</p>"
    pages = [f"<body><article>{head}<div class=body>{body}</div></article>{links}</body>",
             f"<body><div class=a><article><div class=x>{head}</div><section>{body}</section></article></div>{links}</body>",
             f"<body><div class=nav>{links}</div><main>{head}<div class=body>{body}</div></main></body>",
             f"<body><div class=post>{head}<div class=body>{body}</div></div><div class=more>{links}</div></body>",
             f"<body>{head}<div class=body>{body}</div></body>"]
    assert texts_of(spark, *pages) == [want] * len(pages)
