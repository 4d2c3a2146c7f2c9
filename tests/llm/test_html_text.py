import math
import re

from pyspark.sql import functions as F

from sugarmill.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>no";</script></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text&nbsp;here <a href="x>y">link</a>.<p>Second<br>line <div class="share">Share</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><aside>side</aside>
<form><p>mail</p></form><!-- <p>gone</p> --><blockquote>Quote &lt;x&gt; &#233;</blockquote></article><section id="comments"><article><p>I agree</p></article></section><footer>foot</footer></body></html>"""


def test_article_blocks(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", PAGE), (1, "http://a.com/x", PAGE), (2, None, None), (3, "http://a.com/y", ""), (None, "z", "plain <i>text</i> a < b"), (4, "u", "<p>unclosed <p")], "page_id long, url string, html string").withColumn("row", F.lit(1))
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract(df).collect()))
    body = "Title & more\nFirst bold text here link.\nSecond\nline\none\ntwo\nc1\nc2\nQuote <x> é"
    assert got == [(0, "plain text a < b"), (1, body), (1, body), (2, ""), (3, ""), (4, "unclosed <p")]
    assert html_text.extract(df.limit(0)).collect() == []


def test_repeated_branches_without_an_article_go(spark):
    rows = [(i, "http://h.com/" + str(i), f"<body><div class='top'><p>Welcome to the site</p></div><div class='body'><p>Own text {i}</p><p>More {i * 7}</p></div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i}\nMore {i * 7}" for i in range(12)}


def test_importance_is_the_entropy(spark):
    rows = [(i, "http://h.com/", f"<body><div class='x'>{'same' if i < 6 else i}</div></body>") for i in range(8)]
    tree = html_text.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))
    r = html_text.importance(tree).first()
    content = 1 - math.log(6) / (3 * math.log(8))
    assert abs(r.importance - 0.8 * content) < 1e-9 and re.fullmatch("/body/div.x", r.path)


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.com/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract(df).orderBy("page_id").collect()]


def test_entropy_overturns_names(spark, monkeypatch):
    article = "<body><div class='top'><p>Welcome</p></div><div class='by'><p>Written {1}</p></div><article><p>Own {0}</p><div class='note'>Same everywhere</div></article><nav>menu {0}</nav></body>"
    pages = [article.format(i, "by us" if i else "by x") for i in range(12)] + ["<body><div class='top'><p>Welcome</p></div><div class='body'><p>Plain page</p></div></body>"]
    want = [f"Own {i}" for i in range(12)] + ["Plain page"]
    assert extracted(spark, pages) == want
    differing = [article.format(i, i) for i in range(40)]
    assert extracted(spark, differing)[7] == "Written 7\nOwn 7"
    monkeypatch.setattr(html_text, "MOST_SENT", 0)
    assert extracted(spark, pages) == want


def test_copies_of_a_page_keep_their_article(spark):
    assert extracted(spark, ["<body><article><p>Only text</p></article></body>"] * 12) == ["Only text"] * 12
