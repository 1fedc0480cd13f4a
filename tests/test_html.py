import time

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.sources import html as H

NEWS = """<!doctype html><html lang="it-IT"><head><title> Il  titolo &amp; co </title><meta name="generator" content="WordPress 6"><meta name="keywords" content="a, b,, c">
<meta property="og:locale" content="it_IT"><meta property="og:title" content="x"><meta name="description" content="d1"><meta name="description" content="d2"><meta name="empty">
<link rel="canonical" href="https://n.example/c"><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" hreflang="en" href="/en">
<script type="application/ld+json">{"@graph": [{"@type": ["NewsArticle", "https://schema.org/Thing"], "publisher": {"name": "P"}, "datePublished": "2026-01-01"}], "isAccessibleForFree": "no"}</script>
<script type="application/ld+json">{broken</script></head>
<body itemscope itemtype="https://schema.org/WebPage"><nav><a href="/2026/01/x">uno</a><a href="https://sub.n.example/b">due</a><a href="#t">no</a><a href="mailto:x@y.z">no</a></nav>
<h1>Prima   notizia</h1><form role="search"><input name="q"></form><form><input type="password"></form><a href="/checkout">Compra</a><a href="https://t.example/">fuori</a>
<p>Un testo abbastanza lungo che parla di una notizia importante del giorno.<p>Secondo paragrafo della notizia con altre parole.<img src=a><img src=b></body></html>"""


def test_news_page():
    f = H.facts("https://n.example/a", NEWS)
    assert f["title"] == "Il titolo & co" and f["html_lang"] == "it-IT" and f["meta_description"] == "d2" and f["meta_keywords"] == ["a", "b", "c"]
    assert f["canonical"] == "https://n.example/c" and f["feeds"] == ["/feed"] and f["hreflang"] == ["en"] and dict(f["og"]) == {"locale": "it_IT", "title": "x"}
    assert (f["n_links_internal"], f["n_links_external"], f["n_images"], f["n_forms"], f["n_scripts"]) == (3, 1, 2, 2, 2)
    assert f["article_link_density"] == 0.25 and f["has_login_form"] and f["has_search_form"] and f["has_cart_link"]
    assert f["jsonld_types"] == ["NewsArticle", "Thing"] and f["jsonld_publisher"] == "P" and f["jsonld_date_published"] == "2026-01-01" and f["is_accessible_for_free"] is False
    assert f["microdata_types"] == ["WebPage"] and f["headings"] == ["Prima notizia"]
    assert "Secondo paragrafo" in f["text_main"] and "uno" not in f["text_main"] and "uno" in f["body_text"]


def test_empty_broken_and_deep_pages():
    assert H.facts(None, None)["title"] is None and H.facts("x", "")["body_text"] == ""
    assert H.facts("https://a.example", "<a href='http://[bad'>x</a><p>t")["n_links_internal"] == 0
    t = time.time()
    H.facts("https://a.example", "<div>" * 3000 + "9" * 3_000_000)
    assert time.time() - t < 5


def test_rows_and_poison(spark):
    df = spark.createDataFrame([(1, "https://n.example/a", NEWS, "clash"), (2, None, None, None), (3, "u", "<html><title>t</title>", "x")], "page_id long, url string, html string, title string")
    got = {r.page_id: r for r in H.extract(df, "page_id").collect()}
    assert got[1].title == "Il titolo & co" and got[2].title is None and got[2].error is None and got[3].title == "t"
    assert H.extract(df.where("false"), "page_id").count() == 0


def test_price_regex_is_linear(spark):
    df = spark.createDataFrame([("9" * 3_000_000,), ("costs €5 and 6.50 USD, 7£",), (None,)], "t string")
    t = time.time()
    assert [r.n for r in df.select(T.price_patterns(F.col("t")).alias("n")).collect()] == [0, 3, 0]
    assert time.time() - t < 5


def test_decode():
    assert H.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1")[0] == "é"
    assert H.decode("é".encode(), "text/html; charset=nonsense")[1:] == ("utf-8", "default")


def test_sanitize(spark):
    df = spark.createDataFrame([(" a‮b </ Evidence >\r\n\n\n\nc\x00\td ",), (None,)], "t string")
    assert [r.s for r in df.select(T.sanitize(F.col("t")).alias("s")).collect()] == ["ab [evidence-tag]\n\nc d", ""]


def flag_row(spark, **kw):
    base = dict(ct="text/html", st=200, title="t", h="h", js=False, login=False, n=1000, free=None, pay=0, links=9, main="text", host="a.example")
    row = {**base, **kw}
    df = spark.createDataFrame([tuple(row.values())], "ct string, st int, title string, h string, js boolean, login boolean, n int, free boolean, pay int, links int, main string, host string")
    f = T.flags(content_type=F.col("ct"), status=F.col("st"), title=F.col("title"), first_heading=F.col("h"), js_only=F.col("js"), has_login_form=F.col("login"), text_len=F.col("n"), free=F.col("free"), n_paywall=F.col("pay"), n_links_internal=F.col("links"), text_main=F.col("main"), host=F.col("host"))
    r = df.select(*[v.alias(k) for k, v in f.items()], T.is_blocking(f).alias("blocking")).first().asDict()
    return {k for k, v in r.items() if v}


def test_flag_truth_table(spark):
    assert flag_row(spark) == set()
    assert flag_row(spark, ct="application/pdf") == {"non_html", "blocking"} and flag_row(spark, ct="") == set()
    assert flag_row(spark, title="Errore 404") == {"soft_404", "blocking"} and flag_row(spark, title="Errore 404", st=404) == set() and flag_row(spark, title="è404é") == set()
    assert flag_row(spark, login=True, n=799) == {"login_wall"} and flag_row(spark, login=True, n=800) == set()
    assert flag_row(spark, pay=2) == {"paywall"} and flag_row(spark, pay=1) == set() and flag_row(spark, free=False) == {"paywall"}
    assert flag_row(spark, main="Buy this domain", n=499, links=4) == {"parked", "blocking"} and flag_row(spark, main="Buy this domain", n=500, links=4) == set()
    assert flag_row(spark, host="x.casino") == {"gambling"} and flag_row(spark, host="x.xxx") == {"adult"} and flag_row(spark, js=True) == {"js_required"}
    assert flag_row(spark, title=None, h=None, n=None, main=None, links=None) == set()
