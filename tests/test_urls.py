import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import urls as U

PAIRS = [
    ("https://example.com", "https://example.com"),
    ("example.com/x", "https://example.com/x"),
    ("EXAMPLE.com./", "https://example.com"),
    ("http://Example.com:80/A", "http://example.com/A"),
    ("https://example.com:443", "https://example.com"),
    ("https://example.com:8443/", "https://example.com:8443"),
    ("https://user:pw@example.com/", "https://user:pw@example.com"),
    ("https://bücher.de/ä", "https://xn--bcher-kva.de/%C3%A4"),
    ("https://example.com/a/../b/./c", "https://example.com/b/c"),
    ("https://example.com/a/b/..", "https://example.com/a/"),
    ("https://example.com//a//b", "https://example.com//a//b"),
    ("https://example.com/%7euser/%2f", "https://example.com/~user/%2F"),
    ("https://example.com/a b", "https://example.com/a%20b"),
    ("https://example.com/a%zz", "https://example.com/a%25zz"),
    ("https://example.com/?b=2&a=1", "https://example.com?a=1&b=2"),
    ("https://example.com/?utm_source=x&UTM_medium=y&fbclid=1&k=v", "https://example.com?k=v"),
    ("https://example.com/?q=a+b&e=", "https://example.com?e=&q=a%20b"),
    ("https://example.com/x#frag", "https://example.com/x"),
    ("http://192.168.0.1/x", "http://192.168.0.1/x"),
    ("http://[2001:db8::1]:8080/x", "http://[2001:db8::1]:8080/x"),
    ("  https://exa​mple.com/‮ ", "https://example.com"),
]
REJECTED = [("", "empty"), ("  \t", "empty"), ("mailto:a@b.c", "bad_scheme"), ("javascript:alert(1)", "bad_scheme"), ("ftp://x.y/", "bad_scheme"), ("data:text/html,x", "bad_scheme"), ("https:///path", "no_host"), ("http://x:99999/", "bad_port"), ("http://[zz]/", "bad_host"), (None, "empty")]


@pytest.mark.parametrize("raw,want", PAIRS)
def test_pairs(raw, want):
    assert U.canonical_url(raw) == want
    assert U.canonical_url(want) == want


@pytest.mark.parametrize("raw,why", REJECTED)
def test_rejections(raw, why):
    with pytest.raises(U.Rejected, match=why):
        U.canonical_url(raw)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40), st.sampled_from(["", "https://a.example/", "a.example/x?", "http://u@h.example:81/p?q="]))
def test_idempotent_or_rejected(text, head):
    try:
        once = U.canonical_url(head + text)
    except U.Rejected:
        return
    assert U.canonical_url(once) == once


def test_columns(spark):
    rows = [(p,) for p, _ in PAIRS] + [(r,) for r, _ in REJECTED] + [("https://x.example/a.PDF",), ("https://a.b.co.uk/x/y.html",)]
    df = spark.createDataFrame(rows, "raw string").select("raw", U.canonical(F.col("raw")).alias("n")).select("raw", "n.*")
    got = {r.raw: (r.url_norm, r.reject_reason) for r in df.collect()}
    for raw, want in PAIRS:
        assert got[raw] == (want, None)
    for raw, why in REJECTED:
        assert got[raw] == (None, why)
    u = df.where("url_norm IS NOT NULL").select("url_norm", U.host_of(F.col("url_norm")).alias("h"), U.registered_domain(U.host_of(F.col("url_norm"))).alias("d"), U.path_depth(F.col("url_norm")).alias("n"), U.prefilter(F.col("url_norm")).alias("why"))
    by = {r.url_norm: r for r in u.collect()}
    assert by["https://a.b.co.uk/x/y.html"].d == "b.co.uk" and by["https://a.b.co.uk/x/y.html"].n == 2
    assert by["https://x.example/a.PDF"].why == "non_html_extension"
    assert by["http://192.168.0.1/x"].why == by["http://[2001:db8::1]:8080/x"].why == "ip_literal_host"
    assert by["https://user:pw@example.com"].h == "example.com"


def test_prefilter_order(spark):
    rules = U.UrlRules(exclude_hosts=frozenset(["no.example"]), allow_ip_hosts=True, allow_nonhtml=True)
    urls = ["https://no.example/x.pdf", "https://a.example/" + "x" * 2048, "http://10.0.0.1/x.zip", "https://a.example/x.zip"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.w for r in df.select(U.prefilter(F.col("u"), rules).alias("w")).collect()] == ["excluded_host", "url_too_long", None, None]


def test_canonical_evaluates_once(spark):
    df = spark.createDataFrame([("a.example",)], "u string").withColumn("n", U.canonical(F.col("u")))
    plan = df.where("n.url_norm IS NOT NULL").select("n.url_norm", "n.reject_reason")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
