"""Queries of core operators on inputs that are made from every row of the test tables, so that each rule
is met: markup written around pages, flags on both sides of their limits, addresses of many forms, broken
taxonomies, verdicts of two rungs.  The SQL states the same from the tables alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievewright.functions import guard
from sievewright.functions import prompt as P
from sievewright.functions import text as T
from sievewright.functions import urls as U
from sievewright.operators import frontier, ladder, records, taxonomy
from sievewright.plans.core_queries import _ESC, _WS, html_of_pages
from sievewright.session import shared_dir, table
from sievewright.sources import html as H
from sievewright.streaming import intake

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# --- URLs -------------------------------------------------------------------------------------

#: (raw form around the line number N, canonical form or None, reason): one per rule, by line_no.
_FORMS = [
    ("  Example.COM/a/N ", "https://example.com/a/N", None),
    ("http://user:pw@Host.example:80/x/./y/../N", "http://user:pw@host.example/x/N", None),
    ("HTTPS://a.example:443/%7Eu/N?b=2&a=1&utm_source=z&gclid=1#frag", "https://a.example/~u/N?a=1&b=2", None),
    ("https://a.example:8443/N?q=%c3%a9", "https://a.example:8443/N?q=%C3%A9", None),
    ("http://192.0.2.7/N", "http://192.0.2.7/N", None),
    ("https://a.example/?n=N", "https://a.example?n=N", None),
    ("mailto:N@a.example", None, "bad_scheme"),
    ("javascript:void(N)", None, "bad_scheme"),
    ("https://a.example:99999/N", None, "bad_port"),
    ("   ", None, "empty"),
]
_PICK = lambda k: "CASE line_no % 10 " + " ".join(f"WHEN {i} THEN " + ("NULL" if f[k] is None else "replace('" + f[k] + "', 'N', CAST(line_no AS VARCHAR))") for i, f in enumerate(_FORMS)) + " END"


@query(f"SELECT line_no, {_PICK(1)} AS url_norm, CASE line_no % 10 " + " ".join(f"WHEN {i} THEN '{f[2]}'" for i, f in enumerate(_FORMS) if f[2]) + " END AS reject_reason FROM urls")
def url_rules(spark, d):
    raw = F.element_at(F.array(*[F.lit(f[0]) for f in _FORMS]), (F.pmod("line_no", F.lit(10)) + 1).cast("int"))
    u = table(spark, d, "urls").select("line_no", U.canonical(F.replace(raw, F.lit("N"), F.col("line_no").cast("string"))).alias("n"))
    return u.select("line_no", "n.url_norm", "n.reject_reason")


_SUFFIXES = ["com", "co.uk", "com.my", "gov.it", "edu.pl", "gob.mx", "github.io", "de", "example", "co.jp", "k12.ca.us", "com.br"]
_SUFFIX = "CASE line_no % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SUFFIXES)) + " END"


@query(f"SELECT line_no, 'n' || line_no || '.' || {_SUFFIX} AS domain FROM urls")
def url_suffixes(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.pmod("line_no", F.lit(12)) + 1).cast("int"))
    return table(spark, d, "urls").select("line_no", U.registered_domain(F.concat(F.lit("www.n"), "line_no", F.lit("."), suffix)).alias("domain"))


_IP = "CASE line_no % 4 WHEN 0 THEN 'http://10.0.0.' || (line_no % 300) || '/' WHEN 1 THEN 'http://[::1]/' WHEN 2 THEN 'ftp://a.example/' ELSE 'https://a.example/' || line_no END"


@query(f"SELECT line_no, CASE WHEN line_no % 4 = 0 AND line_no % 300 < 256 OR line_no % 4 = 1 THEN 'ip_literal_host' WHEN line_no % 4 = 2 THEN 'bad_scheme' END AS skip_reason FROM urls")
def url_prefilter_hosts(spark, d):
    n = F.col("line_no")
    url = F.when(n % 4 == 0, F.concat(F.lit("http://10.0.0."), n % 300, F.lit("/"))).when(n % 4 == 1, F.lit("http://[::1]/")).when(n % 4 == 2, F.lit("ftp://a.example/")).otherwise(F.concat(F.lit("https://a.example/"), n))
    return table(spark, d, "urls").select("line_no", U.prefilter(url).alias("skip_reason"))


_ROBOTS = """User-agent: *
Disallow: /

User-agent: sieve
Disallow: /a
Disallow: /*.html$
Allow: /a/open
Crawl-delay: 2
"""


@query("""SELECT line_no, CASE WHEN line_no % 5 = 0 THEN true WHEN line_no % 3 = 0 THEN line_no % 2 = 1 WHEN line_no % 3 = 1 THEN line_no % 4 <> 1 ELSE true END AS allowed FROM urls""")
def robots_rules(spark, d):
    """Robots rules per URL: groups by agent, longest match, allow before disallow, wildcards and ends, and
    files that were not served."""
    n = F.col("line_no")
    path = F.when(n % 3 == 0, F.when(n % 2 == 1, F.lit("/a/open/x")).otherwise("/a/shut")).when(n % 3 == 1, F.when(n % 4 == 1, F.lit("/b/page.html")).otherwise("/b/page.html?x")).otherwise(F.concat(F.lit("/c/"), n))
    ok = guard.robots_allow(F.lit(_ROBOTS), F.when(n % 5 == 0, 404).otherwise(200), path, "sievewright/0.1")
    return table(spark, d, "urls").select("line_no", ok.alias("allowed"))


@query("""SELECT DISTINCT fetch_id, CASE WHEN error_code = 'E_RATE_LIMIT' AND fetch_id % 3 = 0 THEN least(60.0, (fetch_id % 90)::DOUBLE) ELSE least(20.0, 0.5 * power(2.0, fetch_id % 8)) END AS seconds FROM fetch_outcomes WHERE error_code IS NOT NULL""")
def retry_waits(spark, d):
    """Least waits before a retry: the server's word after a rate limit, else doubling up to a bound."""
    k = F.col("fetch_id")
    after = F.when(k % 3 == 0, (k % 90).cast("string")).when(k % 3 == 1, F.lit("soon"))
    f = table(spark, d, "fetch_outcomes").where("error_code IS NOT NULL")
    return f.select("fetch_id", guard.retry_delays(k % 8 + 1, F.col("error_code"), after).alias("seconds")).distinct()


@query("SELECT line_no, line_no % 6 NOT IN (1, 3, 4, 5) AS safe FROM urls")
def addresses_of_hosts(spark, d):
    """Resolved addresses of every host: one unsafe address, or none at all, rejects it."""
    n = F.col("line_no")
    ip4 = F.concat(F.lit("93.184."), n % 200, F.lit(".7"))
    ips = F.when(n % 6 == 0, F.array(ip4)).when(n % 6 == 1, F.array(ip4, F.lit("10.0.0.1"))).when(n % 6 == 2, F.array(F.lit("2606:4700::1"), ip4)).when(n % 6 == 3, F.array().cast("array<string>")).when(n % 6 == 4, F.array(F.lit("64:ff9b::a00:1"))).otherwise(F.array(F.lit("nonsense")))
    return table(spark, d, "urls").select("line_no", guard.addresses_safe(ips).alias("safe"))


# --- pages ------------------------------------------------------------------------------------


def _written(spark, d):
    """(page_id, url, html): markup of every kind around each page's own facts."""
    p, k = table(spark, d, "page_html"), F.col("page_id")
    e = F.array().cast("array<string>")
    when = lambda c, s: F.when(c, s if not isinstance(s, str) else F.lit(s)).otherwise("")
    times = lambda n, s: F.repeat(F.lit(s), n.cast("int"))
    ld = F.when(k % 10 == 1, F.lit('{"@type": ')).when(k % 10 == 3, F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, {"@type": ["Person", "https://schema.org/Thing"], "publisher": "P'), k, F.lit('"}]}'))).when(
        k % 2 == 0, F.concat(F.lit('{"@type": ["NewsArticle", "schema:Thing"], "publisher": {"name": "P'), k, F.lit('"}, "datePublished": "2024-01-0'), k % 9 + 1, F.lit('", "isAccessibleForFree": "False"}')))
    html = F.concat(
        F.lit("<html><head>"), F.coalesce(F.concat(F.lit('<meta name="keywords" content="'), _ESC(F.array_join("meta_keywords", ", ")), F.lit('">')), F.lit("")),
        F.concat(F.lit('<meta name="twitter:card" content="card '), k % 3, F.lit('"><meta property="og:title" content="T'), k, F.lit('">')),
        when(k % 3 == 0, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed/'), k, F.lit('"><link rel="alternate" type="application/atom+xml" href="/atom"><link rel="alternate" type="application/rss+xml" href="/feed/'), k, F.lit('">'))),
        F.array_join(F.transform(F.coalesce("hreflang", e), lambda h: F.concat(F.lit('<link rel="alternate" hreflang="'), _ESC(h), F.lit('" href="/x">'))), ""),
        F.coalesce(F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")), F.lit("")), F.lit("</head><body>"),
        when(k % 9 == 0, '<div id="root"></div>'), F.array_join(F.transform(F.coalesce("headings", e), lambda h: F.concat(F.lit("<h1>"), _ESC(h), F.lit("</h1>"))), ""),
        times(k % 20, "<h2>Part\n <b>of</b> the page</h2><h2> </h2>"), times(k % 4, '<a href="/news/">n</a>'), times(k % 3, '<a href="/plain">p</a>'), times(k % 5, '<a href="https://elsewhere.test/post/1">e</a>'),
        when(k % 4 == 1, '<a href="/Basket">go</a>'), when(k % 5 == 2, '<form><input type="password"></form>'), when(k % 6 == 3, '<form><input name="q"></form>'), when(k % 7 == 3, '<input type="password" name="q">'),
        when(k % 3 == 1, '<div itemscope itemtype="https://schema.org/Product"></div><div itemtype="http://schema.org/Offer"></div>'), when(k % 3 == 2, '<p typeof="schema:Article Person">x</p>'),
        F.lit("<p>"), _ESC(F.coalesce("meta_description", F.lit(""))), F.lit("</p></body></html>"),
    )
    return p.select("page_id", F.concat(F.lit("https://own.example/"), k).alias("url"), html.alias("html"))


_K = "page_id"
_INT, _EXT = f"({_K} % 4 + {_K} % 3 + CASE WHEN {_K} % 4 = 1 THEN 1 ELSE 0 END)", f"({_K} % 5)"


@query(f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(coalesce(array_to_string(meta_keywords, ', '), ''), ','), lambda x: trim(x)), lambda x: x <> '')[1:20], '|') AS keywords,
 'card ' || ({_K} % 3) AS twitter_card, 'T' || {_K} AS og_title, CASE WHEN {_K} % 3 = 0 THEN '/feed/' || {_K} || '|/atom' ELSE '' END AS feeds,
 array_to_string(list_sort(list_distinct(list_filter(coalesce(hreflang, []), lambda x: x <> ''))), '|') AS hreflang,
 array_to_string(list_concat(list_transform(list_filter(list_transform(coalesce(headings, []), lambda x: {_WS.format('x')}), lambda x: x IS NOT NULL), lambda x: substring(x, 1, 80)), list_transform(range({_K} % 20), lambda i: 'Part of the page'))[1:15], '|') AS headings
 FROM page_html""")
def html_lists(spark, d):
    """Keywords, cards, feeds, alternate languages and headings read from markup."""
    x = H.extract(_written(spark, d), "page_id")
    join = lambda c: F.array_join(c, "|")
    return x.select("page_id", join("meta_keywords").alias("keywords"), "twitter_card", F.col("og")["title"].alias("og_title"), join("feeds").alias("feeds"), join(F.array_sort("hreflang")).alias("hreflang"), join("headings").alias("headings"))


@query(f"""SELECT page_id, CAST({_INT} AS INT) AS internal, CAST({_EXT} AS INT) AS external, CASE WHEN {_INT} + {_EXT} > 0 THEN round(({_K} % 4) / ({_INT} + {_EXT}), 4) ELSE 0.0 END AS density,
 {_K} % 4 = 1 AS cart, {_K} % 5 = 2 AS login, {_K} % 6 = 3 AS search, {_K} % 9 = 0 AS app_root FROM page_html""")
def html_links_forms(spark, d):
    """Links, article density, carts, login and search forms read from markup."""
    x = H.extract(_written(spark, d), "page_id")
    return x.select("page_id", F.col("n_links_internal").alias("internal"), F.col("n_links_external").alias("external"), F.col("article_link_density").alias("density"), F.col("has_cart_link").alias("cart"), F.col("has_login_form").alias("login"), F.col("has_search_form").alias("search"), F.col("has_app_root").alias("app_root"))


@query(f"""SELECT page_id, CASE WHEN {_K} % 10 = 1 THEN '' WHEN {_K} % 10 = 3 THEN 'WebSite|Person|Thing' WHEN {_K} % 2 = 0 THEN 'NewsArticle|Thing' ELSE '' END AS jsonld,
 CASE WHEN {_K} % 10 = 3 OR {_K} % 2 = 0 THEN 'P' || {_K} END AS publisher, CASE WHEN {_K} % 2 = 0 THEN '2024-01-0' || ({_K} % 9 + 1) END AS published, CASE WHEN {_K} % 2 = 0 THEN false END AS free,
 CASE WHEN {_K} % 3 = 1 THEN 'Product|Offer' ELSE '' END AS microdata, CASE WHEN {_K} % 3 = 2 THEN 'Article|Person' ELSE '' END AS rdfa FROM page_html""")
def html_structured_data(spark, d):
    """JSON-LD with graphs, lists and broken blocks, microdata, RDFa."""
    x = H.extract(_written(spark, d), "page_id")
    join = lambda c: F.array_join(c, "|")
    return x.select("page_id", join("jsonld_types").alias("jsonld"), F.col("jsonld_publisher").alias("publisher"), F.col("jsonld_date_published").alias("published"), F.col("is_accessible_for_free").alias("free"), join("microdata_types").alias("microdata"), join("rdfa_types").alias("rdfa"))


_LINES = f"list_filter(list_concat(list_transform(coalesce(headings, []), lambda x: {_WS.format('x')}), [{_WS.format('body_text')}]), lambda x: x IS NOT NULL)"


@query(f"SELECT page_id, (coalesce(list_sum(list_transform({_LINES}, lambda x: length(x))), 0) + greatest(len({_LINES}) - 1, 0))::BIGINT AS text_len_chars FROM page_html")
def main_text_lengths(spark, d):
    """Main text of pages whose only content is their headings and one paragraph, between links, images,
    forms and scripts."""
    x = H.extract(html_of_pages(spark, d), "page_id")
    return x.select("page_id", F.length("text_main").cast("long").alias("text_len_chars"))


_SALE = T.FOR_SALE
_HEAD = "coalesce(title, '') || ' ' || coalesce(headings[1], '')"
_LOST = "(?i)(^|[^0-9A-Za-zÀ-ɏЀ-ӿ_])(404|not found|page not found|pagina non trovata|non trovata|introuvable|seite nicht gefunden)([^0-9A-Za-zÀ-ɏЀ-ӿ_]|$)"
_MARKERS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.PAYWALL) + "]"
_FLAGS = f"""SELECT page_id, page_id % 4 = 2 AS non_html, page_id % 3 <> 0 AND regexp_matches({_HEAD}, '{_LOST}') AS soft_404, coalesce(js_only, false) AS js_required,
 coalesce(has_login_form AND coalesce(body_text_len, 0) < 800, false) AS login_wall,
 page_id % 5 = 1 OR len(list_filter({_MARKERS}, lambda x: contains(lower(coalesce(body_text, '')), x))) >= 2 AS paywall,
 coalesce(coalesce(body_text_len, 0) < 500 AND n_links_internal < 5 AND regexp_matches(lower(body_text), '{_SALE}'), false) AS parked,
 page_id % 6 IN (2, 3) AS adult, page_id % 6 IN (1, 4) AS gambling, false AS dead, false AS spam_mfa, false AS blocked_robots, false AS injection_attempt FROM page_html"""


@query(f"WITH f AS ({_FLAGS}) SELECT *, dead OR parked OR soft_404 OR non_html AS blocking FROM f")
def page_flags_all(spark, d):
    """All twelve flags and whether they block, over content types, statuses and hosts that vary by page."""
    k = F.col("page_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(k, F.lit(len(v))) + 1).cast("int"))
    f = T.flags(
        content_type=pick("text/html", "application/xhtml+xml", "application/pdf", ""), status=F.when(k % 3 == 0, 404).otherwise(200), title=F.col("title"), first_heading=F.get(F.col("headings"), F.lit(0)), js_only=F.col("js_only"),
        has_login_form=F.col("has_login_form"), text_len=F.col("body_text_len"), free=F.when(k % 5 == 0, True).when(k % 5 == 1, False), n_paywall=F.size(T.paywall_markers(F.col("body_text"))), n_links_internal=F.col("n_links_internal"),
        text_main=F.col("body_text"), host=F.concat(F.lit("h."), pick("example", "casino", "xxx", "sexy", "bet", "com")),
    )
    return table(spark, d, "page_html").select("page_id", *[v.alias(n) for n, v in f.items()], T.is_blocking(f).alias("blocking"))


@query("SELECT page_id, coalesce(body_text_len, 0) < 200 AND n_scripts > 5 AND page_id % 2 = 0 AS js_only FROM page_html")
def page_js_only(spark, d):
    return table(spark, d, "page_html").select("page_id", F.coalesce(T.js_only(F.col("body_text_len"), F.col("n_scripts"), F.col("page_id") % 2 == 0), F.lit(False)).alias("js_only"))


@query("SELECT page_id, CASE WHEN coalesce(body_text_len, 0) > 0 THEN round(greatest(0.0, 1 - length(coalesce(meta_description, '')) / body_text_len), 4) ELSE 0.0 END AS ratio FROM page_html")
def boilerplate_of_description(spark, d):
    """The ratio with a main text that differs by page."""
    n = F.coalesce(F.col("body_text_len"), F.lit(0))
    return table(spark, d, "page_html").select("page_id", T.boilerplate_ratio(F.length(F.coalesce("meta_description", F.lit(""))), n).alias("ratio"))


@query("""SELECT page_id, len(list_distinct(list_filter(coalesce(headings, []), lambda x: x IS NOT NULL))[1:15])::INT AS n_headings,
 coalesce(list_max(list_transform(coalesce(headings, []), lambda x: least(length(x), 12))), 0)::INT AS longest,
 array_to_string(list_filter(list_transform(string_split(coalesce(array_to_string(meta_keywords, ' ,'), ''), ','), lambda x: trim(x)), lambda x: x <> '')[1:20], '|') AS keywords FROM page_html""")
def bounded_lists(spark, d):
    h, words = T.clip_list(F.col("headings"), 15, 12), T.split_keywords(F.coalesce(F.array_join("meta_keywords", " ,"), F.lit("")))
    return table(spark, d, "page_html").select("page_id", F.size(T.clip_list(F.col("headings"), 15)).alias("n_headings"), F.coalesce(F.array_max(F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda x: F.least(F.length(x), F.lit(12)))), F.lit(0)).alias("longest"), F.array_join(words, "|").alias("keywords")).where(F.size(h) >= 0)


@query("SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'utf-16le' WHEN 1 THEN 'no such charset' ELSE NULL END AS charset FROM documents WHERE text IS NOT NULL")
def charset_decoded(spark, d):
    """Texts written in a charset and decoded by its label; unknown and missing labels fall back to UTF-8."""
    from sievewright.pipeline import decoded

    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "utf-16le").when(F.col("doc_id") % 3 == 1, "no such charset").alias("charset"))
    body = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    return t.select("doc_id", decoded(body, F.col("charset")).alias("text"), "charset")


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[\x{{00}}-\x{{08}}\x{{0B}}-\x{{1F}}\x{{7F}}-\x{{9F}}\p{{Cf}}\p{{Co}}\p{{Cs}}]', '', 'g'),
 '(?i)</?\s*evidence\s*>', '[evidence-tag]', 'g'), '[ \t\r\f\v]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"""


@query(f"""SELECT page_id, CASE WHEN title IS NOT NULL THEN {_CLEAN.format('title')} END AS title, CASE page_id % 3 WHEN 0 THEN 'co.uk' WHEN 1 THEN 'example' ELSE 'localhost' END AS tld,
 least(len(coalesce(meta_keywords, [])), 40)::BIGINT AS keywords, least(length({_CLEAN.format('body_text')}), 12000)::BIGINT AS text_len, n_links_internal::BIGINT AS internal, true AS framed FROM page_html""")
def prompt_views(spark, d):
    """The view that a model gets, read back from its JSON."""
    k = F.col("page_id")
    p = table(spark, d, "page_html").withColumns({"domain": F.when(k % 3 == 0, "a.co.uk").when(k % 3 == 1, "b.example").otherwise("localhost"), "text_main": F.col("body_text"), "url_final": F.col("url_norm")})
    cols = ("title", "domain", "meta_keywords", "text_main", "url_final", "n_links_internal", "n_links_external")
    v = p.select("page_id", P.user_message(P.view({c: F.col(c) for c in cols})).alias("m"))
    shape = "title string, tld string, meta_keywords array<string>, text_main string, links struct<internal:bigint,external:bigint>"
    j = F.from_json(F.regexp_extract("m", r"(?s)^<evidence>\n(.*)\n</evidence>$", 1), shape)
    x = v.select("page_id", j.alias("j"), F.col("m").startswith(P.OPEN).alias("framed"))
    return x.select("page_id", "j.title", "j.tld", F.size("j.meta_keywords").cast("long").alias("keywords"), F.length("j.text_main").cast("long").alias("text_len"), F.col("j.links.internal").alias("internal"), "framed")


# --- frontier ---------------------------------------------------------------------------------


@query("""WITH old AS (SELECT url_norm, page_id, site_type FROM page_records WHERE url_norm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY page_id, classified_at, site_type) = 1),
 new AS (SELECT url_norm, page_id, 'extracted' AS site_type FROM page_html WHERE js_only AND url_norm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY page_id) = 1)
 SELECT url_norm, page_id, site_type FROM new UNION ALL SELECT * FROM old WHERE url_norm NOT IN (SELECT url_norm FROM new)""")
def frontier_upsert(spark, d):
    old = frontier.first_wins(table(spark, d, "page_records").select("url_norm", "page_id", "classified_at", "site_type"), "url_norm", "page_id").select("url_norm", "page_id", "site_type")
    new = frontier.first_wins(table(spark, d, "page_html").where("js_only").select("url_norm", "page_id"), "url_norm", "page_id").withColumn("site_type", F.lit("extracted"))
    return frontier.upsert(old, new)


@query("SELECT line_no, url_norm, status FROM urls WHERE url_norm = (SELECT min(url_norm) FROM urls)")
def frontier_get(spark, d):
    u = table(spark, d, "urls")
    return frontier.get(u, u.agg(F.min("url_norm")).first()[0]).select("line_no", "url_norm", "status")


@query("SELECT status, count(*) AS n, min(url_norm) AS first_url FROM urls WHERE status IN ('pending', 'classified') GROUP BY status")
def state_round_trip(spark, d):
    """The frontier written as versioned state and read back by status; a second version replaces nothing
    but its own table."""
    store = frontier.StateStore(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    store.write(urls=table(spark, d, "urls"), domains=table(spark, d, "domains"))
    store.write(domains=table(spark, d, "domains").where("status IS NOT NULL"))
    u = store.read("urls", status="pending").unionByName(store.read("urls", status="classified"))
    return u.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("url_norm").alias("first_url"))


@query("SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    w = intake.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return w.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


# --- taxonomy, ladder, records ----------------------------------------------------------------

_BROKEN = [("dup", "A", 1, None), ("dup", "B", 1, None), ("lost", "C", 2, "nowhere"), ("deep", "D", 3, "dup"), ("x", "X", 1, "y"), ("y", "Y", 2, "x")]


@query("""SELECT * FROM (VALUES ('duplicate id dup'), ('unknown parent nowhere of lost'), ('parent dup of deep is not one tier up'), ('parent y of x is not one tier up'), ('x is its own ancestor'), ('y is its own ancestor')) t(problem)""")
def taxonomy_broken(spark, d):
    """The stored taxonomy with nodes of every fault added; the stored nodes have none."""
    bad = spark.createDataFrame([(*x, None, None) for x in _BROKEN], taxonomy.SCHEMA)
    return taxonomy.problems(table(spark, d, "taxonomy_nodes").unionByName(bad)).distinct()


@query("SELECT p.id AS parent, count(c.id) AS children, p.name AS name FROM taxonomy_nodes p LEFT JOIN taxonomy_nodes c ON c.parent = p.id WHERE p.tier = 1 GROUP BY p.id, p.name")
def taxonomy_lookups(spark, d):
    """First tier, nodes by id and their children."""
    t = table(spark, d, "taxonomy_nodes")
    out = None
    for r in taxonomy.first_tier(t).select("id").collect():  # a small fixed table
        below = taxonomy.children(t, r.id).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
        n = taxonomy.node(t, r.id).select(F.col("id").alias("parent"), "name").join(below, "parent", "left").na.fill(0, ["children"])
        out = n if out is None else out.unionByName(n)
    return out.select("parent", "children", "name")


_ANSWERS = [
    ("404", {"site_type": "other", "site_type_confidence": 0.9, "tokens_in": 3, "tokens_out": 1}),
    ("a", {"site_type": "portfolio", "site_type_confidence": 0.5, "evidence": "has an a", "topics": []}),
    ("e", {"site_type": "no such type", "site_type_confidence": 0.5}),
    ("o", {"error": "E_LLM_RATE"}),
]


class _Answers:
    """Replies by the first needle in the prompt; anything else breaks the call."""

    def complete(self, system: str, user: str, model: str) -> dict:
        return next(a for needle, a in _ANSWERS if needle in user)


@query("""SELECT page_id, CASE WHEN contains(t, '404') THEN 'other' WHEN contains(t, 'a') THEN 'portfolio' END AS site_type, CASE WHEN contains(t, '404') THEN 0.9 WHEN contains(t, 'a') THEN 0.5 END AS confidence,
 CASE WHEN contains(t, '404') THEN 3 END AS tokens_in, CASE WHEN contains(t, '404') OR contains(t, 'a') THEN NULL WHEN contains(t, 'e') THEN 'E_LLM_INVALID' WHEN contains(t, 'o') THEN 'E_LLM_RATE' ELSE 'E_LLM_INVALID' END AS error, 'm' AS model_id
 FROM (SELECT page_id, coalesce(title, '') AS t FROM page_html)""")
def ladder_asked(spark, d):
    """Replies of a provider checked: good ones, unknown types, error codes, calls that break."""
    p = table(spark, d, "page_html").select("page_id", F.coalesce("title", F.lit("")).alias("prompt"))
    v = ladder.ask(p, "page_id", "prompt", _Answers, "system", "m")
    return v.select("page_id", "site_type", F.col("site_type_confidence").alias("confidence"), "tokens_in", "error", "model_id")


_LAST = "SELECT * FROM page_records QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY classified_at DESC, url_norm DESC) = 1"


def _rungs(spark, d):
    r = table(spark, d, "page_records").select("page_id", "site_type", "site_type_confidence", "topics", "evidence", "model_id", "tokens_in", "tokens_out", "audience_geo", "classified_at", "url_norm")
    r = frontier.latest(r, "page_id", "classified_at", "url_norm")
    fail = lambda n: F.when(F.col("page_id") % n == 0, F.lit("E_LLM_RATE"))
    cut = F.transform("topics", lambda t: F.struct(t["tier1_id"].alias("tier1_id"), t["tier2_id"].alias("tier2_id"), t["confidence"].alias("confidence")))
    keep = ["page_id", "site_type", "evidence", "tokens_in", "tokens_out", "audience_geo"]
    small = lambda df: df.select(*keep, "site_type_confidence", cut.alias("topics"), F.lit("small").alias("model_id"), fail(11).alias("error"))
    large = lambda df: df.select(*keep, F.least(F.lit(1.0), F.col("site_type_confidence") + 0.25).alias("site_type_confidence"), cut.alias("topics"), F.lit("large").alias("model_id"), fail(13).alias("error"))
    return ladder.climb(r, "page_id", F.col("page_id") % 7 == 0, F.lit("blocking flag: soft_404"), small, large)


_TAKEN = f"""SELECT *, CASE WHEN page_id % 7 = 0 THEN 'blocked' WHEN page_id % 11 = 0 THEN 'failed_classify' WHEN site_type IS NOT NULL AND coalesce(site_type_confidence, 0) >= 0.75 THEN 'llm_small' WHEN page_id % 13 = 0 THEN 'back' ELSE 'llm_large' END AS rung FROM ({_LAST})"""


@query(f"""WITH p AS ({_TAKEN}) SELECT page_id, CASE rung WHEN 'back' THEN 'llm_small' ELSE rung END AS method, CASE WHEN rung IN ('blocked', 'failed_classify') THEN NULL ELSE evidence END AS evidence,
 CASE WHEN rung IN ('blocked', 'failed_classify') THEN NULL ELSE audience_geo END AS audience_geo, CASE WHEN rung IN ('blocked', 'failed_classify') THEN NULL ELSE tokens_in + tokens_out END AS tokens,
 CASE rung WHEN 'llm_large' THEN 'large' WHEN 'blocked' THEN NULL WHEN 'failed_classify' THEN NULL ELSE 'small' END AS model_id, CASE WHEN rung IN ('blocked', 'failed_classify') THEN NULL ELSE len(topics) END AS n_topics,
 CASE rung WHEN 'blocked' THEN 'blocking flag: soft_404' WHEN 'failed_classify' THEN 'LLM classification failed' END AS uncertain_because FROM p""")
def ladder_outcomes(spark, d):
    """What an outcome carries from the rung that it comes from."""
    x = _rungs(spark, d)
    return x.select("page_id", "method", "evidence", "audience_geo", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), "model_id", F.when(F.col("topics").isNotNull(), F.size("topics")).cast("long").alias("n_topics"), "uncertain_because")


@query(f"""WITH p AS ({_TAKEN}), q AS (SELECT page_id, CASE rung WHEN 'back' THEN 'llm_small' ELSE rung END AS method, CASE WHEN rung IN ('blocked', 'failed_classify') THEN NULL ELSE site_type END AS got, site_type AS expected FROM p)
 SELECT method, count(*) AS total, count(*) FILTER (expected = got) AS correct FROM q GROUP BY method""")
def eval_ladder(spark, d):
    """A ladder's outcomes scored by method against the stored site types."""
    expected = frontier.latest(table(spark, d, "page_records").select("page_id", F.col("site_type").alias("expected"), "classified_at", "url_norm"), "page_id", "classified_at", "url_norm").select("page_id", "expected")
    return records.by_method(_rungs(spark, d).join(expected, "page_id"), "expected", "site_type")


@query(f"""WITH r AS ({_LAST}), g AS (SELECT page_id, max(topic) AS expected FROM topic_labels GROUP BY page_id)
 SELECT count(*) FILTER (coalesce(expected, '') <> '') AS labelled, count(*) FILTER (coalesce(expected, '') <> '' AND list_contains(list_transform(topics, lambda t: t.tier1_id), expected)) AS correct,
 round(count(*) FILTER (coalesce(expected, '') <> '' AND list_contains(list_transform(topics, lambda t: t.tier1_id), expected)) / count(*) FILTER (coalesce(expected, '') <> ''), 4) AS accuracy FROM r LEFT JOIN g USING (page_id)""")
def eval_topics(spark, d):
    """Topic accuracy over the labelled pages only."""
    r = frontier.latest(table(spark, d, "page_records").select("page_id", "topics", "classified_at", "url_norm"), "page_id", "classified_at", "url_norm")
    g = table(spark, d, "topic_labels").groupBy("page_id").agg(F.max("topic").alias("expected"))
    rows = r.select("page_id", F.transform("topics", lambda t: t["tier1_id"]).alias("ids")).join(g, "page_id", "left")
    return records.topic_accuracy(rows, "expected", "ids")


@query("""SELECT page_id, epoch_us(classified_at) AS us, '1.0' AS schema_version, url_norm AS url, domain, CAST(page_id % 4 AS INT) AS redirects, coalesce(site_type, 'unknown') AS site_type, site_type_confidence AS confidence,
 array_to_string(list_transform(coalesce(topics, []), lambda t: coalesce(t.tier1_id, '') || '/' || coalesce(t.tier2_id, '')), '|') AS topics, audience_geo, method, evidence, uncertain_because,
 page_id % 2 = 0 AS has_rss, CASE WHEN page_id % 3 = 0 THEN 'Article' ELSE '' END AS jsonld, 'de' AS lang, 'DE' AS region, true AS agreement, taxonomy_version, model_id, prompt_sha256, tokens_in, tokens_out, page_id % 5 = 0 AS parked FROM page_records""")
def records_whole(spark, d):
    """Every nested part of a record, with lists of several lengths."""
    r, k = table(spark, d, "page_records"), F.col("page_id")
    e = F.array().cast("array<string>")
    own = "domain site_type site_type_confidence topics audience_geo method evidence uncertain_because taxonomy_version model_id prompt_sha256 tokens_in tokens_out".split()
    cols = {
        **{c: F.col(c) for c in own}, "url": F.col("url_norm"), "redirect_chain": F.array_repeat(F.lit("x"), (k % 4).cast("int")), "feeds": F.when(k % 2 == 0, F.array(F.lit("/f"))), "jsonld_types": F.when(k % 3 == 0, F.array(F.lit("Article"))).otherwise(e),
        "lang_value": F.lit("de"), "lang_region": F.lit("DE"), "lang_agreement": F.lit(True),
    }
    x = r.select("page_id", F.unix_micros("classified_at").alias("us"), records.build_record(cols, {"parked": k % 5 == 0, "dead": F.lit(False)}).alias("r"))
    topics = F.array_join(F.transform("r.site.topics", lambda t: F.concat(F.coalesce(t["tier1_id"], F.lit("")), F.lit("/"), F.coalesce(t["tier2_id"], F.lit("")))), "|")
    return x.select(
        "page_id", "us", "r.schema_version", "r.url", "r.domain", "r.http.redirects", "r.site.site_type", F.col("r.site.site_type_confidence").alias("confidence"), topics.alias("topics"), "r.site.audience_geo", "r.site.method", "r.site.evidence", "r.site.uncertain_because",
        "r.signals.has_rss", F.array_join("r.signals.jsonld_types", "|").alias("jsonld"), F.col("r.language.value").alias("lang"), "r.language.region", "r.language.agreement", "r.provenance.taxonomy_version", "r.provenance.model_id", "r.provenance.prompt_sha256", "r.provenance.tokens_in", "r.provenance.tokens_out", "r.flags.parked",
    )
