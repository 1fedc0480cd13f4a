"""Queries of the core operators over the test tables, with the SQL that states the same.

No query narrows its tables; limits stand only in the top-n report.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import guard, langid
from sievewright.functions import text as T
from sievewright.functions import urls as U
from sievewright.operators import frontier, ladder, records, taxonomy
from sievewright.session import table
from sievewright.sources import html as H
from sievewright.sources import lines as L

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- URLs and frontier ------------------------------------------------------------------------


@query("SELECT line_no, url_norm, CAST(NULL AS VARCHAR) AS reject_reason FROM urls")
def url_canonical(spark, d):
    u = table(spark, d, "urls").select("line_no", U.canonical(F.col("url_raw")).alias("n"))
    return u.select("line_no", "n.url_norm", "n.reject_reason")


_HOST = "regexp_extract(url_norm, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


@query(f"SELECT line_no, {_HOST} AS host, array_to_string(string_split({_HOST}, '.')[-2:], '.') AS domain FROM urls")
def url_host_domain(spark, d):
    host = U.host_of(F.col("url_norm"))
    return table(spark, d, "urls").select("line_no", host.alias("host"), U.registered_domain(host).alias("domain"))


@query("SELECT line_no, CAST(len(list_filter(string_split(regexp_extract(url_norm, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS INT) AS path_depth FROM urls")
def url_path_depth(spark, d):
    return table(spark, d, "urls").select("line_no", U.path_depth(F.col("url_norm")).alias("path_depth"))


_EXT = ", ".join(f"'{e}'" for e in sorted(U.NON_HTML))
_REASON = f"""CASE WHEN length(url_norm) > 2048 THEN 'url_too_long' WHEN {_HOST} IN ('linxora.example') THEN 'excluded_host'
 WHEN regexp_extract(lower(regexp_extract(url_norm, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(\\.[^.]*)$', 1) IN ({_EXT}) THEN 'non_html_extension' END"""


@query(f"SELECT line_no, {_REASON} AS skip_reason FROM urls")
def url_prefilter(spark, d):
    rules = U.UrlRules(exclude_hosts=frozenset(["linxora.example"]))
    return table(spark, d, "urls").select("line_no", U.prefilter(F.col("url_norm"), rules).alias("skip_reason"))


@query("SELECT url_norm, line_no, scope FROM urls QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY line_no) = 1")
def url_dedup_first_wins(spark, d):
    return frontier.first_wins(table(spark, d, "urls").select("url_norm", "line_no", "scope"), "url_norm", "line_no")


@query(f"""SELECT url_norm, line_no, scope, {_REASON.replace("'linxora.example'", "'none.invalid'")} AS skip_reason,
 CASE WHEN {_REASON.replace("'linxora.example'", "'none.invalid'")} IS NULL THEN 'pending' ELSE 'skipped_filter' END AS status
 FROM urls QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY line_no) = 1""")
def frontier_admit(spark, d):
    rows = frontier.admit(table(spark, d, "urls").select("line_no", "url_raw", "scope", "tags"))
    return rows.select("url_norm", "line_no", "scope", "skip_reason", "status")


@query("SELECT domain, count(*) AS n FROM (SELECT url_norm, domain FROM page_records QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY page_id) = 1 UNION ALL SELECT url_norm, domain FROM urls WHERE url_norm NOT IN (SELECT url_norm FROM page_records WHERE url_norm IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY line_no) = 1) GROUP BY domain")
def frontier_insert_absent(spark, d):
    state = frontier.first_wins(table(spark, d, "page_records").select("url_norm", "domain", "page_id"), "url_norm", "page_id").select("url_norm", "domain")
    new = frontier.first_wins(table(spark, d, "urls").select("url_norm", "domain", "line_no"), "url_norm", "line_no").select("url_norm", "domain")
    return frontier.insert_absent(state, new).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT status, count(*) AS n FROM urls GROUP BY status")
def frontier_counts(spark, d):
    return frontier.counts_by_status(table(spark, d, "urls"))


@query("SELECT host, url_norm, line_no FROM urls WHERE status = 'pending' ORDER BY host, url_norm, line_no LIMIT 100")
def frontier_pending_top(spark, d):
    return frontier.pending(table(spark, d, "urls"), 100, "line_no").select("host", "url_norm", "line_no")


@query("SELECT line_no, CASE WHEN status = 'fetching' THEN 'pending' ELSE status END AS status FROM urls")
def frontier_requeue_stuck(spark, d):
    return frontier.requeue_stuck(table(spark, d, "urls")).select("line_no", "status")


@query("""SELECT line_no, CASE WHEN status = 'failed_fetch' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed_fetch' THEN 0 ELSE attempts END AS attempts,
 CASE WHEN status = 'failed_fetch' THEN NULL ELSE last_error_code END AS last_error_code FROM urls""")
def frontier_requeue_status(spark, d):
    return frontier.requeue(table(spark, d, "urls"), "failed_fetch").select("line_no", "status", "attempts", "last_error_code")


_LAST_FETCH = "SELECT url_norm, status AS http_status, error_code AS last_error_code FROM fetch_outcomes QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY fetched_at DESC, fetch_id DESC) = 1"


@query(f"WITH f AS ({_LAST_FETCH}) SELECT line_no, CASE WHEN f.url_norm IS NULL THEN u.http_status ELSE f.http_status END AS http_status, CASE WHEN f.url_norm IS NULL THEN u.last_error_code ELSE f.last_error_code END AS last_error_code FROM urls u LEFT JOIN f USING (url_norm)")
def frontier_set_columns(spark, d):
    f = frontier.latest(table(spark, d, "fetch_outcomes").select("url_norm", "fetched_at", "fetch_id", "status", "error_code"), "url_norm", "fetched_at", "fetch_id")
    f = f.select("url_norm", F.col("status").alias("http_status"), F.col("error_code").alias("last_error_code"))
    return frontier.set_columns(table(spark, d, "urls"), f).select("line_no", "http_status", "last_error_code")


@query("SELECT line_no, attempts + CASE WHEN url_norm IN (SELECT url_norm FROM fetch_outcomes) THEN 1 ELSE 0 END AS attempts FROM urls")
def frontier_bump_attempts(spark, d):
    return frontier.bump_attempts(table(spark, d, "urls"), table(spark, d, "fetch_outcomes")).select("line_no", "attempts")


@query("SELECT page_id, url_norm FROM page_html WHERE url_norm IN (SELECT url_norm FROM urls)")
def frontier_reclassifiable(spark, d):
    return frontier.reclassifiable(table(spark, d, "urls"), table(spark, d, "page_html").select("page_id", "url_norm"))


@query("SELECT url_norm, page_id, site_type FROM page_records QUALIFY row_number() OVER (PARTITION BY url_norm ORDER BY classified_at DESC, page_id DESC) = 1")
def records_latest(spark, d):
    return frontier.latest(table(spark, d, "page_records").select("url_norm", "page_id", "site_type", "classified_at"), "url_norm", "classified_at", "page_id").select("url_norm", "page_id", "site_type")


@query("SELECT domain, epoch_us(min(seen_at)) AS first_seen_us FROM urls WHERE domain IS NOT NULL GROUP BY domain")
def domains_first_seen(spark, d):
    return frontier.first_seen(table(spark, d, "urls")).select("domain", F.unix_micros("first_seen_at").alias("first_seen_us"))


@query("""SELECT count(*) AS added, count(*) FILTER (status = 'classified') AS classified, count(*) FILTER (status = 'needs_human') AS needs_human,
 count(*) FILTER (status IN ('failed_fetch', 'blocked_robots', 'skipped_nonhtml', 'skipped_too_large')) AS errors, count(*) FILTER (status = 'skipped_filter') AS skipped FROM urls""")
def run_counters(spark, d):
    return frontier.run_counters(table(spark, d, "urls"))


@query("SELECT url_raw, scope, coalesce(array_to_string(CAST(tags AS JSON)::VARCHAR[], ','), '') AS tags FROM urls")
def input_lines_json(spark, d):
    """Every frontier line written as a JSON line and read back by the line parser."""
    u = table(spark, d, "urls").select(F.to_json(F.struct(F.col("url_raw").alias("url"), "scope", F.from_json("tags", "array<string>").alias("tags"))).alias("line"))
    return L.parse_lines(u).select("url_raw", "scope", F.array_join("tags", ",").alias("tags"))


@query("SELECT trim(url_raw) AS url_raw, 'auto' AS scope FROM urls WHERE trim(url_raw) <> '' AND NOT starts_with(trim(url_raw), '#')")
def input_lines_plain(spark, d):
    return L.parse_lines(table(spark, d, "urls").select(F.col("url_raw").alias("line"))).select("url_raw", "scope")


# --- fetches ----------------------------------------------------------------------------------


@query("""SELECT fetch_id, CASE WHEN status = 429 THEN 'E_RATE_LIMIT' WHEN status BETWEEN 400 AND 499 THEN 'E_HTTP_4XX' WHEN status >= 500 THEN 'E_HTTP_5XX' END AS http_error FROM (SELECT DISTINCT fetch_id, status FROM fetch_outcomes)""")
def fetch_http_error(spark, d):
    return table(spark, d, "fetch_outcomes").select("fetch_id", "status").distinct().select("fetch_id", T.http_error(F.col("status")).alias("http_error"))


@query("""SELECT DISTINCT fetch_id, CASE error_code WHEN 'E_ROBOTS_BLOCK' THEN 'blocked_robots' WHEN 'E_ROBOTS_UNAVAIL' THEN 'blocked_robots_unavailable' WHEN 'E_NONHTML' THEN 'skipped_nonhtml'
 WHEN 'E_TOO_LARGE' THEN 'skipped_too_large' WHEN 'E_BOMB' THEN 'skipped_too_large' ELSE 'failed_fetch' END AS row_status FROM fetch_outcomes WHERE error_code IS NOT NULL""")
def fetch_error_status(spark, d):
    return table(spark, d, "fetch_outcomes").where("error_code IS NOT NULL").select("fetch_id", T.error_status(F.col("error_code")).alias("row_status")).distinct()


@query("SELECT error_code, count(*) AS n FROM (SELECT DISTINCT fetch_id, error_code FROM fetch_outcomes) WHERE error_code IS NOT NULL GROUP BY error_code")
def fetch_error_counts(spark, d):
    f = table(spark, d, "fetch_outcomes").select("fetch_id", "error_code").distinct().where("error_code IS NOT NULL")
    return f.groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT fetch_id, coalesce(lower(trim(string_split(coalesce(headers['content-type'], headers['Content-Type']), ';')[1])), '') AS content_type,
 coalesce(headers['server'], headers['Server']) AS server, CAST(len(redirect_chain) AS INT) AS redirects FROM fetch_outcomes""")
def fetch_headers(spark, d):
    f = table(spark, d, "fetch_outcomes")
    return f.select("fetch_id", T.content_type(F.col("headers")).alias("content_type"), T.header(F.col("headers"), "server").alias("server"), F.size("redirect_chain").alias("redirects")).distinct()


_DOM = "array_to_string(string_split(regexp_extract({0}, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.')[-2:], '.')"


@query(f"SELECT DISTINCT fetch_id, {_DOM.format('url_norm')} <> {_DOM.format('url_final')} AS cross_domain FROM fetch_outcomes WHERE url_final IS NOT NULL")
def fetch_cross_domain(spark, d):
    dom = lambda c: U.registered_domain(U.host_of(F.col(c)))
    return table(spark, d, "fetch_outcomes").where("url_final IS NOT NULL").select("fetch_id", (dom("url_norm") != dom("url_final")).alias("cross_domain")).distinct()


@query("SELECT page_id, count(DISTINCT f.fetch_id) AS attempts FROM page_html p JOIN fetch_outcomes f USING (url_norm) GROUP BY page_id")
def page_fetch_attempts(spark, d):
    """Fetch attempts behind each page: attempts are counted per URL before the join, so a hot URL
    multiplies nothing."""
    f = table(spark, d, "fetch_outcomes").select("url_norm", "fetch_id").distinct().groupBy("url_norm").agg(F.count(F.lit(1)).alias("attempts"))
    return table(spark, d, "page_html").select("page_id", "url_norm").join(f, "url_norm").select("page_id", "attempts")


# --- page facts -------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_sha256, length(text) AS text_len_chars FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.content_sha256(F.col("text")).alias("content_sha256"), F.length("text").cast("long").alias("text_len_chars"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}\p{Cf}\p{Co}\p{Cs}]', '', 'g'),
 '(?i)</?\s*evidence\s*>', '[evidence-tag]', 'g'), '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS clean FROM documents""")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))


@query("SELECT page_id, CASE WHEN coalesce(body_text_len, 0) > 0 THEN round(greatest(0.0, 1 - (body_text_len / 2) / body_text_len), 4) ELSE 0.0 END AS boilerplate_ratio FROM page_html")
def boilerplate_ratio(spark, d):
    n = F.coalesce(F.col("body_text_len"), F.lit(0))
    return table(spark, d, "page_html").select("page_id", T.boilerplate_ratio(n / 2, n).alias("boilerplate_ratio"))


@query(r"""SELECT page_id, least(len(regexp_extract_all(coalesce(body_text, ''), '(?:[€$£]|USD|EUR|GBP)\s?\d[\d.,]*|(?:^|[^\d.,])\d[\d.,]*\s?(?:[€$£]|USD|EUR|GBP)')), 999)::INT AS prices FROM page_html""")
def price_patterns(spark, d):
    return table(spark, d, "page_html").select("page_id", T.price_patterns(F.col("body_text")).alias("prices"))


@query("""SELECT page_id, array_to_string(list_filter(['subscribe', 'subscription', 'abbonati', 'abbonamento', 'paywall', 's''abonner', 'premium content'], lambda x: contains(lower(coalesce(body_text, '')), x)), ',') AS markers FROM page_html""")
def paywall_markers(spark, d):
    return table(spark, d, "page_html").select("page_id", F.array_join(T.paywall_markers(F.col("body_text")), ",").alias("markers"))


def _case(table_, low):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({low}, '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in table_) + " END"


def _list(table_, low):
    items = ", ".join("CASE WHEN " + " OR ".join(f"contains({low}, '{n}')" for n in needles) + f" THEN '{name}' END" for name, needles in table_)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


_LOW = "lower(concat_ws(' ', meta_generator, canonical, body_text))"
_GEN = "CASE " + " ".join(f"WHEN contains(lower(meta_generator), '{n}') THEN '{name}'" for n, name in T.GENERATORS) + " END"


@query(f"SELECT page_id, coalesce({_GEN}, {_case(T.CMS, _LOW)}) AS cms, {_case(T.SHOPS, _LOW)} AS ecommerce_platform, {_list(T.ADS, _LOW)} AS ad_networks, {_list(T.ANALYTICS, _LOW)} AS analytics FROM page_html")
def fingerprints(spark, d):
    low = F.col("_low")  # lower-cased once, below
    p = table(spark, d, "page_html").select("page_id", "meta_generator", F.lower(F.concat_ws(" ", "meta_generator", "canonical", "body_text")).alias("_low"))
    return p.select("page_id", T.cms(F.col("meta_generator"), low).alias("cms"), T.first_match(low, T.SHOPS).alias("ecommerce_platform"), F.array_join(T.all_matches(low, T.ADS), ",").alias("ad_networks"), F.array_join(T.all_matches(low, T.ANALYTICS), ",").alias("analytics"))


@query("""SELECT page_id, nullif(lower(regexp_extract(trim(html_lang), '^([^-_]*)', 1)), '') AS base,
 upper(list_filter(list_transform(list_prepend(og_locale, coalesce(hreflang, [])), lambda c: regexp_extract(c, '[-_]([A-Za-z]{2})\\b', 1)), lambda r: r IS NOT NULL AND r <> '')[1]) AS region,
 len(list_distinct(list_filter(list_transform(coalesce(hreflang, []), lambda c: nullif(lower(regexp_extract(trim(c), '^([^-_]*)', 1)), '')), lambda b: b IS NOT NULL))) > 1 AS multilingual FROM page_html""".replace("\\\\b", "\\b"))
def language_labels(spark, d):
    return table(spark, d, "page_html").select("page_id", T.base_language(F.col("html_lang")).alias("base"), T.region(F.col("og_locale"), F.col("hreflang")).alias("region"), T.multilingual(F.col("hreflang")).alias("multilingual"))


_BASE = "nullif(lower(regexp_extract(trim(html_lang), '^([^-_]*)', 1)), '')"


@query(f"""SELECT DISTINCT page_id, CASE WHEN value IS NOT NULL AND coalesce(confidence, 0) > 0 THEN value ELSE {_BASE} END AS lang,
 CASE WHEN value IS NOT NULL AND coalesce(confidence, 0) > 0 THEN 'detected' WHEN {_BASE} IS NOT NULL THEN 'html_lang' ELSE 'unknown' END AS lang_method,
 CASE WHEN value IS NOT NULL AND coalesce(confidence, 0) > 0 AND {_BASE} IS NOT NULL THEN {_BASE} = value END AS agrees FROM language_info""")
def language_block(spark, d):
    b = table(spark, d, "language_info").select("page_id", T.language_block(F.col("value"), F.col("confidence"), F.col("html_lang")).alias("b"))
    return b.select("page_id", F.col("b.value").alias("lang"), F.col("b.method").alias("lang_method"), F.col("b.agreement").alias("agrees")).distinct()


@query()
def language_detected(spark, d):
    x = table(spark, d, "page_html").select("page_id", langid.detect(F.lit(None).cast("string"), F.col("body_text"), F.col("html_lang")).alias("x"))
    return x.select("page_id", "x.value", "x.confidence", "x.method", "x.agreement")


@query("""SELECT page_id, array_to_string(list_transform(coalesce(headings, [])[1:15], lambda h: substring(h, 1, 80)), '|') AS headings, array_to_string(coalesce(meta_keywords, [])[1:20], '|') AS keywords FROM page_html""")
def page_lists(spark, d):
    e = F.array().cast("array<string>")
    clip = lambda c, n, k: F.array_join(F.slice(F.transform(F.coalesce(F.col(c), e), lambda x: F.substring(x, 1, k)), 1, n), "|")
    return table(spark, d, "page_html").select("page_id", clip("headings", 15, 80).alias("headings"), clip("meta_keywords", 20, 100_000).alias("keywords"))


_TITLE = "coalesce(title, '') || ' ' || coalesce(headings[1], '')"
_NF = "(?i)(^|[^0-9A-Za-zÀ-ɏЀ-ӿ_])(404|not found|page not found|pagina non trovata|non trovata|introuvable|seite nicht gefunden)([^0-9A-Za-zÀ-ɏЀ-ӿ_]|$)"


@query(f"""SELECT page_id, regexp_matches({_TITLE}, '{_NF}') AS soft_404, coalesce(has_login_form AND coalesce(body_text_len, 0) < 800, false) AS login_wall,
 coalesce(coalesce(body_text_len, 0) < 500 AND n_links_internal < 5 AND regexp_matches(lower(body_text), 'for sale|buy this domain|domain is for sale|dominio in vendita|parked (domain|free)|this domain (is|may be) for sale'), false) AS parked,
 coalesce(js_only, false) AS js_required, len(list_filter(['subscribe', 'subscription', 'abbonati', 'abbonamento', 'paywall', 's''abonner', 'premium content'], lambda x: contains(lower(coalesce(body_text, '')), x))) >= 2 AS paywall FROM page_html""")
def page_flags_derived(spark, d):
    f = _flags()
    return table(spark, d, "page_html").select("page_id", *[f[n].alias(n) for n in ("soft_404", "login_wall", "parked", "js_required", "paywall")])


def _flags():
    return T.flags(
        content_type=F.lit("text/html"), status=F.lit(200), title=F.col("title"), first_heading=F.get(F.col("headings"), F.lit(0)), js_only=F.col("js_only"),
        has_login_form=F.col("has_login_form"), text_len=F.col("body_text_len"), free=F.lit(None).cast("boolean"), n_paywall=F.size(T.paywall_markers(F.col("body_text"))),
        n_links_internal=F.col("n_links_internal"), text_main=F.col("body_text"), host=U.host_of(F.col("url_norm")),
    )


_ESC = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def html_of_pages(spark, d):
    """page_html rows written as HTML documents: (page_id, url, html).  The table keeps no source, so
    the extractor is held against the very facts that these documents state."""
    p = table(spark, d, "page_html")
    e = F.array().cast("array<string>")
    attr = lambda name, c, tag: F.coalesce(F.concat(F.lit(f'<meta {tag}="{name}" content="'), _ESC(c), F.lit('">')), F.lit(""))
    html = F.concat(
        F.lit("<!doctype html><html"), F.coalesce(F.concat(F.lit(' lang="'), _ESC(F.col("html_lang")), F.lit('"')), F.lit("")), F.lit("><head>"),
        F.coalesce(F.concat(F.lit("<title>"), _ESC(F.col("title")), F.lit("</title>")), F.lit("")),
        attr("description", F.col("meta_description"), "name"), attr("generator", F.col("meta_generator"), "name"), attr("og:locale", F.col("og_locale"), "property"),
        F.coalesce(F.concat(F.lit('<link rel="canonical" href="'), _ESC(F.col("canonical")), F.lit('">')), F.lit("")),
        F.array_join(F.transform(F.coalesce("hreflang", e), lambda h: F.concat(F.lit('<link rel="alternate" hreflang="'), _ESC(h), F.lit('" href="/x">'))), ""),
        F.lit("</head><body>"),
        F.array_join(F.transform(F.coalesce("headings", e), lambda h: F.concat(F.lit("<h1>"), _ESC(h), F.lit("</h1>"))), ""),
        F.repeat(F.lit('<a href="/in/1">x</a>'), F.col("n_links_internal")), F.repeat(F.lit('<a href="https://elsewhere.test/">x</a>'), F.coalesce("n_links_external", F.lit(0))),
        F.repeat(F.lit('<img src="a.png">'), F.col("n_images")), F.repeat(F.lit("<form><input name=\"mail\"></form>"), F.col("n_forms")),
        F.repeat(F.lit("<script>var a;</script>"), F.col("n_scripts")), F.when(F.col("has_search_form"), F.lit('<form role="search"></form>')).otherwise(""),
        F.lit("<p>"), _ESC(F.coalesce("body_text", F.lit(""))), F.lit("</p></body></html>"),
    )
    return p.select("page_id", F.col("url_norm").alias("url"), html.alias("html"))


_WS = r"nullif(trim(regexp_replace({0}, '[\s\x{{A0}}\x{{85}}\x{{1C}}-\x{{1F}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1680}}]+', ' ', 'g')), '')"


@query(f"""SELECT page_id, {_WS.format('title')} AS title, html_lang, meta_description, meta_generator, og_locale, canonical,
 len(list_distinct(list_filter(coalesce(hreflang, []), lambda x: x <> '')))::INT AS n_hreflang, n_links_internal, coalesce(n_links_external, 0) AS n_links_external, n_images,
 CAST(n_forms + CASE WHEN has_search_form THEN 1 ELSE 0 END AS INT) AS n_forms, n_scripts, has_search_form FROM page_html""")
def html_round_trip(spark, d):
    x = H.extract(html_of_pages(spark, d), "page_id")
    return x.select("page_id", "title", "html_lang", "meta_description", "meta_generator", "og_locale", "canonical", F.size("hreflang").alias("n_hreflang"), "n_links_internal", "n_links_external", "n_images", "n_forms", "n_scripts", "has_search_form")


@query("SELECT coalesce(html_lang, '?') AS html_lang, count(*) AS pages, CAST(sum(n_links_internal) AS BIGINT) AS links FROM page_html GROUP BY 1")
def html_by_language(spark, d):
    x = H.extract(html_of_pages(spark, d), "page_id")
    return x.groupBy(F.coalesce("html_lang", F.lit("?")).alias("html_lang")).agg(F.count(F.lit(1)).alias("pages"), F.sum("n_links_internal").alias("links"))


@query()
def html_main_text(spark, d):
    x = H.extract(html_of_pages(spark, d), "page_id")
    return x.select("page_id", F.length("text_main").alias("text_len_chars"), T.boilerplate_ratio(F.length("text_main"), F.length("body_text")).alias("boilerplate_ratio"))


# --- taxonomy, topics, ladder, records, evaluation --------------------------------------------


@query("WITH RECURSIVE up AS (SELECT id, id AS ancestor, 0 AS distance FROM taxonomy_nodes UNION ALL SELECT u.id, t.parent, u.distance + 1 FROM up u JOIN taxonomy_nodes t ON t.id = u.ancestor WHERE t.parent IS NOT NULL) SELECT id, ancestor, distance FROM up")
def taxonomy_closure(spark, d):
    return taxonomy.closure(table(spark, d, "taxonomy_nodes"))


@query("""SELECT t.id, CASE WHEN p.id IS NULL THEN t.name ELSE p.name || ' > ' || t.name END AS path,
 t.id || ' | ' || CASE WHEN p.id IS NULL THEN t.name ELSE p.name || ' > ' || t.name END || CASE WHEN coalesce(t.hints, '') <> '' THEN '  (hints: ' || t.hints || ')' ELSE '' END AS line
 FROM taxonomy_nodes t LEFT JOIN taxonomy_nodes p ON p.id = t.parent""")
def taxonomy_paths(spark, d):
    return taxonomy.paths(table(spark, d, "taxonomy_nodes"))


@query("SELECT 'x' AS problem WHERE false")
def taxonomy_problems(spark, d):
    return taxonomy.problems(table(spark, d, "taxonomy_nodes"))


@query("""WITH r AS (SELECT row_number() OVER () AS k, page_id, classified_at, topics FROM page_records),
 x AS (SELECT k, page_id, classified_at, unnest(topics) AS t, generate_subscripts(topics, 1) AS pos FROM r),
 v AS (SELECT k, page_id, classified_at, pos, n1.id AS tier1_id, n1.name AS tier1_name, n2.id AS tier2_id, n2.name AS tier2_name, greatest(0, least(1, t.confidence)) AS confidence
   FROM x JOIN taxonomy_nodes n1 ON n1.id = t.tier1_id AND n1.tier = 1 LEFT JOIN taxonomy_nodes n2 ON n2.id = t.tier2_id AND n2.parent = n1.id),
 u AS (SELECT *, row_number() OVER (PARTITION BY k, tier1_id, coalesce(tier2_id, '') ORDER BY pos) AS again FROM v),
 w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM u WHERE again = 1)
 SELECT page_id, epoch_us(classified_at) AS classified_us, CAST(r - 1 AS INT) AS rank, tier1_id, tier1_name, tier2_id, tier2_name, confidence FROM w WHERE r <= 3""")
def topics_validated(spark, d):
    r = table(spark, d, "page_records").withColumn("k", F.struct("page_id", "classified_at", F.monotonically_increasing_id().alias("i")))
    v = taxonomy.validate_topics(r.select("k", "topics"), table(spark, d, "taxonomy_nodes"), "k")
    return v.select("k.page_id", F.unix_micros("k.classified_at").alias("classified_us"), "rank", "tier1_id", "tier1_name", "tier2_id", "tier2_name", "confidence")


@query("""WITH p AS (SELECT page_id, site_type, site_type_confidence AS c, page_id % 7 = 0 AS blocked, page_id % 11 = 0 AS bad_small, page_id % 13 = 0 AS bad_large
   FROM page_records QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY classified_at DESC, url_norm DESC) = 1)
 SELECT page_id, CASE WHEN blocked THEN 'blocked' WHEN bad_small THEN 'failed_classify' WHEN site_type IS NOT NULL AND coalesce(c, 0) >= 0.75 THEN 'llm_small' WHEN bad_large THEN 'llm_small' ELSE 'llm_large' END AS method,
  CASE WHEN blocked THEN 1.0 WHEN bad_small THEN 0.0 WHEN site_type IS NOT NULL AND coalesce(c, 0) >= 0.75 THEN c WHEN bad_large THEN c ELSE least(1.0, c + 0.25) END AS confidence,
  CASE WHEN blocked THEN false WHEN bad_small THEN true WHEN site_type IS NOT NULL AND coalesce(c, 0) >= 0.75 THEN false WHEN bad_large THEN true ELSE NOT (site_type IS NOT NULL AND coalesce(least(1.0, c + 0.25), 0) >= 0.6) END AS needs_human FROM p""")
def ladder_cascade(spark, d):
    """The cascade over stored verdicts: small answers as stored, the large adds a quarter; some pages
    are blocked, some calls fail, by page_id, so that every branch is taken."""
    r = table(spark, d, "page_records").select("page_id", "site_type", "site_type_confidence", "classified_at", "url_norm")
    r = frontier.latest(r, "page_id", "classified_at", "url_norm")
    fail = lambda n: F.when(F.col("page_id") % n == 0, F.lit("E_LLM_RATE"))
    small = lambda df: df.select("page_id", "site_type", "site_type_confidence", fail(11).alias("error"))
    large = lambda df: df.select("page_id", "site_type", F.least(F.lit(1.0), F.col("site_type_confidence") + 0.25).alias("site_type_confidence"), fail(13).alias("error"))
    out = ladder.climb(r, "page_id", F.col("page_id") % 7 == 0, F.lit("blocking flag: soft_404"), small, large)
    return out.select("page_id", "method", "confidence", "needs_human")


@query("""SELECT r.page_id, '1.0' AS schema_version, r.url_norm AS url, CAST(0 AS INT) AS redirects, coalesce(r.site_type, 'unknown') AS site_type, r.method, false AS has_rss, r.model_id FROM page_records r""")
def records_built(spark, d):
    r = table(spark, d, "page_records")
    cols = {"url": F.col("url_norm"), "redirect_chain": F.array().cast("array<string>"), "site_type": F.col("site_type"), "site_type_confidence": F.col("site_type_confidence"), "method": F.col("method"), "model_id": F.col("model_id"), "domain": F.col("domain")}
    x = r.select("page_id", records.build_record(cols, {k: F.lit(False) for k in ("dead", "parked")}).alias("r"))
    return x.select("page_id", "r.schema_version", "r.url", "r.http.redirects", "r.site.site_type", "r.site.method", "r.signals.has_rss", "r.provenance.model_id")


@query("""SELECT DISTINCT fetch_id, url_norm AS url, status, error_code AS evidence, error_code = 'E_ROBOTS_BLOCK' AS blocked_robots, error_code = 'E_NONHTML' AS non_html FROM fetch_outcomes WHERE error_code IS NOT NULL""")
def error_records(spark, d):
    f = table(spark, d, "fetch_outcomes").where("error_code IS NOT NULL").select("fetch_id", records.build_error_record(F.col("url_norm"), F.col("error_code"), F.col("status")).alias("r"))
    return f.select("fetch_id", "r.url", "r.status", "r.evidence", "r.blocked_robots", "r.non_html").distinct()


def _golden(spark, d):
    r = frontier.latest(table(spark, d, "page_records").select("page_id", "method", "topics", "classified_at", "url_norm"), "page_id", "classified_at", "url_norm")
    g = table(spark, d, "topic_labels").where("topic IS NOT NULL").select("page_id", F.col("topic").alias("expected")).distinct()
    first = F.get(F.transform("topics", lambda t: t["tier1_id"]), F.lit(0))
    return g.join(r.select("page_id", "method", first.alias("got")), "page_id")


_GOLDEN = """WITH r AS (SELECT page_id, method, topics[1].tier1_id AS got FROM page_records QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY classified_at DESC, url_norm DESC) = 1),
 g AS (SELECT DISTINCT page_id, topic AS expected FROM topic_labels WHERE topic IS NOT NULL), j AS (SELECT * FROM g JOIN r USING (page_id))"""


@query(_GOLDEN + " SELECT count(*) AS total, count(*) FILTER (expected = got) AS correct, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (expected = got) / count(*), 4) ELSE 0.0 END AS accuracy FROM j")
def eval_accuracy(spark, d):
    return records.accuracy(_golden(spark, d), "expected", "got")


@query(_GOLDEN + " SELECT method, count(*) AS total, count(*) FILTER (expected = got) AS correct FROM j GROUP BY method")
def eval_by_method(spark, d):
    return records.by_method(_golden(spark, d), "expected", "got")


@query(_GOLDEN + " SELECT page_id, 'expected ' || expected || ', got ' || coalesce(got, 'unknown') AS mismatch FROM j WHERE NOT coalesce(expected = got, false)")
def eval_mismatches(spark, d):
    return records.mismatches(_golden(spark, d), "page_id", "expected", "got")


# --- guard ------------------------------------------------------------------------------------

_ADDRESSES = [("10.0.0.1", False), ("127.0.0.1", False), ("169.254.169.254", False), ("100.64.0.1", False), ("168.63.129.16", False), ("::1", False), ("fe80::1", False), ("64:ff9b::a9fe:a9fe", False), ("2002:7f00:1::", False), ("::ffff:10.0.0.1", False), ("224.0.0.1", False), ("0.0.0.0", False), ("192.168.1.1", False), ("8.8.8.8", True), ("1.1.1.1", True), ("2606:4700:4700::1111", True), ("93.184.216.34", True), ("nonsense", False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {str(ok).lower()})" for a, ok in _ADDRESSES) + ") t(ip, safe)")
def guard_addresses(spark, d):
    ips = spark.createDataFrame([(a,) for a, _ in _ADDRESSES], "ip string")
    return ips.select("ip", guard.address_verdict(F.col("ip")).isNull().alias("safe"))


@query("SELECT * FROM (VALUES (80, true), (443, true), (NULL, true), (22, false), (8080, false), (6379, false)) t(port, allowed)")
def guard_ports(spark, d):
    p = spark.createDataFrame([(80,), (443,), (None,), (22,), (8080,), (6379,)], "port int")
    return p.select("port", guard.port_allowed(F.col("port")).alias("allowed"))
