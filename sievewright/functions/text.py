"""Native expressions over page facts: text, language labels, fingerprints, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- text -------------------------------------------------------------------------------------


def sanitize(c: Column) -> Column:
    """Text that can stand inside the evidence delimiters: control characters out (line ends and tabs
    aside), delimiter tags neutralised, blanks and empty lines squeezed, ends trimmed; null is empty."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", "")
    c = F.regexp_replace(c, r"(?i)</?\s*evidence\s*>", "[evidence-tag]")
    c = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def boilerplate_ratio(main_len: Column, all_len: Column) -> Column:
    """1 - main / all, not below 0, to 4 digits; 0 for a page without text."""
    return F.when(all_len > 0, F.round(F.greatest(F.lit(0.0), 1 - main_len / all_len), 4)).otherwise(F.lit(0.0))


def content_sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


#: What counts as an amount of money; possessive, so that long digit runs cost nothing.
PRICE = r"(?:[€$£]|USD|EUR|GBP)\s?\d[\d.,]*+|(?<![\d.,])\d[\d.,]*+\s?(?:[€$£]|USD|EUR|GBP)"
#: Characters that signal scans read, as the definition of these two facts has it, and the cap of the count.
SCAN_CHARS, MOST_PRICES = 1_000_000, 999
#: Words of paywalls.
PAYWALL = ["subscribe", "subscription", "abbonati", "abbonamento", "paywall", "s'abonner", "premium content"]


def price_patterns(text: Column) -> Column:
    return F.least(F.regexp_count(F.substring(F.coalesce(text, F.lit("")), 1, SCAN_CHARS), F.lit(PRICE)), F.lit(MOST_PRICES))


def paywall_markers(text: Column) -> Column:
    low = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, SCAN_CHARS))
    return F.filter(F.array(*map(F.lit, PAYWALL)), lambda t: F.contains(low, t))


def js_only(text_len: Column, n_scripts: Column, has_root: Column) -> Column:
    return (F.coalesce(text_len, F.lit(0)) < 200) & (n_scripts > 5) & has_root


def clip_list(c: Column, most: int, chars: int | None = None) -> Column:
    """First ``most`` entries, distinct in order; each cut to ``chars`` where given."""
    c = F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return F.slice(F.transform(c, lambda x: F.substring(x, 1, chars)) if chars else c, 1, most)


def split_keywords(content: Column) -> Column:
    """A keywords attribute as a list: split at commas, trimmed, empty ones dropped, the first 20."""
    return F.slice(F.filter(F.transform(F.split(content, ","), lambda x: F.trim(x)), lambda x: x != ""), 1, 20)


# --- language labels --------------------------------------------------------------------------


def base_language(code: Column) -> Column:
    """The part before the first - or _, lower case; empty is null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(code), r"^([^-_]*)", 1)), F.lit(""))


def region(og_locale: Column, hreflang: Column) -> Column:
    """The first two-letter region of the locale, then of the alternate links, upper case."""
    codes = F.concat(F.array(og_locale), F.coalesce(hreflang, F.array().cast("array<string>")))
    found = F.filter(F.transform(codes, lambda c: F.regexp_extract(c, r"[-_]([A-Za-z]{2})\b", 1)), lambda r: r.isNotNull() & (r != ""))
    return F.upper(F.get(found, F.lit(0)))


def multilingual(hreflang: Column) -> Column:
    bases = F.filter(F.transform(F.coalesce(hreflang, F.array().cast("array<string>")), base_language), lambda b: b.isNotNull())
    return F.size(F.array_distinct(bases)) > 1


def language_block(detected: Column, confidence: Column, html_lang: Column) -> Column:
    """The language block from stored facts: detected with agreement, declared only, or unknown."""
    declared = base_language(html_lang)
    sure = detected.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) > 0)
    method = F.when(sure, "detected").when(declared.isNotNull(), "html_lang").otherwise("unknown")
    return F.struct(
        F.when(sure, detected).otherwise(declared).alias("value"),
        F.when(sure, confidence).when(declared.isNotNull(), F.lit(0.4)).otherwise(F.lit(0.0)).alias("confidence"),
        method.alias("method"),
        F.when(sure & declared.isNotNull(), declared == detected).alias("agreement"),
    )


# --- fingerprints -----------------------------------------------------------------------------

#: Names and what gives them away in lower-case HTML, in order of precedence.
CMS = [
    ("WordPress", ["wp-content", "wp-includes", "/wp-json"]),
    ("Drupal", ["/sites/default/files", "drupal-settings-json", "data-drupal"]),
    ("Joomla", ["/media/jui/", "com_content", "joomla"]),
    ("Ghost", ["ghost-", "content/images", 'name="generator" content="ghost']),
    ("Wix", ["wix.com", "wixstatic.com", "_wixcssimports"]),
    ("Squarespace", ["squarespace.com", "static1.squarespace"]),
    ("Webflow", ["webflow.js", "wf-active", "assets.website-files"]),
]
GENERATORS = [("wordpress", "WordPress"), ("drupal", "Drupal"), ("joomla", "Joomla"), ("ghost", "Ghost"), ("wix", "Wix"), ("squarespace", "Squarespace"), ("hugo", "Hugo"), ("jekyll", "Jekyll")]
SHOPS = [
    ("Shopify", ["cdn.shopify.com", "shopify.theme", "myshopify.com"]),
    ("WooCommerce", ["woocommerce", "wc-ajax", "wc_add_to_cart"]),
    ("Magento", ["mage/", "/static/version", "magento"]),
    ("PrestaShop", ["prestashop", "/modules/ps_"]),
    ("BigCommerce", ["bigcommerce.com", "stencil-utils"]),
]
ADS = [
    ("adsense", ["adsbygoogle", "pagead2.googlesyndication"]),
    ("gtag", ["googletagmanager.com", "gtag/js", "gtag("]),
    ("doubleclick", ["doubleclick.net", "googlesyndication"]),
    ("taboola", ["taboola.com", "_taboola"]),
    ("outbrain", ["outbrain.com", "ob-widget"]),
    ("prebid", ["prebid.js", "pbjs"]),
    ("criteo", ["criteo.com", "criteo_"]),
]
ANALYTICS = [
    ("google-analytics", ["google-analytics.com", "analytics.js", "ga("]),
    ("plausible", ["plausible.io"]),
    ("matomo", ["matomo.js", "piwik.js", "matomo.php"]),
    ("hotjar", ["hotjar.com", "hj("]),
    ("segment", ["segment.com/analytics.js", "analytics.load("]),
]


def _shows(low: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def first_match(low: Column, table) -> Column:
    return F.coalesce(*[F.when(_shows(low, needles), F.lit(name)) for name, needles in table])


def all_matches(low: Column, table) -> Column:
    return F.array_compact(F.array(*[F.when(_shows(low, needles), F.lit(name)) for name, needles in table]))


def cms(generator: Column, low_html: Column) -> Column:
    named = F.coalesce(*[F.when(F.contains(F.lower(generator), F.lit(n)), F.lit(name)) for n, name in GENERATORS])
    return F.coalesce(named, first_match(low_html, CMS))


# --- HTTP and flags ---------------------------------------------------------------------------


def header(headers: Column, name: str) -> Column:
    """A header by its lower-case name or its title case."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.try_element_at(headers, F.lit(name.title())))


def content_type(headers: Column) -> Column:
    """Media type without parameters, lower case; empty where there is none."""
    return F.lower(F.trim(F.coalesce(F.get(F.split(header(headers, "content-type"), ";"), F.lit(0)), F.lit(""))))


def http_error(status: Column) -> Column:
    return F.when(status == 429, "E_RATE_LIMIT").when((status >= 400) & (status < 500), "E_HTTP_4XX").when(status >= 500, "E_HTTP_5XX")


#: What an error makes of a frontier row; all else is failed_fetch.
ERROR_STATUS = {"E_ROBOTS_BLOCK": "blocked_robots", "E_ROBOTS_UNAVAIL": "blocked_robots_unavailable", "E_NONHTML": "skipped_nonhtml", "E_TOO_LARGE": "skipped_too_large", "E_BOMB": "skipped_too_large"}


def error_status(code: Column) -> Column:
    code = F.coalesce(code, F.lit("E_CONNECT"))
    out = F.lit("failed_fetch")
    for k, v in ERROR_STATUS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


#: Words of not-found and for-sale pages, last host labels.
NOT_FOUND = r"(?iU)\b(404|not found|page not found|pagina non trovata|non trovata|introuvable|seite nicht gefunden)\b"
FOR_SALE = r"for sale|buy this domain|domain is for sale|dominio in vendita|parked (domain|free)|this domain (is|may be) for sale"
ADULT = ["xxx", "porn", "adult", "sex", "sexy", "cam", "tube"]
GAMBLING = ["casino", "poker", "bet", "bingo", "spielbank"]


def flags(*, content_type: Column, status: Column, title: Column, first_heading: Column, js_only: Column, has_login_form: Column, text_len: Column, free: Column, n_paywall: Column, n_links_internal: Column, text_main: Column, host: Column) -> dict[str, Column]:
    """The deterministic flags as named expressions, never null; ``free`` is isAccessibleForFree."""
    label = F.regexp_extract(host, r"([^.]*)$", 1)
    head = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(first_heading, F.lit("")))
    size = F.coalesce(text_len, F.lit(0))
    out = {
        "non_html": (content_type != "") & ~content_type.rlike(r"^(text/html|application/xhtml)"),
        "soft_404": (status == 200) & head.rlike(NOT_FOUND),
        "js_required": js_only,
        "login_wall": has_login_form & (size < 800),
        "paywall": (F.coalesce(free, F.lit(True)) == F.lit(False)) | (n_paywall >= 2),
        "parked": (size < 500) & (n_links_internal < 5) & F.lower(text_main).rlike(FOR_SALE),
        "adult": label.isin(ADULT),
        "gambling": label.isin(GAMBLING),
        "dead": F.lit(False), "spam_mfa": F.lit(False), "blocked_robots": F.lit(False), "injection_attempt": F.lit(False),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def is_blocking(f: dict[str, Column]) -> Column:
    return f["dead"] | f["parked"] | f["soft_404"] | f["non_html"]
