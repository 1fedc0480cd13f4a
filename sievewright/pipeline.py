"""Runs over the state: admit, fetch, extract, classify, write - each stage written before the next."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import langid
from sievewright.functions import prompt as P
from sievewright.functions import text as T
from sievewright.functions import urls as U
from sievewright.operators import frontier, ladder, records, taxonomy
from sievewright.session import materialise, scratch
from sievewright.settings import Settings
from sievewright.sources import fetch as X
from sievewright.sources import html as H
from sievewright.sources import lines as L


def decoded(content: Column, charset: Column) -> Column:
    """Text of a body in its charset; bytes that do not fit become replacement characters."""

    @F.pandas_udf("string")
    def run(body: pd.Series, name: pd.Series) -> pd.Series:
        def one(b, n):
            try:
                return b.decode(n or "utf-8", errors="replace")
            except LookupError:
                return b.decode("utf-8", errors="replace")

        return pd.Series([None if b is None else one(bytes(b), n) for b, n in zip(body, name)], dtype=object)

    return run(content, charset)


def evidence(fetched: DataFrame, detector: Callable = langid.function_words) -> DataFrame:
    """Evidence rows of good fetches: decoded HTML, its facts and the native columns around them.  The
    fetch's columns pass through the parser's batches; nothing is joined."""
    own = ("url_final", "status", "headers", "redirect_chain", "charset", "fetched_at", "content_sha256", "html")
    body = fetched.select("url_norm", *own[:-2], F.sha2("content", 256).alias("content_sha256"), decoded(F.col("content"), F.col("charset")).alias("html"))
    e = H.extract(body.withColumn("_base", F.col("url_final")), "url_norm", "_base", "html", keep=own).drop("url")
    e = e.withColumn("_low", F.lower(F.coalesce("html", F.lit("")))).withColumn("_lang", langid.detect(F.col("text_main"), F.col("body_text"), F.col("html_lang"), detector))
    low, lang = F.col("_low"), F.col("_lang")
    host = U.host_of(F.col("url_final"))
    return e.withColumns({
        "host": host, "domain": U.registered_domain(host), "path_depth": U.path_depth(F.col("url_final")), "content_type": T.content_type(F.col("headers")), "server": T.header(F.col("headers"), "server"),
        "cross_domain_redirect": U.registered_domain(U.host_of(F.col("url_norm"))) != U.registered_domain(host), "text_len_chars": F.length("text_main"),
        "boilerplate_ratio": T.boilerplate_ratio(F.length("text_main"), F.length("body_text")), "price_patterns": T.price_patterns(F.col("body_text")), "paywall_markers": T.paywall_markers(F.col("body_text")),
        "cms": T.cms(F.col("meta_generator"), low), "ecommerce_platform": T.first_match(low, T.SHOPS), "ad_networks": T.all_matches(low, T.ADS), "analytics": T.all_matches(low, T.ANALYTICS),
        "js_only": T.js_only(F.length("body_text"), F.col("n_scripts"), F.col("has_app_root")), "url_raw": F.col("url_norm"),
        "detected_lang": F.when(lang["method"] == "detected", lang["value"]), "detected_lang_conf": F.when(lang["method"] == "detected", lang["confidence"]),
        "lang_value": lang["value"], "lang_confidence": lang["confidence"], "lang_method": lang["method"], "lang_agreement": lang["agreement"], "lang_html_lang": F.col("html_lang"),
        "lang_region": T.region(F.col("og_locale"), F.col("hreflang")), "lang_multilingual": T.multilingual(F.col("hreflang")),
    }).drop("html", "_low", "_lang")


def flag_columns() -> dict:
    return T.flags(
        content_type=F.col("content_type"), status=F.col("status"), title=F.col("title"), first_heading=F.get(F.col("headings"), F.lit(0)), js_only=F.col("js_only"), has_login_form=F.col("has_login_form"),
        text_len=F.col("text_len_chars"), free=F.col("is_accessible_for_free"), n_paywall=F.size("paywall_markers"), n_links_internal=F.col("n_links_internal"), text_main=F.col("text_main"), host=F.col("host"),
    )


def classify(ev: DataFrame, settings: Settings, make=None, tax: DataFrame | None = None) -> DataFrame:
    """The ladder over evidence, topics held against the taxonomy; ``make`` overrides the provider that the
    settings name."""
    c = settings.classify
    tax = taxonomy.load(ev.sparkSession, settings.taxonomy_path) if tax is None else tax
    make = make or ladder.provider(c.provider if c.mode != "off" else None, c.base_url, c.api_key)
    f = flag_columns()
    lines = [r.line for r in taxonomy.paths(tax).orderBy("id").select("line").collect()] if make else []  # a small fixed table
    ev = ev.withColumn("_prompt", P.user_message(P.view({n: F.col(n) for n in ev.columns})))
    system = P.system_prompt(ladder.SITE_TYPES, lines)
    call = lambda model: lambda df: ladder.ask(df, "url_norm", "_prompt", make, system, model, c.parallel)
    out = ladder.climb(ev, "url_norm", T.is_blocking(f), ladder.block_reason(f), call(c.model_small) if make else None, call(c.model_large) if make else None, c.accept_small, c.accept_large)
    return taxonomy.with_topics(out, tax, "url_norm")


#: Columns of evidence and verdicts that a record states under their own names.
STATED = "url_final domain scope status content_type redirect_chain cms ecommerce_platform feeds jsonld_types ad_networks charset boilerplate_ratio content_sha256 fetched_at site_type method topics audience_geo evidence uncertain_because model_id prompt_sha256 tokens_in tokens_out".split()


def _finish(store: frontier.StateStore, ev: DataFrame, settings: Settings, out_path: str, make) -> DataFrame:
    verdicts = materialise(classify(ev, settings, make))
    have = store.read("page_records")
    store.write(page_records=verdicts if have is None else frontier.upsert(have, verdicts))
    status = verdicts.select("url_norm", F.when(F.col("needs_human"), "needs_human").otherwise("classified").alias("status"))
    urls = store.read("urls")
    store.write(urls=frontier.set_columns(urls, status))
    scope = urls.select("url_norm", "scope") if "scope" in urls.columns else urls.select("url_norm", F.lit(None).cast("string").alias("scope"))
    rec = ev.join(verdicts, "url_norm").join(scope, "url_norm", "left")
    cols = {n: F.col(n) for n in [*STATED, *records.LANGUAGE]}
    version = settings.taxonomy_path or taxonomy.DEFAULT_VERSION
    rec = rec.select(records.build_record({**cols, "url": F.col("url_norm"), "site_type_confidence": F.col("confidence"), "taxonomy_version": F.lit(version)}, flag_columns()).alias("r")).select("r.*")
    records.write_jsonl(rec, out_path)
    return verdicts


def evaluate(spark: SparkSession, golden: str, fixtures: str, settings: Settings, make=None, tax: DataFrame | None = None) -> dict:
    """Golden pages through evidence and ladder: accuracy of site types, of topics over the labelled pages
    (None without any), by method, and the misses."""
    with scratch(spark):
        g = L.read_golden(spark, golden)
        got = L.read_pages(spark, fixtures).join(F.broadcast(g), "fixture")  # a hand-made set
        fetched = got.select(F.col("name").alias("url_norm"), F.col("url").alias("url_final"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.array().cast("array<string>").alias("redirect_chain"), F.lit("utf-8").alias("charset"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"), "content")
        v = classify(materialise(evidence(fetched)), settings, make, tax)
        rows = materialise(g.join(v, g["name"] == v["url_norm"], "left").withColumn("_ids", F.transform(F.coalesce("topics", F.array().cast(taxonomy.PATHS)), lambda t: t["tier1_id"])))
        a, t = records.accuracy(rows, "expected_site_type", "site_type").first(), records.topic_accuracy(rows, "expected_topic_tier1", "_ids").first()
        return {
            "total": a.total, "correct": a.correct, "accuracy": a.accuracy, "topic_labelled": t.labelled, "topic_correct": t.correct, "topic_accuracy": t.accuracy,
            "by_method": {r.method: (r.correct, r.total) for r in records.by_method(rows, "expected_site_type", "site_type").collect()},
            "misses": sorted(f"{r.name}: {r.mismatch}" for r in records.mismatches(rows, "name", "expected_site_type", "site_type").collect()),
        }


def run(spark: SparkSession, lines: DataFrame, settings: Settings, state_dir: str, out_path: str, make=None, rules: X.FetchRules | None = None, detector: Callable = langid.function_words) -> dict:
    """URL lines (url_raw, scope, tags, line_no) to records; resumes what an earlier run left.  Returns the
    run's counters."""
    with scratch(spark):
        return _run(frontier.StateStore(spark, state_dir), lines, settings, out_path, make, rules, detector)


def _run(store: frontier.StateStore, lines: DataFrame, settings: Settings, out_path: str, make, rules: X.FetchRules | None, detector: Callable) -> dict:
    new = materialise(frontier.admit(lines))
    have = store.read("urls")
    requeued = 0 if have is None else frontier.stuck(have).count()
    base = new if have is None else frontier.insert_absent(frontier.requeue_stuck(have), new)
    for c, t in (("last_error_code", "string"), ("http_status", "int"), ("next_attempt_at", "timestamp")):
        base = base if c in base.columns else base.withColumn(c, F.lit(None).cast(t))
    store.write(urls=base)
    todo = frontier.pending(store.read("urls")).select("url_norm", "host")
    f = settings.fetch
    rules = rules or X.FetchRules(user_agent=settings.identity.user_agent, retries=f.retries, max_redirects=f.max_redirects, max_length=f.max_length, max_body=f.max_body, host_delay=f.min_host_delay, respect_robots=f.respect_robots)
    got = materialise(X.fetch(todo, rules, f.partitions))
    bad = got.where("error_code IS NOT NULL")
    outcome = got.select("url_norm", F.when(F.col("error_code").isNull(), "extracted").otherwise(T.error_status(F.col("error_code"))).alias("status"), F.col("error_code").alias("last_error_code"), F.nullif(F.col("status"), F.lit(0)).alias("http_status"))
    store.write(urls=frontier.bump_attempts(frontier.set_columns(store.read("urls"), outcome), got))
    records.write_jsonl(bad.select(records.build_error_record(F.col("url_norm"), F.col("error_code"), F.col("status")).alias("r")).select("r.*"), out_path + "-errors")
    ev = materialise(evidence(got.where("error_code IS NULL"), detector))
    have = store.read("evidence")
    store.write(evidence=ev if have is None else frontier.upsert(have, ev))
    _finish(store, ev, settings, out_path, make)
    return {**frontier.run_counters(store.read("urls")).first().asDict(), "requeued": requeued}


def reclassify(spark: SparkSession, settings: Settings, state_dir: str, out_path: str, make=None) -> int:
    """Stored evidence through the ladder again, without any fetch; returns the pages classified."""
    store = frontier.StateStore(spark, state_dir)
    ev = store.read("evidence")
    if ev is None:
        return 0
    with scratch(spark):
        return _finish(store, frontier.reclassifiable(store.read("urls"), ev), settings, out_path, make).count()
