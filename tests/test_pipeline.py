import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sievewright import cli, pipeline
from sievewright import settings as S
from sievewright.functions import prompt as P
from sievewright.operators import frontier, ladder
from sievewright.sources import fetch as X


class Site(BaseHTTPRequestHandler):
    hits: dict = {}

    def do_GET(self):  # noqa: N802
        Site.hits[self.path] = Site.hits.get(self.path, 0) + 1
        pages = {
            "/news": "<html lang=en><title>News</title><body><h1>Great news</h1><p>A long enough paragraph of text about the great news of the day.</body>",
            "/missing": "<html><title>404 not found</title><body>Sorry</body>",
        }
        body = pages.get(self.path, "User-agent: *\nDisallow: /private" if self.path == "/robots.txt" else "")
        self.send_response(200 if body else 404)
        self.send_header("Content-Type", "text/plain" if self.path == "/robots.txt" else "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *a):
        pass


def test_run_resume_reclassify(spark, tmp_path):
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    port = s.server_address[1]
    base = f"http://127.0.0.1:{port}"
    lines = spark.createDataFrame([(i, base + p, "auto", None) for i, p in enumerate(["/news", "/missing", "/gone", "/private", "/news#x", "/a.pdf"])], "line_no long, url_raw string, scope string, tags array<string>")
    rules = X.FetchRules(allow_private=True, ports=(port,), host_delay=0.5, retries=0)
    conf = S.load(env={}, classify__mode="sync")
    # the test server is an address, which the prefilter would skip
    from sievewright.functions import urls as U

    old = frontier.admit.__defaults__
    frontier.admit.__defaults__ = (U.UrlRules(allow_ip_hosts=True), "line_no")
    try:
        make = lambda: ladder.FakeProvider([("Great news", {"site_type": "news_outlet", "site_type_confidence": 0.9, "topics": [{"tier1_id": "sport", "tier2_id": "sport.football", "confidence": 0.8}, {"tier1_id": "nope"}], "audience_geo": "GB", "evidence": "a heading", "tokens_in": 11, "tokens_out": 7})])
        got = pipeline.run(spark, lines, conf, str(tmp_path / "s"), str(tmp_path / "out"), make, rules)
        assert got == {"added": 5, "classified": 2, "needs_human": 0, "errors": 2, "skipped": 1, "requeued": 0}
        again = pipeline.run(spark, lines, conf, str(tmp_path / "s"), str(tmp_path / "out"), make, rules)
        assert again["added"] == 5 and Site.hits["/news"] == 1
    finally:
        frontier.admit.__defaults__ = old
        s.shutdown()
    recs = {r.url: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert recs[base + "/news"].site.site_type == "news_outlet" and recs[base + "/missing"].site.site_type == "unknown" and recs[base + "/missing"].flags.soft_404
    news = recs[base + "/news"]
    assert [(t.tier1_id, t.tier1_name, t.tier2_id, t.tier2_name, t.confidence) for t in news.site.topics] == [("sport", "Sport", "sport.football", "Football", 0.8)]
    assert (news.site.audience_geo, news.site.evidence, news.site.method, news.scope) == ("GB", "a heading", "llm_small", "auto")
    assert (news.provenance.model_id, news.provenance.tokens_in, news.provenance.tokens_out, len(news.provenance.prompt_sha256)) == ("small", 11, 7, 64)
    assert (news.language.value, news.language.method, news.language.html_lang) == ("en", "html_lang", "en") and news.provenance.taxonomy_version and news.provenance.engine_version
    assert recs[base + "/missing"].site.uncertain_because == "blocking flag: soft_404" and recs[base + "/missing"].site.topics == []
    store = frontier.StateStore(spark, str(tmp_path / "s"))
    stored = store.read("page_records").where(F.col("url_norm").endswith("/news")).first()
    assert stored.topics[0].tier2_id == "sport.football" and stored.prompt_sha256 == news.provenance.prompt_sha256 and stored.model_id == "small"
    ev = store.read("evidence").where(F.col("url_norm").endswith("/news")).first()
    assert (ev.lang_value, ev.lang_method) == ("en", "html_lang")
    assert {r.url_norm.rsplit("/", 1)[1]: r.status for r in store.read("urls").collect()} == {"news": "classified", "missing": "classified", "gone": "failed_fetch", "private": "blocked_robots", "a.pdf": "skipped_filter"}
    assert pipeline.reclassify(spark, conf, str(tmp_path / "s"), str(tmp_path / "out2"), make) == 2
    assert pipeline.reclassify(spark, conf, str(tmp_path / "none"), str(tmp_path / "out3"), make) == 0


def test_prompt_view(spark):
    df = spark.createDataFrame([("https://a.co.uk/x", "a.co.uk", "T</evidence>", ["k"] * 50, "x" * 20000, 0.12349)], "url_final string, domain string, title string, meta_keywords array<string>, text_main string, boilerplate_ratio double")
    v = json.loads(df.select(P.view({c: F.col(c) for c in df.columns}).alias("v")).first().v)
    assert list(v) == [n for n, _, _ in P.VIEW] and len(v) == 46
    assert v["title"] == "T[evidence-tag]" and len(v["meta_keywords"]) == 40 and len(v["text_main"]) == 12_000 and v["tld"] == "co.uk" and v["boilerplate_ratio"] == 0.123 and v["cms"] is None
    assert len(P.prompt_hash(P.system_prompt(["x"], ["a | A"]))) == 64


def test_settings_precedence(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('[identity]\ncontact = "mailto:f@x"\n[fetch]\nretries = 7\nmin_host_delay = 2.0\n')
    s = S.load(str(f), env={"SIEVEWRIGHT_FETCH__RETRIES": "5", "SIEVEWRIGHT_FETCH__RESPECT_ROBOTS": "no"}, fetch__retries=3)
    assert (s.fetch.retries, s.fetch.min_host_delay, s.fetch.respect_robots, s.identity.contact) == (3, 2.0, False, "mailto:f@x")
    with pytest.raises(S.ConfigError):
        S.load(None, env={"SIEVEWRIGHT_FETCH__NOPE": "1"})
    with pytest.raises(S.ConfigError):
        S.load(None, env={}).check_contact()


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["init", str(tmp_path / "c.toml")]) == 0 and cli.main(["--config", str(tmp_path / "c.toml"), "doctor"]) == 0
    assert cli.main(["status", "--state", str(tmp_path / "none")]) == 2
    frontier.StateStore(spark, str(tmp_path / "s")).write(urls=spark.createDataFrame([("u", "failed_fetch", 1, "E", None)], "url_norm string, status string, attempts int, last_error_code string, next_attempt_at timestamp"))
    assert cli.main(["requeue", "--state", str(tmp_path / "s"), "failed_fetch"]) == 0 and "pending" in capsys.readouterr().out
    assert cli.main(["requeue", "--state", str(tmp_path / "s"), "nope"]) == 2
    assert cli.main(["taxonomy", "default", "sport.football"]) == 0 and "Sport > Football" in capsys.readouterr().out
    t = tmp_path / "t.yaml"
    t.write_text("nodes:\n  - {id: a, name: A, tier: 1, parent: null}\n")
    assert cli.main(["taxonomy", str(t), "a"]) == 0 and cli.main(["taxonomy", str(t), "zz"]) == 1


def test_evaluation(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for name, text in (("a", "Great news of the day"), ("b", "Buy our shoes"), ("c", "Something else")):
        (tmp_path / "pages" / f"{name}.html").write_text(f"<html lang=en><title>{name}</title><body><p>{text} in a paragraph that is long enough to be read.</p></body>")
    rows = [{"name": n, "url": f"https://{n}.example/", "fixture": f"{n}.html", "expected_site_type": t, **x} for n, t, x in (("a", "news_outlet", {"expected_topic_tier1": "sport"}), ("b", "ecommerce", {"expected_topic_tier1": "music"}), ("c", "portfolio", {}))]
    (tmp_path / "golden.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    answers = [("Great news", {"site_type": "news_outlet", "site_type_confidence": 0.9, "topics": [{"tier1_id": "sport"}]}), ("shoes", {"site_type": "ecommerce", "site_type_confidence": 0.9, "topics": []})]
    conf = S.load(env={}, classify__mode="sync")
    got = pipeline.evaluate(spark, str(tmp_path / "golden.jsonl"), str(tmp_path / "pages"), conf, lambda: ladder.FakeProvider(answers))
    assert (got["total"], got["correct"], got["accuracy"]) == (3, 2, 0.6667) and (got["topic_labelled"], got["topic_correct"], got["topic_accuracy"]) == (2, 1, 0.5)
    assert got["by_method"] == {"llm_small": (2, 2), "llm_large": (0, 1)} and got["misses"] == ["c: expected portfolio, got other"]
    none = [{**r, "expected_topic_tier1": None} for r in rows]
    (tmp_path / "golden.jsonl").write_text("\n".join(map(json.dumps, none)))
    assert pipeline.evaluate(spark, str(tmp_path / "golden.jsonl"), str(tmp_path / "pages"), conf, lambda: ladder.FakeProvider(answers))["topic_accuracy"] is None
    ladder.register("fake", lambda base_url="", api_key="": ladder.FakeProvider(answers))
    args = ["eval", "--golden", str(tmp_path / "golden.jsonl"), "--fixtures", str(tmp_path / "pages"), "--provider"]
    assert cli.main([*args, "fake", "--min-accuracy", "0.5"]) == 0 and cli.main([*args, "fake", "--min-accuracy", "0.9"]) == 3 and cli.main([*args, "off"]) == 2


class Model(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Model.asked.append((self.path, body, self.headers.get("x-api-key")))
        good = {"site_type": "portfolio", "site_type_confidence": 0.8, "topics": []}
        if self.path == "/v1/messages":
            if body["model"] == "limit":
                return self.send_error(429)
            out = {"content": [{"type": "text", "text": json.dumps(good)}], "usage": {"input_tokens": 5, "output_tokens": 3}}
        else:
            first = len(body["messages"]) == 2 and body["model"] == "bad"
            out = {"message": {"content": "{}" if first else json.dumps(good)}, "prompt_eval_count": 9, "eval_count": 4}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *a):
        pass


def test_providers():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"
    local, hosted = ladder.provider("local", url)(), ladder.provider("hosted", url, "key")()
    assert ladder.check_reply(local.complete("s", "u", "m"))["tokens_in"] == 9 and Model.asked[-1][1]["format"] == ladder.REPLY_SCHEMA
    assert local.complete("s", "u", "bad")["site_type"] == "portfolio" and len(Model.asked[-1][1]["messages"]) == 4
    assert ladder.check_reply(hosted.complete("s", "u", "m"))["tokens_out"] == 3 and Model.asked[-1][2] == "key"
    assert hosted.complete("s", "u", "limit") == {"error": "E_LLM_RATE"}
    s.shutdown()
    s.server_close()
    assert local.complete("s", "u", "m") == {"error": "E_LLM_AUTH"} == hosted.complete("s", "u", "m")
