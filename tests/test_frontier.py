import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sievewright.functions import guard
from sievewright.operators import frontier, ladder, records, taxonomy
from sievewright.sources import fetch
from sievewright.sources.lines import parse_lines
from sievewright.streaming import intake

STATE = "url_norm string, host string, domain string, status string, attempts int, last_error_code string, next_attempt_at timestamp, seen_at timestamp"


def state(spark):
    return spark.createDataFrame([("a", "h1", "d", "pending", 0, None, None, None), ("b", "h0", "d", "fetching", 1, None, None, None), ("c", "h2", None, "failed_fetch", 3, "E_DNS", None, None)], STATE)


def test_lines(spark):
    raw = ["# note", "", " https://a.example ", '{"url": "b.example", "scope": "page", "tags": ["x", 1]}', "{broken", '{"scope": "page"}', '{"url": "c.example", "scope": "nope"}']
    got = [(r.url_raw, r.scope, list(r.tags), r.reject_reason) for r in parse_lines(spark.createDataFrame([(x,) for x in raw], "line string")).collect()]
    assert got == [("https://a.example", "auto", [], None), ("b.example", "page", ["x", "1"], None), ("c.example", None, [], "bad_scope")]


def test_admit_and_insert(spark):
    lines = spark.createDataFrame([(1, "A.example/x", "auto"), (2, "https://a.example/x#f", "page"), (3, "mailto:x", "auto"), (4, "https://a.example/y.pdf", "auto"), (5, None, "auto")], "line_no long, url_raw string, scope string")
    rows = {r.url_norm: r for r in frontier.admit(lines).collect()}
    assert set(rows) == {"https://a.example/x", "https://a.example/y.pdf"} and rows["https://a.example/x"].line_no == 1
    assert rows["https://a.example/y.pdf"].status == "skipped_filter"
    both = frontier.insert_absent(frontier.admit(lines), frontier.admit(lines))
    assert both.count() == 2


def test_updates(spark):
    s = state(spark)
    assert {r.url_norm: r.status for r in frontier.requeue_stuck(s).collect()} == {"a": "pending", "b": "pending", "c": "failed_fetch"}
    r = frontier.requeue(s, "failed_fetch").where("url_norm = 'c'").first()
    assert (r.status, r.attempts, r.last_error_code) == ("pending", 0, None)
    with pytest.raises(ValueError):
        frontier.requeue(s, "nope")
    with pytest.raises(ValueError):
        frontier.set_columns(s, spark.createDataFrame([("a", "x")], "url_norm string, host string"))
    u = frontier.set_columns(s, spark.createDataFrame([("a", None, "fetched")], "url_norm string, last_error_code string, status string"))
    assert {r.url_norm: r.status for r in u.collect()} == {"a": "fetched", "b": "fetching", "c": "failed_fetch"}
    b = frontier.bump_attempts(s, s.where("url_norm = 'a'").union(s.where("url_norm = 'a'")))
    assert {r.url_norm: r.attempts for r in b.collect()} == {"a": 1, "b": 1, "c": 3}
    assert [r.url_norm for r in frontier.pending(frontier.requeue_stuck(s)).collect()] == ["b", "a"]
    assert frontier.counts_by_status(s).count() == 3 and frontier.first_seen(s).count() == 1
    assert frontier.latest(s.where("false"), "url_norm", "attempts").count() == 0
    tie = spark.createDataFrame([("k", 1, "b", {"x": 1}), ("k", 1, "a", None), (None, 0, "z", None), ("n", None, None, None)], "k string, o int, v string, m map<string,int>")
    assert {(r.k, r.v) for r in frontier.first_wins(tie, "k", "o").collect()} == {("k", "a"), ("n", None)}
    assert {(r.k, r.v) for r in frontier.latest(tie, "k", "o").collect()} == {("k", "b"), ("n", None)}


def test_state_store_swaps_whole_versions(spark, tmp_path):
    store = frontier.StateStore(spark, str(tmp_path / "s"))
    assert store.read("urls") is None
    store.write(urls=state(spark))
    store.write(urls=frontier.requeue_stuck(store.read("urls")), domains=frontier.first_seen(state(spark)))
    assert store.read("urls").where("status = 'fetching'").count() == 0 and store.read("domains").count() == 1


def test_stream_intake(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("https://a.example/x\nb.example\n# c\n")
    store = frontier.StateStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        q = intake.run_intake(intake.read_line_stream(spark, str(src)), store, str(tmp_path / "ck"))
        q.awaitTermination(120)
        (src / "2.txt").write_text("https://a.example/x#again\nhttps://c.example/z.zip\n")
    assert {r.url_norm: r.status for r in store.read("urls").collect()} == {"https://a.example/x": "pending", "https://b.example": "pending", "https://c.example/z.zip": "skipped_filter"}
    assert len(store._current()[1]["tables"]["urls"]["deltas"]) == 1 and store.read("urls", status="skipped_filter").count() == 1
    store.compact("urls")
    assert "deltas" not in store._current()[1]["tables"]["urls"] and store.read("urls").count() == 3


def test_append_against_a_writer(spark, tmp_path):
    a, b = frontier.StateStore(spark, str(tmp_path / "s")), frontier.StateStore(spark, str(tmp_path / "s"))
    a.append("urls", state(spark))
    have = a.read("urls")
    b.append("urls", spark.createDataFrame([("d", "h3")], "url_norm string, host string"))
    with pytest.raises(frontier.StateConflict):  # what was appended meanwhile would be lost
        a.write(urls=have)
    assert {r.url_norm: r.status for r in a.read("urls").collect()} == {"a": "pending", "b": "fetching", "c": "failed_fetch", "d": None}


def test_robots_and_retries_as_columns(spark):
    df = spark.createDataFrame([(None, None, "/x"), ("User-agent: *\nDisallow: /", 200, "/x"), ("User-agent: *\nDisallow: /", 500, "/x")], "b string, s int, p string")
    assert [r.a for r in df.select(guard.robots_allow(F.col("b"), F.col("s"), F.col("p"), "x").alias("a")).collect()] == [True, False, True]
    waits = spark.createDataFrame([(1, "E_DNS", None), (9, "E_DNS", "5"), (1, "E_RATE_LIMIT", "7"), (1, "E_RATE_LIMIT", "900"), (2, "E_RATE_LIMIT", "x")], "n int, c string, r string")
    got = [r.w for r in waits.select(guard.retry_delays(F.col("n"), F.col("c"), F.col("r")).alias("w")).collect()]
    assert got == [0.5, 20.0, 7.0, 60.0, 1.0] == [guard.retry_delay(n, c, r, rng=lambda: 0.0) for n, c, r in [(1, "E_DNS", None), (9, "E_DNS", "5"), (1, "E_RATE_LIMIT", "7"), (1, "E_RATE_LIMIT", "900"), (2, "E_RATE_LIMIT", "x")]]


def test_guard():
    assert all(guard.address_problem(a) for a in ["10.0.0.1", "127.0.0.1", "100.64.1.1", "168.63.129.16", "::1", "64:ff9b::1", "2002:7f00:1::", "::ffff:10.0.0.1", "224.0.0.1", "x"])
    assert not any(guard.address_problem(a) for a in ["8.8.8.8", "2606:4700:4700::1111"]) and guard.address_problem("10.0.0.1", allow_private=True) is None
    called = []
    with pytest.raises(guard.Blocked) as e:
        guard.resolve("x.example", 22, lookup=lambda *a, **k: called.append(1))
    assert e.value.code == "E_SSRF_BLOCKED" and not called
    two = lambda *a, **k: [(0, 0, 0, "", ("8.8.8.8", 0)), (0, 0, 0, "", ("10.0.0.1", 0))]
    with pytest.raises(guard.Blocked):
        guard.resolve("x.example", None, lookup=two)


def test_robots():
    r = guard.Robots(200, "User-agent: *\nDisallow: /\n\nUser-agent: sieve\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf$\nCrawl-delay: 99\n", "sievewright/1")
    assert r.allows("/") and not r.allows("/private") and r.allows("/p/ok/1") and not r.allows("/x.pdf") and r.allows("/x.pdf?y") and guard.host_delay(r.delay) == 30.0
    assert not guard.Robots(200, "User-agent: *\nDisallow: /", "other").allows("/x")
    assert guard.Robots(503, "User-agent: *\nDisallow: /", "other").allows("/x") and guard.Robots(0, "", "x").allows("/")
    assert guard.host_delay(None, 0.1) == 0.5 and guard.retry_delay(1, "E_RATE_LIMIT", "120") == 60.0 and guard.retry_delay(9, "E_TIMEOUT", rng=lambda: 0) == 20.0


class Site(BaseHTTPRequestHandler):
    tries: dict = {}

    def do_GET(self):  # noqa: N802
        p = self.path
        Site.tries[p] = Site.tries.get(p, 0) + 1
        code, head, body = 200, {"Content-Type": "text/html; charset=utf-8"}, b"<html><title>ok</title>"
        if p == "/robots.txt":
            body = b"User-agent: *\nDisallow: /private"
        elif p == "/redirect":
            code, head = 302, {"Location": "/target"}
        elif p == "/loop":
            code, head = 302, {"Location": "/loop"}
        elif p == "/pdf":
            head = {"Content-Type": "application/pdf"}
        elif p == "/gone":
            code = 404
        elif p == "/flaky" and Site.tries[p] < 3:
            code = 503
        elif p == "/big":
            head["Content-Length-Claim"] = "1"
            body = b"x" * 300_000
        self.send_response(code)
        for k, v in head.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def site():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1]
    s.shutdown()


def test_fetch_local_server(spark, site):
    base = f"http://127.0.0.1:{site}"
    rules = fetch.FetchRules(allow_private=True, ports=(site,), host_delay=0.5, retries=2, max_body=100_000)
    session = fetch.HostSession(rules, sleep=lambda s: None)
    out = {p: session.fetch(base + p) for p in ("/x", "/redirect", "/loop", "/pdf", "/gone", "/flaky", "/private", "/big")}
    assert out["/x"]["error_code"] is None and out["/x"]["content"].startswith(b"<html>") and out["/x"]["charset"] == "utf-8"
    assert out["/redirect"]["url_final"].endswith("/target") and len(out["/redirect"]["redirect_chain"]) == 1
    codes = {p: o["error_code"] for p, o in out.items()}
    assert codes["/loop"] == "E_REDIRECT_LOOP" and codes["/pdf"] == "E_NONHTML" and codes["/gone"] == "E_HTTP_4XX" and codes["/private"] == "E_ROBOTS_BLOCK" and codes["/big"] == "E_BOMB"
    assert codes["/flaky"] is None and out["/flaky"]["attempts"] == 3 and Site.tries["/robots.txt"] == 1
    assert fetch.HostSession(fetch.FetchRules(), sleep=lambda s: None).fetch(base + "/x")["error_code"] == "E_SSRF_BLOCKED"
    df = spark.createDataFrame([(base + "/x", "127.0.0.1"), (base + "/gone", "127.0.0.1")], "url_norm string, host string")
    got = {r.url_norm: r.error_code for r in fetch.fetch(df, rules, 2).collect()}
    assert got == {base + "/x": None, base + "/gone": "E_HTTP_4XX"}


NODES = [("a", "A", 1, None, [], "h"), ("a.x", "AX", 2, "a", [], None), ("b", "B", 1, None, [], None), ("b.y", "BY", 2, "b", [], None)]


def test_taxonomy(spark, tmp_path):
    t = spark.createDataFrame(NODES, taxonomy.SCHEMA)
    assert {(r.id, r.ancestor) for r in taxonomy.closure(t).collect()} == {("a", "a"), ("a.x", "a.x"), ("a.x", "a"), ("b", "b"), ("b.y", "b.y"), ("b.y", "b")}
    assert {r.id: r.line for r in taxonomy.paths(t).collect()}["a"] == "a | A  (hints: h)"
    bad = spark.createDataFrame(NODES + [("a", "again", 1, None, [], None), ("c", "C", 2, "zz", [], None), ("d", "D", 3, "a", [], None)], taxonomy.SCHEMA)
    assert taxonomy.problems(bad).count() == 3
    f = tmp_path / "t.yaml"
    f.write_text("nodes:\n  - {id: a, name: A, tier: 1, parent: null}\n  - {id: a.x, name: X, tier: 2, parent: a, hints: h}\n")
    assert taxonomy.load(spark, str(f)).count() == 2
    f.write_text("nodes:\n  - {id: a, name: A, tier: 2, parent: zz}\n")
    with pytest.raises(ValueError):
        taxonomy.load(spark, str(f))
    v = spark.createDataFrame([(1, [("a", "b.y", 2.0), ("a", None, 0.5), ("zz", None, 0.9), ("b", "b.y", -1.0), ("a.x", None, 0.4)]), (2, None), (3, [])], "k long, topics array<struct<tier1_id:string,tier2_id:string,confidence:double>>")
    got = [(r.k, r.rank, r.tier1_id, r.tier2_id, r.confidence) for r in taxonomy.validate_topics(v, t, "k").collect()]
    assert sorted(got) == [(1, 0, "a", None, 1.0), (1, 1, "b", "b.y", 0.0)]


def test_ladder_branches(spark):
    pages = spark.createDataFrame([(i, i == 0, f"page {i}") for i in range(6)], "k long, blocked boolean, prompt string")
    small = {"page 1": {"site_type": "corporate", "site_type_confidence": 0.75}, "page 2": {"site_type": "corporate", "site_type_confidence": 0.74}, "page 3": {"site_type": "other", "site_type_confidence": 2}, "page 4": {"site_type": "other", "site_type_confidence": 0.1}, "page 5": {"site_type": None, "site_type_confidence": 0.99}}
    large = {"page 2": {"site_type": "ecommerce", "site_type_confidence": 0.6}, "page 4": {"error": "E_LLM_RATE"}, "page 5": {"site_type": "government", "site_type_confidence": 0.59}}
    call = lambda answers: lambda df: ladder.ask(df, "k", "prompt", lambda: ladder.FakeProvider(list(answers.items())), "s", "m", 2)
    got = {r.k: (r.method, r.site_type, r.needs_human) for r in ladder.climb(pages, "k", F.col("blocked"), F.lit("blocking flag: dead"), call(small), call(large)).collect()}
    assert got == {0: ("blocked", None, False), 1: ("llm_small", "corporate", False), 2: ("llm_large", "ecommerce", False), 3: ("failed_classify", None, True), 4: ("llm_small", "other", True), 5: ("llm_large", "government", True)}
    off = ladder.climb(pages, "k", F.col("blocked"), F.lit("r"), None, None)
    assert {r.k: r.needs_human for r in off.collect()} == {0: False, **{i: True for i in range(1, 6)}}
    with pytest.raises(ValueError):
        ladder.provider("nope")
    assert ladder.provider("off") is None


def test_records_and_eval(spark, tmp_path):
    df = spark.createDataFrame([("u", None)], "url string, site_type string")
    r = df.select(records.build_record({"url": F.col("url"), "site_type": F.col("site_type"), "redirect_chain": F.array(F.lit("x"))}, {"dead": F.lit(False)}).alias("r")).select("r.*")
    assert r.first().site.site_type == "unknown" and r.first().http.redirects == 1
    records.write_jsonl(r, str(tmp_path / "o"))
    records.write_jsonl(r, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    rows = spark.createDataFrame([(1, "a", "a", "m"), (2, "a", None, "m"), (3, "b", "a", "n")], "k long, e string, g string, method string")
    assert records.accuracy(rows, "e", "g").first().accuracy == 0.3333 and records.accuracy(rows.where("false"), "e", "g").first().accuracy == 0.0
    assert {(x.method, x.total, x.correct) for x in records.by_method(rows, "e", "g").collect()} == {("m", 2, 1), ("n", 1, 0)} and records.mismatches(rows, "k", "e", "g").count() == 2


def test_two_writers(spark, tmp_path):
    a, b = frontier.StateStore(spark, str(tmp_path / "s")), frontier.StateStore(spark, str(tmp_path / "s"))
    a.write(urls=state(spark), other=spark.range(2))
    ours, theirs = a.read("urls"), b.read("urls")
    b.write(urls=frontier.requeue_stuck(theirs))
    with pytest.raises(frontier.StateConflict):
        a.write(urls=frontier.requeue(ours, "failed_fetch"))
    a.write(more=spark.range(3))  # tables that nobody else changed are taken over
    assert {r.url_norm: r.status for r in a.read("urls").collect()} == {"a": "pending", "b": "pending", "c": "failed_fetch"} and b.read("more").count() == 3
    got = a.read("urls", status="pending")
    assert got.columns == state(spark).columns and got.count() == 2 and "PartitionFilters: [isnotnull(_status" in got._jdf.queryExecution().toString()
    assert [r.host for r in frontier.get(a.read("urls"), "c").collect()] == ["h2"]
    for k in range(6):
        a.write(more=spark.range(k))
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("more-")]) <= 4
    assert not a._create(a._current()[0], {})
    f = next(p for p in sorted((tmp_path / "s").glob("v*.json")))
    f.with_name("v999.json").write_text('{"schema_version": "0", "tables": {}}')
    with pytest.raises(ValueError):
        a.read("urls")
