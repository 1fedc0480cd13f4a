import random

import pytest

from sievewright.operators import hotkeys

URLS = "line_no long, url_norm string, host string, domain string, status string, attempts int, page_id long"
PAGES = "page_id long, url_norm string, body_text_len int, weight string"


def test_key_stats_hand_case(spark):
    urls = spark.createDataFrame(
        [
            (1, "u1", "A.x.", "x", "ok", 1, None),
            (2, "u1", "a.x", "X.", "ok", 2, None),
            (3, "u2", "a.x", None, None, None, None),
            (4, None, "b.x", "x", "bad", 3, None),
            (5, "u3", "...", " ", "bad", 3, None),
        ],
        URLS,
    )
    pages = spark.createDataFrame([(1, "u1", 5, "w"), (2, "u1", 5, "w"), (3, "u2", None, None), (4, None, 9, None)], PAGES)
    got = {(r.key_field, r.key_value): (r.n_rows, r.n_urls, r.n_pages, r.sum_len) for r in hotkeys.key_stats(urls, pages).collect()}
    assert got == {
        ("domain", "x"): (3, 1, 2, 10),
        ("host", "a.x"): (3, 2, 3, 10),
        ("host", "b.x"): (1, 0, 0, 0),
    }


def test_empty_tables(spark):
    urls, pages = spark.createDataFrame([], URLS), spark.createDataFrame([], PAGES)
    assert hotkeys.key_stats(urls, pages).count() == 0
    assert hotkeys.heavy_keys(urls).count() == 0
    assert hotkeys.key_profile(urls).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile_is_exact_across_buckets(spark, q):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, rng.randrange(-10, 10), rng.randrange(0, 1 << 20)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: r.percentile for r in hotkeys.weighted_percentile(hotkeys.frequencies(df, ["k"], "v"), ["k"], "v", q).collect()}
    for k in "ab":
        vals = sorted(v for kk, v in rows if kk == k and v is not None)
        rank = max(1, -(-int(round(len(vals) * q * 1000)) // 1000))
        assert got[k] == vals[rank - 1]


def test_mode_ties_take_the_least(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("a", None), ("b", None)], "k string, v string")
    got = hotkeys.weighted_mode(hotkeys.frequencies(df, ["k"], "v"), ["k"], "v").collect()
    assert [(r.k, r["mode"], r.mode_rows) for r in got] == [("a", "x", 1)]


def test_heavy_keys_share_is_strict(spark):
    urls = spark.createDataFrame([(i, f"u{i}", f"h{i % 100}", None if i % 2 else "big", "s", 0, 0) for i in range(200)], URLS)
    assert {(r.key_field, r.key_value) for r in hotkeys.heavy_keys(urls, 0.01).collect()} == {("domain", "big")}
