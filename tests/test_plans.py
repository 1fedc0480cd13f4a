"""What the optimizer makes of the plans: columns that scans read, filters that reach them, exchanges."""

import re

import pytest

from sievewright.operators import frontier, hotkeys
from sievewright.session import spread


@pytest.fixture(scope="module")
def urls(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "urls.parquet")
    cols = "line_no long, url_norm string, url_raw string, host string, domain string, status string, attempts int, scope string"
    spark.createDataFrame([(i, f"u{i % 7}", "raw", f"h{i % 3}", "d", "pending", 0, "auto") for i in range(50)], cols).write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_read_three_columns_and_no_window(urls):
    p = plan(hotkeys.heavy_keys(urls))
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", p).group(1))) == {"url_norm", "host", "domain"}
    assert "Window" not in p and "Nested" not in p and "Cartesian" not in p


def test_pending_filter_reaches_the_scan(urls):
    p = plan(frontier.pending(urls).select("host", "url_norm"))
    assert "EqualTo(status,pending)" in p and "url_raw" not in p


def test_first_wins_aggregates_before_the_shuffle(urls):
    p = plan(frontier.first_wins(urls.select("url_norm", "line_no", "scope"), "url_norm", "line_no"))
    assert p.count("Aggregate") == 2 and "Window" not in p and p.count("Exchange hashpartitioning") == 1


def test_spread_keeps_shuffled_plans(urls):
    assert spread(urls)._jdf.queryExecution().toRdd().getNumPartitions() >= urls.sparkSession.sparkContext.defaultParallelism
    agg = urls.groupBy("host").count()
    assert spread(agg) is agg
