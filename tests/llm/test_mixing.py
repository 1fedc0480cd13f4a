from sievewright.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_uses string"
TARGETS = "source string, target_share double, max_repeats int"


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [("a", "en", 100), ("a", "de", 10), ("b", "en", 1000)]
    plan = {(s, lang): b for s, lang, b, _ in mixing.plan_budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1), "none": (0.1, 3)}, 150)}
    assert abs(plan["a", "en"] + plan["a", "de"] - 75) < 1e-6 and abs(plan["b", "en"] - 75) < 1e-6
    plan = {(s, lang): b for s, lang, b, _ in mixing.plan_budgets(leaves, {"a": (0.9, 1), "b": (0.1, 1)}, 500)}
    assert abs(plan["a", "en"] - 100) < 1e-6 and abs(plan["a", "de"] - 10) < 1e-6 and abs(plan["b", "en"] - 390) < 1e-6


def test_shares_and_repeats(spark):
    rows = [(i, f"word number {i} and so on", "en", ("Web-Crawl ", "small")[i % 20 == 0], "clash") for i in range(400)]
    rows += [(1000, None, "en", "small", None), (1001, "", None, "web_crawl", None), (1002, "x", "en", None, None), (1003, "x", "en", "unlisted", None)]
    m = mixing.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("web_crawl", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 2)], TARGETS))
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["small"].actual_share - 0.3) < 0.02 and abs(shares["web_crawl"].actual_share - 0.7) < 0.02
    assert shares["absent"].actual_share == 0 and shares["small"].most_uses <= 3
    used = m.rows().collect()
    assert len({r.doc_id for r in used}) == len(used) and all(1 <= r.n_uses <= (3 if r.source == "small" else 1) for r in used)
    assert not {1002, 1003} & {r.doc_id for r in used}
    again = sorted((r.doc_id, r.n_uses) for r in m.rows().collect())
    assert again == sorted((r.doc_id, r.n_uses) for r in used)


def test_empty(spark):
    m = mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert m.rows().count() == 0 and m.shares().collect()[0].actual_share == 0
    m = mixing.mix(spark.createDataFrame([(1, "x", "en", "a", None)], DOCS), spark.createDataFrame([], TARGETS))
    assert m.rows().count() == 0


def test_tree_of_three_levels_and_shortages():
    leaves = [("a", "en", "blog", 60), ("a", "en", "news", 40), ("a", "de", "blog", 10), ("b", "en", "news", 1000)]
    plan = {x[:3]: x[3] for x in mixing.plan_budgets(leaves, {"a": (0.5, 2), "b": (0.5, 1)}, 600)}
    assert abs(sum(plan.values()) - 600) < 1e-6
    # a is full with all its children at twice what they hold; b takes the rest
    assert [round(plan["a", *x]) for x in (("en", "blog"), ("en", "news"), ("de", "blog"))] == [120, 80, 20] and round(plan["b", "en", "news"]) == 380


def test_prefixes_and_stated_total(spark):
    rows = [(i, "word " * (1 + i % 7), ["en", "de", "fr"][i % 3], ["big", "small"][i % 30 == 0], None, ["blog", "news", None][i % 3]) for i in range(900)]
    rows += [(1000 + i, None, "en", "big", None, "blog") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS + ", site_type string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3)], TARGETS)
    m = mixing.mix(docs, targets, part=1.0)
    m.rows().createOrReplaceTempView("mix_rows")
    got = {r.source: r for r in spark.sql("SELECT source, sum(n_tokens * n_uses) AS tokens, max(n_uses) AS most, count(*) AS n FROM mix_rows GROUP BY source").collect()}
    shares = {r.source: r for r in m.shares().collect()}
    assert {k: v.tokens for k, v in got.items()} == {k: v.tokens for k, v in shares.items()}
    held = {r.source: r.t for r in m.tokens.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    total = sum(held.values())
    # small repeats to its cap, big takes what small lacks as far as it can
    assert got["small"].tokens == 3 * held["small"] and got["small"].most == 3
    assert got["big"].tokens == held["big"] or abs(got["big"].tokens + got["small"].tokens - total) <= 4
    # a leaf's documents are the first ones of its seeded order
    few = mixing.mix(docs, targets, budget=300)
    used = {(r.doc_id): r.n_uses for r in few.rows().collect()}
    by: dict = {}
    for r in few.tokens.collect():
        by.setdefault((r.source, r.lang, r.kind), []).append((r._h, r.doc_id))
    for leaf in by.values():
        uses = [used.get(i, 0) for _, i in sorted(leaf)]
        assert uses == sorted(uses, reverse=True) and max(uses) - min(uses) <= 1
    assert abs(sum(r.n_tokens * r.n_uses for r in few.rows().collect()) - 300) <= 8


def test_rounding_comes_closest():
    ends = [(("a", str(i)), 5.0, 10) for i in range(4)] + [(("b", "x"), 1.0, 10)]
    assert len(mixing.round_up(ends)) == 2 and ("b", "x") not in mixing.round_up(ends)
