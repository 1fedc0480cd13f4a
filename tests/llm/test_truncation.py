from sievewright.llm import truncation

SCHEMA = "doc_id long, text string, source string, words string"
SENTENCES = ["The meeting was held in the old town hall.", "Nobody had expected such a large crowd that day.", "The cook prepared a soup with fresh herbs.", "We would do it the same way again."]


def corpus():
    rows = [(i, " ".join(SENTENCES[(i + k) % 4] for k in range(2 + i % 3)), "Feed A", None) for i in range(60)]
    body = " ".join(SENTENCES)
    rows += [(100 + i, (body[: 40 + i % 7] + " " + body * 3)[:200].rstrip(".")[:200], "feed-b", None) for i in range(12)]
    rows += [(200 + i, f"{body} Tags: alpha, beta{'x' * i}", "feed_c", None) for i in range(5)]
    rows += [
        (300, body + " Nobody had expected such a lar", "feed_c", None),
        (301, body + " Nobody had expected such…", "feed_c", None),
        (302, body + " We would do it the same way again…", "feed_c", None),
        (303, body + " We would do it the same way again", "feed_c", None),
        (304, body + " https://a.example/b", "feed_c", None),
        (305, body + " :-)", "feed_c", None),
        (306, body + " Nobody had expected such a lar", None, None),
        (307, None, "feed_c", None),
        (308, "", "feed_c", None),
        (309, " \n ", None, None),
    ]
    return rows + rows[-5:-4]


def test_found(spark):
    rows = corpus()
    got = {r.doc_id for r in truncation.cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {300, 301, 306} <= got
    assert not got & ({302, 303, 304, 305, 307, 308, 309} | set(range(60)) | set(range(200, 205)))


def test_pieces_that_several_cut_texts_share_are_no_formula(spark):
    body = " ".join(SENTENCES)
    rows = corpus() + [(400 + i, " ".join(SENTENCES[(i + k) % 4] for k in range(3 + i // 4)) + f" {piece}", "feed_c", None) for i, piece in enumerate(["Nob"] * 4 + ["Nobody"] * 4 + ["The mee"] * 4)]
    rows += [(500 + i, f"{body * (1 + i)} Written by\n- Nobody", "feed_c", None) for i in range(4)]
    got = {r.doc_id for r in truncation.cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(range(400, 412)) <= got and not got & (set(range(200, 205)) | set(range(500, 504)))


def test_length_limit_is_found(spark):
    body = "".join(SENTENCES) * 5
    rows = [(i, body[i:][: 30 + 7 * (i % 40)], "web feed", None) for i in range(150)] + [(500 + i, body[i : i + 120], "WEB-feed", None) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("regexp_replace(lower(source), '[ -]', '_') AS source", "xxhash64(text) AS _x", "length(text) AS chars", "octet_length(text) AS bytes")
    got = {(r.unit, r.len) for r in truncation.hazard_lengths(df).collect()}
    assert ("chars", 120) in got and ("bytes", 120) in got


def test_shares_and_empty(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    shares = {r.source: r for r in truncation.cut_shares(df).collect()}
    assert shares["feed_a"].n_cut == 0 and shares["feed_c"].n_cut == 2 and shares[None].n_cut == 1
    assert truncation.cut_documents(df.where("false")).count() == 0
    assert truncation.cut_shares(df.where("false")).count() == 0
