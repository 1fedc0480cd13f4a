import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import encoding

PIECES = ["a", "ab", "the", " ", "  ", "\n", "\t\n ", "'l", "l", "'s", "é", "ß", "中文", "🙂", "1", "23", "--", "…", "<|endoftext|>", "aaaa" * 30, "xyz" * 40, " " * 70, "'", " ", "á"]
ENC = encoding.Encoder(encoding.vocabulary(), piece=8)


@pytest.fixture(scope="module")
def enc():
    return ENC


def by_tree(text, leaf):
    return ENC.concatenate([(p, k, ENC.leaf_ids(w, b)) for p, k, w, b in ENC.leaves(text, leaf)])


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.integers(1, 60))
def test_tree_equals_direct(parts, leaf):
    text = "".join(parts)
    want = ENC.bpe.encode_ordinary(text)
    assert by_tree(text, leaf) == want and ENC.encode(text) == want


@settings(max_examples=1000, deadline=None)
@given(st.text(max_size=200), st.integers(1, 50))
def test_tree_equals_direct_any_text(text, leaf):
    text = text.encode("utf-8", "ignore").decode()
    want = ENC.bpe.encode_ordinary(text)
    assert by_tree(text, leaf) == want and ENC.encode(text) == want


def test_contractions_across_leaves():
    for text in ("'ll", "x'll", "'lll", "it's 'tis", "''s", " 's", "\n's", "'re're", "don't"):
        for leaf in (1, 2, 3):
            assert by_tree(text, leaf) == ENC.bpe.encode_ordinary(text), (text, leaf)


def test_unsplit_piece_by_halves(enc):
    rng = random.Random(1)
    for n in (17, 100, 1000, 5000):
        b = bytes(rng.choice(b"abcde") for _ in range(n))
        assert enc.piece(b) == enc.bpe._encode_single_piece(b)


def test_joins_encode_windows_only():
    rng = random.Random(4)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    e = encoding.Encoder(encoding.vocabulary())
    leaves = [(p, k, e.leaf_ids(w, b)) for p, k, w, b in e.leaves(letters, 8192)]
    assert len(leaves) == 123 and all(p == 0 for p, _, _ in leaves)
    e.window_bytes = 0
    ids = e.concatenate(leaves)
    assert e.window_bytes <= 122 * 200  # a few windows a join, whatever the size of its sides
    assert b"".join(e.bytes_of[t] for t in ids).decode() == letters
    assert all(e.fits(a, b) for a, b in zip(ids, ids[1:]))
    short = letters[:3000]
    assert e.concatenate([(p, k, e.leaf_ids(w, b)) for p, k, w, b in e.leaves(short, 700)]) == e.bpe.encode_ordinary(short)


def test_leaves_end_at_safe_boundaries_where_there_are_some():
    text = "word, and 'more' words 123abc " * 50
    leaves = list(ENC.leaves(text, 100))
    assert all(w for _, _, w, _ in leaves) and "".join(b.decode() for *_, b in leaves) == text and max(len(b) for *_, b in leaves) <= 100


def test_rows_and_edge_cases(spark):
    long = "word " * 30 + "z" * 500 + " tail, it's  \n\n done " * 20
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|>", "x"), (5, long, "x"), (5, long, "x"), (5, long + "!", "x"), (6, "  ", None), (None, "q" * 300, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    e = encoding.encoder()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for leaf in (64, 256, encoding.LEAF):
        got = sorted(((r.doc_id, list(r.ids)) for r in encoding.token_ids(df, leaf=leaf).collect()), key=key)
        assert got == sorted(((i, e.bpe.encode_ordinary(t or "")) for i, t, _ in rows), key=key)
        counts = sorted(((r.doc_id, r.n_tokens) for r in encoding.token_counts(df, leaf=leaf).collect()), key=key)
        assert counts == sorted(((i, len(e.bpe.encode_ordinary(t or ""))) for i, t, _ in rows), key=key)
    assert encoding.token_ids(df.where("false")).count() == 0 and encoding.token_counts(df.where("false")).count() == 0


def test_vocabulary_folder_is_a_setting(spark, tmp_path):
    spark.conf.set(encoding.FOLDER_SETTING, str(tmp_path))
    try:
        with pytest.raises(FileNotFoundError):
            encoding.token_ids(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    finally:
        spark.conf.unset(encoding.FOLDER_SETTING)
