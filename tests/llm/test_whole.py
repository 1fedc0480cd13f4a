import random

import numpy as np
import pytest

from sievewright.llm import counts, pages, residue, stuffing, subjects
from sievewright.llm.pagetext import Batch, Vocabulary

FORMS = ["The {} was moved to the old harbour last year.", "Nobody had expected that the {} would cost so much.", "She said that the {} and the {} belong together.", "There is no {} in the archive of the town.", "We asked around and heard very different answers about the {}."]
TERMS = {"mus": ["violin", "orchestra", "choir"], "spt": ["goalkeeper", "referee", "striker"]}
SCHEMA = "page_id long, url_norm string, title string, body_text string, html_lang string, js_only boolean, meta_keywords array<string>"


def text(rng, words, n=6):
    return " ".join(rng.choice(FORMS).format(*[rng.choice(words) for _ in range(2)]) for _ in range(n))


@pytest.fixture(scope="module")
def world(spark):
    rng, rows = random.Random(7), []
    for i in range(240):
        t = ["mus", "spt"][i % 2]
        rows.append((i, f"https://h{i % 9}.example/{i}", "T", text(rng, TERMS[t]), "en", False, TERMS[t]))
    for i in range(240, 280):  # unfilled templates and keyword lists that mention a subject
        k = rng.choice(TERMS["mus"])
        body = " ".join(rng.choice([f"Dear {{{{ user.name }}}}, your {k} awaits.", f"Error 404: this {k} page does not exist.", f"Please enable JavaScript to see the {k}."]) for _ in range(6))
        rows.append((i, f"https://h{i % 9}.example/{i}", "T", body if i % 2 else ", ".join([k, k + " online", "best " + k] * 9), "en", False, None))
    rows += [(280, None, None, None, None, None, None), (281, None, None, "", "en", None, None), (None, None, None, text(rng, TERMS["mus"]), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    tax = spark.createDataFrame([("mus", "Music", 1, None, None), ("spt", "Sport", 1, None, None)], "id string, name string, tier int, parent string, aliases array<string>")
    rec = spark.createDataFrame([(i, [("mus" if i % 2 == 0 else "spt", "x", None, None, 0.9)]) for i in range(240)], "page_id long, topics array<struct<tier1_id:string,tier1_name:string,tier2_id:string,tier2_name:string,confidence:double>>")
    lab = spark.createDataFrame([(i, "mus" if i % 2 == 0 else "spt") for i in range(0, 240, 3)], "page_id long, topic string")
    return df, spark.createDataFrame([(241, True), (241, True), (None, True), (0, False)], "page_id long, soft_404 boolean"), spark.createDataFrame([], "page_id long, value string"), rec, lab, tax


def found(world):
    return {(r.page_id, r.topic) for r in pages.page_subjects(*world).collect()}


def test_subjects_learn_from_no_sample(world, monkeypatch):
    monkeypatch.setattr(counts, "SAMPLE_PAGES", 0)
    monkeypatch.setattr(counts, "SAMPLE_CHARS", 0)
    assert found(world) == {(i, ["mus", "spt"][i % 2]) for i in range(240)} | {(None, "mus")}


def test_shards_and_partitions_agree(world, monkeypatch):
    monkeypatch.setattr(pages, "SHARD_PAGES", 70)
    df, *others = world
    assert found(world) == found((df.repartition(7), *others)) == {(i, ["mus", "spt"][i % 2]) for i in range(240)} | {(None, "mus")}


def test_every_page_is_in_one_shard(world, monkeypatch):
    terms, seen = subjects.SubjectModel([]), []
    fits = {}
    for most in (1_000, 70):
        monkeypatch.setattr(pages, "SHARD_PAGES", most)
        m, read = pages.fit_whole(world[0], world[1], terms)
        fits[most] = m.residue.weights
        seen.append(read.count())
    assert seen == [283, 283]
    # what one shard learns about a frequent feature, the average of several says too
    heavy = np.argsort(-np.abs(fits[1_000]))[:100]
    assert (np.sign(fits[70][heavy]) == np.sign(fits[1_000][heavy])).mean() > 0.9


def batch(n=60):
    rng = random.Random(2)
    texts = [text(rng, TERMS["mus"], 5) if i % 3 else "violin, violin online, best violin, " * 9 if i % 2 else f"Dear {{{{ name }}}} {i}.\nError 404" for i in range(n)] + ["", None, "x"]
    return Batch(Vocabulary(), texts)


def test_counts_of_batches_add_up_to_the_whole():
    b = batch()
    model = stuffing.StuffingModel(function=frozenset(["the", "that", "was"]))
    lines = model.lines(b)
    bins, chars = lines.packed(b.n_pages)
    again = stuffing.Lines.unpacked(bins, chars)
    assert (again.bins == lines.bins).all() and (again.page == lines.page).all()
    assert np.allclose(model.packed_share(bins, chars), model.page_share(b))
    whole = stuffing.tally(model, lines, b.n_pages)
    parts = sum(stuffing.tally(model, stuffing.Lines.unpacked(bins[k : k + 7]), len(bins[k : k + 7])) for k in range(0, len(bins), 7))
    assert (whole == parts).all() and len(whole) == stuffing.CELLS
    assert whole[-stuffing.STATES * (stuffing.STATES + 1) :].sum() == lines.n


def test_packed_pages_score_as_their_batch():
    b, known = batch(), np.zeros(1 << residue.KNOWN_BITS, bool)
    known[::3] = True
    titles = [["Error 404", None, "T"][i % 3] for i in range(b.n_pages)]
    p = residue.Packed(*residue.packed(b, residue.Features(known)), [residue.title_class(t) for t in titles])
    for x, y in zip(p.features(), residue.Features(known)(b, titles)):
        assert (x == y).all()
    model = residue.ResidueModel(np.random.default_rng(1).normal(size=residue.SIZE + 32), 0.1, known)
    assert (model.packed_share(p) == model.page_share(b, titles)).all()


def test_weights_are_averaged_where_their_feature_occurs():
    size = residue.SIZE + 33
    g, gw = np.zeros(size), np.zeros(size)
    for w, g2 in ((2.0, 3.0), (4.0, 1.0)):  # two shards know feature 5, one of them feature 6
        g[5] += g2
        gw[5] += g2 * w
    g[6], gw[6], g[-1], gw[-1] = 2.0, 2.0 * -7.0, 4.0, 4.0 * 0.5
    m = residue.averaged(gw, g, np.ones(1 << residue.KNOWN_BITS, bool))
    assert (m.weights[5], m.weights[6], m.weights[7], m.bias) == (2.5, -7.0, 0.0, 0.5)
    assert residue.averaged(gw * 0, g * 0, m.known).bias == -1.0


def test_the_report_needs_no_sample(world, monkeypatch):
    def no_sample(*_):
        raise AssertionError("a sample is drawn")

    monkeypatch.setattr(counts, "hashed", no_sample)
    df, flags, langs, rec, lab, tax = world
    whole = [r for r in pages.subject_report(df, flags, langs, rec, lab, tax).collect() if r.topic is None]
    assert whole[0].labels > 10 and whole[0].f1 > 0.9
