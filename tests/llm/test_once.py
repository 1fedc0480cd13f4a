"""What all pages pass through does its work once a word, and gives what a look at every page and sentence gives."""

import random

import numpy as np
import pyarrow as pa

from sievewright.llm import charset, residue, subjects
from sievewright.llm.pagetext import Attributes, Batch, Taken, Vocabulary, distinct, numbered, segments

ROWS = [("violin", "mus", 0.9), ("choir", "mus", 0.7), ("goal", "spt", 0.8), ("match", "spt", 0.6), ("judge", "law", 0.5), ("goal line", "law", 0.9), ("line\xa0out", "spt", 0.4), ("5g", "mus", 0.3)]
WORDS = ["violin", "Choir", "goal", "goals", "match", "judge", "line", "the", "a", "match-judge", "(goal)", "5G", "line\xa0out", "GOAL", "goal,", "own", "x\x00goal", "İ", "ΣΑΣ", "goal\tline", "", "violin/choir"]


def pages(n=300):
    rng = random.Random(4)
    return [[" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) or "x" for _ in range(rng.randint(0, 6))] for _ in range(n)]


def test_mentions_by_word_are_those_of_a_search():
    model, parts = subjects.SubjectModel(ROWS), pages()
    vocab, words = Vocabulary(), Attributes(model.word, np.int64)
    searched, found = [], model._found
    model._found = lambda s: searched.append(s) or found(s)
    got = [x for k in (0, 100, 200) for x in model.all_mentions(Batch(vocab, [None] * 100, parts[k : k + 100]), words)]
    n = len(searched)
    for p, (count, weight, total) in zip(parts, got):
        want = model.mentions(p)
        assert count == dict(want[0]) and np.isclose(total, want[2]) and weight.keys() == want[1].keys()
        assert all(np.isclose(weight[t], want[1][t]) for t in weight)
    assert 0 < n < sum(map(len, parts))
    none = subjects.SubjectModel([])
    assert none.all_mentions(Batch(vocab, [None], [["a goal"]]), Attributes(none.word, np.int64)) == [({}, {}, 0.0)]


def test_phrases_by_word_are_those_of_a_look():
    rng = random.Random(5)
    say = ["Error 404", "page not found", "{{ a.b }}", "Dear {{ name }},", "name: undefined", "a.b.c", "lorem ipsum dolor sit amet", "LOREM İPSUM DOLOR AMET ELİT", "the garden was green", "Please enable JavaScript", "x" * 170, "lorem ipsum dolor amet " * 9, "maintenance"]
    parts = [[rng.choice(say) for _ in range(rng.randint(0, 4))] for _ in range(200)]
    hints = Attributes(residue.phrase_hint, bool)
    b = Batch(Vocabulary(), [None] * len(parts), parts)
    assert residue.phrase_shares(b, hints) == [residue.phrase_share(p) for p in parts]
    assert 0 < b.having(hints).mean() < 1


def test_only_pages_with_a_suspect_are_examined():
    sound = ["für", "grün", "schön", "Käse", "Müller", "Straße"]
    model = charset.fit([("de", "Der Garten ist " + " ".join(sound))] * 5)
    texts = [None, "", "plain", "für &amp; grün", "schön\nKäse", "fÃ¼r grÃ¼n schÃ¶n", "caf�", "a\xa0für", "&#252;ber Stra&szlig;e", "f&Atilde;&frac14;r gr&Atilde;&frac14;n sch&Atilde;&para;n"]
    want = [model.examine(t) for t in texts]
    taken, examine = [], model.examine
    model.examine = lambda t: taken.append(t) or examine(t)
    assert model.examine_all(texts) == want and any(g for g, _ in want)
    assert not {None, "", "plain", "für &amp; grün", "schön\nKäse"} & set(taken)


def test_words_are_numbered_as_they_stand():
    each, at, text = numbered(pa.array(["a b\ta", None, "", "b\n\xa0c"]))
    assert [(each[k], t) for k, t in zip(at, text)] == [("a", 0), ("b", 0), ("a", 0), ("", 2), ("b", 3), ("\xa0c", 3)]
    taken = Taken(lambda w: [ord(c) for c in w])
    for words in (["ab", "", "c"], ["c", "ab", "d"]):
        flat, n = taken.parts(taken.numbers(words))
        assert flat.tolist() == [ord(c) for w in words for c in w] and n.tolist() == list(map(len, words))
    assert distinct(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3] and not len(distinct(np.zeros(0)))
    lone = Batch(Vocabulary(), ["a \ud800 b. c"])
    assert lone.vocab.tokens[lone.ids[0]] == "a" and len(lone.seg_chars) == len(segments("a \ud800 b. c"))


def test_calibration_takes_mentions_as_they_were_read(spark):
    from sievewright.llm import pages as p

    model = subjects.SubjectModel(ROWS)
    texts = {i: ["The violin and the choir. A judge.", "The goal of the match. A goal line.", "Nothing here."][i % 3] for i in range(60)}
    labels = spark.createDataFrame([(i, ["mus", "spt", "law"][i % 3]) for i in range(60)], "page_id long, topic string")
    rows = []
    for i, t in texts.items():
        n, w, total = model.mentions(segments(t))
        rows.append((i, len(segments(t)), list(n), list(n.values()), list(w.values()), total))
    read = spark.createDataFrame(rows, "page_id long, n_segs int, topics array<string>, mentions array<int>, weights array<double>, weight double")
    m = p.Models()
    m.charset = charset.CharsetModel({})
    whole = spark.createDataFrame(list(texts.items()), "page_id long, body_text string")
    tier1 = {"mus", "spt", "law"}
    want = p._cells(p._labelled(whole, labels), m, model, tier1)
    assert p._cells(p._labelled(read, labels), m, model, tier1) == want and any(v[0] for v in want[False].values())
