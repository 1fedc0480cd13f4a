import random
from collections import Counter

import numpy as np

from sievewright.llm import language

LETTERS = {"aa": "abcdefgh", "bb": "cdefghij", "cc": "hijklmno", "dd": "アイウエオカキクケコ"}


def sentences(rng, lang, n):
    vocab = ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(6, 14))) + "." for _ in range(n)]


def labelled():
    rng = random.Random(4)
    own = {k: sentences(rng, k, 80) for k in LETTERS}
    out = [(k, own[k][i : i + 4]) for k in own for i in range(0, 80, 4)]
    out += [("aa", own["bb"][:6]), ("bb", own["cc"][3:7]), ("ee", own["aa"][:2]), ("ff", [])]  # wrong labels, a rare one, an empty page
    rng.shuffle(out)
    return out


def brute(words, times, langs, rounds):
    keep = [True] * len(words)
    for _ in range(rounds):
        count, total = {k: Counter() for k in langs}, Counter()
        for ok, (lang, s, ws) in zip(keep, words):
            if ok and lang in count:
                total[lang] += times[lang, s]
                for w in ws:
                    count[lang][w] += times[lang, s]
        keep = []
        for lang, _, ws in words:
            score = Counter()
            for w in ws:
                rate = {k: count[k][w] / total[k] for k in langs if count[k][w]}
                for k, v in rate.items():
                    score[k] += v / sum(rate.values())
            keep.append(score[lang] > 0 and score[lang] >= 0.6 * len(ws) - 1e-9 and score[lang] >= max(score.values()) - 1e-9)
    return keep


def test_votes_equal_brute_force(monkeypatch):
    rows = [(lang, language.plain(s)) for lang, segs in labelled() for s in segs]
    times = Counter(rows)
    words = [(lang, s, language.units(s)) for lang, s in times] + [("aa", " ", set())]
    langs = sorted(LETTERS)
    want = brute(words, times, langs, 2)
    assert True in want and False in want
    for most in (10_000, 7):
        monkeypatch.setattr(language, "VOTE_ROWS", most)
        assert language._agreeing(words, times, langs, 2) == want
    assert language._agreeing([], Counter(), langs, 2) == [] and language._agreeing(words[:3], times, [], 2) == [False] * 3


def test_blocks_of_any_size_give_the_same(monkeypatch):
    model = language.fit(labelled())
    rng = random.Random(9)
    segs = [s for k in LETTERS for s in sentences(rng, k, 30)] + ["", "x", "é ü", "abc " * 300, "アイ" * 500, "1 2 3"]
    calls, block = [], language.LanguageModel._block
    monkeypatch.setattr(language.LanguageModel, "_block", lambda self, s: calls.append(sum(map(len, s))) or block(self, s))
    whole = model.phrases(segs)
    monkeypatch.setattr(language, "BLOCK_CHARS", 50)
    assert len(calls) == 1
    for a, b in zip(whole, model.phrases(segs)):
        assert (a == b).all()
    # a block is bounded, but for the segment that ends it: what it works on stays in the caches
    monkeypatch.undo()
    calls.clear()
    monkeypatch.setattr(language.LanguageModel, "_block", lambda self, s: calls.append(sum(map(len, s))) or (np.zeros((len(s), len(self.langs))), np.zeros(len(s), np.int64)))
    model.phrases(["a" * 100] * 9_000)
    assert max(calls) <= 300_000
