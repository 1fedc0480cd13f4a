"""Language of documents and of segments of mixed ones (problem 2): cross-parsing entropy.

The labelled text of all languages goes into one suffix automaton whose states know, per language, how
long a suffix of the matched string occurs in that language's text - the same longest-match lengths
that one automaton per language would yield, for one pass over the characters.  A segment is parsed
from its end into the fewest phrases that occur in a language (longest matches are optimal there, as
every piece of a phrase is a phrase too); phrases per letter decide.  The margin between the best two
languages, times the root of the letters, is the evidence; how often it is right is learnt from labelled
sentences outside the automaton, which makes the confidence a probability.

Any number of languages, letters and scripts: frequent letters have complete transition tables, in which
all segments of a batch advance together in numpy, as many as fit into ``DENSE_CELLS``; the others are
looked up among the automaton's edges.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import regex

#: Characters of labelled text per language in the automaton.
TRAIN_CHARS = 18_000
#: Labelled sentences per language that training text is chosen from.
TRAIN_SENTENCES = 4_000
#: Longest sentence to train on; longer ones are hardly sentences, and links of the automaton would be as deep.
TRAIN_LONGEST = 400
#: Labelled sentences outside the automaton that the confidence is calibrated on, at most.
HELD_OUT = 3_000
#: Cells of the complete transition table of a worker (4 or 8 bytes each).
DENSE_CELLS = 30_000_000
#: Sentences whose votes are counted at once, and characters of segments that are parsed at once: what caches hold.
VOTE_ROWS, BLOCK_CHARS = 10_000, 200_000
#: Characters that a segment advances by at once.
PIECE = 200
#: A segment shorter than this many letters takes the language of its neighbours; letters of scripts
#: that write words or syllables with one count for WIDE.
LEAST_LETTERS, WIDE = 12, 4
#: Evidence from which a segment keeps its language against the page's and its neighbours'.
SURE = 0.647
#: Slope of the confidence where there is nothing to calibrate on.
SLOPE = 4.0
#: Segments of a language that make it a language of the page.
LEAST_SENTENCES = 3

_CLEAN = regex.compile(r"[^\p{L}\p{M}]+")
_FIRST_WIDE = chr(0x2E80)


def plain(s: str) -> str:
    """Lower-case letters and their marks, everything else one blank, a blank at both ends."""
    return " " + _CLEAN.sub(" ", s.lower()).strip() + " "


def units(s: str) -> set[str]:
    """What a plain sentence consists of: its words; of scripts that put no blanks between words, the
    pairs of characters."""
    out = set()
    for w in s.split():
        if w[0] >= "\u0e00":
            out.update(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        else:
            out.add(w)
    return out


class LanguageModel:
    """The automaton of the languages' training texts: states and edges as built here, the complete
    transition table as each worker expands it."""

    def __init__(self, texts: dict[str, list[str]]):
        self.texts = {k: texts[k] for k in sorted(texts)}
        self.langs = list(self.texts)
        self.slope = SLOPE
        self._build()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("langs", "code", "link", "length", "owner", "edges", "slope")}

    def _build(self):
        alphabet = Counter()
        for ss in self.texts.values():
            for s in ss:
                alphabet.update(s)
        # frequent letters first; 0 is a letter that no training text has
        self.code = {c: i + 1 for i, (c, _) in enumerate(sorted(alphabet.items(), key=lambda x: (-x[1], x[0])))}
        # suffix automaton of all sentences; every sentence restarts at the root
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        owner = [0]  # bit set of languages that end here, a number of any size
        for k, lang in enumerate(self.langs):
            bit = 1 << k
            for s in self.texts[lang]:
                last = 0
                for ch in s:
                    c = self.code[ch]
                    q = nxt[last].get(c)
                    if q is not None:
                        if length[q] == length[last] + 1:
                            last = q
                        else:
                            clone = len(nxt)
                            nxt.append(dict(nxt[q])); link.append(link[q]); length.append(length[last] + 1); owner.append(0)
                            p = last
                            while p != -1 and nxt[p].get(c) == q:
                                nxt[p][c] = clone
                                p = link[p]
                            link[q] = clone
                            last = clone
                    else:
                        cur = len(nxt)
                        nxt.append({}); link.append(0); length.append(length[last] + 1); owner.append(0)
                        p = last
                        while p != -1 and c not in nxt[p]:
                            nxt[p][c] = cur
                            p = link[p]
                        if p != -1:
                            q = nxt[p][c]
                            if length[q] == length[p] + 1:
                                link[cur] = q
                            else:
                                clone = len(nxt)
                                nxt.append(dict(nxt[q])); link.append(link[q]); length.append(length[p] + 1); owner.append(0)
                                while p != -1 and nxt[p].get(c) == q:
                                    nxt[p][c] = clone
                                    p = link[p]
                                link[q] = link[cur] = clone
                        last = cur
                    owner[last] |= bit
        n = len(nxt)
        order = sorted(range(n), key=length.__getitem__)
        for v in reversed(order[1:]):
            owner[link[v]] |= owner[v]
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        n_bytes = -(-max(1, len(self.langs)) // 8)
        self.owner = np.frombuffer(b"".join(v.to_bytes(n_bytes, "little") for v in owner), np.uint8).reshape(n, n_bytes)
        sizes = np.fromiter(map(len, nxt), np.int64, n)
        self.edges = (
            np.repeat(np.arange(n, dtype=np.int32), sizes),
            np.fromiter((c for e in nxt for c in e), np.int32, int(sizes.sum())),
            np.fromiter((t for e in nxt for t in e.values()), np.int32, int(sizes.sum())),
        )

    def _expand(self):
        link, length = self.link, self.length
        n, n_lang = len(link), len(self.langs)
        width = self.width = int(max(2, min(len(self.code) + 1, DENSE_CELLS // n)))  # codes below it are dense
        # a cell holds the next state and the match length that it leaves, ``own`` where the match grows by one;
        # in four bytes where these are few enough, which the caches like
        self.shift, kind = (12, np.uint32) if n < 1 << 20 and int(length.max(initial=0)) + 1 < 0xFFF else (16, np.int64)
        own = self.own = (1 << self.shift) - 1
        # depth in the tree of links; parents come before children
        level, up = np.zeros(n, np.int32), link.copy()
        while (up >= 0).any():
            level += up >= 0
            up = np.where(up >= 0, link[np.maximum(up, 0)], -1)
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(level.max() + 2))
        step = np.zeros((n, width), kind)
        best = np.zeros((n, n_lang), np.uint16)
        src, char, dst = self.edges
        rare = char >= width
        keys = src[rare].astype(np.int64) << 21 | char[rare]
        order = np.argsort(keys)
        self.rare_keys, self.rare_dst = keys[order], dst[rare][order]
        src, char, dst = src[~rare], char[~rare], dst[~rare]
        e_order = np.argsort(level[src], kind="stable")
        src, char, dst = src[e_order], char[e_order].astype(np.int64), dst[e_order]
        e_bounds = np.searchsorted(level[src], np.arange(level.max() + 2))
        bits = np.unpackbits(self.owner, axis=1, count=max(1, n_lang), bitorder="little")[:, :n_lang]
        for k in range(len(bounds) - 1):
            g, e = by_level[bounds[k] : bounds[k + 1]], slice(e_bounds[k], e_bounds[k + 1])
            if k:
                # what the link's state does, with the match length that the link leaves
                left = (length[link[g]] + 1).astype(np.uint16)[:, None]
                above = step[link[g]]
                grown = above & kind(own) == own
                step[g] = np.where(grown, above - kind(own) + left.astype(kind), above)
                above = best[link[g]]
                best[g] = np.where(bits[g] > 0, own, np.where(above == own, left - 1, above))
            step[src[e], char[e]] = dst[e].astype(kind) << kind(self.shift) | kind(own)
        self.step, self.best = step.ravel(), best
        blank = self.code.get(" ", 0)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.codes = np.full(0x110000, blank, np.int32)
        for m in regex.finditer(r"[\p{L}\p{M}]+", every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            self.codes[a:b] = 0
        self.codes[0xD800:0xE000] = blank
        for c, i in self.code.items():
            self.codes[ord(c)] = i

    def _rare(self, state: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step of letters without a table: the longest suffix of the match that the letter continues."""
        at, grown = state.copy(), np.zeros(len(state), bool)
        have = length.copy()
        new = np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            key = at[open_] << 21 | code[open_]
            i = np.minimum(np.searchsorted(self.rare_keys, key), max(0, len(self.rare_keys) - 1))
            hit = self.rare_keys[i] == key if len(self.rare_keys) else np.zeros(len(open_), bool)
            new[open_[hit]], grown[open_[hit]] = self.rare_dst[i[hit]], True
            open_ = open_[~hit]
            at[open_] = self.link[at[open_]]
            open_ = open_[at[open_] >= 0]
            have[open_] = np.minimum(have[open_], self.length[at[open_]])
        return new, np.where(grown, have + 1, 0)

    def phrases(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per language, letters) of each segment (without line ends)."""
        if not hasattr(self, "step"):
            self._expand()
        n, n_lang = len(segments), len(self.langs)
        out, letters = np.zeros((n, n_lang)), np.zeros(n, np.int64)
        done, total, k = 0, 0, 0
        for k, s in enumerate(segments):  # blocks of bounded size
            total += len(s)
            if total > BLOCK_CHARS:
                out[done : k + 1], letters[done : k + 1] = self._block(segments[done : k + 1])
                done, total = k + 1, 0
        if done < n:
            out[done:], letters[done:] = self._block(segments[done:])
        return out, letters

    def _block(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, n_lang = len(segs), len(self.langs)
        # letters as codes, everything else one blank, a blank at both ends of a segment
        chars = np.frombuffer(("\n" + "\n\n".join(segs) + "\n").lower().encode("utf-32-le", "replace"), np.uint32)
        raw = self.codes[chars]
        end = chars == 10
        blank = self.code.get(" ", 0)
        void = (raw == blank) & ~end
        follows = np.concatenate([[False], (raw[:-1] == blank)])
        before_end = np.concatenate([end[1:], [False]])
        keep = ~(void & (follows | before_end))
        codes, end = raw[keep].astype(np.int64), end[keep]
        at = np.flatnonzero(end)
        start, stop = at[0::2], at[1::2]
        sizes = stop - start + 1
        letters = np.add.reduceat((codes != blank).astype(np.int64), start) if n else np.zeros(0, np.int64)
        has_rare = int(codes.max(initial=0)) >= self.width
        # long segments advance in pieces; a cut costs one phrase in every language alike
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = start[owner] + nth * sizes[owner] // pieces[owner]
        sizes = start[owner] + (nth + 1) * sizes[owner] // pieces[owner] - lo
        order = np.argsort(-sizes, kind="stable")
        owner, start, sizes = owner[order], lo[order], sizes[order]
        n_seg, n = n, len(order)
        longest = int(sizes[0]) if n else 0
        state, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        states, lengths = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.uint16)
        live, shift, own = n, self.step.dtype.type(self.shift), self.step.dtype.type(self.own)
        for t in range(longest):
            live = int(np.searchsorted(-sizes[:live], -t, side="left"))
            at = start[:live] + t
            code = codes[at]
            dense = np.minimum(code, self.width - 1) if has_rare else code
            step = self.step[state[:live] * self.width + dense]
            # ``own`` is more than any length
            new, size = (step >> shift).astype(np.int64), np.minimum((step & own).astype(np.int64), length[:live] + 1)
            if has_rare and len(r := np.flatnonzero(code >= self.width)):
                new[r], size[r] = self._rare(state[r], length[r], code[r])
            state[:live], length[:live] = new, size
            states[at], lengths[at] = new, size
        match = np.minimum(self.best[states], lengths[:, None])
        np.maximum(match, 1, out=match)
        # parse from the end: the longest match that ends here, then the one that ends before it
        count = np.zeros(n * n_lang, np.int64)
        flat = match.ravel()
        idx, lang = np.arange(n * n_lang), np.tile(np.arange(n_lang), n)
        first = np.repeat(start, n_lang) * n_lang + lang
        pos = np.repeat(start + sizes - 1, n_lang) * n_lang + lang  # in ``flat``
        phrases = 0
        while len(idx):
            phrases += 1
            pos = pos - flat[pos].astype(np.int64) * n_lang
            more = pos >= first
            count[idx[~more]] = phrases
            idx, pos, first = idx[more], pos[more], first[more]
        count = count.reshape(n, n_lang)
        return np.stack([np.bincount(owner, weights=count[:, k], minlength=n_seg) for k in range(n_lang)], 1), letters

    def evidence(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index or -1, evidence, letters) of each segment."""
        if not segments or not self.langs:
            return np.full(len(segments), -1), np.zeros(len(segments)), np.zeros(len(segments), np.int64)
        once: dict[str, int] = {}
        where = np.fromiter((once.setdefault(s, len(once)) for s in segments), np.int64, len(segments))
        ph, letters = self.phrases(list(once))
        ph, letters = ph[where], letters[where]
        rate = ph / np.maximum(letters, 1)[:, None]
        best = rate.argmin(1)
        top = rate[np.arange(len(rate)), best]
        rate[np.arange(len(rate)), best] = np.inf
        margin = (rate.min(1) - top) if len(self.langs) > 1 else np.ones(len(top))
        margin = np.where(np.isfinite(margin), margin, 1.0)
        return np.where(letters >= 1, best, -1), margin * np.sqrt(np.maximum(letters, 1)), letters

    def confidence(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.minimum(evidence * self.slope, 50.0)))

    def classify(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index or -1, confidence, letters) of each segment."""
        lang, evidence, letters = self.evidence(segments)
        return lang, self.confidence(evidence), letters

    def calibrate(self, sentences: list[tuple[str, str]]) -> dict:
        """The slope that makes labelled sentences most likely; returns what the confidence says and what
        is true.  Half of the sentences are cut to two or three words, as short segments are where it errs."""
        rng = random.Random(11)
        cases = [(k, " ".join(w[: rng.randint(2, 3)]) if i % 2 and len(w := s.split()) > 3 else s) for i, (k, s) in enumerate(sentences) if k in self.texts]
        if len(cases) < 50:
            return {"sentences": len(cases)}
        got, x, _ = self.evidence([s for _, s in cases])
        right = np.array([self.langs[g] == k if g >= 0 else False for g, (k, _) in zip(got, cases)])
        grid = np.geomspace(0.5, 40.0, 80)
        cost = [np.where(right, np.logaddexp(0, -g * x), np.logaddexp(0, g * x)).sum() for g in grid]
        self.slope = float(grid[int(np.argmin(cost))])
        return {"sentences": len(cases), "accuracy": float(right.mean()), "mean_confidence": float(self.confidence(x).mean()), "slope": self.slope}


def _agreeing(words: list[tuple[str, str, set[str]]], times: Counter, langs: list[str], rounds: int) -> list[bool]:
    """Which of the (label, sentence, units) a word-count classifier agrees with, refitted on what it keeps: every
    unit has one vote, shared among the languages by how often these have it."""
    n_lang, number = len(langs), {}
    code = {k: i for i, k in enumerate(langs)}
    label = np.array([code.get(lang, -1) for lang, _, _ in words], np.int64)
    often = np.array([times[lang, s] for lang, s, _ in words], float)
    sizes = np.array([len(ws) for _, _, ws in words], np.int64)
    unit = np.array([number.setdefault(w, len(number)) for _, _, ws in words for w in ws], np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    # the pairs of a unit and a language that labels it, in the order of units
    labelled = label[row] >= 0
    pairs, pair = np.unique(unit[labelled] * max(1, n_lang) + label[row[labelled]], return_inverse=True)
    of, lang = pairs // max(1, n_lang), pairs % max(1, n_lang)
    begin = np.searchsorted(of, np.arange(len(number) + 1))
    keep = np.ones(len(words), bool)
    for _ in range(rounds):
        weight = often * keep
        total = np.bincount(label[label >= 0], weights=weight[label >= 0], minlength=n_lang)
        rate = np.bincount(pair, weights=weight[row[labelled]], minlength=len(pairs)) / np.maximum(total, 1)[lang]
        votes = rate / np.maximum(np.bincount(of, weights=rate, minlength=len(number)), 1e-300)[of]
        keep = np.zeros(len(words), bool)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for a in range(0, len(words), VOTE_ROWS):
            b = min(a + VOTE_ROWS, len(words))
            u = unit[ends[a] : ends[b]]
            n = begin[u + 1] - begin[u]
            at = np.repeat(begin[u] - np.cumsum(n) + n, n) + np.arange(n.sum())
            score = np.bincount(np.repeat(row[ends[a] : ends[b]] - a, n) * n_lang + lang[at], weights=votes[at], minlength=(b - a) * n_lang).reshape(b - a, n_lang)
            if n_lang:
                own = np.where(label[a:b] >= 0, score[np.arange(b - a), label[a:b]], 0.0)
                keep[a:b] = (own > 0) & (own >= 0.6 * sizes[a:b]) & (own == score.max(1))
    return keep.tolist()


def fit(pages: list[tuple[str, list[str]]], rounds: int = 2) -> LanguageModel:
    """A model from sampled (label, segments).  Labels are often wrong, so sentences are kept only where
    a word-count classifier, refitted on what it keeps, agrees with the label."""
    rows, have = [], Counter()
    for lang, segs in pages:
        if have[lang] < TRAIN_SENTENCES:
            new = [(lang, plain(s)) for s in segs if (25 if s[0] < "\u2e80" else 8) <= len(s) <= TRAIN_LONGEST]
            rows += new
            have[lang] += len(new)
    times = Counter(rows)
    words = [(lang, s, units(s)) for lang, s in times]
    langs = [k for k, v in Counter(r[0] for r in rows).items() if v >= 5]
    keep = _agreeing(words, times, langs, rounds)
    texts: dict[str, list[str]] = {}
    size, seen, taken = Counter(), set(), set()
    for new in (2, 1, 0):  # sentences with new words first, for a broad vocabulary
        for i, (ok, (lang, s, ws)) in enumerate(zip(keep, words)):
            if ok and lang in langs and i not in taken and size[lang] < TRAIN_CHARS:
                fresh = {(lang, w) for w in ws} - seen
                if len(fresh) >= new:
                    texts.setdefault(lang, []).append(s)
                    size[lang] += len(s)
                    seen |= fresh
                    taken.add(i)
    model = LanguageModel(texts)
    rest = sorted((lang, s) for i, (ok, (lang, s, _)) in enumerate(zip(keep, words)) if ok and lang in langs and i not in taken)
    model.report = model.calibrate(random.Random(3).sample(rest, min(HELD_OUT, len(rest))))
    return model


def page_languages(model: LanguageModel, parts: list[list[str]]) -> list[dict]:
    """For each page: its main language, sentences per language, and the segments' languages with
    confidence (index arrays).

    A segment of few letters, or one that hardly prefers a language, goes with its neighbours."""
    segs = [s for p in parts for s in p]
    lang, evidence, letters = model.evidence(segs)
    conf = model.confidence(evidence)
    strong = letters >= LEAST_LETTERS
    for k in np.flatnonzero(~strong & (letters > 0)):
        wide = sum(c >= _FIRST_WIDE and c.isalpha() for c in segs[k])
        strong[k] = letters[k] + (WIDE - 1) * wide >= LEAST_LETTERS
    sure = strong & (evidence >= SURE)
    names = model.langs
    out, at = [], 0
    for p in parts:
        n = len(p)
        ls = lang[at : at + n].tolist()
        if not n or not names or max(ls) < 0:
            out.append({"main": None, "counts": {}, "langs": [-1] * n, "conf": conf[at : at + n]})
            at += n
            continue
        if min(ls) == max(ls):
            main = ls[0]
            out.append({"main": names[main], "counts": {names[main]: int(strong[at : at + n].sum())}, "langs": ls, "conf": conf[at : at + n]})
            at += n
            continue
        known = lang[at : at + n] >= 0
        main = int(np.bincount(lang[at : at + n][known], weights=letters[at : at + n][known]).argmax())
        st, su = strong[at : at + n].tolist(), sure[at : at + n].tolist()
        for i in range(n):
            if ls[i] >= 0 and ls[i] != main and not su[i]:
                beside = [j for j in (i - 1, i + 1) if 0 <= j < n and su[j]]
                if not (st[i] and any(ls[j] == ls[i] for j in beside)):
                    ls[i] = ls[beside[0]] if beside and not st[i] else main
        counts = Counter(names[k] for k, s in zip(ls, st) if k >= 0 and s)
        out.append({"main": names[main], "counts": counts, "langs": ls, "conf": conf[at : at + n]})
        at += n
    return out
