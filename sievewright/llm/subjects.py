"""Subject areas of page texts (problem 6): weighted terms, a multi-pattern automaton, thresholds.

The term list is a table (term, topic, weight).  Its draft is drawn from the corpus' own keywords: a
keyword names a subject when the pages that carry it are, by stored verdicts and hand labels together,
mostly of that subject - by a lower bound of the share, so that rare terms need agreement and a wrong
verdict does little.  Terms are weighted by their purity and rarity.  A curated table replaces the draft's
rows of its terms; a weight of 0 strikes a term out.

A page's score for a subject is the weight of its sentences that mention it; it counts by its share of
all sentences that mention any subject and by its density over the length of the page, in sentences.
Each subject has thresholds of its own, calibrated on all hand-labelled pages.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.pagetext import Attributes, Batch, distinct, sums

#: Least pages behind a term, lower bound of its share, and lead over the next subject.
LEAST_PAGES, LEAST_BOUND, LEAD, Z = 3, 0.3, 1.5, 1.64
#: One in so many labelled pages must carry a term: with keywords a page this bounds the list.
RARE_TERM = 100_000
#: Thresholds (sentences, share, density) where there are too few hand labels to calibrate, and labels needed.
DEFAULT, LEAST_LABELS = (2, 0.2, 0.0), 40
#: What calibration chooses from; the default first.
GRID = [(n, share, density) for n in (2, 1, 3) for share in (0.2, 0.1, 0.15, 0.25, 0.3, 0.35) for density in (0.0, 0.04, 0.08, 0.12)]
_ARTICLE = r"^(?:l|d|un|dell|all|nell|dall|sull)[’']"


def keyword(c):
    """One form of a keyword: lower case, single blanks, elided article off."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), _ARTICLE, "")


def subject_labels(records: DataFrame, labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(page_id, topic, hand) from verdicts and hand labels; names, tier-2 ids and aliases are resolved
    to tier-1 ids by the taxonomy, which is a small fixed table."""
    node = taxonomy.select(F.col("id"), F.when(F.col("tier") == 1, F.col("id")).otherwise(F.col("parent")).alias("topic"), "name", "aliases")
    names = node.select("topic", F.explode(F.array_union(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n"))
    names = names.select("topic", F.lower(F.trim("_n")).alias("_n")).where("_n IS NOT NULL AND topic IS NOT NULL").dropDuplicates(["_n"])
    said = records.select("page_id", F.explode("topics").alias("t")).select("page_id", F.explode(F.array("t.tier1_id", "t.tier1_name", "t.tier2_id")).alias("_n"))
    said = said.where("_n IS NOT NULL").select("page_id", F.lower(F.trim("_n")).alias("_n"), F.lit(False).alias("hand"))
    hand = labels.where("topic IS NOT NULL").select("page_id", F.lower(F.trim("topic")).alias("_n"), F.lit(True).alias("hand"))
    return said.unionByName(hand).join(names, "_n").groupBy("page_id", "topic").agg(F.max("hand").alias("hand"))


def terms(pages: DataFrame, said: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(term, topic, weight): aggregated over all pages; only label pairs meet keywords."""
    kw = pages.select("page_id", F.explode(F.array_distinct(F.transform("meta_keywords", keyword))).alias("term")).where("length(term) >= 2")
    topics = said.groupBy("page_id").agg(F.collect_set("topic").alias("_topics"))  # as many as subjects
    # one row per topic, and one under the empty topic for the page itself
    c = kw.join(topics, "page_id").select("term", F.explode(F.concat(F.array(F.lit("")), "_topics")).alias("topic")).groupBy("term", "topic").agg(F.count(F.lit(1)).alias("c"))
    least = F.greatest(F.lit(LEAST_PAGES), F.lit(topics.count() // RARE_TERM))
    own = F.col("topic") != ""
    b = c.groupBy("term").agg(F.max(F.when(~own, F.col("c"))).alias("n"), F.max(F.when(own, F.struct("c", "topic"))).alias("b"), F.array_sort(F.collect_list(F.when(own, F.col("c")))).alias("cs"))  # as many as subjects
    b = b.where((F.col("n") >= least) & F.col("b").isNotNull())
    b = b.select("term", "n", F.col("b.topic").alias("topic"), F.col("b.c").alias("c"), F.when(F.size("cs") > 1, F.element_at("cs", -2)).otherwise(0).alias("second"))
    p = F.col("c") / F.col("n")
    bound = (p + Z * Z / (2 * F.col("n")) - Z * F.sqrt(p * (1 - p) / F.col("n") + Z * Z / (4 * F.col("n") * F.col("n")))) / (1 + Z * Z / F.col("n"))
    draft = b.where((bound > LEAST_BOUND) & (F.col("c") > LEAD * F.col("second"))).select("term", "topic", (bound * (1 + 1 / F.log2(F.col("n") + 1))).alias("weight"))
    if curated is None:
        return draft
    own_terms = curated.select(keyword(F.col("term")).alias("term"), "topic", F.col("weight").cast("double").alias("weight"))
    return draft.join(own_terms.select("term"), "term", "left_anti").unionByName(own_terms.where("weight > 0"))


class SubjectModel:
    """Terms (term, subject, weight; the rarer the term, the heavier) and thresholds by subject; the
    automaton is built where it is used."""

    def __init__(self, rows: list[tuple[str, str, float]], thresholds: dict[str, tuple] | None = None, default: tuple = DEFAULT):
        self.rows, self.thresholds, self.default = rows, thresholds or {}, default

    def __getstate__(self):
        return {"rows": self.rows, "thresholds": self.thresholds, "default": self.default}

    def _build(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, topic, weight in self.rows:
            self.automaton.add_word(term, (len(term), topic, weight))
        if self.rows:
            self.automaton.make_automaton()
        self.topics = sorted({topic for _, topic, _ in self.rows})
        # the second words of terms of several by the first ones
        self.second: dict[str, set[str]] = {}
        for first, second in (term.split(" ")[:2] for term, _, _ in self.rows if " " in term):
            self.second.setdefault(first, set()).add(second)
        self.longest = max(map(len, self.second), default=-1)
        # (subject, weight, whether the term begins and ends its word) -> place, for ``word``
        self.hits = {(-2, 0.0, False, False): 0, (-1, 0.0, False, False): 1}

    def _hits(self, low: str):
        """(first character, last character, subject, weight) of the terms in a lower-case text, whole words only."""
        for end, (size, topic, w) in self.automaton.iter_long(low):
            begin = end - size + 1
            if (begin == 0 or not low[begin - 1].isalpha()) and (end + 1 == len(low) or not low[end + 1].isalpha()):
                yield begin, end, topic, w

    def _found(self, s: str) -> dict[str, float]:
        """The subjects that a sentence mentions, and their weights."""
        low = s.lower()
        hits: list[tuple[int, str, float]] = []
        for begin, end, topic, w in self._hits(low):
            if hits and begin == hits[-1][0] + 2 and low[begin - 1] == " " and hits[-1][1] != topic:
                hits.pop()
            hits.append((end, topic, w))
        found: dict[str, float] = {}
        for _, topic, w in hits:
            found[topic] = max(found.get(topic, 0.0), w)
        return found

    def word(self, word: str) -> int:
        """Of a lower-case word, as it stands between blanks: twice the place in ``hits`` of what it mentions alone (0
        nothing, 1 several things), and 1 where a term of several words may begin in it."""
        if not hasattr(self, "automaton"):
            self._build()
        n, found = len(word), list(self._hits(word)) if self.rows else []
        place = int(bool(found))
        if len(found) == 1:
            begin, end, topic, w = found[0]
            place = self.hits.setdefault((self.topics.index(topic), w, begin == 0, end + 1 == n), len(self.hits))
        return 2 * place + bool(self._firsts(word))

    def _firsts(self, word: str) -> list[str]:
        """The first words of terms of several that end this word."""
        return [x for k in range(max(0, len(word) - self.longest), len(word) + 1) if (x := word[k:]) in self.second]

    def _goes_on(self, word: str, after: str) -> bool:
        """May a term of several words stand in these two?"""
        return any(after.startswith(tuple(self.second[x])) for x in self._firsts(word))

    def all_mentions(self, b: Batch, words: Attributes) -> list[tuple[dict[str, int], dict[str, float], float]]:
        """``mentions`` of each page; ``words`` are by ``word``.  Only sentences are searched in which a term of several words
        may stand, or a word mentions several things."""
        if not hasattr(self, "automaton"):
            self._build()
        code = words.over_words(b.vocab)[b.words]
        # words are parted by one blank each, where no other character stands for one
        search = np.array([not s.isprintable() and any(c in s for c in "\x00\t\n\r") for s in b.flat], bool)
        at = np.flatnonzero(((code[:-1] & 1) > 0) & (b.word_seg[1:] == b.word_seg[:-1]))
        pair = b.words[at] << 32 | b.words[at + 1]
        pairs, seen = distinct(pair), b.vocab.words.seen
        goes = np.array([self._goes_on(seen[x >> 32], seen[x & 0xFFFFFFFF]) for x in pairs.tolist()], bool)
        search[b.word_seg[at[goes[np.searchsorted(pairs, pair)]]]] = True
        at = np.flatnonzero(code >= 2)
        seg, code = b.word_seg[at], code[at] // 2
        search[seg[code == 1]] = True
        keep = ~search[seg]
        at, seg, code = at[keep], seg[keep], code[keep]
        topic, weight, begins, closes = (np.array(x) for x in zip(*self.hits))
        topic, weight, begins, closes = topic[code], weight[code], begins[code], closes[code]
        keep = np.ones(len(at), bool)  # of two that stand next to each other the later counts
        keep[:-1] = ~((at[1:] == at[:-1] + 1) & (seg[1:] == seg[:-1]) & closes[:-1] & begins[1:] & (topic[1:] != topic[:-1]))
        more = [(i, self.topics.index(t), w) for i in np.flatnonzero(search).tolist() for t, w in self._found(b.flat[i]).items()] if self.rows else []
        seg, topic, weight = (np.concatenate([x[keep], np.array(y, x.dtype)]) for x, y in zip((seg, topic, weight), zip(*more) if more else [()] * 3))
        # the best term of each sentence and subject, and of each sentence
        size = max(1, len(self.topics))
        seg, topic, weight = _best(seg * size + topic, weight, size)
        seg_of, _, most = _best(seg, weight, 1)
        total = sums(most, b.seg_page[seg_of], b.n_pages).tolist()
        key = b.seg_page[seg] * size + topic
        which = distinct(key)
        at = np.searchsorted(which, key)
        count, weight = np.bincount(at, minlength=len(which)).tolist(), sums(weight, at, len(which)).tolist()
        cut = np.searchsorted(which, np.arange(b.n_pages + 1) * size).tolist()
        names = [self.topics[k] for k in (which % size).tolist()]
        return [(dict(zip(names[x:y], count[x:y])), dict(zip(names[x:y], weight[x:y])), t) for x, y, t in zip(cut, cut[1:], total)]

    def mentions(self, parts: list[str]) -> tuple[dict[str, int], dict[str, float], float]:
        """Sentences and their weight per subject, and the weight of all sentences that mention any.
        A sentence weighs its best term for the subject; whole words only, the longest term wins, and of
        two terms of different subjects that stand next to each other as one name the later counts (the
        head of a compound, or the modifier that tells a judge of a match from one of a court)."""
        if not hasattr(self, "automaton"):
            self._build()
        count, weight, total = defaultdict(int), defaultdict(float), 0.0
        for found in map(self._found, parts if self.rows else []):
            for topic, w in found.items():
                count[topic] += 1
                weight[topic] += w
            if found:
                total += max(found.values())
        return count, weight, total

    def subjects(self, parts: list[str]) -> dict[str, float]:
        """Subject -> share, for the subjects over their thresholds."""
        return self.judged(*self.mentions(parts), len(parts))

    def judged(self, count: dict[str, int], weight: dict[str, float], total: float, length: int) -> dict[str, float]:
        """``subjects`` of a page with these mentions and so many segments."""
        most = max(count.values(), default=0)
        return {t: weight[t] / total for t in count if total > 0 and over(count[t], weight[t], total, most, length, self.thresholds.get(t, self.default))}


def _best(key: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key // size, key % size, largest weight) of each key, in order."""
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(weight, first) if len(key) else weight
    return key[first] // size, key[first] % size, most


def over(count: int, weight: float, total: float, most: int, length: int, limits: tuple) -> bool:
    """Is a subject over its limits (sentences, share, density)?  Where no subject has so many sentences, the
    most that one has do."""
    return count >= min(limits[0], most) and weight >= limits[1] * total and weight >= limits[2] * length


def cells(model: SubjectModel, parts: list[str], truth: set[str]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(subject, cell of the grid) -> (right, wrong, missed) of one labelled page."""
    return mention_cells(*model.mentions(parts), len(parts), truth)


def mention_cells(count: dict[str, int], weight: dict[str, float], total: float, length: int, truth: set[str]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """``cells`` of a page with these mentions and so many segments."""
    most = max(count.values(), default=0)
    out = {}
    for t in set(count) | truth:
        n, w = count.get(t, 0), weight.get(t, 0.0)
        for k, limits in enumerate(GRID):
            got = n > 0 and over(n, w, total, most, length, limits)
            if got or t in truth:
                out[t, k] = (int(got and t in truth), int(got and t not in truth), int(not got))
    return out


def f1(right: int, wrong: int, missed: int) -> float:
    return 2 * right / max(1, 2 * right + wrong + missed)


def choose(model: SubjectModel, table: dict[tuple[str, int], tuple[int, int, int]]) -> SubjectModel:
    """The thresholds of the best F1 over all subjects together, and for a subject with enough labels others
    of its own where these make fewer errors than chance among so many errors would."""
    names = sorted({t for t, _ in table})
    labels = {t: sum(table.get((t, 0), (0, 0, 0))[i] for i in (0, 2)) for t in names}
    if sum(labels.values()) < LEAST_LABELS:
        return model
    pooled = [tuple(sum(table.get((t, k), (0, 0, 0))[i] for t in names) for i in range(3)) for k in range(len(GRID))]
    common = 0
    for k in range(1, len(GRID)):  # ties keep the earlier one
        if f1(*pooled[k]) > f1(*pooled[common]) + 0.002:
            common = k
    own = {}
    for t in names:
        cell = [table.get((t, k), (0, 0, 0)) for k in range(len(GRID))]
        errors = sum(cell[common][1:])
        good = [k for k in range(len(GRID)) if errors - sum(cell[k][1:]) > Z * errors**0.5]
        if labels[t] >= LEAST_LABELS and good:
            own[t] = GRID[max(good, key=lambda k: (f1(*cell[k]), -k))]
    return SubjectModel(model.rows, own, GRID[common])
