"""Keyword-stuffed and link-list pages (problem 5).

Lines - sentences, lines, and pieces of at most ``WINDOW`` tokens of longer ones - are labelled prose,
stuffed, link list, tag list or menu by a hidden Markov model; a page is flagged when the lines that
are not prose hold more than half of its characters, navigation and footer aside.  Each line emits
five discrete features given its label: share of function words, sentence end, content words repeated
within the line, content words repeated over the page, and addresses or tag marks.  The parameters
start from the stated table and are learnt by Viterbi training on a bounded sample of pages, or on all by
counts that add up (``tally``, ``estimate``), in which the
table counts as ``PRIOR`` lines per label.

Function words are those that many pages of a declared language have (counts over all pages); no word
list is kept.  A feature that says nothing about a line is left out of it: function words where the page's
words are hardly known, sentence ends in scripts that have none.
"""

from __future__ import annotations

import numpy as np

from sievewright.llm.pagetext import IS_UNSPACED, IS_WIDE, Attributes, Batch, sums

PROSE, STUFFED, LINKS, TAGS, MENU = range(5)
WINDOW = 24
STATES = 5
#: Lines per label that the start table counts in training.
PRIOR = 5_000.0
#: Rounds of the training, and the share of the lines that the start table counts for at least where all pages train.
ROUNDS, PRIOR_SHARE = 4, 0.04
#: Share of a page's words that must be known for function words to say something.
LEGIBLE = 0.5

_SEP = set(",;|/·•»>–-—#")
WORD_, FUNCTION_, END_, MARK_, UNSPACED_, KNOWN_ = 1, 2, 8, 16, 32, 64


class Kinds:
    """The bits of a token, by the corpus' function words and known words."""

    def __init__(self, function: frozenset[str], known):
        self.function, self.known = function, known

    def __call__(self, t: str) -> int:
        if t in self.function:
            return WORD_ | FUNCTION_ | KNOWN_
        if t[0].isalpha() or IS_UNSPACED.match(t):
            unspaced = UNSPACED_ if IS_UNSPACED.match(t) else 0
            known = 0 if IS_WIDE.match(t) else KNOWN_ * self.known(t)
            return WORD_ | unspaced | known | (MARK_ if t in ("http", "https", "www") else 0)
        bits = 0
        if any(c in ".!?…。！？।" for c in t) and len(t) < 5:
            bits |= END_
        if t.startswith("#") or "://" in t or "»" in t or "@" in t:
            bits |= MARK_
        return bits


#: Upper bounds of the bins of each feature.
BINS = [np.array([0.04, 0.12, 0.24]), np.array([0.5]), np.array([0.12, 0.34]), np.array([0.03, 0.08, 0.16]), np.array([0.02, 0.12])]
#: Start values: P(bin | state) of the features, by state.
START = [
    [[0.04, 0.12, 0.30, 0.54], [0.15, 0.85], [0.80, 0.16, 0.04], [0.50, 0.34, 0.12, 0.04], [0.90, 0.08, 0.02]],  # prose
    [[0.10, 0.25, 0.35, 0.30], [0.15, 0.85], [0.10, 0.35, 0.55], [0.05, 0.15, 0.30, 0.50], [0.85, 0.10, 0.05]],  # stuffed
    [[0.86, 0.10, 0.03, 0.01], [0.90, 0.10], [0.60, 0.25, 0.15], [0.40, 0.30, 0.20, 0.10], [0.20, 0.30, 0.50]],  # link list
    [[0.70, 0.18, 0.08, 0.04], [0.96, 0.04], [0.40, 0.25, 0.35], [0.20, 0.25, 0.25, 0.30], [0.75, 0.15, 0.10]],  # tag list
    [[0.80, 0.12, 0.05, 0.03], [0.98, 0.02], [0.85, 0.10, 0.05], [0.60, 0.25, 0.10, 0.05], [0.90, 0.07, 0.03]],  # menu
]
INITIAL = [0.80, 0.04, 0.04, 0.06, 0.06]
STAY = 0.90
#: Bins of each feature, with the one that says nothing, and the counts that the parameters are estimated from.
RADIX = [len(edges) + 2 for edges in BINS]
CELLS = STATES * (sum(RADIX) + STATES + 1)


class Lines:
    """The lines of a batch with their features."""

    def __init__(self, b: Batch, kinds: Attributes):
        kind = kinds.over(b.vocab)[b.ids]
        n_tok = len(b.ids)
        token_seg = b.token_seg
        inside = np.arange(n_tok) - b.seg_start[:-1][token_seg] if n_tok else np.zeros(0, np.int64)
        # pieces of long segments, of equal size; segments without tokens are lines too
        pieces = np.maximum(1, -(-b.seg_len // WINDOW))
        first = np.concatenate([[0], np.cumsum(pieces)])
        size = -(-b.seg_len // pieces)
        line = first[:-1][token_seg] + inside // np.maximum(size[token_seg], 1)
        self.n = n = int(first[-1])
        self.seg = np.repeat(np.arange(len(pieces)), pieces)
        self.page = b.seg_page[self.seg] if n else np.zeros(0, np.int64)
        self.chars = (b.seg_chars / pieces)[self.seg] if n else np.zeros(0)
        word = (kind & WORD_) > 0
        content = word & ((kind & FUNCTION_) == 0)
        self.words = words = sums(word, line, n)
        stop = sums((kind & FUNCTION_) > 0, line, n) / np.maximum(words, 1)
        # pages whose words are known, and lines of scripts that end sentences with a blank
        at_page = b.seg_page[token_seg]
        legible = sums((kind & KNOWN_) > 0, at_page, b.n_pages) >= LEGIBLE * np.maximum(sums(word, at_page, b.n_pages), 1)
        unspaced = sums((kind & UNSPACED_) > 0, line, n) > 0.5 * np.maximum(words, 1)
        # does the segment end a sentence
        last = np.zeros(n)
        if n_tok:
            ends = (b.seg_start[1:] - 1)[b.seg_len > 0]
            last[first[1:][b.seg_len > 0] - 1] = (kind[ends] & END_) > 0
            last = last[first[1:] - 1][self.seg]
        # content words seen before in the same line, and over the page: by word and line, which has the pages in order
        n_content = sums(content, line, n)
        shift = max(1, n.bit_length())
        key = np.sort(b.ids[content] << shift | line[content])
        at = key & ((1 << shift) - 1)
        page, key_word = self.page[at], key >> shift
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        in_line = (n_content - np.bincount(at[new], minlength=n)) / np.maximum(n_content, 1)
        new[1:] = (key_word[1:] != key_word[:-1]) | (page[1:] != page[:-1])
        cnt = np.diff(np.append(np.flatnonzero(new), len(key)))
        per_page = np.bincount(page, minlength=b.n_pages)
        over_page = sums(np.repeat(cnt - 1, cnt), at, n) / (np.maximum(per_page[self.page], 16) * np.maximum(n_content, 1))
        marks = sums((kind & MARK_) > 0, line, n) / np.maximum(np.bincount(line, minlength=n), 1)
        values = [stop, last, in_line, over_page, marks]
        self.bins = np.stack([np.searchsorted(edges, v, side="right") for edges, v in zip(BINS, values)]) if n else np.zeros((5, 0), np.int64)
        if n:  # the bin behind the last one says nothing
            self.bins[0][~legible[self.page]] = len(BINS[0]) + 1
            self.bins[1][unspaced] = len(BINS[1]) + 1

    def packed(self, n_pages: int) -> tuple[list[bytes], list[bytes]]:
        """(bins, characters) of each page's lines as bytes."""
        code = np.zeros(self.n, np.uint16)
        for k, r in enumerate(RADIX):
            code = code * np.uint16(r) + self.bins[k].astype(np.uint16)
        cut = np.concatenate([[0], np.cumsum(np.bincount(self.page, minlength=n_pages))])
        chars = self.chars.astype(np.float32)
        return [code[a:b].tobytes() for a, b in zip(cut, cut[1:])], [chars[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    @classmethod
    def unpacked(cls, bins: list[bytes], chars: list[bytes] | None = None) -> Lines:
        """The lines of pages that ``packed`` gave; enough to label them."""
        self = cls.__new__(cls)
        code = np.frombuffer(b"".join(bins), np.uint16).astype(np.int64)
        self.n = len(code)
        self.page = np.repeat(np.arange(len(bins)), [len(x) // 2 for x in bins])
        self.chars = np.frombuffer(b"".join(chars), np.float32).astype(float) if chars is not None else None
        self.bins = np.zeros((len(RADIX), self.n), np.int64)
        for k in range(len(RADIX) - 1, -1, -1):
            code, self.bins[k] = np.divmod(code, RADIX[k])
        return self


class StuffingModel:
    """Parameters of the Markov model, and the labels of lines by it."""

    def __init__(self, emit=None, initial=None, trans=None, function: frozenset[str] = frozenset(), known: np.ndarray | None = None):
        self.emit = [np.array([s[k] for s in START]) for k in range(5)] if emit is None else emit
        self.initial = np.array(INITIAL) if initial is None else initial
        self.trans = np.full((STATES, STATES), (1 - STAY) / (STATES - 1)) + np.eye(STATES) * (STAY - (1 - STAY) / (STATES - 1)) if trans is None else trans
        self.function, self.known = function, known

    def __getstate__(self):
        known = None if self.known is None else np.packbits(self.known)
        return {"emit": self.emit, "initial": self.initial, "trans": self.trans, "function": self.function, "known": known}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.known is not None:
            self.known = np.unpackbits(self.known).astype(bool)

    def _is_known(self, word: str) -> bool:
        from sievewright.llm.residue import _hash

        return self.known is None or bool(self.known[_hash(word) & (len(self.known) - 1)])

    def lines(self, b: Batch) -> Lines:
        if not hasattr(self, "kinds"):
            self.kinds = Attributes(Kinds(self.function, self._is_known), np.uint8)
        return Lines(b, self.kinds)

    def emissions(self, lines: Lines) -> np.ndarray:
        """Log probability of each line's features by label."""
        return sum(np.concatenate([np.log(self.emit[k]).T, np.zeros((1, STATES))])[lines.bins[k]] for k in range(5))

    def label(self, lines: Lines, n_pages: int) -> np.ndarray:
        """Viterbi labels; all pages of the batch advance together, line by line."""
        if not lines.n:
            return np.zeros(0, np.int64)
        loge = self.emissions(lines)
        logt = np.log(self.trans)
        counts = np.bincount(lines.page, minlength=n_pages)
        start = np.concatenate([[0], np.cumsum(counts)])[:-1]
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        length = counts[order]
        delta = np.log(self.initial) + loge[start[order]]
        back = np.zeros((lines.n, STATES), np.int8)
        live = len(order)
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, side="left"))
            at = start[order[:live]] + t
            most, best = delta[:live, :1] + logt[0], np.zeros((live, STATES), np.int8)
            for k in range(1, STATES):  # the first of equal ones stays
                step = delta[:live, k : k + 1] + logt[k]
                best[step > most] = k
                np.maximum(most, step, out=most)
            back[at] = best
            delta[:live] = most + loge[at]
        out = np.zeros(lines.n, np.int64)
        state = delta.argmax(1)
        out[start[order] + length - 1] = state
        for t in range(int(length[0]) - 1, 0, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            at = start[order[:live]] + t
            state[:live] = back[at, out[at]]
            out[at - 1] = state[:live]
        return out

    def page_shares(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Share of each page's characters, and of its words, in lines that are not prose; 0 for pages
        without lines."""
        lines = self.lines(b)
        other = self.label(lines, b.n_pages) != PROSE
        share = lambda v: sums(v * other, lines.page, b.n_pages) / np.maximum(sums(v, lines.page, b.n_pages), 1e-9)
        return (share(lines.chars), share(lines.words)) if lines.n else (np.zeros(b.n_pages), np.zeros(b.n_pages))

    def page_share(self, b: Batch) -> np.ndarray:
        return self.page_shares(b)[0]

    def packed_share(self, bins: list[bytes], chars: list[bytes]) -> np.ndarray:
        """``page_share`` of pages given as packed lines."""
        lines, n = Lines.unpacked(bins, chars), len(bins)
        other = self.label(lines, n) != PROSE
        return sums(lines.chars * other, lines.page, n) / np.maximum(sums(lines.chars, lines.page, n), 1e-9) if lines.n else np.zeros(n)

    def likelihood(self, b: Batch) -> float:
        """Mean log likelihood of a line along the best path, in nats."""
        lines = self.lines(b)
        if not lines.n:
            return 0.0
        lab, loge = self.label(lines, b.n_pages), self.emissions(lines)
        same = lines.page[1:] == lines.page[:-1]
        first = np.concatenate([[True], ~same])
        total = loge[np.arange(lines.n), lab].sum() + np.log(self.trans[lab[:-1][same], lab[1:][same]]).sum() + np.log(self.initial[lab[first]]).sum()
        return float(total / lines.n)


def tally(model: StuffingModel, lines: Lines, n_pages: int) -> np.ndarray:
    """How often the labels by ``model`` meet each bin, follow each other and come first: the flat counts that
    ``estimate`` takes, which may be added up over batches of whole pages."""
    if not lines.n:
        return np.zeros(CELLS, np.int64)
    lab = model.label(lines, n_pages)
    same = lines.page[1:] == lines.page[:-1]
    first = np.concatenate([[True], ~same])
    seen = [np.bincount(lab * r + lines.bins[k], minlength=STATES * r) for k, r in enumerate(RADIX)]
    return np.concatenate([*seen, np.bincount(lab[:-1][same] * STATES + lab[1:][same], minlength=STATES**2), np.bincount(lab[first], minlength=STATES)])


def estimate(counts: np.ndarray, function: frozenset[str] = frozenset(), known: np.ndarray | None = None, prior: float = PRIOR) -> StuffingModel:
    """The model of these counts, with the start table as ``prior`` lines per label."""
    start, emit, at = StuffingModel(), [], 0
    for k, r in enumerate(RADIX):
        e = counts[at : at + STATES * r].reshape(STATES, r)[:, :-1] + prior * start.emit[k]
        emit.append(e / e.sum(1, keepdims=True))
        at += STATES * r
    t = prior * start.trans + counts[at : at + STATES**2].reshape(STATES, STATES)
    i = prior * start.initial + counts[at + STATES**2 :]
    return StuffingModel(emit, i / i.sum(), t / t.sum(1, keepdims=True), function, known)


def fit(b: Batch, function: frozenset[str] = frozenset(), known: np.ndarray | None = None, rounds: int = ROUNDS, prior: float = PRIOR) -> StuffingModel:
    """Viterbi training: label the sampled lines, re-estimate, with the start table as ``prior`` lines
    per label, so that labels that the sample hardly shows keep their meaning."""
    model = StuffingModel(function=function, known=known)
    lines = model.lines(b)
    if not lines.n:
        return model
    for _ in range(rounds):
        model = estimate(tally(model, lines, b.n_pages), function, known, prior)
    return model
