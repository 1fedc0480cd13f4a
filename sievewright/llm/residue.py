"""Template residue and error-page text (problem 1).

A regularised logistic classifier over hashed token n-grams, length and title features judges each
segment (sentence or line); a page is a case when more than half of its characters, navigation and
footer aside, lie in such segments.  It is fitted on a bounded sample of pages, or on all pages in shards
(``fit_shard``, ``averaged``), with weak labels: a
page is a positive example when phrases (unfilled slots, values never rendered, filler, server
messages, demands for scripts) cover most of it, a negative one when they cover little - so prose that
quotes such a phrase teaches the contrary.  A second round relabels with the first round's scores.
Response status is a label only where a table keeps error responses; extracted pages all answered
200, and the flags of an older run (soft_404, js_only) only weight doubtful pages.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

from sievewright.llm.counts import KNOWN_BITS
from sievewright.llm.pagetext import IS_WIDE, Attributes, Batch, Vocabulary, distinct, sums

BITS = 17
SIZE = 1 << BITS
#: Parameters of the fit: L2 penalty, rate and rounds of AdaGrad, most segments used.
L2, RATE, STEPS, MOST_SEGMENTS = 1e-6, 0.3, 50, 20_000
#: Where all pages train: segments behind one step, and how often each segment is used at least.
STEP_SEGMENTS, PASSES = 4_000, 4

#: Share of a page's characters in residue segments that makes it a case: the bar is a half, and the
#: classifier misses single segments of such pages far more often than it finds one too many.
CASE = 0.4

_SLOT = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|[$#]?\{[\w.|\- ]{1,40}\}|%%[\w.\- ]{1,40}%%|@@[\w.\- ]{1,40}@@|\$[A-Za-z][\w.]{1,40}\$|<!--.{0,60}?-->"
    r"|&lt;[\w.\- ]{1,40}&gt;|<[a-z_][\w.\-]{1,40}>|«[A-Za-z_][\w.\-]{1,40}»|\(\([\w.\- ]{1,40}\)\)|%[A-Za-z_][\w.\-]{1,40}%|\[\*?[\w.\- ]{1,40}\*?\]|__[\w.\-]{1,40}__|\[\[[\w.\- ]{1,40}\]\]"
)
_UNSET = re.compile(r"^[^:]{2,30} ?: (?:undefined|null|NaN|None|nil|#N/A|#REF!|\[object Object\]|Invalid Date|\(null\))\W*$")
#: How the values that _UNSET names begin, in small letters.
_VALUES = ("undefined", "null", "nan", "none", "nil", "#n/a", "#ref!", "[object", "invalid", "(null")
_KEY = re.compile(r"^\w+(?:[._]\w+){2,}$")
_LOREM = re.compile(r"\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|sed|tempor|vitae|sapien|mauris|nulla|quis|velit|augue|varius|felis|porta|ut|enim|magna|nunc|eget|purus)\b", re.I)
#: Phrases of filler, of error and maintenance pages, of demands for scripts, in nine languages.
_PHRASES = re.compile(
    "|".join(
        r"""dummy text|placeholder|filler text|blah blah|text text text|test 123|lorem ipsum
click to edit|sample paragraph|your own words|goes here|in this box|to be done|copy missing|to be supplied|(?:add|put|paste|upload|insert|type) (?:a|an|the|some|your) [\w ]{3,30}(?:here|later|\(max)|add a short description|words max|at most \d+ words|just some words
klicken sie, um|haga clic para|clique para editar|cliquez pour|fare clic per|clicca per|klik om|kliknij, aby|нажмите, чтобы
höchstens \d+ w|\d+ palabras como máx|\d+ mots au plus|no máximo \d+ palav|al massimo \d+ parole|hoogstens \d+ woorden|najwyżej \d+ s|не более \d+ слов
tekst zastępczy|tekst próbny|puste miejsce|пробный текст|занимает место|vult alleen|preenchimento|texto fictício|ocupa o lugar|occupa solo|testo di prova
spiacenti|non esiste più|désolé, |lo sentimos|lamentamos, |przepraszamy, |к сожалению, |helaas, |nie istnieje|bestaat niet|не существует
relleno número|sin sentido|texto verdadero|vrai paragraphe|texte de remplissage|riempitivo|opvultekst
n’a pas pu être|réessayez|no pudo (?:ser|cargarse)|pruebe otra vez|ha caducado|fue eliminado|non può essere caricat|riprov|kon niet worden|probeer het|não pôde ser|tente de novo|nie mogła zostać|spróbuj|повторите|konnte nicht geladen|versuchen sie es|could not be loaded|try again in
blindtext|platzhalter|hier steht|texto de relleno|faux texte|ajoutez ici|testo segnaposto|riempire lo spazio|voorbeeldtekst|opvultekst|texto de exemplo|przykładowy tekst|заполнитель|текст-рыба
page (?:could )?not (?:be )?found|nicht gefunden|page introuvable|no encontrada|non trovata|niet gevonden|não encontrada|nie znaleziono|не найдена
error \d{3}|fehler \d{3}|erreur \d{3}|errore \d{3}|erro \d{3}|fout \d{3}|błąd \d{3}|ошибка \d{3}|^(?:40\d|50\d)\b
bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|access denied|forbidden|connection timed out|connection refused|upstream connect
sqlstate|traceback \(most recent|exception in thread|nullpointerexception|fatal error|uncaught \w*error|undefined (?:array key|variable|index)|headers already sent|deprecated:|stack trace|database connection
no longer (?:available|exists)|does not exist|taken offline|your session|has been removed|abgelaufen|nicht mehr verfügbar|nicht vorhanden
n’est plus disponible|n’existe plus|ya no está disponible|non è più disponibile|è stato rimosso|niet meer beschikbaar|já não está disponível|nie jest już dostępn|больше не доступн|удалена|не найден
maintenance|wartung|mantenimiento|manutenzione|onderhoud|manutenção|konserwacj|технически
(?:enable|activate|switch on|turn on|allow) (?:javascript|js|scripts?|cookies|active)|javascript (?:aktivieren|im browser)|skripte im browser|activez javascript|active javascript|activar? javascript|attiva(?:re)? javascript|schakel javascript|włącz javascript|включите javascript
(?:scripts?|javascript|скрипт\w*) (?:puis|für|para|per|voor|in uw|aby|чтобы|zulassen|einschalten)|requires? javascript|besoin de scripts|precisa de scripts|necesita scripts|werkt niet zonder scripts|bisogno di script|wymaga skrypt|нужны скрипт
scripts are blocked|does not support scripts|keine skripte|checking your browser|scripting switched on
loading…|loading\.\.\.|bezig met laden|wird geladen|chargement|cargando|caricamento|carregando|a carregar|ładowanie|загрузка""".split("\n")
    ),
    re.I,
)


_LATIN = ["dolor", "amet", "sapien", "vitae", "tempor", "velit", "mauris", "augue", "felis", "porta"]
_MAY_HOLD_SLOT = re.compile(r"[{%@$<&\[_#«(]")


def _depths(pattern: str) -> list[int]:
    """How many groups are open behind each character; escaped characters open none."""
    out, depth, escaped = [], 0, False
    for c in pattern:
        if not escaped:
            depth += (c == "(") - (c == ")")
        escaped = c == "\\" and not escaped
        out.append(depth)
    return out


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, a group that one starts with taken apart."""
    depths, at, out = _depths(pattern), 0, []
    for i, (c, d) in enumerate(zip(pattern + "|", depths + [0])):
        if c == "|" and not d:
            out.append(pattern[at:i])
            at = i + 1
    parted = []
    for x in out:
        head = 1 if x.startswith("^") else 0
        end = next((i for i, d in enumerate(_depths(x)) if i > head and not d), len(x)) if x.startswith("(?:", head) else None
        if end is None or x[end + 1 : end + 2] == "?":
            parted.append(x)
        else:
            parted += [x[:head] + y + x[end + 1 :] for y in _alternatives(x[head + 3 : end])]
    return parted


def _literal(pattern: str) -> str:
    """The longest text that every match of the pattern holds."""
    from re import _parser

    runs = [""]
    for op, value in _parser.parse(pattern):
        if str(op) == "LITERAL":
            runs[-1] += chr(value)
        else:
            runs.append("")
    return max(runs, key=len)


class _Phrases:
    """The phrases behind an automaton of the texts that they must hold: few of them are tried on a segment."""

    def __init__(self):
        import ahocorasick

        by: dict[str, list[str]] = {}
        for x in _alternatives(_PHRASES.pattern):
            by.setdefault(_literal(x).strip(), []).append(x)
        self.always = [re.compile(x) for x in by.pop("", [])]
        self.automaton = ahocorasick.Automaton()
        for text, xs in by.items():
            self.automaton.add_word(text, re.compile("|".join(xs)))
        for text in _LATIN:
            if text not in by:
                self.automaton.add_word(text, None)
        self.automaton.make_automaton()
        # of each text the longest part without a blank: what a word must hold
        self.parts = ahocorasick.Automaton()
        for text in self.automaton.keys():
            self.parts.add_word(max(text.split(), key=len), True)
        self.parts.make_automaton()

    def part_in(self, word: str) -> bool:
        return next(self.parts.iter(word), None) is not None

    def __call__(self, s: str) -> tuple[bool, bool]:
        """(a phrase is there, a word of Latin filler may be)."""
        low, latin, tried = s.lower(), False, set()
        for _, p in self.automaton.iter(low):
            if p is None:
                latin = True
            elif p not in tried:
                tried.add(p)
                if p.search(low):
                    return True, True
        return any(p.search(low) for p in self.always), latin


_phrases: list[_Phrases] = []


def _look() -> _Phrases:
    if not _phrases:
        _phrases.append(_Phrases())
    return _phrases[0]


def _says(s: str, look: _Phrases) -> bool:
    """Do the phrases mark the segment?"""
    n = len(s)
    slots = sum(m.end() - m.start() for m in _SLOT.finditer(s)) if _MAY_HOLD_SLOT.search(s) else 0
    if slots * 4 > n or (":" in s and _UNSET.match(s)) or (" " not in s and _KEY.match(s)):
        return True
    said, latin = look(s) if n < 160 else (False, True)
    return said or (latin and len(_LOREM.findall(s)) >= 4)


def phrase_share(parts: list[str]) -> float:
    """Share of the characters in segments that the phrases mark: a weak label, never the result."""
    total = sum(map(len, parts))
    return sum(len(s) for s in parts if _says(s, _look())) / total if total else 0.0


def phrase_shares(b: Batch, hints: Attributes) -> list[float]:
    """``phrase_share`` of each page; only segments are looked at whose words (``hints``, of ``phrase_hint``) may say something."""
    look = _look()
    marked = [(may or look.always or " " not in s) and _says(s, look) for may, s in zip(b.having(hints).tolist(), b.flat)]
    return page_share(b, np.array(marked, bool)).tolist()


def phrase_hint(word: str) -> bool:
    """May a segment owe it to this lower-case word that ``_says`` marks it?"""
    # a capital I with a dot, which the patterns take for an i, has a mark of its own as a small letter
    return bool(_MAY_HOLD_SLOT.search(word) or word.startswith(_VALUES) or _look().part_in(word) or _LOREM.search(word) or "\u0307" in word)


def _hash(token: str) -> int:
    return zlib.crc32(b"0" if token.isdigit() else token.encode("utf-8", "replace"))


def _is_word(token: str) -> bool:
    """Words of scripts that part them by blanks; pieces of others are known or not by chance."""
    return token.isalpha() and not IS_WIDE.match(token)


class Features:
    """Hashed features of every segment of a batch, as flat arrays (feature, segment).

    ``known`` marks the hashes of the corpus' known words: keyboard filler consists of words that hardly
    any other page has."""

    def __init__(self, known: np.ndarray):
        self.hashes = Attributes(_hash, np.uint64)
        self.words = Attributes(_is_word, bool)
        self.known = known

    def taken(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each token, bin of each segment's share of unknown words)."""
        h = self.hashes.over(b.vocab)[b.ids]
        seg, n = b.token_seg, len(b.seg_chars)
        word = self.words.over(b.vocab)[b.ids]
        strange = word & ~self.known[(h & np.uint64((1 << KNOWN_BITS) - 1)).astype(np.int64)]
        share = sums(strange, seg, n) / np.maximum(sums(word, seg, n), 1)
        return h, np.searchsorted([0.25, 0.5, 0.85], share)

    def parts(self, b: Batch, titles: list[str | None]) -> tuple:
        classes = np.fromiter((title_class(t) for t in titles), np.int64, b.n_pages)[b.seg_page]
        return _parts(*self.taken(b), classes, b.token_seg, b.seg_chars)

    def __call__(self, b: Batch, titles: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _entries(*self.parts(b, titles))


def _parts(h, unknown, classes, seg, seg_chars) -> tuple:
    """(features of the tokens, their segments, features of the pairs, their segments, features of the segments; of these
    the last one counts fourfold)."""
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    same = seg[1:] == seg[:-1]
    two = ((h[:-1] * np.uint64(31) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F))[same] >> np.uint64(64 - BITS)
    length = np.minimum(15, np.log2(1 + seg_chars).astype(np.int64)) + SIZE
    # the unknown-word bin stands against many n-grams whose weights are chance there: it counts fourfold
    return one.view(np.int64), seg, two.view(np.int64), seg[1:][same], [length, classes + (SIZE + 16), unknown + (SIZE + 24)]


def _entries(one, seg_one, two, seg_two, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, segment) of every entry, and the value that a segment's features have."""
    n = len(own[0])
    feat = np.concatenate([one, two, *own, *own[2:] * 3])
    where = np.concatenate([seg_one, seg_two, *[np.arange(n)] * 6])
    return feat, where, 1.0 / np.sqrt(np.bincount(seg_one, minlength=n) + np.bincount(seg_two, minlength=n) + 6)


class Packed:
    """What the classifier takes of pages, as a batch without its words: hashes of the tokens, and of each
    segment its tokens, characters and bin of unknown words.  A page is two rows of bytes and the class of its title."""

    def __init__(self, tokens: list[bytes], segs: list[bytes], classes: list[int]):
        self.n_pages = len(segs)
        self.h = np.frombuffer(b"".join(tokens), np.uint32).astype(np.uint64)
        of = np.frombuffer(b"".join(segs), np.uint32).reshape(-1, 3).astype(np.int64)
        self.seg_len, self.seg_chars, self.unknown = of[:, 0], of[:, 1], of[:, 2]
        self.seg_page = np.repeat(np.arange(self.n_pages), [len(x) // 12 for x in segs])
        self.classes = np.array(classes, np.int64)[self.seg_page]

    def parts(self) -> tuple:
        return _parts(self.h, self.unknown, self.classes, np.repeat(np.arange(len(self.seg_len)), self.seg_len), self.seg_chars)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _entries(*self.parts())


def packed(b: Batch, features: Features) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each page that Packed takes."""
    h, unknown = features.taken(b)
    h, of = h.astype(np.uint32), np.stack([b.seg_len, b.seg_chars, unknown], 1).astype(np.uint32)
    seg_cut = np.concatenate([[0], np.cumsum(np.bincount(b.seg_page, minlength=b.n_pages))])
    cut = b.seg_start[seg_cut]
    return [h[x:y].tobytes() for x, y in zip(cut, cut[1:])], [of[x:y].tobytes() for x, y in zip(seg_cut, seg_cut[1:])]


_TITLE = re.compile(
    r"\b[45]\d\d\b|not found|nicht gefunden|introuvable|no encontrad|non trovat|niet gevonden|não encontrad|nie znalez|не найден|error|fehler|erreur|unavailable|maintenance|wartung|timed out",
    re.I,
)


def title_class(title: str | None) -> int:
    """0 no title, 1 unfilled slot, 2 words of an error page, 3 the like inside a longer title, 4 other."""
    if not title or not title.strip():
        return 0
    if _SLOT.search(title):
        return 1
    if _TITLE.search(title):
        return 2 if len(title) < 60 else 3
    return 4


class ResidueModel:
    """Weights, and the scores of pages by them."""

    def __init__(self, weights: np.ndarray, bias: float, known: np.ndarray | None = None):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.known = np.ones(1 << KNOWN_BITS, bool) if known is None else known

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": np.packbits(self.known)}

    def __setstate__(self, state):
        self.weights, self.bias, self.known = state["weights"], state["bias"], np.unpackbits(state["known"]).astype(bool)

    def page_share(self, b: Batch, titles: list[str | None]) -> np.ndarray:
        """Share of each page's characters in residue segments; 0 for pages without a segment."""
        if not hasattr(self, "features"):
            self.features = Features(self.known)
        n = len(b.seg_chars)
        if not n:
            return np.zeros(b.n_pages)
        return self._share(b, *self.features.parts(b, titles))

    def packed_share(self, p: Packed) -> np.ndarray:
        """``page_share`` of packed pages."""
        return self._share(p, *p.parts()) if len(p.seg_chars) else np.zeros(p.n_pages)

    def _share(self, b, one, seg_one, two, seg_two, own) -> np.ndarray:
        n, w = len(b.seg_chars), self.weights
        entries = np.bincount(seg_one, minlength=n) + np.bincount(seg_two, minlength=n) + 6
        score = sums(w[one], seg_one, n) + sums(w[two], seg_two, n) + w[own[0]] + w[own[1]] + 4 * w[own[2]]
        return page_share(b, score / np.sqrt(entries) + self.bias > 0)


def page_share(b: Batch | Packed, marked: np.ndarray) -> np.ndarray:
    chars = b.seg_chars.astype(float)
    total = sums(chars, b.seg_page, b.n_pages)
    return sums(chars * marked, b.seg_page, b.n_pages) / np.maximum(total, 1)


def _logistic(feat, where, scale, y, weight, n) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by full-batch AdaGrad, which lets rare n-grams learn as fast
    as frequent ones; features have the value ``scale`` of their segment."""
    size = SIZE + 32
    w, bias = np.zeros(size), 0.0
    g2, b2 = np.full(size, 1e-12), 1e-12
    order = np.argsort(where.astype(np.uint16) if n <= 1 << 16 else where, kind="stable")
    feat, where, sizes = feat[order], where[order], np.bincount(where, minlength=n)
    total = weight.sum()
    for _ in range(STEPS):
        z = sums(w[feat], where, n) * scale + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / total
        grad = np.bincount(feat, weights=np.repeat(g * scale, sizes), minlength=size) + L2 * w
        g2 += grad * grad
        w -= RATE * grad / np.sqrt(g2)
        b2 += g.sum() ** 2
        bias -= RATE * g.sum() / np.sqrt(b2)
    return w, bias


@dataclass
class Fitted:
    """Weights with the squared gradients behind each, by which the fits of several shards are averaged."""

    weights: np.ndarray
    bias: float
    g2: np.ndarray
    b2: float


def _adagrad(feat, size, start, scale, y, weight) -> Fitted:
    """``_logistic`` in steps of ``STEP_SEGMENTS`` segments; the features of segment i, of ``size`` in all, are
    feat[start[i] : start[i + 1]]."""
    n = len(scale)
    w, bias = np.zeros(size), 0.0
    g2, b2 = np.zeros(size), 0.0
    parts = -(-n // STEP_SEGMENTS)
    cuts = [n * k // parts for k in range(parts + 1)]
    entries, room = np.diff(start), np.empty(size)
    for step in range(max(STEPS, PASSES * parts)):
        a, b = cuts[step % parts], cuts[step % parts + 1]
        f, at = feat[start[a] : start[b]], start[a:b] - start[a]
        z = np.add.reduceat(w[f], at) * scale[a:b] + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) * weight[a:b] * (n / (b - a))
        grad = np.bincount(f, weights=np.repeat(g * scale[a:b], entries[a:b]), minlength=size)
        grad += np.multiply(w, L2, out=room)
        g2 += np.multiply(grad, grad, out=room)
        np.sqrt(np.add(g2, 1e-12, out=room), out=room)
        grad *= RATE
        w -= np.divide(grad, room, out=room)
        b2 += g.sum() ** 2
        bias -= RATE * g.sum() / np.sqrt(b2 + 1e-12)
    return Fitted(w, bias, g2, b2)


def _unknown_share(b: Batch, features: Features) -> np.ndarray:
    """Each page's share of words that are not known; 0 for pages of fewer than eight words, and of fewer than
    five unknown ones, whose share is at most a half."""
    strange = ~features.known[(features.hashes.over(b.vocab) & np.uint64((1 << KNOWN_BITS) - 1)).astype(np.int64)]
    word = features.words.over(b.vocab)[b.ids]
    page = b.seg_page[b.token_seg]
    word &= (np.bincount(page[word], weights=strange[b.ids[word]], minlength=b.n_pages) >= 5)[page]
    pair = distinct(b.ids[word] * np.int64(1 << 31) + page[word])
    ids, at = pair >> 31, pair & ((1 << 31) - 1)
    n = np.bincount(at, minlength=b.n_pages)
    return np.where(n >= 8, np.bincount(at, weights=strange[ids], minlength=b.n_pages) / np.maximum(n, 1), 0.0)


def mash(b: Batch, features: Features) -> np.ndarray:
    """Each page's share of unknown words; 0 where tags run together, which are words of their own too."""
    tags = np.array([sum(x.count("#") for x in p) * 12 > sum(map(len, p)) / 4 for p in b.parts], bool)
    return np.where(tags, 0.0, _unknown_share(b, features))


def _first_labels(share, mash, flagged, stuffed) -> np.ndarray:
    label = np.where((share > 0.5) | (mash > 0.6), 1, np.where((share < 0.2) & ~(flagged & (share > 0)), 0, -1))
    label[stuffed & (mash <= 0.6)] = 0
    return label


def _relabelled(got, share, mash, stuffed) -> np.ndarray:
    """The pages' labels by their phrases and the share ``got`` that a model marks."""
    label = np.where((share > 0.5) | (got > CASE), 1, np.where((got < 0.2) & (share <= 0.5), 0, -1))
    label[stuffed & (mash <= 0.6)] = 0
    return label


class _Training:
    """The sampled pages with their features and weak labels; fits the shipped model and the one that is
    validated by the same steps."""

    def __init__(self, pages: list[dict], known: np.ndarray, seed: int):
        self.seed, self.known = seed, known
        self.pages = pages = [p for p in pages if p["parts"]]
        flagged = np.array([bool(p.get("soft_404")) or bool(p.get("js_only")) for p in pages], bool)
        self.vocab = Vocabulary()
        self.titles = [p["title"] for p in pages]
        self.batch = Batch(self.vocab, [None] * len(pages), [p["parts"] for p in pages])
        self.share = share = np.array(phrase_shares(self.batch, Attributes(phrase_hint, bool)))
        self.stuffed = np.array([bool(p.get("stuffed")) for p in pages], bool) & (share < 0.1)
        features = Features(known)
        self.mash = mash(self.batch, features)
        self.label = _first_labels(share, self.mash, flagged, self.stuffed)
        self.features = features(self.batch, self.titles)
        self.held = np.array([zlib.crc32((p.get("host") or "").encode()) % 5 == 0 for p in pages], bool)

    def fit(self, use: np.ndarray) -> ResidueModel | None:
        """Three rounds on the pages marked in ``use``; each relabels by the scores of the one before.  The
        features of all pages are made once."""
        rng, label, model = np.random.default_rng(self.seed), self.label.copy(), None
        feat, where, scale = self.features
        page, n = self.batch.seg_page, len(self.batch.seg_chars)
        for _ in range(3):
            pos, neg = np.flatnonzero((label == 1) & use), np.flatnonzero((label == 0) & use)
            if not len(pos) or not len(neg):
                break
            # negatives: lists and stuffed pages all, prose as many as it takes
            chosen = np.zeros(len(self.pages), bool)
            chosen[pos] = chosen[neg[self.stuffed[neg]]] = True
            chosen[rng.permutation(neg[~self.stuffed[neg]])[: max(600, 3 * len(pos))]] = True
            y, keep = (label == 1)[page].astype(float), chosen[page]
            if keep.sum() > MOST_SEGMENTS:
                some = rng.permutation(np.flatnonzero(keep))[:MOST_SEGMENTS]
                keep = np.zeros(n, bool)
                keep[some] = True
            own, place = keep[where], np.cumsum(keep) - 1  # segments used, numbered through
            y = y[keep]
            weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
            model = ResidueModel(*_logistic(feat[own], place[where[own]], scale[keep], y, weight, len(y)), self.known)
            got = page_share(self.batch, sums(model.weights[feat], where, n) * scale + model.bias > 0)
            label = _relabelled(got, self.share, self.mash, self.stuffed)
        return model

    def validate(self) -> dict | None:
        """The same three rounds without the hosts held out, held against these hosts' weak labels at the
        threshold in use."""
        model, test = self.fit(~self.held), self.held & (self.label >= 0)
        if model is None or not test.any():
            return None
        hit, true = (model.page_share(self.batch, self.titles) > CASE)[test], (self.label == 1)[test]
        return {
            "pages": int(test.sum()), "positive": int(true.sum()), "accuracy": float((hit == true).mean()), "recall": float(hit[true].mean()) if true.any() else None,
            "precision": float(true[hit].mean()) if hit.any() else None, "threshold": CASE,
        }


def fit(pages: list[dict], known: np.ndarray, seed: int = 5, report: bool = False) -> tuple[ResidueModel, dict]:
    """Fit on sampled pages (dicts with parts, title, host, soft_404, js_only, stuffed) and the map of known
    words; with ``report`` also the model's agreement with the weak labels on hosts that it has not seen.

    Pages that the keyword-stuffing model claims (stuffed) and that hold no phrase are negative."""
    t = _Training(pages, known, seed)
    model = t.fit(np.ones(len(t.pages), bool)) or ResidueModel(np.zeros(SIZE + 32), -1.0, known)
    return model, {"pages": len(t.pages), "unseen_hosts": t.validate() if report else None}


def fit_shard(p: Packed, share: np.ndarray, mash: np.ndarray, flagged: np.ndarray, stuffed: np.ndarray, seed: int = 5) -> Fitted | None:
    """The three rounds of ``fit`` on every segment of every labelled page, none left out; None where one of the
    two labels is missing.  Of the pages: share of phrases, of unknown words, flags, and what the keyword-stuffing model claims."""
    rng, stuffed, fitted = np.random.default_rng(seed), stuffed & (share < 0.1), None
    label = _first_labels(share, mash, flagged, stuffed)
    feat, where, scale = p.features()
    n = len(scale)
    # segments in an order by chance, so that steps take one run of them after the other
    perm = rng.permutation(n)
    place = np.empty(n, np.uint16 if n <= 1 << 16 else np.int64)  # short numbers are sorted by their digits
    place[perm] = np.arange(n)
    feat = feat[np.argsort(place[where], kind="stable")]
    # the features that occur, numbered through; frequent ones first, which caches then hold
    often = np.bincount(feat, minlength=SIZE + 32)
    there = np.flatnonzero(often)
    there = there[np.argsort(-often[there], kind="stable")]
    number = np.zeros(SIZE + 32, np.int64)
    number[there] = np.arange(len(there))
    feat = number[feat]
    start = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n)[perm])])
    scale, page = scale[perm], p.seg_page[perm]
    for _ in range(3):
        y = label[page]
        pos, neg = int((y == 1).sum()), int((y == 0).sum())
        if not pos or not neg:
            break
        fitted = _adagrad(feat, len(there), start, scale, y == 1, np.where(y == 1, 0.5 / pos, np.where(y == 0, 0.5 / neg, 0.0)))
        marked = np.zeros(n, bool)
        marked[perm] = np.add.reduceat(fitted.weights[feat], start[:-1]) * scale + fitted.bias > 0
        label = _relabelled(page_share(p, marked), share, mash, stuffed)
    if fitted is None:
        return None
    weights, g2 = np.zeros(SIZE + 32), np.zeros(SIZE + 32)
    weights[there], g2[there] = fitted.weights, fitted.g2
    return Fitted(weights, fitted.bias, g2, fitted.b2)


def averaged(gw: np.ndarray, g: np.ndarray, known: np.ndarray) -> ResidueModel:
    """The model of all shards: sums of weights times squared gradients, and of squared gradients, the bias last.
    So a weight is the mean over the shards that have its feature, by how much they know of it."""
    if not g[-1] > 0:
        return ResidueModel(np.zeros(SIZE + 32), -1.0, known)
    w = np.where(g > 0, gw / np.where(g > 0, g, 1.0), 0.0)
    return ResidueModel(w[:-1], w[-1], known)
