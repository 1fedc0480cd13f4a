"""Page texts as flat arrays: navigation and footers off, segments, tokens.

The page operators share this step.  A batch of texts becomes one array of token ids with segment and
page offsets, so that everything after the tokenising runs in numpy over a whole batch.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Navigation labels of the nine languages, and English ones.
NAV = """Home;About;About us;Contact;Archive;Search;Sign in;Log in;Login;Menu;Startseite;Über uns;Kontakt;Archiv;Suche;Anmelden;
Accueil;À propos;Archives;Recherche;Connexion;Inicio;Quiénes somos;Contacto;Archivo;Buscar;Acceder;Pagina iniziale;Chi siamo;Contatti;Archivio;Cerca;Accedi;
Voorpagina;Over ons;Archief;Zoeken;Inloggen;Início;Sobre nós;Contactos;Arquivo;Procurar;Entrar;Strona główna;O nas;Archiwum;Szukaj;Zaloguj;
Главная;О нас;Контакты;Архив;Поиск;Войти"""
_LABELS = sorted((x.strip() for x in NAV.replace("\n", "").split(";")), key=len, reverse=True)
_LABEL = "(?:" + "|".join(map(re.escape, _LABELS)) + ")"
_HEAD = re.compile(rf"\s*(?:{_LABEL}(?:\s*[|·>•/»«\-–—�?]\s*|\s+|$))+")
_YEAR = r"(?:19|20)\d\d"
_FOOT = re.compile(
    r"(?:^|\s)(?:"
    rf"(?:©|\(c\)|copyright\b)[^\n]{{0,80}}|[^\s|]{{1,40}} [·|�?] all rights reserved(?: {_YEAR})?|all rights reserved[^\n]{{0,40}}"
    r"|(?:(?:cookies|rss|imprint|privacy|terms|impressum)\s*[|·�?]\s*){1,3}[^\s|·]{1,40}|↑ top)\s*$",
    re.I,
)
#: What a footer line holds, for a quick look.
_FOOT_HINTS = ("©", "(c)", "copyright", "all rights", "cookies", "rss", "imprint", "privacy", "terms", "impressum", "↑")
#: Ends of segments; every one starts with a character of one class, so that a text is searched fast.
_END = re.compile(r"[.!?…。！？।\n\r](?:(?<=[.!?…])[\"”»’“)\]]*[ \t\xa0]+|(?<=[。！？।])[。！？।]*[」』”）]*|(?<=[\n\r])[\n\r]*)")
#: Scripts that put no blanks between words: their runs are taken in pieces, of two characters where a
#: character is a syllable or word, of four where it is a letter; a keyword that comes again gives the same pieces.
_SYLLABLES, _UNSPACED = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff", "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
#: Scripts whose words hold marks that are no letters by themselves.
_MARKED = "\u0900-\u0963\u0966-\u0dff"
_TOKEN = re.compile(rf"[{_MARKED}]+|[{_SYLLABLES}]{{1,2}}|[{_UNSPACED}]{{1,4}}|[^\W\d_{_SYLLABLES}{_UNSPACED}{_MARKED}]+|\d+|[^\w\s\x00{_UNSPACED}{_MARKED}]+|_+|\x00")
IS_UNSPACED = re.compile(f"[{_UNSPACED}]")
IS_WIDE = re.compile(f"[{_SYLLABLES}{_UNSPACED}]")


def body(text: str) -> str:
    """The text without the navigation labels it starts with and the footer line it ends with."""
    m = _HEAD.match(text)
    if m:
        text = text[m.end() :]
    tail = text[-140:].lower()
    if any(h in tail for h in _FOOT_HINTS):
        m = _FOOT.search(text, max(0, len(text) - 140))
        if m:
            text = text[: m.start()]
    m = _HEAD.fullmatch(text)
    return "" if m else text.strip()


def segments(text: str) -> list[str]:
    """Sentences and lines of a text, without navigation and footer."""
    text = body(text)
    out, at = [], 0
    for m in _END.finditer(text):
        s = text[at : m.end()].strip()
        if s:
            out.append(s)
        at = m.end()
    s = text[at:].strip()
    if s:
        out.append(s)
    return out


def numbered(texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """(what stands between ASCII blanks, each once; all of it in a row as indices of these; the text that each stands in)."""
    for blank in "\n\t\r":
        texts = pc.replace_substring(texts, blank, " ")
    parts = pc.split_pattern(texts, " ")
    each = parts.flatten().dictionary_encode()
    return each.dictionary.to_pylist(), each.indices.to_numpy().astype(np.int64), pc.list_parent_indices(parts).to_numpy().astype(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once; by a sort, which is much faster than np.unique."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Taken(dict):
    """word -> its number, taken apart once: f(word) -> numbers.  ``seen`` has the words by number."""

    def __init__(self, f):
        super().__init__()
        self.f, self.seen, self.new = f, [], []
        # the parts of all words in a row, and where those of each begin
        self.flat, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self.seen)
        self.seen.append(word)
        self.new.append(self.f(word))
        return i

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def parts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the parts of these words in a row, how many each has)."""
        if self.new:
            self.flat = np.concatenate([self.flat, np.array([i for x in self.new for i in x], np.int64)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in self.new])])
            self.new = []
        n = np.diff(self.start)[numbers]
        return self.flat[np.repeat(self.start[numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n


class Vocabulary(dict):
    """token -> id with attribute arrays; forgets everything when it grows past ``most`` tokens."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        self.reset()

    def reset(self):
        self.clear()
        self.tokens: list[str] = []
        self.words = Taken(lambda word: [self[t] for t in _TOKEN.findall(word)])
        self["\x00"]  # id 0 is no token of a text

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self.tokens)
        self.tokens.append(token)
        return i

    def trim(self):
        if len(self.tokens) > self.most or len(self.words) > self.most:
            self.reset()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the words, the text of each, token ids, tokens of each word) of lower-case texts; what stands between
        blanks is taken apart once."""
        try:
            words, at, text = numbered(pa.array(texts, pa.large_string()))
        except UnicodeEncodeError:  # half a pair of surrogates
            words, at, text = numbered(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()))
            words = [w.decode("utf-8", "surrogatepass") for w in words]
        words = self.words.numbers(words)[at]
        return words, text, *self.words.parts(words)


class Attributes:
    """An array over a vocabulary, extended as it grows: f(token) -> number."""

    def __init__(self, f, dtype):
        self.f, self.dtype, self.of, self.array = f, dtype, None, np.zeros(0, dtype)

    def over(self, vocab: Vocabulary) -> np.ndarray:
        return self._over(vocab.tokens)

    def over_words(self, vocab: Vocabulary) -> np.ndarray:
        """The same by the words that stand between blanks."""
        return self._over(vocab.words.seen)

    def _over(self, tokens: list[str]) -> np.ndarray:
        if self.of is not tokens:
            self.of, self.array = tokens, np.zeros(0, self.dtype)
        have = len(self.array)
        if have < len(tokens):
            new = np.fromiter((self.f(t) for t in tokens[have:]), self.dtype, len(tokens) - have)
            self.array = np.concatenate([self.array, new])
        return self.array


class Batch:
    """Texts as token ids.

    ids          token ids, without separators
    seg_start    first token of each segment (one more entry at the end)
    seg_chars    characters of each segment
    seg_page     index of the text of each segment
    flat         the segments
    words        numbers of the words, as they stand between blanks
    word_seg     segment of each word
    """

    def __init__(self, vocab: Vocabulary, texts: list[str | None], parts: list[list[str]] | None = None):
        vocab.trim()
        self.parts = [segments(t) if t else [] for t in texts] if parts is None else parts
        self.n_pages = len(self.parts)
        counts = np.fromiter(map(len, self.parts), np.int64, self.n_pages)
        self.flat = flat = [s for p in self.parts for s in p]
        self.seg_page = np.repeat(np.arange(self.n_pages), counts)
        self.seg_chars = np.fromiter(map(len, flat), np.int64, len(flat))
        self.words, self.word_seg, self.ids, n = vocab.encode([(x.replace("\x00", " ") if "\x00" in x else x).lower() for x in flat])
        self.seg_start = np.concatenate([[0], np.cumsum(sums(n, self.word_seg, len(flat)).astype(np.int64))])
        self.vocab = vocab

    @cached_property
    def seg_len(self) -> np.ndarray:
        return np.diff(self.seg_start)

    @cached_property
    def token_seg(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.seg_chars)), self.seg_len)

    def having(self, attribute: Attributes) -> np.ndarray:
        """Which segments have a word, as it stands between blanks, that the attribute holds for."""
        out = np.zeros(len(self.flat), bool)
        out[self.word_seg[attribute.over_words(self.vocab)[self.words]]] = True
        return out


def sums(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by index."""
    return np.bincount(index, weights=values, minlength=n)
