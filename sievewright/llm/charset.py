"""Garbled text from wrong character encodings (problem 4).

Only tokens with characters beyond ASCII can differ between decodings, so the description of a page is
its list of such tokens.  Every candidate decoding - chains of (read as W, was R) steps, up to three
deep - is compressed with zstandard under each language's dictionary; the chain with the least length,
its own cost included, wins, and the text stays as it is unless a chain beats it.  Pages whose tokens
all stand in the dictionaries need no compression: nothing could describe them shorter.

Tokens that carry U+FFFD have lost bytes; they are garbled and stay as they are.
"""

from __future__ import annotations

import codecs
import html
import re
from collections import Counter
from unicodedata import category

import numpy as np
import pyarrow as pa
import zstandard

from sievewright.llm.pagetext import distinct, numbered

#: Codecs a page may have been read in, and codecs it may have been written in.
READ = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_15", "iso8859_5", "cp1254", "iso8859_7", "cp1253"]
WRITTEN = ["cp1252", "iso8859_2", "cp1250", "cp1251", "koi8_r", "cp866", "mac_roman", "cp850", "cp437", "iso8859_5"]
#: Cost in bytes of one step of a chain, by what it claims.
UTF8_COST, SINGLE_COST = 0.8, 2
UTF8_CHANCE = 0.9
#: A single-byte step holds for all tokens that its codec can have shown; one that it cannot explain has
#: to be said apart.
EXCEPT_COST = 2
#: A single-byte step that yields no known token has only the letters to speak for it.
UNSEEN_COST = 4
#: Among chains that describe a page shorter than its text, a known token is worth so many bytes.
HIT = 0.5
#: Least description of a token.
TOKEN_BYTES = 1
#: Steps of a chain, tokens a dictionary holds, its bytes.
DEPTH, DICT_TOKENS, DICT_BYTES = 3, 6000, 1 << 16
LEVEL = 6
#: Letters that the first step of a two-step chain may leave.
INNER = "ÃÂâäåÅÄãÐÑðñŠšŽžŸÿƒˆ˜"
#: A token on this share of a language's pages is sound.
COMMON = 0.06

_BLANKS = str.maketrans("\t\n\r", "   ")
_INSIDE = re.compile(r"[^\W\d_][“”„«»—–…°•][^\W\d_]|^[”»…][^\W\d_]|[“„«]$|[“”„]{2}")
_FROM_ODD = re.compile(r"[^\x00-\x7f][^ ]*")
_RUN = re.compile(r"[^ \t\n\r]+")
_ENTITY = re.compile(r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d{0,2});")
_ASCII_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SOFT_EDGE = _ASCII_EDGE + "“”„«»‘’‹›…–—¿¡"
#: Typographic marks count one byte in a description, as ASCII marks do.
_SHORT = str.maketrans({c: chr(14 + i) for i, c in enumerate("“”„‘’–—…«»·•©®°£€§")})
_QUOTED = re.compile(r"[“„«\"‘'(]\s?([^\sA-Za-z]{1,5})\s?[”“»\"’')]")


def _to_bytes(codec: str) -> dict:
    """translate() table: characters of the codec to U+0000-00FF, all others beyond ASCII to U+FFFF."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)  # undefined bytes pass as C1 controls, as browsers read them
        table.setdefault(ord(c), b)
    for b in range(128, 256):
        table.setdefault(b, b if b < 160 else 0xFFFF)
    # a replacement character stands for the one byte that the codec does not know
    void = [b for b in range(256) if not _knows(codec, b)]
    if len(void) == 1:
        table[0xFFFD] = void[0]
    return table


def _knows(codec: str, b: int) -> bool:
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


class _Table(dict):
    """A translate() table that holds all it was asked for."""

    def __init__(self, items=()):
        super().__init__(enumerate(range(128)))
        self.update(items)

    def __missing__(self, key):
        self[key] = 0xFFFF
        return 0xFFFF


_BYTES = {c: _Table(_to_bytes(c)) for c in READ}
#: Characters beyond ASCII that each codec can have been read as.
_SHOWN = {c: frozenset(chr(k) for k, b in t.items() if k > 127 and b != 0xFFFF) for c, t in _BYTES.items()}


def _pairs() -> dict[tuple[str, str], _Table]:
    out = {}
    for w in READ:
        for r in WRITTEN:
            t = _Table()
            for char, b in _BYTES[w].items():
                if b > 127 and b != 0xFFFF:
                    try:
                        t[char] = bytes([b]).decode(r)
                    except UnicodeDecodeError:
                        t[char] = 0xFFFF
            if any(v != chr(k) for k, v in t.items()):
                out[w, r] = t
    return out


_PAIRS = _pairs()
#: The same for tokens without control and replacement characters, by the codecs' own fast routines: characters
#: to bytes, and bytes to characters, U+FFFF where a codec has none.
_ENCODE = {w: codecs.charmap_build("".join(bytes([b]).decode(w) if _knows(w, b) else chr(b) for b in range(256))) for w in READ}
_DECODE = {r: "".join(bytes([b]).decode(r) if _knows(r, b) else "\uffff" for b in range(256)) for r in WRITTEN}
_UNUSUAL = re.compile(r"[\x80-\x9f\ufffd]")
CHAINS = [(w, "utf_8") for w in READ] + list(_PAIRS)
#: Steps to try, and whether a step is repeated while it can be.
_TRIALS = [(s, deep) for s in CHAINS[: len(READ)] for deep in (False, True)] + [(s, False) for s in CHAINS[len(READ) :]]
_BY_READ = {w: [(k, s, deep) for k, (s, deep) in enumerate(_TRIALS) if s[0] == w] for w in READ}


def undo(token: str, step: tuple[str, str]) -> str | None:
    """The token as it was before being read as step[0] while written in step[1]; None if impossible."""
    w, r = step
    if r == "utf_8":
        try:
            out = token.translate(_BYTES[w]).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return None
    else:
        out = token.translate(_PAIRS[step])
        if "\uffff" in out:
            return None
    return out if out != token else None


def decode_entities(text: str) -> str:
    """Character references as characters; correct ones read as any other text, and a garbled text that
    was escaped afterwards shows its sequences."""
    return _ENTITY.sub(lambda m: html.unescape(m.group()), text) if "&" in text else text


def words(text: str) -> set[str]:
    """What stands between blanks and has a character beyond ASCII.  Blanks are the ASCII ones only:
    others may be bytes of a garbled character."""
    if "\n" in text or "\t" in text or "\r" in text:
        text = text.translate(_BLANKS) if "\t" in text or "\r" in text else text.replace("\n", " ")
    back = text.rfind
    return {text[back(" ", 0, m.start()) + 1 : m.end()] for m in _FROM_ODD.finditer(text)}


def token(word: str) -> str:
    """The word without punctuation at its edges; quotes and dashes are edges only of what is
    otherwise a word."""
    s = word.strip(_ASCII_EDGE)
    e = s.strip(_SOFT_EDGE)
    return e if e and e[0].isalnum() and e[-1].isalnum() else s


_tokens: dict[str, str] = {}


def tokens(text: str) -> set[str]:
    """The tokens of a text that have a character beyond ASCII."""
    if len(_tokens) > 300_000:
        _tokens.clear()
    out = set()
    for w in words(text):
        t = _tokens.get(w)
        if t is None:
            t = _tokens[w] = token(w)
        if not t.isascii():
            out.add(t)
    return out


class _Sound(dict):
    """character -> 2 sound, 1 a C1 control, 0 a control or a letter or mark of no known language."""

    def __init__(self, letters: set[str]):
        self.letters = letters

    def __missing__(self, c: str) -> int:
        if c == "\uffff" or c < " ":
            v = 0
        elif "\x80" <= c < "\xa0":
            v = 1
        else:
            v = 2 if c < "\x7f" or c in self.letters or category(c)[0] not in "LM" else 0
        self[c] = v
        return v


class CharsetModel:
    """Dictionaries per language, and the tokens that stand in them."""

    def __init__(self, by_lang: dict[str, list[str]]):
        self.by_lang = by_lang

    def _ready(self):
        self.known = {t for ts in self.by_lang.values() for t in ts}
        self.sound = _Sound({c for t in self.known for c in t + t.upper()} | set(INNER))
        self.coders, self.primer = {}, {}
        for lang, ts in sorted(self.by_lang.items()):
            content = (" " + " ".join(reversed(ts)) + " ").translate(_SHORT).encode("utf-8")[-DICT_BYTES:]
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            # a stretch of known tokens in front of what is measured takes the fixed costs of a frame
            self.primer[lang] = (" " + " ".join(ts[len(ts) // 3 :: max(1, len(ts) // 24)][:12]).translate(_SHORT) + " ").encode("utf-8")
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.floors = {g: len(c.compress(self.primer[g])) for g, c in self.coders.items()}
        self.readings: dict[str, dict] = {}
        self.doubt: dict[str, str] = {}
        self.seen: dict[tuple, tuple] = {}

    def __getstate__(self):
        return {"by_lang": self.by_lang}

    def __setstate__(self, state):
        self.by_lang = state["by_lang"]

    def length(self, ts: list[str]) -> int:
        """Least description length of the tokens over all languages, in bytes; no token takes less than
        TOKEN_BYTES."""
        data = (" ".join(ts).lower().translate(_SHORT) + " ").encode("utf-8", "replace")
        if not self.coders:
            return len(self.plain.compress(data))
        return max(len(ts) * TOKEN_BYTES, min(len(c.compress(self.primer[g] + data)) - self.floors[g] for g, c in self.coders.items()))

    def _possible(self, u: str, formed: bool) -> bool:
        """No control characters (those of an inner step of a chain aside), no letters that no language
        of the dictionaries has, and, but for well-formed UTF-8, no quotes or dashes between letters."""
        worst = min(map(self.sound.__getitem__, u), default=2)
        if worst < 2 and (worst == 0 or not ("â" in u or "Â" in u or "Ã" in u)):
            return False
        return formed or not _INSIDE.search(u)

    def _readings(self, t: str) -> dict[int, tuple[str, bool] | None]:
        """What a token may have been, by trial: (text, whether it is known), or None where the codec
        shows the token but cannot have meant it."""
        out = self.readings.get(t)
        if out is None:
            odd, out, judged = {c for c in t if c > "\x7f"}, {}, {}
            unusual = _UNUSUAL.search(t)
            for w, trials in _BY_READ.items():
                if not odd <= _SHOWN[w]:
                    continue  # a token was read in a codec that shows all its characters
                raw = None if unusual else codecs.charmap_encode(t, "strict", _ENCODE[w])[0]
                for k, step, deep in trials:
                    utf8 = step[1] == "utf_8"
                    u = undo(t, step) if utf8 else t.translate(_PAIRS[step]) if unusual else codecs.charmap_decode(raw, "strict", _DECODE[step[1]])[0]
                    for _ in range((DEPTH - 1) * deep):
                        u = (u and undo(u, step)) or u
                    if u is None or u == t:
                        continue
                    key = (u, utf8)
                    if key not in judged:  # many codecs agree on a token
                        e = u.strip(_SOFT_EDGE)
                        judged[key] = (u, e.lower() in self.known or e.isascii() or not any(map(str.isalpha, e))) if self._possible(u, utf8) else None
                    out[k] = judged[key]
            if len(self.readings) > 100_000:
                self.readings.clear()
            self.readings[t] = out
        return out

    def _candidates(self, ts: list[str]) -> list[tuple[float, float, tuple, list[str]]]:
        """Every decoding of the tokens that some step yields: (cost, preference, step, tokens).  Of steps that yield
        the same tokens the cheapest stands for all."""
        bad, hits = [0] * len(_TRIALS), [0] * len(_TRIALS)
        changes: dict[int, list[tuple[int, str]]] = {}
        for i, t in enumerate(ts):
            # tokens of a dictionary are no evidence against themselves and stay
            if t.lower() not in self.known:
                for k, r in self._readings(t).items():
                    if r is None:
                        bad[k] += 1
                    else:
                        changes.setdefault(k, []).append((i, r[0]))
                        hits[k] += r[1]
        found: dict[tuple, tuple] = {}
        for k in sorted(changes):
            step, deep = _TRIALS[k]
            new, n = list(ts), hits[k]
            for i, u in changes[k]:
                new[i] = u
            # that so many sequences are well-formed UTF-8 by chance would take bits to say
            cost = UTF8_COST * (1 + deep) - UTF8_CHANCE * len(changes[k]) if step[1] == "utf_8" else SINGLE_COST + EXCEPT_COST * bad[k] + UNSEEN_COST * (not n)
            key = tuple(new)
            if key not in found or cost < found[key][0]:
                found[key] = (cost, HIT * n, step, new)
        return list(found.values())

    def _shortest(self, ts: list[str]) -> tuple | None:
        """(step, tokens) of the decoding that describes the tokens shortest, if shorter than they are.
        A description has a least length: once this and the cost of all that is left are more than the
        best total, none of these can win, and they are not compressed."""
        base, least = self.length(ts), len(ts) * TOKEN_BYTES
        best: tuple | None = None
        for bound, i, cost, more, step, new in sorted((cost - more, i, cost, more, s, n) for i, (cost, more, s, n) in enumerate(self._candidates(ts))):
            if best is not None and bound + least > best[0]:
                break
            if cost + least < base and (total := self.length(new) + cost) < base and (best is None or (total - more, i) < best[:2]):
                best = (total - more, i, step, new)
        return best and best[2:]

    def decide(self, suspects: tuple[str, ...]) -> tuple[bool, dict[str, str]]:
        """(garbled, token -> restored token) for the unknown tokens of a page."""
        if suspects in self.seen:
            return self.seen[suspects]
        lost = any("�" in t for t in suspects)
        best = list(t for t in suspects if "�" not in t)
        origin = list(best)
        chain: tuple = ()
        for _ in range(DEPTH):
            if all(t.lower() in self.known for t in best):
                break
            found = self._shortest(best)
            if not found:
                break
            step, best = found
            chain += (step,)
        new = {a: b for a, b in zip(origin, best) if a != b}
        for t in suspects if chain and lost else ():
            u = t
            for step in chain:  # what was undone for the others may bring lost bytes back too
                for _ in range(DEPTH if step[1] == "utf_8" else 1):
                    u = undo(u, step) or u
            if u != t and "�" not in u and "�" in t:
                new[t] = u
        out = (lost or bool(chain), new)
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[suspects] = out
        return out

    def examine(self, text: str | None) -> tuple[bool, str | None]:
        """(garbled, restored text).  Null and blank texts are not garbled."""
        if not hasattr(self, "known"):
            self._ready()
        if not text or (text.isascii() and "&" not in text):
            return False, text
        plain = decode_entities(text)
        suspects = {t for w in words(plain) if (t := self._suspect(w))}
        if not suspects:
            return False, text
        suspects = sorted(suspects)
        # a sequence quoted on its own is mentioned, not garbled
        quoted = {m.strip(_SOFT_EDGE) or m for m in _QUOTED.findall(plain)}
        if quoted:
            suspects = [t for t in suspects if not any(ch.isascii() and ch.isalpha() for ch in t) and (t.strip(_SOFT_EDGE) or t) not in quoted or any(ch.isascii() and ch.isalpha() for ch in t)]
        garbled, new = self.decide(tuple(suspects))
        if not garbled:
            return False, text
        if new:  # word by word, so that no token is replaced inside another
            plain = _RUN.sub(lambda m: self._restore(m.group(), new), plain)
        return True, plain

    def _suspect(self, word: str) -> str:
        """The token of a word with a character beyond ASCII where no dictionary has it, else ""."""
        t = self.doubt.get(word)
        if t is None:
            t = token(word)
            t = "" if t.isascii() or t.lower() in self.known else self._whole(word, t)
            if len(self.doubt) > 300_000:
                self.doubt.clear()
            self.doubt[word] = t
        return t

    def examine_all(self, texts: list[str | None]) -> list[tuple[bool, str | None]]:
        """``examine`` of each text; only those with a suspect are taken apart one by one."""
        if not hasattr(self, "known"):
            self._ready()
        some = [k for k, t in enumerate(texts) if t and not (t.isascii() and "&" not in t)]
        plain = [decode_entities(texts[k]).encode("utf-8", "surrogatepass") for k in some]
        each, at, text = numbered(pa.array(plain, pa.large_binary()))
        doubted = np.array([not w.isascii() and bool(self._suspect(w.decode("utf-8", "surrogatepass"))) for w in each], bool)
        out = [(False, t) for t in texts]
        for k in distinct(text[doubted[at]]).tolist():
            out[some[k]] = self.examine(texts[some[k]])
        return out

    def _whole(self, word: str, t: str) -> str:
        """The token with its typographic edges where these are bytes of its last or first character:
        where some step can undo it only so."""
        s = word.strip(_ASCII_EDGE)
        if s == t:
            return t
        for step in CHAINS[: len(READ)]:
            if undo(s, step) is not None and undo(t, step) is None:
                return s
        return t

    def _restore(self, word: str, new: dict[str, str]) -> str:
        t = self.doubt.get(word) if not word.isascii() else None
        return word.replace(t, new[t]) if t and t in new else word


def fit(pages: list[tuple[str, str]]) -> CharsetModel:
    """Dictionaries from (language label, text) of a few texts."""
    by: Counter = Counter()
    written: dict[str, str] = {}
    plain: Counter = Counter()
    for lang, text in pages:
        for t in sorted(tokens(text)) if not text.isascii() else []:
            by[lang, t.lower()] += 1
            written.setdefault(t.lower(), t)
        plain.update({w for w in {t.strip(_ASCII_EDGE) for t in text.lower().split()} if w.isascii()})
    return fit_counts([(lang, t, written[t], n) for (lang, t), n in by.items()], plain, Counter(lang for lang, _ in pages), 2)


def fit_counts(counted: list[tuple[str, str, str, int]], plain: dict[str, int], pages_of: dict[str, int], least: int) -> CharsetModel:
    """Dictionaries from the corpus' counts: (language label, token, a written form, pages), the pages of
    ASCII words (what a garbled quote at a word leaves beside it), the pages of a language, and the least
    pages of a token.  Pages without a label count, but make no dictionary.  Frequent tokens, without those that some chain turns into a more frequent one:
    these are garbled themselves."""
    count: Counter = Counter()
    by: dict[str, Counter] = {}
    written: dict[str, str] = {}
    for lang, t, form, n in counted:
        count[t] += n
        by.setdefault(lang, Counter())[t] += n
        written[t] = min(form, written.get(t, form))
    clean: dict[str, bool] = {}
    for t, n in count.items():
        if n < least or "\ufffd" in t or any("\x80" <= c < "\xa0" for c in t):
            clean[t] = False
            continue
        # common in a language: sound, whatever it could be read as elsewhere
        if any(c[t] >= max(least, COMMON * pages_of.get(g, 0)) for g, c in by.items()):
            clean[t] = True
            continue
        clean[t] = not any(_better(t, form, step, n, count, plain) for form in {t, written[t], t.swapcase()} for step in CHAINS)
    return CharsetModel({lang: [t for t, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if clean[t]][:DICT_TOKENS] for lang, c in by.items() if lang})


def _better(t: str, form: str, step: tuple[str, str], n: int, count: Counter, plain: dict[str, int]) -> bool:
    """Does the step turn a token of n pages into a more frequent one?"""
    utf8 = step[1] == "utf_8"
    if len(t) < 3 and not utf8:
        return False
    u = undo(form, step)
    if u and utf8:
        u = undo(u, step) or u
    if not u:
        return False
    bare = u.strip(_SOFT_EDGE)
    if utf8:
        return bare.isascii() or count.get(bare.lower(), 0) > n
    if sum(map(str.isalpha, u)) >= sum(map(str.isalpha, t)) and count.get(bare.lower(), 0) > n:
        return True
    return bare != u and bare.isascii() and bare.isalpha() and plain.get(bare.lower(), 0) > n and not _INSIDE.search(u)
