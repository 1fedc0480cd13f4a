"""Facts of stored HTML: one parse per page in Arrow batches, one typed row out.

A tolerant event parser (the standard library's) feeds a flat list of elements with parent links; all
facts are read from that list, so a page is walked a fixed number of times however many facts there
are.  One poisoned page yields an error column, never a failed task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a following one of the same family closes.
IMPLIED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Parts of a page that hold no main text.
ASIDE = frozenset("nav header footer aside form table script style noscript template button select".split())
#: Fixed values.
FEEDS = {"application/rss+xml", "application/atom+xml"}
SEARCH_NAMES = {"q", "query", "search", "s", "keyword"}
CART = ("cart", "carrello", "basket", "checkout", "panier", "warenkorb", "cesta")
ARTICLE = re.compile(r"/\d{4}/\d{2}/|/article/|/articolo/|/news/|/story/|/post/|/\d{4,}(?:/|$)")
APP_ROOTS = {"root", "app", "__next"}
HEADINGS, HEADING = 15, 80

SCHEMA = """url string, error string, title string, html_lang string, meta_description string, meta_keywords array<string>, meta_generator string,
twitter_card string, og map<string,string>, og_locale string, canonical string, feeds array<string>, hreflang array<string>, headings array<string>,
n_images int, n_scripts int, n_forms int, n_links_internal int, n_links_external int, article_link_density double, has_login_form boolean,
has_search_form boolean, has_cart_link boolean, has_app_root boolean, body_text string, text_main string, jsonld_types array<string>, jsonld_publisher string,
jsonld_date_published string, is_accessible_for_free boolean, microdata_types array<string>, rdfa_types array<string>"""


class Element:
    """An element with what its ancestors make of it, known when it is opened."""

    __slots__ = ("tag", "attrs", "parent", "order", "in_body", "in_form", "aside", "anchor", "first", "last")

    def __init__(self, tag, attrs, parent, order, at):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.first = self.last = at  # its text pieces: those from its opening to its end
        up = parent
        self.in_body = tag == "body" or (up is not None and up.in_body)
        self.in_form = tag == "form" or (up is not None and up.in_form)
        self.aside = tag in ASIDE or (up is not None and up.aside)
        self.anchor = self if tag == "a" else up.anchor if up is not None else None


class Document(HTMLParser):
    """All elements in document order, and the text pieces with the element that holds them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.pieces: list[tuple[Element | None, str]] = []
        self.stack: list[Element] = []
        self.shown: list[int] = [0]  # pieces with something to see, counted up
        self.feed(html)
        self.close()
        self._end(0)

    def handle_starttag(self, tag, attrs):
        family = IMPLIED.get(tag)
        if family or tag in BLOCK:
            closes = family or {"p"}
            while self.stack and self.stack[-1].tag in closes:
                self._end(len(self.stack) - 1)
        e = Element(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.stack[-1] if self.stack else None, len(self.elements), len(self.pieces))
        self.elements.append(e)
        if tag not in VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1].tag == tag:
            self._end(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self._end(k)
                return

    def _end(self, k: int):
        """Close the open elements from the k-th on."""
        for e in self.stack[k:]:
            e.last = len(self.pieces)
        del self.stack[k:]

    def handle_data(self, data):
        self.pieces.append((self.stack[-1] if self.stack else None, data))
        self.shown.append(self.shown[-1] + (not data.isspace()))

    def of(self, *tags) -> list[Element]:
        return [e for e in self.elements if e.tag in tags]

    def text_under(self, root: Element, most: int | None = None) -> str:
        """The text of an element, which are the pieces between its opening and its end; with ``most`` as
        many pieces as it takes for so many visible characters."""
        if self.shown[root.last] == self.shown[root.first]:
            return ""
        out, seen = [], 0
        for k in range(root.first, root.last):
            t = self.pieces[k][1]
            out.append(t)
            if most is not None and (seen := seen + len("".join(t.split()))) > most:
                break
        return "".join(out)


def squeeze(s: str | None) -> str | None:
    s = " ".join((s or "").split())
    return s or None


def distinct(xs) -> list:
    return list(dict.fromkeys(x for x in xs if x))


def short_type(name) -> str:
    """schema.org name without its address or prefix."""
    return re.split(r"[/#:]", str(name).strip().rstrip("/"))[-1]


def linked_data(blocks: list[str]) -> dict:
    """Types, publisher, date and free access of JSON-LD blocks; bad JSON is skipped."""
    nodes, out = [], {"types": [], "publisher": None, "date": None, "free": None}
    for text in blocks:
        try:
            todo = [json.loads(text)] if text.strip() else []
        except (ValueError, RecursionError):
            continue
        while todo:  # a stack; lists flattened, graphs before their node
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(reversed(x))
            elif isinstance(x, dict):
                if "@graph" in x:
                    todo += [{k: v for k, v in x.items() if k != "@graph"}, x["@graph"]]
                else:
                    nodes.append(x)
    for node in nodes:
        t = node.get("@type")
        out["types"] += [short_type(x) for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]
        p = node.get("publisher")
        name = p.get("name") if isinstance(p, dict) else p
        if out["publisher"] is None and isinstance(name, str):
            out["publisher"] = name
        if out["date"] is None and isinstance(node.get("datePublished"), str):
            out["date"] = node["datePublished"]
        if out["free"] is None:
            v = str(node.get("isAccessibleForFree")).strip().lower()
            out["free"] = True if v in ("true", "yes", "1") else False if v in ("false", "no", "0") else None
    out["types"] = distinct(out["types"])
    return out


def main_text(doc: Document) -> str:
    """Blocks outside boilerplate that carry more text than links (shallow text features: a block stays
    when it is long or dense enough and mostly not anchor text)."""
    blocks: dict[int, list] = {}
    for e, t in doc.pieces:
        if e is None or e.aside or not e.in_body or not t.strip():
            continue
        b, linked = e, False
        while b.parent is not None and b.tag not in BLOCK and b.tag not in ("p", "li", "td", "dd", "body"):
            linked |= b.tag == "a"
            b = b.parent
        entry = blocks.setdefault(b.order, [[], 0, 0, b.tag])
        words = len(t.split())
        entry[0].append(t)
        entry[1] += words
        entry[2] += words * linked
    kept = []
    for order in sorted(blocks):
        text, words, linked, tag = blocks[order]
        if linked * 2 <= words and (words >= 5 or tag in ("p", "h1", "h2", "h3", "h4", "blockquote")):
            kept.append(squeeze("".join(text)) or "")
    return "\n".join(k for k in kept if k)


def facts(url: str | None, html: str | None, domain: str | None = None) -> dict:
    """All facts of one page; url serves as the base of links."""
    doc = Document(html or "")
    base = url or ""
    host = (urlsplit(base).hostname or "").lower() if base else ""
    domain = (domain or host).lower()
    metas = [(e.attrs.get("name", "").strip().lower(), e.attrs.get("property", "").strip().lower(), e.attrs["content"]) for e in doc.of("meta") if "content" in e.attrs]
    named = {n: c for n, _, c in metas if n}
    og = {p[3:]: c for _, p, c in metas if p.startswith("og:")}
    links = [(e.attrs.get("rel", "").lower().split(), e.attrs) for e in doc.of("link")]
    alternates = [a for rel, a in links if "alternate" in rel]
    internal = external = articles = 0
    resolved: dict[str, int] = {}
    anchors = doc.of("a")
    text_of: dict[int, list[str]] = {}
    body_pieces = []
    for e, t in doc.pieces:
        if e is not None:
            if e.in_body:
                body_pieces.append(t)
            if e.anchor is not None:
                text_of.setdefault(e.anchor.order, []).append(t)
    cart = False
    for a in anchors:
        href = a.attrs.get("href")
        if href is None:
            continue
        shown = (href + " " + "".join(text_of.get(a.order, []))).lower()
        cart = cart or any(c in shown for c in CART)
        href = href.strip()
        if href in resolved:
            kind = resolved[href]
            internal, external, articles = internal + (kind > 0), external + (kind == 0), articles + (kind == 2)
            continue
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        try:
            target = urlsplit(urljoin(base, href))
            to = (target.hostname or "").lower()
        except ValueError:
            continue
        if to in ("", host, domain) or (domain and to.endswith("." + domain)):
            kind = 2 if ARTICLE.search(target.path) else 1
        else:
            kind = 0
        resolved[href] = kind
        internal, external, articles = internal + (kind > 0), external + (kind == 0), articles + (kind == 2)
    inputs = [(e, e.attrs.get("type", "").lower(), e.attrs.get("name", "").lower()) for e in doc.of("input")]
    in_form = [(kind, name) for e, kind, name in inputs if e.in_form]
    ld = linked_data([doc.text_under(e) for e in doc.of("script") if e.attrs.get("type", "").lower() == "application/ld+json"])
    body = " ".join(t for t in body_pieces if t).strip()
    first = lambda tag: next(iter(doc.of(tag)), None)
    title = first("title")
    return {
        "url": url, "error": None,
        "title": squeeze(doc.text_under(title)) if title is not None else None,
        "html_lang": first("html").attrs.get("lang") if first("html") is not None else None,
        "meta_description": named.get("description"),
        "meta_keywords": [k.strip() for k in named.get("keywords", "").split(",") if k.strip()][:20],
        "meta_generator": named.get("generator"), "twitter_card": named.get("twitter:card"),
        "og": list(og.items()), "og_locale": og.get("locale"),
        "canonical": next((a.get("href") for rel, a in links if rel == ["canonical"]), None),
        "feeds": distinct(a.get("href") for a in alternates if a.get("type", "").lower() in FEEDS),
        "hreflang": distinct(a.get("hreflang") for a in alternates)[:30],
        "headings": list(islice((h[:HEADING] for e in doc.elements if e.tag in ("h1", "h2") and (h := squeeze(doc.text_under(e, HEADING)))), HEADINGS)),
        "n_images": len(doc.of("img")), "n_scripts": len(doc.of("script")), "n_forms": len(doc.of("form")),
        "n_links_internal": internal, "n_links_external": external,
        "article_link_density": round(articles / (internal + external), 4) if internal + external else 0.0,
        "has_login_form": any(kind == "password" for kind, _ in in_form),
        "has_search_form": any(e.attrs.get("role", "").lower() == "search" for e in doc.of("form")) or any(k == "search" or n in SEARCH_NAMES for k, n in in_form),
        "has_cart_link": cart,
        "has_app_root": any(e.attrs.get("id") in APP_ROOTS for e in doc.elements),
        "body_text": body, "text_main": main_text(doc),
        "jsonld_types": ld["types"], "jsonld_publisher": ld["publisher"], "jsonld_date_published": ld["date"], "is_accessible_for_free": ld["free"],
        "microdata_types": distinct(short_type(e.attrs["itemtype"]) for e in doc.elements if e.attrs.get("itemtype", "").strip()),
        "rdfa_types": distinct(short_type(t) for e in doc.elements if "typeof" in e.attrs for t in e.attrs["typeof"].split()),
    }


def _charset_of(kind: str | None) -> str | None:
    m = re.search(r"charset=[\"']?([\w.:-]+)", kind or "", re.I)
    return m.group(1).lower() if m else None


def decode(body: bytes, content_type: str | None = None) -> tuple[str, str, str]:
    """(text, charset, source): the header's charset, else a detector's on the first 64 KiB, else utf-8;
    an unknown label falls back to utf-8."""
    name, source = _charset_of(content_type), "header"
    if not name:
        source = "charset_normalizer"
        try:
            from charset_normalizer import from_bytes

            best = from_bytes(body[: 64 * 1024]).best()
            name = best.encoding if best is not None else None
        except ImportError:
            name = None
    try:
        return body.decode(name or "utf-8", errors="replace"), name or "utf-8", source if name else "default"
    except LookupError:
        return body.decode("utf-8", errors="replace"), "utf-8", "default"


def extract(pages: DataFrame, id_col: str, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The facts of every page, one parse each: (id, facts..., kept columns...).  Null HTML is an empty page; a
    page that breaks the parser has its message in ``error`` and nulls elsewhere.  Columns to keep pass through
    the batches, so no join brings them back."""
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_u"), F.col(html_col).cast("string").alias("_h"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    kind = dict(src.dtypes)["_id"]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"_id {kind}, " + SCHEMA.replace("\n", " ")
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    kinds = dict(src.dtypes)
    whole = ddl + "".join(f", `_k_{c}` {kinds[f'_k_{c}']}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for i, u, h in zip(*(part.column(k).to_pylist() for k in range(3))):
                    try:
                        r = facts(u, h)
                    except Exception as e:  # noqa: BLE001 - isolate the row
                        r = {"url": u, "error": f"{type(e).__name__}: {e}"[:200]}
                    rows.append({"_id": i, **r})
                kept = [part.column(k) for k in range(3, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*[pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], *kept], names=[*arrow.names, *part.schema.names[3:]])

    out = spread(src).mapInArrow(run, whole).withColumnRenamed("_id", id_col)
    return out.withColumnsRenamed({f"_k_{c}": c for c in keep})
