"""One pass over a page's markup, run inside Arrow batches.

This is the only Python that touches rows: HTML needs a tokenizer, which the
built-in functions do not have. It only reports what the markup says (texts,
links, payload attributes and whether a reader could see them); everything
decided from those facts is a Column expression elsewhere.

Markup rules. Tags and attributes are read leniently and every pattern
consumes forward only, so the cost is linear in the page. ``script`` and
``style`` bodies are skipped; text under ``template``, ``rt`` and ``rp`` is
not page text. An end tag closes up to its nearest open start tag and is
ignored when nothing matches. ``p``, list items, table cells and rows and
options are closed by the start tags that imply their end.
"""

import re
import sys
from html import unescape
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagelens.functions import fixed_values as V
from pagelens.schemas import FACTS

# Workers receive this module with the task and need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

_TOKEN = re.compile(
    r"<!--(?:[^-]++|-(?!->))*+(?:-->)?+"
    r"|<[!?][^>]*+>?+"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+>?+"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)>?+"
)
_RAW_END = {
    name: re.compile(f"</{name}", re.IGNORECASE) for name in ("script", "style")
}
_ATTR = re.compile(
    r"([^\s/>=][^\s/>=]*+)"
    r"(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+)?))?"
)
_STYLE_ATTR = re.compile(r"style\s*=")
_TREE_HINTS = ("hidden", "<template", "<rt", "<rp")
_HIDDEN_STYLE = re.compile(V.HIDDEN_STYLE, re.IGNORECASE)
_TEXT_COLOUR = re.compile(V.TEXT_COLOUR, re.IGNORECASE)
_BACK_COLOUR = re.compile(V.BACK_COLOUR, re.IGNORECASE)
_COLOUR_NAMES = V.COLOUR_NAMES

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr"
    .split()
)
_NO_TEXT = frozenset(["template", "rt", "rp"])
_CELL = frozenset(["td", "th"])
_BLOCKS = (
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 "
    "h4 h5 h6 header hr main nav ol p pre section table ul"
).split()
_FLOW_ROOTS = frozenset(
    "div td th li dd body article section aside main form blockquote "
    "header footer nav fieldset table".split()
)
# start tag -> (open elements it ends, elements that shield them)
_IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (_CELL, frozenset(["tr", "table"])),
    "th": (_CELL, frozenset(["tr", "table"])),
    **{tag: (frozenset(["p"]), _FLOW_ROOTS) for tag in _BLOCKS},
}
# A rooted path that needs no normalising: no empty or dotted segment, query,
# fragment, parameter, space or control character.
_ROOTED = re.compile(r"(?:/[^/\\?#;.\x00-\x20\x7f-\xa0][^/\\?#;\x00-\x20\x7f-\xa0]*+)++/?")


def _attributes(raw: str) -> dict:
    found: dict = {}
    for name, double, single, bare in _ATTR.findall(raw):
        value = double or single or bare
        found.setdefault(
            name.lower(), unescape(value) if "&" in value else value
        )
    return found


def _unreadable(name: str, attrs: dict) -> bool:
    """True when an element's own attributes keep it from a reader."""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if name == "input" and attrs.get("type", "").lower() == "hidden":
        return True
    style = attrs.get("style")
    if not style:
        return False
    if _HIDDEN_STYLE.search(style):
        return True
    shades = [p.search(style) for p in (_TEXT_COLOUR, _BACK_COLOUR)]
    if not all(shades):
        return False
    text, back = (
        _COLOUR_NAMES.get(s, s)
        for s in (m.group(1).strip().lower() for m in shades)
    )
    return text == back


class _OpenElements:
    """Open elements, each with the region its text belongs to."""

    def __init__(self):
        self.stack: list = []
        # Per tag name the places of its open elements in the stack.
        self.places: dict = {}
        self.region = 0
        self.muted = 0

    def push(self, name: str, region: int):
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, self.region))
        self.muted += name in _NO_TEXT
        self.region = region

    def pop(self) -> str:
        name, self.region = self.stack.pop()
        self.places[name].pop()
        self.muted -= name in _NO_TEXT
        return name

    def close(self, name: str):
        if self.places.get(name):
            while self.pop() != name:
                pass

    def imply_end(self, name: str):
        ended, shields = _IMPLIED_END.get(name, ((), ()))
        last = self._last(ended)
        if last > self._last(shields):
            while len(self.stack) > last:
                self.pop()

    def _last(self, names) -> int:
        """Place of the innermost open element of these names, or -1."""
        places = self.places
        return max((places[n][-1] for n in names if places.get(n)), default=-1)


def _resolver(base: str):
    """Resolve links against ``base``; plain rooted paths only need a prefix."""
    try:
        parts = urlsplit(base)
        rooted = parts.scheme in ("http", "https") and parts.netloc
    except ValueError:
        rooted = False
    prefix = f"{parts.scheme}://{parts.netloc}" if rooted else None

    def resolve(href: str):
        href = href.strip()
        if prefix and _ROOTED.fullmatch(href):
            return prefix + href
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    return resolve


def _raw_end(name: str, html: str, start: int) -> int:
    """Where the raw body of a script or style element ends."""
    found = _RAW_END[name].search(html, start)
    return found.start() if found else len(html)


def _joined(pieces: list) -> str:
    """Text pieces apart by a space, which also ends any open entity."""
    whole = " ".join(pieces)
    return unescape(whole) if "&" in whole else whole


class _Page:
    """Collects the facts of one page while its tags go by."""

    def __init__(self, html: str, base):
        lowered = html.lower()
        nested = any(h in lowered for h in _TREE_HINTS) or _STYLE_ATTR.search(lowered)
        self.tree = _OpenElements() if nested else None
        self.coded = "data-cfemail" in lowered
        self.resolve = _resolver(base) if base is not None else None
        self.lang = None
        self.texts: list = []
        self.regions: list = [[]]
        self.anchors: list = []
        self.payloads: list = []

    def text(self, piece: str):
        if self.tree:
            if self.tree.muted:
                return
            self.regions[self.tree.region].append(piece)
        self.texts.append(piece)

    def start(self, name: str, raw: str):
        attrs = None
        hidden = False
        if self.tree:
            attrs = _attributes(raw) if raw else {}
            hidden = self._nest(name, attrs)
        if name == "html" and self.lang is None:
            self.lang = _attributes(raw).get("lang", "")
        if name != "a" and not (self.coded and "data-cfemail" in raw.lower()):
            return
        if attrs is None:
            attrs = _attributes(raw)
        href = attrs.get("href") if name == "a" else None
        if href is not None:
            url = self.resolve(href) if self.resolve else None
            self.anchors.append((href, url, hidden, len(self.anchors)))
        if "data-cfemail" in attrs:
            self.payloads.append((attrs["data-cfemail"], hidden))

    def _nest(self, name: str, attrs: dict) -> bool:
        """Place an element in the tree; True when a reader cannot see it."""
        self.tree.imply_end(name)
        region = self.tree.region
        if attrs and _unreadable(name, attrs):
            self.regions.append([])
            region = len(self.regions) - 1
        if name not in _VOID:
            self.tree.push(name, region)
        return region > 0

    def facts(self) -> dict:
        marked = len(self.regions) > 1
        return {
            "lang": self.lang,
            "text": _joined(self.texts),
            "visible_text": _joined(self.regions[0]) if marked else None,
            "hidden_texts": [_joined(r) for r in self.regions[1:]],
            "anchors": [dict(zip(_ANCHOR, a)) for a in self.anchors],
            "payloads": [dict(zip(_PAYLOAD, p)) for p in self.payloads],
        }


_READ = frozenset(["a", "html"])
_ANCHOR = ("href", "url", "hidden", "pos")
_PAYLOAD = ("hex", "hidden")


def read_markup(html, base=None) -> dict | None:
    """The facts of one page; ``base`` also resolves its links."""
    if html is None:
        return None
    page = _Page(html, base)
    text, start_tag, tree = page.text, page.start, page.tree
    every_tag = tree is not None or page.coded
    last = at = 0
    while at is not None:
        tokens, at = _TOKEN.finditer(html, at), None
        for token in tokens:
            begin, stop = token.span()
            if begin > last:
                text(html[last:begin])
            last = stop
            end, name, raw = token.groups()
            if name:
                name = name.lower()
                if every_tag or name in _READ:
                    start_tag(name, raw)
                if name in _RAW_END:
                    last = at = _raw_end(name, html, stop)
                    break
            elif end and tree:
                tree.close(end.lower())
    if last < len(html):
        text(html[last:])
    return page.facts()


_ARROW_FACTS = to_arrow_type(FACTS)


# Pages whose texts and facts are Python objects at one time.
_SLICE = 64


def _in_slices(*columns: pa.Array) -> pa.Array:
    """The facts of a batch, of which only a slice is held as objects."""
    done = [pa.array([], type=_ARROW_FACTS)]
    for at in range(0, len(columns[0]), _SLICE):
        some = [c.slice(at, _SLICE).to_pylist() for c in columns]
        done.append(pa.array(map(read_markup, *some), type=_ARROW_FACTS))
    return pa.concat_arrays(done)


def _facts(html: pa.Array) -> pa.Array:
    return _in_slices(html)


def _facts_with_links(html: pa.Array, url: pa.Array) -> pa.Array:
    return _in_slices(html, url)


def facts_of(html: Column, url: Column | None = None) -> Column:
    """Struct of page facts; links are resolved only when ``url`` is given.

    Marked nondeterministic so that the optimizer never copies the parse into
    later filters: a page is parsed once per plan.
    """
    if url is None:
        return F.arrow_udf(_facts, FACTS).asNondeterministic()(html)
    return F.arrow_udf(_facts_with_links, FACTS).asNondeterministic()(html, url)
