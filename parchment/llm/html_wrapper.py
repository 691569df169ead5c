"""Main text of web pages by wrappers that are inferred from the pages of a host.

A page is a stream of tokens: tags (with id and class) and pieces of text. A wrapper is a union-free regular expression
over such tokens: elements, fixed texts, text slots, optional groups and repeated groups. It is inferred by iterative
alignment: the first page is the first wrapper; each further page is aligned with it, a text mismatch becomes a slot, a tag
mismatch a repeated group if the extra tokens repeat what stands beside them, else an optional group. Wrappers are made
per partition and host, then merged by the same alignment in bounded groups, level by level, so that no task gets all pages of a host.

Extraction: each page is matched with its host's wrapper, node by node, as a regular expression is: elements by tag, id and class,
optional and repeated groups as often as they come. A text that stands where the wrapper has a fixed text is the site's; what
stands in slots, in optional and repeated groups whose text differs, or where nothing matches, is the page's. A block all of
whose text is the site's is left out, also in an article. A host needs pages of DIFFERENT different texts for that.
Of the rest, the main region is <article> or <main> where a page has one, else the whole page, so that no headline or part
of an article is lost for the container it lies in. What differs from page to page and still is no main text (menus of the
page, adverts, comments) no wrapper can tell: it is left out by tag, role, id and class.

Defined results: a null page counts as empty and gives an empty text; a page that stops early gives what it has; repeated
rows are extracted each; a null or malformed URL makes a host of its own kind, the empty one; other columns are left out;
empty tables give empty results. Elements nested more than DEPTH deep count, for the wrapper alone, as children of the one at that depth.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_rows

#: Neighbours in a wrapper from which on optional ones, which hold no fixed text, are not kept, and which are aligned at once.
LONGEST = 3000
#: Wrappers merged in one task.
FAN_IN = 64
#: Levels of elements that a wrapper tells apart.
DEPTH = 150
#: Pages of different texts that a host must have before a text counts as fixed; so many digests of pages are kept for a host.
DIFFERENT = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br"}
LEFT_OUT = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "menu", "dialog", "head", "object", "embed", "canvas", "audio", "video", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar", "form"}
#: Words of ids and classes of what isn't main text. A whole class must be made of them; "has-sidebar" or "comments-open" is not.
_WORD = (
    r"(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscri(?:be|ption)|sign-?up|log-?in"
    r"|nav(?:bar|igation)?|menus?|breadcrumbs?|side-?bars?|footers?|site-?header|page-?header|masthead|topbar|toolbar|widgets?|related|recommended|share|sharing|social|follow-?us|comments?|commentlist|responses|replies|discussion|disqus|pagination|pager|skip-?links?|toc)"
)
_BAD_NAME = re.compile(rf"(?:(?:site|page|main|left|right|top|bottom|primary|secondary)[_-])*{_WORD}(?:[_-](?:{_WORD}|box|bar|list|area|section|block|links|posts))*(?:[_-]?[0-9]+)?")
#: Words of the list that also name parts of articles: within one, they count as the whole class of an element, and not as its id.
_DOUBTFUL = re.compile(r"share|sharing|notices?|alerts?|related|recommended|social|toc|overlays?|promos?|promotions?|discussion|responses|replies|banners?|widgets?")
#: Start tags that end an open element of the same list, up to the nearest of its parents.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): kind is open, close or text; value is the attributes or the raw text. Comments and what scripts hold are left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or ""
        if name in VOID or (m[3] or "").endswith("/") and name in ("svg",):
            continue
        if name in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n


def _left_out(name: str, attributes: str, parents: list[str]) -> bool:
    if name in LEFT_OUT:
        return True
    if name == "header" and not any(p in ("article", "main", "section") for p in parents):
        return True
    if not attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _bad_name(name: str, attributes: str, parents: list[str]) -> bool:
    """Whether a class or the id is one of the list. Never of the page or its article; an article in an article is a comment or the like."""
    if not attributes or name in ("html", "body", "main") or name == "article" and "article" not in parents:
        return False
    inside = "article" in parents or "main" in parents
    for key, value in _ATTRIBUTE.findall(attributes):
        if (key := key.lower()) in ("class", "id"):
            words = value.strip("\"'").lower().split()
            for w in filter(_BAD_NAME.fullmatch, words):
                if not (inside and _DOUBTFUL.fullmatch(w)) or key == "class" and len(words) == 1:
                    return True
    return False


def blocks(page: str | list, of_site: frozenset[int] | set[int] = frozenset()) -> list[tuple[str, str, bool, bool]]:
    """(path, text, main, left out) of each block of text: text between block tags, its white space folded. of_site: which of the
    page's texts are the site's; a block of nothing else is left out."""
    stack: list[list] = []  # name, left out, left out by its name, 2 if it holds a <main>, 1 if an <article>
    out: list[tuple[str, str, bool, list]] = []
    piece: list[str] = []
    number, own, sites = -1, False, False

    def flush() -> None:
        nonlocal own, sites
        text = _SPACE.sub(" ", _html.unescape("".join(piece))).strip()
        piece.clear()
        dropped, own, sites = sites and not own, False, False
        if text and not dropped:
            names = [s[0] for s in stack if s[0] not in INLINE]
            out.append(("/".join(names), text, "article" in names or "main" in names, [*stack]))

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            if top == name:
                return

    for kind, name, value in tokens(page) if isinstance(page, str) else page:
        if kind == "text":
            piece.append(value)
            if not value.isspace():
                number += 1
                if number in of_site:
                    sites = True
                else:
                    own = True
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name not in INLINE:
            flush()
        if kind == "open":
            if name in VOID:
                continue
            ends = _ENDS.get(name, set()) | ({"p"} if name in _BLOCKS_END_P else set())
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        if name != "p" or stack[i][0] == "p":
                            del stack[i:]
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in ends and name != "p":
                        break
                    if stack[i][0] not in INLINE and name == "p":
                        break
            parents = [s[0] for s in stack]
            bad, named = (False, False) if name in INLINE and not value else (_left_out(name, value, parents), _bad_name(name, value, parents))
            if (bad or named) and name in INLINE:
                flush()
            if name in ("main", "article"):
                for s in stack:
                    s[3] = max(s[3], 2 if name == "main" else 1)
            stack.append([name, bad, named, 0])
        elif any(s[0] == name for s in stack):
            if any((s[1] or s[2]) and s[0] in INLINE for s in stack):
                flush()
            close(name)
    flush()

    def without(holds: int) -> list[tuple[str, str, bool, bool]]:
        return [(p, t, m, any(s[1] or s[2] and s[3] < holds for s in inside)) for p, t, m, inside in out]

    # a name counts for nothing around <main>, and around an <article> where all articles would go
    found = without(2)
    return found if any(m and not b for _, _, m, b in found) or not any(m for _, _, m, _ in found) else without(1)


# ---- wrappers ------------------------------------------------------------------------------------------------------
# A wrapper is a list of nodes: ["x", text] a fixed text, ["s"] a text slot, ["e", tag, quantity, nodes] an element, and
# ["g", quantity, nodes] a group of neighbours; quantity is "1", "?", "+" or "*". Elements stand for the part of the token
# stream from a start tag to its end, so groups that the alignment makes are always balanced.


def _short(text: str) -> str:
    """A text, or of a long one its beginning and the digest of the whole."""
    return text if len(text) <= 200 else f"{text[:100]}#{hashlib.blake2b(text.encode('utf-8', 'replace'), digest_size=16).hexdigest()}"


def _key_of(mark: str) -> str:
    return mark if len(mark) <= 100 else f"{mark.partition('.')[0]}.{hashlib.blake2b(mark.encode('utf-8', 'replace'), digest_size=16).hexdigest()}"


def tree(page: str | list, seen=None) -> list:
    """The page's elements ["e", key, "1", children] and texts ["x", text, number]. seen, a hash, takes in every text."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    number = -1
    for kind, name, value in tokens(page) if isinstance(page, str) else page:
        if kind == "text":
            if not value.isspace():
                number += 1
                text = _SPACE.sub(" ", value).strip()
                stack[min(len(stack), DEPTH) - 1][1].append(["x", _short(text), number])
                if seen is not None:
                    seen.update(f"{text}\0".encode("utf-8", "replace"))
            continue
        if kind == "close":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        ends = _ENDS.get(name, set()) | ({"p"} if name in _BLOCKS_END_P else set())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                del stack[i:]
                break
            if stack[i][0] not in INLINE:
                break
        mark = ""
        if value:
            mark = "".join("." + v.strip("\"'") for k, v in _ATTRIBUTE.findall(value) if k.lower() in ("class", "id"))
        node = ["e", _key_of(name + mark), "1", []]
        stack[min(len(stack), DEPTH) - 1][1].append(node)
        if name not in VOID:
            stack.append((name, node[3]))
    return root


def shape(page: str | list, seen=None) -> list:
    """A page as a wrapper of itself: its tree with neighbouring repeats folded, from the leaves up."""
    return _folded(tree(page, seen))


def _folded(nodes: list) -> list:
    return fold([n[:2] if n[0] == "x" else ["e", n[1], n[2], _folded(n[3])] for n in nodes])


def _key(node: list) -> tuple:
    return ("x",) if node[0] in "xs" else ("e", node[1]) if node[0] == "e" else ("g", *map(_key, node[2]))


def _quantity(a: str, b: str) -> str:
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return "*" if many and none else "+" if many else "?" if none else "1"


def _with(node: list, quantity: str) -> list:
    return ["e", node[1], quantity, node[3]] if node[0] == "e" else ["g", quantity, node[2]]


def _unite(x: list, y: list) -> list:
    """Two nodes of one key as one."""
    if x[0] in "xs":
        return x if x == y else ["s"]
    if x[0] == "e":
        return ["e", x[1], _quantity(x[2], y[2]), align(x[3], y[3])]
    return ["g", _quantity(x[1], y[1]), align(x[2], y[2])]


def _repeat(node: list) -> list:
    return _with(node, "*" if node[2 if node[0] == "e" else 1] in "?*" else "+")


def fold(nodes: list, longest: int = 4) -> list:
    """Neighbouring nodes of one key, and neighbouring groups of up to `longest` nodes, as one repeated node."""
    out: list = []
    for node in nodes:
        if out and _key(out[-1]) == _key(node):
            out[-1] = _unite(out[-1], node) if node[0] in "xs" else _repeat(_unite(out[-1], node))
            continue
        out.append(node)
        for k in range(2, longest + 1):
            keys = [*map(_key, out[-k:])]
            if len(out) > k and out[-k - 1][0] == "g" and [*map(_key, out[-k - 1][2])] == keys:
                out[-k - 1 :] = [["g", "+", align(out[-k - 1][2], out[-k:])]]
                break
            if len(out) >= 2 * k and [*map(_key, out[-2 * k : -k])] == keys:
                out[-2 * k :] = [["g", "+", align(out[-2 * k : -k], out[-k:])]]
                break
    return out


def align(a: list, b: list) -> list:
    """The least general list of nodes of this kind that covers both."""
    keys_a, keys_b = [*map(_key, a)], [*map(_key, b)]
    if keys_a == keys_b:
        return [_unite(x, y) for x, y in zip(a, b)]
    from difflib import SequenceMatcher

    def opcodes():
        head, tail, least = 0, 0, min(len(a), len(b))
        if max(len(a), len(b)) > LONGEST:  # what begins and ends alike, then stretch by stretch, so that time stays bounded
            while head < least and keys_a[head] == keys_b[head]:
                head += 1
            while tail < least - head and keys_a[-1 - tail] == keys_b[-1 - tail]:
                tail += 1
        end_a, end_b = len(a) - tail, len(b) - tail
        yield "equal", 0, head, 0, head
        for at in range(0, max(end_a, end_b) - head, LONGEST):
            i, k = min(head + at, end_a), min(head + at, end_b)
            for op, *x in SequenceMatcher(None, keys_a[i : min(i + LONGEST, end_a)], keys_b[k : min(k + LONGEST, end_b)], autojunk=False).get_opcodes():
                yield op, x[0] + i, x[1] + i, x[2] + k, x[3] + k
        yield "equal", end_a, len(a), end_b, len(b)

    out: list = []
    for op, i, j, k, m in opcodes():
        if op == "equal":
            out += [_unite(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [["s"] if n[0] in "xs" else _with(n, _quantity(n[2 if n[0] == "e" else 1], "?")) for n in (*a[i:j], *b[k:m])]
    out = fold(out)
    if len(out) > LONGEST:  # one that comes again is optional again, so no text becomes fixed by this
        out = [n for n in out if n[0] in "xs" or n[-2] not in "?*"]
    return out


def fixed_texts(nodes: list, path: str = "") -> set[tuple[str, str]]:
    """(path, text) of what the wrapper holds fixed on every page: all else is in slots, optional or repeated groups."""
    out: set[tuple[str, str]] = set()
    for n in nodes:
        if n[0] == "x":
            out.add((path, n[1]))
        elif n[0] == "g" and n[1] not in "?*":
            out |= fixed_texts(n[2], path)
        elif n[0] == "e" and n[2] not in "?*":
            name = n[1].partition(".")[0]
            out |= fixed_texts(n[3], path if name in INLINE else f"{path}/{name}".lstrip("/"))
    return out


def texts_of_site(wrapper: list, page: list) -> set[int]:
    """Numbers of the texts of a page's tree that stand where the wrapper has the same text fixed.

    Siblings are matched from left to right. Neighbours in a wrapper never have one key, so which node a sibling belongs to is
    seen from its key: it is that of the node at hand, which repeats while it may, or of the next one that has this key.
    """
    out: set[int] = set()

    def one(node: list, item: list, required: bool) -> None:
        if node[0] == "e":
            siblings(node[3], item[3], required and node[2] not in "?*")
        elif node[0] == "x" and required and node[1] == item[1]:
            out.add(item[2])

    def fits(node: list, items: list, at: int) -> bool:
        if node[0] == "g":
            first = next((n for n in node[2] if n[0] in "xs" or n[-2] not in "?*"), node[2][0])
            return any(fits(n, items, at) for n in (node[2][0], first))
        return (items[at][0] == "x") if node[0] in "xs" else items[at][0] == "e" and items[at][1] == node[1]

    def group(node: list, items: list, at: int, required: bool) -> int:
        """The place after as many turns of the group as there are."""
        while at < len(items) and fits(node, items, at):
            before = at
            at = through(node[2], items, at, required and node[1] not in "?*")
            if at == before:
                break
        return at

    def through(nodes: list, items: list, at: int, required: bool) -> int:
        """The place after one turn of these nodes."""
        for node in nodes:
            if at >= len(items):
                break
            if node[0] == "g":
                at = group(node, items, at, required)
            elif fits(node, items, at):
                many = node[0] in "xs" or node[2] in "+*"
                run = at + 1
                while many and run < len(items) and fits(node, items, run):
                    run += 1
                if node[0] == "e" or run == at + 1:  # several texts side by side are a slot
                    for item in items[at:run]:
                        one(node, item, required)
                at = run
        return at

    def siblings(nodes: list, items: list, required: bool) -> None:
        i = at = 0
        while at < len(items):
            k = next((k for k in range(i, len(nodes)) if fits(nodes[k], items, at)), None)
            if k is None:  # nothing of the wrapper: the page's own
                at += 1
                continue
            after = through(nodes[k : k + 1], items, at, required)
            at, i = (after, k + 1) if after > at else (at + 1, i)

    siblings(wrapper, page, True)
    return out


class Learner:
    """Wrappers of hosts, from pages one after another."""

    def __init__(self):
        self.wrappers: dict[str, list] = {}
        self.pages: dict[str, int] = {}
        self.kinds: dict[str, set[str]] = {}

    def add(self, host: str, nodes: list, pages: int, kinds: list[str]) -> None:
        old = self.wrappers.get(host)
        self.pages[host] = self.pages.get(host, 0) + pages
        self.kinds[host] = set(sorted(self.kinds.get(host, set()).union(kinds))[:DIFFERENT])
        if old is None:
            self.wrappers[host] = nodes
        elif old != nodes:
            self.wrappers[host] = align(old, nodes)

    def rows(self) -> list[tuple[str, int, str, str]]:
        return [(h, self.pages[h], ",".join(sorted(self.kinds[h])), json.dumps(w)) for h, w in self.wrappers.items()]


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_SCHEMA = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("kinds", pa.string()), ("wrapper", pa.string())])
_FIELDS = "host string, pages long, kinds string, wrapper string"


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, kinds, wrapper) of every host, from all pages; kinds: digests of up to DIFFERENT pages whose texts differ."""
    rows = pages.select(host(pages[url_col]).alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))

    def learn(batches):
        _deep()
        learner, nothing = Learner(), hashlib.blake2b(digest_size=16).digest()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for h, page in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    seen = hashlib.blake2b(digest_size=16)
                    nodes = shape(page, seen)
                    if seen.digest() != nothing:  # a page without text says nothing of its host
                        learner.add(h, nodes, 1, [seen.hexdigest()])
        found = learner.rows()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _SCHEMA)], schema=_SCHEMA)

    def merge(key, frame):
        import pandas as pd

        _deep()
        learner = Learner()
        frame = frame.sort_values(["pages", "wrapper"])
        for n, kinds, w in zip(frame["pages"], frame["kinds"], frame["wrapper"]):
            learner.add(key[0], json.loads(w), int(n), kinds.split(","))
        return pd.DataFrame(learner.rows(), columns=["host", "pages", "kinds", "wrapper"])

    parts = rows.mapInArrow(learn, _FIELDS)
    n = pages.rdd.getNumPartitions()
    while n > 1:  # a host has at most a wrapper for each partition
        n = -(-n // FAN_IN)
        parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper", "pages"), F.lit(n)).alias("part")).applyInPandas(merge, _FIELDS)
    return parts


def main_text(page: str, wrapper: list | None = None) -> str:
    """The page's main text; wrapper: that of its host, if it has one."""
    parts = [*tokens(page)]
    of_site = texts_of_site(wrapper, tree(parts)) if wrapper else set()
    kept = [b for b in blocks(parts, of_site) if not b[3]]
    marked = any(m for _, _, m, _ in kept)
    return "\n\n".join(t for _, t, m, _ in kept if m or not marked)


def _deep() -> None:
    """Wrappers nest to DEPTH elements and the groups between them; Python's own limit of 1,000 calls is less."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50 * DEPTH))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every page. The wrappers' fixed texts, a row for each host, are joined by host."""
    from .common import stored

    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    wrappers = stored(infer(pages, url_col, html_col), "wrappers")
    wrappers = wrappers.where(F.size(F.split("kinds", ",")) >= DIFFERENT).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    rows = pages.select(pages[id_col].cast("long").alias("__id"), pages[url_col].alias("__url"), host(pages[url_col]).alias("__host"), F.coalesce(pages[html_col], F.lit("")).alias("__html"))
    small = wrappers.agg(F.sum(F.length("__wrapper"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if small <= 32_000_000 else wrappers, "__host", "left").select("__id", "__url", "__wrapper", "__html")

    def run(batches):
        known: dict = {None: None}
        _deep()

        def of_rows(columns):
            texts = []
            for w, page in zip(columns[2], columns[3]):
                if w not in known:
                    if len(known) > 1000:
                        known.clear()
                        known[None] = None
                    wrapper = json.loads(w)
                    known[w] = wrapper if fixed_texts(wrapper) else None
                texts.append(main_text(page, known[w]))
            return columns[0], columns[1], texts

        return by_rows(batches, of_rows, schema)

    return joined.mapInArrow(run, "id long, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
