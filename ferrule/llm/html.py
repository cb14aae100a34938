"""Main text of web pages by wrappers, inferred per host as union-free regular expressions over token streams.

A page is a tree of elements and text slots.  A wrapper is such a tree with a sign on each node: once, optional,
repeated, or both.  It begins as a page whose repeated neighbours are folded together, and is aligned with one page
after another: nodes that match are aligned in turn; a node that only one side has becomes optional; neighbours that
match one another, also in groups of two or three, are folded into one that repeats; texts that differ become a slot,
equal texts stay a constant.  Alignment of two wrappers is the same step, so wrappers of parts of a host's pages are
merged in a tree: parts of about PART pages by their hash, then FAN parts at a time.  Pages and parts are taken in the
order of their hashes, so that the wrapper does not depend on how the table is dealt.  A wrapper keeps every child that
was seen, on however few pages: its size is that of what differs in a host's pages, of long texts only the digest.

The main text comes from the element to which the host's wrapper leads when, from the root on, the child with most of
the text that varies between pages and is no link is followed, as far as an article or main element.  Where it holds
such elements, the text is theirs, all of them in page order; where those outside of it hold more, the wrapper does not
fit the page and the text is that of all of them.  Boilerplate elements (by their tag, role or name) are left out.  Only a
page that neither fits the wrapper nor has an article loses the wrapper's constants, unless nothing else is left.
"""

from __future__ import annotations

import html
import marshal
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b
from itertools import groupby, islice
from math import ceil, isqrt
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shelf import Shelf, bounded_batches

#: Pages in a part of a host, about, and parts that are merged at once.
PART = 500
FAN = 64
#: Characters of a text from which on a wrapper holds the text's digest.
LONG = 80
#: Places of a label among an element's children from which on their mask is kept while children are aligned.
OFTEN = 32
#: Bytes of a wrapper in a row.
PIECE = 1 << 20
#: Levels of a page's tree.  As in browsers, what is nested deeper is put side by side.
DEEPEST = 100
#: Distinct pages that a constant must have been seen on to count as part of the template.
LEAST_PAGES = 5
#: Share of an element's varying text that a child must hold to be followed.
MOST_TEXT = 0.6

# Names of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold main text.
LEFT_OUT = frozenset("nav header footer aside form script style noscript template button select option input textarea iframe object embed svg canvas dialog menu title head audio video map".split())
#: Whole names in an element's class, id or role that say the same.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog footer "
    "form header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related "
    "replies respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets alert complementary contentinfo".split()
)
#: Those that say so only if all names of the element do: they are also words for parts of a text.
WEAK_NAMES = frozenset("alert banner dialog form header notice notices promotion related respond search share skip social widget".split())
#: Elements that an opening element of these names ends.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article section main body td th blockquote aside nav header footer form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("block", "children", "label", "name", "out")

    def __init__(self, name: str, label: str, out: bool):
        self.name, self.label, self.out, self.children = name, label, out, []
        self.block = self  # the element whose block its text is part of


def _names(attributes: str) -> tuple[str, bool]:
    """What tells elements of one name apart, and whether the attributes say boilerplate."""
    if not attributes or attributes.isspace():
        return "", False
    told, out = [], False
    for m in _NAMED.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            out = out or kind == "hidden"
            continue
        words = _WORD.findall(value)
        if kind == "itemprop":
            if "articlebody" in words:
                told.append("@body")
            continue
        said = LEFT_OUT_NAMES.intersection(names := value.split())
        out = out or bool(said - WEAK_NAMES) or bool(said and said.issuperset(names))
        if kind != "role" or "main" in words:
            told.append("#" + ".".join(sorted(words)))
    return "".join(told), out


def parse(page: str) -> Element:
    """The page as a tree; text is a str among the children, still with its white space, references decoded."""
    root = Element("#root", "#root", False)
    stack, opened, at, n = [root], Counter(), 0, len(page)
    flat: list[Element] = [root, root]  # the last block below the deepest level, and what stands for it

    def add(child: str | Element) -> None:
        """Below the deepest level the blocks' texts stand side by side; their elements are not kept."""
        if len(stack) <= DEEPEST:
            stack[-1].children.append(child)
        elif isinstance(child, str):
            block, above = stack[-1].block, stack[DEEPEST - 1].children
            if block is stack[DEEPEST - 1]:
                return above.append(child)
            if flat[0] is not block or not above or above[-1] is not flat[1]:
                flat[:] = block, Element("div", block.label, block.out)
                above.append(flat[1])
            flat[1].children.append(child)

    def text(a: int, b: int) -> None:
        if a < b:
            add(html.unescape(page[a:b]))

    def cut(i: int) -> None:
        opened.subtract(e.name for e in stack[i:])
        del stack[i:]

    def close(names: set[str]) -> None:
        """Ends the nearest open element of these names, within its scope, and inline elements inside of it."""
        if any(opened[name] > 0 for name in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    return cut(i)
                if stack[i].name in SCOPE:
                    return

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if opened[name] > 0:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in ENDS_P:
            close({"p"})
        if name in SAME:
            close(SAME[name])
        told, out = _names(m[3])
        e = Element(name, name + told, (out or name in LEFT_OUT) and name not in ("html", "body"))
        if len(stack) >= DEEPEST:
            e.out = e.out or stack[-1].out and len(stack) > DEEPEST
            if name in INLINE and not e.out:
                e.block = stack[-1].block
            if name == "br":
                add(" ")
        add(e)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "textarea" or name == "title":
                e.children.append(html.unescape(page[at : end.start() if end else n]))
            at = end.end() if end else n
        elif name not in VOID:  # also where it ends with a slash: HTML has no self-closing elements beyond the void ones
            stack.append(e)
            opened[name] += 1
    _keep_main(root)
    return root


def _keep_main(root: Element) -> None:
    """Takes back the mark of boilerplate from what holds the page's longest article or, without one, most of its text.

    Only marks by names, and those of forms, are taken back; text in links and in other marked tags does not count."""
    marked: list[tuple[Element, int]] = []
    best, best_chars = None, 0

    def walk(e: Element, link: bool, above: list[Element]) -> int:
        nonlocal best, best_chars
        chars, here = 0, [*above, e] if e.out else above
        for c in e.children:
            if isinstance(c, str):
                chars += 0 if link else len(c.strip())
            elif c.name not in LEFT_OUT or c.name == "form":
                chars += walk(c, link or c.name == "a", here)
        if chars > best_chars and _says_article(e.label):
            best, best_chars = here, chars
        if e.out:
            marked.append((e, chars))
        return chars

    if next(_marked(root), None) is None:
        return
    total = walk(root, False, [])
    for e in best if best is not None else [e for e, chars in marked if chars and chars >= MOST_TEXT * total]:
        e.out = False


def _marked(e: Element) -> Iterator[Element]:
    """Elements whose mark may be taken back."""
    todo = [e]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Element) and (c.name not in LEFT_OUT or c.name == "form"):
                if c.out:
                    yield c
                todo.append(c)


# A wrapper's node: [label, least (0 or 1), repeats (bool), pages, varying characters, children or None, constant].
# A text slot has the label "#", no children, and its constant text (as _brief gives it) or None.  The children of a node
# that other pages lack are packed as bytes until they are needed, a fraction of the lists' size.
LABEL, LEAST, MANY, PAGES, MASS, KIDS, CONST = range(7)


def _flat(e: Element, out: list, link: bool) -> None:
    for c in e.children:
        if isinstance(c, str):
            c = _SPACE.sub(" ", c).strip()
            if c:
                if out and out[-1][LABEL] == "#":
                    out[-1][CONST] += " " + c
                    out[-1][MASS] += 0 if link else len(c)
                else:
                    out.append(["#", 1, False, 1, 0 if link else len(c), None, c])
        elif c.name in INLINE:
            _flat(c, out, link or c.name == "a")
        elif c.name not in RAW:
            kids = _kids(c, link)
            out.append([c.label, 1, False, 1, 0 if c.out else sum(k[MASS] for k in kids), kids, None])


def _brief(text: str) -> str:
    """A text, or for a long one what stands for it: a line break, which no text holds, and its digest."""
    return text if len(text) < LONG else "\n" + blake2b(text.encode(errors="surrogatepass"), digest_size=16).hexdigest()


def _kids(e: Element, link: bool) -> list:
    kids: list = []
    _flat(e, kids, link)
    for k in kids:
        if k[KIDS] is None:
            k[CONST] = _brief(k[CONST])
    return fold(kids)


def wrapper(page: str) -> list:
    """A page as the wrapper of itself."""
    kids = _kids(parse(page), False)
    return ["#root", 1, False, 1, sum(k[MASS] for k in kids), kids, None]


def _same(a: list, b: list) -> bool:
    return a[LABEL] == b[LABEL]


def _open(node: list) -> list | None:
    kids = node[KIDS]
    return marshal.loads(kids) if isinstance(kids, bytes) else kids


def _inside(node: list, out: set[str]) -> set[str]:
    for k in _open(node) or ():
        if k[KIDS] is not None:
            out.add(k[LABEL])
            _inside(k, out)
    return out


def _alike(a: list, b: list) -> bool:
    """Whether neighbours that match are of one kind: they hold no elements, or some of the same."""
    if not _same(a, b):
        return False
    x, y = _inside(a, set()), _inside(b, set())
    return 4 * len(x & y) >= len(x | y)


def fold(kids: list) -> list:
    """Neighbouring groups of one to three nodes that match the group before them become one that repeats."""
    for width in (1, 2, 3):
        if len(kids) < 2 * width:
            break
        labels = [k[LABEL] for k in kids]
        equal = "".join("01"[x] for x in map(eq, labels, islice(labels, width, None)))
        if "1" * width not in equal:  # no group's labels are those of the one before it
            continue
        out: list = []
        for k in kids:
            out.append(k)
            tail = len(out) - 2 * width
            if tail >= 0 and all(_same(out[tail + i], out[tail + width + i]) for i in range(width)) and all(_alike(out[tail + i], out[tail + width + i]) for i in range(width)) and (width == 1 or any(x[LABEL] != "#" for x in out[tail : tail + width])):
                last = out[tail + width :]
                del out[tail + width :]
                for i, x in enumerate(last):
                    out[tail + i] = join(out[tail + i], x, within=True)
        kids = out
    return kids


def join(a: list, b: list, within: bool = False) -> list:
    """One node for two that match: of different pages, or neighbours within one."""
    kids = None if a[KIDS] is None else align(_open(a), _open(b), within)
    constant = a[CONST] if a[CONST] == b[CONST] and not within else None
    pages = max(a[PAGES], b[PAGES]) if within else a[PAGES] + b[PAGES]
    return [a[LABEL], min(a[LEAST], b[LEAST]) if not within else max(a[LEAST], b[LEAST]), within or a[MANY] or b[MANY], pages, a[MASS] + b[MASS], kids, constant]


def _optional(nodes: list) -> Iterator[list]:
    return (x if not x[LEAST] else [x[LABEL], 0, *x[MANY:KIDS], marshal.dumps(x[KIDS]) if x[KIDS] else x[KIDS], x[CONST]] for x in nodes)


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence.

    Labels that only one side has cannot match and are left out first.  For the others, a row of bits for each position j
    of y says where in x the subsequence of x from there and y from j would lose nothing without that element (Hyyro's
    bit-vector algorithm, from the end).  Some rows are kept and those between computed again, so that the memory is
    about len(x) * sqrt(len(y)) / 4 bytes and the time len(x) * len(y) / 64 steps.
    """
    both = set(x).intersection(y)
    at, to = ([i for i, k in enumerate(z) if k in both] for z in (x, y))
    n, m = len(at), len(to)
    places: dict[str, list[int]] = {}
    for p, i in enumerate(reversed(at)):
        places.setdefault(x[i], []).append(p)
    masks = {k: _mask(ps) for k, ps in places.items() if len(ps) >= OFTEN}
    full = (1 << n) - 1
    size = n // 8 + 1

    def before(row: int, j: int) -> int:
        k = y[to[j]]
        u = row & (masks[k] if k in masks else _mask(places[k]))
        return (row + u | row - u) & full

    step = isqrt(m) + 1
    row, marks = full, {m: full}
    for j in range(m - 1, -1, -1):
        row = before(row, j)
        if j % step == 0:
            marks[j] = row
    found, i = [], 0
    for start in range(0, m, step):
        end = min(start + step, m)
        rows = [marks[end]]
        for j in range(end - 1, start - 1, -1):
            rows.append(before(rows[-1], j))
        for j in range(start, end):
            row, k = rows[end - j], y[to[j]]
            # past what stands only in y, equal labels do not match at once: the last of them that loses nothing does
            past = to[j] > (to[j - 1] + 1 if j else 0)
            if past or x[at[i]] != k:
                spare = row.to_bytes(size, "little")
                while i < n and (past or x[at[i]] != k) and spare[(n - 1 - i) >> 3] >> ((n - 1 - i) & 7) & 1:
                    i += 1
            if i < n and x[at[i]] == k:
                found.append((at[i], to[j]))
                i += 1
            if i == n:
                return found
    return found


def _mask(places: list[int]) -> int:
    bits = bytearray(max(places) // 8 + 1)
    for p in places:
        bits[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(bits, "little")


def align(a: list, b: list, within: bool = False) -> list:
    """The children of two matching nodes, by their longest common subsequence of labels; the rest is optional."""
    if len(a) == len(b) and all(map(_same, a, b)):
        return [join(x, y, within) for x, y in zip(a, b, strict=True)]
    out: list = []
    i = j = 0
    for x, y in _matches([k[LABEL] for k in a], [k[LABEL] for k in b]):
        out += *_optional(a[i:x]), *_optional(b[j:y]), join(a[x], b[y], within)
        i, j = x + 1, y + 1
    return fold([*out, *_optional(a[i:]), *_optional(b[j:])])


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags and slots."""
    sign = ("" if node[LEAST] else "?") if not node[MANY] else ("+" if node[LEAST] else "*")
    if node[KIDS] is None:
        return (node[CONST].strip() if node[CONST] is not None else "#TEXT") + sign
    inner = " ".join(map(expression, _open(node)))
    return f"(<{node[LABEL]}> {inner} </>){sign}" if inner else f"(<{node[LABEL]}></>){sign}"


def _heads(node: list) -> bool:
    """Whether the node holds a heading, there on all pages, that differs between them."""
    if node[KIDS] is None or not node[LEAST] or node[MANY] or not node[MASS]:
        return False
    if node[LABEL].split("#")[0] in ("h1", "h2"):
        return any(k[KIDS] is None and k[CONST] is None for k in _open(node))
    return any(map(_heads, _open(node)))


def main_path(node: list) -> list[str]:
    """Labels from the root to the element with the main text."""
    path = []
    while True:
        inner = _open(node) or []
        kids = [k for k in inner if k[KIDS] is not None]
        total = sum(k[MASS] for k in inner)
        best = max(kids, key=lambda k: k[MASS], default=None)
        # a repeated element is a paragraph or an item of the main text, not what holds it
        if best is None or best[MANY] or best[MASS] < MOST_TEXT * total or best[MASS] == 0 or best[LABEL].split("#")[0] in ("p", "h1", "pre", "blockquote"):
            return path
        # nor is what follows a heading of its own the whole text
        if any(_heads(k) for k in inner[: next(i for i, k in enumerate(inner) if k is best)]):
            return path
        path.append(best[LABEL])
        if _says_article(best[LABEL]):
            return path
        node = best


def constants(tree: list) -> list[str]:
    """Texts (as _brief gives them) that are the same on most of a host's distinct pages and stand outside of the element with the main text."""

    def found(node: list, path: list[str] | None) -> list[str]:
        """The path leads to the element with the main text; it is None beside the path."""
        # what is inside of a node stands on no more pages than the node
        if path == [] or node[PAGES] < LEAST_PAGES or 2 * node[PAGES] <= tree[PAGES]:
            return []
        if node[KIDS] is None:
            return [node[CONST]] if node[CONST] is not None else []
        inner = _open(node)
        next_ = max((k for k in inner if k[LABEL] == path[0] and k[KIDS] is not None), key=lambda k: k[MASS]) if path else None
        return [c for k in inner for c in found(k, path[1:] if k is next_ else None)]

    return found(tree, main_path(tree))


def _blocks(e: Element, out: list[list[str]], drop: frozenset[str]) -> None:
    """Adds the blocks of an element's text; the last one is open."""
    for c in e.children:
        if isinstance(c, str):
            out[-1].append(c)
        elif c.out:
            if c.name not in INLINE:
                out.append([])
        elif c.name == "br":
            out[-1].append(" ")
        elif c.name in INLINE:
            _blocks(c, out, drop)
        elif c.name not in RAW:
            out.append([])
            _blocks(c, out, drop)
            out.append([])


def text_of(elements: list[Element], drop: frozenset[str] = frozenset()) -> str:
    out: list[list[str]] = [[]]
    for e in elements:
        _blocks(e, out, drop)
        out.append([])
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in out)
    return "\n".join(x for x in lines if x and not (drop and _brief(x) in drop))


def _says_article(label: str) -> bool:
    return label.split("#")[0].split("@")[0] in ("article", "main") or "@body" in label or label in ("div#main", "section#main")


def _articles(e: Element, found: list[Element]) -> None:
    """The outermost elements that say they hold an article, in page order."""
    for c in e.children:
        if isinstance(c, Element) and not c.out:
            if _says_article(c.label):
                found.append(c)
            else:
                _articles(c, found)


def _find(e: Element, path: list[str]) -> Element | None:
    """The element that the path leads to; of several with one label, that with most text."""
    for label in path:
        found = [c for c in _elements(e) if c.label == label]
        if not found:
            return None
        e = max(found, key=_chars) if len(found) > 1 else found[0]
    return e


def _chars(e: Element) -> int:
    """Characters of text that are in no link and in nothing left out."""
    if e.out or e.name == "a":
        return 0
    return sum(len(c.strip()) if isinstance(c, str) else _chars(c) for c in e.children)


def _elements(e: Element) -> Iterator[Element]:
    """Element children, also those inside inline elements."""
    for c in e.children:
        if isinstance(c, Element):
            if c.name in INLINE:
                yield from _elements(c)
            else:
                yield c


def main_text(page: str, path: list[str] | None = None, fixed: list[str] | None = None) -> str:
    """The page's main text; path and fixed are what its host's wrapper says."""
    root = parse(page)
    articles: list[Element] = []
    _articles(root, articles)
    drop = frozenset(fixed or ())
    e = _find(root, path) if path else None
    if e is not None and not e.out:
        inside: list[Element] = []
        if _says_article(e.label):
            # its like beside it are parts of the same text
            inside = [a for a in articles if a is e or a.label == e.label] or [e]
        else:
            _articles(e, inside)
        text = text_of(inside or [e])
        outside = text_of([a for a in articles if not any(a is b for b in inside)])
        if text and len(text) >= len(outside):
            return text
    return text_of(articles) or text_of([root], drop) or text_of([root])


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


Found = Iterator[tuple[str, int, list]]  # host, part and wrapper


def _pieces(found: Found) -> Iterator[pa.RecordBatch]:
    """Wrappers as rows: their bytes from ``at`` on, as the JVM should hold no large rows."""

    def batch() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["host", "part", "at", "wrapper"])

    rows, size = [], 0
    for host, part, tree in found:
        held = marshal.dumps(tree)
        for at in range(0, len(held), PIECE):
            rows.append((host, part, at, held[at : at + PIECE]))
            size += len(rows[-1][-1])
            if size >= PIECE:
                yield batch()
                rows, size = [], 0
    yield batch()


def _whole(batches: Iterator[pa.RecordBatch]) -> Found:
    """Wrappers of rows that are sorted by host, part and at."""
    now, held = None, bytearray()
    for batch in batches:
        for host, part, piece in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper")), strict=True):
            if (host, part) != now:
                if now is not None:
                    tree, held = marshal.loads(held), bytearray()
                    yield *now, tree
                now = host, part
            held += piece
    if now is not None:
        tree, held = marshal.loads(held), bytearray()
        yield *now, tree


def wrappers(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", finish: Callable[[Found], Iterator[pa.RecordBatch]] = _pieces, schema: str = "host string, part int, at long, wrapper binary"
) -> DataFrame:
    """What ``finish`` makes of the wrappers of the hosts, inferred from their distinct pages; without it, marshal's bytes
    in rows of at most PIECE."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Found:
        now, page, held = None, None, None
        for batch in batches:
            for *key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key != now:
                    if now is not None:
                        yield *now, held
                    now, page, held = key, text, wrapper(text)
                elif text != page:
                    page, held = text, join(held, wrapper(text))
        if now is not None:
            yield *now, held

    def merge(batches: Iterator[pa.RecordBatch]) -> Found:
        for (host, part), below in groupby(_whole(batches), lambda x: (x[0], x[1] // fan)):
            yield host, part, reduce(join, (tree for *_, tree in below))

    def step(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Found]) -> DataFrame:
        if parts > 1:
            return rows.mapInArrow(lambda batches: _pieces(run(batches)), "host string, part int, at long, wrapper binary")
        return rows.mapInArrow(lambda batches: finish(run(batches)), schema)

    fan = FAN
    rows = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    parts = ceil(rows.count() / PART) or 1
    rows = rows.withColumn("h", F.xxhash64("html")).select("host", F.pmod("h", F.lit(parts)).cast("int").alias("part"), "h", "html")
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "h", "html")
    found = step(rows, infer)
    while parts > 1:
        parts = ceil(parts / fan)
        found = step(found.repartition("host", F.floor(F.col("part") / fan)).sortWithinPartitions("host", "part", "at"), merge)
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page: its main text and the number of its code points.

    A null or empty page has an empty text.  Pages without a host in their URL share one wrapper.  Each row is
    extracted by itself, so repeated rows give repeated rows; an empty table gives no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)

    def learn(found: Found) -> Iterator[pa.RecordBatch]:
        for host, _, tree in found:
            yield pa.RecordBatch.from_arrays([pa.array([host]), *(pa.array([x], pa.list_(pa.string())) for x in (main_path(tree), constants(tree)))], names=["host", "path", "fixed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", path, fixed) for p, path, fixed in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    hosts = Shelf(spark, "html").put(wrappers(pages, url_col, html_col, learn, "host string, path array<string>, fixed array<string>"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), _host(F.col(url_col)).alias("host"))
    # a frequent host is a hot key of this join, which adaptive execution splits; its other side has a row a host
    rows = rows.join(hosts, "host", "left").select("id", "url", "html", "path", "fixed")
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
