"""Small helpers on HTML: a block tree of a page, simple tree matching, and the text of what is kept of it."""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator
from functools import lru_cache

#: Fixed values of the HTML standard: elements that start a block, that have no content, that hold no text for a reader.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select button noframes xmp".split())
#: Start tag -> the open elements it ends, up to the nearest of the third.
ENDS = {x: (frozenset(["p"]), frozenset("article aside body div footer form header li main nav section td th".split())) for x in BLOCK - {"option", "optgroup", "html", "body", "head", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}}
ENDS |= {"li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])), "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"]))}
ENDS |= {x: (frozenset(["dd", "dt", "p"]), frozenset(["dl"])) for x in ("dd", "dt")} | {x: (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])) for x in ("td", "th")}
#: Elements, roles and words of class or id that mark what isn't the article.
ASIDE = frozenset("nav header footer aside form menu dialog search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|respond|replies|cookies?|consent|gdpr|notice|notices|alert|newsletter|subscribe|signup|promo\w*|sponsor\w*|share|sharing|social|sidebar|side|widget|related|recommend\w*|popular|trending|nav|navbar|navigation|menu|footer|header|masthead|topbar|toolbar|pagination|pager|popup|modal|overlay|login|search|tags|disclaimer|copyright)(?:$|[\s_-])", re.I)
#: Classes by which an article is a reader's comment, whole words.
COMMENT = re.compile(r"(?:^|\s)(?:comments?|comment-?(?:body|content|entry|item|list)|reply|replies|respond)(?:$|\s)", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    """A block. parts: its texts and its child blocks in order; links: characters of its own text inside links."""

    __slots__ = ("aside", "key", "links", "parent", "parts", "tag")

    def __init__(self, tag: str, key: str, aside: bool, parent: Node | None):
        self.tag, self.key, self.aside, self.parent, self.parts, self.links = tag, key, aside, parent, [], 0

    def children(self) -> list[Node]:
        return [x for x in self.parts if type(x) is not str]

    def own(self) -> str:
        return " ".join("".join([x if type(x) is str else " " for x in self.parts]).split())


@lru_cache(maxsize=4096)
def judged(tag: str, attributes: str) -> tuple[str, bool]:
    """A label of a start tag by which nodes are matched, and whether it marks what isn't the article."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    name = f"{found.get('class', '')} {found.get('id', '')}"
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    aside = tag in ASIDE or found.get("role", "").lower() in ROLES or hidden or (tag not in ("body", "html", "article", "main") and bool(MARKS.search(name))) or (tag == "article" and bool(COMMENT.search(name)))
    return f"{tag}.{' '.join(re.sub(r'[0-9]+', '0', name).split())}", aside


def parse(text: str) -> Node:
    """The block tree. Unclosed and stray tags are taken as browsers take them, roughly; texts of scripts, styles, controls
    and the like are left out."""
    root = here = Node("", "", False, None)
    stack: list[tuple[str, Node]] = [("", root)]  # open elements and the block that each is in
    at, end, link = 0, len(text), 0

    def put(piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        here.parts.append(piece)
        if link:
            here.links += len(piece)

    for m in iter(lambda: TOKEN.search(text, at), None):
        if m.start() > at:
            put(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, close = tag.lower(), m[1] or m[4]
        if close:
            if any(t == tag for t, _ in reversed(stack)):
                while stack[-1][0] != tag:
                    link -= stack.pop()[0] == "a"
                stack.pop()
                link -= tag == "a"
                here = stack[-1][1]
            continue
        if tag in RAW:
            m = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(text, at)
            at = m.end() if m else end
            put(" ")
            continue
        if tag in ENDS:
            closing, stop = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in closing:
                    link -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    here = stack[-1][1]
        if tag in BLOCK:
            key, aside = judged(tag, m[3] or m[6] or "")
            if tag == "header" and any(t == "article" for t, _ in stack):  # an article's own heading
                aside = judged("div", m[3] or m[6] or "")[1]
            child = Node(tag, key, aside, here)
            here.parts.append(child)
            if tag not in VOID:
                here = child
                stack.append((tag, child))
        elif tag in VOID:
            put(" ")
        else:
            _, hidden = judged(tag, m[3] or m[6] or "")
            if hidden and tag != "a":  # an inline part that isn't the article's, as a block of its own
                child = Node(tag, f"{tag}.hidden", True, here)
                here.parts.append(child)
                here = child
                stack.append((tag, child))
            else:
                link += tag == "a"
                stack.append((tag, here))
    if at < end:
        put(text[at:])
    return root


def walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.children()))


def slots(node: Node) -> list[tuple[str, list[Node]]]:
    """Children, with childless ones of one label in a row as one slot."""
    out: list[tuple[str, list[Node]]] = []
    for c in node.children():
        leaf = not any(type(x) is not str for x in c.parts)
        if leaf and out and out[-1][0] == c.key:
            out[-1][1].append(c)
        else:
            out.append((c.key if leaf else f"{c.key} ", [c]))
    return out


def shapes(*roots: Node) -> tuple[dict[int, int], dict[int, int]]:
    """By id() of each node: a number that subtrees of the same labels share, and how many nodes it holds."""
    names: dict[tuple, int] = {}
    shape: dict[int, int] = {}
    size: dict[int, int] = {}
    for root in roots:
        for node in reversed(list(walk(root))):
            below = node.children()
            shape[id(node)] = names.setdefault((node.key, *[shape[id(c)] for c in below]), len(names))
            size[id(node)] = 1 + sum(size[id(c)] for c in below)
    return shape, size


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest number of pairs that keep order and parents, and the pairs. A row of childless
    nodes counts as many as both rows have. Nothing recurses, and only numbers are kept of what isn't on the best path;
    subtrees of one shape match whole, and so do those that both nodes begin with."""
    shape, size = shapes(a, b)
    known: dict[tuple[int, int], int] = {}  # by shapes

    def compare(a: Node, b: Node, path: list[tuple[Node, Node]] | None) -> Generator[tuple[Node, Node], int, int]:
        """How many pairs; it asks for those of inner nodes by yielding them. The best path's children go to ``path``."""
        x, y = slots(a), slots(b)
        total = begin = 0
        for (kx, nx), (ky, ny) in zip(x, y, strict=False):
            if kx != ky or len(nx) != len(ny) or shape[id(nx[0])] != shape[id(ny[0])]:
                break
            begin += 1
            total += size[id(nx[0])] * len(nx)
            if path is not None:
                path += zip(nx, ny, strict=True)
        x, y = x[begin:], y[begin:]
        row, steps = [0] * (len(y) + 1), []
        for kx, nx in x:
            above, row = row, [0] * (len(y) + 1)
            step = bytearray(len(y))  # 0: without x's, 1: without y's, 2: both
            for j, (ky, ny) in enumerate(y):
                w = max(row[j], above[j + 1])
                if kx.strip() == ky.strip():
                    if kx == ky and kx[-1] != " ":
                        found = min(len(nx), len(ny))
                    elif (s := shape[id(nx[0])]) == (t := shape[id(ny[0])]):
                        found = size[id(nx[0])]
                    elif (found := known.get((s, t))) is None:
                        found = known[s, t] = yield nx[0], ny[0]
                    w = max(w, above[j] + found)
                row[j + 1] = w
                step[j] = 0 if w == above[j + 1] else 1 if w == row[j] else 2
            if path is not None:
                steps.append(step)
        if path is not None:
            i, j, taken = len(x), len(y), []
            while i and j:
                step = steps[i - 1][j - 1]
                i, j = i - (step != 1), j - (step != 0)
                if step == 2:
                    nx, ny = x[i][1], y[j][1]
                    taken.append(list(zip(nx, ny, strict=False)))
            for some in reversed(taken):
                path += some
        return 1 + total + row[-1]

    def solve(a: Node, b: Node, path: list[tuple[Node, Node]]) -> int:
        stack, answer = [compare(a, b, path)], None
        while stack:
            try:
                ask = stack[-1].send(answer)
                stack.append(compare(*ask, None))
                answer = None
            except StopIteration as done:
                stack.pop()
                answer = done.value
        return answer

    pairs: list[tuple[Node, Node]] = []
    whole, todo = None, [(a, b)]
    while todo:
        m, n = todo.pop()
        if shape[id(m)] == shape[id(n)]:
            pairs += zip(walk(m), walk(n), strict=True)
            whole = size[id(m)] if whole is None else whole
        else:
            pairs.append((m, n))
            inner: list[tuple[Node, Node]] = []
            found = solve(m, n, inner)
            whole = found if whole is None else whole
            todo.extend(reversed(inner))
    return whole, pairs


def text_of(root: Node, leave: set[int]) -> str:
    """The blocks under a node in page order, one to a line; nodes marked as aside or in ``leave`` (by id()) are left out."""
    lines: list[str] = []
    current: list[str] = []

    def end_line() -> None:
        if line := " ".join("".join(current).split()):
            lines.append(line)
        current.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end_line()
        elif type(x) is str:
            current.append(x)
        elif x is not root and (x.aside or id(x) in leave):
            if x.tag in BLOCK:
                end_line()
        else:
            end_line()
            stack.append(None)
            stack.extend(reversed(x.parts))
    return "\n".join(lines)


def own_roots(page: Node) -> list[Node]:
    """Where the article is, by the page alone: its outermost articles, else the largest main, else a block whose name says
    content, else the body. What lies in a part marked as aside is none."""
    order, aside, size = list(walk(page)), {}, {}
    for node in order:
        aside[id(node)] = node.aside or (node.parent is not None and aside[id(node.parent)])
    for node in reversed(order):
        size[id(node)] = sum(len(x) if type(x) is str else size[id(x)] for x in node.parts)
    fine = [n for n in order if not aside[id(n)]]
    inner, articles = set(), []
    for node in order:
        if node.parent is not None and id(node.parent) in inner:
            inner.add(id(node))
        elif node.tag == "article" and not aside[id(node)]:
            inner.add(id(node))
            articles.append(node)
    if articles:
        return articles
    for test in (lambda n: n.tag == "main" or n.key.startswith("main"), lambda n: n.tag in ("div", "section", "td") and CONTENT.search(n.key.partition(".")[2]) is not None):
        if found := [n for n in fine if test(n)]:
            return [max(found, key=lambda n: size[id(n)])]
    return [next((n for n in order if n.tag == "body"), page)]
