"""A small HTML tree and a CSS selector matcher, on the standard library's tokenizer.

The tree repairs what browsers repair most: void elements, elements whose end tags may be left out (p, li, dt, dd,
option, table parts), stray end tags, and unclosed elements at the end. Script and style are raw text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html li link main meta nav ol option optgroup p pre section summary table tbody td tfoot th thead title tr ul video".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main nav ol p pre "
    "section table ul".split()
)
#: An opening tag closes open ones of these names, up to the nearest of the fences.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        """Readable text: runs of blanks are one space, and block elements stand apart."""
        out: list[str] = []

        def put(s: str) -> None:
            if s == " " and (not out or out[-1].endswith(" ")):
                return
            out.append(s)

        stack: list[Node | str | None] = [self]
        while stack:
            item = stack.pop()
            if item is None:
                continue
            if isinstance(item, str):
                for i, part in enumerate(re.split(r"[ \t\n\f\r]+", item)):
                    if i:
                        put(" ")
                    if part:
                        put(part)
            elif item.tag not in ("script", "style") or item is self:
                if item.tag in BLOCK:
                    put(" ")
                    stack.append(" ")
                stack.extend(item.children[::-1])
        return "".join(out).strip(" ")

    def outer(self) -> str:
        attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{self.inner()}</{self.tag}>")

    def inner(self) -> str:
        raw = self.tag in ("script", "style")
        return "".join(c.outer() if isinstance(c, Node) else c if raw else entities.escape(c, quote=False) for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def _close_to(self, node: Node) -> None:
        self.at = node.parent or self.root

    def _close_open(self, names: set[str] | frozenset[str], fences: set[str]) -> None:
        node, last = self.at, None
        while node is not self.root and node.tag not in fences:
            if node.tag in names:
                last = node
            node = node.parent
        if last is not None:
            self._close_to(last)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close_open({"p"}, {"button", "td", "th", "table", "div", "section", "article"} if tag != "p" else {"button", "td", "th", "table", "div"})
        if tag in ENDS:
            self._close_open(*ENDS[tag])
        if tag in ("html", "body") and (same := next((n for n in self.root.walk() if n.tag == tag), None)):
            for k, v in attrs:
                same.attrs.setdefault(k, v or "")
            return
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "use", "circle", "rect", "g", "line"):
            self._close_to(self.at)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            if node.tag in ("table",) and tag in ("p", "div", "span", "b", "i", "a"):
                return  # a stray end tag inside a table closes nothing outside
            node = node.parent
        if node is not self.root:
            self._close_to(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# -- selectors -----------------------------------------------------------------

_NAME = r"[\w\-\u00a0-\uffff]+"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:\-]+)\s*(?:(?P<op>[~^$*|!]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"
    rf"|:(?P<pseudo>[\w\-]+)(?P<open>\()?"
)


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class _Test:
    kind: str
    name: str = ""
    value: object = None


@dataclass(frozen=True)
class _Compound:
    joint: str  # how it hangs on the one before: "", " ", ">", "+", "~"
    tests: tuple[_Test, ...]


def _nth(text: str) -> tuple[int, int]:
    t = text.replace(" ", "").lower()
    if t in ("odd", "even"):
        return 2, int(t == "odd")
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", t):
        a = m[1]
        return (int(a) if a not in ("", "+", "-") else int(a + "1")), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", t):
        return 0, int(t)
    raise SelectorError(f"not a position: {text}")


def _inside(s: str, at: int) -> tuple[str, int]:
    """The text up to the bracket that closes the one before at, and the place behind it."""
    depth, i, quote = 1, at, ""
    while i < len(s):
        c = s[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return s[at:i], i + 1
        i += 1
    raise SelectorError(f"unclosed bracket: {s}")


@lru_cache(maxsize=1024)
def compile_selector(selector: str) -> tuple[tuple[_Compound, ...], ...]:
    """A selector's alternatives, each a chain of compounds."""
    s, i, groups, chain, tests, joint, open_ = selector.strip(), 0, [], [], [], "", False
    if not s:
        raise SelectorError("empty selector")

    def flush() -> None:
        nonlocal tests
        if tests:
            chain.append(_Compound(joint, tuple(tests)))
            tests = []

    while i < len(s):
        if m := re.match(r"\s*([>+~,])\s*|\s+", s[i:]):
            flush()
            if open_ or not chain and m[1] != ">":
                raise SelectorError(f"nothing before {m[0]!r}: {selector}")
            open_ = m[1] is not None
            joint = m[1] or " "
            if joint == ",":
                groups.append(tuple(chain))
                chain, joint = [], ""
            i += m.end()
            continue
        m = _PART.match(s, i)
        if not m or m["tag"] and tests:
            raise SelectorError(f"cannot read {s[i:]!r}")
        i, open_ = m.end(), False
        if m["tag"]:
            tests.append(_Test("tag", m["tag"].lower()))
        elif m["cls"]:
            tests.append(_Test("class", m["cls"].lower()))
        elif m["id"]:
            tests.append(_Test("id", m["id"]))
        elif m["attr"]:
            value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), None)
            tests.append(_Test("attr", m["attr"].lower(), (m["op"], value)))
        else:
            name, inner = m["pseudo"].lower(), None
            if m["open"]:
                inner, i = _inside(s, i)
            if name.startswith("nth-"):
                tests.append(_Test(name, value=_nth(inner or "")))
            elif name in ("not", "is", "where", "has"):
                tests.append(_Test("is" if name == "where" else name, value=compile_selector(inner or "")))
            elif name in ("contains", "containsown"):
                tests.append(_Test(name, value=(inner or "").strip().strip("\"'").lower()))
            elif name in ("eq", "lt", "gt"):
                tests.append(_Test(name, value=int(inner or "")))
            elif name in ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "empty", "root"):
                tests.append(_Test(name))
            else:
                raise SelectorError(f"unknown :{name}")
    flush()
    if open_ or not chain:
        raise SelectorError(f"nothing after the last joint: {selector}")
    return (*groups, tuple(chain))


def _place(node: Node, same: bool, back: bool) -> int:
    of = [e for e in node.parent.elements() if not same or e.tag == node.tag] if node.parent else [node]
    i = next(k for k, e in enumerate(of) if e is node)
    return len(of) - i if back else i + 1


def _passes(node: Node, t: _Test) -> bool:
    k = t.kind
    if k == "tag":
        return t.name in ("*", node.tag)
    if k == "class":
        return t.name in node.attrs.get("class", "").lower().split()
    if k == "id":
        return node.attrs.get("id") == t.name
    if k == "attr":
        op, want = t.value
        have = node.attrs.get(t.name)
        if op is None:
            return have is not None
        if op == "!=":
            return have != want
        if have is None:
            return False
        have, want = have.lower(), (want or "").lower()
        return {
            "=": have == want, "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have,
            "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"),
        }[op]
    if k == "not":
        return not any(_matches(node, c) for c in t.value)
    if k == "is":
        return any(_matches(node, c) for c in t.value)
    if k == "has":
        return any(_matches(n, c) for n in node.walk() for c in t.value)
    if k == "contains":
        return t.value in node.text().lower()
    if k == "containsown":
        return t.value in " ".join(c for c in node.children if isinstance(c, str)).lower()
    if k == "empty":
        return not any(isinstance(c, Node) or c for c in node.children)
    if k == "root":
        return node.parent is not None and node.parent.tag == "#document"
    if k in ("eq", "lt", "gt"):
        i = _place(node, False, False) - 1
        return {"eq": i == t.value, "lt": i < t.value, "gt": i > t.value}[k]
    if k.startswith("nth-"):
        a, b = t.value
        d = _place(node, k.endswith("of-type"), "last" in k) - b
        return d == 0 if a == 0 else d % a == 0 and d // a >= 0
    same = k.endswith("of-type")
    first, last = _place(node, same, False) == 1, _place(node, same, True) == 1
    return {"first": first, "last": last, "only": first and last}[k.split("-")[0]]


def _matches(node: Node, chain: tuple[_Compound, ...], upto: Node | None = None) -> bool:
    """Does the node end the chain? upto: the node that a chain that starts with a joint hangs on."""
    last = chain[-1]
    if node.tag == "#document" or not all(_passes(node, t) for t in last.tests):
        return False
    rest, joint = chain[:-1], last.joint
    if not rest:
        return joint != ">" or (node.parent is upto if upto is not None else node.parent is not None)
    if joint == ">":
        return node.parent is not None and _matches(node.parent, rest, upto)
    if joint == " ":
        up = node.parent
        while up is not None:
            if _matches(up, rest, upto):
                return True
            up = up.parent
        return False
    before = []
    for e in node.parent.elements() if node.parent else []:
        if e is node:
            break
        before.append(e)
    return any(_matches(e, rest, upto) for e in (before[-1:] if joint == "+" else before))


def select(node: Node, selector: str) -> list[Node]:
    """Elements at or below the node that match, in document order."""
    chains = compile_selector(selector)
    own = [node] if node.tag != "#document" else []
    return [n for n in (*own, *node.walk()) if any(_matches(n, c, node) for c in chains)]
