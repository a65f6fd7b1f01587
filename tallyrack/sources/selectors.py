"""CSS selectors compiled to programs over a numbered tree.

A selector becomes alternatives, each a chain of tests joined by combinators, and is matched from its last test back.
A node's numbers (its place in document order and that of its last descendant) tell ancestors from others, so a
selector walks no tree: candidates come from an index of the page's tags, classes and ids, the rest is per node and
remembered.  Programs are made once a worker and used on all pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .dom import Node, Tree

Test = Callable[["Page", "Node"], bool]
_NAME = r"(?:[-_a-zA-Z0-9\u0080-\U0010ffff]|\\[0-9a-fA-F]{1,6}\s?|\\.)+"
_TOKENS = re.compile(
    rf"""(?P<space>\s*(?P<comb>[>+~,])\s*|\s+)|(?P<hash>\#{_NAME})|(?P<cls>\.{_NAME})|(?P<pseudo>::?{_NAME})(?P<call>\()?|
    \[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<value>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|{_NAME})\s*(?P<flag>[iIsS])?\s*)?\]|
    (?P<tag>{_NAME}|\*)|(?P<close>\))""",
    re.X | re.S,
)
_NTH = re.compile(r"\s*(?:(?P<word>even|odd)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*", re.I)


class Page:
    """A tree with what selectors look up in it, and their answers so far."""

    def __init__(self, tree: Tree) -> None:
        self.tree = tree
        self.index: dict[str, list[Node]] = {}
        for n in tree.nodes:
            for key in (n.tag, *("." + c for c in set(n.attrs.get("class", "").split())), "#" + n.attrs.get("id", "")):
                self.index.setdefault(key, []).append(n)
        self.known: dict[tuple[int, int, int], bool] = {}
        self.places: dict[int, tuple[list[Node], dict[int, int]]] = {}

    def siblings(self, node: Node) -> tuple[list[Node], int]:
        """The elements that share a parent, and a node's place among them."""
        up = node.parent
        key = up.order if up.tag else 0
        if key not in self.places:
            own = [c for c in up.children if not isinstance(c, str)]
            self.places[key] = own, {c.order: i for i, c in enumerate(own)}
        own, place = self.places[key]
        return own, place[node.order]


def _unescape(name: str) -> str:
    return re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else m[2], name, flags=re.S)


class _Chain:
    """Tests of one compound selector, and how it is joined to the one before."""

    __slots__ = ("tests", "comb", "before", "key")

    def __init__(self, comb: str, before: _Chain | None) -> None:
        self.tests: list[Test] = []
        self.comb, self.before, self.key = comb, before, None


class Selector:
    """A compiled selector list."""

    def __init__(self, ends: list[_Chain]) -> None:
        self.ends = ends
        self.deep = any(c.before is not None and c.before.tests != [_SCOPE] for c in ends)

    def matches(self, page: Page, node: Node, scope: Node | None = None) -> bool:
        return any(self._match(page, node, end, scope) for end in self.ends)

    def _match(self, page: Page, node: Node, end: _Chain, scope: Node | None) -> bool:
        key = (node.order, id(end), scope.order if scope is not None else -1)
        if key not in page.known:
            page.known[key] = False  # for :has() that asks for itself
            page.known[key] = all(t(page, node) if t is not _SCOPE else scope is not None and node is scope for t in end.tests) and self._before(page, node, end, scope)
        return page.known[key]

    def _before(self, page: Page, node: Node, end: _Chain, scope: Node | None) -> bool:
        if end.before is None:
            return True
        if end.comb in " >":
            up = node.parent
            while up is not None and (up.tag or (up is scope and _SCOPE in end.before.tests)):
                if self._match(page, up, end.before, scope):
                    return True
                if end.comb == ">":
                    return False
                up = up.parent
            return False
        own, at = page.siblings(node)
        earlier = own[at - 1 : at] if end.comb == "+" else own[:at]
        return any(self._match(page, n, end.before, scope) for n in earlier if n is not node)

    def select(self, page: Page, scope: Node, most: int | None = None) -> list[Node]:
        """Matching descendants of a scope in document order, the first `most` of them."""
        found: dict[int, Node] = {}
        lo, hi = (scope.order, scope.end) if scope.tag else (0, len(page.tree.nodes))
        for end in self.ends:
            pool = page.index.get(end.key, []) if end.key else page.tree.nodes
            n = 0
            for node in pool:
                if lo < node.order <= hi and self._match(page, node, end, scope):
                    found[node.order] = node
                    n += 1
                    if n == most:
                        break
        return [found[k] for k in sorted(found)][:most]


def _SCOPE(page: Page, node: Node) -> bool:
    """:scope, which the program resolves."""
    return False


def _attribute(name: str, op: str | None, value: str, flag: str) -> Test:
    name = name.lower()
    fold = flag == "i" or (name == "type" and flag != "s")
    want = value.lower() if fold else value
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda v: True, "=": lambda v: v == want, "!=": lambda v: v != want, "~=": lambda v: bool(want) and not re.search(r"\s", want) and want in v.split(),
        "|=": lambda v: v == want or v.startswith(want + "-"), "^=": lambda v: bool(want) and v.startswith(want), "$=": lambda v: bool(want) and v.endswith(want), "*=": lambda v: bool(want) and want in v,
    }
    test = tests[op]

    def run(page: Page, node: Node) -> bool:
        v = node.attrs.get(name)
        if v is None:
            return op == "!="
        if name == "class":
            v = " ".join(v.split())
        return test(v.lower() if fold else v)

    return run


def _nth(text: str, kind: str) -> Test:
    """:nth-child() and its kin, with "of" a selector."""
    m = _NTH.match(text)
    of = re.fullmatch(r"of\s+(.+)", text[m.end() :].strip(), re.S) if m else None
    if not m or (text[m.end() :].strip() and not (of and "child" in kind)):
        raise ValueError(f"bad :{kind}({text})")
    if m["word"]:
        a, b = 2, int(m["word"].lower() == "odd")
    elif m["only"]:
        a, b = 0, int(m["only"])
    else:
        a = int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
        b = int((m["sign"] or "+") + (m["b"] or "0"))
    among = compiled(of[1]) if of else None

    def run(page: Page, node: Node) -> bool:
        own, at = page.siblings(node)
        if among is not None and not among.matches(page, node):
            return False
        side = own[at + 1 :] if "last" in kind else own[:at]
        k = 1 + sum(1 for n in side if ("type" not in kind or n.tag == node.tag) and (among is None or among.matches(page, n)))
        return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0

    return run


def _has(chains: list[tuple[str, Selector]]) -> Test:
    def run(page: Page, node: Node) -> bool:
        for comb, inner in chains:
            if comb in " >":
                pool = page.tree.nodes[node.order : node.end]
                if any((comb == " " or n.parent is node or inner.deep) and inner.matches(page, n, node) for n in pool):
                    return True
            else:
                own, at = page.siblings(node)
                later = own[at + 1 : at + 2] if comb == "+" else own[at + 1 :]
                pool = later if not inner.deep else [n for x in later for n in (x, *page.tree.nodes[x.order : x.end])]
                if any(inner.matches(page, n, node) for n in pool):
                    return True
        return False

    return run


def _only(of_type: bool) -> Test:
    def run(page: Page, node: Node) -> bool:
        own, _ = page.siblings(node)
        return sum(1 for n in own if not of_type or n.tag == node.tag) == 1

    return run


def _contains(words: list[str], own: bool) -> Test:
    def words_of(node: Node) -> str:
        return "".join(c if isinstance(c, str) else "" if own else words_of(c) for c in node.children)

    return lambda page, node: any(w in words_of(node) for w in words)


_INPUTS = ("input", "button", "select", "textarea", "option", "optgroup", "fieldset")
_PLAIN: dict[str, Test] = {
    "first-child": lambda p, n: p.siblings(n)[1] == 0, "last-child": lambda p, n: p.siblings(n)[1] == len(p.siblings(n)[0]) - 1, "only-child": _only(False), "only-of-type": _only(True),
    "empty": lambda p, n: not any(not isinstance(c, str) or c.strip() for c in n.children), "root": lambda p, n: not n.parent.tag and len(p.siblings(n)[0]) == 1 and not any(isinstance(c, str) and c.strip() for c in n.parent.children),
    "link": lambda p, n: n.tag in ("a", "area") and "href" in n.attrs, "any-link": lambda p, n: n.tag in ("a", "area") and "href" in n.attrs,
    "checked": lambda p, n: (n.tag == "input" and "checked" in n.attrs and n.attrs.get("type", "").lower() in ("checkbox", "radio")) or (n.tag == "option" and "selected" in n.attrs),
    "disabled": lambda p, n: n.tag in _INPUTS and "disabled" in n.attrs, "enabled": lambda p, n: n.tag in _INPUTS and "disabled" not in n.attrs,
    "scope": _SCOPE,
}
_NTH_WORDS = {"first-of-type": ("1", "nth-of-type"), "last-of-type": ("1", "nth-last-of-type")}
#: Of these nothing in a stored page is ever so.
_NEVER = ("hover", "active", "focus", "visited", "target", "focus-within", "focus-visible")


def _arguments(text: str, at: int) -> tuple[str, int]:
    """What stands between a call's brackets, and where it goes on."""
    depth, quote, k = 1, "", at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                return text[at:k], k + 1
        k += 1
    raise ValueError(f"bad selector: {text!r}")


def _pseudo(name: str, inner: str | None) -> Test:
    if inner is None:
        if name in _NTH_WORDS:
            return _nth(*_NTH_WORDS[name])
        if name in _NEVER:
            return lambda page, node: False
        if name in _PLAIN:
            return _PLAIN[name]
    elif name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        return _nth(inner, name)
    elif name in ("not", "is", "where", "matches", "any"):
        own = compiled(inner) if inner.strip() else Selector([])
        return (lambda page, node: not own.matches(page, node)) if name == "not" else (lambda page, node: own.matches(page, node))
    elif name == "has":
        return _has(_relative(inner))
    elif name in ("contains", "-soup-contains", "-soup-contains-own"):
        words = [_unescape(a or b or c) for a, b, c in re.findall(rf""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|({_NAME})""", inner, re.S)]
        return _contains(words, name.endswith("own"))
    raise ValueError(f"unknown :{name}")


def _relative(text: str) -> list[tuple[str, Selector]]:
    """The selectors of :has(), each with the combinator it begins with; chains that go on are bound to the asking node."""
    out = []
    for one in _split(text):
        m = re.match(r"\s*([>+~])?\s*", one)
        inner = compiled(":scope " + (m[1] or "") + " " + one[m.end() :]) if one[m.end() :].strip() else None
        if inner is None:
            raise ValueError(f"bad :has({text})")
        out.append((m[1] or " ", inner))
    return out


def _split(text: str) -> list[str]:
    parts, at, k = [], 0, 0
    while k < len(text):
        if text[k] in "([":
            _, k = _arguments(text, k + 1)
            continue
        if text[k] in "\"'":
            k = text.index(text[k], k + 1)
        elif text[k] == "\\":
            k += 1
        elif text[k] == ",":
            parts.append(text[at:k])
            at = k + 1
        k += 1
    return [*parts, text[at:]]


def _compile(text: str) -> Selector:
    ends: list[_Chain] = []
    bad = ValueError(f"bad selector: {text!r}")
    for one in _split(text):
        one = one.strip()
        chain, at, comb = _Chain("", None), 0, ""
        while at < len(one):
            m = _TOKENS.match(one, at)
            if not m or m["close"]:
                raise bad
            at = m.end()
            if m["space"] is not None:
                comb = m["comb"] or " "
                if not chain.tests or comb == ",":
                    raise bad
                chain, comb = _Chain(comb, chain), ""
                continue
            if m["tag"]:
                tag = _unescape(m["tag"]).lower()
                if chain.tests:
                    raise bad
                chain.tests.append((lambda t: lambda page, node: t in ("*", node.tag))(tag))
                chain.key = None if tag == "*" else tag
            elif m["hash"]:
                name = _unescape(m["hash"][1:])
                chain.tests.append((lambda v: lambda page, node: node.attrs.get("id") == v)(name))
                chain.key = "#" + name
            elif m["cls"]:
                name = _unescape(m["cls"][1:])
                chain.tests.append((lambda v: lambda page, node: v in node.attrs.get("class", "").split())(name))
                chain.key = chain.key if chain.key and chain.key[0] == "#" else "." + name
            elif m["attr"]:
                value = m["value"] or ""
                value = _unescape(value[1:-1] if value[:1] in "\"'" and value else value)
                chain.tests.append(_attribute(_unescape(m["attr"]), m["op"], value, (m["flag"] or "").lower()))
            else:
                name = m["pseudo"]
                if name.startswith("::"):
                    raise bad
                inner = None
                if m["call"]:
                    inner, at = _arguments(one, at)
                chain.tests.append(_pseudo(name[1:].lower(), inner))
        if not chain.tests:
            raise bad
        ends.append(chain)
    return Selector(ends)


@lru_cache(maxsize=4096)
def compiled(text: str) -> Selector:
    """The program of a selector; ValueError if it isn't one."""
    return _compile(text)


def select(page: Page, scope: Node, selector: str, most: int | None = None) -> list[Node]:
    return compiled(selector).select(page, scope, most)
