"""Selectors on a page whose answers are worked out by hand."""

import pytest

from tallyrack.sources.dom import Tree
from tallyrack.sources.selectors import Page, compiled, select

HTML = """<main id="top" lang="en-GB"><section class="grid first"><article class="card hot" data-sku="A-1" data-tags="new sale"><h2 id=h1>Lamp</h2><a href="/p/1">See</a><span class="price">10</span></article>
<article class="card" data-sku="A-2"><h2 id=h2>Bowl</h2><a href="https://x.example.com/p/2.html">See</a><b></b></article><p id=ad>Ad</p><article class="card sold" data-sku="B-1"><h2 id=h3>Rug</h2><span class="price old">30</span><span class="price now">25</span></article></section>
<ul><li id=l1>one</li><li id=l2 class=x>two</li><li id=l3>three</li><li id=l4 class=x>four</li><li id=l5>five</li></ul><form><input id=i1 type=CHECKBOX checked><input id=i2 type="text" disabled><input id=i3></form><div id=e1></div><div id=e2> </div><div id=e3><i>i</i></div></main>"""

# selector -> ids of what it finds (cards by data-sku, others by text or tag)
CASES = {
    "#h1": "h1", "h2#h2": "h2", "article": "A-1 A-2 B-1", ".card.hot": "A-1", ".card:not(.hot)": "A-2 B-1", ".card:not(.hot, .sold)": "A-2", "article:is(.hot, .sold)": "A-1 B-1", ":where(.sold) h2": "h3",
    "[data-sku]": "A-1 A-2 B-1", "[data-sku=A-1]": "A-1", "[data-sku='B-1']": "B-1", '[data-sku^="A-"]': "A-1 A-2", "[data-sku$='-1']": "A-1 B-1", "[data-sku*='-']": "A-1 A-2 B-1", "[data-tags~=sale]": "A-1", "[data-tags~='new sale']": "", "[lang|=en] > form": "form", "[lang|=en-G]": "",
    "article[data-sku!=A-1]": "A-2 B-1", "[data-sku='a-1' i]": "A-1", "[data-sku='a-1']": "", "[type=checkbox]": "i1", "[type=checkbox s]": "", "[data-sku^='']": "",
    "section > h2": "", "section h2": "h1 h2 h3", "section>article>h2": "h1 h2 h3", "p + article": "B-1", "article + article": "A-2", "article ~ article": "A-2 B-1", "h2 ~ span.price": "price price.old price.now", "p ~ article h2": "h3",
    "li:first-child": "l1", "li:last-child": "l5", "li:nth-child(2)": "l2", "li:nth-child(odd)": "l1 l3 l5", "li:nth-child(even)": "l2 l4", "li:nth-child(2n+1)": "l1 l3 l5", "li:nth-child(-n+2)": "l1 l2", "li:nth-child(n+4)": "l4 l5", "li:nth-child( 3n - 1 )": "l2 l5",
    "li:nth-last-child(1)": "l5", "li:nth-last-child(-n+2)": "l4 l5", "li:nth-child(2 of .x)": "l4", "li:nth-child(0n+3)": "l3", "article:nth-of-type(3)": "B-1", "section > :nth-child(3)": "ad", "article:last-of-type": "B-1", "section > p:only-of-type": "ad", "article:first-of-type h2": "h1", "i:only-child": "i", "article:nth-last-of-type(2)": "A-2",
    "div:empty": "e1 e2", "article:has(a)": "A-1 A-2", "article:has(> b)": "A-2", "article:has(+ p)": "A-2", "article:has(~ article.sold)": "A-1 A-2", "article:not(:has(a))": "B-1", "section:has(article > b) > p": "ad", "article:has(h2, table)": "A-1 A-2 B-1",
    "li:-soup-contains('o')": "l1 l2 l4", "li:contains(three)": "l3", "li:-soup-contains-own(\"f\", 'one')": "l1 l4 l5", "input:checked": "i1", "input:disabled": "i2", "input:enabled": "i1 i3", "a:any-link": "a a", "li:hover": "", "h2, #ad, h2": "h1 h2 ad h3", "ul *": "l1 l2 l3 l4 l5", "main:root": "top",
    "#\\68 1": "h1", "*|x": None, "a[": None, "a:nope": None, "a >": None, "> a": None, "": None, "a,": None, "li:nth-child(x)": None, "a::before": None, ".": None, "a b >> c": None, ":has()": None, ")": None, "#top  >\n section": "grid.first",
}


def name(node):
    own = node.attrs.get("data-sku") or node.attrs.get("id")
    return own or ".".join(node.attrs.get("class", "").split()) or node.tag


@pytest.mark.parametrize("css", CASES)
def test_selector(css):
    page = Page(Tree(HTML))
    if CASES[css] is None:
        with pytest.raises(ValueError):
            compiled(css)
        return
    assert [name(n) for n in select(page, page.tree.root, css)] == CASES[css].split()
    assert [name(n) for n in select(page, page.tree.root, css, 1)] == CASES[css].split()[:1]


def test_scopes():
    """Within an element, whose own ancestors count for what stands before."""
    page = Page(Tree(HTML))
    card = select(page, page.tree.root, ".sold")[0]
    for css, want in ((".price", "price.old price.now"), ("section .price", "price.old price.now"), (":scope > .now", "price.now"), (":scope > section", ""), ("article", ""), (":scope", "")):
        assert [name(n) for n in select(page, card, css)] == want.split(), css


def test_against_a_plain_matcher():
    """Random trees and chains of simple steps, matched by trying all ways up."""
    import random

    r = random.Random(6)

    def tree(depth):
        return "".join(f"<{(t := r.choice('abp'))} class='{r.choice(['x', 'y', 'x y', ''])}'>{tree(depth - 1) if depth else ''}</{t}>" for _ in range(r.randint(0, 3)))

    def plain(node, steps):
        tag, cls = steps[-1][1]
        if (tag and node.tag != tag) or (cls and cls not in node.attrs.get("class", "").split()):
            return False
        if len(steps) == 1:
            return True
        comb, rest = steps[-1][0], steps[:-1]
        own = [c for c in node.parent.children if not isinstance(c, str)]
        at = next(i for i, c in enumerate(own) if c is node)
        ups, up = [], node.parent
        while up.tag:
            ups.append(up)
            up = up.parent
        pool = {" ": ups, ">": ups[:1], "+": own[max(0, at - 1) : at], "~": own[:at]}[comb]
        return any(plain(n, rest) for n in pool)

    for _ in range(60):
        page = Page(Tree(tree(4)))
        steps = [(r.choice(" >+~"), (r.choice(["a", "b", "p", ""]), r.choice(["x", "y", ""]))) for _ in range(r.randint(1, 4))]
        css = "".join((f" {c} " if i else "") + ((t or ("" if k else "*")) + (f".{k}" if k else "")) for i, (c, (t, k)) in enumerate(steps))
        assert select(page, page.tree.root, css) == [n for n in page.tree.nodes if plain(n, steps)], css
