"""HTML into relational features: one Arrow-batched pass that builds a tree with the standard parser.

A page becomes one row: counts, links with where they stand, containers with what later steps read of them, and what the
selectors of templates that come with it find.  All decisions (scores, fields, filters) are native columns over these
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.lineage import spread
from .selectors import Page, select

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
HEADINGS = ("h1", "h2", "h3", "h4")
# Tags that hold items, and tags that hold collections of them.
ITEMS = ("article", "li", "div", "tr", "section")
COLLECTIONS = ("main", "section", "div", "ul", "ol", "tbody")
# Attributes with the next page's address.
NEXT_ATTRIBUTES = ("data-next-url", "data-next", "data-url", "data-href", "data-load-more-url", "data-page-url")
NEXT_SCRIPT = r'"(?:next|nextUrl|next_url|nextPage|next_page)"\s*:\s*"([^"]+)"'


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "order", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int) -> None:
        self.tag, self.attrs, self.parent, self.order, self.end = tag, attrs, parent, order, order
        self.children: list[Node | str] = []


class Tree(HTMLParser):
    """Tags nest as they are written: nothing is closed implicitly, an end tag without a start is ignored, and one
    that closes an outer element closes those within."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None, 0)
        self.nodes: list[Node] = []
        self.open = [self.root]
        self.feed(html)
        self.close()
        for node in reversed(self.nodes):
            node.end = max(node.end, node.order)
            if node.parent is not None:
                node.parent.end = max(node.parent.end, node.end)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {}, self.open[-1], len(self.nodes) + 1)
        for k, v in attrs:
            node.attrs[k] = v or ""
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def under(self, node: Node) -> list[Node]:
        """Descendants in document order."""
        return self.nodes[node.order : node.end]


def text(node: Node) -> str:
    """Stripped strings joined by spaces; scripts and styles within are left out."""
    out, stack = [], [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            if s := child.strip():
                out.append(s)
        elif child.tag not in SILENT:
            stack.append(iter(child.children))
    return " ".join(out)


def ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None and node.parent.tag:
        node = node.parent
        yield node


def classes(node: Node) -> list[str]:
    return node.attrs.get("class", "").split()


LINK = "struct<ord:int,href:string,text:string,heading:boolean,hints:string,area:string,parent:int>"
BOX = f"struct<ord:int,parent:int,parent_tag:string,tag:string,cls:string,kids:array<string>,nav:boolean,text:string,links:array<{LINK}>,n_headings:int,headings:array<string>,blocks:array<string>,hinted:array<struct<cls:string,txt:string>>>"
PAGE = f"page_id long, url string, n_scripts int, n_anchors int, n_forms int, n_headings int, text string, fingerprint string, rel_next string, link_rel_next string, links array<{LINK}>, data_next string, script_next string, boxes array<{BOX}>"


def _link(tree: Tree, a: Node, boxes: dict[int, int] | None = None) -> dict:
    area = " ".join(f"{x.attrs.get('id', '')} {x.attrs.get('class', '')}" for x in [a, *ancestors(a)])
    hints = " ".join(a.attrs.get(k, "") for k in ("aria-label", "title", "class", "id"))
    parent = next((x.order for x in ancestors(a) if x.tag in ITEMS), None)
    return {"ord": a.order, "href": a.attrs["href"], "text": text(a), "heading": any(x.tag in HEADINGS for x in tree.under(a)), "hints": hints, "area": area, "parent": parent}


def fingerprint(tree: Tree) -> str:
    """A hash of the twenty most frequent tags and classes, ties by name, and three counts.  The text that is hashed
    is a fixed format."""
    top = lambda names: sorted(Counter(names).items(), key=lambda x: (-x[1], x[0]))[:20]
    tags = top(n.tag for n in tree.nodes[:400])
    named = top(c for n in tree.nodes[:300] for c in classes(n)[:2])
    counts = {"anchors": sum(n.tag == "a" and "href" in n.attrs for n in tree.nodes), "headings": sum(n.tag in HEADINGS for n in tree.nodes), "forms": sum(n.tag == "form" for n in tree.nodes)}
    return hashlib.sha1(repr({"top_tags": tags, "top_classes": named} | counts).encode()).hexdigest()


def page_row(tree: Tree, page_id: int, url: str) -> dict:
    anchors = [n for n in tree.nodes if n.tag == "a" and "href" in n.attrs]
    links = {a.order: _link(tree, a) for a in anchors}
    headings = [n for n in tree.nodes if n.tag in HEADINGS]
    boxes = []
    holders = {x["parent"] for x in links.values()}
    for n in tree.nodes:
        inside = n.parent is not None and n.parent.tag in COLLECTIONS
        if n.tag not in ITEMS or not (inside or n.order in holders):
            continue
        under = tree.under(n)
        own = [links[x.order] for x in under if x.order in links]
        heads = [text(x) for x in under if x.tag in HEADINGS]
        up = list(ancestors(n))
        nav = n.tag in ("nav", "header", "footer") or any(x.tag in ("nav", "header", "footer") or re.search("nav|menu|breadcrumb|footer|header", " ".join(classes(x)), re.I) for x in up)
        blocks = [text(x) for x in [x for x in under if x.tag in ("span", "p", "div")][:10]]
        hinted = [{"cls": " ".join(classes(x)), "txt": text(x)} for x in under[:120] if classes(x)]
        boxes.append({"ord": n.order, "parent": n.parent.order if inside else None, "parent_tag": n.parent.tag, "tag": n.tag, "cls": ".".join(classes(n)[:2]), "kids": [c.tag for c in n.children if isinstance(c, Node)][:6], "nav": bool(nav), "text": text(n), "links": own, "n_headings": len(heads), "headings": heads, "blocks": blocks, "hinted": hinted})
    rel = lambda tag: next((n.attrs["href"] for n in tree.nodes if n.tag == tag and "href" in n.attrs and "next" in n.attrs.get("rel", "").lower().split()), None)
    data = next((n.attrs[k] for n in tree.nodes for k in NEXT_ATTRIBUTES if n.attrs.get(k, "").strip()), None)
    scripts = ("".join(c for c in n.children if isinstance(c, str)) for n in tree.nodes if n.tag == "script")
    script = next((m for m in (re.search(NEXT_SCRIPT, s) for s in scripts) if m), None)
    return {
        "page_id": page_id, "url": url, "n_scripts": sum(n.tag == "script" for n in tree.nodes), "n_anchors": len([n for n in tree.nodes if n.tag == "a"]), "n_forms": sum(n.tag == "form" for n in tree.nodes), "n_headings": len(headings), "text": text(tree.root),
        "rel_next": rel("a"), "link_rel_next": rel("link"), "links": list(links.values()), "data_next": data, "script_next": script[1] if script else None, "boxes": boxes, "fingerprint": fingerprint(tree),
    }


#: A template's selectors, and what they find on a page.
PROGRAM = "template_id string, container string, fields map<string,string>, next string"
FOUND = "template_id string, warning string, rows array<map<string,string>>, next_url string, next_warning string"

#: Attributes that hold a list, which reads as a list's text.
LISTS = ("class", "rel", "rev", "accept-charset", "headers", "accesskey")


def _selected(page: Page, node: Node, expression: str, base: str) -> str | None:
    """`sel`, `sel@attr` or `@attr`; an `@href` is joined to the page's address."""
    css, _, attr = expression.strip().rpartition("@") if "@" in expression else (expression.strip(), "", "")
    try:
        found = (select(page, node, css, 1) or [None])[0] if css.strip() else node
    except ValueError:
        return None
    attr = attr.strip()
    if found is None or (attr and attr not in found.attrs):
        return None
    value = text(found) if not attr else str(found.attrs[attr].split()) if attr in LISTS else found.attrs[attr].strip()
    return urljoin(base or "", value) if attr == "href" else value


def _rows(page: Page, url: str, container: str | None, fields: dict[str, str], most: int) -> tuple[list[dict], str | None]:
    """Raw values of the first `most` containers, or why there are none."""
    if not (container and container.strip()) or not fields:
        return [], "template_invalid_structure"
    try:
        boxes = select(page, page.tree.root, container, most)
    except ValueError:
        return [], "template_selector_invalid"
    return [{f: _selected(page, b, e, url) for f, e in fields.items()} for b in boxes], None if boxes else "template_container_not_found"


def _onward(page: Page, url: str, selector: str | None) -> tuple[str | None, str | None]:
    """Where the pagination selector's first node leads, or why nowhere."""
    if not selector:
        return None, None
    try:
        found = select(page, page.tree.root, selector, 1)
    except ValueError:
        return None, "template_pagination_selector_invalid"
    if not found:
        return None, "template_pagination_not_found"
    ref = next((v for k in ("href", "data-next-url", "data-url", "data-href") if (v := found[0].attrs.get(k, "").strip())), None)
    return (urljoin(url or "", ref), None) if ref else (None, "template_pagination_no_url")


def read_pages(pages: DataFrame, most: int = 0, features: bool = True) -> DataFrame:
    """pages (page_id, url, html; programs array<struct<PROGRAM>> where templates are to read them) -> PAGE and
    by_template array<struct<FOUND>>.  A page is parsed once, for its features, its fingerprint and every program; of a
    program's containers the first `most` are read.  Null HTML is an empty page.  Without features only page_id, url and
    by_template are filled.  Pages are spread over the session's number of partitions."""
    programs = "programs" in pages.columns
    columns = [*pages.select("page_id", "url", "html").schema.fields]
    kind = f"page_id {columns[0].dataType.simpleString()}, " + PAGE.partition(", ")[2] + f", by_template array<struct<{FOUND}>>"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def one(row: dict) -> dict:
        tree = Tree(row["html"] or "")
        out = page_row(tree, row["page_id"], row["url"]) if features else {"page_id": row["page_id"], "url": row["url"]}
        page, found = Page(tree) if row.get("programs") else None, []
        for p in row.get("programs") or []:
            rows, warning = _rows(page, row["url"], p["container"], dict(p["fields"] or []), most)
            onward, lost = _onward(page, row["url"], p["next"])
            found.append({"template_id": p["template_id"], "warning": warning, "rows": [list(r.items()) for r in rows], "next_url": onward, "next_warning": lost})
        return out | {"by_template": found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(at, 64).to_pylist()], schema)

    wanted = pages.select("page_id", "url", "html", *(["programs"] if programs else []))
    return spread(wanted, "page_id", "url").mapInArrow(run, kind)


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> PAGE."""
    return read_pages(pages.select("page_id", "url", F.col("html"))).drop("by_template")
