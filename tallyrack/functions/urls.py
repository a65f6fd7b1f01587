"""URLs by the RFC 3986 split as regular expressions; nothing raises on a malformed one."""

from __future__ import annotations

from .dialect import Dialect


def scheme(d: Dialect, u: str) -> str:
    return f"lower({d.find(u, r'^([a-z][a-z0-9+.-]*):', 1)})"


def authority(d: Dialect, u: str) -> str:
    return d.find(u, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(d: Dialect, u: str) -> str:
    return f"coalesce({d.find(u, r'^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)}, '')"


def query(d: Dialect, u: str) -> str:
    return f"coalesce({d.find(u, r'^[^?#]*[?]([^#]*)', 1)}, '')"


def domain(d: Dialect, u: str) -> str:
    """Host (with a port or user, if any) in lower case without www."""
    return d.sub(f"coalesce(lower({authority(d, u)}), '')", r"^www\.", "")


def canonical(d: Dialect, u: str) -> str:
    """Without query and fragment when absolute, else as it is."""
    absolute = f"{scheme(d, u)} IS NOT NULL AND {authority(d, u)} IS NOT NULL"
    return d.case((absolute, d.sub(u, r"[?#].*$", "")), other=f"coalesce({u}, '')")


def with_scheme(d: Dialect, u: str) -> str:
    return d.sub(f"trim({u})", "^//", "https://")


def product_link(d: Dialect, raw: str) -> str:
    """http(s) only; lower scheme and host, single slashes, no trailing one, no parameters, query or fragment."""
    route = d.sub(d.sub(d.sub(path(d, raw), r";[^/]*$", ""), "/{2,}", "/"), "/+$", "")
    route = f"regexp_replace({route}, '^$', '/')"
    return d.case((f"{scheme(d, raw)} IN ('http', 'https') AND {authority(d, raw)} <> ''", f"{scheme(d, raw)} || '://' || lower({authority(d, raw)}) || {route}"))


def segments(d: Dialect, u: str) -> str:
    return d.keep(d.split(path(d, u), "/"), "v <> ''")


def slug(d: Dialect, u: str, last: bool = True) -> str:
    """The segment before the first one named p, else the last (C4) or the first."""
    before = d.find(path(d, u), r"([^/]+)/+p(?:/|$)", 1, False)
    other = d.at(segments(d, u), -1 if last else 1)
    return f"coalesce({d.case((d.match(path(d, u), '^/*p(/|$)', False), 'null'), other=before)}, {other}, '')"


def is_product_page(d: Dialect, u: str) -> str:
    """a canonical product page and not a search, category or offer page."""
    p, a = f"lower({path(d, u)})", authority(d, u)
    bad = d.match(p, r"/(search|category|categories|collections?|offers?|deals?)(/|$)")
    fair = f"(NOT contains({a}, 'flipkart.com') OR contains({p}, '/p/')) AND (NOT contains({a}, 'amazon.') OR contains({p}, '/dp/') OR contains({p}, '/gp/product/'))"
    return f"coalesce({scheme(d, u)} IN ('http', 'https') AND {a} IS NOT NULL AND NOT {d.match(u, '[?#;]')} AND {p} NOT IN ('', '/') AND NOT {bad} AND {fair}, false)"


def looks_like_product(d: Dialect, u: str) -> str:
    """F3."""
    return f"({d.match(path(d, u), r'/p/|/dp/|/product/|/itm|/item/')} OR {d.match(query(d, u), 'pid=')})"


def next_page(d: Dialect, u: str) -> str:
    """The first of the page parameters, incremented."""
    ways = []
    for name in ("page", "p", "pg", "pageno", "page_no"):
        number = d.find(u, rf"[?&]{name}=(\d+)(?:&|#|$)", 1)
        head, tail = d.find(u, rf"^(.*?[?&]{name}=)\d+(?:&|#|$)", 1), f"coalesce({d.find(u, rf'[?&]{name}=[0-9]+([&#].*)$', 1)}, '')"
        ways.append(f"{head} || cast({d.long(number)} + 1 AS string) || {tail}" if d.spark else f"{head} || cast({d.long(number)} + 1 AS varchar) || {tail}")
    return d.either(*ways)


def join(d: Dialect, base: str, ref: str) -> str:
    """urljoin for references without dot segments: absolute, //host, /path, ?query, #fragment, relative."""
    root = d.find(base, r"^[a-z][a-z0-9+.-]*://[^/?#]*")
    no_query, folder = d.sub(base, r"[?#].*$", ""), d.find(d.sub(base, r"[?#].*$", ""), r"^([a-z][a-z0-9+.-]*://[^/]*.*/)[^/]*$", 1)
    return d.case(
        (f"{ref} IS NULL OR {ref} = ''", base), (d.match(ref, r"^[a-z][a-z0-9+.-]*:"), ref), (d.match(ref, "^//"), f"{scheme(d, base)} || ':' || {ref}"),
        (d.match(ref, "^/"), f"{root} || {ref}"), (d.match(ref, r"^[?]"), f"{no_query} || {ref}"), (d.match(ref, "^#"), f"{d.sub(base, '#.*$', '')} || {ref}"),
        other=f"CASE WHEN {no_query} = {root} THEN {root} || '/' || {ref} ELSE {folder} || {ref} END",
    )
