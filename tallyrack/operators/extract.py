"""Listing rows from parsed pages (D1-D22, S2-S4, S8, F1, F2): native columns over what the DOM pass emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dialect import SPARK
from ..plans.lineage import settle

# The patterns of prices, ratings, counts and states, and the class names that hint at them.
PRICE = r"(?:₹|\$|€|£)\s*\d[\d,]*(?:\.\d+)?"
PRICE_CODE = r"(?i)(?:USD|EUR|INR|GBP|JPY|AUD|CAD)\s*\d[\d,]*(?:\.\d+)?"
RATING = r"(?i)(\d(?:\.\d)?)\s*(?:/\s*5|out of 5|stars?)"
RATINGS = (r"(?i)\b(\d(?:\.\d)?)\b(?=\s*[\d,]+\s+Ratings?\b)", r"(?i)\b(\d(?:\.\d)?)\b(?=\s*Ratings?\b)", r"(?i)\b(\d(?:\.\d)?)\b(?=\s*[\d,]+\s*Reviews?\b)", RATING, r"(?i)\b(\d(?:[.,]\d)?)\s*/\s*5\b")
REVIEWS = r"(?i)\b(\d[\d,]*)\s*reviews?\b"
STATE = r"(?i)\b(currently unavailable|coming soon|out of stock|in stock|available)\b"
STATES = ("pre order", "currently unavailable", "coming soon", "out of stock", "in stock", "available")
PRICE_CLASS, RATING_CLASS, STATE_CLASS = r"(?i)price|amount|cost|mrp|sale", r"(?i)rating|stars?|score|review", r"(?i)availability|stock|status"
NAV_WORDS = r"^(home|about|contact|privacy|terms|login|sign in|signup|register|menu|categories?)$"
TITLE_NOISE = ("add to compare", "currently unavailable", "coming soon", "pre order", "trending", "bestseller")
SHELL = ("enable javascript", "javascript is required", r"loading\.\.\.")
FIELDS = ("title", "price", "rating", "review_count", "availability", "seller", "company", "product_url", "raw_text")


def squeeze(x: Column) -> Column:
    """X1."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def nav_text(x: Column) -> Column:
    """D8."""
    v = F.lower(squeeze(x))
    return (v == "") | v.rlike(NAV_WORDS) | (v.rlike(r"^(shop by |browse |view all)") & (F.length(v) < 40))


def first(x: Column, pattern: str, group: int = 0) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(1))


def resolved(u: Column, ref: Column) -> Column:
    """An address that a reference was joined to, without dot segments where the reference has no host of its own."""
    path = first(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)

    def step(acc: Column, part: Column) -> Column:
        return F.when(part == ".", acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, part))

    def whole(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        # a last dot segment names a folder
        return F.array_join(F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.array_append(kept, F.lit(""))).otherwise(kept), "/")

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    full = F.concat(first(u, r"^[^:/?#]+://[^/?#]*"), F.lit("/"), whole(parts), F.coalesce(first(u, r"[?#].*$"), F.lit("")))
    return F.when(~ref.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|//)") & path.rlike(r"/\.{1,2}(/|$)"), full).otherwise(u)


def product_title(x: Column) -> Column:
    """X2."""
    t = squeeze(x)
    for p in TITLE_NOISE:
        t = F.regexp_replace(t, rf"(?i)^\s*{p}\s*[:|-]?\s*", "")
    for p in TITLE_NOISE:
        t = F.regexp_replace(t, rf"(?i)\b{p}\b", " ")
    t = squeeze(t)
    counted = t.rlike(RATINGS[0])
    t = squeeze(F.when(counted, F.regexp_replace(t, f"{RATINGS[0]}.*$", "")).otherwise(F.regexp_replace(t, f"{RATINGS[1]}.*$", "")))
    t = F.regexp_replace(t, r"(?i)\b\d{1,2}(?:\.\d{1,2})?\s*cm\b.*$", "")
    t = F.regexp_replace(t, r"(?i)\b(?:ratings?|reviews?|gb\s*rom|display|camera|processor|battery|ram|rom)\b.*$", "")
    t = F.btrim(squeeze(t), F.lit(" ,;|-"))
    return squeeze(F.regexp_replace(t, r"(?i)^([^)]*\)).*(?:ratings?|reviews?|gb\b|tb\b|cm\b|inch\b|display|camera|rom|ram|processor|battery|ssd|hdd).*$", "$1"))


def rating_text(x: Column) -> Column:
    """At most one decimal, none if it is zero; null above 5."""
    n = first(F.regexp_replace(squeeze(x), ",", "."), r"\d(?:\.\d+)?").try_cast("double")
    return F.when(n <= 5, F.regexp_replace(F.format_string("%.1f", n), r"\.0$", ""))


def state(x: Column) -> Column:
    """X6."""
    v, out = F.regexp_replace(F.lower(squeeze(x)), "pre-?order", "pre order"), F.lit("")
    for s in reversed(STATES):
        out = F.when(F.contains(v, F.lit(s)), s).otherwise(out)
    return out


def hinted(cls: str, value: str, group: int = 0) -> Column:
    """The first of the first 120 nodes whose class hints and whose text has the value."""
    one = F.try_element_at(F.filter("hinted", lambda h: h["cls"].rlike(cls) & h["txt"].rlike(value)), F.lit(1))
    return first(one["txt"], value, group)


def primary_link(links: Column) -> Column:
    """The best scored link, the first of equals; else the first of all."""
    real = F.filter(links, lambda a: (F.trim(a["href"]) != "") & ~F.trim(a["href"]).rlike(r"(?i)^(#|javascript:)"))

    def score(a: Column) -> Column:
        href = F.trim(a["href"])
        words = F.when(a["text"] != "", F.least(F.length(a["text"]), F.lit(100)) / 18.0 - F.when(nav_text(a["text"]), 2.0).otherwise(0.0)).otherwise(0.0)
        return words + F.when(a["heading"], 2.0).otherwise(0.0) + F.when(href.rlike(r"(?i)product|item|details?|dp/|/p/"), 0.8).otherwise(0.0) + F.when(href.startswith("/"), 0.2).otherwise(0.0)

    best = F.array_max(F.filter(F.transform(real, lambda a: F.struct(score(a).alias("s"), (-a["ord"]).alias("o"), a.alias("a"))), lambda x: x["s"] > -1.0))
    return F.coalesce(best["a"], F.try_element_at(links, F.lit(1)))


def _title() -> Column:
    """D10."""
    heading = F.try_element_at(F.filter("headings", lambda h: (h != "") & ~nav_text(h)), F.lit(1))
    link = F.when((F.col("link.text") != "") & ~nav_text(F.col("link.text")), F.col("link.text"))
    block = F.try_element_at(F.filter("blocks", lambda b: (F.length(b) >= 6) & ~nav_text(b) & ~b.rlike(PRICE) & ~b.rlike(RATING)), F.lit(1))
    return F.substring(product_title(F.coalesce(heading, link, block, F.col("text"))), 1, 160)


def boxes(parsed: DataFrame) -> DataFrame:
    """One row for each container that passes D3, with its fields (D9-D17, D19) and signature."""
    one = parsed.select("page_id", "url", F.explode("boxes").alias("b")).select("page_id", "url", "b.*")
    texts = F.filter(F.transform(F.slice("links", 1, 5), lambda a: a["text"]), lambda t: t != "")
    only_nav = (F.size(texts) > 0) & F.forall(texts, nav_text) & ~(F.col("text").rlike(PRICE) | F.col("text").rlike(RATING))
    good = one.filter(~F.col("nav") & (F.length("text") >= 20) & ((F.size("links") > 0) | (F.col("n_headings") > 0)) & ~only_nav)
    good = good.withColumn("link", primary_link(F.col("links")))
    rating = F.coalesce(*(rating_text(hinted(RATING_CLASS, p, 1)) for p in RATINGS), *(rating_text(first(F.col("text"), p, 1)) for p in RATINGS), F.lit(""))
    price = squeeze(F.coalesce(hinted(PRICE_CLASS, PRICE), hinted(PRICE_CLASS, PRICE_CODE), first(F.col("text"), PRICE), first(F.col("text"), PRICE_CODE), F.lit("")))
    count = F.regexp_replace(F.coalesce(hinted(RATING_CLASS, REVIEWS, 1), first(F.col("text"), REVIEWS, 1)), ",", "").try_cast("bigint")
    entity = lambda names: F.trim(F.coalesce(first(F.col("text"), rf"(?i)(?:{names})\s*[:\-]?\s*([A-Za-z0-9 &._-]{{2,40}})", 1), F.lit("")))
    href = F.trim(F.col("link.href"))
    sign = F.concat_ws("|", "tag", "cls", F.array_join("kids", "-"), F.concat(F.lit("a"), F.size("links")), F.concat(F.lit("h"), F.col("n_headings")))
    out = good.select("*", href.alias("href"), _title().alias("title"), price.alias("price"), rating.alias("rating"), count.alias("review_count"), state(F.coalesce(hinted(STATE_CLASS, STATE, 1), first(F.col("text"), STATE, 1), F.lit(""))).alias("availability"), entity("seller|sold by").alias("seller"), entity("company|by").alias("company"), F.col("text").alias("raw_text"), sign.alias("signature"))
    out = out.withColumn("product_url", F.when(F.coalesce("href", F.lit("")) == "", F.lit("")).otherwise(F.expr(U.join(SPARK, "url", "href"))))
    return out.withColumn("product_url", resolved(F.col("product_url"), F.coalesce("href", F.lit(""))))


def _group_score() -> Column:
    """D5."""
    share = lambda c: F.avg(c.cast("int"))
    titled = F.greatest(F.count_if(F.col("title") != ""), F.lit(1))
    return F.count(F.lit(1)) * 2.0 + F.least(F.avg(F.length("text")) / 120.0, F.lit(2.0)) + share(F.size("links") > 0) * 1.2 + share(F.col("n_headings") > 0) * 1.1 + share(F.col("text").rlike(PRICE)) * 2.2 + share(F.col("text").rlike(RATING)) * 1.5 + F.count_distinct(F.when(F.col("title") != "", F.col("title"))) / titled * 1.8 - F.count_if((F.col("title") != "") & nav_text(F.col("title"))) / titled * 3.0


def containers(found: DataFrame) -> DataFrame:
    """The children of the best scored parent with two or more candidates, the first of equals; for pages without
    one, D4: the nearest containers of links, grouped by signature."""
    inside = found.filter("parent IS NOT NULL AND parent_tag IN ('main', 'section', 'div', 'ul', 'ol', 'tbody')")
    groups = inside.groupBy("page_id", "parent").agg(F.count(F.lit(1)).alias("n"), (_group_score() + F.least(F.count_distinct("signature") / F.count(F.lit(1)), F.lit(0.6))).alias("score")).filter("n >= 2")
    best = groups.groupBy("page_id").agg(F.max_by("parent", F.struct("score", -F.col("parent"))).alias("parent"))
    one = inside.join(best, ["page_id", "parent"], "left_semi").select(found.columns)
    rest = found.join(best.select("page_id"), "page_id", "left_anti")
    # each link counts its nearest container once, repeats included
    holders = rest.withColumn("own", F.filter("links", lambda a: a["parent"] == F.col("ord"))).filter(F.size("own") > 0)
    weighed = holders.withColumn("_w", F.explode(F.sequence(F.lit(1), F.size("own"))))
    signs = weighed.groupBy("page_id", "signature").agg(F.count(F.lit(1)).alias("n"), _group_score().alias("score"), F.min("ord").alias("first")).filter("n >= 2")
    sign = signs.groupBy("page_id").agg(F.max_by("signature", F.struct("score", -F.col("first"))).alias("signature"))
    return one.unionByName(holders.join(sign, ["page_id", "signature"], "left_semi").select(found.columns))


def has_substance(columns: list[str]) -> Column:
    """F1."""
    return F.exists(F.array(*(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns)), lambda v: v != "")


def probable_product() -> Column:
    """F2."""
    title = F.trim("title")
    return (title != "") & ~nav_text(title) & ((F.col("price") != "") | (F.col("rating") != "") | F.expr(U.looks_like_product(SPARK, "lower(product_url)")) | (F.size(F.split(squeeze(title), " ")) >= 3))


def generic_field(name: str) -> Column:
    """A field of another name: its title or address if it is called so, else the start of its text."""
    low = name.lower()
    if "title" in low or "name" in low:
        return F.col("title")
    if "url" in low or "link" in low:
        return F.col("product_url")
    return F.substring(squeeze(F.col("raw_text")), 1, 160)


def with_defaults(fields: list[str]) -> tuple[str, ...]:
    """The named fields after those that every row has."""
    return FIELDS + tuple(f for f in fields if f not in FIELDS)


def container_pages(parsed: DataFrame) -> DataFrame:
    """page_id of pages where repeated containers are found (D20 falls back on links for the others)."""
    return containers(settle(boxes(settle(parsed)))).select("page_id").distinct()


def listing_rows(parsed: DataFrame, max_rows: int = 100, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(page_id, idx, fields).  Containers are capped at twice max_rows a page, filtered, capped, made distinct;
    pages without any give a row for each of their first links that looks like a product.  The caps are the
    request's own limit on a page."""
    parsed = settle(parsed)
    found = settle(boxes(parsed))
    others = {f: generic_field(f) for f in fields if f not in FIELDS}
    found = found.withColumns(others) if others else found
    chosen = settle(containers(found))
    nth = Window.partitionBy("page_id").orderBy("ord")
    capped = chosen.withColumn("_k", F.row_number().over(nth)).filter(F.col("_k") <= 2 * max_rows).filter(has_substance(list(fields)) & probable_product())
    own = capped.select("page_id", "ord", *fields)
    bare = parsed.join(chosen.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "url", F.posexplode(F.slice("links", 1, max_rows)).alias("_p", "a"))
    bare = bare.filter((F.col("a.text") != "") & ~nav_text(F.col("a.text"))).select("page_id", "url", F.col("a.ord").alias("ord"), F.col("a.text").alias("t"), F.trim("a.href").alias("h"), F.col("a.parent").alias("box"))
    inside = bare.join(found.select("page_id", F.col("ord").alias("box"), *fields), ["page_id", "box"])
    blank = {f: F.lit("") for f in fields} | {"title": F.col("t"), "product_url": F.expr(U.join(SPARK, "url", "h")), "review_count": F.lit(None).cast("bigint")}
    blank |= {f: blank["title"] for f in fields if f == "name"} | {f: blank["product_url"] for f in fields if f in ("url", "link")}
    outside = bare.join(found.select("page_id", F.col("ord").alias("box")), ["page_id", "box"], "left_anti").select("page_id", "ord", *(blank[f].alias(f) for f in fields))
    rows = own.unionByName(inside.select("page_id", "ord", *fields).filter(probable_product())).unionByName(outside.filter(probable_product()))
    rows = rows.withColumn("idx", F.row_number().over(nth)).filter(F.col("idx") <= max_rows)
    sign = Window.partitionBy("page_id", *(F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields)).orderBy("idx")
    return rows.withColumn("_k", F.row_number().over(sign)).filter("_k = 1").select("page_id", "idx", *fields)


def js_shell(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """S3."""
    head = F.substring("html", 1, 2000)
    hints = F.lit(False)
    for p in SHELL:
        hints = hints | head.rlike(f"(?is){p}")
    few = (F.col("n_scripts") >= 8) & (F.length("text") < 120) & (F.col("n_anchors") <= 2)
    both = pages.select("page_id", "html").join(parsed.select("page_id", "n_scripts", "n_anchors", "text"), "page_id")
    return both.select("page_id", (F.coalesce(F.trim("html") == "", F.lit(True)) | hints | few).alias("js_shell"))


def with_rendered(http: DataFrame, rendered: DataFrame, shells: DataFrame) -> DataFrame:
    """The rendered page where the first is a shell; with the warnings."""
    both = http.join(shells, "page_id", "left").join(rendered.select("page_id", F.col("html").alias("r")), "page_id", "left")
    use = F.coalesce("js_shell", F.lit(True))
    warn = F.when(use, F.when(F.col("r").isNotNull(), F.array(F.lit("http_js_shell_detected"), F.lit("source_playwright_fallback"))).otherwise(F.array(F.lit("http_js_shell_detected"), F.lit("playwright_unavailable_or_failed")))).otherwise(F.array().cast("array<string>"))
    return both.select("page_id", "url", F.when(use, F.coalesce("r", "html")).otherwise(F.col("html")).alias("html"), warn.alias("warnings"))


def fingerprint(parsed: DataFrame) -> DataFrame:
    """D21, as the DOM pass has it."""
    return parsed.select("page_id", "fingerprint")


def placeholders(pages: DataFrame, count: int, fields: list[str], page: int = 1) -> DataFrame:
    """Made-up rows of each page (page_id, url), only ever on request."""
    host = F.expr(U.domain(SPARK, "url"))
    i = F.col("idx")
    known = {
        "title": F.concat(F.lit("Item "), i, F.lit(" from "), host), "price": (999 + 5 * i).cast("string"), "rating": F.round(3.8 + (i % 10) / 10, 1).cast("string"), "product_url": F.concat(F.lit("https://"), host, F.lit("/item/"), i),
        "seller": F.concat(F.lit("Seller "), (i - 1) % 7 + 1), "company": F.concat(F.lit("Company "), (i - 1) % 9 + 1), "review_count": F.lit(None).cast("bigint"),
    }
    numbered = pages.select("page_id", "url", F.explode(F.sequence(F.lit(1 + (page - 1) * count), F.lit(page * count))).alias("idx"))
    return numbered.select("page_id", "idx", *(known.get(f, F.lit("")).alias(f) for f in fields))
