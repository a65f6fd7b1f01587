"""Listing rows to catalog rows of 36 columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dialect import SPARK
from ..functions.identity import model_signature
from . import identity as I
from .extract import RATINGS, REVIEWS, first, product_title, rating_text, squeeze, state

# The catalog row's columns, in order.
COLUMNS = ("brand", "category", "product_family", "model", "parent_product_id", "parent_cluster_id", "variant_id", "variant_cluster_id", "canonical_product_id", "cluster_id", "cluster_confidence", "global_entity_id", "match_confidence", "sku", "sku_confidence", "ram", "storage", "processor", "display", "os_family", "os_version", "os", "is_canonical_name", "name_source", "canonical_review_required", "list_price_inr", "effective_price_inr", "discount_percent", "price_confidence", "price_inr", "rating", "review_count", "review_scope", "review_count_timestamp", "availability", "product_url")
IDS = {"parent_product_id", "parent_cluster_id", "variant_id", "variant_cluster_id", "canonical_product_id", "cluster_id", "cluster_confidence", "global_entity_id", "match_confidence"}
# Patterns of part numbers, brands and words.
SKU = r"\b([A-Z]{2,}[A-Z0-9]{2,}(?:[/-][A-Z0-9]{1,})+)\b"
PART_LABEL = r"(?i)\b(?:model\s*(?:no\.?|number)?|part\s*(?:no\.?|number)?)\s*[:#-]?\s*([A-Z0-9][A-Z0-9/-]{3,})\b"
TRAIL = r"(?i)\b(?:Apple\s+M[1-5](?:\s*(?:Pro|Max|Ultra))?|Intel\s+Core\s+[^,()/]+|AMD\s+Ryzen\s+\d+[A-Za-z0-9-]*)\b"
GENERIC = ("mobiles", "mobile", "accessories", "computers", "laptops", "electronics", "bestseller", "trending")
FIXED_BRANDS = {"apple": "Apple", "samsung": "Samsung", "lenovo": "Lenovo", "dell": "Dell", "hp": "HP", "asus": "ASUS", "acer": "Acer", "msi": "MSI"}
SLUG_STOPS = ("windows", "macos", "intel", "core", "ultra", "series", "ssd", "hdd", "display", "home", "pro")


# Patterns of processors, systems, memory, displays and models.
CORE_ULTRA = r"(?i)\b(?:intel\s+)?core\s+ultra\s+([3579])\s+(\d{3,4}[a-z]?)\b"
CORE_SERIES = r"(?i)\b(?:intel\s+)?core\s+([3579])\s+series\s+(\d+)\s+(\d{3,4}[a-z]?)\b"
CHIP_A, CHIP_M = r"(?i)\bA(\d{1,2})(\s*Pro)?\b", r"(?i)\bM([1-5])(\s*(?:Pro|Max|Ultra))?\b"
CORE_I, RYZEN = r"(?i)\b(?:Intel\s+)?Core\s+i([3579])\b", r"(?i)\b(?:AMD\s+)?Ryzen\s+(\d{3,5})\b"
WINDOWS = r"\bwindows\s*(11|10)(?:\s*(home|pro|s))?\b"
MACOS = r"\bmac\s*os(?:\s*(sequoia|sonoma|ventura|monterey|big\s*sur))?\b"
MEMORY_PAIR = r"(?i)\b(\d{1,3})\s*gb\s*/\s*(\d{2,4})\s*(gb|tb)(?:\s*(ssd|hdd|ufs|rom|emmc))?\b"
DISPLAY_INCH, DISPLAY_CM = r"(?i)\b(\d{1,2}(?:\.\d+)?)\s*(?:inch|inches|in|\"|'')\b", r"(?i)\b(\d{1,2}(?:\.\d+)?)\s*cm\b"
MODEL_SPECS = (r"(?i)\((?:[^)]*\b(?:gb|tb|ram|rom|ssd|hdd|ufs|emmc|windows|macos|display|inch|cm)\b[^)]*)\)", r"\(\s*\d{4}\s*\)", r"(?i)\b\d+\s*(?:gb|tb)\b(?:\s*(?:ram|rom|ssd|hdd|ufs|emmc))?", r"(?i)\b\d+(?:\.\d+)?\s*(?:inch|inches|cm)\b")
MODEL_TAILS = (r"(?i)\bwith\b.*$", r"(?i)\b\d{3,5}\s*mAh\b.*$", r"(?i)\b\d{2,3}\s*W\b.*$", r"(?i)\b(?:supervooc|charger|in[-\s]?the[-\s]?box)\b.*$", r"\s*[-|:]\s*\(\s*$", r"\([^()]*$", r"[-|:/\s(]+$")
MACBOOK, MACBOOK_NEO = r"(?i)\bMacBook\s+(Air|Pro)\b", r"(?i)\bMacBook\s+Neo\b"
GALAXY_BOOK, MOTOBOOK, MOTOBOOK_PRO = r"(?i)\bGalaxy\s+Book\d+\b", r"(?i)\bMotobook\s+\d+\b", r"(?i)\bMotobook\s+\d+(?:\s+Pro)?\b"
CANONICAL = r"(?i)^(MacBook (Air|Pro)(?: M[1-9])?|Galaxy Book\d+|Motobook \d+(?: Pro)?)$"
NOISY = ("add to compare", "currently unavailable", "coming soon", "trending", "pre order", "http://", "https://", "pid=")
MODEL_BRANDS = ("apple", "samsung", "lenovo", "dell", "hp", "asus", "acer", "msi", "motorola")
# Patterns of amounts, of part numbers and sizes in slugs, and words that tell listings from variants.
AMOUNT = r"₹\s*([\d,]{2,})"
SLUG_PART = r"(?i)^(?=[a-z0-9-]*\d)[a-z]{2,}[a-z0-9]{3,}-[a-z0-9]{1,8}$"
SLUG_SIZE = r"(?<![a-z0-9])\d{1,4}-?(?:gb|tb)(?![a-z0-9])(?:-(?:ssd|hdd|ufs|rom|emmc)(?![a-z0-9]))?"
RAM_SAID = r"\b\d+\s*(gb|tb)\s*ram\b"
GENERIC_TITLE = r"^(mobiles?|mobile phones?|computers?|laptops?|electronics?|tablets?)(?:\s*&\s*[a-z ]+)?$"
SPEC_WORDS = r"\b(\d+\s*(gb|tb|mah|inch|cm)|\d+\s*w|ratings?|reviews?)\b"
REVIEW_WORDS = r"\b(neo|concept|edition|special)\b"
VARIANT_SIZES = r"(?s)\b\d+\s*gb\b.*\b(ssd|hdd|rom|ufs)\b"
LAPTOP_WORDS, PHONE_WORDS, AUDIO_WORDS = ("macbook", "laptop", "notebook", "ultrabook"), ("iphone", "smartphone", "mobile", "phone"), ("headphone", "earbud", "airpods")


def wants_catalog(prompt: str) -> bool:
    """F11."""
    p = (prompt or "").lower().replace("-", "_")
    return sum(w in p for w in ("brand", "category", "model", "ram", "storage")) >= 3 and bool(re.search(r"price\s*_?\s*inr", p)) and ("product_url" in p or "product url" in p)


# Words of a prompt and the fields that they ask for, in order.
ASKED = {"title": "title", "name": "title", "price": "price", "rating": "rating", "review_count": "review_count", "review count": "review_count", "reviews": "review_count", "url": "product_url", "link": "product_url", "availability": "availability", "unavailable": "availability", "stock": "availability", "seller": "seller", "company": "company"}
DEFAULT_FIELDS = ["title", "price", "rating", "product_url"]


def fields_of(prompt: str) -> list[str]:
    """The fields that a prompt asks for, in order; four by default, seven for the catalog."""
    if prompt and wants_catalog(prompt):
        return [*DEFAULT_FIELDS, "review_count", "availability", "raw_text"]
    chosen = dict.fromkeys(field for word, field in ASKED.items() if word in (prompt or "").lower())
    return list(chosen) or list(DEFAULT_FIELDS)


def digits(x: Column) -> Column:
    """All digits together, null without any or beyond a long."""
    return F.regexp_replace(x.cast("string"), "[^0-9]", "").try_cast("bigint")


def amounts(x: Column) -> Column:
    """X8."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(1)), digits), lambda v: v.isNotNull()))


def keyword_price(x: Column, words: tuple[str, ...]) -> Column:
    """X9."""
    low = F.lower(x)

    def near(word: str) -> Column:
        at = F.locate(word, low)
        start = F.greatest(F.lit(1), at - 20)
        return F.when(at > 0, digits(first(F.substring(x, start, at + 120 - start), AMOUNT, 1)))

    return F.coalesce(*(near(w) for w in words))


def _title_case(x: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+|[^a-z]+"), F.lit(0)), lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, 1000))), "")


def _brand() -> Column:
    """X16."""
    word, head = F.try_element_at(F.split("title", " "), F.lit(1)), F.try_element_at(F.split("slug", "-"), F.lit(1))
    own = F.when((word != "") & ~word.rlike(r"^\d") & ~F.lower(word).isin(*GENERIC), word)
    name = F.coalesce(own, F.when(head.rlike(r"^\p{L}+$") & ~F.lower(head).isin(*GENERIC), head))
    fixed = F.create_map(*(F.lit(v) for kv in FIXED_BRANDS.items() for v in kv))
    return F.coalesce(F.try_element_at(fixed, F.lower(name)), _title_case(name), F.lit(""))


def _has(x: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def _category(x: Column) -> Column:
    """X17."""
    return F.when(_has(x, *LAPTOP_WORDS), "laptop").when(_has(x, *PHONE_WORDS), "smartphone").when(_has(x, *AUDIO_WORDS), "audio").otherwise("product")


def _processor() -> Column:
    """X18, over `spoken`."""
    x, apple = F.col("spoken"), F.when(F.lower("brand") == "apple", "Apple ").otherwise("")
    ultra, series, a, m = CORE_ULTRA, CORE_SERIES, CHIP_A, CHIP_M
    pro = F.when(squeeze(first(x, a, 2)) != "", " Pro").otherwise("")
    return F.coalesce(
        F.concat(F.lit("Intel Core Ultra "), first(x, ultra, 1), F.lit(" "), F.upper(first(x, ultra, 2))), F.concat(F.lit("Intel Core "), first(x, series, 1), F.lit(" Series "), first(x, series, 2), F.lit(" "), F.upper(first(x, series, 3))),
        F.concat(apple, F.lit("A"), first(x, a, 1), pro), F.concat(apple, F.rtrim(F.concat(F.lit("M"), first(x, m, 1), F.lit(" "), squeeze(first(x, m, 2))))),
        F.concat(F.lit("Intel Core i"), first(x, CORE_I, 1)), F.concat(F.lit("AMD Ryzen "), first(x, RYZEN, 1)),
    )


def _os(x: Column) -> tuple[Column, Column]:
    """Family and version, over lower text."""
    windows, mac = WINDOWS, MACOS
    is_windows, is_mac, chrome, linux = x.rlike(windows), x.rlike(mac), _has(x, "chrome os", "chromeos"), _has(x, "linux", "ubuntu")
    android, ios = F.contains(x, F.lit("android")), F.contains(x, F.lit("ios"))
    apple = (F.lower("brand") == "apple") & (F.col("category") == "laptop")
    family = F.when(is_windows, "Windows").when(is_mac, "macOS").when(chrome, "ChromeOS").when(linux, "Linux").when(android, "Android").when(ios, "iOS").when(apple, "macOS")
    number = lambda name, label: F.concat(F.lit(f"{label} "), first(x, rf"\b{name}\s*(\d+(?:\.\d+)?)\b", 1))
    version = F.when(is_windows, F.rtrim(F.concat(first(x, windows, 1), F.lit(" "), _title_case(first(x, windows, 2))))).when(is_mac, F.nullif(_title_case(squeeze(first(x, mac, 1))), F.lit(""))).when(chrome | linux, F.lit(None)).when(android, number("android", "Android")).when(ios, number("ios", "iOS"))
    return family, version


def _normal_sku(x: Column) -> Column:
    """X25."""
    s = F.btrim(F.regexp_replace(F.regexp_replace(F.upper(squeeze(x)), "/", "-"), "-{2,}", "-"), F.lit("-"))
    return F.when(s.rlike(r"^[A-Z0-9]+(?:-[A-Z0-9]+)+$"), s)


def _sku() -> Column:
    """struct(sku, confidence) of what the text, a label, the slug's tail or the link's pid tells."""
    blob = F.concat_ws(" ", "source_text", "title")
    label = F.upper(squeeze(first(blob, PART_LABEL, 1)))
    compact = F.regexp_replace(label, "[^A-Z0-9]", "")
    parts = F.filter(F.split("slug", "-"), lambda t: t != "")
    left, right = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    tail = F.concat(left, F.lit("-"), right)
    pid = F.regexp_replace(F.upper(first(F.col("raw_url"), r"[?&](?:pid|product_id)=([^&#]*)", 1)), "[^A-Z0-9]", "")
    of = lambda sku, confidence: F.when(sku.isNotNull(), F.struct(sku.alias("sku"), F.lit(confidence).alias("confidence")))
    none = F.struct(F.lit(None).cast("string").alias("sku"), F.lit(None).cast("double").alias("confidence"))
    return F.when(blob.rlike(SKU), F.coalesce(of(_normal_sku(first(blob, SKU, 1)), 0.95), none)).otherwise(
        F.coalesce(
            of(_normal_sku(label), 0.78), of(F.when(F.length(compact) >= 6, F.concat(F.lit("PART-"), compact)), 0.62),
            of(F.when(~F.lower(left).isin(*SLUG_STOPS) & tail.rlike(SLUG_PART), _normal_sku(tail)), 0.7),
            of(F.when(F.length(pid) >= 6, F.concat(F.lit("PID-"), pid)), 0.45), none,
        )
    )


def _recovered() -> Column:
    """Part numbers in the text, the link and its adjacent path tokens, scored, the first of the best; beside a
    known one only its extensions count."""
    cur, base = F.col("found.sku"), F.col("found.confidence")
    left = F.substring_index(cur, "-", 1)
    right = F.expr("substring(found.sku, length(substring_index(found.sku, '-', 1)) + 2)")
    pattern = F.lit(r"\b([A-Z0-9]{4,}-[A-Z0-9]{1,16})\b")
    text = F.upper(squeeze(F.concat_ws(" ", "title", "source_text")))
    link = F.upper(F.coalesce(F.try_url_decode(F.regexp_replace("raw_url", "[+]", "%2B")), "raw_url"))
    of = lambda items, points, sure: F.transform(items, lambda c: F.struct(c.alias("c"), F.lit(points).alias("points"), F.lit(sure).alias("sure")))
    tokens = F.regexp_extract_all(F.upper(F.expr(U.path(SPARK, "raw_url"))), F.lit("[A-Z0-9]+"), F.lit(0))
    pairs = F.filter(F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: cur.isNotNull() | (F.length(p["b"]) >= 3))
    joined = F.transform(pairs, lambda p: F.concat(p["a"], F.lit("-"), p["b"]))
    found = F.concat(of(F.regexp_extract_all(text, pattern, F.lit(1)), 2.5, 0.95), of(F.regexp_extract_all(link, pattern, F.lit(1)), 2.0, 0.92), of(joined, 2.0, 0.92))
    first_part, last_part = lambda c: F.substring_index(c, "-", 1), lambda c: F.substring_index(c, "-", -1)

    def fits(x: Column) -> Column:
        a, b = first_part(x["c"]), last_part(x["c"])
        plausible = (F.length(a) >= 4) & a.rlike("[A-Z]") & a.rlike("[0-9]")
        return plausible & (cur.isNull() | ((a == left) & (F.length(b) > F.length(right)) & F.startswith(b, right)))

    def rated(x: Column, i: Column) -> Column:
        a, b = first_part(x["c"]), last_part(x["c"])
        short = (F.length(b) <= 2) & (F.length(a) >= 8)
        more = F.when(cur.isNotNull(), 1.8).otherwise(0.0)
        sure = F.when(cur.isNotNull(), F.greatest(x["sure"], F.lit(0.95))).otherwise(x["sure"])
        return F.struct((x["points"] + F.least(F.length(b), F.lit(12)) / 12.0 + more - F.when(short, 0.8).otherwise(0.0)).alias("score"), (-i).alias("at"), x["c"].alias("c"), (sure - F.when(short, 0.08).otherwise(0.0)).alias("sure"))

    best = F.array_max(F.transform(F.filter(found, fits), rated))
    return F.when(best.isNull(), F.struct(cur.alias("sku"), base.alias("confidence"))).otherwise(F.struct(best["c"].alias("sku"), F.round(F.least(F.lit(0.99), F.greatest(base, best["sure"])), 2).alias("confidence")))


def _model_parts() -> list[tuple[str, Column]]:
    """X26, in steps."""
    starts = F.lower("brand").isin(*MODEL_BRANDS) & F.startswith(F.lower("title"), F.concat(F.lower("brand"), F.lit(" ")))
    m = F.when(starts, F.trim(F.expr("substring(title, length(brand) + 1)"))).otherwise(F.col("title"))
    for p in MODEL_SPECS:
        m = F.regexp_replace(m, p, "")
    literal = lambda c: F.concat(F.lit(r"(?i)\Q"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("\u0001")), F.lit(r"\E"))
    m2 = F.regexp_replace(F.col("m1"), literal("found.sku"), F.lit(""))
    m2 = F.regexp_replace(F.regexp_replace(m2, SKU, ""), TRAIL, "")
    m2 = F.regexp_replace(m2, literal("processor"), F.lit(""))
    for p in MODEL_TAILS:
        m2 = F.regexp_replace(m2, p, "")
    for word in ("MacBook", "Air", "Pro"):
        m2 = F.regexp_replace(m2, rf"(?i)\b{word}\b", word)
    m2 = F.btrim(squeeze(m2), F.lit(" ,;|-"))
    x = F.col("m2")
    chip = F.coalesce(first(x, r"(?i)\bM([1-9])\b", 1), first(F.col("processor"), r"(?i)\bM([1-9])\b", 1))
    mac = _title_case(first(x, MACBOOK, 1))
    galaxy, moto = squeeze(first(x, GALAXY_BOOK)), squeeze(first(x, MOTOBOOK_PRO))
    mac_name = F.concat(F.lit("MacBook "), mac)
    name = F.coalesce(F.concat(mac_name, F.lit(" M"), chip), mac_name, F.regexp_replace(F.regexp_replace(galaxy, "galaxy", "Galaxy"), "book", "Book"), F.regexp_replace(moto, "motobook", "Motobook"), x)
    return [("m1", m), ("m2", m2), ("model", name)]


def _family() -> Column:
    """X27."""
    x, apple = F.col("model"), F.lower("brand") == "apple"
    mac = F.concat(F.lit("MacBook "), _title_case(first(x, MACBOOK, 1)))
    words = F.split(squeeze(x), " ")
    return F.when(x != "", F.coalesce(
        F.when(apple & x.rlike(MACBOOK_NEO), "MacBook Neo"), F.when(apple, mac), F.when(apple & x.rlike(r"(?i)\bMacBook\b"), "MacBook"),
        F.regexp_replace(F.regexp_replace(squeeze(first(x, GALAXY_BOOK)), "galaxy", "Galaxy"), "book", "Book"), F.regexp_replace(squeeze(first(x, MOTOBOOK)), "motobook", "Motobook"), F.array_join(F.slice(words, 1, 2), " "),
    ))


def _canonicality() -> Column:
    """struct(is_canonical_name, name_source)."""
    m = squeeze(F.col("model"))
    blob = F.lower(F.concat_ws(" ", "title", m))
    of = lambda ok, source: F.struct(F.lit(ok).alias("is_canonical_name"), F.lit(source).alias("name_source"))
    noisy = _has(blob, *NOISY) | m.rlike(r"[?=&]|[(-]$")
    return (
        F.when(F.coalesce(m, F.lit("")) == "", F.struct(F.lit(None).cast("boolean").alias("is_canonical_name"), F.lit(None).cast("string").alias("name_source")))
        .when(m.rlike(CANONICAL), of(True, "catalog_pattern"))
        .when(noisy, of(False, "marketplace_title"))
        .when((F.lower("brand") == "apple") & m.rlike(r"(?i)\bmacbook\s+neo\b"), of(False, "marketplace_naming"))
        .when((F.col("brand") != "") & F.startswith(F.lower(m), F.concat(F.lower("brand"), F.lit(" "))), of(True, "brand_prefixed"))
        .otherwise(of(True, "normalized_title"))
    )


def _calibrated() -> Column:
    """The sku's confidence by what the text and the link say; null below 0.4."""
    sku, bare = F.col("recovered.sku"), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    own, after = bare(sku), bare(F.regexp_replace(sku, "^[^-]*-", ""))
    given = sku.rlike("^(PID|PART)-")
    target = F.when(given, after).otherwise(own)
    blob = bare(F.concat_ws(" ", "title", "source_text", "slug", "raw_url", "brand", "model", "product_family"))
    path = F.lower(F.expr(U.path(SPARK, "raw_url")))
    pid = bare(first(F.col("raw_url"), r"[?&](?:pid|product_id)=([^&#]+)", 1))
    c = F.col("recovered.confidence")
    missing = F.when(~F.contains(blob, target), F.when(c < 0.8, 0.35).otherwise(0.2)).otherwise(0.0)
    kind = F.when(F.startswith(sku, F.lit("PID-")), F.when((pid != "") & F.contains(after, pid), 0.05).otherwise(-0.25)).when(F.startswith(sku, F.lit("PART-")), F.when(F.concat_ws(" ", "source_text", "title").rlike(PART_LABEL), 0.0).otherwise(-0.2)).otherwise(F.when(F.contains(bare(path), own), 0.0).otherwise(-0.1))
    words = F.slice(F.concat(F.slice(F.filter(F.split(F.expr(model_signature(SPARK, "model")), "-"), lambda t: t != ""), 1, 3), F.slice(F.filter(F.split(F.lower(F.coalesce("product_family", F.lit(""))), " "), lambda t: t != ""), 1, 2)), 1, 4)
    tokens = F.regexp_extract_all(path, F.lit("[a-z0-9]+"), F.lit(0))
    weak = F.when((F.size(words) > 0) & (path != "") & ~F.arrays_overlap(words, tokens), 0.08).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(0.99), c - missing + kind - weak))
    return F.when(sku.isNotNull() & (score >= 0.4), F.struct(sku.alias("sku"), F.round(score, 2).alias("confidence")))


def _memory() -> list[tuple[str, Column]]:
    """A pair in the text, else sizes in the slug."""
    blob, pair = F.concat_ws(" ", "source_text", "title"), MEMORY_PAIR
    medium = lambda k: F.when(F.lower(k) == "emmc", "eMMC").otherwise(F.upper(k))
    sizes = F.regexp_extract_all(F.col("slug"), F.lit(SLUG_SIZE), F.lit(0))
    label = lambda s: F.concat(first(s, r"^\d+"), F.lit(" "), F.upper(first(s, "gb|tb")))
    full = lambda s: F.rtrim(F.concat(label(s), F.lit(" "), F.coalesce(medium(first(s, "(?:ssd|hdd|ufs|rom|emmc)$")), F.lit(""))))
    one, two = F.try_element_at("sizes", F.lit(1)), F.try_element_at("sizes", F.lit(2))
    ram_said = F.concat(F.lit(" "), F.lower("title"), F.lit(" ")).rlike(RAM_SAID)
    has = blob.rlike(pair)
    ram = F.when(has, F.concat(first(blob, pair, 1), F.lit(" GB"))).when(two.isNotNull() | ram_said, label(one))
    storage = F.when(has, F.rtrim(F.concat(first(blob, pair, 2), F.lit(" "), F.upper(first(blob, pair, 3)), F.lit(" "), medium(first(blob, pair, 4))))).when(two.isNotNull(), full(two)).when(~ram_said, full(one))
    return [("sizes", sizes), ("ram", ram), ("storage", storage)]


def _prices() -> list[tuple[str, Column]]:
    """X10-X13."""
    text, sums = F.col("said"), F.col("sums")
    most, least = F.array_max("sums"), F.array_min("sums")
    effective = F.coalesce(digits(F.col("price")), least, keyword_price(text, ("offer", "deal", "sale", "now")))
    hint = keyword_price(text, ("mrp", "original", "was", "list price"))
    listed = F.when(most > F.coalesce(F.col("e0"), F.lit(0)), F.greatest(F.coalesce("h0", F.lit(0)), most)).otherwise(F.col("h0"))
    e1 = I.price_in_bounds(F.col("category"), F.coalesce("e0", "l0"))
    l1 = I.price_in_bounds(F.col("category"), F.col("l0"))
    l2 = F.when(F.col("e1").isNull() | ((F.col("l1") >= F.col("e1")) & (F.col("l1") <= F.col("e1") * 5)), F.col("l1"))
    rupee = lambda c: F.coalesce(F.contains(F.col(c), F.lit("₹")), F.lit(False))
    score = F.when(F.col("e1").isNotNull(), 0.62).otherwise(0.0) + F.when(F.col("list_price_inr").isNotNull(), 0.16).otherwise(0.0) + F.when(F.col("discount_percent").isNotNull(), 0.12).otherwise(0.0) + F.when(F.size(sums) >= 2, 0.05).otherwise(0.0) + F.when(rupee("price"), 0.06).otherwise(0.0) + F.when(rupee("said"), 0.04).otherwise(0.0)
    some = F.coalesce("e1", "list_price_inr").isNotNull()
    return [
        ("sums", amounts(text)), ("e0", effective), ("h0", hint), ("l0", listed), ("e1", e1), ("l1", l1), ("list_price_inr", l2), ("discount_percent", I.discount(F.col("list_price_inr"), F.col("e1"))),
        ("price_confidence", F.when(some, F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.99), score)), 2))), ("price_inr", F.coalesce(digits(F.col("price")), "e1")), ("effective_price_inr", F.coalesce("e1", "price_inr")),
    ]


def catalog_rows(rows: DataFrame, order: str, page_url: str = "url", stamp: str | None = None) -> DataFrame:
    """Listing rows (title, price, rating, review_count, availability, product_url, raw_text, url) -> the catalog's
    columns without the ids, and `order`.  `stamp` is the time that goes with review counts, given for reruns to agree."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in rows.columns else F.lit("")
    df = rows.select(order, text("title").alias("raw_title"), text("raw_text").alias("source_text"), text("product_url").alias("raw_url"), *(F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("price", "rating", "review_count", "availability")), text(page_url).alias("page_url"))
    # each step's columns read those of the steps before
    memory, prices, model = dict(_memory()), dict(_prices()), dict(_model_parts())
    some = lambda of, *names: {n: of[n] for n in names}
    family, version = _os(F.col("heard"))
    steps: list[dict[str, Column]] = [
        {"title": product_title(F.col("raw_title")), "product_url": F.expr(U.canonical(SPARK, "raw_url")), "said": F.coalesce(F.nullif(F.col("source_text"), F.lit("")), "raw_title"), "price_given": digits(F.col("price")), "rating_given": rating_text(F.col("rating")).cast("double")},
        {"slug": F.expr(U.slug(SPARK, "product_url", False))},
        {"brand": _brand(), "category": _category(F.lower(F.concat_ws(" ", "title", "slug", "page_url"))), "spoken": F.concat_ws(" ", "source_text", "title", F.regexp_replace("slug", "-", " ")), "heard": F.lower(F.concat_ws(" ", "source_text", "title", "slug"))},
        {
            "processor": _processor(), "found": _sku(), **some(memory, "sizes"), **some(prices, "sums", "h0"),
            "display": F.coalesce(F.concat(first(F.col("spoken"), DISPLAY_INCH, 1), F.lit(" inch")), F.concat(first(F.col("spoken"), DISPLAY_CM, 1), F.lit(" cm"))),
            "rating_": F.coalesce("rating_given", *(rating_text(first(F.col("said"), p, 1)).cast("double") for p in RATINGS)), "reviews": F.coalesce(digits(F.col("review_count")), digits(first(F.col("said"), REVIEWS, 1))),
        },
        {**some(model, "m1"), "os_family": family, "os_version": version, **some(prices, "e0"), **some(memory, "ram", "storage"), "recovered": _recovered()},
        {**some(model, "m2"), **some(prices, "l0")},
        {**some(model, "model"), **some(prices, "e1", "l1")},
        {"product_family": _family(), "named": _canonicality(), **some(prices, "list_price_inr", "price_inr")},
        {"sure": _calibrated(), **some(prices, "discount_percent", "effective_price_inr")},
        some(prices, "price_confidence"),
    ]
    for step in steps:
        df = df.withColumns(step)
    path = F.lower(F.regexp_replace(F.expr(U.path(SPARK, "product_url")), "/+$", ""))
    generic = F.lower("title").rlike(GENERIC_TITLE)
    specs = F.lower("source_text").rlike(SPEC_WORDS)
    drop = (F.col("product_url") != "") & path.endswith("/pr") & F.col("price_given").isNull() & F.col("rating_given").isNull() & (generic | ~specs)
    family_model = F.lower(F.concat_ws(" ", F.coalesce("product_family", F.lit("")), "model"))
    review = (F.col("named.is_canonical_name") == F.lit(False)) | ((F.lower("brand") == "apple") & F.contains(family_model, F.lit("macbook neo"))) | (family_model.rlike(REVIEW_WORDS) & (F.coalesce(F.col("named.name_source"), F.lit("")) != "catalog_pattern"))
    said = F.lower(F.concat_ws(" ", "said", "title"))
    scope = F.when(F.coalesce(F.col("reviews").cast("double"), "rating_").isNull(), F.lit(None)).when(said.rlike(VARIANT_SIZES), "variant").when(_has(said, "reviews", "ratings"), "listing").otherwise("unknown")
    made = {
        "sku": F.col("sure.sku"), "sku_confidence": F.col("sure.confidence"), "is_canonical_name": F.col("named.is_canonical_name"), "name_source": F.col("named.name_source"), "canonical_review_required": F.coalesce(review, F.lit(False)),
        "os": F.rtrim(F.concat("os_family", F.lit(" "), F.coalesce("os_version", F.lit("")))), "rating": F.col("rating_"), "review_count": F.col("reviews"), "review_scope": scope, "review_count_timestamp": F.when(F.col("reviews").isNotNull(), F.lit(stamp)), "availability": F.nullif(state(F.coalesce(F.nullif(F.trim("availability"), F.lit("")), "said")), F.lit("")),
        "ram": F.nullif(F.trim("ram"), F.lit("")), "storage": F.nullif(F.trim("storage"), F.lit("")),
    }
    out = df.withColumn("_drop", F.coalesce(drop, F.lit(False))).withColumn("_row", F.monotonically_increasing_id())
    out = out.filter("_row >= 0 AND NOT _drop")  # the row number keeps the predicate above the projections
    return out.select(order, *(made.get(c, F.col(c)).alias(c) for c in COLUMNS if c not in IDS))


def catalog(rows: DataFrame, order: str, stamp: str | None = None) -> DataFrame:
    """Projection, merge of variants, ids; 36 columns and `order`."""
    from ..plans.lineage import settle

    merged = settle(I.merge_variants(settle(catalog_rows(rows, order, stamp=stamp)), order))
    return I.catalog_entities(merged, order).select(order, *COLUMNS)


#: What a job is told of its transformation.
APPLIED, DEDUPED = "structured_product_schema_applied", "structured_product_rows_deduped"


def catalog_jobs(rows: DataFrame, job: str, order: str, stamp: str | None = None) -> tuple[DataFrame, DataFrame]:
    """G13, job by job: listing rows with their job and an `order` within it -> (the catalog of each: job, order and 36
    columns, and for each job that had rows its warnings).  Variants and skus meet within a job only."""
    from ..plans.lineage import settle

    key = F.struct(F.col(job), F.col(order))
    made = settle(catalog_rows(rows.withColumn("_key", key).drop(job, order), "_key", stamp=stamp))
    made = made.select(F.col(f"_key.{job}").alias(job), F.col(f"_key.{order}").alias(order), *(c for c in made.columns if c != "_key"))
    merged = settle(I.merge_variants(made, order, (job,)))
    before, after = (df.groupBy(job).agg(F.count(F.lit(1)).alias(n)) for df, n in ((made, "_before"), (merged, "_after")))
    counts = rows.select(job).distinct().join(before, job, "left").join(after, job, "left")
    told = F.when(F.col("_after") < F.col("_before"), F.array(F.lit(APPLIED), F.lit(DEDUPED))).otherwise(F.array(F.lit(APPLIED)))
    return I.catalog_entities(merged, order, (job,)).select(job, order, *COLUMNS), counts.select(job, told.alias("warnings"))
