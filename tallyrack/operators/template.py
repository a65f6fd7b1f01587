"""Rows and next pages by templates' selectors (D23-D25, X38, U2): one DOM pass, then native columns.

Templates are rows: a page comes with the selectors of all those that may read it, whatever their fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle
from ..sources import dom
from .extract import first, squeeze

# Parts of field names that tell how a value is read, and what is read of it.
URL_NAMES = ("url", "link", "product_url", "profile_url", "website", "href")
PRICE_NAMES = ("price", "amount", "cost", "mrp")
RATING_NAMES = ("rating", "score", "stars")
KIND_NAMES = {"url": ("url", "link", "href", "website"), "money": PRICE_NAMES, "rating": ("rating", "score", "stars", "review")}
PRICE_VALUE = r"(?i)(?:₹|\$|€|£|USD|EUR|INR|GBP|JPY|AUD|CAD)\s*\d[\d,]*(?:\.\d+)?"
RATING_VALUE = r"(?i)\b(\d(?:[.,]\d)?)\s*(?:/\s*5|out of 5|stars?)\b"


@dataclass(frozen=True)
class Template:
    """Selectors of a site's listing pages."""

    container_selector: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    list_selector: str | None = None
    next_selector: str | None = None
    next_type: str = ""
    template_id: str = ""
    version: int = 1

    @property
    def container(self) -> str | None:
        return next((s.strip() for s in (self.container_selector, self.list_selector) if s and s.strip()), None)


def field_infos(template: Template) -> list[tuple[str, str, float]]:
    """(name, kind, confidence) of a template's fields."""
    kinds = {name: next((kind for kind, words in KIND_NAMES.items() if any(w in name.lower() for w in words)), "text") for name in template.fields}
    return [(name, kind, 0.9 if kind == "text" else 0.95) for name, kind in kinds.items()]


def _named(name: Column, words: tuple[str, ...]) -> Column:
    return F.lower(name).rlike("|".join(words))


def field_value(name: Column, value: Column) -> Column:
    """By its field's name an address as it is, a sum of money or a rating where there is one, else the text."""
    text = squeeze(F.coalesce(value, F.lit("")))
    rating = F.regexp_replace(first(text, RATING_VALUE, 1), ",", ".")
    return F.when(_named(name, URL_NAMES), text).when(_named(name, PRICE_NAMES), F.coalesce(first(text, PRICE_VALUE), text)).when(_named(name, RATING_NAMES), F.coalesce(rating, text)).otherwise(text)


def programs(template: Template) -> Column:
    """One template's selectors for every page."""
    fields = F.create_map(*(F.lit(x) for kv in template.fields.items() for x in kv)) if template.fields else F.lit(None).cast("map<string,string>")
    return F.array(F.struct(F.lit(template.template_id).alias("template_id"), F.lit(template.container).cast("string").alias("container"), fields.alias("fields"), F.lit(template.next_selector).cast("string").alias("next")))


def found_rows(read: DataFrame, max_rows: int) -> DataFrame:
    """Pages that templates have read (dom.read_pages(pages, 2 * max_rows)) -> (page_id, template_id, idx, values
    map, warning).  Of a page's first 2 * max_rows containers those with a value count, max_rows of them at most, repeats
    once; a page without rows has one row with a warning.  The caps are the request's own limit on a page."""
    each = read.select("page_id", F.explode("by_template").alias("t")).select("page_id", "t.template_id", "t.warning", "t.rows")
    found = each.select("page_id", "template_id", F.posexplode("rows").alias("idx", "raw"))
    found = settle(found.withColumn("values", F.transform_values("raw", field_value)).drop("raw"))
    found = found.filter(F.exists(F.map_values("values"), lambda v: v != ""))
    nth = Window.partitionBy("page_id", "template_id").orderBy("idx")
    found = found.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= max_rows)
    sign = F.array_sort(F.transform(F.map_entries("values"), lambda e: F.struct(e["key"].alias("k"), F.lower(F.trim(e["value"])).alias("v"))))
    same = Window.partitionBy("page_id", "template_id", "_s").orderBy("idx")
    rows = settle(found.withColumn("_s", sign).withColumn("_n", F.row_number().over(same)).filter("_n = 1").select("page_id", "template_id", "idx", "values", F.lit(None).cast("string").alias("warning")))
    bare = each.join(rows.select("page_id", "template_id").distinct(), ["page_id", "template_id"], "left_anti")
    return rows.unionByName(bare.select("page_id", "template_id", F.coalesce("warning", F.lit("template_rows_empty")).alias("warning")), allowMissingColumns=True)


def found_next(read: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(page_id, template_id, next_url, warning): the address of the pagination selector's first node.  `kinds`
    (template_id, next_type) names each template's pagination."""
    out = read.select("page_id", F.explode("by_template").alias("t")).select("page_id", "t.template_id", "t.next_url", F.col("t.next_warning").alias("warning"))
    if kinds is None:
        return out
    kind = F.lower(F.trim(F.coalesce("next_type", F.lit(""))))
    used = F.when(F.col("next_url").isNotNull(), F.when(kind != "", F.concat(F.lit("template_pagination_"), kind, F.lit("_used")))).otherwise(F.col("warning"))
    return out.join(kinds.select("template_id", "next_type"), "template_id", "left").select("page_id", "template_id", "next_url", used.alias("warning"))


def template_rows(pages: DataFrame, template: Template, max_rows: int) -> DataFrame:
    """found_rows() of one template on pages (page_id, url, html)."""
    read = settle(dom.read_pages(pages.select("page_id", "url", "html").withColumn("programs", programs(template)), 2 * max_rows, False))
    return found_rows(read, max_rows).drop("template_id")


def template_next(pages: DataFrame, template: Template) -> DataFrame:
    """found_next() of one template: (page_id, next_url, warning); pages (page_id, url, html), or as it has read them."""
    read = pages
    if "by_template" not in pages.columns:
        read = dom.read_pages(pages.select("page_id", "url", "html").withColumn("programs", programs(template)), 0, False)
    kinds = read.sparkSession.createDataFrame([(template.template_id, template.next_type)], "template_id string, next_type string")
    return found_next(read, kinds).drop("template_id")
