"""Next pages and crawls over stored pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dialect import SPARK
from ..plans.lineage import settle, spread
from .extract import resolved


def _absolute(ref: str) -> Column:
    return F.expr(U.join(SPARK, "url", ref))


def next_pages(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, url, next_url, mode): rel=next, then links, then data attributes, then a page parameter."""
    real = F.filter("links", lambda a: (F.trim(a["href"]) != "") & ~F.trim(a["href"]).rlike(r"(?i)^(#|javascript:)"))

    def mode(a: Column) -> Column:
        said = F.concat_ws(" ", a["text"], a["hints"])
        is_next = a["text"].rlike("(?i)^(next|next page|>|>>|›|→)$") | said.rlike("(?i)next|older|forward|more results")
        return F.when(is_next, "next").when(said.rlike("(?i)load more|show more|view more|more results"), "load_more").when(a["area"].rlike("(?i)pagination|pager|paginator|load-more"), "infinite")

    marked = F.try_element_at(F.filter(F.transform(real, lambda a: F.struct(F.trim(a["href"]).alias("href"), mode(a).alias("mode"))), lambda x: x["mode"].isNotNull()), F.lit(1))
    hint = F.substring("html", 1, 3500).rlike("(?i)next|load more|show more|pagination")
    out = parsed.select("page_id", "url", "rel_next", "link_rel_next", marked.alias("m"), F.coalesce("data_next", "script_next").alias("data")).join(pages.select("page_id", "html"), "page_id")
    out = out.withColumn("bumped", F.when(hint, F.expr(U.next_page(SPARK, "url"))))
    way = F.when(F.col("rel_next").isNotNull(), "rel_next").when(F.col("link_rel_next").isNotNull(), "link_rel_next").when(F.col("m").isNotNull(), F.col("m.mode")).when(F.col("data").isNotNull(), "data").when(F.col("bumped").isNotNull(), "increment")
    ref = F.coalesce("rel_next", "link_rel_next", "m.href", "data", "bumped")
    out = out.select("page_id", "url", way.alias("mode"), ref.alias("ref"))
    out = out.withColumn("next_url", F.when(F.col("ref").isNotNull(), _absolute("ref")))
    return out.select("page_id", "url", resolved(F.col("next_url"), F.col("ref")).alias("next_url"), "mode")


#: What each way of finding the next page is reported as.
WARNINGS = {"load_more": "pagination_load_more_detected", "next": "pagination_next_detected", "infinite": "pagination_infinite_scroll_hint_detected", "data": "pagination_data_next_detected", "increment": "pagination_query_increment_used"}


def with_warning(found: DataFrame) -> DataFrame:
    """next_pages() with an array of warnings; rel=next has none."""
    known = F.create_map(*(F.lit(v) for kv in WARNINGS.items() for v in kv))
    warning = F.try_element_at(known, F.coalesce("mode", F.lit("")))
    return found.withColumn("warnings", F.when(warning.isNull(), F.array().cast("array<string>")).otherwise(F.array(warning)))


def template_next_pages(found: DataFrame, by_template: DataFrame) -> DataFrame:
    """next_pages() with warnings, a template's own next page first, the others' where it has none."""
    own = by_template.select("page_id", F.col("next_url").alias("_own"), F.when(F.col("warning").isNull(), F.array().cast("array<string>")).otherwise(F.array("warning")).alias("_w"))
    fallback = F.concat(F.array(F.lit("template_pagination_fallback_used")), "warnings")
    both = found.join(own, "page_id")
    return both.select("page_id", "url", F.coalesce("_own", "next_url").alias("next_url"), F.concat("_w", F.when(F.col("_own").isNull() & F.col("next_url").isNotNull(), fallback).otherwise(F.array().cast("array<string>"))).alias("warnings"))


def chains(starts: DataFrame, edges: DataFrame, max_pages: int) -> DataFrame:
    """starts (job_id, url), edges (url, next_url) -> (job_id, url, page_no): the pages a crawl reaches, in order.  A
    page that was visited ends it.  One join a step, written each time; jobs that ended aren't carried on.  Where starts
    and edges have a `via` (a template), a job goes by the edges of its own."""
    via = ["via"] if "via" in starts.columns else []
    known = settle(edges.select(F.col("url").alias("_from"), *via, "next_url").filter("next_url IS NOT NULL").groupBy("_from", *via).agg(F.min("next_url").alias("next_url")))
    step = settle(starts.select("job_id", *via, "url", F.lit(1).alias("page_no"), F.array("url").alias("seen")))
    out = step.select("job_id", *via, "url", "page_no")
    for _ in range(max_pages - 1):
        onward = step.withColumnRenamed("url", "_from").join(known, ["_from", *via]).filter(~F.array_contains("seen", F.col("next_url")))
        step = settle(onward.select("job_id", *via, F.col("next_url").alias("url"), (F.col("page_no") + 1).alias("page_no"), F.array_append("seen", F.col("next_url")).alias("seen")))
        if step.isEmpty():
            break
        out = out.unionByName(step.select("job_id", *via, "url", "page_no"))
    return out


def page_signature(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A hash of a page's first twenty rows."""
    sign = F.concat_ws("\u0001", *(F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields))
    first = F.slice(F.sort_array(F.collect_list(F.struct("idx", sign.alias("s")))), 1, 20)
    return rows.groupBy("page_id").agg(F.sha1(F.array_join(F.transform(first, lambda x: x["s"]), "|")).alias("signature"))


def crawl_jobs(visits: DataFrame, rows: DataFrame, fields: list[str], max_rows: int, max_pages: int = 100, duplicate_cutoff: float = 0.8, max_low_yield: int = 1, by_template: bool = False) -> DataFrame:
    """Visits (job_id, page_no, page_id; page_id is null for a page that isn't stored; url, next_url, text,
    found and warnings where they are known) and rows (page_id, idx, fields) -> one row a job: (job_id, rows, pages,
    partial, stop, warnings).  found: warnings of reading a page; warnings: of looking for its next one.

    Whether a page counts depends on those before it, so one job's visits are folded in order; a job has at most
    max_pages of max_rows rows, which bounds the group."""
    known, none = dict(visits.dtypes), F.array().cast("array<string>")
    of = lambda c, other: F.coalesce(F.col(c), other).alias(c) if c in known else other.alias(c)
    own = F.struct("idx", F.array(*(F.col(f"`{f}`").cast("string") for f in fields)).alias("v"))
    grouped = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(own)).alias("own"))
    blank = F.lit(None).cast("string")
    joined = visits.join(grouped, "page_id", "left").select("job_id", "page_no", "page_id", of("url", blank), of("next_url", blank), of("text", F.lit("")), of("found", none), of("warnings", none), F.transform(F.coalesce("own", F.array().cast("array<struct<idx:int,v:array<string>>>")), lambda x: x["v"]).alias("own"))

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kept, said, seen, pages_seen, visited = [], [], set(), set(), set()
        pages, low, partial, stop = 0, 0, False, "no_next_page"
        for page in frame.sort_values("page_no").itertuples():
            visited.add(page.url)
            if pd.isna(page.page_id):
                said, partial, stop = [*said, "page_load_failed"], pages > 0, "page_load_failed"
                break
            own = [tuple(v) for v in page.own][: max_rows - len(kept)]
            signs = [tuple((v or "").strip().lower() for v in r) for r in own]
            said.extend(page.found)
            mark = tuple(signs[:20]) if own else page.text[:1200]
            if mark in pages_seen:
                said, partial, stop = [*said, "repeated_page_signature_detected"], pages > 0, "repeated_page_signature_detected"
                break
            pages_seen.add(mark)
            new = []
            for r, s in zip(own, signs, strict=True):
                if s not in seen:
                    seen.add(s)
                    new.append(r)
            if own and (len(own) - len(new)) / len(own) >= duplicate_cutoff and pages > 0:
                said, partial, stop = [*said, "duplicate_row_cutoff_reached"], True, "duplicate_row_cutoff_reached"
                break
            low = 0 if new else low + 1
            said += [] if new else ["page_yield_low"]
            kept, pages = kept + new, pages + 1
            if len(kept) >= max_rows:
                stop = "max_rows"
                break
            if low > max_low_yield:
                said, partial, stop = [*said, "consecutive_low_yield_cutoff_reached"], True, "consecutive_low_yield_cutoff_reached"
                break
            said.extend(page.warnings)
            if page.next_url and pages >= max_pages:
                stop = "max_pages"
                break
            if page.next_url in visited:
                said, stop = [*said, "repeated_page_detected"], "repeated_page_detected"
                partial = partial or (by_template and pages > 0)
        if by_template and not kept:
            said.append("template_rows_empty")
        values = [{f: v for f, v in zip(fields, r, strict=True)} for r in kept]
        return pd.DataFrame([{"job_id": key[0], "rows": values, "pages": pages, "partial": partial, "stop": stop, "warnings": list(dict.fromkeys(said)) if not by_template else said}])

    kind = ", ".join(f"`{f}`: string" for f in fields)
    return spread(joined, "job_id").groupBy("job_id").applyInPandas(fold, f"job_id {known['job_id']}, rows array<struct<{kind}>>, pages int, partial boolean, stop string, warnings array<string>")


def crawl(visits: DataFrame, rows: DataFrame, fields: list[str], max_rows: int, **limits) -> DataFrame:
    """The rows of crawl_jobs(): (job_id, row_index from 1, fields, pages, partial, stop)."""
    jobs = crawl_jobs(visits, rows, fields, max_rows, **limits)
    flat = jobs.select("job_id", F.posexplode("rows").alias("_k", "_r"), "pages", "partial", "stop")
    return flat.select("job_id", (F.col("_k") + 1).alias("row_index"), *(F.col(f"_r.{f}").alias(f) for f in fields), "pages", "partial", "stop")
