"""Previews and full runs over stored pages: prompt or template to rows, catalog rows and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dialect import SPARK
from ..operators import extract as X
from ..operators import paginate as P
from ..operators import store
from ..operators import structured as S
from ..operators import template as T
from ..sources import dom
from .lineage import settle


@dataclass(frozen=True)
class Limits:
    """What a request may ask for."""

    max_rows: int = 100
    max_pages: int = 10
    duplicate_cutoff: float = 0.8
    max_low_yield: int = 1

    def __post_init__(self) -> None:
        if not 1 <= self.max_rows <= 5000 or not 1 <= self.max_pages <= 100:
            raise ValueError("max_rows is 1 to 5000, max_pages 1 to 100")


def preview(pages: DataFrame, prompt: str, max_rows: int = 20, rendered: DataFrame | None = None, placeholders: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of each page, and one summary a page (rows, listing or detail, warnings).  max_rows is 1 to 100.  Pages
    without rows are read again as `rendered` (page_id, html) has them; made-up rows only come on request."""
    if not 1 <= max_rows <= 100:
        raise ValueError("max_rows is 1 to 100")
    asked = S.fields_of(prompt)
    rows = settle(X.listing_rows(dom.parse_pages(pages), max_rows, fields=X.with_defaults(asked)))
    some = F.array().cast("array<string>")
    state = pages.select("page_id", "url").join(rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")), "page_id", "left").withColumn("warnings", some)
    if rendered is not None:
        again = settle(pages.select("page_id", "url").join(rows.select("page_id"), "page_id", "left_anti").join(rendered.select("page_id", "html"), "page_id"))
        more = settle(X.listing_rows(dom.parse_pages(again), max_rows, fields=X.with_defaults(asked)))
        tried = again.select("page_id", F.lit("playwright_retry_after_extraction_empty").alias("_w")).join(more.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")), "page_id", "left")
        state = state.join(tried, "page_id", "left").select("page_id", "url", F.coalesce("n", "_n").alias("n"), F.when(F.col("_w").isNotNull(), F.array("_w")).otherwise(some).alias("warnings"))
        rows = rows.unionByName(more)
    empty = F.coalesce("n", F.lit(0)) == 0
    said = ["extraction_empty", "fallback_generated_rows"] if placeholders else ["extraction_empty"]
    state = state.withColumn("warnings", F.concat("warnings", F.when(empty, F.array(*map(F.lit, said))).otherwise(some)))
    if placeholders:
        rows = rows.unionByName(X.placeholders(state.filter(empty).select("page_id", "url"), min(max_rows, 10), [c for c in rows.columns if c not in ("page_id", "idx")]))
        state = state.withColumn("n", F.when(empty, F.lit(min(max_rows, 10))).otherwise(F.col("n")))
    summary = state.select("page_id", F.coalesce("n", F.lit(0)).alias("rows"), F.when(F.col("n") > 1, "listing").otherwise("detail").alias("page_type"), "warnings")
    return rows.select("page_id", "idx", *asked), summary


def visits_of(jobs: DataFrame, pages: DataFrame, parsed: DataFrame, found: DataFrame, max_pages: int) -> DataFrame:
    """jobs (job_id, url) -> the pages each crawl comes to, in order, with what crawl_jobs() reads of them.  A page that
    isn't stored has a null page_id."""
    known = found.select("url", "next_url", "warnings", "page_id").join(parsed.select("page_id", F.substring("text", 1, 1200).alias("text")), "page_id")
    return P.chains(jobs, found, max_pages).join(known, "url", "left")


def run_jobs(jobs: DataFrame, pages: DataFrame, prompt: str, limits: Limits = Limits(), template: T.Template | None = None) -> DataFrame:
    """Jobs (job_id, url) over stored pages -> one row a job: (job_id, rows, pages, partial, stop, warnings).
    With a template rows and next pages are its own; where it finds no next page, the general rules do.  Pages are
    parsed once."""
    pages = settle(pages.select("page_id", "url", "html"))
    if template is None:
        return _by_rules(jobs, pages, settle(dom.read_pages(pages)), prompt, limits)
    read = settle(dom.read_pages(pages.withColumn("programs", T.programs(template)), 2 * limits.max_rows))
    fields = list(template.fields)
    made = settle(T.found_rows(read, limits.max_rows))
    rows = made.filter("idx IS NOT NULL").select("page_id", "idx", *(F.col("values")[f].alias(f) for f in fields))
    bare = made.filter("warning IS NOT NULL").select("page_id", F.array("warning").alias("found"))
    found = P.template_next_pages(P.with_warning(P.next_pages(read, pages)), T.template_next(read, template))
    visits = visits_of(jobs, pages, read, settle(found), limits.max_pages).join(bare, "page_id", "left")
    return P.crawl_jobs(visits, rows, fields, limits.max_rows, limits.max_pages, limits.duplicate_cutoff, limits.max_low_yield, True)


def _by_rules(jobs: DataFrame, pages: DataFrame, read: DataFrame, prompt: str, limits: Limits) -> DataFrame:
    """Jobs without a template."""
    fields = list(X.with_defaults(S.fields_of(prompt)))
    rows = settle(X.listing_rows(read, limits.max_rows, fields=tuple(fields)))
    bare = read.select("page_id").join(X.container_pages(read), "page_id", "left_anti").select("page_id", F.array(F.lit("container_detection_fallback")).alias("found"))
    visits = visits_of(jobs, pages, read, settle(P.with_warning(P.next_pages(read, pages))), limits.max_pages).join(bare, "page_id", "left")
    return P.crawl_jobs(visits, rows, fields, limits.max_rows, limits.max_pages, limits.duplicate_cutoff, limits.max_low_yield)


_VALUES = "map<string,string>"


def _by_templates(jobs: DataFrame, pages: DataFrame, read: DataFrame, templates: DataFrame, limits: Limits) -> DataFrame:
    """Jobs (job_id, url, template_id), each by its own template: crawl_jobs() with rows of maps.

    A page is known by its id and the template that read it.  Pages that a crawl comes to from another domain weren't
    read by its template yet: those are read before the crawl goes on, as long as there are any."""
    general = settle(P.with_warning(P.next_pages(read, pages)))
    texts = read.select("page_id", F.substring("text", 1, 1200).alias("text"))
    key = F.concat_ws("\u0001", F.col("page_id").cast("string"), "template_id")
    starts = jobs.select("job_id", "url", F.col("template_id").alias("via"))
    read = read.select("page_id", "url", "by_template")
    for _ in range(limits.max_pages):
        made = settle(T.found_rows(read, limits.max_rows).withColumn("page", key))
        onward = T.found_next(read, templates).withColumnRenamed("warning", "_w")
        own = general.join(onward.withColumnRenamed("next_url", "_own"), "page_id")
        none = F.array().cast("array<string>")
        fallback = F.concat(F.array(F.lit("template_pagination_fallback_used")), "warnings")
        said = F.concat(F.when(F.col("_w").isNull(), none).otherwise(F.array("_w")), F.when(F.col("_own").isNull() & F.col("next_url").isNotNull(), fallback).otherwise(none))
        edges = settle(own.select("page_id", "url", F.col("template_id").alias("via"), F.coalesce("_own", "next_url").alias("next_url"), said.alias("warnings")))
        chain = settle(P.chains(starts, edges, limits.max_pages))
        unread = chain.select("url", "via").distinct().join(edges.select("url", "via"), ["url", "via"], "left_anti").join(pages.select("page_id", "url", "html"), "url")
        wanted = unread.join(templates, unread["via"] == templates["template_id"]).groupBy("page_id", "url").agg(F.first("html").alias("html"), F.collect_list(F.struct("template_id", "container", "fields", "next")).alias("programs"))
        more = settle(dom.read_pages(wanted, 2 * limits.max_rows, False).select("page_id", "url", "by_template"))
        if more.isEmpty():
            break
        read = settle(read.unionByName(more))
    bare = made.filter("warning IS NOT NULL").select("page", F.array("warning").alias("found"))
    visits = chain.join(edges, ["url", "via"], "left").join(texts, "page_id", "left").withColumn("page", F.when(F.col("page_id").isNotNull(), F.concat_ws("\u0001", F.col("page_id").cast("string"), "via"))).drop("page_id").join(bare, "page", "left").withColumnRenamed("page", "page_id")
    rows = made.filter("idx IS NOT NULL").select(F.col("page").alias("page_id"), "idx", F.to_json("values").alias("values"))
    done = P.crawl_jobs(visits, rows, ["values"], limits.max_rows, limits.max_pages, limits.duplicate_cutoff, limits.max_low_yield, True)
    return done.withColumn("rows", F.transform("rows", lambda r: F.from_json(r["values"], _VALUES)))


def dispatch_jobs(jobs: DataFrame, pages: DataFrame, templates: DataFrame, prompt: str, limits: Limits = Limits()) -> DataFrame:
    """Jobs (job_id, url; template_id if one is asked for; status, force) over stored pages, each by the template
    that matches its first page, else by the general rules -> (job_id, status, template_id, by_template, rows array of
    maps, pages, partial, stop, warnings).

    templates: (template_id, version, domain, page_fingerprint, page_type, success_rate, updated_at, invalidated,
    container, fields map, next, next_type).  A page is parsed once, for all templates that a job of its domain may be
    given, and matched by what that parse has found.  A job whose template finds no rows is done by the rules, with both
    sets of warnings.  Jobs that are over don't run again (store.due)."""
    jobs = settle(store.due(jobs))
    pages = settle(pages.select("page_id", "url", "html"))
    templates = settle(templates.withColumn("template_id", F.col("template_id").cast("string")))
    asked = "template_id" in jobs.columns
    jobs = jobs.select("job_id", "url", *([F.col("template_id").cast("string").alias("template_id")] if asked else []), _domain())
    own = store.template_candidates(templates).join(jobs.select("domain"), "domain", "left_semi")
    if asked:
        own = own.unionByName(jobs.filter("template_id IS NOT NULL").select("domain", "template_id")).distinct()
    selectors = own.join(templates.select("template_id", "container", "fields", "next"), "template_id").groupBy("domain").agg(F.collect_list(F.struct("template_id", "container", "fields", "next")).alias("programs"))
    read = settle(dom.read_pages(pages.withColumn("domain", _domain()).join(selectors, "domain", "left"), 2 * limits.max_rows))
    first = jobs.withColumnRenamed("job_id", "page_id").join(read.groupBy("url").agg(F.min("fingerprint").alias("fingerprint")), "url", "left")
    # A template is looked for on the first page; without it only one that is asked for is used.
    stored = F.col("fingerprint").isNotNull() | (F.col("template_id").isNotNull() if asked else F.lit(False))
    matched = store.match_templates(first.filter(stored), templates).select(F.col("page_id").alias("job_id"), "template_id").filter("template_id IS NOT NULL")
    plan = settle(jobs.select("job_id", "url").join(matched, "job_id", "left"))
    told = templates.select("template_id", F.array(F.concat(F.lit("template_matched:"), "template_id"), F.concat(F.lit("template_version:"), F.col("version").cast("string"))).alias("told"))
    tried = _by_templates(plan.filter("template_id IS NOT NULL"), pages, read, templates, limits)
    tried = settle(tried.join(plan.select("job_id", "template_id"), "job_id").join(told, "template_id").withColumn("warnings", F.concat("told", "warnings")).drop("told"))
    good = tried.filter(F.size("rows") > 0).withColumn("by_template", F.lit(True))
    failed = tried.filter(F.size("rows") == 0).select("job_id", "template_id", F.col("warnings").alias("before"))
    ruled = _by_rules(plan.join(good.select("job_id"), "job_id", "left_anti").select("job_id", "url"), pages, read, prompt, limits)
    names = S.fields_of(prompt)
    as_map = lambda r: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(r[n] for n in names)))
    ruled = ruled.join(failed, "job_id", "left").withColumn("rows", F.transform("rows", as_map)).withColumn("warnings", F.concat(F.coalesce("before", F.array().cast("array<string>")), "warnings")).drop("before").withColumn("by_template", F.lit(False))
    both = good.unionByName(ruled)
    return both.select("job_id", F.when(F.col("partial"), "partial_success").otherwise("success").alias("status"), "template_id", "by_template", "rows", "pages", "partial", "stop", "warnings")


def catalog_of(done: DataFrame, prompt: str, stamp: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What dispatch_jobs() has found -> (rows, jobs).  If the prompt asks for the catalog's columns, each job's rows
    become its catalog (job_id, row_index and 36 columns) and its warnings end with what was done; else rows are the maps
    as they are (job_id, row_index, row)."""
    flat = done.select("job_id", F.posexplode("rows").alias("_k", "row")).select("job_id", (F.col("_k") + 1).alias("row_index"), "row")
    if not S.wants_catalog(prompt):
        return flat, done.drop("rows")
    names = ("title", "price", "rating", "review_count", "availability", "product_url", "raw_text", "url")
    rows = flat.select("job_id", "row_index", *(F.try_element_at("row", F.lit(n)).alias(n) for n in names))
    found, told = S.catalog_jobs(rows, "job_id", "row_index", stamp)
    jobs = done.drop("rows").join(told.withColumnRenamed("warnings", "_told"), "job_id", "left").withColumn("warnings", F.concat("warnings", F.coalesce("_told", F.array().cast("array<string>")))).drop("_told")
    return found, jobs


def template_outcomes(done: DataFrame) -> DataFrame:
    """What dispatch_jobs() tells of its templates, for store.template_health(): (template_id, success, job_id)."""
    return done.filter("template_id IS NOT NULL").select("template_id", F.col("by_template").alias("success"), "job_id")


def _domain() -> Column:
    return F.expr(U.domain(SPARK, "url")).alias("domain")


def run(jobs: DataFrame, pages: DataFrame, prompt: str, limits: Limits = Limits(), stamp: str | None = None) -> DataFrame:
    """The rows of run_jobs().  If the prompt asks for the catalog's columns, the rows of all these jobs become
    one catalog; `order` is then the (job_id, row_index) of a variant's first row."""
    fields = S.fields_of(prompt)
    done = run_jobs(jobs, pages, prompt, limits).select("job_id", F.posexplode("rows").alias("_k", "_r"), "pages", "partial", "stop")
    rows = done.select("job_id", (F.col("_k") + 1).alias("row_index"), *(F.col(f"_r.{f}").alias(f) for f in fields), "pages", "partial", "stop")
    if not S.wants_catalog(prompt):
        return rows
    ordered = rows.join(jobs.select("job_id", "url"), "job_id").withColumn("order", F.struct("job_id", "row_index"))
    return S.catalog(settle(ordered), "order", stamp)
