"""The queries of the catalog engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records as R
from .functions import urls as U
from .functions.dialect import DUCK, SPARK, Dialect
from .operators import clean as C
from .operators import extract as X
from .operators import paginate as P
from .operators import structured as G
from .operators import export as E
from .operators import identity as I
from .operators import labels as A
from .operators import metrics as M
from .operators import store as S
from .operators import template as T
from .plans import listings as L
from .plans import offers as O
from .plans import runs as N
from .plans.lineage import settle
from .plans.tables import derived, sql_of
from .sources import dom
from .sources import warc as W
from .streaming import limits, queue

Query = Callable[[SparkSession, str], DataFrame]
CATALOG = ["idx", "brand", "category", "product_family", "model", "sku"]


def _scalars(columns: Callable[[Dialect], dict[str, str]], key: str, source: str, table: str) -> tuple[Query, str]:
    """A projection of scalar functions over a table or a derived one, with its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = O.offers(spark, sf_dir) if table == "offers" else spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(key, *(F.expr(sql).alias(c) for c, sql in columns(SPARK).items()))

    return run, f"SELECT {key}, " + ", ".join(f"{sql} AS {c}" for c, sql in columns(DUCK).items()) + f" FROM ({source})"


def _offer_fields(d: Dialect) -> dict[str, str]:
    return {"clean_title": R.title(d, "title"), "price_inr": R.price(d, "price"), "rating": R.rating(d, "rating"), "rating_in": R.rating_in(d, "title"), "reviews": R.review_count(d, "review_count"), "reviews_in": R.reviews_in(d, "title"), "availability": R.availability(d, "availability", "description"), "os": R.system(d, "cast(NULL AS varchar(10))", "description"), "display": R.display(d, "cast(NULL AS varchar(10))", "title"), "processor": R.processor(d, "title"), "category": R.category(d, "category", "title", "description")}


def _url_fields(d: Dialect) -> dict[str, str]:
    return {"domain": U.domain(d, "url"), "canonical": U.canonical(d, "url"), "link": U.product_link(d, "url"), "last_slug": U.slug(d, "url"), "first_slug": U.slug(d, "url", False), "is_product": U.looks_like_product(d, "url"), "valid_link": U.is_product_page(d, "url"), "next_url": U.next_page(d, "url"), "joined": U.join(d, "url", "'/next?page=2'"), "relative": U.join(d, "url", "'more.html'")}


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = O.offers(spark, sf_dir).select("idx", F.expr(R.memory_text(SPARK, "title")).alias("m"))
    df = df.select("*", F.expr(R.memory_list(SPARK, "m")).alias("sizes"))
    ram, storage = R.memory_specs(SPARK, "m", "sizes")
    return df.select("*", F.expr(ram).alias("ram"), F.expr(storage).alias("s")).select("idx", "ram", F.expr(R.with_medium(SPARK, "s", "m")).alias("storage"))


def _memory_sql() -> str:
    ram, storage = R.memory_specs(DUCK, "m", "sizes")
    return f"WITH a AS (SELECT idx, {R.memory_text(DUCK, 'title')} AS m FROM ({O.OFFERS})), b AS (SELECT *, {R.memory_list(DUCK, 'm')} AS sizes FROM a), c AS (SELECT *, {ram} AS ram, {storage} AS s FROM b) SELECT idx, ram, {R.with_medium(DUCK, 's', 'm')} AS storage FROM c"


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one project's finished jobs, newest first, with the total."""
    own = derived(spark, sf_dir, "jobs").filter("project_id = 3 AND status = 'success'")
    total, rows = S.page(own, [F.desc("created_at"), F.asc("job_id")], 10, 20)
    return rows.withColumn("total", F.lit(total).cast("long"))


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: derived(spark, sf_dir, name)
    templates = of("templates").withColumn("updated_at", F.expr("timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(updated_at AS int))"))
    return S.cleanup(of("jobs"), of("job_rows"), of("exports"), of("usage"), templates, F.expr("timestamp_ntz'1996-06-01'"))[1]


def _dup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text")
    return I.duplicate_ratio(docs, "source", "doc_id", ["text"])


def _limited(kind: type) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = derived(spark, sf_dir, "request_log").select(F.col("user_key").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("id"))
        return limits.decide(log.withColumn("ts", F.col("ts") / 1e6), kind, 3, 36_000.0).select("id", "key", "allowed", "remaining", "reset_seconds")

    return run


def _limited_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived(spark, sf_dir, "request_log").select(F.col("user_key").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "id")
    return limits.decide_in_order(log, limits.SlidingLog, 3, 36_000.0).select("id", "key", "allowed", "remaining", "reset_seconds")


def _queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request as a delivery of its user's job, under leases of ten hours that nobody gives back."""
    log = derived(spark, sf_dir, "request_log").select(F.col("user_key").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").alias("nth"), F.lit("deliver").alias("kind"), F.lit(0).alias("attempt"), F.lit(3).alias("max_attempts"), F.lit(None).cast("long").alias("available_at"), F.col("id").cast("string").alias("payload"), F.lit(None).cast("string").alias("owner"))
    return queue.run_queue(log, queue.QueueRules(lease_seconds=36_000)).select("job_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "event", "payload")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the clean path merged by variant (rows alone keep their prices as they are)."""
    cat = derived(spark, sf_dir, "catalog").withColumn("sku_confidence", F.col("sku_confidence").cast("double")).withColumn("list_price_inr", F.col("price_inr") + F.col("idx") % 9 * 1000).withColumn("effective_price_inr", F.when(F.col("idx") % 3 > 0, F.col("price_inr"))).withColumn("discount_percent", F.lit(None).cast("double"))
    return I.merge_variants(cat, "idx")


#: The same in SQL, and how each of its columns is merged.
PRICED = f"SELECT * REPLACE (CAST(sku_confidence AS DOUBLE) AS sku_confidence), price_inr + idx % 9 * 1000 AS list_price_inr, CASE WHEN idx % 3 > 0 THEN price_inr END AS effective_price_inr, CAST(NULL AS DOUBLE) AS discount_percent FROM {sql_of('catalog')}"
MERGED = {c: "text" for c in ("brand", "category", "product_family", "model", "sku")} | {"sku_confidence": "sure"} | {c: "text" for c in ("ram", "storage", "processor", "display", "os_family", "os_version")} | {"price_inr": "other"} | {c: "text" for c in ("product_url", "name_source")} | {"is_canonical_name": "flag", "list_price_inr": "other", "effective_price_inr": "other", "discount_percent": "other"}


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as listing rows."""
    return O.offers(spark, sf_dir).select("idx", "title", F.regexp_replace("price", "Rs[.] ", "₹").alias("price"), "rating", F.lit(None).cast("string").alias("review_count"), "availability", "product_url", F.concat_ws(" ", "title", "description").alias("raw_text"), F.lit("https://example.com/list").alias("url"))


def _pages(then: Callable[[DataFrame, DataFrame], DataFrame], of: Query = L.listing_pages) -> Query:
    """A query over pages and their parse, which is written once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = settle(of(spark, sf_dir))
        return then(pages, settle(dom.parse_pages(pages)))

    return run


#: A template of the listing pages.
CARD = T.Template("article.card", {"name": "h2 a", "link": "h2 > a@href", "price": "span.price", "rating": "div.stars", "none": ".none"}, next_selector="div.pager a.next", next_type="next")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.template_rows(L.listing_pages(spark, sf_dir), CARD, 5000)
    return rows.select("page_id", F.regexp_extract(F.col("values")["link"], r"(\d+)$", 1).cast("long").alias("k"), *(F.col("values")[f].alias(f) for f in CARD.fields))


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.run(L.crawl_starts(spark, sf_dir), L.listing_pages(spark, sf_dir), "title, price and link", N.Limits(5000, 100))


def _crawl_jobs(template: T.Template | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        jobs = N.run_jobs(L.crawl_starts(spark, sf_dir), L.listing_pages(spark, sf_dir), "title, price and link", N.Limits(5000, 100), template)
        return jobs.select("job_id", F.size("rows").alias("rows"), "pages", "partial", F.array_join("warnings", ",").alias("warnings"))

    return run


def _fingerprints(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    return X.fingerprint(parsed).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's pages."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


#: A template of the driver's pages: their menu but for its first item.
MENU = T.Template("nav li:not(:first-child)", {"word": "a", "link": "a[href]@href"})


def _menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.template_rows(_given(spark, sf_dir), MENU, 5000)
    return rows.select("page_id", "idx", *(F.col("values")[f].alias(f) for f in MENU.fields))


def _dispatched(then: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return then(N.dispatch_jobs(L.store_jobs(spark, sf_dir), L.store_pages(spark, sf_dir), L.templates(spark), "title, price and link", N.Limits(5000, 100)))

    return run


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.validate_labels(derived(spark, sf_dir, "label_fields"), derived(spark, sf_dir, "label_answers"), ("job_id",))
    return done.withColumn("target", A.rename_target(("job_id",))).withColumn("confidence", F.round("confidence", 4))


#: Field names, kinds and targets worked out anew.
VALIDATED = f"""WITH f AS (SELECT * FROM {sql_of('label_fields')}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, source ORDER BY position, name, kind NULLS FIRST, confidence NULLS FIRST) AS k FROM {sql_of('label_answers')} WHERE trim(name) <> '') WHERE k = 1),
j AS (SELECT f.job_id, f.source, f.position, coalesce(nullif(left(trim(regexp_replace(lower(trim(coalesce(l.name, f.source))), '[^a-z0-9]+', '_', 'g'), '_'), 64), ''), 'field') AS name, lower(l.kind) AS given, l.k IS NOT NULL AS there, l.confidence AS sure FROM f LEFT JOIN l USING (job_id, source)),
v AS (SELECT job_id, source, position, name, CASE WHEN given IN ('text', 'money', 'rating', 'url', 'number', 'date', 'email', 'phone', 'boolean') THEN given WHEN regexp_matches(name, 'url|link|href|website') THEN 'url' WHEN regexp_matches(name, 'price|amount|cost|mrp') THEN 'money' WHEN regexp_matches(name, 'rating|score|stars|review') THEN 'rating'
  WHEN regexp_matches(name, 'date|time|published|created') THEN 'date' WHEN regexp_matches(name, 'email|mail') THEN 'email' WHEN regexp_matches(name, 'phone|mobile|contact') THEN 'phone' ELSE 'text' END AS kind, round(CASE WHEN there THEN greatest(0.0, least(1.0, coalesce(sure, 0.75::DOUBLE))) ELSE 0.65 END, 4)::DOUBLE AS confidence FROM j),
t AS (SELECT *, row_number() OVER (PARTITION BY job_id, name ORDER BY position, source) AS k FROM v)
SELECT job_id, source, position, name, kind, confidence, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS target FROM t"""


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "job_rows").select("job_id", "row_index", "flag", "part")
    return E.array_of(E.json_rows(rows, "job_id", "row_index"), "job_id", "row_index")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "objects")
    return E.csv_lines(rows, "job_id", "row_index", "data").withColumn("row_index", F.coalesce("row_index", F.lit(-1)))


#: Lines of each job's file: columns in first-seen order, quotes where they are needed.
CSV_LINES = f"""WITH o AS (SELECT * FROM {sql_of('objects')}), e AS (SELECT job_id, row_index, generate_subscripts(json_keys(data), 1) AS pos, unnest(json_keys(data)) AS name FROM o),
c AS (SELECT job_id, name, min(row_index * 100 + pos) AS seen FROM e GROUP BY job_id, name), h AS (SELECT job_id, list(name ORDER BY seen) AS columns FROM c GROUP BY job_id),
v AS (SELECT job_id, -1 AS row_index, columns AS cells FROM h UNION ALL SELECT o.job_id, o.row_index, list_transform(h.columns, lambda n: json_extract_string(o.data, '$.' || n)) FROM o JOIN h USING (job_id)),
q AS (SELECT job_id, row_index, len(cells) AS n, array_to_string(list_transform(cells, lambda x: CASE WHEN regexp_matches(x, '[",\\r\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE coalesce(x, '') END), ',') AS line FROM v)
SELECT job_id, row_index, CASE WHEN n = 1 AND line = '' THEN '""' ELSE line END AS line FROM q"""


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived(spark, sf_dir, "dumped")
    return W.fetched(pages.select("url"), pages, 8).select("url", "final_url", "status", F.md5("html").alias("digest"), "error")


#: Redirects followed by recursion, eight hops at most.
FETCHED = f"""WITH RECURSIVE p AS (SELECT * FROM {sql_of('dumped')}),
h AS (SELECT url, url AS final_url, 0 AS hops FROM p UNION ALL SELECT h.url, p.location, h.hops + 1 FROM h JOIN p ON p.url = h.final_url AND p.status BETWEEN 300 AND 399 AND h.hops < 8),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY hops DESC) AS k FROM h) WHERE k = 1),
e AS (SELECT l.url, l.final_url, p.status, p.html, CASE WHEN l.hops = 8 THEN 'too_many_redirects' WHEN p.status IS NULL THEN 'page_load_failed' WHEN p.status >= 400 THEN 'http_' || p.status END AS error FROM l LEFT JOIN p ON p.url = l.final_url)
SELECT url, final_url, status, CASE WHEN error IS NULL THEN md5(html) END AS digest, error FROM e"""


#: Hits of each key in order.
HITS = f"WITH RECURSIVE h AS (SELECT id, user_key AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_key ORDER BY ts, id) AS k FROM {sql_of('request_log')})"


def _table() -> dict[str, tuple[Query, str | None]]:
    of = lambda name, then: lambda spark, sf_dir: then(derived(spark, sf_dir, name))
    two = lambda one, other, then: lambda spark, sf_dir: then(derived(spark, sf_dir, one), derived(spark, sf_dir, other))
    out: dict[str, tuple[Query, str | None]] = {
        "clean_offers": (lambda spark, sf_dir: C.valid(C.normalize(O.offers(spark, sf_dir), "idx")), C.oracle(O.duck_source(), "idx", False)),
        "clean_offers_dedupe": (lambda spark, sf_dir: C.clean(O.offers(spark, sf_dir), "idx"), C.oracle(O.duck_source(), "idx", True)),
        "offer_fields": _scalars(_offer_fields, "idx", O.OFFERS, "offers"),
        "url_fields": _scalars(_url_fields, "page_id", "SELECT * FROM pages", "pages"),
        "memory_specs": (_memory, _memory_sql()),
        "url_domain_counts": (
            lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(F.expr(U.domain(SPARK, "url")).alias("domain")).agg(F.count(F.lit(1)).alias("n")),
            f"SELECT {U.domain(DUCK, 'url')} AS domain, count(*) AS n FROM pages GROUP BY 1",
        ),
        "catalog_entities": (lambda spark, sf_dir: I.catalog_entities(derived(spark, sf_dir, "catalog"), "idx").drop("sku_confidence", "ram", "storage", "processor", "display", "os_family", "os_version", "price_inr", "product_url", "name_source", "is_canonical_name"), I.catalog_oracle(sql_of("catalog")[1:-1], "idx", CATALOG)),
        "variant_merge": (_merged, I.merge_oracle(PRICED, "idx", MERGED)),
        "structured_catalog": (lambda spark, sf_dir: G.catalog(_listing(spark, sf_dir), "idx", stamp="2024-01-01T00:00:00Z"), None),
        "structured_rows": (lambda spark, sf_dir: G.catalog_rows(_listing(spark, sf_dir), "idx", stamp="2024-01-01T00:00:00Z"), None),
        "js_shell_flags": (_pages(X.js_shell, _given), L.GIVEN_SHELLS),
        "next_page_url": (_pages(lambda pages, parsed: P.next_pages(parsed, pages), _given), L.given_next(U.join(DUCK, "url", "href"), U.next_page(DUCK, "url"))),
        "page_fingerprint_groups": (_pages(_fingerprints, _given), L.GIVEN_FINGERPRINTS),
        "page_menus": (_menus, L.GIVEN_VALUES),
        "listing_shell_flags": (_pages(X.js_shell, L.shell_pages), L.SHELLS),
        "listing_next_url": (_pages(lambda pages, parsed: P.next_pages(parsed, pages)), L.NEXT),
        "listing_fingerprint_groups": (_pages(lambda pages, parsed: _fingerprints(pages, parsed).drop("fingerprint")), L.FINGERPRINTS),
        "template_dispatch": (_dispatched(lambda done: done.select("job_id", "status", "template_id", "by_template", F.size("rows").alias("rows"), "pages", F.array_join("warnings", ",").alias("warnings"))), L.DISPATCHED),
        "template_dispatch_rows": (_dispatched(lambda done: done.select("job_id", F.posexplode("rows").alias("k", "row")).select("job_id", (F.col("k") + 1).alias("row_index"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("row")))).alias("json"))), L.DISPATCHED_ROWS),
        "template_outcomes": (_dispatched(lambda done: S.template_health(N.template_outcomes(done), "template_id", "job_id")), L.OUTCOMES),
        "listing_rows": (_pages(lambda pages, parsed: X.listing_rows(parsed).drop("seller", "company", "raw_text")), L.LISTED),
        "template_values": (_values, L.VALUES),
        "crawl_rows": (_crawled, L.CRAWLED),
        "crawl_jobs": (_crawl_jobs(None), L.JOBS),
        "template_crawl_jobs": (_crawl_jobs(CARD), L.TEMPLATE_JOBS),
        "doc_signature_dedupe": (
            lambda spark, sf_dir: I.dedupe_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").select("doc_id", "lang"),
            "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(coalesce(text, ''))), lower(trim(coalesce(lang, ''))) ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
        ),
        "duplicate_ratio_by_source": (
            _dup_ratio,
            "SELECT source, count(*) AS rows, count(*) FILTER (k > 1) AS duplicates, avg(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS ratio FROM (SELECT source, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY source, doc_id) AS k FROM documents) GROUP BY source",
        ),
        "jobs_page": (_page, f"SELECT *, count(*) OVER () AS total FROM {sql_of('jobs')} WHERE project_id = 3 AND status = 'success' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 10"),
        "jobs_by_status": (
            of("jobs", lambda df: df.groupBy("status", S.status_bucket(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 2).alias("cost"))),
            f"SELECT status, CASE WHEN status IN ('success', 'partial_success', 'failed', 'cancelled') THEN 'terminal' ELSE 'active' END AS bucket, count(*) AS n, round(sum(cost), 2) AS cost FROM {sql_of('jobs')} GROUP BY 1, 2",
        ),
        "job_transitions": (
            of("jobs", lambda df: df.select("job_id", S.transition(F.col("status"), "retry").alias("retry"), S.transition(F.col("status"), "cancel").alias("cancel"))),
            f"SELECT job_id, CASE WHEN status IN ('failed', 'cancelled') THEN 'queued' END AS retry, CASE WHEN status = 'queued' THEN 'cancelled' END AS cancel FROM {sql_of('jobs')}",
        ),
        "visible_exports": (
            lambda spark, sf_dir: S.visible_exports(derived(spark, sf_dir, "exports"), derived(spark, sf_dir, "jobs"), spark.range(2, 5).select(F.col("id").cast("string").alias("project_id"))),
            f"SELECT * FROM {sql_of('exports')} WHERE job_id IN (SELECT job_id FROM {sql_of('jobs')} WHERE project_id IN (2, 3, 4))",
        ),
        "exportable_jobs": (
            two("jobs", "job_rows", S.exportable),
            f"SELECT * FROM {sql_of('jobs')} WHERE status IN ('success', 'partial_success') AND job_id IN (SELECT job_id FROM {sql_of('job_rows')})",
        ),
        "template_match": (
            two("template_pages", "templates", S.match_templates),
            f"SELECT page_id, domain, template_id, exact FROM (SELECT p.page_id, p.domain, t.template_id, coalesce(t.page_fingerprint = p.fingerprint, false) AS exact, row_number() OVER (PARTITION BY p.page_id ORDER BY coalesce(t.page_fingerprint = p.fingerprint, false) DESC, t.success_rate DESC, t.version DESC, t.updated_at DESC) AS k FROM {sql_of('template_pages')} p LEFT JOIN (SELECT * FROM {sql_of('templates')} WHERE NOT invalidated) t ON t.domain = p.domain) WHERE k = 1",
        ),
        "template_versions": (
            of("templates", lambda df: S.version_templates(df.drop("version"), "updated_at").select("template_id", "version", "parent_template_id")),
            f"SELECT template_id, row_number() OVER w AS version, lag(template_id) OVER w AS parent_template_id FROM {sql_of('templates')} WINDOW w AS (PARTITION BY domain, page_type, page_fingerprint ORDER BY updated_at)",
        ),
        "template_health": (
            of("outcomes", lambda df: S.template_health(df, "template_id", "event_id")),
            f"SELECT template_id, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count, round(count(*) FILTER (success) / count(*), 4) AS success_rate, NOT arg_max(success, event_id) AND count(*) FILTER (NOT success) >= 3 AS invalidated FROM {sql_of('outcomes')} GROUP BY 1",
        ),
        "latest_versions": (
            of("usage", lambda df: S.latest(df, "user_id", "event_id")),
            f"SELECT user_id, event_id, event_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM {sql_of('usage')}) WHERE k = 1",
        ),
        "usage_ids": (
            of("usage", lambda df: S.with_ids(df.drop("event_type", "user_id"), ["created_at", "event_id"])),
            f"SELECT event_id, created_at, row_number() OVER (ORDER BY created_at, event_id) AS id FROM {sql_of('usage')}",
        ),
        "retention_counts": (
            _retention,
            f"WITH j AS (SELECT job_id FROM {sql_of('jobs')} WHERE created_at < TIMESTAMP '1996-06-01') SELECT (SELECT count(*) FROM j) AS jobs_deleted, (SELECT count(*) FROM {sql_of('job_rows')} WHERE job_id IN (SELECT job_id FROM j)) AS rows_deleted, (SELECT count(*) FROM {sql_of('exports')} WHERE job_id IN (SELECT job_id FROM j)) AS exports_deleted, (SELECT count(*) FROM {sql_of('usage')} WHERE created_at < TIMESTAMP '1996-06-01') AS events_deleted, (SELECT count(*) FROM {sql_of('templates')} WHERE invalidated AND TIMESTAMP '1995-01-01' + to_days(cast(updated_at AS int)) < TIMESTAMP '1996-06-01') AS templates_deleted",
        ),
        "request_metrics": (of("request_log", M.request_metrics), f"SELECT method, path, status, count(*) AS requests, round(sum(duration_ms), 4) AS duration_ms_sum FROM {sql_of('request_log')} GROUP BY 1, 2, 3"),
        "request_blocks": (of("request_log", M.blocked), f"SELECT path, count(*) FILTER (status = 429) AS rate_limited, count(*) FILTER (status = 401) AS auth_failed FROM {sql_of('request_log')} GROUP BY 1 HAVING count(*) FILTER (status IN (401, 429)) > 0"),
        "metrics_exposition": (
            of("request_log", lambda df: M.exposition(M.request_metrics(df))),
            f"SELECT 'http_requests_total{{method=\"' || method || '\",path=\"' || path || '\",status=\"' || status || '\"}} ' || count(*) AS line FROM {sql_of('request_log')} GROUP BY method, path, status",
        ),
        "label_counts": (of("labelled", M.label_counts), f"SELECT coalesce(nullif(trim(label), ''), 'unclassified') AS label, count(*) AS n FROM {sql_of('labelled')} GROUP BY 1"),
        "label_validate": (_validated, VALIDATED),
        "export_json_rows": (
            _export,
            f"WITH x AS (SELECT job_id, row_index, '{{\"flag\":\"' || flag || '\",\"part\":' || part || '}}' AS j FROM {sql_of('job_rows')}) SELECT job_id, '[' || string_agg(j, ',' ORDER BY row_index, j) || ']' AS json FROM x GROUP BY job_id",
        ),
        "export_csv_lines": (_csv, CSV_LINES),
        "fetched_pages": (_fetched, FETCHED),
        "rate_limit_log": (
            _limited(limits.SlidingLog),
            f"{HITS}, r AS (SELECT id, key, t, k, [t] AS log, true AS allowed, 2 AS remaining, 36000 AS reset FROM h WHERE k = 1 UNION ALL SELECT id, key, t, k, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3, greatest(0, 2 - len(live)), CASE WHEN len(live) < 3 THEN 36000 ELSE greatest(1, cast(round_even(live[1] + 36000 - t, 0) AS bigint)) END FROM (SELECT h.id, h.key, h.t, h.k, list_filter(r.log, lambda x: x > h.t - 36000) AS live FROM r JOIN h ON h.key = r.key AND h.k = r.k + 1)) SELECT id, key, allowed, remaining, reset AS reset_seconds FROM r",
        ),
        "rate_limit_in_order": (
            _limited_in_order,
            f"{HITS}, r AS (SELECT id, key, t, k, [t] AS log, true AS allowed, 2 AS remaining, 36000 AS reset FROM h WHERE k = 1 UNION ALL SELECT id, key, t, k, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3, greatest(0, 2 - len(live)), CASE WHEN len(live) < 3 THEN 36000 ELSE greatest(1, cast(round_even(live[1] + 36000 - t, 0) AS bigint)) END FROM (SELECT h.id, h.key, h.t, h.k, list_filter(r.log, lambda x: x > h.t - 36000) AS live FROM r JOIN h ON h.key = r.key AND h.k = r.k + 1)) SELECT id, key, allowed, remaining, reset AS reset_seconds FROM r",
        ),
        "queue_leases": (
            _queued,
            f"WITH RECURSIVE h AS (SELECT id, user_key AS key, ts, row_number() OVER (PARTITION BY user_key ORDER BY ts, id) AS k FROM {sql_of('request_log')}), r AS (SELECT id, key, ts, k, ts AS since, true AS held FROM h WHERE k = 1 UNION ALL SELECT h.id, h.key, h.ts, h.k, CASE WHEN h.ts >= r.since + INTERVAL 10 HOUR THEN h.ts ELSE r.since END, h.ts >= r.since + INTERVAL 10 HOUR FROM r JOIN h ON h.key = r.key AND h.k = r.k + 1) SELECT key AS job_id, ts AS at, CASE WHEN held THEN 'dispatched' ELSE 'duplicate_skipped' END AS event, CAST(id AS VARCHAR) AS payload FROM r UNION ALL SELECT key, ts + INTERVAL 10 HOUR, 'lease_expired', CAST(id AS VARCHAR) FROM r WHERE held",
        ),
        "rate_limit_fixed": (
            _limited(limits.FixedWindow),
            f"{HITS}, r AS (SELECT id, key, t, k, t AS s, 1 AS n FROM h WHERE k = 1 UNION ALL SELECT h.id, h.key, h.t, h.k, CASE WHEN floor(r.s + 36000 - h.t + 0.5) <= 0 THEN h.t ELSE r.s END, CASE WHEN h.t >= r.s + 36000 THEN 1 ELSE r.n + 1 END FROM r JOIN h ON h.key = r.key AND h.k = r.k + 1) SELECT id, key, n <= 3 AS allowed, greatest(0, 3 - n) AS remaining, cast(floor(s + 36000 - t + 0.5) AS bigint) AS reset_seconds FROM r",
        ),
    }
    return out


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _table().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _table().items() if sql}
