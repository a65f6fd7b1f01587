"""Listing pages derived from part, as the driver's pages hold no products: what is on them is known in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import query

PER_PAGE, CHAIN = 20, 5
#: One product a row, in either dialect.
CARDS = f"""SELECT p_partkey AS k, cast(floor(p_partkey / {PER_PAGE}) AS bigint) AS page,
  'Nova ' || CASE p_partkey % 4 WHEN 0 THEN 'Desk Lamp ' WHEN 1 THEN 'Steel Kettle ' WHEN 2 THEN 'Trail Shoes ' ELSE 'Garden Chair ' END || cast(p_partkey AS varchar(20)) AS title,
  '₹' || cast(p_size * 1000 + p_partkey % 1000 AS varchar(20)) AS price,
  cast(cast(floor(p_partkey % 50 / 10) AS int) AS varchar(2)) || '.' || cast(p_partkey % 10 AS varchar(2)) AS rated, p_partkey % 300 AS reviews,
  CASE p_partkey % 5 WHEN 0 THEN 'In stock' WHEN 1 THEN 'Out of stock' WHEN 2 THEN 'Coming soon' ELSE '' END AS state FROM part"""
#: A page's address, by its number `page`.
URL = f"'https://shop' || cast(cast(floor(page / {CHAIN}) AS bigint) % 3 AS varchar(2)) || '.example.com'"
SHELL = '<html><body><div id="root">Loading...</div><script src="/a.js"></script></body></html>'
SCRIPTS = "<html><body>" + "<script></script>" * 8 + "<p>Please wait</p></body></html>"


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): a page's cards, its first once more, and a link to the next but on each fifth page."""
    card = F.expr("""'<article class="card"><h2><a href="/item/' || k || '">' || title || '</a></h2><span class="price">' || price || '</span><div class="stars">' || rated || ' out of 5</div><p>' || reviews || ' reviews. ' || state || '</p></article>'""")
    cards = query(spark, sf_dir, CARDS, ("part",)).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("k", card.alias("html")))).alias("c"))
    onward = F.when(F.col("page") % CHAIN < CHAIN - 1, F.concat(F.lit('<div class="pager"><a class="next" href="/list/'), F.col("page") + 1, F.lit('">Next</a></div>'))).otherwise("")
    body = F.array_join(F.transform("c", lambda x: x["html"]), "")
    html = F.concat(F.lit('<html><body><header><nav class="menu"><a href="/home">Home</a><a href="/about">About</a></nav></header><main>'), body, F.col("c")[0]["html"], F.lit("</main>"), onward, F.lit("</body></html>"))
    return cards.select(F.col("page").alias("page_id"), F.expr(URL + " || '/list/' || page").alias("url"), html.alias("html"))


def crawl_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, url): a job for each chain of pages."""
    return listing_pages(spark, sf_dir).filter(F.col("page_id") % CHAIN == 0).select((F.col("page_id") / CHAIN).cast("bigint").alias("job_id"), "url")


def shell_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages, some of them empty shells of one kind or the other."""
    nth = F.col("page_id") % 7
    return listing_pages(spark, sf_dir).withColumn("html", F.when(nth == 0, SHELL).when(nth == 1, SCRIPTS).when(nth == 2, " ").otherwise(F.col("html")))


#: Stores whose listings are marked up in five ways, by the number of a chain of pages; what templates they have.
STORES = 5
STORE = f"cast(floor(page / {CHAIN}) AS bigint) % {STORES}"
STORE_URL = f"'https://store' || cast({STORE} AS varchar(2)) || '.example.com'"
TEMPLATES = [
    ("cards", 3, "store0.example.com", None, "listing", 0.9, 1, False, "article.card", {"name": "h2 a", "link": "h2 > a@href", "price": "span.price"}, "div.pager a.next", "next"),
    ("worse", 9, "store0.example.com", None, "listing", 0.2, 2, False, "li", {"name": "a"}, None, ""),
    ("broken", 4, "store0.example.com", None, "listing", 1.0, 3, True, "p", {"name": "a"}, None, ""),
    ("grid", 1, "store1.example.com", None, "listing", 0.5, 1, False, "ul.grid > li[data-sku]:not(.ad)", {"title": "b:first-child", "mrp": "i:nth-of-type(2)", "url": "a[href^='/item/']:last-child@href"}, "ul ~ div.pager > a.next:has(+ hr)", ""),
    ("table", 2, "store2.example.com", None, "listing", 0.5, 1, False, "tbody tr:has(td)", {"item": "td:first-child", "cost": "td:nth-child(2)", "link": "td:nth-last-child(1) a@href"}, None, ""),
    ("stale", 7, "store4.example.com", None, "listing", 0.5, 1, False, "section.gone", {"name": "h2"}, None, ""),
]
TEMPLATE = "template_id string, version int, domain string, page_fingerprint string, page_type string, success_rate double, updated_at int, invalidated boolean, container string, fields map<string,string>, next string, next_type string"


def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html) of all stores."""
    card = """'<article class="card"><h2><a href="/item/' || k || '">' || title || '</a></h2><span class="price">' || price || '</span></article>'"""
    cell = """'<li data-sku="' || k || '"><b>' || title || '</b><i>from</i><i>' || price || '</i><a href="/help">?</a><a href="/item/' || k || '">See</a></li>'"""
    line = """'<tr><td>' || title || '</td><td>' || price || '</td><td><a href="/item/' || k || '">go</a></td></tr>'"""
    one = F.expr(f"CASE {STORE} WHEN 1 THEN {cell} WHEN 2 THEN {line} ELSE {card} END")
    pages = query(spark, sf_dir, CARDS, ("part",)).withColumn("store", F.expr(STORE)).groupBy("page", "store").agg(F.sort_array(F.collect_list(F.struct("k", one.alias("html")))).alias("c"))
    # A listing ends with its first item once more.
    body = F.concat(F.array_join(F.transform("c", lambda x: x["html"]), ""), F.col("c")[0]["html"])
    body = F.when(F.col("store") == 1, F.concat(F.lit('<ul class="grid"><li class="ad" data-sku="0">Ad</li>'), body, F.lit("</ul>"))).when(F.col("store") == 2, F.concat(F.lit("<table><tbody><tr><th>Item</th></tr>"), body, F.lit("</tbody></table>"))).otherwise(body)
    onward = F.when(F.col("page") % CHAIN < CHAIN - 1, F.concat(F.lit('<div class="pager"><a class="next" href="/list/'), F.col("page") + 1, F.lit('">Next</a><hr></div>'))).otherwise("")
    html = F.concat(F.lit('<html><body><header><nav class="menu"><a href="/home">Home</a><a href="/about">About</a></nav></header><main>'), body, onward, F.lit("</main></body></html>"))
    return pages.select(F.col("page").alias("page_id"), F.expr(STORE_URL + " || '/list/' || page").alias("url"), html.alias("html"))


def store_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, url): a job for each chain of pages."""
    return store_pages(spark, sf_dir).filter(F.col("page_id") % CHAIN == 0).select((F.col("page_id") / CHAIN).cast("bigint").alias("job_id"), "url")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, TEMPLATE)


_CHAINS = f"SELECT *, cast(floor(page / {CHAIN}) AS bigint) AS job_id, {STORE} AS store, {STORE_URL} AS host FROM ({CARDS})"
_CALLED = "CASE store WHEN 0 THEN 'cards' WHEN 1 THEN 'grid' WHEN 2 THEN 'table' WHEN 4 THEN 'stale' END"
#: A job's warnings: what its template says of itself and of each page, then what the rules say.
DISPATCHED = f"""WITH j AS (SELECT job_id, any_value(store) AS store, count(*) AS rows, count(DISTINCT page) AS pages FROM ({_CHAINS}) GROUP BY job_id),
s AS (SELECT *, {_CALLED} AS template_id, CASE WHEN pages < {CHAIN} THEN ['page_load_failed'] ELSE []::VARCHAR[] END AS lost, pages - CASE WHEN pages < {CHAIN} THEN 0 ELSE 1 END AS onward FROM j),
t AS (SELECT *, CASE store WHEN 0 THEN ['template_matched:cards', 'template_version:3'] WHEN 1 THEN ['template_matched:grid', 'template_version:1'] WHEN 2 THEN ['template_matched:table', 'template_version:2'] WHEN 4 THEN ['template_matched:stale', 'template_version:7'] ELSE []::VARCHAR[] END AS told, ['pagination_next_detected'] || lost AS ruled,
  list_transform(range(onward), lambda i: 'template_pagination_next_used') AS used, flatten(list_transform(range(onward), lambda i: ['template_pagination_fallback_used', 'pagination_next_detected'])) AS fell, CASE WHEN pages < {CHAIN} THEN []::VARCHAR[] ELSE ['template_pagination_not_found'] END AS nowhere FROM s)
SELECT job_id, CASE WHEN pages < {CHAIN} THEN 'partial_success' ELSE 'success' END AS status, template_id, store IN (0, 1, 2) AS by_template, rows, pages,
  array_to_string(told || CASE store WHEN 0 THEN used || nowhere || lost WHEN 1 THEN nowhere || lost WHEN 2 THEN fell || lost WHEN 3 THEN ruled
    ELSE ['template_container_not_found', 'page_yield_low', 'template_pagination_fallback_used', 'pagination_next_detected'] || CASE WHEN pages = 1 THEN ['page_load_failed'] ELSE ['template_container_not_found', 'page_yield_low', 'consecutive_low_yield_cutoff_reached'] END || ['template_rows_empty'] || ruled END, ',') AS warnings FROM t"""
DISPATCHED_ROWS = f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY k) AS row_index, CASE store WHEN 0 THEN '{{"link":"' || host || '/item/' || k || '","name":"' || title || '","price":"' || price || '"}}' WHEN 1 THEN '{{"mrp":"' || price || '","title":"' || title || '","url":"' || host || '/item/' || k || '"}}' WHEN 2 THEN '{{"cost":"' || price || '","item":"' || title || '","link":"' || host || '/item/' || k || '"}}'
  ELSE '{{"price":"' || price || '","product_url":"' || host || '/item/' || k || '","title":"' || title || '"}}' END AS json FROM ({_CHAINS})"""
OUTCOMES = f"SELECT {_CALLED} AS template_id, count(DISTINCT job_id) FILTER (store <> 4) AS success_count, count(DISTINCT job_id) FILTER (store = 4) AS failure_count, round(count(DISTINCT job_id) FILTER (store <> 4) / count(DISTINCT job_id), 4) AS success_rate, store = 4 AND count(DISTINCT job_id) >= 3 AS invalidated FROM ({_CHAINS}) WHERE store <> 3 GROUP BY store"

#: The driver's pages as regular expressions see them: tags and classes in order, links with plain text.
_TAGS = r"list_transform(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'sg'), '<([A-Za-z][A-Za-z0-9]*)[^>]*>', 1), lambda x: lower(x))"
_TOP = "'[' || array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct({0}), lambda t: {{'n': -len(list_filter({0}, lambda u: u = t)), 't': t}})), 1, 20), lambda x: '(''' || x.t || ''', ' || (-x.n) || ')'), ', ') || ']'"
_LINKS = r"""list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), lambda a: {'href': regexp_extract(a, '"([^"]*)"', 1), 'text': trim(regexp_extract(a, '>([^<]*)<', 1))})"""
GIVEN_FINGERPRINTS = f"""WITH t AS (SELECT page_id, {_TAGS} AS tags, regexp_extract_all(html, '<[a-z]+ class="([a-z]+)"', 1) AS named FROM pages),
f AS (SELECT page_id, tags, list_slice(tags, 1, 400) AS head, named FROM t),
h AS (SELECT page_id, sha1('{{''top_tags'': ' || {_TOP.format("head")} || ', ''top_classes'': ' || {_TOP.format("named")} || ', ''anchors'': ' || len(list_filter(tags, lambda x: x = 'a')) || ', ''headings'': ' || len(list_filter(tags, lambda x: x IN ('h1', 'h2', 'h3', 'h4'))) || ', ''forms'': ' || len(list_filter(tags, lambda x: x = 'form')) || '}}') AS fingerprint FROM f)
SELECT fingerprint, count(*) AS pages, min(page_id) AS first_page FROM h GROUP BY fingerprint"""
GIVEN_SHELLS = r"""SELECT page_id, trim(html) = '' OR regexp_matches(left(html, 2000), '(?is)enable javascript|javascript is required|loading\.\.\.') OR (len(regexp_extract_all(html, '<script')) >= 8 AND len(regexp_replace(html, '<[^>]*>', '', 'g')) < 120 AND len(regexp_extract_all(html, '<a ')) <= 2) AS js_shell FROM pages"""


def given_next(joined: str, bumped: str) -> str:
    """SQL of the driver's pages' next pages; the address that a link or a page parameter leads to is given as SQL."""
    return rf"""WITH l AS (SELECT page_id, url, html, {_LINKS} AS links FROM pages),
    m AS (SELECT page_id, url, list_filter(links, lambda a: regexp_matches(a.text, '(?i)^(next|next page|>|>>|›|→)$') OR regexp_matches(a.text, '(?i)next|older|forward|more results'))[1] AS nxt, list_filter(links, lambda a: regexp_matches(a.text, '(?i)load more|show more|view more'))[1] AS more, regexp_matches(left(html, 3500), '(?i)next|load more|show more|pagination') AS hint FROM l),
    n AS (SELECT page_id, url, coalesce(nxt, more).href AS href, CASE WHEN nxt IS NOT NULL THEN 'next' WHEN more IS NOT NULL THEN 'load_more' END AS way, CASE WHEN hint THEN {bumped} END AS bumped FROM m)
    SELECT page_id, url, CASE WHEN way IS NOT NULL THEN {joined} ELSE bumped END AS next_url, coalesce(way, CASE WHEN bumped IS NOT NULL THEN 'increment' END) AS mode FROM n"""


GIVEN_VALUES = rf"""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS host, {_LINKS} AS links FROM pages),
e AS (SELECT page_id, host, generate_subscripts(links, 1) - 1 AS i, unnest(links) AS a FROM l),
v AS (SELECT page_id, i, regexp_replace(a.text, '\s+', ' ', 'g') AS word, host || a.href AS link FROM e WHERE i > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(word), lower(link) ORDER BY i) AS k FROM v)
SELECT page_id, CAST(i - 1 AS INTEGER) AS idx, word, link FROM d WHERE k = 1"""

RATING = "CASE WHEN rated LIKE '%.0' THEN left(rated, 1) ELSE rated END"
LISTED = f"SELECT page AS page_id, row_number() OVER (PARTITION BY page ORDER BY k) AS idx, title, price, {RATING} AS rating, reviews AS review_count, lower(state) AS availability, {URL} || '/item/' || k AS product_url FROM ({CARDS})"
NEXT = f"SELECT DISTINCT page AS page_id, {URL} || '/list/' || page AS url, CASE WHEN page % {CHAIN} < {CHAIN - 1} THEN {URL} || '/list/' || (page + 1) END AS next_url, CASE WHEN page % {CHAIN} < {CHAIN - 1} THEN 'next' END AS mode FROM ({CARDS})"
SHELLS = f"SELECT DISTINCT page AS page_id, page % 7 < 3 AS js_shell FROM ({CARDS})"
FINGERPRINTS = f"SELECT count(*) AS pages, min(page) AS first_page FROM (SELECT page, count(*) AS cards FROM ({CARDS}) GROUP BY page) GROUP BY cards, page % {CHAIN} < {CHAIN - 1}"
VALUES = f"SELECT page AS page_id, k, title AS name, {URL} || '/item/' || k AS link, price, rated AS rating, '' AS none FROM ({CARDS})"
CRAWLED = f"WITH c AS (SELECT *, cast(floor(page / {CHAIN}) AS bigint) AS job_id FROM ({CARDS})), j AS (SELECT job_id, count(DISTINCT page) AS pages FROM c GROUP BY job_id) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY k) AS row_index, title, price, {URL} || '/item/' || k AS product_url, pages, pages < {CHAIN} AS partial, CASE WHEN pages < {CHAIN} THEN 'page_load_failed' ELSE 'no_next_page' END AS stop FROM c JOIN j USING (job_id)"
JOBS = f"WITH c AS (SELECT *, cast(floor(page / {CHAIN}) AS bigint) AS job_id FROM ({CARDS})) SELECT job_id, count(*) AS rows, count(DISTINCT page) AS pages, count(DISTINCT page) < {CHAIN} AS partial, 'pagination_next_detected' || CASE WHEN count(DISTINCT page) < {CHAIN} THEN ',page_load_failed' ELSE '' END AS warnings FROM c GROUP BY job_id"
TEMPLATE_JOBS = f"WITH c AS (SELECT *, cast(floor(page / {CHAIN}) AS bigint) AS job_id FROM ({CARDS})), j AS (SELECT job_id, count(*) AS rows, count(DISTINCT page) AS pages FROM c GROUP BY job_id) SELECT job_id, rows, pages, pages < {CHAIN} AS partial, array_to_string(list_transform(range(CASE WHEN pages < {CHAIN} THEN pages ELSE pages - 1 END), lambda i: 'template_pagination_next_used') || [CASE WHEN pages < {CHAIN} THEN 'page_load_failed' ELSE 'template_pagination_not_found' END], ',') AS warnings FROM j"
