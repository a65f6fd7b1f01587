"""The catalog's tables derived from the driver's: constructed data, the same in both dialects.

Each is SQL that Spark and DuckDB both run; SPARK-only spellings are avoided.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (SQL, tables that it reads)
TABLES = {
    "jobs": (
        "SELECT o_orderkey AS job_id, o_custkey % 10 AS project_id, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'failed' ELSE 'success' END WHEN 'P' THEN 'partial_success' ELSE CASE WHEN o_orderpriority LIKE '2%' THEN 'cancelled' ELSE 'queued' END END AS status, o_orderdate AS created_at, o_totalprice AS cost FROM orders",
        ("orders",),
    ),
    "job_rows": ("SELECT l_orderkey AS job_id, l_linenumber AS row_index, l_partkey AS part, l_quantity AS quantity, l_returnflag AS flag FROM lineitem", ("lineitem",)),
    "exports": ("SELECT event_id AS export_id, event_id * 3 AS job_id, CASE event_type WHEN 'view' THEN 'csv' ELSE 'json' END AS format, ts AS created_at FROM events WHERE event_type IN ('view', 'click')", ("events",)),
    "usage": ("SELECT event_id, event_type, user_id, ts AS created_at FROM events", ("events",)),
    "request_log": (
        "SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN 401 WHEN user_id % 3 = 1 THEN 429 ELSE 500 END ELSE 200 END AS status, value AS duration_ms, cast(user_id AS varchar(20)) AS user_key, ts FROM events",
        ("events",),
    ),
    "templates": (
        "SELECT s_suppkey AS template_id, 'd' || cast(s_nationkey AS varchar(10)) AS domain, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'f' || cast(s_suppkey % 3 AS varchar(10)) END AS page_fingerprint, CASE WHEN s_suppkey % 2 = 0 THEN 'listing' ELSE 'detail' END AS page_type, round(abs(s_acctbal) / 10000, 2) AS success_rate, s_suppkey % 5 AS version, s_suppkey AS updated_at, s_suppkey % 7 = 0 AS invalidated FROM supplier",
        ("supplier",),
    ),
    "template_pages": ("SELECT c_custkey AS page_id, 'd' || cast(c_nationkey AS varchar(10)) AS domain, 'f' || cast(c_custkey % 4 AS varchar(10)) AS fingerprint FROM customer", ("customer",)),
    "outcomes": ("SELECT user_id AS template_id, event_type <> 'error' AS success, event_id FROM events", ("events",)),
    "objects": (
        """SELECT user_id AS job_id, event_id AS row_index, CASE event_id % 4 WHEN 0 THEN '{"kind": "' || event_type || '", "k": ' || cast(event_id % 90 AS varchar(9)) || '}' WHEN 1 THEN '{"note": "a, ' || chr(92) || '"' || event_type || chr(92) || '"", "kind": "x", "none": null}' WHEN 2 THEN '{"' || event_type || '": "' || cast(event_id AS varchar(20)) || '", "deep": ""}' ELSE props END AS data FROM events""",
        ("events",),
    ),
    "dumped": (
        """SELECT 'https://d.example.com/' || cast(page_id AS varchar(20)) AS url, CASE WHEN page_id % 5 = 0 THEN 301 WHEN page_id % 5 = 1 THEN 404 WHEN page_id % 5 = 3 THEN 302 WHEN page_id % 100 BETWEEN 40 AND 60 THEN 307 ELSE 200 END AS status,
        CASE WHEN page_id % 100 = 44 THEN 'https://d.example.com/42' ELSE 'https://d.example.com/' || cast(page_id + CASE WHEN page_id % 100 BETWEEN 40 AND 60 THEN 2 ELSE 1 END AS varchar(20)) END AS location, html FROM pages""",
        ("pages",),
    ),
    "label_fields": (
        "SELECT l_orderkey AS job_id, CASE l_partkey % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'Price text' WHEN 2 THEN 'Stars' WHEN 3 THEN 'Product  Link' WHEN 4 THEN 'e-mail' WHEN 5 THEN 'created at' ELSE '?' END AS source, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2",
        ("lineitem",),
    ),
    "label_answers": (
        """SELECT l_orderkey AS job_id, CASE l_suppkey % 8 WHEN 0 THEN 'title' WHEN 1 THEN 'Price text' WHEN 2 THEN 'Stars' WHEN 3 THEN 'Product  Link' WHEN 4 THEN 'e-mail' WHEN 5 THEN 'created at' WHEN 6 THEN '?' ELSE 'unknown' END AS source, l_linenumber AS position,
        CASE l_partkey % 5 WHEN 0 THEN 'Product Name!' WHEN 1 THEN '  ' WHEN 2 THEN NULL WHEN 3 THEN 'MRP (INR)' ELSE 'Contact' END AS name, CASE l_partkey % 4 WHEN 0 THEN 'MONEY' WHEN 1 THEN 'nonsense' WHEN 2 THEN NULL ELSE 'text' END AS kind, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE cast(l_discount * 12 AS double) END AS confidence FROM lineitem""",
        ("lineitem",),
    ),
    "labelled": ("SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE ' ' END AS label FROM labels", ("labels",)),
    "catalog": (
        """SELECT p_partkey AS idx, CASE p_partkey % 4 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Lenovo' WHEN 2 THEN ' samsung ' ELSE NULL END AS brand, CASE p_partkey % 3 WHEN 0 THEN 'laptop' WHEN 1 THEN 'smartphone' ELSE NULL END AS category,
        CASE p_partkey % 5 WHEN 0 THEN 'MacBook Air' WHEN 1 THEN 'Galaxy Book4' WHEN 2 THEN NULL ELSE 'IdeaPad Slim 3 Series' END AS product_family,
        CASE p_partkey % 6 WHEN 0 THEN 'MacBook Air 13 inch (2024) M3' WHEN 1 THEN 'Galaxy  Book4 Pro 2023 laptop' WHEN 2 THEN 'motobook 60 pro oled' WHEN 3 THEN NULL ELSE 'IdeaPad ' || cast(p_size % 7 AS varchar(10)) || ' with AMD' END AS model,
        CASE WHEN p_partkey % 7 < 3 THEN 'SKU-' || cast(p_size AS varchar(10)) END AS sku, CASE WHEN p_partkey % 2 = 0 THEN 0.95 ELSE 0.7 END AS sku_confidence,
        CASE WHEN p_partkey % 3 > 0 THEN cast(p_size % 3 * 8 AS varchar(10)) || ' GB' END AS ram, CASE WHEN p_partkey % 4 > 0 THEN '512 GB SSD' END AS storage, CASE WHEN p_partkey % 5 = 1 THEN 'Core i5' END AS processor, CASE WHEN p_partkey % 8 = 1 THEN '13 inch' END AS display,
        CASE WHEN p_partkey % 9 = 1 THEN 'Windows' END AS os_family, CASE WHEN p_partkey % 9 = 1 THEN '11' END AS os_version, p_size * 2500 AS price_inr, 'https://x.example.com/p/' || cast(p_partkey AS varchar(20)) AS product_url,
        CASE WHEN p_partkey % 3 = 0 THEN 'catalog_pattern' ELSE 'normalized_title' END AS name_source, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_canonical_name FROM part""",
        ("part",),
    ),
}


def query(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """SQL over the driver's tables; their names mean nothing outside it."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, *TABLES[name])


def sql_of(name: str) -> str:
    return f"({TABLES[name][0]})"
