"""Queries on derived tables beside their SQL."""

import decimal

import duckdb
import pytest

from tallyrack.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "events", "labels", "lineitem", "orders", "pages", "part", "supplier")


def plain(value):
    return float(value) if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", ["listing_rows", "template_values", "crawl_rows", "template_crawl_jobs", "js_shell_flags", "variant_merge", "rate_limit_log", "rate_limit_fixed", "rate_limit_in_order", "queue_leases", "page_fingerprint_groups", "next_page_url", "page_menus", "template_dispatch", "template_dispatch_rows", "label_validate", "export_csv_lines", "fetched_pages", "doc_signature_dedupe", "duplicate_ratio_by_source", "clean_offers_dedupe"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries()[name](spark, SF)
    assert set(got.columns) == set(columns)
    rows = lambda of: sorted(str([plain(v) for v in r]) for r in of)
    assert rows(got.select(*columns).collect()) == rows(found.fetchall())
