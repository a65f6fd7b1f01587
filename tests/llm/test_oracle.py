"""The SQL of the corpus queries that SQL can express."""

import duckdb
import pytest

from tallyrack.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def test_links(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(oracle_sql()["op7_covertree"]).fetchall()
    got = queries()["op7_covertree"](spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(want) == sorted(tuple(r) for r in got)


def test_prefixes(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = con.execute(oracle_sql()["op12_prefixtrie"])
    columns = [c[0] for c in found.description]
    got = queries()["op12_prefixtrie"](spark, SF)
    assert set(got.columns) == set(columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


@pytest.mark.parametrize("name", ["op13_repeats", "mixture_targets", "media_payloads", "media_formats", "secrets_base", "lmscore_base"])
def test_parts_of_results(spark, name):
    """Columns of an operator's own result that SQL can compute."""
    small = SF.replace("0.01", "0.001")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = con.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries()[name](spark, small)
    assert set(got.columns) == set(columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
