"""Mixing: targets against a plain water filling, dependent rounding against its invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyrack.llm.mixture import mix, targets


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    r = random.Random(2)
    for sizes in ({"a": 10, "é": 1000, None: 5, "b": 0, "Z": 300}, {"one": 7}, {f"s{i}": r.choice([1, 50, 9000]) for i in range(40)}, {"z": 0}):
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {x.source: x.target for x in targets(frame).collect()}
        want = water(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        source = r.choice(["hot"] * 6 + ["b", "c", "é", None])
        rows.append((i, source, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), 1.5, 2))
    rows += [(7, "hot", "twice here", 0.0, 1)] * 2 + [(None, "b", None, 0.0, 1), (5000, "long", "x y " * 20000, 0.0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, target double, size int").repartition(5)
    got = mix(frame).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((g.doc_id, g.source, g.size) for g in got), key=key) == sorted(((i, s, size(t)) for i, s, t, _, _ in rows), key=key)
    assert all(0 <= g.copies <= 3 for g in got)
    totals = {}
    for g in got:
        totals.setdefault(g.source, [0, g.target, 0, g.source_size])
        totals[g.source][0] += g.size * g.copies
        totals[g.source][2] = max(totals[g.source][2], g.size)
    for taken, target, most, source_size in totals.values():
        assert abs(taken - target) <= most and target <= 3 * source_size + 1e-6
    wanted = {g.source: g.target / g.source_size for g in got}
    assert all(abs(g.copies - wanted[g.source]) < 1 for g in got if g.size)
    again = mix(frame.repartition(3)).collect()
    assert sorted(map(tuple, got), key=lambda x: (str(x[0]), x[2], x[5])) == sorted(map(tuple, again), key=lambda x: (str(x[0]), x[2], x[5]))


def test_rounding_is_unbiased(spark):
    """Over many seeds each document is taken as often as its source wants."""
    frame = spark.createDataFrame([(i, "a" if i < 400 else "b", "w " * (i % 12 + 1)) for i in range(800)], "doc_id long, source string, text string").coalesce(1)
    runs = [mix(frame, seed) for seed in range(3)]
    out = runs[0]
    for x in runs[1:]:
        out = out.union(x)
    for g in out.groupBy("source").agg(F.avg("copies").alias("m"), F.max(F.col("target") / F.col("source_size")).alias("want")).collect():
        assert abs(g.m - g.want) < 0.06


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_repeated_rows_are_numbered_apart(spark, monkeypatch):
    """Rows that repeat, with null ids too, don't share a block, whether they are made anew in one task or several."""
    from tallyrack.llm import mixture

    rows = [(None, "a", "one two")] * 500 + [(1, "a", "x")] * 3 + [(None, "a", "other words")] * 2 + [(i, "b", "w " * 9) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = [mix(frame).collect()]
    monkeypatch.setattr(mixture, "CHUNK", 64)
    got.append(mix(frame.repartition(2)).collect())
    key = lambda g: (str(g.doc_id), g.source, g.size, bytes(g.row), g.copies)
    assert sorted(map(key, got[0])) == sorted(map(key, got[1])) and len(got[0]) == len(rows)
    for source in ("a", "b"):
        own = [g for g in got[0] if g.source == source]
        assert abs(sum(g.size * g.copies for g in own) - own[0].target) <= 9
    own = mixture.numbered(mixture.sized(frame).select("doc_id", "source", "size").withColumn("row", F.lit(b"x")))
    assert own.filter("doc_id IS NULL AND size = 2").agg(F.count_distinct("nth")).first()[0] == 502


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_sources_end_near_their_targets(spark, sf):
    """No further off than the larger of the median document and three thousandths of the target; where a source has some
    fifty documents only, than two such documents."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.median("size").alias("median"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("most"))
    for g in found.collect():
        assert abs(g.taken - g.target) <= max(g.median * (2 if g.n < 100 else 1), 0.003 * g.target) and g.most <= 3, g


def test_large_documents_are_made_up_for(spark):
    """A source of small documents and a few huge ones is as near its target as the small ones allow."""
    rows = [(i, "a", "w " * (i % 7 + 1)) for i in range(3000)] + [(5000 + i, "a", "w " * 4000) for i in range(2)] + [(i, "b", "w " * 9) for i in range(9000, 9300)] + [(9999, "c", "w " * 77)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()
    for source, most in (("a", 7), ("b", 9), ("c", 77)):
        own = [g for g in got if g.source == source]
        assert abs(sum(g.size * g.copies for g in own) - own[0].target) <= most
