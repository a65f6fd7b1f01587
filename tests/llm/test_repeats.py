"""Removed repeats against a plain index of all strings of 50 bytes."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyrack.llm.repeats import intervals, repeated_spans, repeats


def plain(rows):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            if doc is not None:
                first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if doc is not None and first[raw[i : i + 50]] < doc:
                gone[i : i + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((doc, len(raw), edges[::2].tolist(), edges[1::2].tolist(), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("variants", [10_000, 2])
def test_spans(spark, variants):
    r = random.Random(variants)
    prose = lambda n: "".join(r.choices("abcdefgh éß\n", k=n))
    shared = [prose(r.randint(40, 160)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [r.choice(shared)[r.choice([0, 0, r.randint(0, 30)]) :][: r.choice([500, r.randint(30, 90)])] if r.random() < 0.5 else prose(r.randint(0, 90)) for _ in range(r.randint(0, 6))]
        rows.append((r.randint(-20, 200), "".join(parts)))
    rows += [(300 + i, "x" * n) for i, n in enumerate([0, 49, 50, 51, 75, 76, 77, 200])] + [(320, "ab" * 60), (321, "ba" * 60), (322, "\0" * 60), (323, "\0" * 80)]
    rows += [(None, shared[0] * 2), (None, None), (400, None), (401, ""), (402, shared[1]), (402, shared[1]), (403, "long one " * 20_000), (404, "long one " * 9)]
    frame = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, batch int, bucket string").repartition(6)
    same(repeated_spans(frame, variants).collect(), plain(rows))


def test_several_batches(spark, monkeypatch):
    """Repeats between batches, and between documents of one batch, in several buckets."""
    from tallyrack.llm import repeats as module

    monkeypatch.setattr(module, "BUCKET", 4096)
    r = random.Random(9)
    words = ["".join(r.choices("etaoin", k=r.randint(2, 7))) for _ in range(300)]
    base = [" ".join(r.choices(words, k=60)) for _ in range(40)]
    rows = []
    for i in range(300):
        own = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 3])):
            own[r.randrange(len(own))] = r.choice(words)
        rows.append((i, " ".join(own)))
    same(repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect(), plain(rows))


def test_whole_table(spark):
    from tallyrack.llm.queries import queries

    path = "/root/testdata/sf0.01"
    rows = [(x["doc_id"], x["text"]) for x in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = queries()["op13_repeats"](spark, path).collect()
    want = [(d, n, sum(e) - sum(s), len(s), h) for d, n, s, e, h in plain(rows)]
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want) > 0


def test_intervals():
    """The textbook's acaaacatat: intervals of its suffix array."""
    text = "acaaacatat"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = []
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while text[a + n : a + n + 1] and text[a + n : a + n + 1] == text[b + n : b + n + 1]:
            n += 1
        common.append(n)
    found = {(text[order[lo] :][:length], hi - lo) for length, lo, hi, _ in intervals(common, 1)}
    assert found == {("a", 6), ("aa", 2), ("aca", 2), ("at", 2), ("ca", 2), ("t", 2)}


def test_maximal_repeats():
    """All occurrences of each, against every pair's own extension."""
    r = random.Random(4)
    rows = sorted({("".join(r.choices("ab", k=r.randint(0, 6))), "Z" + "".join(r.choices("ab", k=r.randint(0, 6)))) for _ in range(60)})
    table = lambda x: np.array([list(s.encode().ljust(8, b"\0")) for s in x], np.uint8)
    sizes = lambda x: np.array([len(s) for s in x])
    left, right = [a for a, _ in rows], [b for _, b in rows]
    got = {(before, after, tuple(sorted(own.tolist()))) for before, after, own in repeats(table(right), sizes(right), table(left), sizes(left), np.zeros(len(rows), int), 4, 1)}
    want = set()
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for i in range(len(rows)):
        for j in range(i):
            before, after = prefix(left[i], left[j]), prefix(right[i], right[j])
            if before + after >= 4:
                want.add((before, after, tuple(k for k in range(len(rows)) if left[k][:before] == left[i][:before] and len(left[k]) >= before and right[k][:after] == right[i][:after])))
    assert got == want
