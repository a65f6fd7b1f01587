"""Cover trees: their invariants, the dual traversal and the whole operator against all pairs."""

import numpy as np
import pytest

from tallyrack.llm.covertree import CoverTree, dual, near_duplicates, unit


def points(n, dim, seed):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(max(1, n // 8), dim))
    return centers[r.integers(0, len(centers), n)] + r.choice([0.0, 0.05, 0.12, 0.3], n)[:, None] * r.normal(size=(n, dim))


@pytest.mark.parametrize("n,dim", [(1, 3), (2, 2), (60, 2), (200, 8), (150, 40)])
def test_tree_and_traversal(n, dim):
    x, y = unit(points(n, dim, 1).tolist()), unit(points(n + 5, dim, 2).tolist())
    one, two = CoverTree(x), CoverTree(y)
    for k, kids in enumerate(one.children):
        if len(one.members[k]) > 1:
            assert one.center[kids[0]] == one.center[k]
            assert sorted(np.concatenate([one.members[c] for c in kids])) == sorted(one.members[k])
            assert all(one.radius[c] <= max(one.radius[k], 1e-12) for c in kids)
        assert np.sqrt(np.maximum(0, 2 - 2 * x[one.members[k]] @ x[one.center[k]])).max() <= one.radius[k] + 1e-7
    r = np.random.default_rng(3)
    w1, w2 = r.integers(1, 5, n), r.integers(1, 5, n + 5)
    near = x @ y.T >= 0.93
    n1, n2, links = dual(one, two, w1, w2, 0.93)
    assert (n1 == near @ w2).all() and (n2 == near.T @ w1).all() and all(near[a, b] for a, b in links)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    n1, _, links = dual(one, one, w1, w1, 0.93, True)
    assert (n1 == near @ w1).all() and all(near[a, b] for a, b in links)


def brute(rows):
    ok = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) and label is not None for _, v, label in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float64(np.float32(rows[i][1])), np.float64(np.float32(rows[j][1]))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), v), v)
    return sorted((v, n[i], least[find(i)], v == least[find(i)]) for i, (v, _, _) in enumerate(rows))


def test_operator(spark):
    x = points(260, 6, 5).astype(np.float32).tolist()
    rows = [(1000 - i, v, i % 3 if i % 17 else 0) for i, v in enumerate(x)]
    rows += [(2000 + i, x[0], 0) for i in range(20)] + [(2100, [2 * c for c in x[1]], 1), (2101, x[3], None), (2102, None, 0), (2103, [], 0), (2104, [0.0] * 6, 0), (2105, [-0.0] * 6, 0)]
    rows += [(2106, [float("nan")] * 6, 0), (2107, [float("inf"), 1.0], 0), (2108, [None, 1.0], 0), (2109, [1.0, 2.0], 0), (2110, [1.0, 2.0], 0), (2111, [1e-30] * 6, 1), (2112, [1e30] * 6, 1)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    want = brute(rows)
    for block in (1024, 12):
        assert sorted(tuple(g) for g in near_duplicates(frame, block=block).collect()) == want
    assert near_duplicates(frame.filter("false")).collect() == []


def test_units_grow_in_proportion_on_separated_clusters(spark):
    """Cells are divided again and again; on clusters that lie apart, pairs of cells grow as the vectors do."""
    from tallyrack.llm.covertree import dealt

    found = []
    for n in (250, 1000):
        r = np.random.default_rng(7)
        centres = unit(r.normal(size=(n // 5, 3)).tolist())
        x = centres[np.arange(n) % len(centres)] + 0.002 * r.normal(size=(n, 3))
        frame = spark.createDataFrame([(1, 3, i, 1, v) for i, v in enumerate(x.astype(np.float32).tolist())], "label int, dim int, node long, weight long, embedding array<float>")
        members, pairs = dealt(frame, 3, 0.02)
        sizes = [r["count"] for r in members.groupBy("cell").count().collect()]
        assert sum(sizes) == n and sorted(r.node for r in members.select("node").collect()) == list(range(n))
        assert max(c.cell.count("/") for c in members.select("cell").distinct().collect()) >= 2
        found.append(pairs.count())
        rows = [(i, v, 1) for i, v in enumerate(x.astype(np.float32).tolist())]
        if n == 250:
            want = brute(rows)
            assert sorted(tuple(g) for g in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=12).collect()) == want
    assert found[1] < 4 * 1.6 * found[0], found


def test_dense_vectors_and_repeated_nulls(spark):
    """No radius separates them; a cell that its pivots don't divide is cut by hash.  Rows without an id repeat."""
    r = np.random.default_rng(8)
    x = (np.ones(6) + 0.05 * r.normal(size=(90, 6))).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(g) for g in near_duplicates(frame, block=8).collect()) == brute(rows)
    nulls = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (None, None, 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((g.vec_id or 0, g.n_links, g.component_id or 0, g.kept) for g in near_duplicates(nulls).collect()))
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (0, 2, 5, False), (0, 2, 5, False), (5, 2, 5, True)]
