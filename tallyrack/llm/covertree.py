"""Embedding near-duplicates by dual traversal of cover trees (operator 7).

Vectors of equal values under one label are one class.  Classes are dealt into bounded blocks by the upper levels of
their label's tree: a large cell's members go to the nearest of its pivots, level by level.  Pairs of cells of a label
that their pivots' covering radii can't rule out are units of work.  In a unit a cover tree is built over each block,
nested levels with halving radii, and the two are traversed together: a pair of nodes is dropped if their covering
radii keep all their points apart, counted whole if these keep all of them together, and else split.  Points that are
left are compared in double precision.  A unit returns a count for each class and a forest of links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents, table, uniform
from .components import components

THRESHOLD = 0.93
#: Classes in a block, about, and pivots of a cell at most.
BLOCK, PIVOTS = 1024, 64
#: What rounding may take from a distance: bounds are kept this far from what they decide.
SLACK = 1e-6


class CoverTree:
    """Unit vectors in nested levels: a node's centre is also the centre of its first child; a child's points lie within
    half of the parent's radius.  `radius` holds each node's true covering radius, `first` and `count` its range in `order`."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        if not len(x):
            return
        away = self._away(0, np.arange(len(x)))
        todo = [self._add(0, np.arange(len(x)), away) + (float(away.max()),)]
        while todo:
            node, members, away, bound = todo.pop()
            if len(members) == 1:
                continue
            if self.radius[node] < 1e-7:  # equal but for rounding: no radius tells them apart
                alone = [self.center[node], *members[members != self.center[node]].tolist()]
                self.children[node] = np.array([self._add(m, np.array([m]), np.zeros(1))[0] for m in alone])
                continue
            bound, left, kids = bound / 2, np.ones(len(members), bool), []
            center, near = self.center[node], away
            while True:
                mine = left & (near <= bound)
                mine |= left & (members == center)
                kids.append((*self._add(center, members[mine], near[mine]), bound))
                left &= ~mine
                if not left.any():
                    break
                center = int(members[np.argmax(left)])
                near = np.full(len(members), np.inf)
                near[left] = self._away(center, members[left])
            self.children[node] = np.array([k[0] for k in kids])
            todo += kids

    def _away(self, center: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[center])))

    def _add(self, center: int, members: np.ndarray, away: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        self.center.append(center)
        self.radius.append(float(away.max()) if len(members) > 1 else 0.0)
        self.children.append(np.zeros(0, np.int64))
        self.members.append(members)
        return len(self.center) - 1, members, away


class _Joined:
    """Union-find that remembers the links which joined something."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    def link(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.root[ra] = rb
            self.links.append((a, b))


def dual(one: CoverTree, two: CoverTree, w1: np.ndarray, w2: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between the points of two trees (or of one tree with itself): for each point, the weight of those it is
    linked to; and a forest of links (of the first's point, of the second's)."""
    n1, n2 = np.zeros(len(one.x), np.int64), np.zeros(len(two.x), np.int64)
    joined, off = _Joined(), 0 if same else len(one.x)
    if not len(one.x) or not len(two.x):
        return n1, n2, []
    reach = sqrt(max(0.0, 2 - 2 * threshold))
    c1, c2 = np.array(one.center), np.array(two.center)
    r1, r2 = np.array(one.radius), np.array(two.radius)
    single1, single2 = np.array([len(m) == 1 for m in one.members]), np.array([len(m) == 1 for m in two.members])
    todo = [(np.array([0]), np.array([0]))]
    while todo:
        a, b = todo.pop()
        for at in range(0, len(a), 512):
            aa = a[at : at + 512]
            dots = one.x[c1[aa]] @ two.x[c2[b]].T
            away = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
            sums = r1[aa][:, None] + r2[b][None, :]
            points = single1[aa][:, None] & single2[b][None, :]
            linked = points & (dots >= threshold)
            if linked.any():
                i, j = np.nonzero(linked)
                p, q = c1[aa[i]], c2[b[j]]
                if same:
                    p, q = p[keep := p != q], q[keep]
                np.add.at(n1, p, w2[q])
                if not same:
                    np.add.at(n2, q, w1[p])
                for u, v in zip(p.tolist(), q.tolist(), strict=True):
                    joined.link(u, v + off)
            whole = ~points & (away + sums <= reach - SLACK)
            for i, j in zip(*(k.tolist() for k in np.nonzero(whole)), strict=True):
                p, q = one.members[aa[i]], two.members[b[j]]
                n1[p] += w2[q].sum()
                if same:  # ordered pairs are visited both ways; a point isn't linked to itself
                    n1[np.intersect1d(p, q)] -= w1[np.intersect1d(p, q)]
                else:
                    n2[q] += w1[p].sum()
                for u in p.tolist():
                    joined.link(u, int(q[0]) + off) if u != int(q[0]) + off else None
                for v in q.tolist():
                    joined.link(int(p[0]), v + off) if v + off != int(p[0]) else None
            for i, j in zip(*(k.tolist() for k in np.nonzero(~points & ~whole & (away <= sums + reach + SLACK))), strict=True):
                x, y = aa[i], b[j]
                todo.append((one.children[x] if len(one.children[x]) else np.array([x]), two.children[y] if len(two.children[y]) else np.array([y])))
    return n1, n2, [(u, v - off) for u, v in joined.links]


def unit(vectors: list) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unit_of_work(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows of one or two blocks (side 0, 1) -> (a, b, n): counts have b null, links have n null."""
    sides = [frame[frame.side == s].sort_values("node") for s in (0, 1)]
    nodes = [s.node.to_numpy() for s in sides]
    trees = [CoverTree(unit(s.embedding.tolist()) if len(s) else np.zeros((0, 1))) for s in sides]
    weights = [s.weight.to_numpy() for s in sides]
    if frame.own.iloc[0]:
        n1, _, links = dual(trees[0], trees[0], weights[0], weights[0], threshold, True)
        counts, ends = [(nodes[0], n1)], (nodes[0], nodes[0])
    else:
        n1, n2, links = dual(*trees, *weights, threshold)
        counts, ends = [(nodes[0], n1), (nodes[1], n2)], (nodes[0], nodes[1])
    out = [pd.DataFrame({"a": node[n > 0], "b": pd.array([None] * int((n > 0).sum()), "Int64"), "n": pd.array(n[n > 0], "Int64")}) for node, n in counts]
    if links:
        p, q = np.array(links).T
        out.append(pd.DataFrame({"a": ends[0][p], "b": pd.array(ends[1][q], "Int64"), "n": pd.array([None] * len(p), "Int64")}))
    return pd.concat(out)


def _valid() -> F.Column:
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)


_KEYS = ["label", "dim", "cell"]


def _nearest(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Members of a cell, a share of them, with the number of their nearest pivot and the distance to it."""
    if not len(rows) or not len(pivots):
        return rows.assign(k=0, away=0.0).head(0)[["label", "dim", "cell", "node", "weight", "embedding", "k", "away"]]
    pivots = pivots.sort_values("k")
    dots = unit(rows.embedding.tolist()) @ unit(pivots["pivot"].tolist()).T
    best = dots.argmax(axis=1)
    away = np.sqrt(np.maximum(0.0, 2 - 2 * dots[np.arange(len(rows)), best]))
    return rows.assign(k=pivots.k.to_numpy()[best], away=away)[["label", "dim", "cell", "node", "weight", "embedding", "k", "away"]]


def _children(frame: pd.DataFrame, reach: float) -> pd.DataFrame:
    """The children of a pair of cells (side 0, 1) -> their pairs that covering radii can't rule out."""
    one, two = (frame[frame.side == k] for k in (0, 1))
    if not len(two):
        two = one
    away = np.sqrt(np.maximum(0.0, 2 - 2 * unit(one["pivot"].tolist()) @ unit(two["pivot"].tolist()).T))
    i, j = np.nonzero(away <= one.radius.to_numpy()[:, None] + two.radius.to_numpy()[None, :] + reach + SLACK)
    a, b = one.cell.to_numpy()[i], two.cell.to_numpy()[j]
    out = pd.DataFrame({"cell0": np.where(a <= b, a, b), "cell1": np.where(a <= b, b, a)}).drop_duplicates()
    return out.assign(label=frame.label.iloc[0], dim=frame.dim.iloc[0])[["label", "dim", "cell0", "cell1"]]


def dealt(nodes: DataFrame, block: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """Classes (label, dim, node, weight, embedding) -> the same with `cell`, and pairs (label, dim, cell0, cell1) of
    cells that may hold links, a cell with itself too.

    A label's classes are one cell at first.  A cell of more than two blocks is dealt out to the nearest of its pivots,
    as many as it has blocks or PIVOTS, and these cells in turn, until none is larger: the upper levels of the label's
    tree.  Pairs go down with them: the children of a pair meet unless their pivots are further apart than their
    covering radii and `reach`.  No table of cells or pivots reaches the driver.  A cell that its pivots don't divide,
    one child having three quarters of it, is left to be cut by hash.
    """
    schema = "label int, dim int, cell string, node long, weight long, embedding array<float>, k int, away double"
    live = nodes.withColumn("cell", F.lit(""))
    sizes = checkpoint(live.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")))
    pairs = sizes.select("label", "dim", F.col("cell").alias("cell0"), F.col("cell").alias("cell1"))
    balls = sizes.select(*_KEYS, F.lit(None).cast("array<float>").alias("pivot"), F.lit(2.0).alias("radius"))
    large, level, members, done = sizes.filter(F.col("n") > 2 * block), 0, [], []
    while not large.isEmpty():
        large = large.select(*_KEYS, "n", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / block)).cast("int").alias("pivots"), F.ceil(F.col("n") / (16 * block)).cast("int").alias("shares"))
        chosen = checkpoint(live.join(large, _KEYS))
        members.append(live.join(large, _KEYS, "left_anti"))
        thin = chosen.filter(uniform(F.col("node"), level) * F.col("n") < 4 * F.col("pivots") + 64)
        first = Window.partitionBy(*_KEYS).orderBy(F.xxhash64("node", F.lit(level)), "node")
        pivots = thin.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= F.col("pivots"))
        pivots = checkpoint(pivots.select(*_KEYS, "k", F.col("embedding").alias("pivot"), "shares"))
        shared = pivots.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        rows = chosen.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).drop("n", "pivots", "shares")
        moved = rows.groupBy(*_KEYS, "share").cogroup(shared.groupBy(*_KEYS, "share")).applyInPandas(_nearest, schema)
        moved = checkpoint(moved.withColumnRenamed("cell", "parent").withColumn("cell", F.concat("parent", F.lit("/"), "k")))
        grown = moved.groupBy("label", "dim", "parent", "cell", "k").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        centres = pivots.select("label", "dim", F.col("cell").alias("parent"), "k", "pivot")
        grown = checkpoint(grown.join(centres, ["label", "dim", "parent", "k"]).join(large.select("label", "dim", F.col("cell").alias("parent"), F.col("n").alias("whole")), ["label", "dim", "parent"]))
        lasting = balls.join(large, _KEYS, "left_anti")
        ends = grown.select("label", "dim", "parent", "cell", "pivot", "radius").unionByName(lasting.select("label", "dim", F.col("cell").alias("parent"), "cell", "pivot", "radius"))
        divided = large.select("label", "dim", F.col("cell").alias("c"), F.lit(True).alias("divided"))
        of = lambda k: divided.withColumnRenamed("c", f"cell{k}").withColumnRenamed("divided", f"divided{k}")
        marked = pairs.join(of(0), ["label", "dim", "cell0"], "left").join(of(1), ["label", "dim", "cell1"], "left")
        open_ = F.coalesce("divided0", "divided1", F.lit(False))
        done.append(marked.filter(~open_).select("label", "dim", "cell0", "cell1"))
        sides = F.when(F.col("cell0") == F.col("cell1"), F.array(F.struct(F.lit(0).alias("side"), F.col("cell0").alias("parent")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("cell0").alias("parent")), F.struct(F.lit(1).alias("side"), F.col("cell1").alias("parent"))))
        met = marked.filter(open_).select("label", "dim", "cell0", "cell1", F.explode(sides).alias("e")).select("label", "dim", "cell0", "cell1", "e.*").join(ends, ["label", "dim", "parent"])
        pairs = checkpoint(met.groupBy("label", "dim", "cell0", "cell1").applyInPandas(lambda f: _children(f, reach), "label int, dim int, cell0 string, cell1 string"))
        balls = checkpoint(ends.select(*_KEYS, "pivot", "radius"))
        live = moved.select("label", "dim", "cell", "node", "weight", "embedding")
        large, level = grown.filter((F.col("n") > 2 * block) & (F.col("n") < 0.75 * F.col("whole"))).select(*_KEYS, "n"), level + 1
    for more in members:
        live = live.unionByName(more)
    for more in done:
        pairs = pairs.unionByName(more)
    return live, pairs


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept).

    Only vectors of one label and one dimension are compared.  A vector that is null, empty, zero or has a null or
    non-finite component, or whose label is null, links with nothing: no links, a component of its own.  Every row
    counts, repeated ones too, as another vector; a null vec_id names a component only if all its vectors' are null.
    """
    own = documents(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    good = own.filter(_valid())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = checkpoint(classes).withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding"))
    celled, pairs = dealt(classes.select("label", "dim", "node", "weight", "embedding"), block, sqrt(max(0.0, 2 - 2 * threshold)))
    celled = checkpoint(celled)
    cells = checkpoint(celled.groupBy(*_KEYS).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    of = lambda k: cells.select("label", "dim", F.col("cell").alias(f"cell{k}"), F.col("parts").alias(f"parts{k}"))
    pairs = pairs.join(of(0), ["label", "dim", "cell0"]).join(of(1), ["label", "dim", "cell1"])
    parts = lambda k: F.explode(F.sequence(F.lit(0), F.col(f"parts{k}") - 1))
    pairs = pairs.withColumn("part0", parts(0)).withColumn("part1", parts(1)).filter((F.col("cell0") < F.col("cell1")) | (F.col("part0") <= F.col("part1")))
    same = (F.col("cell0") == F.col("cell1")) & (F.col("part0") == F.col("part1"))
    ends = [F.struct(F.lit(k).alias("side"), F.col(f"cell{k}").alias("cell"), F.col(f"part{k}").alias("part")) for k in (0, 1)]
    units = pairs.select("label", "dim", "cell0", "part0", "cell1", "part1", same.alias("own"), F.explode(F.when(same, F.array(ends[0])).otherwise(F.array(*ends))).alias("e"))
    units = units.select("label", "dim", "cell0", "part0", "cell1", "part1", "own", "e.*")
    sized = celled.join(cells, _KEYS)
    dealt_out = sized.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(units, [*_KEYS, "part"])
    keys = ["label", "dim", "cell0", "part0", "cell1", "part1"]
    found = dealt_out.select(*keys, "own", "side", "node", "weight", "embedding").groupBy(*keys).applyInPandas(lambda f: _unit_of_work(f, threshold), "a long, b long, n long")
    found = checkpoint(found)
    joined = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    named = classes.join(counts, F.col("node") == F.col("a"), "left").drop("a").join(joined.withColumnRenamed("node", "j"), F.col("node") == F.col("j"), "left")
    named = checkpoint(named.select("label", "embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("label", "embedding", "n_links", "component_id")
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    one = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id", kept)
    rest = own.filter(~F.coalesce(_valid(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return one.union(rest)


def op7_covertree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
