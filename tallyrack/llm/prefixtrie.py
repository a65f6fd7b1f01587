"""Conversation prefix trie by Patricia construction (operator 12).

Conversations are paths of turns; equal prefixes are one node.  A prefix is known by two 64-bit exclusive ors of its
turns' hashes (depth and digest), so the hashes of all prefixes of a conversation are running ones, and whatever is
long (a conversation, a group of copies) is cut: turns are ranked by one global sort, and paths are held in segments of
at most SEGMENT turns.  Distinct paths are sorted; neighbours' common prefixes give the branch points.  Branch, end and
leaf points (and the joints of segments) are the only ones that are created, with the edge above each compressed.
Aggregates are made on those points; unary nodes come last, from suffix sums along their edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Turns of a path that are held in one row, at most.
SEGMENT = 256
#: What the contract fixes: conversations of a block open with the block's first one, for 0 to 5 of its turns.
BLOCK, OPENINGS = 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """-> (conv_id, turn, digest, size), one row a turn: digest tells (role, text) apart, size counts code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("size"))
    return own.filter("conv_id IS NOT NULL")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds `nth`, a turn's place in its conversation from 0: by turn (null first), ties by digest.

    One global sort cuts long conversations between tasks.  A row's number in the sorted table is its task's and its
    place there; what a conversation has in earlier tasks is summed over (conversation, task) pairs.
    """
    order = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "digest").withColumn("at", F.monotonically_increasing_id())
    order = checkpoint(order.withColumn("task", F.shiftright("at", 33)))
    parts = order.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "task", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("zero"))
    return order.join(parts, ["conv_id", "task"]).select("conv_id", (F.col("at") - F.col("zero")).alias("nth"), "digest", "size")


def rebuilt(rows: DataFrame, base: Column, opening: Column) -> tuple[DataFrame, DataFrame]:
    """Ranked turns -> ((conv_id, depth, digest, size) of the rebuilt conversations, their (conv_id)s).

    A conversation opens with the first `opening` turns (a small number) of conversation `base`, or as many as that
    has; its own turns after its first `opening` follow.
    """
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", base.alias("base"), opening.cast("long").alias("h"))
    there = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = checkpoint(sizes.join(there, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m")))
    heads = rows.filter(F.col("nth") < OPENINGS - 1).select(F.col("conv_id").alias("base"), F.col("nth"), "digest", "size")
    opens = plan.join(heads, "base").filter("nth < m").select("conv_id", (F.col("nth") + 1).alias("depth"), "digest", "size")
    own = rows.join(plan, "conv_id").filter("nth >= h").select("conv_id", (F.col("m") + F.col("nth") - F.col("h") + 1).alias("depth"), "digest", "size")
    return opens.unionByName(own), plan.select("conv_id")


def segments(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, size) -> (conv_id, k, a, b, n, steps): path segments of at most SEGMENT turns; a and b
    are the hash of the prefix before it, steps the (a, b, size) of its nodes."""
    hashed = paths.select("conv_id", F.floor((F.col("depth") - 1) / SEGMENT).alias("k"), "depth", F.xxhash64("depth", "digest").alias("a"), F.xxhash64(F.lit(12), "digest", "depth").alias("b"), "size")
    cut = hashed.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "size"))).alias("turns"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.bit_xor(x).over(before), F.lit(0).cast("long")).alias(c) for x, c in (("xa", "a"), ("xb", "b"))]
    none = F.expr("CAST(array() AS array<struct<a: bigint, b: bigint, size: bigint>>)")
    last = lambda steps, c, first: F.when(F.size(steps) == 0, F.col(first)).otherwise(F.element_at(steps, -1)[c])

    def step(steps: Column, t: Column) -> Column:
        return F.concat(steps, F.array(F.struct(last(steps, "a", "a").bitwiseXOR(t["a"]).alias("a"), last(steps, "b", "b").bitwiseXOR(t["b"]).alias("b"), t["size"].alias("size"))))

    held = cut.select("conv_id", "k", "turns", *start)
    return held.select("conv_id", "k", "a", "b", F.size("turns").alias("n"), F.aggregate("turns", none, step).alias("steps"))


def _common(rows: pa.Table | pa.RecordBatch, held: list) -> Iterator[tuple]:
    """Branch points between neighbours of sorted rows: where two segments with one start part."""
    for a, b, steps in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("steps"), strict=True):
        own = np.column_stack([steps.values.field(c).to_numpy() for c in ("a", "b")])
        if held and held[:2] == [a, b]:
            n = min(len(own), len(held[2]))
            differ = np.flatnonzero((own[:n] != held[2][:n]).any(1))
            shared = differ[0] if len(differ) else n
            yield (a, b) if shared == 0 else tuple(own[shared - 1].tolist())
        held[:] = [a, b, own]


POINT = "a long, b long"
_EDGE = "a: bigint, b: bigint, steps: array<struct<a: bigint, b: bigint, size: bigint>>"


def branches(paths: DataFrame) -> DataFrame:
    """(a, b, steps) segments -> the (a, b) of points where sorted neighbours part.  The first and last row of each
    task are compared once more in one small task, two rows for each task, since their neighbours are elsewhere."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        ends: list[dict] = []
        for batch in batches:
            points = list(_common(batch, held))
            for i in range(0, len(points), 1 << 16):
                part = points[i : i + (1 << 16)]
                yield pa.record_batch({"a": pa.array([p[0] for p in part], pa.int64()), "b": pa.array([p[1] for p in part], pa.int64()), "edge": pa.nulls(len(part), _arrow_edge())})
            if batch.num_rows:
                for row in ([batch.slice(0, 1)] if not ends else []) + [batch.slice(batch.num_rows - 1)]:
                    ends[1:] = row.to_pylist() if ends else []
                    if not ends:
                        ends = row.to_pylist()
        if ends:
            yield pa.record_batch({"a": pa.nulls(len(ends), pa.int64()), "b": pa.nulls(len(ends), pa.int64()), "edge": pa.array([{c: e[c] for c in ("a", "b", "steps")} for e in ends], _arrow_edge())})

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            points = list(_common(batch, held))
            yield pa.record_batch({"a": pa.array([p[0] for p in points], pa.int64()), "b": pa.array([p[1] for p in points], pa.int64())})

    ordered = paths.select("a", "b", "steps").repartitionByRange("a", "b", "steps").sortWithinPartitions("a", "b", "steps")
    found = checkpoint(ordered.mapInArrow(scan, f"{POINT}, edge struct<{_EDGE}>"))
    edges = found.filter("edge IS NOT NULL").select("edge.*").coalesce(1).sortWithinPartitions("a", "b", "steps")
    return found.filter("edge IS NULL").select("a", "b").unionByName(edges.mapInArrow(border, POINT)).distinct()


def _arrow_edge() -> pa.DataType:
    step = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64())])
    return pa.struct([("a", pa.int64()), ("b", pa.int64()), ("steps", pa.list_(step))])


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, conv_id) -> (a, b, ends_sha256) of the ids in numerical order.  SHA-256 goes through its input in one
    pass, so a large group is read by one task, sorted outside memory and never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
            starts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()] if len(a) else []
            for at, to in zip(starts, [*starts[1:], len(a)], strict=True):
                text = ",".join(map(str, ids[at:to].tolist())).encode()
                if key == (a[at], b[at]):
                    state.update(b"," + text)
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a[at], b[at]), hashlib.sha256(text)
            yield _digests(out)
            out = []
        yield _digests([(*key, state.hexdigest())] if key is not None else [])

    return ends.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id").mapInArrow(run, f"{POINT}, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})


def compressed(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Segments of all conversations -> the tree's points, each with the edge above it.

    (a, b, depth, up_a, up_b, conv_id, n_convs, n_children, n_leaves, below, sizes, ends_sha256): `sizes` are those of
    the edge's nodes, the point's own last (none for the root, whose up_a is null); `below` is saved_tokens of the
    subtree under the edge.  Copies of a conversation are one path with a count; its least conv_id stands for it.
    """
    last = F.element_at("steps", -1)
    ends = paths.groupBy("conv_id").agg(F.max_by(F.struct(last["a"].alias("a"), last["b"].alias("b")), "k").alias("end"))
    zero = F.lit(0).cast("long")
    ends = checkpoint(convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("end.a", zero).alias("a"), F.coalesce("end.b", zero).alias("b")))
    whole = checkpoint(ends.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")))
    own = checkpoint(paths.join(whole.select("conv_id", "copies"), "conv_id"))
    joints = own.select(last["a"].alias("a"), last["b"].alias("b"))
    root = own.sparkSession.createDataFrame([(0, 0)], POINT)
    points = checkpoint(branches(own).unionByName(whole.select("a", "b")).unionByName(joints).unionByName(root).distinct().join(root, ["a", "b"], "left_anti"))
    nodes = own.select("conv_id", "k", F.posexplode("steps").alias("i", "s")).select("conv_id", "k", "i", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    marks = nodes.join(points, ["a", "b"]).groupBy("conv_id", "k").agg(F.sort_array(F.collect_list("i")).alias("marks"))
    cut = own.join(marks, ["conv_id", "k"])
    edge = cut.select("conv_id", "copies", "k", "a", "b", "steps", "marks", F.posexplode("marks").alias("j", "at"))
    before = F.when(F.col("j") > 0, F.get("marks", F.col("j") - 1)).otherwise(F.lit(-1))
    up = lambda c: F.when(F.col("j") > 0, F.get("steps", before)[c]).otherwise(F.col(c))
    low = F.get("steps", F.col("at"))
    sizes = F.transform(F.slice("steps", before + 2, F.col("at") - before), lambda s: s["size"])
    edges = checkpoint(edge.select("conv_id", "copies", low["a"].alias("a"), low["b"].alias("b"), up("a").alias("up_a"), up("b").alias("up_b"), (F.col("k") * SEGMENT + F.col("at") + 1).alias("depth"), sizes.alias("sizes")))
    first = lambda c: F.first(c).alias(c)
    tops = whole.agg(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("depth"), *(F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")), F.expr("CAST(array() AS array<bigint>)").alias("sizes"), F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs")).filter("conv_id IS NOT NULL")
    inner = edges.groupBy("a", "b").agg(first("depth"), first("up_a"), first("up_b"), first("sizes"), F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"))
    tree = checkpoint(inner.unionByName(tops))
    children = tree.filter("up_a IS NOT NULL").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    edge_sum = F.aggregate("sizes", zero, lambda x, y: x + y)
    tree = checkpoint(tree.withColumn("worth", (F.col("n_convs") - 1) * edge_sum))
    # Every point is owned by the least path through it; what a path owns from a depth on belongs to all points above.
    owned = tree.select("conv_id", "a", "b", "depth", "worth", (F.col("n_children") == 0).cast("long").alias("leaf"))
    way = edges.select("conv_id", "a", "b", "depth").unionByName(whole.select("conv_id", zero.alias("a"), zero.alias("b"), zero.alias("depth")))
    way = way.join(owned.drop("depth"), ["conv_id", "a", "b"], "left")
    under = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = way.select("a", "b", *(F.sum(F.coalesce(c, zero)).over(under).alias(c) for c in ("worth", "leaf")))
    sums = sums.groupBy("a", "b").agg(F.sum("worth").alias("total"), F.sum("leaf").alias("n_leaves"))
    out = tree.join(sums, ["a", "b"]).withColumn("below", F.col("total") - F.col("worth")).drop("total", "worth")
    return checkpoint(out.join(end_digests(ends), ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))


def expanded(tree: DataFrame) -> DataFrame:
    """Points -> all nodes.  A node inside an edge has the members of the point below it, one child, no ends; what its
    subtree saves is what lies below the edge and the edge's suffix sum from it on."""
    parents = tree.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("up_conv"))
    tree = tree.join(parents, ["up_a", "up_b"], "left")
    count, zero = F.size("sizes"), F.lit(0).cast("long")
    sums = F.aggregate(F.reverse("sizes"), F.array(zero), lambda x, y: F.concat(x, F.array(F.element_at(x, -1) + y)))
    nodes = tree.withColumn("sums", F.reverse(sums)).withColumn("i", F.explode(F.when(count == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), count))))
    bottom = F.col("i") == count
    saved = F.when(count == 0, F.col("below")).otherwise(F.col("below") + (F.col("n_convs") - 1) * F.get("sums", F.col("i") - 1))
    return nodes.select(
        "conv_id", (F.col("depth") - count + F.col("i")).alias("depth"), F.when(F.col("i") <= 1, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(bottom, F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def prefix_trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, size) turns, depth from 1 without gaps, and all conv_ids, turnless ones too -> one row a
    node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root alone; without conversations there is no node.
    """
    return expanded(compressed(checkpoint(segments(paths)), convs))


def opened(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the opening turns of its block's first one, as the contract has it.  Rows without a
    conv_id belong to no conversation; null roles and texts are empty; repeated rows are turns of their own; extra
    columns are not read."""
    rows = checkpoint(ranked(turns(conversations)))
    c = F.col("conv_id")
    return rebuilt(rows, c - c % BLOCK, F.crc32(c.cast("string").cast("binary")) % OPENINGS)


def op12_prefixtrie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*opened(table(spark, sf_dir, "conversations")))
