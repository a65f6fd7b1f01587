"""SimHash near-duplicates by deletion-variant signatures (operator 9).

A fingerprint is cut into two halves.  Two fingerprints at three or fewer differing bits have a half that differs
in one bit at most, so the two share a signature: that half with one position made a wildcard.  Every distinct
fingerprint is indexed under its 2 x 32 one-wildcard signatures; an equality exchange on the signature brings
candidates together, and all 64 bits are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents, release, slices, table, texts
from .components import components

#: A signature with more fingerprints than this is verified in pairs of blocks, each a group of its own.
BLOCK = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles, repeats included; bit set where over half of the hashes have it."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), 42)
    buffer = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    hashes = np.array([digest(buffer[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp, more): fp is the 64-bit fingerprint as a signed long, more are binary columns carried along.  Null
    text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            found = np.array([fingerprint(x) for x in texts(part.column("text"))], dtype=np.uint64)
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "fp": pa.array(found.view(np.int64)), **{c: part.column(c).cast(pa.binary()) for c in more}})

    return documents(docs, "doc_id", "text", *more).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} binary" for c in more)]))


def _forest(group: np.ndarray, bit: int, side: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one signature as all links between them would.

    Wildcard 0 stands for pairs with equal halves as well; at any other wildcard only pairs that differ in that
    position are this signature's own.  Breadth first, so a dense group costs about its size and not its square.
    """
    links = []
    if bit == 0:
        left = np.ones(len(group), bool)
        while left.any():
            front = [int(np.argmax(left))]
            left[front[0]] = False
            while front:
                i = front.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count(group[rest] ^ group[i]) <= most]
                links += [(int(group[i]), int(group[j])) for j in near]
                left[near] = False
                front += near.tolist()
        return links
    sides = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    while len(sides[0]) and len(sides[1]):
        front = [(0, int(sides[0][0]))]
        sides[0] = sides[0][1:]
        while front:
            s, i = front.pop()
            rest = sides[1 - s]
            close = np.bitwise_count(group[rest] ^ group[i]) <= most
            links += [(int(group[i]), int(group[j])) for j in rest[close]]
            front += [(1 - s, int(j)) for j in rest[close]]
            sides[1 - s] = rest[~close]
    return links


def _verify(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (signature, pair of blocks) -> links.  The last run of a batch waits for the next batch."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in chain(batches, [None]):
        if batch is not None:
            new = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("sig", "pair", "fp"), strict=True)]
        else:
            new = held
        sig, pair, fp = new
        if not len(sig):
            continue
        cuts = np.flatnonzero((np.diff(sig) != 0) | (np.diff(pair) != 0)) + 1
        stop = len(sig) if batch is None else (int(cuts[-1]) if len(cuts) else 0)
        edges = np.concatenate([[0], cuts, [len(sig)]])
        long = np.flatnonzero((np.diff(edges) > 1) & (edges[1:] <= stop))
        links: list[tuple[int, int]] = []
        for r in long.tolist():
            lo, hi = edges[r], edges[r + 1]
            bit = int(sig[lo]) & 31
            group = np.unique(fp[lo:hi].view(np.uint64))
            half = 32 if int(sig[lo]) & 32 else 0
            side = ((group >> np.uint64(half + bit)) & np.uint64(1)).astype(np.int8)
            links += _forest(group, bit, side, most)
        held = [x[stop:] for x in new]
        if links:
            both = np.array(links, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def links(prints: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), enough to join all that `most` (up to 3) or fewer bits part.

    A signature is a long: the half's 32 bits without the wildcard, the half's number, the wildcard's place.
    A half that very many fingerprints have is found beforehand (two rows a fingerprint); its signatures are cut
    into blocks by hash, and every pair of blocks is a group of its own: exact, with bounded groups.
    """
    if not 0 <= most <= 3:
        raise ValueError("two halves serve up to three differing bits")
    halves = F.array(F.struct(F.lit(0).alias("half"), F.expr("fp & 4294967295L").alias("v")), F.struct(F.lit(1).alias("half"), F.expr("(fp >> 32) & 4294967295L").alias("v")))
    cut = prints.select("fp", F.explode(halves).alias("x")).select("fp", "x.*")
    wild = F.transform(F.sequence(F.lit(0), F.lit(31)), _signature)
    hot = cut.groupBy("half", "v").count().filter(F.col("count") > block // 2)
    hot = checkpoint(hot.select(F.explode(wild).alias("sig"), "count").groupBy("sig").agg(F.ceil((F.sum("count") + block // 2) / block).cast("int").alias("blocks")))
    rows = cut.select("fp", F.explode(wild).alias("sig"))
    if hot.isEmpty():
        rows = rows.select("sig", F.lit(0).cast("long").alias("pair"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda j: F.least(own, j) * (1 << 31) + F.greatest(own, j))
        rows = rows.join(hot, "sig", "left").select("sig", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"), "fp")
    dealt = rows.repartition("sig", "pair").sortWithinPartitions("sig", "pair")
    return dealt.mapInArrow(lambda batches: _verify(batches, most), "a long, b long")


def _signature(i: Column) -> Column:
    bit = F.pow(F.lit(2.0), i).cast("long")
    return F.col("v").bitwiseAND(F.lit((1 << 32) - 1) - bit) * 64 + F.col("half") * 32 + i


def near_duplicates(docs: DataFrame, most: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """documents -> (doc_id, fp, component_id) and, with `more` columns to carry along, these and root, which names
    the component whatever its ids: the smallest doc_id among the documents reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows stay; a null doc_id is
    never a component's name unless all its documents have none.  No tables of documents reach the driver.
    """
    prints = checkpoint(fingerprints(docs, *more))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(classes.select("fp"), most))
    named = classes.join(joined.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = checkpoint(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id", "root")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id", *more, *(["root"] if more else []))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
