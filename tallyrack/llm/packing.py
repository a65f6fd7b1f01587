"""Best-fit packing with large-item matching (operator 5).

Lengths are integers up to the capacity, so the whole corpus's packing is decided on the histogram of lengths, of at
most `capacity` rows however many documents there are: pieces over a third of the capacity pair at most twice a
sequence by greedy matching, the smaller ones best-fit the gaps in falling order.  The plan lists ranges: "pieces of
this length, ranks a to b, lie in sequences x to x + b - a at this offset".  Executors rank the pieces of a length
and read their places off the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import checkpoint, documents, slices, table, texts, tokenizer_path, trim, unused, without, word_ids

CAPACITY = 4096
#: The id that ends each document.
END_ID = 1
#: A length with more pieces than this is ranked in as many groups as the root of its count, of about as many rows.
RANKED = 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32[, ids]): each document's tokens and the end id, only
    longer ones cut, into full pieces and a shorter last one.  Null text is empty: the end id alone."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, size = word_ids(tokenizer), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for part in slices(batches, most_bytes=1 << 20):
            rows = []
            coded_all = coder.encode([coder.split(x) for x in texts(part.column("text"))])
            for doc, coded in zip(part.column("doc_id").to_pylist(), coded_all, strict=True):
                coded += end
                for k, at in enumerate(range(0, len(coded), size)):
                    one = coded[at : at + size]
                    rows.append((doc, k, at // 4, len(one) // 4, zlib.crc32(one), *[one] * ids))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * ids)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
            rows = coded_all = coded = one = None
            trim()

    return documents(docs, "doc_id", "text").mapInArrow(run, schema)


class _Gaps:
    """Open sequences by the room they have left: room -> ranges (first sequence, how many)."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.ranges:
                insort(self.rooms, room)
                self.ranges[room] = []
            self.ranges[room].append((first, count))

    def best(self, length: int) -> tuple[int, int, int] | None:
        """Takes a range of the tightest room that holds the length."""
        k = bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        first, count = self.ranges[room].pop()
        if not self.ranges[room]:
            del self.ranges[room], self.rooms[k]
        return room, first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """length -> count: rows (length, first rank, one past the last, first sequence, offset), sorted by length and rank."""
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps, fresh = _Gaps(), 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + count, first, offset))
        rank[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside it
        if k >= 0 and large[k] == a and left[a] == 1:
            k -= 1
        if k >= 0:
            b = large[k]
            count = left[a] // 2 if a == b else min(left[a], left[b])
            place(a, count, fresh, 0)
            place(b, count, fresh, a)
            gaps.add(capacity - a - b, fresh, count)
            if not left[b] and a != b:
                del large[k]
        else:
            count = left[a]
            place(a, count, fresh, 0)
            gaps.add(capacity - a, fresh, count)
        fresh += count
        if not left[a]:
            large.pop()
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            found = gaps.best(n)
            if found is None:
                # open as many as the rest fills, and let best fit fill them one after another
                per = capacity // n
                found = capacity, fresh, -(-left[n] // per)
                fresh += found[2]
            room, first, count = found
            per = room // n
            full = min(count, left[n] // per)
            for k in range(per if full else 0):
                place(n, full, first, capacity - room + k * n)
            gaps.add(room - per * n, first, full)
            if full < count and left[n]:
                some = min(per, left[n])
                for k in range(some):
                    place(n, 1, first + full, capacity - room + k * n)
                gaps.add(room - some * n, first + full, 1)
                full += 1
            gaps.add(room, first + full, count - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (length and any other columns) -> the same with sequence_id and offset; columns of these names are replaced.

    Every piece is placed, repeated rows too; sequences have no gaps.  The histogram (at most `capacity` rows) is all
    that the driver reads.  Ranks are dealt out by length and, for frequent lengths, by hash; the hash has a row's
    partition in it, so that rows which repeat very often don't meet in one task.
    """
    cut = without(cut, "sequence_id", "offset")
    names = cut.columns
    salt, own, first, rank, ways, place, n = unused(cut, "salt", "own", "first", "rank", "ways", "place", "n")
    cut = checkpoint(cut.withColumn(place, F.spark_partition_id()))
    counts = {r.length: r[n] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias(n)).collect()}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a piece is longer than the capacity, or empty")
    session, key = cut.sparkSession, [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in names]
    roots = session.createDataFrame([(k, isqrt(c) if c > RANKED else 1) for k, c in counts.items()], f"length int, `{ways}` int")
    hashed = F.xxhash64("length", place, *key)
    salted = cut.join(F.broadcast(roots), "length").withColumn(salt, F.pmod(hashed, F.col(ways)).cast("int"))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias(n)).select("length", salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    ranked = salted.withColumn(own, F.row_number().over(Window.partitionBy("length", salt).orderBy(*(key or [place]))) - 1)
    ranked = ranked.join(firsts, ["length", salt]).withColumn(rank, F.col(first) + F.col(own))
    rows = plan(counts, capacity)
    ranked = ranked.select(*(F.col(f"`{c}`") for c in names), rank)
    schema = StructType(list(ranked.schema)[:-1]).add("sequence_id", LongType()).add("offset", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {int(n): (lo, hi) for n, lo, hi in zip(*_runs(rows[:, 0]), strict=True)}
        for batch in batches:
            length, ranks = batch.column("length").to_numpy(), batch.column(rank).to_numpy()
            found = np.empty(len(ranks), np.int64)
            for n in np.unique(length).tolist():
                mine = length == n
                lo, hi = at[n]
                found[mine] = lo + np.searchsorted(rows[lo:hi, 1], ranks[mine], side="right") - 1
            hit = rows[found]
            more = [pa.array(hit[:, 3] + ranks - hit[:, 1]), pa.array(hit[:, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(sorted_values, return_index=True)
    return values, first, np.append(first[1:], len(sorted_values))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """documents -> one row a piece with its place; with `ids`, the piece's ids as little-endian bytes as well.

    A null or empty text is the end id alone; repeated documents are packed as often as they come; a null doc_id is
    packed like any other.  No documents, no rows.
    """
    return pack(pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), capacity, ids), capacity)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    found = pack_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
