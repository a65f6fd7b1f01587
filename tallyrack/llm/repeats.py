"""Suffix-array deduplication by common-prefix intervals (operator 13).

A suffix of every byte would be a hundred times the corpus.  Of each window of LEAST bytes only one suffix is kept, the
one at the window's minimiser (the least hashed K bytes, the first of equal ones): equal windows have it at equal
places, so an enhanced suffix array of these alone meets every repeat of LEAST bytes or more.

Texts are packed into batches, which stay in the shared folder, and batches and buckets of minimisers exchange messages:

1. batches send each distinct minimiser once, buckets answer which are repeated;
2. batches send the repeated ones' contexts (the bytes of their windows) with the least doc_id, each distinct one once;
   a bucket sorts them into a suffix array with common-prefix lengths, and its stack scan gives the intervals, i.e. the
   strings that several share; of an interval those are maximal repeats whose left extensions differ, found by the same
   scan over the reversed left contexts.  All occurrences of a repeat get its least doc_id, not neighbours alone;
3. batches read for each window whether a smaller doc_id has it, and remove the bytes.

A batch sends a string once however many of its documents hold it, so copies and frequent passages are no hot key; a
minimiser with more than VARIANTS contexts sends its windows one by one, each a bucket key of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents, table, texts

#: Bytes of the shortest repeat, and of what a minimiser hashes.
LEAST, K = 50, 24
#: Windows that one minimiser can serve, and the longest context.
SPAN = LEAST - K + 1
WIDTH = LEAST + SPAN - 1
#: Bytes of text in a batch, and windows that are hashed at a time.
BATCH, CHUNK = 8 << 20, 1 << 20
#: Bytes of text for each bucket, about.
BUCKET = 4 << 20
#: Distinct contexts of a minimiser that may share a bucket.
VARIANTS = 10_000

_zstd = pa.Codec("zstd")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def _squeeze(x: np.ndarray | bytes) -> bytes:
    raw = bytes(x) if isinstance(x, (bytes, bytearray)) else np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def _spread(x: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(_zstd.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), kind)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _ODD[3]
    h ^= h >> np.uint64(32)
    return h


def _octets(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros after the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = padded[: len(text)].astype(np.uint64)
    for j in range(1, 8):
        out |= padded[j : j + len(text)].astype(np.uint64) << np.uint64(8 * j)
    return out


class Runs:
    """The windows of some texts that follow each other, in runs of one minimiser.

    start, n: a run's first window and how many follow each other; off: where the minimiser is after `start`; key: its
    hash; doc: its text.  A run's context are the bytes of its windows; (key, off, lanes) stand for them.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray) -> None:
        stops = np.cumsum(sizes)
        starts, anchors = [], []
        for lo in range(0, max(0, len(text) - LEAST + 1), CHUNK):
            hi = min(lo + CHUNK, len(text) - LEAST + 1)
            words = _octets(text[lo : hi + LEAST - 1])
            n = hi - lo + SPAN - 1
            h = _mix(words[:n] * _ODD[0] + words[8 : n + 8] * _ODD[1] ^ words[16 : n + 16] * _ODD[2])
            best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
            width = 1
            while width < SPAN:
                step = min(width, SPAN - width)
                best = np.minimum(best[: len(best) - step], best[step:])
                width += step
            anchors.append((best & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo)
            starts.append(np.arange(lo, hi))
        at = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
        start = np.concatenate(starts) if starts else at
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
        there = start + LEAST <= stops[doc] if len(at) else np.zeros(0, bool)
        new = there.copy()
        new[1:] &= ~there[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        self.start = start[new]
        self.n = np.diff(np.append(np.flatnonzero(new[there]), there.sum()))
        self.off = at[new] - self.start
        self.doc = doc[new]
        self.text = text
        self.key, _ = self._hash(self.start + self.off, np.full(len(self.off), K))

    def _hash(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of text[at : at + size]; sizes of 8 at least."""
        one, two = size.astype(np.uint64) * _ODD[4], size.astype(np.uint64) * _ODD[5]
        words = np.concatenate([self.text, np.zeros(8, np.uint8)])
        for j in range(0, WIDTH, 8):
            live = j < size
            if not live.any():
                break
            place = np.minimum(at + j, at + size - 8)
            w = np.zeros(len(at), np.uint64)
            for k in range(8):
                w |= words[place + k].astype(np.uint64) << np.uint64(8 * k)
            one = np.where(live, _mix((one ^ w) * _ODD[6]), one)
            two = np.where(live, _mix((two + w) * _ODD[7]), two)
        return one, two

    def lanes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self._hash(self.start[which], self.n[which] + LEAST - 1)
        return one, two ^ (self.off[which].astype(np.uint64) * _ODD[8])


def _batch(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (the largest where null), sizes and text of a packed batch; texts without an id count as empty for runs."""
    ids = np.array([(1 << 63) - 1 if i is None else i for i in row["ids"]], np.int64)
    return ids, np.array(row["sizes"], np.int64), _spread(row["text"])


def packed(docs: DataFrame) -> DataFrame:
    """documents -> (batch, ids, sizes, text): about BATCH bytes of text a row (a longer text has its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, held = [], [], 0

        def row() -> pa.RecordBatch:
            sizes = pa.array([[len(x) for x in own]], pa.list_(pa.int64()))
            return pa.record_batch({"ids": pa.array([ids], pa.list_(pa.int64())), "sizes": sizes, "text": pa.array([_squeeze(b"".join(own))], pa.binary())})

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), texts(batch.column("text")), strict=True):
                if own and held + len(raw) > BATCH:
                    yield row()
                    ids, own, held = [], [], 0
                ids.append(doc)
                own.append(raw)
                held += len(raw) + 16
        if own:
            yield row()

    rows = documents(docs, "doc_id", "text").mapInArrow(run, "ids array<long>, sizes array<long>, text binary")
    return checkpoint(rows.withColumn("batch", F.monotonically_increasing_id()))


def _by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """A stable order of keys by bucket, and each bucket's slice of it."""
    bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    held, at = np.unique(bucket[order], return_index=True)
    return order, [(int(b), slice(int(i), int(j))) for b, i, j in zip(held, at, [*at[1:], len(order)], strict=True)]


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each distinct one, in sorted order; every row's place among them)."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


class Sent:
    """What a batch sends in the first two rounds, made anew in each so that answers can be read by place."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> None:
        self.runs = r = Runs(text, sizes)
        self.ids = ids
        nameless = ids[r.doc] == (1 << 63) - 1  # texts without an id neither remove nor lose anything
        if nameless.any():
            for c in ("start", "n", "off", "doc", "key"):
                setattr(r, c, getattr(r, c)[~nameless])
        self.least = ids[r.doc]
        self.keys, self.key_of = np.unique(r.key, return_inverse=True)

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and how many distinct contexts each has here."""
        everything = np.arange(len(self.runs.key))
        first, _ = _distinct(self.runs.key, *self.runs.lanes(everything))
        return self.keys, np.bincount(self.key_of[first], minlength=len(self.keys)).astype(np.uint32)

    def contexts(self, answer: np.ndarray) -> None:
        """Distinct contexts of keys that are answered 1, and single windows of those answered 2."""
        r, kind = self.runs, answer[self.key_of]
        # A key that only this batch has still repeats if several of its documents hold it.
        alone = kind == 0
        low, high = np.full(len(self.keys), 1 << 62), np.full(len(self.keys), -1)
        np.minimum.at(low, self.key_of, r.doc)
        np.maximum.at(high, self.key_of, r.doc)
        kind = np.where(alone & (low != high)[self.key_of], 1, kind)
        whole = np.flatnonzero(kind == 1)
        split = np.flatnonzero(kind == 2)
        each = np.repeat(split, r.n[split])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(r.n[split]) - r.n[split], r.n[split])
        windows = r.start[each] + nth
        w1, w2 = r._hash(windows, np.full(len(windows), LEAST))
        one, two = r.lanes(whole)
        self.owner, self.nth = np.concatenate([whole, each]), np.concatenate([np.zeros(len(whole), np.int64), nth])
        key = np.concatenate([r.key[whole], w1 ^ _ODD[9]])
        first, self.place = _distinct(key, np.concatenate([one, w1]), np.concatenate([two, w2]))
        self.start = np.concatenate([r.start[whole], windows])
        self.n = np.concatenate([r.n[whole], np.ones(len(windows), np.int64)])
        off = np.concatenate([r.off[whole], np.zeros(len(windows), np.int64)])
        self.low = np.full(len(first), (1 << 63) - 1)
        np.minimum.at(self.low, self.place, self.least[self.owner])
        self.key, self.at, self.off, self.count = key[first], self.start[first], off[first], self.n[first]


def _answers(table_: pa.Table, size: int, kind, order: np.ndarray, slices: list, column: str) -> np.ndarray:
    out = np.zeros(size, kind)
    at = dict(slices)
    for bucket, raw in zip(table_.column("bucket").to_pylist(), table_.column(column).to_pylist(), strict=True):
        out[order[at[bucket]]] = _spread(raw, kind)
    return out


def _first_round(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, variants = Sent(*_batch(row)).minimisers()
                order, slices = _by_bucket(keys, buckets)
                keys, variants = keys[order], variants[order]
                yield pa.record_batch({"bucket": pa.array([b for b, _ in slices], pa.int64()), "batch": pa.array([row["batch"]] * len(slices), pa.int64()), "keys": pa.array([_squeeze(keys[s]) for _, s in slices], pa.binary()), "variants": pa.array([_squeeze(variants[s]) for _, s in slices], pa.binary())})

    return run


def _repeated(variants: int):
    """A bucket's keys -> for each batch which of its keys other batches have too: 1, or 2 where contexts are many."""

    def run(own: pa.Table) -> pa.Table:
        keys = [_spread(x, np.uint64) for x in own.column("keys").to_pylist()]
        counts = [_spread(x, np.uint32) for x in own.column("variants").to_pylist()]
        _, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        total = np.bincount(place, np.concatenate(counts))
        kind = np.where(total > variants, 2, np.where(times > 1, 1, 0)).astype(np.uint8)[place]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"batch": own.column("batch"), "bucket": own.column("bucket"), "kinds": pa.array([_squeeze(x) for x in np.split(kind, cuts)], pa.binary())})

    return run


def _second_round(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("bucket", "batch", "keys", "low", "off", "count", "bytes")}
        for row in left.to_pylist():
            sent = Sent(*_batch(row))
            order, slices = _by_bucket(sent.keys, buckets)
            sent.contexts(_answers(right, len(sent.keys), np.uint8, order, slices, "kinds"))
            order, slices = _by_bucket(sent.key, buckets)
            for b, s in slices:
                which = order[s]
                size = sent.count[which] + LEAST - 1
                at = np.repeat(sent.at[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                for c, x in (("bucket", b), ("batch", row["batch"]), ("keys", _squeeze(sent.key[which])), ("low", _squeeze(sent.low[which])), ("off", _squeeze(sent.off[which].astype(np.uint8))), ("count", _squeeze(sent.count[which].astype(np.uint8))), ("bytes", _squeeze(sent.runs.text[at]))):
                    out[c].append(x)
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "batch": pa.array(out["batch"], pa.int64())} | {c: pa.array(out[c], pa.binary()) for c in ("keys", "low", "off", "count", "bytes")})

    return run


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Stack scan of common-prefix lengths of neighbours (common[i]: rows i and i + 1) -> (length, first row, row after
    the last, rows where its children begin) of every interval of length `least` or more, children first."""
    stack: list[tuple[int, int, list[int]]] = []
    for i in range(len(common) + 1):
        here = common[i] if i < len(common) else -1
        begin = i
        while stack and stack[-1][0] > here:
            length, begin, cuts = stack.pop()
            if length >= least:
                yield length, begin, i + 1, [begin, *cuts]
        if stack and stack[-1][0] == here:
            stack[-1][2].append(i + 1)
        elif here >= 0:
            stack.append((here, begin, [i + 1]))


def _shared(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of two byte tables, `most` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def repeats(right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, group: np.ndarray, least: int, shortest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats of distinct contexts around a place: (bytes before the place, bytes from it on, all rows that
    share them), of `least` bytes together and `shortest` from the place on at least.

    Rows are byte tables with what follows the place and, reversed, what is before it; only rows of one group are
    compared.  The suffix array is the order by (group, right); an interval of common prefixes is right-maximal.  Its
    rows, ordered by their reversed left sides, are scanned alike: an interval there is left-maximal, and it is a repeat
    that no longer one stands for if its rows come from several children of the first.
    """
    n = len(group)
    wide = lambda x: x.view(f"S{x.shape[1]}").ravel()
    sa = np.lexsort((right_size, wide(right), group))
    lrank = np.empty(n, np.int64)
    left_order = np.lexsort((left_size, wide(left)))
    lrank[left_order] = np.arange(n)
    same = group[sa][1:] == group[sa][:-1]
    common = np.where(same, _shared(right[sa][1:], right[sa][:-1], np.minimum(right_size[sa][1:], right_size[sa][:-1])), -1)
    for length, lo, hi, cuts in intervals(common.tolist(), shortest):
        own = sa[lo:hi]
        child = np.searchsorted(np.array(cuts), np.arange(lo, hi), "right")
        by_left = np.argsort(lrank[own], kind="stable")
        own, child = own[by_left], child[by_left]
        before = _shared(left[own[1:]], left[own[:-1]], np.minimum(left_size[own[1:]], left_size[own[:-1]]))
        for depth, i, j, _ in intervals(before.tolist(), max(0, least - length)):
            if (child[i:j] != child[i]).any():
                yield depth, length, own[i:j]


def _scan(own: pa.Table) -> pa.Table:
    """A bucket's contexts -> for each batch and context a bit for each window, set if a smaller doc_id has it."""
    parts = [{c: _spread(own.column(c)[i].as_py(), kind) for c, kind in (("keys", np.uint64), ("low", np.int64), ("off", np.uint8), ("count", np.uint8), ("bytes", np.uint8))} for i in range(own.num_rows)]
    key, low, off, count, raw = (np.concatenate([p[c] for p in parts]) for c in ("keys", "low", "off", "count", "bytes"))
    off, count = off.astype(np.int64), count.astype(np.int64)
    size = count + LEAST - 1
    begin = np.cumsum(size) - size
    padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
    whole = padded[begin[:, None] + np.arange(WIDTH)]
    whole[np.arange(WIDTH) >= size[:, None]] = 0
    # Equal contexts are one row of the array, whatever batch they come from.
    tagged = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), off.astype(np.uint8)[:, None], size.astype(np.uint8)[:, None], whole], 1)
    _, first, place = np.unique(tagged.view(f"V{tagged.shape[1]}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(first), (1 << 63) - 1)
    np.minimum.at(least, place, low)
    _, group, members = np.unique(key[first], return_inverse=True, return_counts=True)
    many = np.flatnonzero(members[group] > 1)
    smaller = least[:, None].repeat(SPAN, 1)  # by the minimiser's place in the window
    if len(many):
        row, o, s = first[many], off[first[many]], size[first[many]]
        reach = np.arange(WIDTH)
        right = np.where(reach < (s - o)[:, None], padded[np.minimum(begin[row] + o, len(raw))[:, None] + reach], 0).astype(np.uint8)
        left = np.where(reach[:SPAN] < o[:, None], padded[np.maximum(begin[row][:, None] + o[:, None] - 1 - reach[:SPAN], 0)], 0).astype(np.uint8)
        for before, after, rows in repeats(np.ascontiguousarray(right), s - o, np.ascontiguousarray(left), o, group[many], LEAST, LEAST - SPAN + 1):
            of = many[rows]
            to = slice(max(0, LEAST - after), min(before, SPAN - 1) + 1)
            smaller[of, to] = np.minimum(smaller[of, to], least[of].min())
    bits = ((smaller[place] < low[:, None]) << np.arange(SPAN)).sum(1).astype(np.uint32)
    cuts = np.cumsum([len(p["keys"]) for p in parts])[:-1]
    return pa.table({"batch": own.column("batch"), "bucket": own.column("bucket"), "bits": pa.array([_squeeze(x) for x in np.split(bits, cuts)], pa.binary())})


def _removed(row: dict, kinds: pa.Table, bits: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes, text and which of its bytes go."""
    ids, sizes, text = _batch(row)
    sent = Sent(ids, sizes, text)
    order, slices = _by_bucket(sent.keys, buckets)
    sent.contexts(_answers(kinds, len(sent.keys), np.uint8, order, slices, "kinds"))
    order, slices = _by_bucket(sent.key, buckets)
    bit = _answers(bits, len(sent.key), np.uint32, order, slices, "bits")[sent.place]
    start, off = sent.start, sent.off[sent.place]
    # Where no smaller document elsewhere has a window, the context's own least one may be smaller still.
    own = sent.least[sent.owner] > sent.low[sent.place]
    hits = [start[hit] + j for j in range(SPAN) if (hit := (j < sent.n) & (own | ((bit >> np.maximum(off - j, 0).astype(np.uint32)) & 1).astype(bool))).any()]
    if not hits:
        return ids, sizes, text, np.zeros(len(text), bool)
    gone = np.bincount(np.concatenate(hits), minlength=len(text) + LEAST).astype(np.int32)
    gone[LEAST:] -= gone[:-LEAST].copy()
    return ids, sizes, text, np.cumsum(gone)[: len(text)] > 0


_SPANS = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string"


def _last_round(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        kinds, bits = right.filter(pa.compute.is_valid(right.column("kinds"))), right.filter(pa.compute.is_valid(right.column("bits")))
        for row in left.to_pylist():
            _, sizes, text, gone = _removed(row, kinds, bits, buckets)
            stops = np.cumsum(sizes)
            out: dict[str, list] = {"starts": [], "ends": [], "kept_sha256": []}
            for lo, hi in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
                own = gone[lo:hi]
                if own.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    out["starts"].append(edge[::2])
                    out["ends"].append(edge[1::2])
                    out["kept_sha256"].append(hashlib.sha256(text[lo:hi][~own].tobytes()).hexdigest())
                else:
                    out["starts"].append([])
                    out["ends"].append([])
                    out["kept_sha256"].append(hashlib.sha256(text[lo:hi].tobytes()).hexdigest())
            lists = pa.list_(pa.int64())
            parts.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "starts": pa.array(out["starts"], lists), "ends": pa.array(out["ends"], lists), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}))
        return pa.concat_tables(parts)

    return run


def repeated_spans(docs: DataFrame, variants: int = VARIANTS) -> DataFrame:
    """documents -> (doc_id, n_bytes, starts, ends, kept_sha256): the runs of bytes covered by strings of LEAST bytes that
    also start in a document with a smaller doc_id, and the digest of what remains.

    One row for each row.  Null texts are empty; texts under LEAST bytes lose nothing; a row without a doc_id is smaller
    than none and larger than none, so it loses nothing and takes nothing.  Rows that repeat, or share a doc_id, don't
    remove each other.  A very long text is a batch of its own and is hashed a chunk at a time.  No row, no result.
    """
    batches = packed(docs)
    total = batches.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    keys = batches.mapInArrow(_first_round(buckets), "bucket long, batch long, keys binary, variants binary")
    kinds = checkpoint(keys.groupBy("bucket").applyInArrow(_repeated(variants), "batch long, bucket long, kinds binary"))
    answers = kinds.withColumnRenamed("batch", "into")
    contexts = batches.groupBy("batch").cogroup(answers.groupBy("into")).applyInArrow(_second_round(buckets), "bucket long, batch long, keys binary, low binary, off binary, count binary, bytes binary")
    bits = contexts.groupBy("bucket").applyInArrow(_scan, "batch long, bucket long, bits binary")
    none = F.lit(None).cast("binary")
    both = kinds.select(F.col("batch").alias("into"), "bucket", "kinds", none.alias("bits")).unionByName(bits.select(F.col("batch").alias("into"), "bucket", none.alias("kinds"), "bits"))
    return batches.groupBy("batch").cogroup(both.groupBy("into")).applyInArrow(_last_round(buckets), _SPANS)


def op13_repeats(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
