"""Language-model scoring (operator 8): add-one word counts, and a causal self-attention model on subword ids.

Base score.  Word counts of all training documents stay a distributed table.  The most frequent words, a bounded
number, go to every task; a document's other words are joined to the table as (document, word) rows and summed.

Model.  log10 P(text) = sum over subword ids and one end id of log10 P(class | context) + log10 P(id | class, class of
the id before).  P(class | context) is masked self-attention over the ids before: queries and keys are learned vectors
of an id's class, each distance has a learned bias, and an id's value is a distribution, that of the classes which
follow it, so that what the attention mixes is a probability.  Texts are cut into windows of 9 inputs that overlap by
3: each token is scored once.

All of it is learned from every training document.  Classes come from how ids stand beside each other, values and ids
within classes from counts, which partitions sum by blocks.  Queries, keys and biases are learned by gradient steps in
numpy over every window, in rounds: each partition goes on from the round's model, and changes are averaged by windows.
"""

from __future__ import annotations

import copy
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents, held_out, release, shared_folder, slices, table, tokenizer_path, values, word_ids, word_lists

#: Words that every task is sent.  A key has LONG bytes at most: longer words are counted by their digest.
HEAD, LONG = 131_072, 64
#: A count's key is the word itself; what no word can be starts with white space: the end token, digests of long words.
_END_KEY, _LONG = b"\n", b"\t"
#: Inputs of a window, those before its first target, width of queries and keys.
WINDOW, OVERLAP, DIM = 9, 3, 16
STEP = WINDOW - OVERLAP
#: What a target sees, one row for each input: the first of its rows and the last, the input right before it; how far each is.
ROWS = [(s * (OVERLAP + 1) + s * (s - 1) // 2, (s + 1) * (OVERLAP + 1) + (s + 1) * s // 2 - 1) for s in range(STEP)]
DISTANCE = np.concatenate([np.arange(OVERLAP + s, -1, -1) for s in range(STEP)])
CLASSES, BUCKETS = 64, 32
END = 49407
IDS = END + 1
#: Each training document is learned from in one of the rounds; a round's rate, and windows a step (or scored at a time).
RATES, BATCH = (0.1, 0.03), 1024
#: How many sightings a class's distribution counts for beside an id's own, and cells of a summed block.
BACKOFF, BLOCK, FAN_IN = 8.0, 1 << 18, 64
#: Words that a worker's coder remembers, and their bytes.
CODER = {"most": 300_000, "most_bytes": 28 << 20}
#: Targets counted at a time, few enough that their numbers stay in the cache.
PLACES = 8192


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONG else _LONG + hashlib.sha256(word).digest()


def _keys(words: pa.Array) -> pa.Array:
    """Keys of some words; almost always the words themselves."""
    if (pc.max(pc.binary_length(words)).as_py() or 0) <= LONG:
        return words
    return pa.array([_key(w) for w in words.to_pylist()], pa.binary())


def word_counts(docs: DataFrame) -> DataFrame:
    """training documents -> (key, c), every word's count; also the end token's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most_bytes=8 << 20, most_rows=1 << 20):
            found = _keys(word_lists(part.column("text"))[0]).value_counts()
            yield pa.record_batch({"key": found.field("values"), "c": found.field("counts")})
            yield pa.record_batch({"key": pa.array([_END_KEY], pa.binary()), "c": pa.array([part.num_rows], pa.int64())})

    return documents(docs, "text").mapInArrow(run, "key binary, c long").groupBy("key").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(key, c) of the most frequent keys, `most` of them or somewhat fewer: those above a count that a small histogram of counts
    gives, so that no partition sends more than belongs to them."""
    step = F.floor(F.log("c") * 16).cast("int")
    left, least = most, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    return counts.filter(F.lit(False) if least is None else step >= least).select("key", "c")


def with_ids(frequent: DataFrame, tokenizer: str) -> DataFrame:
    """(key, c) -> (key, c, ids): the words' subword ids, so that no task codes them again; null where the key is a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer, **CODER)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            coded = iter(coder.pieces([k for k in keys if not k.startswith(_LONG)]))
            ids = [None if k.startswith(_LONG) else np.frombuffer(next(coded), "<u4").astype("<u2").tobytes() for k in keys]
            yield pa.record_batch({"key": batch.column("key"), "c": batch.column("c"), "ids": pa.array(ids, pa.binary())})

    return frequent.mapInArrow(run, "key binary, c long, ids binary")


# ---- windows -------------------------------------------------------------------------------------------------------


def id_lists(column: pa.Array, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    """Coded texts (unsigned 16-bit ids) one after another, as numbers of `kind`, and how many ids each has."""
    data = column.cast(pa.binary())
    return np.frombuffer(b"".join(data.to_pylist()), "<u2").astype(kind), pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // 2


def laid_out(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' ids one after another, each with OVERLAP + 1 ends before it and ends after it, where each window of
    WINDOW + 1 begins, and how many of its STEP targets are real: all ids of a text and one end."""
    windows = -(-(lengths + 1) // STEP)
    ends = np.cumsum(windows * STEP + OVERLAP + 1)
    begins = ends - (windows * STEP + OVERLAP + 1)
    flat = np.full(int(ends[-1]) if len(ends) else 0, END, np.int64)
    flat[np.arange(len(ids)) + np.repeat(begins + OVERLAP + 1 - (np.cumsum(lengths) - lengths), lengths)] = ids
    nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    return flat, np.repeat(begins, windows) + nth * STEP, np.minimum(STEP, np.repeat(lengths + 1, windows) - nth * STEP)


def targets(starts: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Where the real targets of some windows are."""
    places = starts[:, None] + np.arange(OVERLAP + 1, WINDOW + 1)
    return places[np.arange(STEP) < real[:, None]]


def windows_of(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inputs and targets of some windows, (n, WINDOW + 1); a place's ids of all windows lie side by side."""
    return flat.take(np.arange(WINDOW + 1)[:, None] + starts).T


# ---- sums over partitions ------------------------------------------------------------------------------------------


def summed(rows: DataFrame, parts: int, kind: str = "<f8") -> Iterator[tuple[int, np.ndarray]]:
    """(block, who, at, x) rows -> (block, its sum), a partition at a time; at: the cells (32 bits) of a sparse x, else null.  Rows are
    added up FAN_IN at a time before the next exchange, so that no task reads what all partitions send.  What the
    driver gets is of `kind`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0)

        def row() -> pa.RecordBatch:
            return pa.record_batch({"block": pa.array([key[0]], pa.int32()), "who": pa.array([key[1]], pa.int32()), "at": pa.nulls(1, pa.binary()), "x": pa.array([total.astype(kind if last else "<f8").tobytes()], pa.binary())})

        for batch in batches:
            for block, who, at, x in zip(*(batch.column(n).to_pylist() for n in ("block", "who", "at", "x")), strict=True):
                more = np.frombuffer(x, float)
                if at is not None:
                    cells = np.frombuffer(at, "<u4")
                    spread = np.zeros(BLOCK)
                    spread[cells] = more
                    more = spread
                if (block, who) != key:
                    if key is not None:
                        yield row()
                    key, total = (block, who), np.array(more)
                else:
                    total += more
        if key is not None:
            yield row()

    while True:
        parts = -(-parts // FAN_IN)
        last = parts <= 1
        dealt = rows.withColumn("part", F.col("who")).withColumn("who", F.pmod("who", F.lit(max(1, parts)))).repartition("block", "who").sortWithinPartitions("block", "who", "part").select("block", "who", "at", "x")
        rows = dealt.mapInArrow(add, "block int, who int, at binary, x binary")
        if last:
            return ((r.block, np.frombuffer(r.x, kind)) for r in rows.toLocalIterator())


def counted(coded: DataFrame, cells: int, of) -> np.ndarray:
    """Cells that of(flat, places of targets) names, counted over all windows of all coded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, one = np.zeros(cells, np.int32), np.int32(1)
        for part in slices(batches, "ids", 2 << 20, 1 << 20):
            flat, starts, real = laid_out(*id_lists(part.column("ids")))
            places = targets(starts, real)
            for at in range(0, len(places), PLACES):
                for first, size, found in of(flat, places[at : at + PLACES]):
                    np.add.at(total[first : first + size], found, one)
        who = TaskContext.get().partitionId()
        for block, first in enumerate(range(0, cells, BLOCK)):
            own = total[first : first + BLOCK]
            there = np.flatnonzero(own)
            if len(there):
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "who": pa.array([who], pa.int32()), "at": pa.array([there.astype("<u4").tobytes()], pa.binary()), "x": pa.array([own[there].astype(float).tobytes()], pa.binary())})

    out = np.zeros(-(-cells // BLOCK) * BLOCK, np.float32)
    for block, x in summed(coded.mapInArrow(run, "block int, who int, at binary, x binary"), coded.rdd.getNumPartitions(), "<f4"):
        out[block * BLOCK : block * BLOCK + BLOCK] = x
    return out[:cells]


# ---- the model -----------------------------------------------------------------------------------------------------


def bucket(ids: np.ndarray) -> np.ndarray:
    """A number below BUCKETS by a multiplicative hash."""
    return (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - 5)).astype(np.int64)


def beside(flat: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """How often ids of each bucket come after an id, and before it."""
    before, after = flat[places - 1], flat[places]
    yield 0, IDS * BUCKETS, before * BUCKETS + bucket(after)
    yield IDS * BUCKETS, IDS * BUCKETS, after * BUCKETS + bucket(before)


def classes(counts: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Ids in CLASSES classes of a like distribution of neighbours: k-means weighted by count, begun at the most frequent
    ids.  A rare id is drawn to the mean of all."""
    counts = counts.reshape(IDS, BUCKETS)
    weights = counts.sum(axis=1)
    mean = (counts.sum(axis=0) + 1) / (weights.sum() + BUCKETS)
    points = np.sqrt((counts + 4 * mean) / (weights[:, None] + 4)).astype(np.float32)
    centres = points[np.argsort(-weights, kind="stable")[:CLASSES]]
    for _ in range(rounds):
        near = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        mass = np.bincount(near, weights, CLASSES)
        sums = np.stack([np.bincount(near, weights * points[:, i], CLASSES) for i in range(BUCKETS)], axis=1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres).astype(np.float32)
    return (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


class AttentionModel:
    """P(id | ids before it).  context: an id's class as a source, by what comes after it; target: by what comes before."""

    def __init__(self, context: np.ndarray, target: np.ndarray, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.context, self.target = context.astype(np.int64), target.astype(np.int64)
        self.p = {"Q": r.normal(0, 0.3, (CLASSES, DIM)), "K": r.normal(0, 0.3, (CLASSES, DIM)), "R": -0.7 * np.arange(WINDOW)}
        self.g2 = {k: np.full_like(v, 1e-4) for k, v in self.p.items()}
        self.room: list[np.ndarray] | None = None

    def cells(self, flat: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """What is counted: classes after an id, classes two to four places after it, ids after a class."""
        own, wanted, size = flat[places], self.target[flat[places]], IDS * CLASSES
        yield 0, size, flat[places - 1] * CLASSES + wanted
        for back in (2, 3, 4):
            yield size, size, flat[places - back] * CLASSES + wanted
        yield 2 * size, size, self.context[flat[places - 1]] * IDS + own

    def tables(self, counts: np.ndarray) -> AttentionModel:
        """Values and ids within classes, of counts of cells(), which they take the place of.  An id's rare sightings are
        filled up with its class's."""
        near, far, within = counts.astype(np.float32, copy=False).reshape(3, -1)
        near, far, within = near.reshape(IDS, CLASSES), far.reshape(IDS, CLASSES), within.reshape(CLASSES, IDS)
        seen = within.sum(axis=0, dtype=float) + 0.1
        mass = np.bincount(self.target, seen, CLASSES)
        prior = (mass + 1e-3) / (mass + 1e-3).sum()
        for of in (near, far):
            mean = np.stack([np.bincount(self.context, of[:, k], CLASSES) for k in range(CLASSES)], axis=1)
            mean = (mean + BACKOFF * prior) / (mean.sum(axis=1, keepdims=True) + BACKOFF)
            size = of.sum(axis=1, keepdims=True)
            of += (BACKOFF * mean).astype(np.float32)[self.context]
            of /= size + np.float32(BACKOFF)
        alone = BACKOFF * seen / mass[self.target]
        for c in range(CLASSES):
            after = np.bincount(self.target, within[c], CLASSES) + BACKOFF
            within[c] = np.log((within[c] + alone) / after[self.target])
        self.near, self.far, self.within = near, far, within
        return self

    def mix(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (n, WINDOW) and targets (n, STEP): pairs of classes, attention and values by (what a target sees, window),
        and the probability of each target's class.  A target sees the inputs before it alone, in rows of their own (ROWS):
        what follows it is never computed.  Exponents are bounded, so that no weight or sum of weights leaves the range of
        its type.  The first three lie in room that the next call uses again: new pages cost more than the sums in them."""
        weights = np.exp(np.clip(self.p["Q"] @ self.p["K"].T / np.sqrt(DIM), -25, 25)).astype(np.float32)
        bias = np.exp(np.clip(self.p["R"], -25, 25)).astype(np.float32)[DISTANCE, None]
        x = x.T * CLASSES
        c, t = self.context.take(x // CLASSES), self.target.take(y.T)
        n = x.shape[1]
        if self.room is None or self.room[0].shape[1] != n:
            self.room = [np.empty((len(DISTANCE), n), kind) for kind in (np.int64, np.float32, np.float32)]
        pairs, a, v = self.room
        for s, (at, own) in enumerate(ROWS):
            np.add(c[OVERLAP + s] * CLASSES, c[: OVERLAP + s + 1], out=pairs[at : own + 1])
            v[at:own] = self.far.take(x[: OVERLAP + s] + t[s])
            v[own] = self.near.take(x[OVERLAP + s] + t[s])
        weights.take(pairs, out=a, mode="clip")
        a *= bias
        p = np.empty((STEP, n), np.float32)
        for s, (at, own) in enumerate(ROWS):
            # row by row, so that a window's sums are the same whatever stands beside it
            total = a[at].copy()
            for row in range(at + 1, own + 1):
                total += a[row]
            a[at : own + 1] /= total
            each = a[at : own + 1] * v[at : own + 1]
            p[s] = each[0]
            for row in each[1:]:
                p[s] += row
        return pairs, a, v, p.T

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, rate: float) -> None:
        """A gradient step (by Adagrad) on some windows."""
        for k, g in self.gradients(x, y, real).items():
            self.g2[k] += g * g
            self.p[k] = self.p[k] - rate * g / np.sqrt(self.g2[k])

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean of -log P(class): a score's is a (1 - v / P)."""
        pairs, a, v, p = self.mix(x, y)
        share, by_class = np.float32(1) / np.float32(max(1, real.sum())), np.zeros(CLASSES * CLASSES)
        for s, (at, own) in enumerate(ROWS):
            g = v[at : own + 1]
            g /= p[:, s]
            np.subtract(1, g, out=g)
            g *= a[at : own + 1]
            g *= real[:, s] * share
            by_class += np.bincount(pairs[at : own + 1].reshape(-1), g.reshape(-1), CLASSES * CLASSES)
        by_class = by_class.reshape(CLASSES, CLASSES) / np.sqrt(DIM)
        by_place = np.bincount(DISTANCE, v.sum(axis=1), WINDOW)
        return {"Q": by_class @ self.p["K"], "K": by_class.T @ self.p["Q"], "R": by_place}

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        flat, starts, real = laid_out(ids, lengths)
        sums, ten = np.zeros(len(starts)), np.log(10)
        for at in range(0, len(starts), BATCH):
            w = windows_of(flat, starts[at : at + BATCH])
            x, y = w[:, :WINDOW], w[:, OVERLAP + 1 :]
            logs = np.log(self.mix(x, y)[3].T) + self.within.take(self.context.take(x.T[OVERLAP:]) * IDS + y.T)
            for s in range(STEP):
                sums[at : at + BATCH] += np.where(s < real[at : at + BATCH], logs[s], 0)
        sums /= ten
        windows = -(-(lengths + 1) // STEP)
        return np.add.reduceat(sums, np.cumsum(windows) - windows) if len(windows) else np.zeros(0)


class _Classes:
    """What cells() reads of a model."""

    def __init__(self, context: np.ndarray, target: np.ndarray) -> None:
        self.context, self.target = context, target


def train(coded: DataFrame) -> tuple[AttentionModel, Broadcast]:
    """The model of some coded texts: classes, then values, then attention, each from all of them.  Its tables, which no
    longer change, are sent to the executors once; the driver keeps the rest."""
    context = coded.sparkSession.sparkContext
    sides = counted(coded, 2 * IDS * BUCKETS, beside).reshape(2, -1)
    model = AttentionModel(classes(sides[0]), classes(sides[1]))
    known = context.broadcast(_Classes(model.context, model.target))
    model.tables(counted(coded, 3 * IDS * CLASSES, lambda flat, places: AttentionModel.cells(known.value, flat, places)))
    known.destroy()
    shared = context.broadcast(model)
    del model.near, model.far, model.within
    for k, rate in enumerate(RATES):
        learn(coded.filter(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(len(RATES))) == k), model, shared, rate)
    return model, shared


def learn(coded: DataFrame, model: AttentionModel, shared: Broadcast, rate: float) -> None:
    """A round: each partition takes steps over every window of its texts; changes are averaged by windows."""
    names, start, squares = sorted(model.p), model.p, model.g2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, r, seen = copy.copy(shared.value), np.random.default_rng(9), 0
        own.p, own.g2 = dict(start), {k: v.copy() for k, v in squares.items()}
        for part in slices(batches, "ids", 1 << 20, 1 << 20):
            flat, starts, real = laid_out(*id_lists(part.column("ids")))
            order = r.permutation(len(starts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                w = windows_of(flat, starts[pick])
                own.step(w[:, :WINDOW], w[:, OVERLAP + 1 :], np.arange(STEP) < real[pick, None], rate)
            seen += len(starts)
        change = np.concatenate([*((own.p[k] - start[k]).reshape(-1) * seen for k in names), [float(seen)]])
        if seen:
            yield pa.record_batch({"block": pa.array([0], pa.int32()), "who": pa.array([TaskContext.get().partitionId()], pa.int32()), "at": pa.nulls(1, pa.binary()), "x": pa.array([change.tobytes()], pa.binary())})

    for _, x in summed(coded.mapInArrow(run, "block int, who int, at binary, x binary"), coded.rdd.getNumPartitions()):
        at = 0
        for k in names:
            size = model.p[k].size
            model.p[k] = model.p[k] + (x[at : at + size] / x[-1]).reshape(model.p[k].shape)
            at += size


# ---- scores --------------------------------------------------------------------------------------------------------

_CODED = "rid long, key binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, ids binary"


def coded_texts(docs: DataFrame, head: pa.Table, end: int, under: int, tokenizer: str) -> DataFrame:
    """Two kinds of rows, written to the shared folder: a document's, with its subword ids and the base score of its
    words among `head`, and one for each of its other words, with the word's key.  Words of the head come with their ids;
    a slice's other words are coded."""
    keys, known = (pa.concat_arrays(head.column(n).chunks) if len(head) else pa.array([], pa.binary()) for n in ("key", "ids"))
    common = docs.sparkSession.sparkContext.broadcast((keys, np.append(head.column("c").to_numpy(), 0), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (frequent, counts, ready), coder = common.value, word_ids(tokenizer, **CODER)
        # the last place is that of words outside the head
        uncoded = np.append(ready.is_null().to_numpy(zero_copy_only=False), True)
        ready, sizes = id_lists(pc.fill_null(ready, b""), "<u2")
        sizes = np.append(sizes, 0)
        begins = np.cumsum(sizes) - sizes
        logs = np.log10((counts + 1) / under)
        logs[-1] = 0
        for part in slices(batches, most_bytes=2 << 20):
            m = part.num_rows
            words, have = word_lists(part.column("text"))
            different = words.dictionary_encode()
            which = different.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys = _keys(different.dictionary)
            at = pc.fill_null(pc.index_in(keys, value_set=frequent), len(frequent)).to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, np.int64)
            found = at[which]
            owner = np.repeat(np.arange(m), have)
            known, base = np.bincount(owner, found < len(frequent), m).astype(np.int64) + (end > 0), np.bincount(owner, logs[found], m) + np.log10((end + 1) / under)
            others = np.flatnonzero(uncoded[at])
            parts = coder.pieces(values(different.dictionary.take(pa.array(others))))
            own = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            size, begin = sizes[at], begins[at]
            size[others], begin[others] = own, len(ready) + np.cumsum(own) - own
            flat = np.concatenate([ready, np.frombuffer(b"".join(parts), "<u4").astype("<u2")])
            each = size[which]
            ids = flat[np.arange(int(each.sum())) + np.repeat(begin[which] - (np.cumsum(each) - each), each)]
            to = np.cumsum(np.bincount(owner, each, m).astype(np.int64)) * 2
            raw = memoryview(ids.tobytes())
            rid, rare = part.column("rid").to_numpy(), np.flatnonzero(found == len(frequent))
            blank = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([part.column("rid"), blank(m, pa.binary()), part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(have + 1), pa.array(known), pa.array(base), pa.array([bytes(raw[a:b]) for a, b in zip([0, *to.tolist()[:-1]], to.tolist(), strict=True)], pa.binary())], names=_NAMES)
            if len(rare):
                k = len(rare)
                yield pa.RecordBatch.from_arrays([pa.array(rid[owner[rare]]), keys.take(pa.array(which[rare])), blank(k, pa.int64()), blank(k, pa.bool_()), blank(k, pa.int64()), blank(k, pa.int64()), blank(k, pa.float64()), blank(k, pa.binary())], names=_NAMES)
            pa.default_memory_pool().release_unused()

    out = f"{shared_folder(docs.sparkSession)}/coded-{uuid.uuid4()}"
    docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "text").mapInArrow(run, _CODED).write.parquet(out)
    return docs.sparkSession.read.schema(_CODED).parquet(out)


_NAMES = ["rid", "key", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids"]


def score(docs: DataFrame, tokenizer: str | None = None, head: int = HEAD) -> DataFrame:
    """documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row.

    Null and empty texts are one end token.  Without training documents every count is 0 and the model knows no more
    than its start.  Documents whose crc32 leaves 2 of 7 are not learned from; all are scored.  Repeated rows, and rows
    with a null or equal doc_id, are scored each by itself.  The coded texts stay in the shared folder.
    """
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    own = documents(docs, "doc_id", "text")
    counts = checkpoint(word_counts(own.filter(~held_out(F.col("doc_id"), 7, 2))))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = counts.filter(F.col("key") == F.lit(_END_KEY)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    under = n + 1 * (v + 1)
    words = counts.filter(F.col("key") != F.lit(_END_KEY))
    rows = coded_texts(own, with_ids(most_frequent(words, head), tokenizer).toArrow(), end, under, tokenizer)
    texts = rows.filter(F.col("ids").isNotNull())
    model, shared = train(texts.filter("not held_out").select("doc_id", "n_tokens", "ids"))
    weights = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = copy.copy(shared.value)
        own.p = weights
        for part in slices(batches, "ids", 1 << 20, 1 << 20):
            scores = own.score(*id_lists(part.column("ids")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(scores, pa.float64())], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    kept = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    scored = texts.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(run, kept)
    c = F.coalesce("c", F.lit(0))
    rare = rows.filter(F.col("ids").isNull()).select("rid", "key").join(words, "key", "left")
    rare = rare.select("rid", F.when(c > 0, 1).otherwise(0).cast("long").alias("n_known"), F.log10((c + 1) / F.lit(float(under))).alias("base"))
    out = scored.unionByName(rare, allowMissingColumns=True).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.max("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lmscore(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
