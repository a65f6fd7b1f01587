"""Language identification by a byte convolutional network (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import documents, held_out, release, slices, table, texts, uniform, without
from .convnet import ByteConvNet, learn

#: The network starts from at most this many labelled documents, shared among the languages, least by hash, and this
#: many windows of each; a language has LEAST_DOCS at least, and LANGUAGES of them are learned, the most frequent.
SAMPLE_DOCS, SAMPLE_WINDOWS, LENGTH = 3000, 3, 128
LEAST_DOCS, LANGUAGES = 50, 256
#: Rates of the rounds over all labelled documents.  A step's windows of rare languages weigh up to RARE times as much.
RATES, RARE = (0.001,), 10.0
UNDETERMINED = "und"


class LanguageModel:
    def __init__(self, languages: list[str], net: ByteConvNet) -> None:
        self.languages, self.net, self.tables = languages, net, net.tables()
        #: Windows of the corpus that it has learned from, after those that it started from.
        self.learned = 0

    def predict(self, items: list[bytes]) -> list[tuple[str, float]]:
        """Every whole text in fixed-length windows, the last one padded with zeros and followed by an empty one, so that
        no filter reads the next text; a text's probabilities are its windows' means, weighed by their bytes."""
        step, ahead = self.net.length, self.net.ahead
        counts = np.array([-(-len(x) // step) for x in items], np.int64)
        data = np.frombuffer(b"".join(x + b"\0" * (-len(x) % step + step) for x in items) + b"\0" * ahead, np.uint8)
        own = np.ones(int(counts.sum()) + len(items), bool)
        own[np.cumsum(counts + 1) - 1] = False
        found = self.net.predict(data, len(own), self.tables)[own]
        weight = np.full(len(found), float(step))
        ends = np.cumsum(counts)
        some = counts > 0
        weight[ends[some] - 1] = [len(x) - (c - 1) * step for x, c in zip(items, counts.tolist(), strict=True) if c]
        total = np.zeros((len(items), len(self.languages)))
        if some.any():
            total[some] = np.add.reduceat(found * weight[:, None], (ends - counts)[some], axis=0)
        out = []
        for x, row in zip(items, total, strict=True):
            if not has_letter(x) or not self.languages:
                out.append((UNDETERMINED, 0.0))
            else:
                best = int(row.argmax())
                out.append((self.languages[best], min(1.0, float(row[best] / row.sum()))))
        return out


def has_letter(text: bytes) -> bool:
    if not text.isascii():
        return any(map(str.isalpha, text.decode("utf-8", "replace")))
    return text.upper() != text.lower()


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))


def all_windows(docs: DataFrame, languages: list[str], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes (label, weight, window) of (lang, text) rows of labelled documents: whole windows of a whole text, those
    of the languages that are known.  A document's windows weigh one together, and more where its language is rare."""
    counts = {r.lang: r["count"] for r in _labelled(docs).groupBy("lang").count().filter(F.col("lang").isin(languages)).collect()}
    usual = sum(counts.values()) / max(1, len(counts))
    label = {x: k for k, x in enumerate(languages)}
    weight = [min(RARE, usual / counts[x]) if x in counts else 1.0 for x in languages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most_bytes=1 << 19):
            labels, weights, rows = [], [], []
            for lang, text in zip(part.column("lang").to_pylist(), texts(part.column("text")), strict=True):
                own = [w for w in (text[at : at + LENGTH] for at in range(0, len(text), LENGTH)) if has_letter(w)] if lang in label else []
                labels += [label[lang]] * len(own) if own else []
                weights += [weight[label[lang]] / len(own)] * len(own) if own else []
                rows += [w.ljust(size, b"\0") for w in own]
            yield pa.record_batch({"label": pa.array(labels, pa.int32()), "weight": pa.array(weights, pa.float64()), "window": pa.array(rows, pa.binary())})

    return run


def training_windows(docs: DataFrame) -> list:
    """(lang, pieces) that the network starts from: texts cut at repeatable places anywhere in the whole text, of a bounded sample: as many documents
    of each language, so that a rare one is learned too; of very many languages, the most frequent."""
    spread = F.greatest(F.length("text") - LENGTH, F.lit(0)) + 1
    places = [F.pmod(F.xxhash64("doc_id", F.lit(k)), spread).cast("int") + 1 for k in range(SAMPLE_WINDOWS)]
    labelled = _labelled(docs)
    known = labelled.filter(F.col("text").isNotNull() & (F.trim("text") != ""))
    pieces = known.select("lang", "doc_id", F.array(*(F.substring(F.col("text"), p, F.lit(LENGTH)) for p in places)).alias("pieces"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    most = max(LEAST_DOCS, SAMPLE_DOCS // len(counts))
    shares = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, (1.5 * most + 50) / r["count"])) for r in counts], "own string, share double")
    thin = pieces.join(F.broadcast(shares), F.col("lang") == F.col("own")).filter(uniform(F.col("doc_id"), -7) < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "pieces"))
    return thin.select("lang", "doc_id", "pieces", nth.alias("k")).filter(F.col("k") <= most).orderBy("lang", "k").collect()


def train(docs: DataFrame) -> LanguageModel:
    """Learns from text and lang of the documents that aren't held out; without any, it knows no language.  The network
    starts from a few windows of some; then partitions take steps over every window of all of them and are averaged."""
    docs = documents(docs, "doc_id", "text", "lang")
    rows = training_windows(docs)
    languages = sorted({r.lang for r in rows})
    net = ByteConvNet(max(1, len(languages)), LENGTH)
    pairs = [(languages.index(r.lang), p.encode()) for r in rows for p in r.pieces if has_letter(p.encode())]
    if len(languages) > 1 and pairs:
        size = LENGTH + net.ahead
        windows = np.zeros((len(pairs), size), np.uint8)
        for i, (_, piece) in enumerate(pairs):
            windows[i, : min(len(piece), size)] = np.frombuffer(piece[:size], np.uint8)
        # the same windows cut short, as the ends of texts are
        short = windows[::4].copy()
        for i, n in enumerate(np.random.default_rng(3).integers(6, 64, len(short)).tolist()):
            short[i, n:] = 0
        labels = np.array([k for k, _ in pairs])
        net.fit(np.concatenate([windows, short]), np.concatenate([labels, labels[::4]]))
        learned = learn(_labelled(docs).select("lang", "text"), net, RATES, cut=all_windows(docs, languages, size))
        model = LanguageModel(languages, net)
        model.learned = learned
        return model
    return LanguageModel(languages, net)


def identify(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds lang_pred and score (or as they are to be called) to documents, whatever their other columns; columns of
    these names are replaced.  `und` with score 0 where the text is null or has no letter.  Very long texts are read
    whole, repeated rows stay, an empty table gives none."""
    docs = without(docs, lang, score)
    schema = StructType(list(docs.schema)).add(lang, StringType()).add(score, DoubleType())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            found = model.predict(list(texts(part.column("text"))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, lang, score])

    return docs.mapInArrow(run, schema)


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(documents(docs, "doc_id", "text"), train(docs)).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
