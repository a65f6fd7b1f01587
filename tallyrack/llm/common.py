"""Shared helpers: input tables, checkpoints, word splitting and the word-cached tokenizer."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts write it: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return df.select(*(df[f"`{c}`"] for c in columns))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of the table needs to be called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table but for columns of these names, in any case of letters."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def row_digest(df: DataFrame) -> Column:
    """16 bytes that tell rows apart by all their columns; only rows that repeat wholly share them."""
    values = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "text")), {"ignoreNullFields": "false"})
    return F.unhex(F.md5(F.concat_ws("\n", values, F.when(F.col("text").isNull(), "0").otherwise(F.concat(F.lit("1"), "text")))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a local master may fall back on one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage, so that a lost executor costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def uniform(*parts: Column | int) -> Column:
    """A repeatable number in [0, 1) from a 64-bit hash of the parts."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, population: int, most: int, *key: str) -> list:
    """At most `most` rows, the least by a hash of the key.  Rows are first thinned by that hash to about half as many
    again, so that all partitions together, however many, send the driver no more than that.  `population` is the
    number of rows, or somewhat more; where it is much more, the sample is smaller."""
    least = F.xxhash64(*key, F.lit("sample"))
    thin = uniform(*map(F.col, key), -7) < min(1.0, (1.5 * most + 50) / max(1, population))
    return df.filter(thin).orderBy(least, *df.columns).limit(most).collect()


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about most_bytes of text at most (one longer text may stand alone)."""
    for batch in batches:
        at, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > at and (held + n > most_bytes or i - at >= most_rows):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII marks but the apostrophe, which the tokenizer may join to letters after it.
_TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
_MARKS = frozenset(_TAIL)
_MARK, _JOIN = b"\x01", b" \x01 "
#: a-z and the small letters of Latin-1.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def lower(text: bytes) -> bytes:
    """A-Z in lower case."""
    return text.translate(_LOWER)


def word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, A-Z in lower case, one after another, and how many each text has; null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(words), 0)
    if not pc.all(there, min_count=0).as_py():
        words, owner = words.filter(there), owner.filter(there)
    return words.cast(pa.binary()), np.bincount(owner.to_numpy(), minlength=len(column)).astype(np.int64)


def values(column: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls, cut from its buffer at once."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    if not len(column):
        return []
    cuts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw, cuts = memoryview(data)[cuts[0] : cuts[-1]].tobytes() if data else b"", (cuts - cuts[0]).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class WordIds:
    """Ids of the public word-BPE tokenizer as unsigned 32-bit bytes (of a little-endian machine), remembered by word.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    ASCII-white-space words one after another (tests compare with the tokenizer on whole texts).  The memory is emptied
    after a call that leaves it with more than `most` words or `most_bytes` of keys and ids.
    """

    def __init__(self, path: str, most: int = 500_000, most_bytes: int = 48 << 20) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.most, self.most_bytes, self.held, self.known = most, most_bytes, 0, {}
        self.mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids[0]
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.no_truncation()
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.final = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """Words to code, in lower case, as the tokenizer has them anyway."""
        return text.translate(_LOWER).split()

    def _shared(self, words: list[bytes], tokenizer, join: bytes) -> list[np.ndarray]:
        """Ids of up to 256 words at a time that share a string."""
        strings = [join.join(words[i : i + 256]).decode("utf-8", "replace") for i in range(0, len(words), 256)]
        # a few at a time: an encoding holds far more than its ids
        coded = (tokenizer.encode_batch_fast(strings[i : i + 32], add_special_tokens=False) for i in range(0, len(strings), 32))
        return [np.array(c.ids, np.uint32) for some in coded for c in some]

    def _code(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word.  Words of small Latin letters alone need no normalising and are one piece for the model:
        their last ids end a word.  Others share strings with a mark between them that is never joined to a word."""
        out: dict[bytes, bytes] = {}
        plain, rest, alone = [], [], []
        for w in words:
            (plain if _PLAIN(w) else alone if _MARK in w else rest).append(w)
        for w, c in zip(alone, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False), strict=True):
            out[w] = array("I", c.ids).tobytes()
        for own, shared, ends in ((plain, self._shared(plain, self.bare, b" "), True), (rest, self._shared(rest, self.tokenizer, _JOIN), False)):
            for i, ids in enumerate(shared):
                raw, at, group = ids.tobytes(), 0, own[i * 256 : i * 256 + 256]
                stops = np.flatnonzero(self.final[ids] if ends else ids == self.mark)
                to = ((stops + 1) * 4).tolist() if ends else [*(stops * 4).tolist(), len(raw)]
                for w, stop in zip(group, to, strict=True):
                    out[w] = raw[at:stop]
                    at = stop + 4 * (not ends)
        return [out[w] for w in words]

    def _learn(self, words: Iterable[bytes]) -> None:
        """Final marks after a small Latin letter or ASCII digit are coded apart, as the tokenizer splits them there,
        so that their words are often known."""
        known = self.known
        whole, cut = set(), {}
        for w in words:
            if w[-1] in _MARKS and (stem := w.rstrip(_TAIL)) and (97 <= stem[-1] <= 122 or 48 <= stem[-1] <= 57 or _PLAIN(stem[-2:])):
                tail = w[len(stem) :]
                cut[w] = stem, tail
                if stem not in known:
                    whole.add(stem)
                if tail not in known:
                    whole.add(tail)
            else:
                whole.add(w)
        new = list(whole)
        fresh = dict(zip(new, self._code(new), strict=True))
        known.update(fresh)
        fresh |= {w: known[stem] + known[tail] for w, (stem, tail) in cut.items()}
        known.update(fresh)
        self.held += sum(map(len, fresh)) + sum(map(len, fresh.values()))

    def _bound(self) -> None:
        if len(self.known) > self.most or self.held > self.most_bytes:
            self.known.clear()
            self.held = 0

    def encode(self, lists: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words; words that aren't known yet are coded in one call."""
        self._learn(set(chain.from_iterable(lists)).difference(self.known))
        out = [b"".join(map(self.known.__getitem__, words)) for words in lists]
        self._bound()
        return out

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        known = self.known
        if new := [w for w in words if w not in known]:
            self._learn(new)
        out = list(map(known.__getitem__, words))
        self._bound()
        return out


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str, **bounds: int) -> WordIds:
    """One coder for each Python worker, which serves the tasks that follow as well."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path, **bounds)
    return _word_ids[path]


def release() -> None:
    """Gives back what the worker holds of earlier tasks: coders, and memory that Arrow keeps for the next batch."""
    _word_ids.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives back memory that Arrow and the C library keep for the next batch; elsewhere than under glibc, Arrow's alone."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
