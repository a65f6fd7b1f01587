"""Cross-tokenizer alignment by a static interval index (operator 11).

Two tokenizers cut the same bytes.  B's tokens of a text are a static index of sorted intervals; each token of A stabs it
by bisection and gets the run of B tokens that it overlaps.  A gap between two B tokens that no A token spans is a
boundary of both: there the text falls into groups.  Documents follow each other in one byte range, so that whole
batches are stabbed at once; no token crosses a document.

Texts are coded once.  The ids are kept, packed by batch, in the shared folder; pairs of ids are counted by batch,
summed over the corpus, and each batch reads the counts of its own pairs again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents, table, texts, tokenizer_path

#: Bytes of text that share a row of packed ids, and tokens of A that are stabbed at a time.
BATCH, CHUNK = 4 << 20, 1 << 20
#: Words a coder remembers, and their bytes.
WORDS, WORD_BYTES = 400_000, 48 << 20
#: A pair of ids is a << SHIFT | b.
SHIFT = 20
#: A text is cut before a space between two other characters: neither tokenizer joins anything across it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLOCK = 1 << 20
_LATIN = re.compile(r"[\x00-ɏ]*").fullmatch


class Coder:
    """Ids of words by both tokenizers, remembered by word, with A's tokens of space + word and B's of the word."""

    def __init__(self, a_json: str, a_ranks: str | None, b_model: str) -> None:
        import base64

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.fast = None
        if a_ranks:  # the same vocabulary, quicker; for letters whose classes no version of Unicode has changed
            with open(a_ranks, "rb") as f:
                ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("a piece that goes on after a space would join words")
        code = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes = [bytes(map(code.__getitem__, self.a.id_to_token(i))) if not self._special(i) else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()
        self.held = 0

    def _special(self, i: int) -> bool:
        return any(c not in _BYTE_LETTERS for c in self.a.id_to_token(i))

    def _learn(self, words: list[str]) -> None:
        """Words without white space at their ends share a string, as they could in a text; where tokens end with a
        word, by their lengths, is where ids are cut."""
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        quick = [w for w in plain if self.fast is not None and _LATIN(w)]
        rest = [w for w in plain if self.fast is None or not _LATIN(w)]
        alone = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
        for group, fast in ((quick, True), (rest, False)):
            for i in range(0, len(group), 1 << 14):
                part = group[i : i + (1 << 14)]
                if not self._shared(part, fast):
                    alone += part
        for w, a, b in zip(alone, self.a.encode_batch_fast([" " + w for w in alone], add_special_tokens=False), self.b.encode(alone, num_threads=1), strict=True):
            self._keep(w, np.array(a.ids, np.uint16).tobytes(), np.array(b, np.uint16).tobytes())
            raw = b" " + w.encode("utf-8", "surrogatepass")
            if b"".join(map(self.a_bytes.__getitem__, a.ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                self.odd.add(w)

    def _keep(self, w: str, a: bytes, b: bytes) -> None:
        self.known[w] = a, b
        self.held += 4 * len(w) + len(a) + len(b)

    def _shared(self, words: list[str], fast: bool) -> bool:
        """Whether the words, coded in one string, give its bytes, with a token's end at each word's end."""
        text = " ".join(words)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        a = self.fast.encode_ordinary(" " + text) if fast else self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
        cuts = []
        for ids, sizes, letters in ((a, self.a_len, self.a_bytes), (b, self.b_len, self.b_bytes)):
            if b"".join(map(letters.__getitem__, ids)) != raw:
                return False
            stops = np.cumsum(sizes[np.array(ids, np.uint16)])
            at = np.searchsorted(stops, ends)
            if (stops[at] != ends).any():
                return False
            cuts.append((np.array(ids, np.uint16).tobytes(), (2 * (at + 1)).tolist()))
        (one, one_to), (two, two_to) = cuts
        for w, i, j, k, m in zip(words, [0, *one_to], one_to, [0, *two_to], two_to, strict=False):
            self._keep(w, one[i:j], two[k:m])
        return True

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Both lists of ids, 16 bits each; none where the tokens' bytes aren't those of space + text."""
        own, at, odd = [], 0, False
        while at < len(text):
            cut = _CUT.search(text, at + _BLOCK)
            to = cut.start() if cut else len(text)
            words = _CUT.split(text[at:to])
            at = to + 1
            if len(self.known) > WORDS or self.held > WORD_BYTES:
                self.known.clear()
                self.odd.clear()
                self.held = 0
            if new := list(set(words).difference(self.known)):
                self._learn(new)
            odd = odd or not self.odd.isdisjoint(words)
            found = list(map(self.known.__getitem__, words))
            own.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        a, b = b"".join([x[0] for x in own]), b"".join([x[1] for x in own])
        if odd:
            raw = b" " + text.encode("utf-8", "surrogatepass")
            if any(b"".join(map(t.__getitem__, np.frombuffer(ids, np.uint16).tolist())) != raw for t, ids in ((self.a_bytes, a), (self.b_bytes, b))):
                return b"", b""
        return a, b


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE_LETTERS = frozenset(_byte_letters())
_coders: dict[tuple, Coder] = {}


def coder(paths: tuple) -> Coder:
    """One for each Python worker."""
    if paths not in _coders:
        _coders.clear()
        _coders[paths] = Coder(*paths)
    return _coders[paths]


def stab(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of tokens that cover the same bytes -> for each A token the first and last B token it overlaps, and for each
    B token the number of its group."""
    a_start = np.concatenate([[0], a_end[:-1]])
    first = np.searchsorted(b_end, a_start, "right")
    last = np.searchsorted(b_end, a_end, "left")
    spans = np.bincount(first, minlength=len(b_end)) - np.bincount(last, minlength=len(b_end))
    whole = np.cumsum(spans) == 0  # no A token goes on over the gap after this B token
    return first, last, np.cumsum(whole) - whole


def links(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> Iterator[tuple]:
    """Chunks of (slice of A, slice of B, first, last, groups, pair of each link), cut where tokens of both end."""
    a_end, b_end = np.cumsum(a_len[a]), np.cumsum(b_len[b])
    i = j = 0
    while i < len(a):
        to = min(i + CHUNK, len(a))
        while True:
            k = int(np.searchsorted(b_end, a_end[to - 1]))
            if b_end[k] == a_end[to - 1]:
                break
            to += 1
        base = a_end[i - 1] if i else 0
        first, last, group = stab(a_end[i:to] - base, b_end[j : k + 1] - base)
        n = last - first + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        yield slice(i, to), slice(j, k + 1), n, first, group, np.repeat(a[i:to].astype(np.int64) << SHIFT, n) | b[j : k + 1][at]
        i, j = to, k + 1


def _pack(ids: list, na: list, nb: list, a: list, b: list, known: Coder) -> pa.RecordBatch:
    one, two = b"".join(a), b"".join(b)
    pairs, counts = [], []
    for *_, found in links(np.frombuffer(one, np.uint16), np.frombuffer(two, np.uint16), known.a_len, known.b_len):
        p, c = np.unique(found, return_counts=True)
        pairs.append(p)
        counts.append(c)
    p, at = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.zeros(0, np.int64), None)
    c = np.bincount(at, np.concatenate(counts)).astype(np.int64) if pairs else p
    squeeze = pa.Codec("zstd", 3).compress
    lists = lambda x, t=pa.int64(): pa.array([x], pa.list_(t))
    return pa.record_batch({"ids": lists(ids), "na": lists(na), "nb": lists(nb), "a": pa.array([squeeze(one, asbytes=True)], pa.binary()), "b": pa.array([squeeze(two, asbytes=True)], pa.binary()), "pairs": lists(p), "counts": lists(c)})


_PACKED = "ids array<long>, na array<long>, nb array<long>, a binary, b binary, pairs array<long>, counts array<long>"


def packed(docs: DataFrame, paths: tuple) -> DataFrame:
    """documents -> their ids, packed by about BATCH bytes of text, with the pairs of linked ids and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(paths)
        rows: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), texts(batch.column("text")), strict=True):
                a, b = known.encode(raw.decode("utf-8", "replace")) if raw else (b"", b"")
                for into, x in zip(rows, (doc, len(a) // 2, len(b) // 2, a, b), strict=True):
                    into.append(x)
                held += len(raw) + 64
                if held > BATCH:
                    yield _pack(*rows, known)
                    rows, held = ([], [], [], [], []), 0
        if rows[0]:
            yield _pack(*rows, known)

    return documents(docs, "doc_id", "text").mapInArrow(run, _PACKED)


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, n) rows -> (pair, count, best): how many links the corpus has of each pair, and whether no other pair of
    the same B id has more."""
    total = checkpoint(batches.groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = total.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return total.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _digits(n: int, after: bytes) -> list[bytes]:
    return [b"%d" % i + after for i in range(n)]


def _results(ids: list, na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray, known: Coder) -> pa.RecordBatch:
    n_docs = len(ids)
    words = _digits(len(known.a_len), b",") + _digits(len(known.a_len), b"|") + _digits(len(known.b_len), b",") + _digits(len(known.b_len), b";")
    steps = np.cumsum([0, len(known.a_len), len(known.a_len), len(known.b_len)])
    a_stop, b_stop = np.cumsum(na), np.cumsum(nb)
    sums = np.zeros((4, n_docs), np.int64)
    shas: list = [None] * n_docs
    for at, to, n, first, group, pair in links(a, b, known.a_len, known.b_len):
        a_group = group[first]
        ends = lambda g: np.append(g[1:] != g[:-1], True)  # noqa: E731  whether a token is its group's last
        # A group's A tokens, then its B tokens: places in the written order.
        n_a, n_b = len(a_group), len(group)
        in_a, in_b = np.bincount(a_group), np.bincount(group)
        a_place = np.arange(n_a) + (np.cumsum(in_b) - in_b)[a_group]
        b_place = np.arange(n_b) + np.cumsum(in_a)[group]
        code = np.empty(n_a + n_b, np.int64)
        code[a_place] = a[at] + steps[ends(a_group).astype(int)]
        code[b_place] = b[to] + steps[2 + ends(group).astype(int)]
        held = np.searchsorted(pairs, pair)
        totals = [np.concatenate([[0], np.cumsum(x)]) for x in (best[held], counts[held])]
        upto = np.concatenate([[0], np.cumsum(n)])
        d0, d1 = int(np.searchsorted(a_stop, at.start, "right")), int(np.searchsorted(a_stop, at.stop, "left")) + 1
        lo = np.clip(a_stop[d0:d1] - na[d0:d1], at.start, at.stop) - at.start
        hi = np.clip(a_stop[d0:d1], at.start, at.stop) - at.start
        b_lo = np.clip(b_stop[d0:d1] - nb[d0:d1], to.start, to.stop) - to.start
        b_hi = np.clip(b_stop[d0:d1], to.start, to.stop) - to.start
        closed = np.concatenate([[0], np.cumsum(ends(group))])
        sums[0, d0:d1] += closed[b_hi] - closed[b_lo]
        sums[1, d0:d1] += upto[hi] - upto[lo]
        for k, total in enumerate(totals):
            sums[2 + k, d0:d1] += total[upto[hi]] - total[upto[lo]]
        for d, x, y in zip(range(d0, d1), (lo + b_lo).tolist(), (hi + b_hi).tolist(), strict=True):
            if x < y:
                if shas[d] is None:
                    shas[d] = hashlib.sha256()
                else:
                    shas[d].update(b";")
                shas[d].update(b"".join(map(words.__getitem__, code[x:y].tolist()))[:-1])
    out = dict(zip(("n_groups", "n_links", "n_best", "count_sum"), sums, strict=True))
    return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_a": pa.array(na, pa.int64()), "n_b": pa.array(nb, pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in out.items()} | {"groups_sha256": pa.array([s.hexdigest() if s else "" for s in shas], pa.string())})


def align(docs: DataFrame, a_json: str | None = None, a_ranks: str | None = None, b_model: str | None = None) -> DataFrame:
    """documents -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row.

    Null and empty texts, and those whose tokens don't give their bytes again, have no tokens.  Repeated rows each count.
    Very long texts are coded a block and stabbed a chunk at a time; a block ends at the first single space after
    _BLOCK characters, so a text without one is coded whole.  An empty table gives an empty result.
    """
    if a_json is None and a_ranks is None:
        a_ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    paths = (a_json or tokenizer_path("byte_bpe_50k.json"), a_ranks, b_model or tokenizer_path("piece_bpe_32k.model"))
    batches = checkpoint(packed(docs, paths).withColumn("batch", F.monotonically_increasing_id()))
    own = batches.select("batch", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("batch", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = own.select(F.col("batch").alias("into"), "pair").join(pair_counts(own), "pair")
    unpack = lambda x, n: np.frombuffer(pa.Codec("zstd").decompress(x, int(n) * 2, asbytes=True), np.uint16)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = coder(paths)
        pair, count, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        out = []
        for row in left.to_pylist():
            na, nb = np.array(row["na"], np.int64), np.array(row["nb"], np.int64)
            out.append(_results(row["ids"], na, nb, unpack(row["a"], na.sum()), unpack(row["b"], nb.sum()), pair[order], count[order], best[order].astype(np.int64), known))
        return pa.Table.from_batches(out)

    return batches.select("batch", "ids", "na", "nb", "a", "b").groupBy("batch").cogroup(counts.groupBy("into")).applyInArrow(run, _ROW)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
