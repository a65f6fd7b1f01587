"""Token counts by trie-shared dynamic programming (operator 3).

Pre-tokens are the words between ASCII white space with a word mark before them.  Distinct ones are put into a trie;
the unigram forward score of a prefix is computed once, at its node, however many words share it, and a word's count
is the token count that its last node stores.  Counts go back to the documents in the same task: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, table, texts, tokenizer_path

MARK = "▁"
#: Bounds of what a Python worker remembers: trie nodes and words.
NODES, WORDS = 500_000, 400_000
#: A longer pre-token goes through the same recurrence in a rolling window and is not remembered.
LONG = 512


def unigram(path: str) -> dict[str, float]:
    """Pieces of a public sentencepiece vocabulary with log probabilities.

    Its file ranks pieces and has no frequencies, so the piece of rank r is given Zipf's 1 / (r + 1), normalised.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -log(r + 1) - norm for r, p in enumerate(pieces)}


class TrieCounter:
    """Most probable segmentation's token count; a character without a piece counts as its UTF-8 bytes, each with a
    score below every piece's.  Of equal scores the one with fewer tokens counts."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.endings: dict = {}  # a trie of the pieces from their ends; "" holds a whole piece's score
        for piece, score in vocabulary.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.longest = max(map(len, vocabulary), default=1)
        self.byte = min(vocabulary.values(), default=0.0) - 10
        self.words: dict[bytes, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def _forward(self, text: str, d: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score and count of text[:d]; scores and counts are those of the prefixes before, the nearest last."""
        c = text[d - 1]
        width = len(c.encode("utf-8", "surrogatepass"))
        best, fewest = scores[-1] + width * self.byte, counts[-1] + width
        node = self.endings
        for k in range(1, min(self.longest, d) + 1):
            node = node.get(text[d - k])
            if node is None:
                break
            p = node.get("")
            if p is not None:
                s = scores[-k] + p
                if s > best or (s == best and counts[-k] + 1 < fewest):
                    best, fewest = s, counts[-k] + 1
        return best, fewest

    def _count(self, word: bytes) -> int:
        text = MARK + word.decode("utf-8", "replace")
        if len(text) > LONG:
            scores, counts = [0.0], [0]
            for d in range(1, len(text) + 1):
                s, c = self._forward(text, d, scores, counts)
                scores.append(s)
                counts.append(c)
                if len(scores) > 4 * self.longest:
                    del scores[: -self.longest], counts[: -self.longest]
            return counts[-1]
        if len(self.score) > NODES:
            self._empty()
        child, node, d = self.child, 0, 0
        scores, counts = [0.0], [0]
        for c in text:  # down the shared prefix
            at = child.get((node, c))
            if at is None:
                break
            node, d = at, d + 1
            scores.append(self.score[node])
            counts.append(self.count[node])
        for c in text[d:]:  # new nodes below it
            d += 1
            s, n = self._forward(text, d, scores, counts)
            child[node, c] = node = len(self.score)
            self.score.append(s)
            self.count.append(n)
            scores.append(s)
            counts.append(n)
        return self.count[node]

    def total(self, words: list[bytes]) -> int:
        known = self.words
        for w in {w for w in words if w not in known}:
            known[w] = self._count(w)
        out = sum(map(known.__getitem__, words))
        if len(known) > WORDS or any(len(w) > LONG for w in words):
            known.clear()
        return out


_counters: dict[str, TrieCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_pretokens, n_tokens) of every whole text; null and empty texts count 0.
    One output row for each row, repeated ones too; none for an empty table."""
    path = vocabulary or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TrieCounter(unigram(path))
        counter = _counters[path]
        for part in slices(batches):
            rows = [(len(x), len(words := x.split()), counter.total(words)) for x in texts(part.column("text"))]
            more = {k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("n_bytes", "n_pretokens", "n_tokens"))}
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64())} | more)

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_pretokens long, n_tokens long")


def corpus_tokens(counts: DataFrame) -> DataFrame:
    """The whole corpus's totals, one row."""
    return counts.agg(F.count(F.lit(1)).alias("docs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_bytes", "n_pretokens", "n_tokens")))


def op3_tokencount(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
