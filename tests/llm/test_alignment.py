"""Alignment against plain loops over whole texts' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyrack.llm import alignment
from tallyrack.llm.alignment import align, stab
from tallyrack.llm.common import tokenizer_path


def plain(rows):
    """Whole texts by the named files, every pair of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    one = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = {c: b for b, c in enumerate(alignment._byte_letters())}
    assert ByteLevel().decode(["".join(alignment._byte_letters()[b] for b in "é 東".encode())]) == "é 東"
    coded, total = [], Counter()
    for doc, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        ab = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            a, b, ab, bb = [], [], [], []
        ends = lambda x: np.cumsum([len(t) for t in x]).tolist()
        ea, eb = ends(ab), ends(bb)
        found = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(ab[i]), eb[j] - len(bb[j])) < min(ea[i], eb[j])] if len(a) < 400 else list(walk(ea, eb))
        total.update((a[i], b[j]) for i, j in found)
        coded.append((doc, a, b, ea, eb, found))
    most = {}
    for (_, y), n in total.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for doc, a, b, ea, eb, found in coded:
        cuts = sorted(set(ea) & set(eb))
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(x) for x, e in zip(a, ea, strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, eb, strict=True) if lo < e <= hi)) if len(a) < 400 else None
        counts = [total[a[i], b[j]] for i, j in found]
        sha = (hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) < 400 else None) if a else ""
        out.append((doc, len(a), len(b), len(cuts), len(found), sum(n == most[b[j]] for n, (_, j) in zip(counts, found, strict=True)), sum(counts), sha))
    return out


def walk(ea, eb):
    i = j = 0
    while i < len(ea) and j < len(eb):
        yield i, j
        x, y = ea[i], eb[j]
        i, j = i + (x <= y), j + (y <= x)


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[6])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:7] == w[:7] and (w[7] is None or g[7] == w[7]), (g, w)


def odd_rows():
    r = random.Random(3)
    alphabet = ["a", "the", "Étion", " ", "  ", "\n", "'s", "don't", "1234", "東京", "<|endoftext|>", "<s>", "▁", " ", "\t", "🙂", "é", "́", "x" * 50, "\x1c", "​"]
    rows = [(i, "".join(r.choices(alphabet, k=r.randint(1, 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, " \n "), (None, "no id here"), (204, "again and again"), (204, "again and again"), (205, "﻿mark \u0000 nul"), (206, "ﬁ ligature ½ ①")]
    return [*rows, (207, "one two three " * 4000), (208, "y" * 3000)]


def test_odd_texts(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, pair string, batch int").repartition(3)
    same(align(frame).collect(), plain(rows))


@pytest.mark.parametrize("chunk", [7, 200])
def test_chunks_of_a_batch(monkeypatch, chunk):
    """Long batches are stabbed a chunk at a time, long texts coded a block at a time; results don't depend on either."""
    rows = [x for x in odd_rows() if x[0] not in (207, 208)] + [(207, "one two three, " * 25)]
    known = alignment.Coder(*(tokenizer_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
    results = []
    for size in (chunk, 1 << 20):
        monkeypatch.setattr(alignment, "CHUNK", size)
        monkeypatch.setattr(alignment, "_BLOCK", size)
        coded = [known.encode(t) if t else (b"", b"") for _, t in rows]
        a, b = (np.frombuffer(b"".join(x), np.uint16) for x in zip(*coded, strict=True))
        na, nb = (np.array([len(x) // 2 for x in y]) for y in zip(*coded, strict=True))
        pairs = [x for *_, p in alignment.links(a, b, known.a_len, known.b_len) for x in p.tolist()]
        pair, count = np.unique(pairs, return_counts=True)
        results.append(alignment._results([d for d, _ in rows], na, nb, a, b, pair, count, count % 2, known).to_pylist())
    assert results[0] == results[1] and sum(r["n_links"] for r in results[0]) == len(pairs)


def test_whole_table(spark):
    from tallyrack.llm.queries import queries

    path = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    same(queries()["op11_alignment"](spark, path).collect(), plain([(x["doc_id"], x["text"]) for x in rows]))


def test_stabbing():
    first, last, group = stab(np.array([3, 4, 9, 10]), np.array([1, 4, 6, 7, 10]))
    assert first.tolist() == [0, 1, 2, 4] and last.tolist() == [1, 1, 4, 4] and group.tolist() == [0, 0, 1, 1, 1]


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
