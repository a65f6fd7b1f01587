"""Packing: the plan against its invariants, the pieces against the tokenizer on whole texts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyrack.llm.common import tokenizer_path
from tallyrack.llm.packing import pack_documents, plan


def spread(histogram, rows):
    """sequence -> [(offset, length)]"""
    seen, out = {n: 0 for n in histogram}, {}
    for n, a, b, first, offset in rows.tolist():
        assert a == seen[n] and b > a
        seen[n] = b
        for k in range(b - a):
            out.setdefault(first + k, []).append((offset, n))
    assert seen == histogram
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_gapless(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 64, 4096])
    histogram = {n: r.choice([1, 2, 3, r.randint(1, 500)]) for n in r.sample(range(1, capacity + 1), min(capacity, r.randint(1, 300)))}
    filled = spread(histogram, plan(histogram, capacity))
    for items in filled.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    words = sum(n * c for n, c in histogram.items())
    large = sum(c for n, c in histogram.items() if 2 * n > capacity)
    assert len(filled) <= max(-(-words // capacity), large) * 1.25 + 2


def test_plan_of_nothing():
    assert plan({}).shape == (0, 5)


TEXTS = ["", None, " \t\n ", "Hello, it's 2024!  Ünïcode é", "<|endoftext|> x", "a b c\x85d ́e", "é \x1c\x00 'S", "lone ﬁ ẛ̣ İI ΣΑΣ", "x" * 9000, "tie", "tie"]


def test_documents(spark):
    r = random.Random(3)
    texts = [*TEXTS, *(" ".join("".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(r.choice([3, 200, 3000]))) for _ in range(40))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, "again", "x"), (1, "again", "x"), (None, "no id", "x")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), ids=True).collect()
    coder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    coder.encode_special_tokens = True
    want = sorted((-1 if i is None else i, *x) for i, t, _ in rows for ids in [coder.encode(t or "", add_special_tokens=False).ids + [1]] for x in [(k, at, len(ids[at : at + 4096]), np.array(ids[at : at + 4096], "<u4").tobytes()) for k, at in enumerate(range(0, len(ids), 4096))])
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.piece, g.start, g.length, bytes(g.ids)) for g in got) == want
    assert all(zlib.crc32(g.ids) == g.ids_crc32 for g in got)
    filled = {}
    for g in got:
        filled.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for items in filled.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= 4096


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_clashing_columns_and_repeated_rows(spark):
    """Columns of any name stay; rows that repeat more often than a group is large are placed one by one."""
    from tallyrack.llm import packing

    names = ["salt", "own", "first", "rank", "ways", "place", "n", "Offset", "count"]
    rows = [(None, 0, 0, 5, 1, *range(8), "c")] * 900 + [(i, 0, 0, 4096 - i % 50, 1, *range(8), "c") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long, " + ", ".join(f"{c} int" for c in names[:-1]) + ", count string").repartition(4)
    got = packing.pack(frame).collect()
    assert len(got) == 960 and all((g.salt, g.own, g.first, g.rank, g.ways, g.place, g.n, g["count"]) == (0, 1, 2, 3, 4, 5, 6, "c") for g in got)
    filled = {}
    for g in got:
        filled.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for items in filled.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= 4096
    bare = packing.pack(frame.select("length").limit(3))
    assert bare.columns == ["length", "sequence_id", "offset"] and bare.count() == 3
