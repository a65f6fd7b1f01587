"""The prefix trie against a plain one, and against recursive SQL."""

import hashlib
import random
import zlib

import pytest

from tallyrack.llm import prefixtrie
from tallyrack.llm.prefixtrie import opened, prefix_trie


def brute(rows):
    """A node a prefix, subtrees by comparing all prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    kids = {}
    for t in nodes:
        if t:
            kids.setdefault(t[:-1], []).append(t)
    leaves, saved = {}, {}
    for t in sorted(nodes, key=len, reverse=True):
        leaves[t] = sum(leaves[k] for k in kids.get(t, [])) or 1
        saved[t] = sum(saved[k] for k in kids.get(t, [])) + (len(nodes[t]) - 1) * (len(t[-1][1]) if t else 0)
    ends = lambda t: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[t] if built[c] == t))).encode()).hexdigest()
    return sorted((min(m), len(t), min(nodes[t[:-1]]) if t else None, len(m), len(kids.get(t, [])), leaves[t], saved[t], ends(t)) for t, m in nodes.items())


def trie(spark, rows, parts=5):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, n string").repartition(parts)
    return sorted((tuple(r) for r in prefix_trie(*opened(frame)).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("segment", [2, 256])
def test_random_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(prefixtrie, "SEGMENT", segment)
    r = random.Random(segment)
    rows = []
    for c in [*range(90, 130), *range(200, 240), 305, -7, -100]:
        for i in range(r.choice([1, 2, 3, 5, 8])):
            rows.append((c, r.choice([i, i, i, None]), r.choice(["user", "user", None, ""]), r.choice(["a", "a", "b", None, "é€" * 3])))
    rows += [(400, i, "u", "same") for i in range(40)] + [(c, i, "u", "same") for c in range(401, 440) for i in range(c % 7 * 6 + 1)]
    rows += [(305, 1, "user", "a")] * 3 + [(None, 0, "u", "lost"), (500, None, None, None), (501, 3, "u", "long " * 50_000)]
    assert trie(spark, rows) == brute(rows)


def test_turnless_and_alone(spark):
    """No base and few turns of its own leave a conversation without any."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    for rows in ([(c, 0, "u", "x")], [(c, 0, "u", "x"), (100, 0, "u", "y")], [(7, 1, "u", "t")] * 9):
        assert trie(spark, rows, 2) == brute(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(*opened(frame)).collect() == []


def test_whole_table(spark):
    import pyarrow.parquet as pq

    from tallyrack.llm.queries import queries

    path = "/root/testdata/sf0.01"
    t = pq.read_table(f"{path}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()
    got = sorted((tuple(r) for r in queries()["op12_prefixtrie"](spark, path).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute([tuple(r.values()) for r in t])
