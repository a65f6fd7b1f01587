"""SimHash links and components against brute force."""

import random

import numpy as np
import xxhash

from tallyrack.llm.simhash import fingerprint, links, near_duplicates


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


TEXTS = ["", None, " \n", "one", "One", "one two", "one two three", "one two three four", "É é x y z", "a b c " * 5000, "tie tie tie tie"]


def test_fingerprint_is_the_contract():
    for text in TEXTS:
        assert fingerprint((text or "").encode()) == brute_print(text)


def test_links_join_what_all_pairs_join(spark):
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(12):
            for _ in range(r.randint(1, 4)):
                p ^= 1 << r.randrange(64)
            prints.append(p)
    center = r.getrandbits(64)
    prints = sorted({*prints, *(center ^ 1 << r.randrange(32) ^ 1 << r.randrange(32, 64) ^ 1 << r.randrange(64) for _ in range(300)), 0, 7})
    want = brute_components(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for block in (4096, 32):
        edges = [(int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))) for a, b in links(frame, block=block).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        at = {p: i for i, p in enumerate(prints)}
        root = list(range(len(prints)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            root[find(at[a])] = find(at[b])
        got = [find(i) for i in range(len(prints))]
        pairs = lambda x: {tuple(i for i, y in enumerate(x) if y == k) for k in set(x)}
        assert pairs(got) == pairs(want)


def test_components_of_documents(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefg", k=4)) for _ in range(300)]
    base = [r.choices(vocabulary, k=200) for _ in range(6)]
    rows = [*enumerate(TEXTS)]
    for words in base:
        for _ in range(6):
            words = list(words)
            words[r.randrange(200)] = "new"
            rows.append((len(rows), " ".join(words)))
    rows += [(3, "one"), (None, "one"), (None, "lonely words here and there")]
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, fp string, component_id double")
    got = near_duplicates(frame).collect()
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    least = {k: min((i for (i, _), q in zip(rows, roots) if q == k and i is not None), default=None) for k in roots}
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((g.doc_id, g.fp & (1 << 64) - 1, g.component_id) for g in got), key=key) == sorted(((i, p, least[q]) for (i, _), p, q in zip(rows, prints, roots)), key=key)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
