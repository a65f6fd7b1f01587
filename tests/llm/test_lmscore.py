"""LM scoring: base scores by brute force, the attention's gradients and windows against plain loops."""

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa

from tallyrack.llm.lmscore import CLASSES, END, IDS, OVERLAP, STEP, WINDOW, AttentionModel, counted, laid_out, score, targets


def small(seed=1):
    r = np.random.default_rng(seed)
    model = AttentionModel(r.integers(0, CLASSES, IDS), r.integers(0, CLASSES, IDS)).tables(r.poisson(0.3, 3 * IDS * CLASSES))
    model.p["R"] = r.normal(size=WINDOW)
    return model


def flat(items):
    return np.concatenate([np.zeros(0, np.int64), *items]).astype(np.int64), np.array([len(x) for x in items], np.int64)


def plain(model, ids):
    """One token at a time, by the definition."""
    p, total = model.p, 0.0
    seen = [END] * (OVERLAP + 1) + list(ids)
    for i, want in enumerate([*ids, END]):
        start = i // STEP * STEP
        own = seen[start : i + OVERLAP + 1]
        c, t = model.context[own], model.target[want]
        s = np.array([p["Q"][c[-1]] @ p["K"][k] / np.sqrt(p["Q"].shape[1]) + p["R"][len(own) - 1 - j] for j, k in enumerate(c)])
        a = np.exp(s - s.max())
        values = [model.far[x, t] for x in own[:-1]] + [model.near[own[-1], t]]
        total += np.log((a / a.sum()) @ np.array(values, float)) + model.within[c[-1], want]
    return total / np.log(10)


def test_windows_score_each_token_once():
    r, model = np.random.default_rng(2), small()
    items = [r.integers(0, END, n) for n in (0, 1, 3, 11, 12, 13, 40, 0, 200)]
    assert np.allclose(model.score(*flat(items)), [plain(model, x) for x in items], rtol=1e-5, atol=1e-4)
    assert model.score(*flat([])).shape == (0,)


def test_probabilities_sum_to_one():
    """Of all ids after some context: the attention's distribution of classes times the ids' within them."""
    r, model = np.random.default_rng(5), small(6)
    x = r.integers(0, END, WINDOW)
    total = 0.0
    for t in range(CLASSES):
        members = np.flatnonzero(model.target == t)
        y = np.full((1, STEP), members[0])
        p = model.mix(x[None, :], y)[3][0, -1]
        total += p * np.exp(model.within[model.context[x[-1]], members].astype(float)).sum()
    assert abs(total - 1) < 1e-4


def test_gradients():
    r, model = np.random.default_rng(3), small()
    x, y, real = r.integers(0, END, (3, WINDOW)), r.integers(0, END, (3, STEP)), r.random((3, STEP)) < 0.7

    def loss():
        p = np.zeros((3, STEP))
        for n in range(3):
            for s in range(STEP):
                own = x[n, : OVERLAP + s + 1]
                c = model.context[own]
                e = np.exp([model.p["Q"][c[-1]] @ model.p["K"][k] / 4 + model.p["R"][len(own) - 1 - j] for j, k in enumerate(c)])
                v = np.array([model.far[i, model.target[y[n, s]]] for i in own[:-1]] + [model.near[own[-1], model.target[y[n, s]]]], float)
                p[n, s] = e @ v / e.sum()
        return -np.log(p)[real].mean()

    grads = model.gradients(x, y, real)
    for name, at in [("Q", (int(model.context[x[0, 6]]), 2)), ("K", (int(model.context[x[1, 3]]), 4)), ("R", (1,)), ("R", (5,))]:
        keep, h = model.p[name][at], 1e-4
        model.p[name][at] = keep + h
        up = loss()
        model.p[name][at] = keep - h
        down = loss()
        model.p[name][at] = keep
        assert np.isclose((up - down) / (2 * h), grads[name][at], rtol=2e-2, atol=1e-5), name


def test_extreme_queries_stay_finite():
    model = small()
    model.p["Q"][:], model.p["K"][:] = 8, 8
    assert np.isfinite(model.score(*flat([np.arange(50)]))).all()


def test_counts_cover_every_pair(spark):
    """Over many partitions, in more than one round of sums, against a plain loop."""
    r = np.random.default_rng(4)
    items = [r.integers(0, 300, n) for n in r.integers(0, 30, 200)]
    coded = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in items], "ids binary").repartition(70)
    model = AttentionModel(r.integers(0, CLASSES, IDS), r.integers(0, CLASSES, IDS))
    got = counted(coded, 3 * IDS * CLASSES, model.cells)
    want = Counter()
    for x in items:
        seen = [END] * 5 + x.tolist() + [END]
        for i in range(5, len(seen)):
            t = model.target[seen[i]]
            want[seen[i - 1] * CLASSES + t] += 1
            for back in (2, 3, 4):
                want[IDS * CLASSES + seen[i - back] * CLASSES + t] += 1
            want[2 * IDS * CLASSES + model.context[seen[i - 1]] * IDS + seen[i]] += 1
    there = np.flatnonzero(got)
    assert {int(k): int(got[k]) for k in there} == {int(k): n for k, n in want.items()}


def test_base_scores(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcé", k=r.randint(1, 5))) for _ in range(200)]
    texts = ["", None, " ", "One one ONE", "x" * 3000, "x" * 3000 + " y", "tie b", "tie b"] + [" ".join(r.choices(vocabulary, k=r.choice([5, 60]))) for _ in range(120)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "a b", "z"), (3, "One one ONE", "z")]
    got = score(spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3), head=40).collect()
    words = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [b"\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t, _ in rows if not out(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t, _ in rows:
        w = words(t)
        want[i] = (out(i), len(w), sum(count[x] > 0 for x in w), n, sum(log10((count[x] + 1) / (n + v + 1)) for x in w))
    assert sorted((g.doc_id is not None, g.doc_id or 0) for g in got) == sorted((i is not None, i or 0) for i, _, _ in rows)
    for g in got:
        assert tuple(g)[1:5] == want[g.doc_id][:4] and abs(g.base_score - want[g.doc_id][4]) < 1e-6 and g.score < 0
    assert len({round(g.score, 6) for g in got if g.doc_id in (6, 7)}) == 1


def test_held_out_texts_are_likelier_than_by_a_unigram(spark):
    """On documents that were not learned from, the model beats add-one counts of the same ids by a tenth at least."""
    from tallyrack.llm.common import tokenizer_path, word_ids

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    coder = word_ids(tokenizer_path("word_bpe_49k.json"))
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    ids = {r.doc_id: np.append(np.frombuffer(coder.encode([coder.split((r.text or "").encode())])[0], "<u4"), END) for r in docs.collect()}
    counts = np.bincount(np.concatenate([x for i, x in ids.items() if not out(i)]), minlength=IDS) + 1
    logs = np.log10(counts / counts.sum())
    got = {g.doc_id: g.score for g in score(docs).collect()}
    held = [i for i in ids if out(i)]
    size = sum(len(ids[i]) for i in held)
    model, unigram = sum(got[i] for i in held) / size, sum(logs[ids[i]].sum() for i in held) / size
    assert size > 50_000 and model > 0.9 * unigram


def test_empty_table(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_training_text_teaches():
    """Whatever follows an id in any text makes it likelier there; the end after short texts too."""
    text = np.array([5, 6])
    model = AttentionModel(np.arange(IDS) % CLASSES, np.arange(IDS) % CLASSES).tables(np.zeros(3 * IDS * CLASSES))
    before = model.score(*flat([text]))[0]
    rows, starts, real = laid_out(*flat([text] * 50))
    cells = np.zeros(3 * IDS * CLASSES)
    for first, size, found in model.cells(rows, targets(starts, real)):
        cells[first : first + size] += np.bincount(found, minlength=size)
    model.tables(cells)
    assert model.score(*flat([text]))[0] > before + 3
    w = rows[starts[:, None] + np.arange(WINDOW + 1)]
    x, y, mask = w[:, :WINDOW], w[:, OVERLAP + 1 :], np.arange(STEP) < real[:, None]
    start = model.score(*flat([text]))[0]
    for _ in range(30):
        model.step(x, y, mask, 0.1)
    assert model.score(*flat([text]))[0] > start
    seen = [w[i, OVERLAP + 1 + j] for i, n in enumerate(real) for j in range(n)]
    assert seen == [5, 6, END] * 50


def test_the_end_is_counted_whatever_the_head(spark):
    """No word is sent to the tasks, and one long text whose words are all as rare as the end."""
    for texts, head in ((["a b", "b", None], 0), ([" ".join(f"w{i}" for i in range(500))], 100)):
        got = score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), head=head).collect()
        lists = [(t or "").split() + ["\n"] for t in texts]
        count = Counter(w for i, x in enumerate(lists) if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
        n, v = sum(count.values()), len(count)
        for g in got:
            own = lists[g.doc_id]
            assert g.n_tokens == len(own) and g.n_known == sum(count[w] > 0 for w in own)
            assert abs(g.base_score - sum(log10((count[w] + 1) / (n + v + 1)) for w in own)) < 1e-6


def test_held_out_documents_against_pairs_and_words(spark):
    """Better by a tenth a token than an add-one bigram of ids, and near the base, which knows whole words, where all
    words are known."""
    from tallyrack.llm import lmscore
    from tallyrack.llm.common import tokenizer_path, word_ids

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lmscore.score(docs).collect()}
    coder = word_ids(tokenizer_path("word_bpe_49k.json"))
    ids = {r.doc_id: np.frombuffer(coder.encode([coder.split((r.text or "").encode())])[0], "<u4").tolist() for r in docs.select("doc_id", "text").collect()}
    pairs, firsts = Counter(), Counter()
    for d, x in ids.items():
        if not got[d].held_out:
            pairs.update(zip([END, *x], [*x, END], strict=True))
            firsts.update([END, *x])
    model = bigram = n = 0.0
    for d, x in ids.items():
        if got[d].held_out:
            bigram += sum(log10((pairs[a, b] + 1) / (firsts[a] + IDS)) for a, b in zip([END, *x], [*x, END], strict=True))
            model, n = model + got[d].score, n + len(x) + 1
    assert model / n > 0.9 * bigram / n, (model / n, bigram / n)
    known = [r for r in got.values() if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in known) > 1.1 * sum(r.base_score for r in known)


def test_windows_are_scored_many_at_a_time(monkeypatch):
    from tallyrack.llm import lmscore

    r = np.random.default_rng(4)
    model = lmscore.AttentionModel(r.integers(0, lmscore.CLASSES, lmscore.IDS), r.integers(0, lmscore.CLASSES, lmscore.IDS))
    model.near, model.far = r.random((2, lmscore.IDS, lmscore.CLASSES), dtype=np.float32) + 0.01
    model.within = -r.random((lmscore.CLASSES, lmscore.IDS), dtype=np.float32)
    lengths = np.array([0, 5, 3000, 7, 6000])
    ids = r.integers(0, lmscore.IDS, lengths.sum())
    passes, mix = [], model.mix
    monkeypatch.setattr(model, "mix", lambda x, y: (passes.append(len(x)), mix(x, y))[1])
    scores = model.score(ids, lengths)
    assert len(passes) == 2 and sum(passes) == int((-(-(lengths + 1) // lmscore.STEP)).sum())
    cuts = np.cumsum(lengths)
    alone = [model.score(ids[b - n : b], np.array([n]))[0] for b, n in zip(cuts, lengths, strict=True)]
    assert np.array_equal(scores, alone)


def test_values_of_slices():
    from tallyrack.llm.common import values

    x = pa.array([b"ab", b"", b"\xc3\xa9", b"z" * 100], pa.binary())
    assert values(x) == x.to_pylist() and values(x[1:3]) == [b"", b"\xc3\xa9"] and values(x[:0]) == [] and values(pa.array([b""], pa.binary())) == [b""]


def test_targets_see_only_what_stands_before_them():
    """No row is computed of inputs after a target; a window scores the same whatever stands beside it."""
    r, model = np.random.default_rng(8), small(9)
    x, y = r.integers(0, END, (5, WINDOW)), r.integers(0, END, (5, STEP))
    pairs, a, v, p = model.mix(x, y)
    assert pairs.shape == a.shape == v.shape == (sum(range(OVERLAP + 1, WINDOW + 1)), 5) and p.shape == (5, STEP)
    whole = p.copy()
    for n in range(5):
        assert np.array_equal(model.mix(x[n : n + 1], y[n : n + 1])[3][0], whole[n])


def test_counts_take_few_targets_at_a_time(spark):
    """A long text's targets come in blocks, all of them once."""
    from tallyrack.llm.lmscore import PLACES

    coded = spark.createDataFrame([(np.zeros(20_000, "<u2").tobytes(),)], "ids binary").repartition(1)
    got = counted(coded, 30_000, lambda flat, places: iter([(0, 30_000, np.array([len(places)]))]))
    there = np.flatnonzero(got)
    assert there.max() <= PLACES and int((got[there] * there).sum()) == 20_001


def test_words_of_the_head_come_with_their_ids(spark):
    """They are coded once, and tasks take the ids they are sent; words whose keys are digests are coded where the texts are."""
    from tallyrack.llm.common import tokenizer_path, word_ids
    from tallyrack.llm.lmscore import _key, coded_texts, with_ids

    path, long = tokenizer_path("word_bpe_49k.json"), b"ab" * 400
    coder = word_ids(path)
    wanted = lambda *words: np.concatenate([np.frombuffer(x, "<u4") for x in coder.encode([list(words)])]).tolist()
    words = [b"the", b"caf\xc3\xa9s!!", b"\xe2\x82\xac5", _key(long)]
    head = with_ids(spark.createDataFrame([(w, 9) for w in words], "key binary, c long"), path).toArrow()
    ids = dict(zip(head["key"].to_pylist(), head["ids"].to_pylist(), strict=True))
    assert ids[_key(long)] is None and head["c"].to_pylist() == [9] * 4
    assert all(np.frombuffer(ids[w], "<u2").tolist() == wanted(w) for w in words[:3])
    docs = spark.createDataFrame([(1, f"Rare the {long.decode()} cafés!! the €5 zq"), (2, None)], "doc_id long, text string")
    told = lambda head: {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in coded_texts(docs, head, 1, 50, path).collect() if r.ids is not None}
    assert told(head) == {1: wanted(b"rare", b"the", long, "cafés!!".encode(), b"the", "€5".encode(), b"zq"), 2: []}
    sent = head.set_column(2, "ids", pa.array([np.array([7, 8], "<u2").tobytes() if w == b"the" else ids[w] for w in head["key"].to_pylist()], pa.binary()))
    assert told(sent)[1] == [*wanted(b"rare"), 7, 8, *wanted(long, "cafés!!".encode()), 7, 8, *wanted("€5".encode(), b"zq")]
