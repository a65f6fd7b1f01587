"""Quality: held-out accuracy, and every odd text and label."""

from pyspark.sql import functions as F

from tallyrack.llm.common import held_out, table
from tallyrack.llm.quality import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    known = labels.filter(held_out(F.col("doc_id"), 3, 1))
    found = quality(table(spark, SF, "documents"), labels).join(known, "doc_id")
    for truth, least in ((1, 0.99), (0, 0.93)):
        right = found.filter(F.col("quality") == truth).agg(F.avg((F.col("predicted") == truth).cast("int"))).first()[0]
        assert right > least, (truth, right)


def test_odd_rows(spark):
    texts = ["", None, "\n", "plain words of some text", "A!! B!! C!!", "z " * 100_000, "tie", "tie"]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(texts)] + [(3, texts[3], 0.0), (None, "no id", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (3, 0), (99, 1), (None, 0), (0, None), (5, 0), (6, 1)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == len(texts) + 2 and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    none = quality(docs, labels.filter("false")).collect()
    assert {g.score for g in none} == {0.5}
    assert quality(docs.filter("false"), labels).collect() == []


def test_the_ranker_against_plain_loops(monkeypatch):
    """Pairwise logistic loss by gradient steps, the threshold at the quantile, against plain loops over the pairs."""
    import numpy as np

    from tallyrack.llm import quality as Q

    monkeypatch.setattr(Q, "SAMPLE_PAIRS", 40)
    r = np.random.default_rng(2)
    x = r.random((30, Q.FEATURES)).astype(np.float32)
    y = (x[:, 0] + 0.3 * r.random(30) > 0.6).astype(int)
    ranker = Q.fit(x, y, steps=8)
    r = np.random.default_rng(4)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(r.choice(good, 40), r.choice(bad, 40), strict=True))
    one = [[(k, int(b)) for k, b in enumerate(row)] for row in ranker.bins(x)]
    for k in range(Q.FEATURES):  # a bin's number is how many edges lie at or below the value
        assert [b[k][1] for b in one] == [sum(e <= v for e in ranker.edges[k]) for v in x[:, k]]
    w, speed = np.zeros((Q.FEATURES, Q.BINS + 2)), np.zeros((Q.FEATURES, Q.BINS + 2))
    for step in range(8):
        pull = np.zeros_like(w)
        for a, b in pairs:
            lost = 1 / (1 + np.exp(sum(w[f] for f in one[a]) - sum(w[f] for f in one[b])))
            for f in one[a]:
                pull[f] += lost / 40
            for f in one[b]:
                pull[f] -= lost / 40
        speed = 0.9 * speed + pull - 1e-4 * w
        w = w + 3.0 * (1 - step / 8) * speed
    assert np.allclose(ranker.weights, w, atol=1e-4)
    scores = sorted(sum(w[f] for f in f1) for f1 in one)
    assert np.isclose(ranker.threshold, (scores[len(bad) - 1] + scores[len(bad)]) / 2, atol=1e-3)
    assert sum(ranker.score(x) >= 0.5) == len(good)
