"""Language ID: held-out accuracy and every odd text."""

from pyspark.sql import functions as F

from tallyrack.llm.common import held_out, table
from tallyrack.llm.langid import identify, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    found = identify(docs, train(docs)).filter(held_out(F.col("doc_id"), 4, 2))
    right, n = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert n > 150 and right > 0.97


def test_odd_texts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = ["", None, "12 345 !?", "a", "é", "\0\0", "x" * 1_000_000, "the and of", "the and of"]
    frame = spark.createDataFrame([(-i, t, 0.5) for i, t in enumerate(odd)] + [(None, "and the", 1.0)], "doc_id long, text string, score double")
    got = identify(frame, train(docs)).collect()
    assert len(got) == len(odd) + 1
    for g in got:
        assert 0 <= g.score <= 1
        assert (g.lang_pred == "und") == (not any(map(str.isalpha, g.text or "")))


def test_no_labels_and_no_rows(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(nothing)
    assert identify(nothing, model).collect() == []
    assert identify(spark.createDataFrame([(1, "words")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_no_text_reads_its_neighbour():
    import numpy as np

    from tallyrack.llm.convnet import ByteConvNet
    from tallyrack.llm.langid import LanguageModel

    model = LanguageModel(["a", "b"], ByteConvNet(2, 128))
    for text in (b"x" * 128, b"xy" * 64, b"short one", b"z" * 127):
        alone = model.predict([text])[0]
        assert all(model.predict([text, after, b"", text])[0] == alone for after in (b"QQQQ", bytes(range(128, 256)), b"\xff" * 9))
    assert np.isclose(model.predict([b"", b"abc"])[1][1], model.predict([b"abc"])[0][1])


def test_the_pipeline_keeps_mixed_languages(spark, monkeypatch):
    import corpus_pipeline
    from tallyrack.llm import langid

    monkeypatch.setattr(langid, "train", lambda docs: None)
    monkeypatch.setattr(langid, "identify", lambda docs, model, *names: docs.selectExpr("*", "if(doc_id = 1, 'und', 'en') AS lang_pred", "if(doc_id = 1, 0D, 0.3D) AS score"))
    docs = spark.createDataFrame([(1, "1 2"), (2, "one zwei trois")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [2]


def test_a_rare_language_is_learned(spark, monkeypatch):
    from tallyrack.llm import langid

    monkeypatch.setattr(langid, "SAMPLE_DOCS", 60)
    rows = [(i, "the and of that with from " * 3, "en") for i in range(3000)] + [(i, "ßä öü ñandú ğı " * 3, "zz") for i in range(10_000, 10_012)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.training_windows(docs)
    assert 6 <= sum(r.lang == "zz" for r in found) <= 12 and sum(r.lang == "en" for r in found) == 50
    assert langid.identify(docs.filter("doc_id = 10003").select("doc_id", "text"), train(docs)).first().lang_pred == "zz"


def test_the_network_against_plain_loops():
    """Pooling, softmax and every gradient, against the definition and differences."""
    import numpy as np

    from tallyrack.llm.convnet import ByteConvNet

    net = ByteConvNet(3, 10, (2, 3), 4, 5, seed=3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    windows, labels = r.integers(0, 256, (4, 10 + net.ahead)).astype(np.uint8), np.array([0, 2, 1, 2])

    def plain(window):
        pools = []
        for w in net.widths:
            for f in range(net.filters):
                answers = [sum(net.p["E"][window[i + k]] @ net.p[f"W{w}"][k][:, f] for k in range(w)) for i in range(net.length)]
                pools.append(max(0.0, max(answers) + net.p[f"c{w}"][f]))
        z = np.array(pools) @ net.p["V"] + net.p["b"]
        return np.exp(z) / np.exp(z).sum()

    loss = lambda: -np.mean([np.log(plain(x)[y]) for x, y in zip(windows, labels, strict=True)])
    for x in windows:
        assert np.allclose(net.predict(x, 1)[0], plain(x), atol=1e-5)
    grads = net._gradients(windows, labels)
    under = int(windows[1, 3])
    for name, at in [("V", (1, 2)), ("b", (0,)), ("c2", (1,)), ("c3", (0,)), ("W2", (1, 2, 3)), ("W3", (2, 0, 1)), ("E", (under, 1))]:
        keep, h = net.p[name][at], 1e-6
        net.p[name][at] = keep + h
        up = loss()
        net.p[name][at] = keep - h
        down = loss()
        net.p[name][at] = keep
        assert np.isclose((up - down) / (2 * h), grads[name][at], rtol=1e-3, atol=1e-7), name


def test_every_window_of_every_labelled_document_is_learned_from(spark, monkeypatch):
    """Far more documents and windows than the network starts from; held-out ones and those without a language aren't read."""
    from tallyrack.llm import langid

    monkeypatch.setattr(langid, "SAMPLE_DOCS", 40)
    words = {"en": "the and of that with from ", "de": "und der nicht ist auch wir "}
    rows = [(i, words[lang] * (1 + i % 17), lang) for i in range(400) for lang in [["en", "de"][i % 2]]] + [(9001, "x " * 300, None), (9002, None, "en"), (9003, "12 " * 100, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    own = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).filter("text rlike '[a-z]'").collect()
    assert train(docs).learned == sum(-(-len(r.text) // 128) for r in own) > 500


def test_windows_are_cut_in_the_worker_that_learns_from_them(spark, monkeypatch):
    """No second Python worker a task, and no window goes through the JVM: what learn() reads is the texts themselves."""
    from tallyrack.llm import langid

    seen = []
    monkeypatch.setattr(langid, "learn", lambda rows, net, rates, **more: seen.append((rows, more["cut"])) or 0)
    docs = spark.createDataFrame([(i, "the and of " * 40, ["en", "de"][i % 2]) for i in range(80)], "doc_id long, text string, lang string")
    train(docs)
    (rows, cut), = seen
    assert rows.columns == ["lang", "text"] and "MapInArrow" not in rows._jdf.queryExecution().toString()
    windows = [w for b in cut(iter(rows.toArrow().to_batches())) for w in b.column("window").to_pylist()]
    assert len(windows) == 4 * rows.count() and {len(w) for w in windows} == {131}


def test_the_largest_response_of_windows_of_any_length():
    import numpy as np

    from tallyrack.llm.convnet import ByteConvNet

    for length in (1, 2, 7, 24, 128):
        net = ByteConvNet(3, length)
        data, tables = np.random.default_rng(length).integers(0, 256, 5 * length + net.ahead).astype(np.uint8), net.tables()
        plain = [np.stack([sum(tables[w][k][data[at + k]] for k in range(w)) for at in range(5 * length)]).reshape(5, length, -1).max(axis=1) for w in net.widths]
        assert np.allclose(net._pooled(data, 5, tables), np.concatenate(plain, axis=1))
