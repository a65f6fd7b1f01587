"""The pipeline's stages on planted documents."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark):
    words = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(3).collect()
    clean = [w.text for w in words]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(clean)]
    rows += [(10, clean[0], "en", "b", len(clean[0])), (10, clean[0], "en", "b", len(clean[0])), (11, None, None, None, None), (12, "", "en", "a", 0), (13, "12 34!", "en", "a", 6), (14, clean[1] + " token=abcdef123456", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = dict(corpus_pipeline.STAGES)
    kept = names["langid"](spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 10, 14}
    single = names["simhash"](spark, kept, SF)
    left = [r.doc_id for r in single.collect()]
    assert single.columns == docs.columns and len(left) == len(set(left)) and 10 not in left and {0, 1, 2} <= set(left)
    safe = names["secrets"](spark, kept, SF)
    texts = {r.doc_id: r for r in safe.collect()}
    assert "abcdef123456" not in texts[14].text and texts[14].n_chars == len(texts[14].text) and texts[0].text == clean[0]
    mixed = names["mixture"](spark, single, SF)
    assert mixed.columns == docs.columns
    assert names["packing"](spark, mixed, SF).count() >= mixed.count()
    nothing = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).collect() == []


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50
    used = out.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n")
    assert used.filter("n > 4096").count() == 0


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["langid", "simhash", "secrets", "mixture", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_one_row_of_each_component_whatever_the_ids(spark):
    texts = [w.text for w in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars > 400").dropDuplicates(["text"]).orderBy("doc_id").limit(60).collect()]
    from tallyrack.llm.simhash import fingerprint

    apart = []
    for t in texts:
        if all((fingerprint(t.encode()) ^ fingerprint(x.encode())).bit_count() > 8 for x in apart):
            apart.append(t)
    a, b, c, d, e = apart[:5]
    rows = [(None, a), (None, b), (None, b), (7, a), (8, c), (8, d), (3, c), (9, e), (9, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.one_of_each(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted([(7, a), (0, b), (3, c), (8, d), (9, e)])


CLASHES = ["id", "score", "lang_pred", "copies", "copy", "taken", "taken_id", "salt", "rank", "height", "row_digest", "stays", "n", "row", "rid", "first", "own", "place", "digest", "root", "fp", "secret", "findings", "size", "Score_"]


def test_clashing_columns_nulls_and_repeats(spark):
    """Every stage keeps columns of any name as they are, with null ids, repeated rows and very long texts."""
    words = [w.text for w in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars > 300").dropDuplicates(["text"]).orderBy("doc_id").limit(4).collect()]
    long = " ".join(words * 200)
    rows = [(i, t) for i, t in enumerate([*words, None, "", "1 2", long])] + [(None, words[0] + " one more"), (3, words[3]), (3, words[3]), (None, None)]
    more = [f"v{k}" for k in range(len(CLASHES))]
    docs = spark.createDataFrame([(i, t, "en", "a" if (i or 0) % 2 else None, len(t or ""), *more) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all([g[c] for c in CLASHES] == more for g in got), name
        if name == "secrets":
            assert len(got) == len(rows)
        if name == "langid":
            assert len(got) == 8 and max(len(g.text) for g in got) == len(long)
        if name == "simhash":
            assert len({(g.doc_id, g.text) for g in got}) == len(got) <= 7
    assert corpus_pipeline.packed(spark, docs, SF).count() >= len(rows)


def test_the_mixture_takes_repeated_rows_together(spark):
    rows = [(1, "a b c", "x")] * 6 + [(2, "d e", "x"), (None, "f", "x"), (None, "g", "x"), (4, "h " * 50, "y")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    from tallyrack.llm.mixture import mix

    wanted = sum(r.copies for r in mix(docs, row=None).collect() if r.doc_id == 1)
    got = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert abs(sum(g.doc_id == 1 for g in got) - wanted) <= 6
    again = corpus_pipeline.mixed(spark, docs.repartition(2), SF).collect()
    key = lambda g: (str(g.doc_id), g.text)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_run_with_very_long_texts(spark, tmp_path):
    """Whole texts go through all stages: a text of some megabytes leaves as pieces without gaps."""
    words = [w.text for w in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars > 300").dropDuplicates(["text"]).orderBy("doc_id").limit(6).collect()]
    long = " ".join(" ".join(words[i % 6 :]) + f" part {i}" for i in range(300))
    rows = [(i, t, "en", "a") for i, t in enumerate([*words, long, None, ""])]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {0, 1, 2, 3, 4, 5, 6} and 6 in {r.doc_id for r in out}
    by_copy = {}
    for r in sorted((r for r in out if r.doc_id == 6), key=lambda r: (r.piece, r.sequence_id)):
        by_copy.setdefault(r.piece, []).append((r.start, r.length))
    assert all(len(set(v)) == 1 and v[0][0] == 4096 * k for k, v in by_copy.items()) and sum(v[0][1] for v in by_copy.values()) > len(long) / 8


def test_stages_give_back_the_coder(spark, monkeypatch):
    """Workers serve one stage after another; what packing holds must not lie beside what the others need."""
    from tallyrack.llm import common, langid, secrets, simhash

    docs = spark.createDataFrame([(1, "some words", "en"), (2, "des mots", "fr")], "doc_id long, text string, lang string")
    steps, whole = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *more: (steps.append(f), whole(self, f, schema, *more))[1])
    net = secrets.ByteConvNet(2, secrets.LENGTH)
    model = secrets.SecretModel(net, 1.0, 0.0, 0.5)
    simhash.fingerprints(docs), secrets.findings(docs), secrets.spans(docs, model), secrets.redact(docs, model)
    langid.identify(docs, langid.LanguageModel(["en", "fr"], langid.ByteConvNet(2)))
    assert len(steps) == 5
    for step in steps:
        monkeypatch.setitem(common._word_ids, "held", object())
        assert list(step(iter(()))) == [] and not common._word_ids


def test_coder_is_sent_few_strings_at_a_time():
    from tallyrack.llm.common import WordIds, tokenizer_path

    coder = WordIds(tokenizer_path("word_bpe_49k.json"))
    sizes, bare = [], coder.bare

    class Recorded:
        def encode_batch_fast(self, strings, **options):
            sizes.append(len(strings))
            return bare.encode_batch_fast(strings, **options)

    words = [b"".join(bytes([97 + i // 26**k % 26]) for k in range(4)) for i in range(20_000)]
    plain = coder._code(words)
    coder.bare = Recorded()
    assert coder._code(words) == plain and max(sizes) <= 32 and sum(sizes) == -(-len(words) // 256)
