"""The catalog engine's operators on small tables: values worked out by hand, odd rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from tallyrack.functions import urls as U
from tallyrack.functions.dialect import SPARK
from tallyrack.operators import clean as C
from tallyrack.operators import export as E
from tallyrack.operators import identity as I
from tallyrack.operators import labels as A
from tallyrack.operators import structured as S
from tallyrack.streaming import limits as T
from tallyrack.streaming import queue as Q


def test_clean_records(spark):
    rows = [
        (1, "Add to Compare HP Pavilion 15 (8 GB/512 GB SSD) 4.3 1,204 Ratings", "Rs. 55,000", "https://Shop.example.com//hp-pavilion/p/1/?x=1#y", "Windows 11 laptop"),
        (2, "HP Pavilion 15 (8 GB/512 GB SSD)", "Rs. 54,000", "https://shop.example.com/hp-pavilion/p/2", "laptop"),
        (3, "Unknown", "Rs. 5", "https://shop.example.com/search", None),
        (4, None, None, None, None),
    ]
    got = C.clean(spark.createDataFrame(rows, "idx int, title string, price string, product_url string, description string"), "idx").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.brand, r.category, r.model, r.ram, r.storage, r.os, r.price_inr, r.rating, r.product_url) == ("HP", None, "Pavilion 15", "8 GB", "512 GB SSD", "Windows", 55000, 4.3, "https://shop.example.com/hp-pavilion/p/1")
    assert C.clean(spark.createDataFrame([], "idx int, title string"), "idx").collect() == []


def test_load_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": " x ", "tags": ["", "b "], "price": null}, {"title": "", "tags": []}]')
    got = C.load_records(spark, str(tmp_path / "a.json")).select("title", "tags").collect()
    assert [tuple(r) for r in got] == [("x", [None, "b"]), (None, [])]
    (tmp_path / "b.json").write_text('[{"title": {"a": 1}}]')
    with pytest.raises(ValueError, match="scalar"):
        C.load_records(spark, str(tmp_path / "b.json"))
    (tmp_path / "c.json").write_text('[{"name": "x"}]')
    with pytest.raises(ValueError, match="title"):
        C.load_records(spark, str(tmp_path / "c.json"))


def test_urls(spark):
    def one(sql, *args):
        return spark.sql("SELECT " + sql, args=list(args)).first()[0]

    assert one(U.product_link(SPARK, "'HTTPS://A.com//x//y/;p?q#f'")) == "https://a.com/x/y"
    assert one(U.product_link(SPARK, "'ftp://a.com/x'")) is None and one(U.product_link(SPARK, "'https://a.com'")) == "https://a.com/"
    assert one(U.slug(SPARK, "'https://a.com/n/lamp/p/9'")) == "lamp" and one(U.slug(SPARK, "'https://a.com/p/9'")) == "9"
    assert one(U.next_page(SPARK, "'https://a.com/x?page=9&z=1#t'")) == "https://a.com/x?page=10&z=1#t" and one(U.next_page(SPARK, "'https://a.com/x'")) is None
    for ref, want in (("/b", "https://a.com/b"), ("b", "https://a.com/x/b"), ("?q=1", "https://a.com/x/y?q=1"), ("//c.com/d", "https://c.com/d"), ("http://d.com", "http://d.com"), ("", "https://a.com/x/y?z#f")):
        assert one(U.join(SPARK, "'https://a.com/x/y?z#f'", f"'{ref}'")) == want


def test_structured_row(spark):
    rows = [(1, "Add to Compare Apple MacBook Air M4 - (16 GB/512 GB SSD/macOS Sequoia) MC6T4HN/A 4.7 2,835 Ratings", "₹89,990", "https://shop.example.com/apple-macbook-air-m4-mc6t4hn-a/p/itm1?pid=COMH9ZWQ", "Apple MacBook Air M4 (16 GB/512 GB SSD) MC6T4HN/A ₹89,990 ₹99,900 4.7 2,835 Ratings & 210 Reviews in stock"), (2, "Laptops", None, "https://shop.example.com/laptops/pr?sid=1", ""), (3, None, None, None, None), (4, "Samsung Galaxy Book NP750XGJ-K", "₹50,000", "https://x.example.com/samsung-np750xgj-kg1in/p/2", "")]
    df = spark.createDataFrame(rows, "idx long, title string, price string, product_url string, raw_text string")
    got = {r.idx: r for r in S.catalog_rows(df, "idx").collect()}
    assert got.keys() == {1, 3, 4} and got[4].sku == "NP750XGJ-KG1IN"
    r = got[1]
    assert (r.brand, r.category, r.model, r.sku, r.ram, r.storage, r.processor, r.os, r.name_source) == ("Apple", "laptop", "MacBook Air M4", "MC6T4HN-A", "16 GB", "512 GB SSD", "Apple M4", "macOS Sequoia", "catalog_pattern")
    assert (r.list_price_inr, r.effective_price_inr, r.discount_percent, r.rating, r.review_count, r.review_scope, r.availability) == (99900, 89990, 9.92, 4.7, 210, "variant", "in stock")
    assert got[3].sku is None and got[3].sku_confidence is None
    assert S.wants_catalog("brand, category, model, price_inr and product_url") and not S.wants_catalog("prices please")


def test_merge_and_dedupe(spark):
    columns = "at int, brand string, category string, model string, ram string, storage string, processor string, sku_confidence double, is_canonical_name boolean, list_price_inr long, effective_price_inr long, price_inr long, discount_percent double"
    rows = [(1, "A", "laptop", "m", None, None, None, 0.5, False, None, None, 50000, None), (2, "a ", "laptop", "M", None, None, "i5", 0.9, None, 60000, None, None, None), (3, "a", "laptop", "m", None, None, None, None, True, 999, 40000, None, None), (4, "b", "x", None, None, None, None, None, None, None, None, 7, None)]
    got = {r.at: r for r in I.merge_variants(spark.createDataFrame(rows, columns), "at").collect()}
    assert got.keys() == {1, 2, 4} and got[4].price_inr == 7 and got[4].effective_price_inr is None
    assert (got[1].brand, got[1].is_canonical_name, got[1].effective_price_inr, got[1].list_price_inr, got[1].price_inr) == ("A", True, 40000, None, 50000) or got[1].price_inr == 50000
    twice = spark.createDataFrame([(3, "x", 1.0), (1, " X", 1.00001), (2, "y", None)], "i int, a string, b double")
    assert [r.i for r in I.dedupe_rows(twice, "i").orderBy("i").collect()] == [1, 2]


def test_labels(spark):
    assert spark.range(1).select(A.field_name(F.lit(" Price (INR)! "))).first()[0] == "price_inr"
    assert spark.range(1).select(A.field_score(*(F.lit(x) for x in (1.0, 0.5, 2.0, -1.0, 0.0)))).first()[0] == 0.65
    labels = spark.createDataFrame([("j", 1, "good", None, 1), ("j", 1, "bad", 0.2, 2), ("j", 9, "far", 0.2, 3), ("j", 2, " ", 0.2, 4)], "job string, row_index int, label string, confidence double, position int")
    got = A.row_labels(labels, spark.createDataFrame([("j", 3)], "job string, n int"), "job").collect()
    assert [tuple(r) for r in got] == [("j", 1, "good", 0.7)]


def test_rate_limits(spark):
    hits = spark.createDataFrame([("k", float(t), i) for i, t in enumerate((0, 1, 2, 3.5, 11, 12, 13))], "key string, ts double, id long")
    of = lambda kind: {r.id: (r.allowed, r.remaining, r.reset_seconds) for r in T.decide(hits, kind, 2, 10).collect()}
    assert of(T.SlidingLog) == {0: (True, 1, 10), 1: (True, 0, 10), 2: (False, 0, 8), 3: (False, 0, 6), 4: (True, 1, 10), 5: (True, 0, 10), 6: (False, 0, 8)}
    assert of(T.FixedWindow) == {0: (True, 1, 10), 1: (True, 0, 9), 2: (False, 0, 8), 3: (False, 0, 7), 4: (True, 1, 10), 5: (True, 0, 9), 6: (False, 0, 8)}
    late = T.FixedWindow(1, 10)
    assert [late.hit(t) for t in (0.0, 9.8, 19.7, 19.8)] == [(True, 0, 10), (False, 0, 10), (False, 0, 10), (False, 0, 10)] and late.count == 4


def test_streams(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text('{"job_id": "j1", "attempt": 0, "max_attempts": 2, "available_at": 5.0}\n{"job_id": "j2", "attempt": 2, "max_attempts": 2, "available_at": 1.0}\n')
    seen = []
    run = Q.process(Q.messages_from(spark, str(tmp_path / "m")), lambda df, n: seen.extend(df.collect()), str(tmp_path / "c2"), once=True)
    run.awaitTermination(60)
    assert sorted(r.job_id for r in seen) == ["j1", "j2"]
    again, dead = Q.after_failure(spark.createDataFrame(seen, Q.MESSAGE), F.lit(100.0), 10, 60, 3)
    assert [(r.job_id, r.attempt, r.available_at) for r in again.collect()] == [("j1", 1, 110.0)] and [r.job_id for r in dead.collect()] == ["j2"]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 'say "hi", é', None, (1,)), (1, 1, "x", 2.5, None)], "job int, i int, a string, b double, s struct<n:int>")
    E.write_csv(rows.coalesce(1).orderBy("i"), str(tmp_path / "csv"), ["i", "a", "b", "s", "gone", " "])
    body = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert body == 'i,a,b,s,gone\r\n1,x,2.5,,\r\n2,"say ""hi"", é",,"{""n"":1}",\r\n'
    assert E.array_of(E.json_rows(rows.select("job", "i", "a", "b"), "job", "i"), "job", "i").first().json == '[{"a":"x","b":2.5},{"a":"say \\"hi\\", é","b":null}]'
    token = E.sign("e", 99, "s")
    assert E.verify("e", 99, token, "s", 98) and not E.verify("e", 99, token, "s", 100) and not E.verify("f", 99, token, "s", 1)


def test_every_job_is_exported(spark):
    from tallyrack.plans.tables import derived
    from tallyrack.queries import queries

    sf = "/root/testdata/sf0.01"
    want = {}
    for r in derived(spark, sf, "job_rows").select("job_id", "row_index", "flag", "part").collect():
        want.setdefault(r.job_id, []).append((r.row_index, f'{{"flag":"{r.flag}","part":{r.part}}}'))
    got = {r.job_id: r.json for r in queries()["export_json_rows"](spark, sf).collect()}
    assert max(want) >= 200 and got == {k: "[" + ",".join(j for _, j in sorted(v)) + "]" for k, v in want.items()}


def test_cleaning_values_worked_out_by_hand(spark):
    """C5-C8, C12 and F5 on values of the record format, without the second dialect."""
    from tallyrack.functions import records as R

    def of(function, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r.y for r in df.select("i", F.expr(function(SPARK, "x")).alias("y")).orderBy("i").collect()]

    assert of(R.price, "₹1,79,900", "Rs. 69,900", "free", "0", None) == [179900, 69900, None, None, None]
    assert of(R.rating, "4,2 out of 5", "5", "9.9", "good") == [4.2, 5.0, None, None]
    assert of(R.review_count, "2.5k", "1m", "1,024 reviews", "none") == [2500, 1_000_000, 1024, None]
    assert of(R.rating_in, "Fine lamp 4.3 1,204 Ratings", "3.9 ratings", "a lamp") == [4.3, 3.9, None]
    assert of(R.reviews_in, "Fine lamp 1,204 Reviews & more", "a lamp") == [1204, None]
    assert of(R.placeholder, "Unknown", " N/A ", "", None, "Nova") == [True, True, True, True, False]
    texts = ["nova book (8 GB/256 GB SSD)", "nova-pro-8-gb-512-gb-ssd-x", "16 GB RAM 1 TB HDD", "no size", "6 GB RAM"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.expr(R.memory_text(SPARK, "t")).alias("m")).select("*", F.expr(R.memory_list(SPARK, "m")).alias("sizes"))
    ram, storage = R.memory_specs(SPARK, "m", "sizes")
    assert [(r.ram, r.storage) for r in df.select("i", F.expr(ram).alias("ram"), F.expr(storage).alias("storage")).orderBy("i").collect()] == [("8 GB", "256 GB SSD"), ("8 GB", "512 GB SSD"), ("16 GB", "1 TB HDD"), (None, None), ("6 GB", None)]


def test_near_duplicate_offers_become_one_record_a_variant(spark):
    """Five offers of a laptop in two variants, with noise in their titles, sizes in their links alone and several prices."""
    link = "https://shop.example.com/acer-orbit-m7-2026-pro-8-gb-{}-gb-ssd-{}/p/itm{}?pid=C{}&srno=s"
    offers = [("Acer Orbit M7 Pro(2026) laptop", "₹69,900", 256), ("Trending Pre Order Acer Orbit M7 Pro(2026) laptop", "₹79,900", 512), ("Pre Order Acer Orbit M7 Pro(2026) laptop", "₹79,900", 512), ("Pre Order Acer Orbit M7 Pro(2026) laptop", "₹69,900", 256), ("Coming soon Acer Orbit M7 Pro(2026) laptop", "₹79,900", 512)]
    rows = [(i, t, p, link.format(size, f"k{i}x", i, i)) for i, (t, p, size) in enumerate(offers)]
    got = C.clean(spark.createDataFrame(rows, "idx int, title string, price string, product_url string"), "idx").orderBy("idx").collect()
    assert [(r.idx, r.ram, r.storage, r.price_inr) for r in got] == [(0, "8 GB", "256 GB SSD", 69900), (1, "8 GB", "512 GB SSD", 79900)]


def test_identity_keys_worked_out_by_hand(spark):
    """A parent's key keeps a slot for each part; a strong sku names the variant."""
    from hashlib import sha1

    schema = "idx int, brand string, category string, product_family string, model string, sku string, sku_confidence double, ram string, storage string, processor string, display string, os_family string, os_version string, price_inr long, product_url string, name_source string, is_canonical_name boolean"
    rows = [(1, "Apple", "laptop", "MacBook Air", "MacBook Air 13 inch (2024) M3", "AB-1", 0.95, "8 GB", None, None, None, None, None, 61_000, "u1", "catalog_pattern", True), (2, None, None, None, None, None, None, None, None, None, None, None, None, None, "U2", None, None), (3, " acer ", "laptop", None, "Orbit with oled", None, None, None, None, None, None, None, None, 61_000, "u3", None, None)]
    got = {r.idx: r for r in I.catalog_entities(spark.createDataFrame(rows, schema), "idx").collect()}
    name = lambda prefix, key: f"{prefix}_{sha1(key.encode()).hexdigest()[:16]}"
    parent = "apple|laptop|macbook air|macbook air m3"
    assert got[1].parent_product_id == name("pp", parent) and got[1].variant_id == name("var", parent + "|sku|ab-1") and got[1].cluster_id == name("vclu", "sku|apple|ab-1")
    assert got[2].parent_product_id == name("pp", "unknown|u2")
    assert got[3].parent_product_id == name("pp", "acer|laptop|orbit with oled|orbit with oled") and got[3].cluster_id == name("vclu", "fuzzy|acer|orbit|||60k-69k")


def test_templates_by_id_type_and_version(spark):
    from tallyrack.operators import store as S

    templates = spark.createDataFrame([(1, "d", None, "listing", 0.9, 1, 1, False), (2, "d", "f", "listing", 0.2, 1, 2, False), (3, "d", None, "detail", 1.0, 1, 3, False), (4, "d", "f", "listing", 1.0, 1, 4, True)], "template_id long, domain string, page_fingerprint string, page_type string, success_rate double, version int, updated_at int, invalidated boolean")
    pages = spark.createDataFrame([(1, "d", "f", None), (2, "d", "g", None), (3, "d", "f", 3), (4, "d", "f", 4), (5, "x", "f", None)], "page_id long, domain string, fingerprint string, template_id long")
    assert {r.page_id: (r.template_id, r.exact) for r in S.match_templates(pages, templates).collect()} == {1: (2, True), 2: (3, False), 3: (3, False), 4: (None, False), 5: (None, False)}
    assert {r.page_id: r.template_id for r in S.match_templates(pages.drop("template_id"), templates, "listing").collect()} == {1: 2, 2: 1, 3: 2, 4: 2, 5: None}
    saved = spark.createDataFrame([(1, "d", "p", None, 1, 1), (2, "d", "p", None, 7, 2), (3, "d", "p", None, 2, 3), (4, "d", "q", None, None, 4)], "template_id long, domain string, page_type string, page_fingerprint string, version int, at int")
    assert {r.template_id: (r.version, r.parent_template_id) for r in S.version_templates(saved, "at").collect()} == {1: (1, None), 2: (7, 1), 3: (8, 2), 4: (1, None)}
    users = spark.createDataFrame([(1, " A@x.org"), (2, "a@X.org "), (3, "nobody"), (4, "b@x.org")], "user_id long, email string")
    keys = spark.createDataFrame([(i, "h") for i in range(1, 5)], "user_id long, hash string")
    spaces, projects = spark.createDataFrame([(1, 9, 1)], "user_id long, workspace_id long, created_at int"), spark.createDataFrame([(9, 5, 1)], "workspace_id long, project_id long, created_at int")
    assert sorted((r.user_id, r.email, r.project_id or 0) for r in S.accounts(users, keys, spaces, projects).collect()) == [(1, "a@x.org", 5), (4, "b@x.org", 0)]


def test_plans_lines_and_links(spark):
    from hashlib import sha1

    from tallyrack.operators import metrics as M

    key = sha1(b"m|abcd").hexdigest()
    jobs, cache = spark.createDataFrame([(1, "abcd"), (2, "x" * 60), (3, "other")], "job_id int, context string"), spark.createDataFrame([(key,), (key,)], "cache_key string")
    got = {r.job_id: (r.hit, r.warnings) for r in A.label_plan(jobs, cache, "m", 10).collect()}
    assert got == {1: (True, ["ai_planner_cache_hit"]), 2: (False, ["ai_planner_skipped_input_budget"]), 3: (False, [])}
    assert {tuple(r.warnings) for r in A.label_plan(jobs, cache, "m", 10, "ai_insights", has_key=False).collect()} == {("ai_insights_skipped_no_api_key",)}
    pair = spark.createDataFrame([(" ", "h"), ("given", "h"), (None, None)], "a string, b string").select(A.insight_summary(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in pair] == ["h", "given", "No rows available for summarization/classification."]
    log = spark.createDataFrame([("r", "GET", "/x", 200, 1.23456, "", "w")], "request_id string, method string, path string, status int, duration_ms double, trace_id string, workspace_id string")
    assert M.log_lines(log).first().line == '{"request_id":"r","method":"GET","path":"/x","status_code":200,"duration_ms":1.235,"workspace_id":"w"}'
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "job_id int, title string")
    assert M.summary(rows, "job_id", F.lit("listing"), ["title", "price"]).first().summary == "Extracted 2 listing rows with fields: title, price."
    assert E.export_path("/e/", "j", "x", " CSV") == "/e/j/x.csv"
    with pytest.raises(ValueError, match="unsupported"):
        E.export_path("/e", "j", "x", "xml")
    url = E.signed_url("https://a.org/", "x y", "s", 100, 5)
    assert url == f"https://a.org/api/v1/exports/x%20y/download?expires=160&token={E.sign('x y', 160, 's')}"


def test_export_files(spark, tmp_path):
    """Exact files at their places, written again without a trace of the first run, and nothing from a run that fails."""
    rows = [("j1", 2, '{"b": 2.5, "a": "x, \\"y\\"", "deep": {"n": [1, true]}}'), ("j1", 1, '{"a": "é\\nz", "b": null}'), ("j2", 1, '{"on": true}'), ("j3", 1, "{}"), ("j4", 1, '{"gone": 1}')]
    frame = spark.createDataFrame(rows, "job_id string, row_index long, data string").repartition(3)
    exports = spark.createDataFrame([("j1", "e1", None), ("j1", "e2", ["b", " ", "nope"]), ("j2", "e3", []), ("j3", "e4", None), ("nowhere", "e5", None)], "job_id string, export_id string, columns array<string>")
    root = tmp_path / "out"
    want = {
        "csv": {"j1/e1.csv": 'a,b,deep\r\n"é\nz",,\r\n"x, ""y""",2.5,"{""n"": [1, true]}"\r\n', "j1/e2.csv": "b,nope\r\n,\r\n2.5,\r\n", "j2/e3.csv": "on\r\nTrue\r\n", "j3/e4.csv": "\r\n\r\n"},
        "json": {"j1/e1.json": '[{"a":"é\\nz","b":null,"deep":null},{"a":"x, \\"y\\"","b":2.5,"deep":"{\\"n\\": [1, true]}"}]', "j1/e2.json": '[{"b":null,"nope":null},{"b":2.5,"nope":null}]', "j2/e3.json": '[{"on":true}]', "j3/e4.json": "[{}]"},
    }
    for kind in ("csv", "json", "csv"):
        E.export_jobs(frame, exports, str(root), kind)
        assert {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob(f"*.{kind}")} == want[kind]
    assert not list(root.glob(".staging*"))
    broken = frame.unionByName(spark.createDataFrame([("../j9", 1, "{}")], frame.schema))
    with pytest.raises(Exception, match="no file name"):
        E.export_jobs(broken, spark.createDataFrame([("j4", "e9"), ("../j9", "e8")], "job_id string, export_id string"), str(root), "json")
    assert not list(root.rglob("e9.json")) and not list(root.glob(".staging*"))
    with pytest.raises(Exception, match="unsupported"):
        E.export_jobs(frame, exports, str(root), "xml")


def test_labels_are_validated_without_working_names_out_again(spark):
    """A name's expression is there once, and targets come of a window and not of a second join."""
    from tallyrack.queries import queries

    plan = queries()["label_validate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1 and plan.count("Join ") == 1 and "Window" in plan
