"""The DOM pass and the listing extractor on pages written here."""

from tallyrack.operators import extract as X
from tallyrack.operators import paginate as P
from tallyrack.operators import store
from tallyrack.operators import template as T
from tallyrack.sources import dom
from tallyrack.sources.selectors import Page, select

CARD = '<article class="card"><h2><a href="/p/{0}">Fine Desk Lamp {0}</a></h2><span class="price">$1,{0}9.99</span><div class="stars">Rated 4.{0}/5</div><p>12 reviews. In stock now</p></article>'


def page(cards, tail=""):
    return f'<html><body><header><nav class="menu"><a href="/home">Home</a><a href="/about">About</a></nav></header><main>{"".join(CARD.format(c) for c in cards)}</main>{tail}<script>var a="<p>no</p>";</script></body></html>'


def test_tree():
    tree = dom.Tree("<div id=a class='x y'><p>one <b>two</b><p>three</div></span><br/>four<style>no</style>")
    div = tree.nodes[0]
    assert dom.text(div) == "one two three" and dom.text(tree.root) == "one two three four"
    for css, n in (("div p", 2), ("div > p", 1), ("#a.x b", 1), ("[class~=y]", 1), ("b, br", 2), ("p > p", 1), ("*", 5 + 1), (".z", 0)):
        assert len(select(Page(tree), tree.root, css)) == n, css


def test_listings(spark):
    base = "https://shop.example.com/list?page=1"
    htmls = [page([1, 2, 3]), page([1, 1, 2]), "", None, page([]), "<a href='/x/item/1'>A very long product name</a><a href='/'>Home</a>"]
    pages = spark.createDataFrame([(i, base, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = {}
    for r in X.listing_rows(dom.parse_pages(pages), max_rows=3).orderBy("page_id", "idx").collect():
        got.setdefault(r.page_id, []).append(r)
    assert [(r.title, r.price, r.rating, r.review_count, r.availability, r.product_url) for r in got[0]] == [(f"Fine Desk Lamp {i}", f"$1,{i}9.99", f"4.{i}", 12, "in stock", f"https://shop.example.com/p/{i}") for i in (1, 2, 3)]
    assert len(got[1]) == 2 and got.keys() == {0, 1, 5}
    assert [(r.title, r.product_url) for r in got[5]] == [("A very long product name", "https://shop.example.com/x/item/1")]


def test_next_pages_and_crawl(spark):
    data = [(1, "https://s.example.com/a?page=1", page([1, 2], '<a class="more" href="/a?page=2">Load more</a>')), (2, "https://s.example.com/a?page=2", page([2, 3], '<div class="pager"><a href="?page=3">2</a></div>')), (3, "https://s.example.com/a?page=3", page([2, 3], '<link rel="next" href="/a?page=1">')), (4, "https://t.example.com/x", "<p>nothing</p>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    parsed = dom.parse_pages(pages)
    following = {r.page_id: (r.next_url, r["mode"]) for r in P.next_pages(parsed, pages).collect()}
    assert following == {1: ("https://s.example.com/a?page=2", "load_more"), 2: ("https://s.example.com/a?page=3", "infinite"), 3: ("https://s.example.com/a?page=1", "link_rel_next"), 4: (None, None)}
    starts = spark.createDataFrame([(7, data[0][1])], "job_id long, url string")
    visits = P.chains(starts, P.next_pages(parsed, pages), 10)
    assert sorted(r.page_no for r in visits.collect()) == [1, 2, 3]
    out = P.crawl(visits.join(pages.select("url", "page_id"), "url"), X.listing_rows(parsed), ["title", "product_url"], 50).orderBy("row_index").collect()
    assert [r.title[-1] for r in out] == ["1", "2", "3"] and out[0].pages == 2 and out[0].partial and out[0].stop == "repeated_page_signature_detected"


def test_template_rows(spark):
    base = "https://s.example.com/x/list"
    twice = '<article class="card big"><h2><a href="../q/2">B</a></h2><i class="mrp">now EUR 5.50 each</i><b>Rated 4,5 stars</b></article>'
    pages = spark.createDataFrame([(1, base, page([1, 2])), (2, base, "<p></p>"), (3, base, twice + twice.upper().replace("ARTICLE CLASS", "article class").replace("CARD BIG", "card big")), (4, base, '<article class="card"></article>'), (5, None, None)], "page_id long, url string, html string")
    fields = {"name": "h2", "link": "h2 > a@href", "cls": "@class", "no": ".none", "bad": "a:hover", "price": ".mrp", "stars": "b"}
    got = {}
    for r in T.template_rows(pages, T.Template("article.card", fields), 5).orderBy("page_id", "idx").collect():
        got.setdefault(r.page_id, []).append((r["values"], r.warning))
    one = got[1][0][0]
    assert one == {"name": "Fine Desk Lamp 1", "link": "https://s.example.com/p/1", "cls": "['card']", "no": "", "bad": "", "price": "", "stars": ""} and len(got[1]) == 2
    assert (got[3][0][0]["link"], got[3][0][0]["price"], got[3][0][0]["stars"], got[3][0][0]["cls"]) == ("https://s.example.com/q/2", "EUR 5.50", "4.5", "['card', 'big']")
    warned = {k: v[0][1] for k, v in got.items() if v[0][1]}
    assert warned == {2: "template_container_not_found", 5: "template_container_not_found"}
    bare = T.template_rows(pages, T.Template("article.card", {"no": ".none"}), 5).collect()
    assert {r.page_id: r.warning for r in bare} == {1: "template_rows_empty", 2: "template_container_not_found", 3: "template_rows_empty", 4: "template_rows_empty", 5: "template_container_not_found"}
    assert {r.warning for r in T.template_rows(pages, T.Template("a[", {"x": "b"}), 5).collect()} == {"template_selector_invalid"}
    assert {r.warning for r in T.template_rows(pages, T.Template(" ", {"x": "b"}), 5).collect()} == {"template_invalid_structure"}
    assert T.Template(None, {}, " li ").container == "li"
    many = spark.createDataFrame([(1, base, "".join(f"<li>{i // 2}</li>" for i in range(40)))], "page_id long, url string, html string")
    assert [r.idx for r in T.template_rows(many, T.Template("li", {"v": "@x"} | {"t": ""}), 10).orderBy("idx").collect()] == [0, 2, 4, 6, 8]
    assert T.field_infos(T.Template("a", {"product_url": "", "MRP": "", "stars": "", "name": ""})) == [("product_url", "url", 0.95), ("MRP", "money", 0.95), ("stars", "rating", 0.95), ("name", "text", 0.9)]


def test_template_next(spark):
    base = "https://s.example.com/x/list?p=1"
    htmls = ['<a class="n" href="../y">go</a>', '<button class="n" data-url=" ?p=2 ">', '<b class="n">', "<p>", None]
    pages = spark.createDataFrame([(i, base, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    of = lambda **k: {r.page_id: (r.next_url, r.warning) for r in T.template_next(pages, T.Template("a", {"a": "a"}, **k)).collect()}
    used, lost, none = "template_pagination_next_used", "template_pagination_not_found", (None, "template_pagination_no_url")
    assert of(next_selector=".n", next_type="Next") == {0: ("https://s.example.com/y", used), 1: ("https://s.example.com/x/list?p=2", used), 2: none, 3: (None, lost), 4: (None, lost)}
    assert of(next_selector=".n")[0] == ("https://s.example.com/y", None)
    assert set(of(next_selector="a[").values()) == {(None, "template_pagination_selector_invalid")}
    assert set(of().values()) == {(None, None)}


def listing(rows, tag="article", cls="tile", money="sale", words="{} out of 5 stars", head="h2", tail=""):
    cards = "".join(f'<{tag} class="{cls}"><a href="{href}"><{head}>{title}</{head}></a><div class="{money}">{price}</div><em class="stars">{words.format(rating)}</em></{tag}>' for title, href, price, rating in rows)
    top = '<header><h3>Corner</h3><nav><a href="/new">New in</a><a href="/help">Help desk</a></nav></header>'
    return f"<html><body>{top}<main><section class='found'>{cards}</section>{tail}</main></body></html>"


def test_golden_listings(spark):
    """Three listing shapes on pages of our own: symbol prices, code prices in a class that hints
    at nothing, Indian grouping; ratings out of five in three spellings."""
    shop = [(f"Harbor Boots {i}", f"/item/boots-{i}", f"${i}9.50", f"4.{i}") for i in (1, 2, 3)]
    jobs = [("Senior Rust Developer", "/jobs/r-1", "USD 130,000", "4.2"), ("Data Platform Lead", "/jobs/r-2", "USD 99,500", "4.0"), ("Cloud Build Engineer", "/jobs/r-3", "USD 101,000", "4.5")]
    homes = [("2 BHK Villa - Lakeside", "/listing/v-1", "INR 75,00,000", "4.5"), ("Studio - Old Town", "/listing/v-2", "INR 1,12,00,000", "4.1"), ("Loft - Harbor Road", "/listing/v-3", "INR 48,00,000", "4.3")]
    cases = {
        "https://shop.example.com/search?q=x": (shop, listing(shop)),
        "https://jobs.example.com/rust": (jobs, listing(jobs, cls="opening", money="pay", words="Staff give it {}/5 so far")),
        "https://homes.example.in/search?city=x": (homes, listing(homes, "li", "home", words="{}/5 for the street", head="h3").replace("<section", "<ul").replace("</section", "</ul")),
    }
    pages = spark.createDataFrame([(i, url, html) for i, (url, (_, html)) in enumerate(cases.items())], "page_id long, url string, html string")
    got = {}
    for r in X.listing_rows(dom.parse_pages(pages), 10).orderBy("page_id", "idx").collect():
        got.setdefault(r.page_id, []).append((r.title, r.price, r.rating, r.product_url))
    for i, (url, (rows, _)) in enumerate(cases.items()):
        host = "/".join(url.split("/")[:3])
        assert got[i] == [(t, p, r.removesuffix(".0"), host + h) for t, h, p, r in rows]


def test_golden_crawls(spark):
    """Two crawls: a load-more link, and a next button whose second page has a single card."""
    from tallyrack.plans import runs

    tents = [(f"Summit Tarp {i}", f"/product/{200 + i}", f"${i}29.00", f"4.{i}") for i in (1, 2, 3, 4)]
    data = [
        (1, "https://shop.example.com/catalog?page=1", listing(tents[:2], tail='<a class="more" href="/catalog?page=2">Load more tarps</a>')), (2, "https://shop.example.com/catalog?page=2", listing(tents[2:])),
        (3, "https://market.example.com/browse?page=1", listing(tents[:2], tail='<div class="pager"><a href="/browse?page=2">Next</a></div>')), (4, "https://market.example.com/browse?page=2", listing(tents[2:3])),
        (5, "https://loop.example.com/a", listing(tents[:2], tail='<a href="/b">Next</a>')), (6, "https://loop.example.com/b", listing(tents[2:], tail='<a href="/a">Next</a>')),
        (7, "https://gone.example.com/a", listing(tents[:2], tail='<a href="/none">Next</a>')),
        (8, "https://same.example.com/a", listing(tents[:2], tail='<a href="/b">Next</a>')), (9, "https://same.example.com/b", listing(tents[:2])),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    starts = spark.createDataFrame([(k, data[i][1]) for k, i in (("more", 0), ("next", 2), ("loop", 4), ("gone", 6), ("same", 7))], "job_id string, url string")
    got = {r.job_id: r for r in runs.run_jobs(starts, pages, "title, price, rating and url", runs.Limits(20, 5)).collect()}
    row = lambda r: (r.title, r.price, r.rating, r.product_url.split("/")[-1])
    want = [(t, p, s, h.split("/")[-1]) for t, h, p, s in tents]
    state = {k: (len(r.rows), r.pages, r.partial, r.warnings) for k, r in got.items()}
    assert [row(r) for r in got["more"].rows] == want and state["more"] == (4, 2, False, ["pagination_load_more_detected"])
    assert [row(r) for r in got["next"].rows] == want[:3] and state["next"][1:3] == (2, False) and "pagination_next_detected" in state["next"][3]
    assert state["loop"] == (4, 2, False, ["pagination_next_detected", "repeated_page_detected"])
    assert state["gone"] == (2, 1, True, ["pagination_next_detected", "page_load_failed"])
    assert state["same"] == (2, 1, True, ["pagination_next_detected", "repeated_page_signature_detected"])


def test_template_crawl(spark):
    """A template's next page first; the general rules where it finds none; a repeated page makes it partial."""
    from tallyrack.plans import runs

    li = lambda *names: "".join(f"<li><b>{n}</b></li>" for n in names)
    data = [(1, "https://t.example.com/1", li("a", "b") + '<a id="on" href="/2">x</a>'), (2, "https://t.example.com/2", li("c") + '<a href="/3">Next</a>'), (3, "https://t.example.com/3", li("d") + '<a id="on" href="/1">x</a>'), (4, "https://t.example.com/4", "<p>nothing</p>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    starts = spark.createDataFrame([(1, data[0][1]), (2, data[3][1])], "job_id int, url string")
    template = T.Template("li", {"name": "b"}, next_selector="#on", next_type="next")
    got = {r.job_id: r for r in runs.run_jobs(starts, pages, "", runs.Limits(20, 5), template).collect()}
    used = "template_pagination_next_used"
    assert [r.name for r in got[1].rows] == ["a", "b", "c", "d"] and (got[1].pages, got[1].partial) == (3, True)
    assert got[1].warnings == [used, "template_pagination_not_found", "template_pagination_fallback_used", "pagination_next_detected", used, "repeated_page_detected"]
    assert got[2].rows == [] and got[2].warnings == ["template_container_not_found", "page_yield_low", "template_pagination_not_found", "template_rows_empty"]


def test_other_fields(spark):
    """A field that has no rule of its own is the title, the address or the start of the text, by its name."""
    pages = spark.createDataFrame([(1, "https://s.example.com/a", page([1, 2]))], "page_id long, url string, html string")
    got = X.listing_rows(dom.parse_pages(pages), 10, X.with_defaults(["name", "deep_link", "colour"])).orderBy("idx").first()
    assert (got.name, got.deep_link) == ("Fine Desk Lamp 1", "https://s.example.com/p/1") and got.colour.startswith("Fine Desk Lamp 1 $1,19.99")


def test_preview_and_run(spark):
    from tallyrack.plans import runs

    data = [(1, "https://s.example.com/a?page=1", page([1, 2], '<a class="more" href="/a?page=2">Load more</a>')), (2, "https://s.example.com/a?page=2", page([2, 3]))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    rows, summary = runs.preview(pages, "title and price please", 10)
    assert rows.columns == ["page_id", "idx", "title", "price"] and rows.count() == 4
    assert {r.page_id: (r.rows, r.page_type) for r in summary.collect()} == {1: (2, "listing"), 2: (2, "listing")}
    got = runs.run(spark.createDataFrame([(7, data[0][1])], "job_id long, url string"), pages, "title, price").orderBy("row_index").collect()
    assert [(r.row_index, r.title[-1], r.pages, r.partial) for r in got] == [(1, "1", 2, False), (2, "2", 2, False), (3, "3", 2, False)]


def test_template_values_past_the_tenth_container(spark):
    html = "".join(f"<article><h1>t{i}</h1><p>x</p></article>" for i in range(30))
    pages = spark.createDataFrame([(1, "https://a.com", html)], "page_id long, url string, html string")
    assert sorted(r.idx for r in T.template_rows(pages, T.Template("article", {"title": "h1", "first": "p"}), 5000).collect()) == list(range(30))


def test_dot_segments(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    from tallyrack.functions import urls as U
    from tallyrack.functions.dialect import SPARK

    base = "https://a.com/x/y?z"
    refs = ["../b", "./c", "/p/./q/../r", "..", ".", "../../../k", "d/..", "e/../f?g=../h", "https://a.com/i/../j", "//b.com/k/../l", "m..n", ""]
    df = spark.createDataFrame([(i, base, r) for i, r in enumerate(refs)], "i int, url string, ref string").withColumn("u", F.expr(U.join(SPARK, "url", "ref")))
    assert [r.v for r in df.select("i", X.resolved(F.col("u"), F.col("ref")).alias("v")).orderBy("i").collect()] == [urljoin(base, r) for r in refs]


def test_dispatch_by_data(spark):
    """Jobs of two templates and none, a crawl that leaves its domain, a template that was asked for, jobs that are over,
    and a template that finds nothing."""
    from tallyrack.plans import runs as N

    def shop(n, tail):
        return f'<ul>{"".join(f"<li class=it><b>Thing {k}</b><i>${k}.50</i></li>" for k in n)}</ul>{tail}'

    pages = [
        (1, "https://a.example.com/1", shop([1, 2], '<a id=more href="https://b.example.com/2">go</a>')), (2, "https://b.example.com/2", shop([2, 3], "")),
        (3, "https://c.example.com/1", page([1, 2], '<a class="more" href="/2">Load more</a>')), (4, "https://c.example.com/2", page([3, 4])), (5, "https://d.example.com/1", page([7, 8])),
    ]
    templates = [
        ("ta", 2, "a.example.com", None, "listing", 0.5, 1, False, "li.it", {"name": "b", "price": "i"}, "#more", "Next"), ("tc", 1, "c.example.com", "other", "listing", 0.5, 1, True, "li", {"name": "b"}, None, ""),
        ("td", 5, "d.example.com", None, "listing", 0.5, 1, False, "table", {"name": "b"}, None, ""), ("tx", 1, "x.example.com", None, "listing", 0.5, 1, False, "article.card", {"title": "h2", "price": ".price"}, "a.more", ""),
    ]
    kind = "template_id string, version int, domain string, page_fingerprint string, page_type string, success_rate double, updated_at int, invalidated boolean, container string, fields map<string,string>, next string, next_type string"
    jobs = [("j1", pages[0][1], None, "queued", False), ("j2", pages[2][1], None, None, None), ("j3", pages[2][1], "tx", "failed", False), ("j4", pages[4][1], None, "queued", False), ("j5", pages[0][1], None, "success", False), ("j6", pages[0][1], None, "cancelled", True), ("j7", "https://e.example.com/", None, "queued", False)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    done = N.dispatch_jobs(spark.createDataFrame(jobs, "job_id string, url string, template_id string, status string, force boolean"), frame, spark.createDataFrame(templates, kind), "title and price", N.Limits(50, 5))
    got = {r.job_id: r for r in done.collect()}
    assert got.keys() == {"j1", "j2", "j3", "j4", "j6", "j7"}
    lamp = lambda *n: [{"title": f"Fine Desk Lamp {k}", "price": f"$1,{k}9.99"} for k in n]
    assert [dict(r) for r in got["j1"].rows] == [{"name": f"Thing {k}", "price": f"${k}.50"} for k in (1, 2, 3)] and got["j1"].by_template and got["j1"].status == "success" and got["j1"].pages == 2
    assert got["j1"].warnings == got["j6"].warnings == ["template_matched:ta", "template_version:2", "template_pagination_next_used", "template_pagination_not_found"]
    assert [{k: r[k] for k in ("title", "price")} for r in got["j2"].rows] == lamp(1, 2, 3, 4) and got["j2"].template_id is None and got["j2"].warnings == ["pagination_load_more_detected"]
    assert [dict(r) for r in got["j3"].rows] == lamp(1, 2, 3, 4) and got["j3"].template_id == "tx" and got["j3"].warnings == ["template_matched:tx", "template_version:1", "template_pagination_not_found"]
    assert [{k: r[k] for k in ("title", "price")} for r in got["j4"].rows] == lamp(7, 8) and not got["j4"].by_template
    assert got["j4"].warnings == ["template_matched:td", "template_version:5", "template_container_not_found", "page_yield_low", "template_rows_empty"]
    assert got["j7"].rows == [] and got["j7"].warnings == ["page_load_failed"] and not got["j7"].partial
    health = {r.template_id: (r.success_count, r.failure_count) for r in store.template_health(N.template_outcomes(done), "template_id", "job_id").collect()}
    assert health == {"ta": (2, 0), "tx": (1, 0), "td": (0, 1)}


def test_catalog_of_jobs(spark):
    """Each job's rows become its own catalog, with what was done among its warnings."""
    from tallyrack.plans import runs as N

    offer = lambda n, price: {"title": f"Apple MacBook Air M{n} (8 GB/256 GB SSD)", "price": price, "product_url": f"https://s.example.com/apple-macbook-air/p/itm{n}"}
    rows = [("a", [offer(2, "₹99,990"), offer(2, "₹98,000"), offer(3, "₹120,000")], ["x"]), ("b", [offer(2, "₹97,000")], []), ("c", [], ["extraction_empty"])]
    done = spark.createDataFrame(rows, "job_id string, rows array<map<string,string>>, warnings array<string>")
    prompt = "brand, category, model, ram, storage, price_inr and product_url"
    found, jobs = N.catalog_of(done, prompt, "2024-01-01T00:00:00Z")
    assert {r.job_id: r.warnings for r in jobs.collect()} == {"a": ["x", "structured_product_schema_applied", "structured_product_rows_deduped"], "b": ["structured_product_schema_applied"], "c": ["extraction_empty"]}
    got = sorted((r.job_id, r.row_index, r.model, r.ram, r.storage, r.price_inr) for r in found.collect())
    assert [g[:2] for g in got] == [("a", 1), ("a", 3), ("b", 1)] and [g[5] for g in got] == [99990, 120000, 97000] and all(g[3:5] == ("8 GB", "256 GB SSD") for g in got), got
    plain, _ = N.catalog_of(done, "title, price", None)
    assert plain.count() == 4


def test_few_pages_are_parsed_on_all_partitions(spark):
    """Pages that come in one partition, as small tables do, are spread before they are parsed; jobs before they are folded."""
    from tallyrack.plans.lineage import spread
    from tallyrack.sources import dom

    pages = spark.createDataFrame([(i, f"https://e.example.com/{i}", f"<p>{i}</p>") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    read = dom.read_pages(pages)
    assert read.rdd.getNumPartitions() == spread(pages, "page_id").rdd.getNumPartitions() > 1
    assert sorted((r.page_id, r.text) for r in read.collect()) == [(i, str(i)) for i in range(40)]
