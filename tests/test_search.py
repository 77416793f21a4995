import pytest

from tapisan.operators import discovery, search

SITE = search.Site(discovery.SiteRules("x.test", r"^/a/.+"), general=("https://x.test/list?p={page}",), topical=("https://x.test/s?q={q}&p={page}", "https://x.test/"), pages=4)
LINK = '<a href="/a/{0}">x</a>'


def listings(spark, pages, tier=0):
    return spark.createDataFrame([(tier, n, f"https://x.test/list?p={n}", None if p is None else "".join(LINK.format(s) for s in p)) for n, p in pages.items()], "tier int, page int, url string, html string")


def found(spark, pages, site=SITE, most=None):
    p = listings(spark, pages)
    return [r.url.rsplit("/", 1)[-1] for r in search.paged(search.links_of(p, site), p, site, most).orderBy("tier", "page", "place").collect()]


def test_paging_stops(spark):
    assert found(spark, {1: "ab", 2: "bc", 3: "d"}) == list("abcd")
    assert found(spark, {1: "ab", 2: "ab", 3: "c"}) == list("ab")  # a page that adds nothing
    assert found(spark, {1: "ab", 2: "", 3: "c"}) == list("ab")  # an empty page
    assert found(spark, {1: "ab", 2: None, 3: "c"}) == list("ab")  # a page that failed
    assert found(spark, {1: "ab", 3: "c"}) == list("ab")  # a page that was not fetched
    assert found(spark, {1: "a", 2: "A", 3: "b"}) == list("a")  # the same address in another case
    later = search.Site(SITE.rules, stop_without_new=2)
    assert found(spark, {1: "ab", 2: "ab", 3: "c", 4: "c", 5: "c", 6: "d"}, later) == list("abc")
    least = search.Site(SITE.rules, least_pages=3)
    assert found(spark, {1: "ab", 2: "ab", 3: "c"}, least) == list("abc")
    assert found(spark, {1: "abc", 2: "de"}, most=4) == list("abcd")
    assert found(spark, {}) == []


def test_addresses_of_listings(spark):
    rows = search.addresses(spark, SITE, "flu burung").orderBy("tier", "page").collect()
    assert [r.url for r in rows] == [f"https://x.test/s?q=flu+burung&p={n}" for n in range(1, 5)] + ["https://x.test/"]
    assert search.addresses(spark, SITE, "health").count() == 4
    with pytest.raises(ValueError):
        search.addresses(spark, search.Site(SITE.rules, topical=("https://x.test/{q}",)), " ")


def test_search(spark):
    pages = listings(spark, {1: ["flu-satu", "batuk"], 2: ["flu-dua", "flu-kosong", "flu-hilang", "flu-mati"]})
    page = "<article><h1>{0}</h1><p>Isi tentang {0}.</p></article>"
    html = {"flu-satu": page.format("Flu satu"), "batuk": page.format("Batuk"), "flu-dua": page.format("Flu dua"), "flu-kosong": "<h1>Flu</h1><article></article>", "flu-hilang": page.format("404"), "flu-mati": None, "lain": page.format("Lain")}
    articles = spark.createDataFrame([(f"https://x.test/a/{k}", v) for k, v in html.items()], "url string, html string")
    titles = lambda q, **k: [r.title for r in search.search(pages, articles, SITE, q, **k).orderBy("place").collect()]
    assert titles("flu") == ["Flu satu", "Flu dua"] and titles("general") == ["Flu satu", "Batuk", "Flu dua"]
    assert titles("general", most=2) == ["Flu satu", "Batuk"] and titles("https://x.test/a/lain") == ["Lain"] and titles("https://y.test/a/lain") == []
    assert search.tokens("di flu burung") == ["flu", "burung"] and search.tokens("tb") == ["tb"]


def test_state_scripts(spark):
    page = '<script id="s" type="application/json">{&q;k&q;:{&q;b&q;:{&q;result&q;:[{&q;slug&q;:&q;demam&q;},{&q;slug&q;:&q;tag/x&q;},{&q;slug&q;:&q;demam&q;},{}]}},&q;n&q;:{&q;b&q;:7}}</script>'
    df = spark.createDataFrame([(page,), ('<script id="s">{broken</script>',), ("<p>",), (None,)], "p string")
    assert [r[0] for r in df.select(search.state_results(df.p, "s")).collect()] == [["demam"], None, None, None]
