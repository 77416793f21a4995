import datetime as dt

from pyspark.sql import functions as F

from tapisan.functions import html, paragraphs, text, urls
from tapisan.operators import classify, runs, store, validate


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]


def test_text(spark):
    assert one(spark, "<b>Air &amp; gula</b> <script>x</script>&lt;i&gt;baik", text.clean_title) == "Air & gula baik"
    assert one(spark, "“Sehat” — ‘ya’… tidak", text.clean_title) == "\"Sehat\" - 'ya'... tidak"
    assert one(spark, "Home > News > Flu", text.clean_title) == ""
    assert one(spark, "a b ,  c", text.collapse) == "a b, c"
    assert one(spark, "nge-gym, o'neil sehat , ABC", text.clean_category) == "Nge-Gym , O'Neil Sehat , ABC"
    assert one(spark, "Teks yang sama. Teks yang sama.", text.dedupe_sentences) == "Teks yang sama."
    assert one(spark, "Satu kalimat. satu kalimat. Dua.", text.dedupe_sentences) == "Satu kalimat. Dua."
    assert one(spark, " x \t", text.utrim) == "x"
    assert one(spark, "Judul - Situs | Lain", lambda c: text.strip_suffixes(c, [" | Lain", " - Situs"])) == "Judul"
    assert one(spark, "kittén", lambda c: text.similarity(c, F.lit("sitting"))) == 1 - 3 / 7
    assert one(spark, "a" * 120 + ". " + "b" * 600, text.truncate_sentence) == "a" * 120 + "."
    assert one(spark, None, lambda c: text.article_id(c, F.lit(" "))) is None
    assert one(spark, "b,a,B", lambda c: text.distinct_folded(F.split(c, ","))) == ["b", "a"]


def test_urls(spark):
    base = F.lit("https://x.example/a/b?q=1")
    assert one(spark, "/c", lambda c: urls.resolve(c, base)) == "https://x.example/c"
    assert one(spark, "c/../d", lambda c: urls.resolve(c, base)) == "https://x.example/a/d"
    for bad in ("ftp://x.example/a.jpg", "http://localhost/a.jpg", "/a.jpg", "http:///a.jpg"):
        assert one(spark, bad, urls.image_error)
    for good in ("-", "gambar/x.jpg", "HTTPS://x.example/a.jpg"):
        assert one(spark, good, urls.image_error) is None
    assert one(spark, "https://x.example/a.JPG.webp", urls.fixed_image) == "https://x.example/a.JPG"


def test_paragraphs(spark):
    ps = ["• Gejala flu", "• Obat", "Gejala flu adalah demam tinggi.", "Daftar isi:", "pendek", "Ini penting, tuturnya.", "Video cara minum obat", "Video cara minum obat"]
    clean = lambda ps: one(spark, "\n\n".join(ps), lambda c: paragraphs.clean_stored(c))
    assert clean(ps) == ["Gejala flu adalah demam tinggi.", "Ini penting, tuturnya."]
    assert clean(["pendek"]) == ["pendek"]
    assert clean(["empat belas hé"]) == ["empat belas hé"]
    assert one(spark, "Satu dua tiga empat lima.<br>Enam tujuh delapan sembilan.", lambda c: paragraphs.clean_stored(c)) == ["Satu dua tiga empat lima.", "Enam tujuh delapan sembilan."]
    assert one(spark, None, lambda c: paragraphs.clean_stored(c)) is None
    assert paragraphs.without_repeats("Teks yang sama. Teks yang sama.") == "Teks yang sama."


PAGE = """<html><head><title>Flu | Situs</title><meta property="og:image" content="https://x.example/a.jpg"><script type="application/ld+json">{"headline":"H","keywords":["a","b"]}</script></head>
<body><nav><a href="/x">X</a></nav><article><h1>Flu &amp; batuk</h1><p class="linksisip">Lihat juga</p><p>Daftar isi</p><ul><li><a href="#h-1">Gejala</a></li><li><a href="#h-2">Obat</a></li></ul>
<p>Satu<p>Dua <b>tiga<br></b><h2>Beli di toko</h2><p>Promo</p><h2>Kapan harus ke dokter</h2><p>Segera</p><ul><li>Item</ul><h3>Referensi</h3><p>Buku</p></article></body></html>"""


def test_html(spark):
    f = html.fields(PAGE, marks=("linksisip",), rules=html.Sections(promo=("beli di toko",)))
    assert (f["title"], f["title_tier"], f["image_tier"], f["category"]) == ("Flu & batuk", "h1", "og", "a, b")
    assert f["paragraphs"] == ["Flu & batuk", "Satu", "Dua tiga", "Kapan harus ke dokter", "Segera", "• Item"]
    assert one(spark, PAGE, html.links)[0] == "/x"
    assert one(spark, PAGE, lambda c: html.page_fields(c))["title"] == "Flu & batuk"
    assert one(spark, None, lambda c: html.page_fields(c))["title"] is None
    assert html.fields("<div>" * 2000 + "x")["paragraphs"] == []


def test_classifier(spark):
    rules = classify.Rules([("Flu", ["flu", "flu shot"]), ("Pil", ["pill"]), ("Kaf", ["kaf"])], "Umum")
    rules.add("FLU", ["demam"])
    assert rules.categories() == ["Flu", "Pil", "Kaf", "Umum"]
    rows = [(1, "Fluid", "spill"), (2, "x", "a FLU-shot helps"), (3, "pill", "flu flu flu"), (4, "pill", "flu shot demam"), (5, "kafé", None), (6, None, None)]
    got = {r.i: (r.classified.category, r.classified.score) for r in classify.classify(spark.createDataFrame(rows, "i int, t string, b string"), "t", "b", rules).collect()}
    assert got == {1: ("Umum", 0), 2: ("Flu", 3), 3: ("Pil", 3), 4: ("Flu", 4), 5: ("Kaf", 3), 6: ("Umum", 0)}


def test_ties_go_to_the_title_then_the_earlier_rule(spark):
    rules = classify.Rules([("A", ["a b c"]), ("B", ["d"]), ("C", ["d"])])
    df = spark.createDataFrame([("d", "a b c")], "t string, b string")
    assert classify.classify(df, "t", "b", rules).first().classified.category == "B"


def test_validation(spark):
    df = spark.createDataFrame([("", ["x"], None), ("abc", ["x" * 20], None), ("judul", [], "-"), ("judul", ["x" * 4], "-"), ("judul", ["é" * 5], "x"), ("judul", ["é" * 5], None), (None, None, None)], "t string, p array<string>, i string")
    got = [r[0] for r in df.select(validate.first_reason(F.col("t"), F.col("p"), F.col("i"))).collect()]
    assert got == ["empty_title", "short_title", "empty_description", "short_description", "bad_image", None, "empty_title"]


def test_runs_and_store(spark):
    at = lambda s: one(spark, s, lambda c: runs.next_run(c.cast("timestamp"), 1, 0))
    assert at("2026-01-01 17:59:00") == dt.datetime(2026, 1, 1, 18, 0) and at("2026-01-01 18:00:00") == dt.datetime(2026, 1, 2, 18, 0)
    none = spark.createDataFrame([], "ordinal bigint, crawl_session string")
    assert [(r.name, r["count"]) for r in store.sessions(none).collect()] == [("All Crawls", 0)]
    arts = spark.createDataFrame([(1, "", "b"), (2, None, "a"), (3, "2025", "z"), (4, "2026", "z")], "ordinal bigint, scraped_at string, title string")
    assert [r.ordinal for r in arts.orderBy(*store.order_by_time()).collect()] == [4, 3, 2, 1]
    assert [r.ordinal for r in arts.orderBy(*store.order_by_time(False)).collect()] == [3, 4, 2, 1]


def test_contents_and_video_lines(spark):
    import json

    run = lambda f, ps: spark.createDataFrame([(ps,)], "c array<string>").select(f(F.col("c"))).first()[0]
    lead, tail = paragraphs.without_leading_contents, paragraphs.without_trailing_video
    assert run(lead, ["• Gejala flu", "• Obat", "Gejala flu adalah demam.", "• Minum air"]) == ["Gejala flu adalah demam.", "• Minum air"]
    assert run(lead, ["• Gejala", "Demam."]) == ["• Gejala", "Demam."] and run(lead, ["• ab", "ab ab"]) == ["• ab", "ab ab"]
    assert run(lead, [f"• butir {k}x" for k in range(16)] + ["butir 3x"]) == ["• butir 15x", "butir 3x"] and run(lead, []) == []
    assert run(tail, ["a", "Video X", "video x", "VIDEO X"]) == ["a", "Video X"] and run(tail, ["video x"] * 3) == ["video x"]
    assert run(tail, ["Selesai, pungkasnya.", "Video X", "video x"]) == ["Selesai, pungkasnya."]
    assert run(tail, ["Selesai, pungkasnya.", "Video X."]) == ["Selesai, pungkasnya.", "Video X."] and run(tail, []) == []
    assert run(tail, ["a", "b", "b"]) == ["a", "b", "b"]
    for s, want in {"a. A. b. b.": "a. A. b. b.", "Satu kalimat panjang. satu kalimat panjang. Dua.": "Satu kalimat panjang. Dua.", "Teks  yang sama.   Teks  yang sama.": "Teks  yang sama.", "Ulang ulang. Ulang ulang.": "Ulang ulang."}.items():
        assert paragraphs.without_repeats(s) == want, json.dumps(s)


def test_sections_and_contents_of_pages():
    read = lambda x, **k: html.fields(f"<article>{x}</article>", rules=html.Sections(**k))["paragraphs"]
    promo = {"promo": ("beli di toko",)}
    assert read("<p>Satu.</p><h2>Beli di toko kami</h2><p>Murah.</p><p>1. Langkah satu</p><p>Lanjut.</p>", **promo) == ["Satu.", "1. Langkah satu", "Lanjut."]
    assert read("<h3>Referensi</h3><p>Buku A</p><p>1. Buku B</p><h3>Tanda bahaya</h3><p>Sesak.</p>") == ["Tanda bahaya", "Sesak."]
    assert read("<h3>Referensi</h3><h2>Beli di toko</h2><p>Apa ini?</p><p>Buku.</p><h2>Lain</h2>", **promo) == ["Lain"]
    assert read("<p>" + "beli di toko " * 9 + "</p><p>Biasa.</p>", **promo)[-1] == "Biasa."
    assert read("<h2>Daftar Isi:</h2> <ul><li><a href='#h-1'>A</a></li></ul><p><a href='#b'>B</a></p><hr><ul><li>Tetap</li></ul>") == ["• Tetap"]
    assert read("<ul><li><a href='#h-1'>A</a></li><li><a href='/x#heading-2'>B</a></li><li><a href='/y'>C</a></li></ul><p>Isi.</p>") == ["Isi."]
    assert read("<ul><li><a href='#h-1'>A</a></li><li><a href='/y'>C</a></li></ul>") == ["• A", "• C"]
    assert read("<div id='toc'><p>x</p></div><div class='my-article-toc'><p>y</p></div><nav><p>z</p></nav><li>satu<p>dua</p></li><p>Baca juga: x</p>") == ["dua"]
