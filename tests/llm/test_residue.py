import pytest

from tapisan.llm import residue

REAL = "Obat ini hanya boleh diminum sebelum tidur supaya tekanan darah tidak makin berat."


def sure(text):
    """What the grammar and the trusted rules alone say of a text."""
    if text and residue.has_placeholder(text):
        return "placeholder"
    kinds = [residue.trusted(p) for p in residue.pieces(text)]
    return max(kinds) if kinds and all(kinds) else None


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"{REAL}\n\nHalo {{{{ nama_pasien }}}}, jadwal Anda jatuh pada Senin.", "placeholder"),
        ("x " * 30_000 + "${dosis_mg} akhir", "placeholder"),
        ("Take [[ARTICLE_TITLE]] twice.", "placeholder"),
        ("Take &lt;INSERT TEXT&gt; twice.", "placeholder"),
        ("Minum %TULIS ISI DI SINI% dua kali.", "placeholder"),
        ("Artikel __tanggal__ ditulis oleh ~penulis.depan~.", "placeholder"),
        ("Petugas diminta mengganti {{nama}} dengan nama pasien sebelum mencetak.", None),
        ("Naik 5% dan 10% tahun ini; lihat [1] dan <b>ini</b>.", None),
        ("404: Halaman tidak ditemukan", "message"),
        ('{"status": 500, "message": "Your session has expired, please sign in once more.", "trace": "ab12"}', "message"),
        ("<html><body><h1>Info Zizai</h1><p>Too many requests from your network.</body></html>", "message"),
        ("Situs ini tidak berfungsi tanpa JavaScript.\n© 2025 X.", "message"),
        ("Confirme que no es un robot y permita los scripts.", "message"),
        ("Ruang 500 tidak ditemukan oleh banyak pengunjung karena papan nama rumah sakit kecil.", None),
        ("The patient portal once showed an error 500 message, so the team opened a phone line.", None),
        (f"404: Halaman tidak ditemukan\n{REAL}", None),
        ("Contoh teks contoh teks xyz. Ini hanya teks pengganti, jangan diterbitkan abc.", "filler"),
        (REAL, None),
        ("", None),
        (None, None),
        (" \n ", None),
    ],
)
def test_rules(text, kind):
    assert sure(text) == kind


def test_labels_run_through_components(spark):
    known = "Aktifkan skrip di peramban Anda untuk memuat artikel ini."
    chain = ["Nyalakan skrip di peramban Anda untuk memuat artikel ini.", "Nyalakan skrip di peramban Anda untuk membuka artikel ini.", "Izinkan skrip di peramban Anda untuk membuka artikel ini.", "Izinkan skripnya di peramban Anda untuk membuka artikel ini."]
    after = "Lalu muat ulang."
    far = "Nyalakan lampu di ruang tamu Anda sebelum membuka tirai."
    rows = [(1, known), (2, f"{chain[0]} {after}"), (3, chain[1]), (4, f"{chain[2]}\n© 2025 X"), (5, f"{chain[3]} {after}"), (6, chain[3]), (7, far), (8, f"{known} {REAL} {REAL} {far}"), (9, None), (10, after)]
    df = spark.createDataFrame(rows, "d bigint, text string").selectExpr("*", "1 as id", "2 as kind", "3 as h")
    got = {r.d: (r.kind, r.trusted) for r in residue.residue(df, "d", "text").collect()}
    assert got == {1: ("message", True)} | {k: ("message", False) for k in (2, 3, 4, 5, 6, 10)}
    # without the trusted member the component isn't walked
    assert residue.residue(df.filter("d != 1 and d != 8"), "d", "text").count() == 0


def test_mock_latin_is_fitted(spark):
    rows = [(1, "Lorem ipsum quam norem velit. Oculis norem quam."), (2, "Ipsum norem oculis quam velit lorem."), (3, "Velit quam norem."), (4, "Lorem Ipsum is the name of the filler that printers use."), (5, REAL)]
    df = spark.createDataFrame(rows, "d bigint, text string")
    assert {"norem", "quam", "velit"} <= residue.latin_words(df, "d", "text") and "the" not in residue.latin_words(df, "d", "text")
    assert {r.d for r in residue.residue(df, "d", "text").collect()} == {1, 2, 3}


def test_links_against_brute_force(spark):
    """Of the pieces that brute force over all pairs reaches from trusted ones, the tables reach at least nine in ten."""
    import random

    r = random.Random(5)
    first, browser, verb, what = ["Aktifkan", "Nyalakan", "Hidupkan", "Izinkan", "Mohon izinkan"], ["peramban Anda", "browser Anda", "pelayar Anda"], ["memuat", "membuka", "membaca", "melihat"], ["artikel ini", "halaman ini", "tulisan ini"]
    texts = sorted({f"{r.choice(first)} skrip di {r.choice(browser)} untuk {r.choice(verb)} {r.choice(what)}" for _ in range(120)})
    df = spark.createDataFrame(list(enumerate(texts)), "d bigint, text string")
    sets = [set(residue.runs(residue.masked(t)).tolist()) for t in texts]
    reached = {i for i, t in enumerate(texts) if residue.trusted(residue.masked(t))}
    n_sure, more = len(reached), True
    while more:
        more = {j for j in range(len(texts)) if j not in reached and any(len(sets[i] & sets[j]) >= residue.SIMILAR * len(sets[i] | sets[j]) for i in reached)}
        reached |= more
    got = {x.d for x in residue.residue(df, "d", "text").collect()}
    assert got <= reached and len(reached) > 2 * n_sure and len(got) >= 0.9 * len(reached)


def test_clean_and_empty(spark):
    df = spark.createDataFrame([(1, "404: Halaman tidak ditemukan"), (2, REAL)], "d bigint, text string")
    assert [r.d for r in residue.without_residue(df, "d", residue.residue(df, "d", "text")).collect()] == [2]
    assert residue.residue(df.limit(0), "d", "text").count() == 0


def test_middle_pieces_label_and_link(spark):
    """A document whose ends say nothing is residue if a labelled piece between them is a third of it; such a piece also links others."""
    message = "Aktifkan skrip di peramban Anda untuk memuat artikel ini"
    rows = [(1, f"Selamat siang.\n{message}.\nSalam hangat."), (2, f"{REAL} {REAL[:40]}\n{message}.\n{REAL} Warga {REAL.lower()}")]
    assert {r.d for r in residue.residue(spark.createDataFrame(rows, "d bigint, text string"), "d", "text").collect()} == {1}


def test_parts_give_the_same(spark, monkeypatch):
    """Labelled pieces taken in many small parts, and nothing broadcast, link the same."""
    rows = [(k, f"{a} skrip di {b} Anda untuk {c} artikel ini.") for k, (a, b, c) in enumerate((a, b, c) for a in ("Aktifkan", "Nyalakan", "Izinkan") for b in ("peramban", "pelayar") for c in ("memuat", "membuka", "melihat"))]
    df = spark.createDataFrame(rows, "d bigint, text string")
    want = {tuple(r) for r in residue.residue(df, "d", "text").collect()}
    monkeypatch.setattr(residue, "PART", 2)
    monkeypatch.setattr(residue.small, "__defaults__", (0,))
    assert {tuple(r) for r in residue.residue(df, "d", "text").collect()} == want and len(want) > 9


def test_fingerprints_are_majorities():
    own = ["a", "", "aktifkan skrip di peramban anda", "x" * 300, "señal 😀 de página", *("kata " * k + "akhir" for k in range(1, 40))]
    prints, n = residue.simhashes(own)
    for p, got, m in zip(own, prints, n.tolist()):
        t = f" {p} ".ljust(residue.RUN)
        votes = [[0] * 64, [0] * 64]
        for k in range(len(t) - residue.RUN + 1):
            h = residue.xxhash.xxh32_intdigest(t[k : k + residue.RUN])
            for w, v in enumerate(votes):
                bits = int(residue.mixed(residue.np.array([(h + w * 2**32) % 2**64], residue.np.uint64))[0])
                for i in range(64):
                    v[i] += bits >> i & 1
        assert m == len(t) - residue.RUN + 1
        assert [int(x) % 2**64 for x in got] == [sum((2 * v[i] > m) << i for i in range(64)) for v in votes]
