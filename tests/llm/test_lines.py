import random
import re
from collections import Counter, defaultdict

from tapisan.llm import lines as repeated
from tapisan.llm.text import lines, words

SCHEMA = "k bigint, body string, url string"


def brute(rows, share, least):
    docs, seen, forms = Counter(), defaultdict(set), []
    for n, (k, body, url) in enumerate(rows):
        m = re.match(r"https?://(?:www\.|m\.)?([^/]+)", url or "", re.I)
        if not m:
            continue
        docs[m[1].lower()] += 1
        for i, x in enumerate(lines(body), 1):
            f = re.sub(r"\d+", "0", " ".join(words(x)))
            forms.append((k, i, m[1].lower(), f))
            seen[m[1].lower(), f].add(k)
    return sorted((k, i) for k, i, s, f in forms if f and len(seen[s, f]) >= max(least, share * docs[s]))


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for k in range(200):
        ls = [r.choice(["Bagikan 12 kali", "BAGIKAN 7 KALI", "Ikuti kanal kami", "© 2025 Situs", "***", f"kalimat unik nomor {r.choice('abcdefghij')}{k}", ""]) for _ in range(r.randrange(0, 8))]
        rows.append((k, r.choice([None, "\r\n".join(ls), "\n\n".join(ls)]), r.choice([None, "", "https://www.a.test/x", "http://A.test/y", "https://b.test/z", "no url"])))
    return rows


def test_same_lines_as_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = repeated.repeated_lines(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as site", "2 as form", "3 as id", "4 as f"), "k", "body", "url")
        assert sorted(map(tuple, got.collect())) == brute(rows, repeated.SHARE, repeated.LEAST)


def test_names_numbers_and_dates_are_one_cluster(spark):
    names = ["Budi", "Sari", "Tono", "Wati", "Joko", "Rina", "Dewi", "Agus", "Lina", "Hadi"]
    rows = [(i, f"Ditulis oleh {n} pada {i + 1} {m} 2025\n\nIsi {' '.join(chr(97 + i) * k for k in range(2, 9))} artikel", "https://a.test/") for i, (n, m) in enumerate(zip(names, ["Januari", "Mei"] * 5))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert repeated.repeated_lines(df, "k", "body", "url").count() == 0
    drop = repeated.repeated_lines(df, "k", "body", "url", exact=False)
    assert sorted(map(tuple, drop.collect())) == [(i, 1) for i in range(10)]
    clean = {r.k: r.body for r in repeated.without_lines(df, "k", "body", drop).collect()}
    assert clean[3].startswith("Isi dd ddd") and len(clean) == 10


def test_clusters_alone_find_every_form_and_lines_without_words(spark):
    rows = [(i, f"{'Ikuti Budi' if i % 2 else 'IKUTI BUDI'} 3 Mei\n***\nunik{chr(97 + i)}", "https://a.test/") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    docs = repeated.document_keys(df, "k", "body", "url").drop("f")
    sites = spark.createDataFrame([("a.test", 10)], "site string, docs bigint")
    assert repeated.hot_clusters(docs, sites, 0.05, 8).count() >= 1
    assert len({r.c[0] for r in docs.collect()}) == 1
    for wordless, want in ((False, [1]), (True, [1, 2])):
        got = repeated.repeated_lines(df, "k", "body", "url", wordless=wordless)
        assert sorted(map(tuple, got.collect())) == [(i, n) for i in range(10) for n in want]


def test_clean_keeps_what_it_should(spark):
    df = spark.createDataFrame([(1, "a\r\n\nb\n\nc\n", None), (2, None, None), (3, "", None), (4, "x\ny", None)], SCHEMA)
    drop = spark.createDataFrame([(1, 2), (2, 1)], "k bigint, line_no int")
    got = {r.k: r.body for r in repeated.without_lines(df, "k", "body", drop).collect()}
    assert got == {1: "a\r\n\nc", 2: None, 3: "", 4: "x\ny"}


def test_empty(spark):
    assert repeated.repeated_lines(spark.createDataFrame([], SCHEMA), "k", "body", "url").count() == 0
