import random

from tapisan.operators import greedy


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def similar(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else 1 - edits(a, b) / max(len(a), len(b))


def brute(rows, t=0.85):
    from re import sub

    kept, out = [], {}
    for o, title, url in sorted(rows):
        n = sub(r"[^a-z0-9]+", " ", (title or "").lower()).strip()
        u = (url or "").lower().strip()
        clash = any((u and u == v) or n == m or similar(n, m) >= t for m, v in kept)
        out[o] = not clash
        if not clash:
            kept.append((n, u))
    return out


SCHEMA = "ordinal bigint, title string, source_url string"


def test_chain_keeps_both_ends(spark):
    a = "abcdefghijklmnopqrst"
    rows = [(1, a, None), (2, a[:-3] + "xyz", None), (3, a[3:-3] + "xyz123", None)]
    rows = [(1, "aaaaaaaaaa" * 2, None), (2, "aaaaaaaaaa" * 2 + "bbb", None), (3, "aaaaaaaaaa" * 2 + "bbbccc", None)]
    got = {r.ordinal: r.accepted for r in greedy.fuzzy_unique(spark.createDataFrame(rows, SCHEMA), "ordinal", "title", "source_url").collect()}
    assert got == brute(rows) == {1: True, 2: False, 3: True}


def test_refused_rows_block_nothing(spark):
    rows = [(1, "first title", "http://x/a"), (2, "second title", "http://x/a"), (3, "second title", "http://x/b")]
    df = spark.createDataFrame(rows, SCHEMA)
    for f in (greedy.fuzzy_unique, greedy.store_unique):
        assert {r.ordinal: r.accepted for r in f(df, "ordinal", "title", "source_url").collect()} == {1: True, 2: False, 3: True}


def test_random_against_brute_force(spark):
    r = random.Random(3)
    base = ["manfaat air putih untuk ginjal", "gejala flu pada anak", "tips tidur nyenyak", "abc", "ab", "", None]
    rows = []
    for o in range(120):
        t = r.choice(base)
        if t and r.random() < 0.6:
            t = list(t)
            for _ in range(r.randrange(1, 5)):
                t[r.randrange(len(t))] = r.choice("abcxyz ")
            t = "".join(t)
        rows.append((o, t, r.choice([None, "", f"http://x/{r.randrange(60)}"])))
    got = {x.ordinal: x.accepted for x in greedy.fuzzy_unique(spark.createDataFrame(rows, SCHEMA), "ordinal", "title", "source_url").collect()}
    assert got == brute(rows)


def test_similar_titles_misses_none(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 14))) for _ in range(150)]
    got = {(x.t, x.u) for x in greedy.similar_titles(spark.createDataFrame([(w,) for w in words], "t string")).collect()}
    d = sorted(set(words))
    assert got == {(a, b) for i, a in enumerate(d) for b in d[i + 1 :] if similar(a, b) >= 0.85}


def test_merge_and_empty(spark):
    old = spark.createDataFrame([(1, "Air putih", "http://x/a/")], SCHEMA)
    new = spark.createDataFrame([(2, "air putih!", "http://x/z"), (3, "Lain sekali ini", "http://x/A"), (4, "Yang baru datang", None), (5, "Yang baru datang.", None)], SCHEMA)
    assert {r.ordinal: r.accepted for r in greedy.merged(old, new, "ordinal", "title", "source_url").collect()} == {2: False, 3: False, 4: True, 5: False}
    assert greedy.fuzzy_unique(old.limit(0), "ordinal", "title", "source_url").count() == 0


def test_similar_titles_in_parts_and_without_a_shuffle_of_runs(spark, monkeypatch):
    """The texts taken in parts give the same, and a text is sent on a few times, not once for each of its runs."""
    r = random.Random(8)
    base = "".join(r.choice("abcdefghij ") for _ in range(60))
    edited = lambda: "".join(r.choice("xyz") if r.random() < 0.06 else c for c in base)
    rows = [(edited(),) for _ in range(80)]
    d = sorted({t for t, in rows})
    monkeypatch.setattr(greedy, "PART", 30)
    got = {(x.t, x.u) for x in greedy.similar_titles(spark.createDataFrame(rows, "t string")).collect()}
    assert got == {(a, b) for i, a in enumerate(d) for b in d[i + 1 :] if similar(a, b) >= 0.85} and got
    seen, real = {}, greedy.written
    monkeypatch.setattr(greedy, "written", lambda df, name: (lambda x: (seen.update({name: max(x.count(), seen.get(name, 0))}), x)[1])(real(df, name)))
    greedy.similar_titles(spark.createDataFrame([(f"{k} {base}{k * k}",) for k in range(0, 900, 7)], "t string"))
    assert max(n for name, n in seen.items() if name not in ("near", "similar")) <= 130
