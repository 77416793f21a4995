import random

from tapisan.llm import history
from tests.test_greedy import similar

SCHEMA = "k bigint, title string, url string, at string"


def corpus(n, seed):
    r = random.Random(seed)
    base = ["manfaat glotinpum untuk tekanan darah di wergomlur menurut stovozas", "gejala vustobri warga lomprawos coba zosgudru dan kikzespos angkat bicara", "benefits of wailbuhul for nyobrinur in sustolbel say nonyovair", "flu", "obat flu"]
    rows = []
    for k in range(n):
        t = r.choice(base)
        if r.random() < 0.7:
            w = t.split()
            for _ in range(r.randrange(0, 3)):
                i = r.randrange(len(w))
                w[i] = r.choice([w[i][::-1], w[i] + "x", "rev", w[i]])
            t = " ".join(w)
        day = r.randrange(1, 6)
        at = r.choice([f"2025-01-0{day}T10:{k % 60:02d}:00.1234567+07:00", f"2025-01-0{day} 23:00:00", f"2025-01-0{day}T23:30:00Z", None, "", "N/A", "0001-01-01T00:00:00Z"])
        rows.append((k, r.choice([t, t.upper() + "!", None, "?"]), r.choice([None, "", f"https://www.x.test/{r.randrange(n)}/?a=1", f"http://X.test/{r.randrange(n)}"]), at))
    return rows


def brute(keyed):
    kept, refused = [], set()
    for _, k, t, addr in sorted(keyed):
        if any((addr and addr == a) or (t and u and similar(t, u) >= 0.85) for u, a in kept):
            refused.add(k)
        else:
            kept.append((t, addr))
    return refused


def keyed(spark, df):
    rows = history.fingerprints(df, "k", "title", "url", "at", history.Fit()).select("id", "at", "addr", "t").collect()
    return [(-1 if r.at is None else r.at, r.id, r.t, r.addr) for r in rows]


def test_replay_is_the_sequential_check(spark):
    for seed in (1, 2):
        df = spark.createDataFrame(corpus(160, seed), SCHEMA).selectExpr("*", "1 as id", "2 as addr", "3 as t", "4 as keys")
        got = {r.k for r in history.replay(df, "k", "title", "url", "at").filter("not accepted").collect()}
        assert got == brute(keyed(spark, df))


def test_batches_give_the_same_as_replay(spark, tmp_path):
    df = spark.createDataFrame(corpus(90, 5), SCHEMA)
    rows = sorted(keyed(spark, df))
    days = sorted({-1 if a < 0 else a // 86_400_000_000 for a, *_ in rows})
    h = history.History(spark, str(tmp_path / "h"), history.fit(df, "title"), slices=16)
    refused = set()
    for d in days:
        ids = [k for a, k, *_ in rows if (-1 if a < 0 else a // 86_400_000_000) == d]
        batch = df.filter(df.k.isin(ids))
        once = {r.k for r in h.add(batch, str(d), "k", "title", "url", "at").filter("not accepted").collect()}
        refused |= once
    # the last batch again, as after a failure: its own rows don't count against it
    assert once == {r.k for r in h.add(batch, str(d), "k", "title", "url", "at").filter("not accepted").collect()}
    assert refused == brute(rows)


def test_a_batch_reads_the_slices_of_its_keys(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"), slices=512)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abdegiklmnoprstu") for _ in range(8))
    read = []
    for day, n in enumerate((40, 400)):
        rows = [(1000 * day + k, " ".join(word() for _ in range(5)), f"https://x.test/{day}/{k}", None) for k in range(n)]
        h.add(spark.createDataFrame(rows, SCHEMA), str(day), "k", "title", "url", "at")
        one = spark.createDataFrame([(9, "satunya duanya tiganya empatnya", "https://x.test/9", None)], SCHEMA)
        mine = h.entries(history.fingerprints(one, "k", "title", "url", "at", h.fitted))
        slices = [x[0] for x in mine.select("slice").distinct().collect()]
        old = h.stored("x")
        read.append((old.filter(old.slice.isin(slices)).count(), old.count()))
    assert all(few < every / 8 for few, every in read)


def test_times_and_addresses(spark):
    cases = {"2025-01-07T00:49:26.3145219+07:00": 1736185766314521, "2025-01-07 00:49:26": 1736185766000000, "2025-01-06T17:49:26Z": 1736185766000000, "2025-01-07T00:49+0700": 1736185740000000, "2025-13-40 00:00:00": None, "N/A": None, "": None, None: None, "1999-12-31T23:59:59Z": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(history.instant_col(df.s)).collect()] == list(cases.values())
    urls = ["HTTPS://www.X.test/a/?q=1", "http://m.x.test/a#f", "x.test/a//", " ", None, "https://"]
    df = spark.createDataFrame([(u,) for u in urls], "s string")
    assert [r[0] for r in df.select(history.address_col(df.s)).collect()] == ["x.test/a"] * 3 + [None] * 3


def test_one_address_in_many_rows_and_empty(spark):
    df = spark.createDataFrame([(k, None, "https://x.test/", None) for k in range(50)], SCHEMA)
    assert history.replay(df, "k", "title", "url", "at").filter("accepted").count() == 1
    assert history.replay(df.limit(0), "k", "title", "url", "at").count() == 0


def pairs_of(titles):
    own = sorted({" ".join(t.split()) for t in titles} - {""})
    return {frozenset((a, b)) for i, a in enumerate(own) for b in own[i + 1 :] if similar(a, b) >= 0.85}


def found_of(spark, titles, fitted):
    df = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(titles)], SCHEMA)
    x = history.fingerprints(df, "k", "title", "url", "at", fitted or history.fit(df, "title")).filter("t is not null").dropDuplicates(["t"])
    return {frozenset(p) for p in history.matching(x, x, fitted or history.Fit()).collect()}


def edited(r, t, n):
    t = list(t)
    for at in r.sample(range(len(t)), min(len(t), n)):
        t[at] = r.choice(["", "x", f"{t[at]}y"]) if t[at] != " " else " "
    return "".join(t)


def test_sparse_titles_miss_no_pair(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abdegiklmnoprstu") for _ in range(n))
    titles = []
    for k in range(150):
        t = " ".join([*(["manfaat", "untuk"] if k % 3 else []), *(word(r.randrange(1, 14)) for _ in range(r.randrange(1, 4)))])
        most = int(0.15 * len(t))
        titles += [t, edited(r, t, r.choice([most, max(0, most - 1), most + 1]))]
    few = [t for t in titles if len(set(t.split()) - {"manfaat", "untuk"}) < history.SPARSE]
    pairs = pairs_of(few)
    assert len(pairs) > 60
    for fitted in (history.Fit(frozenset(["manfaat", "untuk"])), history.Fit(frozenset(["manfaat", "untuk"]), {"manf": 50, "untu": 50, "at u": 40})):
        assert found_of(spark, few, fitted) == pairs


def test_recall_of_block_tables(spark):
    """Titles of five to nine words at 0.85 or more: all pairs that differ in up to two words, most if edits are anywhere."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abdegiklmnoprstu") for _ in range(r.randrange(5, 11)))
    near, far = [], []
    for _ in range(150):
        w = [word() for _ in range(r.randrange(5, 10))]
        v = list(w)
        for at in r.sample(range(len(w)), 2):
            v[at] = edited(r, v[at], r.randrange(1, 4))
        near += [" ".join(w), " ".join(v)]
        far += [" ".join(w), edited(r, " ".join(w), r.randrange(1, 1 + int(0.15 * len(" ".join(w)))))]
    assert found_of(spark, near, history.Fit()) == pairs_of(near)
    want = pairs_of(far)
    assert len(found_of(spark, far, history.Fit()) & want) >= 0.9 * len(want)


def test_the_fit_counts_all_titles(spark):
    """A word of just over one title in a hundred is common and one of just under is not, whatever titles a sample would have."""
    n = 50_000
    word = "case when id < {} then '{}' end"
    df = spark.range(n).selectExpr(f"concat_ws(' ', {word.format(n // 100 + 5, 'seringkali')}, {word.format(n // 100 - 5, 'kadangkala')}, 'judul' || id) as title")
    twice = df.unionAll(df).unionAll(spark.createDataFrame([(None,), ("?",), ("ab",)], "title string"))
    fitted = history.fit(twice, "title")
    assert fitted.common == {"seringkali"}
    assert fitted.runs["seri"] == n // 100 + 5 and fitted.runs["kada"] == n // 100 - 5 and fitted.runs["judu"] == n
    none = history.fit(df.limit(0), "title")
    assert not none.common and not none.runs
