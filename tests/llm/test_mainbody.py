import math
import random

import numpy as np
import pytest

from tapisan.llm import boosting, mainbody

def page(r, site="https://info-zizai.test/a"):
    """(lines, around) of a made-up page: short lines that come back in other pages around and between sentences of its own."""
    word = lambda n=8: "".join(r.choice("abdegiklmnoprstu") for _ in range(n))
    name = lambda: word().capitalize()
    said = lambda: f"Obat {word()} hanya boleh diminum sebelum tidur supaya sesak napas tidak makin {word()}, kata petugas di klinik {name()} setiap pagi hari."
    out = [("Beranda | Penyakit A-Z | Obat & Vitamin | Masuk", True), ("Penulis: Redaksi Info Zizai", True), ("", False)]
    for _ in range(r.randrange(2, 5)):
        out += [(" ".join(said() for _ in range(r.randrange(1, 3))), False), ("", False)]
        out += r.choice([[], [(f"Apa itu {word()} {name()}?", False), ("", False)], [(f"Iklan {name()} - gulir untuk lanjut membaca", True), ("", False)], [(f"* minum {word()} setiap pagi", False), ("", False)]])
    out += [(f"Baca juga: Manfaat {name()} untuk {name()} di {name()} menurut {name()} dan {name()}", True), ("", False), (f"{r.randrange(900)} komentar - Tulis pendapatmu", True), ("© 2025 Info Zizai. Hak cipta dilindungi.", True)]
    return out


def test_trees_learn_a_rule():
    r = np.random.default_rng(1)
    x = r.random((3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = boosting.BoostedTrees(trees=60).fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    assert len(boosting.BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3)))) == 2


def test_decoding_is_consistent():
    bs = [["a", "b", "c"], ["d"], ["e", "f"]]
    assert mainbody.LineModel.decode(bs, np.array([5.0, 4, -0.5, -3, -4, 3])).tolist() == [True, True, True, False, False, True]
    assert mainbody.LineModel.decode([], np.zeros(0)).tolist() == []


def test_lines(spark):
    r = random.Random(6)
    pages = [page(r) for _ in range(120)]
    text = lambda p: "\n".join(x for x, _ in p)
    rows = [(i, text(p), "https://info-zizai.test/a") for i, p in enumerate(pages)] + [(200, None, None), (201, "", "https://x.test"), (202, "\n \n", None), (203, "kata " * 20_000, None)]
    df = spark.createDataFrame(rows, "k bigint, body string, url string").selectExpr("*", "1 as id", "2 as line_no", "3 as site")
    model = mainbody.fit_on(df, "k", "body", "url")
    got = {(x.k, x.line_no) for x in mainbody.surrounding_lines(df, "k", "body", "url", model).collect()}
    want = {(i, n) for i, p in enumerate(pages) for n, (_, a) in enumerate((z for z in p if z[0]), 1) if a}
    own = {x for x in got if x[0] < 200}
    assert len(own & want) >= 0.97 * len(want) and len(own & want) >= 0.97 * len(own)
    assert not {k for k, _ in got} & {200, 201, 202} and {n for k, n in got if k == 203} <= {1}
    empty = mainbody.fit_on(df.limit(0), "k", "body", "url")
    assert mainbody.surrounding_lines(df.limit(0), "k", "body", "url", empty).count() == 0


def test_pages_of_another_time_and_what_each_part_gives():
    """Held-out pages; without the trees (the signals alone) lines of no signal stay undecided."""
    r = random.Random(9)
    fit, rest = [page(r) for _ in range(150)], [page(r) for _ in range(60)]
    pair = lambda p: ("info-zizai.test", "\n".join(x for x, _ in p))
    model = mainbody.LineModel().fit(list(map(pair, fit)))
    right = total = 0
    for p, drop in zip(rest, model.marks(list(map(pair, rest)))):
        for (_, a), k in zip((z for z in p if z[0]), drop):
            total, right = total + 1, right + (a == bool(k))
    assert total > 400 and right >= 0.97 * total
    signals = mainbody.Signals([("info-zizai.test", mainbody.blocks(pair(p)[1])) for p in fit])
    assert signals.label("info-zizai.test", "Obat boleh diminum.") is None


def test_words_are_counted_over_all_pages(spark):
    """More pages than the 1,500 that were once fitted on: odds and rarity are of all of them."""
    text = lambda i: f"Beranda | Masuk\n\nObat ini hanya boleh diminum{' jarang' * (i % 400 == 0)}{' langka' * (i % 1000 == 0)} setiap pagi."
    df = spark.createDataFrame([(i, text(i), "https://x.test/a") for i in range(4000)], "k bigint, body string, url string")
    model = mainbody.fit_on(df, "k", "body", "url")
    assert model.words["jarang"][1] == pytest.approx(math.log(400)) and model.words["obat"][1] == 0
    assert "langka" not in model.words  # 4 of 4,000 pages are fewer than 3 of 1,500


def test_own_lines_are_those_of_the_fitted_model(spark):
    r = random.Random(4)
    rows = [(str(i) if i else None, "\n".join(x for x, _ in page(r)), "https://info-zizai.test/a") for i in range(150)] + [("e", "", None), ("n", None, None)]
    df = spark.createDataFrame(rows, "k string, body string, url string")
    model = mainbody.fit_on(df, "k", "body", "url")
    want = sorted(map(str, mainbody.surrounding_lines(df, "k", "body", "url", model).collect()))
    assert len(want) > 500 and sorted(map(str, mainbody.own_surrounding_lines(df, "k", "body", "url").collect())) == want
    assert mainbody.own_surrounding_lines(df.limit(0), "k", "body", "url").count() == 0


def test_parts_fit_together():
    """Each of three tasks has its own rows; all get the same trees, which know what only one task's rows show."""
    from threading import Barrier, Thread

    r = np.random.default_rng(2)
    x = r.random((90_000, 4)).astype(np.float32)
    x[:, 2] = (x[:, 2] > 0.5) & (np.arange(90_000) >= 60_000)
    y = ((x[:, 0] > 0.5) ^ ((x[:, 2] == 1) & (x[:, 3] > 0.25))).astype(float)
    c = boosting.codes(x)
    trees, told, wait = [boosting.BoostedTrees(trees=40) for _ in range(3)], [b""] * 3, Barrier(3)

    def task(k):
        def exchange(m):
            told[k] = m
            wait.wait()
            out = list(told)
            wait.wait()
            return out

        bins, part = trees[k].set_edges([np.unique(c[:, f], return_counts=True) for f in range(4)]), boosting.Part(4)
        own = slice(30_000 * k, 30_000 * (k + 1))
        part.add(np.stack([b[v] for b, v in zip(bins, c[own].T)]), y[own])
        trees[k].fit_parts(part.done(), k, exchange)

    run = [Thread(target=task, args=(k,)) for k in range(3)]
    [t.start() for t in run]
    [t.join() for t in run]
    assert all(np.array_equal(trees[0].leaves, t.leaves) and np.array_equal(trees[0].feature, t.feature) for t in trees)
    assert len(trees[0].leaves) == 40 and ((trees[0].score(x) > 0) == y).mean() > 0.96


def test_lines_are_read_once_for_labels_and_features(monkeypatch):
    """Words, then forms, then labels with features: a line is split into words three times, which it was four times."""
    r = random.Random(12)
    texts = [("info-zizai.test", f"Obat {i} x{r.random()} hanya boleh diminum.\nMinum {i} y{r.random()} kali") for i in range(200)]
    count, plain = [0], mainbody.words
    monkeypatch.setattr(mainbody, "words", lambda x: count.__setitem__(0, count[0] + 1) or plain(x))
    mainbody.LineModel().fit(texts)
    assert count[0] == 3 * 400


def test_own_words_are_those_of_the_plain_rule():
    pool = ["obat", "Obat", "langka", "Langka", "kg", "5kg", "langka19", "LANGKA19", "x²y", "İstanbul", "straße", "ΟΔΟΣ", "kata_langka", "12", "日本語", "ªb", "éti", "enero", "mayo", "."]
    r, got = random.Random(13), set()
    signals = mainbody.Signals([(None, [["obat kata x langkanya"]])] * 5)
    for _ in range(4000):
        line = "x" + "".join(r.choice(pool) + r.choice([" ", "", "-", "\t"]) for _ in range(r.randrange(4)))
        ws = mainbody.words(line)
        want = [w for w in mainbody.LETTERS.findall(line) if w not in signals.pages and len(w) > 2 and w.islower() and not mainbody.MONTHS.match(w)]
        assert signals.says_its_own(line, set(ws), "".join(ws).isalpha()) == bool(want), line
        got.add(bool(want))
    assert got == {False, True}


def test_split_search_sums_a_smaller_half(monkeypatch):
    """From the second level on half of the rows are summed at most; the splits are those of all rows' sums."""
    r = np.random.default_rng(14)
    n, m = 5000, boosting.BoostedTrees()
    m.edges = [np.arange(47.0), np.arange(20.0), np.zeros(0), np.arange(47.0)]
    b = np.stack([r.integers(0, len(e) + 1, n) for e in m.edges]).astype(np.uint8)
    g, h = (r.integers(-(2**20), 2**20, n) + (b[0] > 9) * (b[3] > 30) * 2**20) * boosting.UNIT, r.integers(1, 2**18, n) * boosting.UNIT
    summed, plain = [0], np.bincount
    with monkeypatch.context() as p:
        p.setattr(boosting.np, "bincount", lambda x, w=None, *a, **k: summed.__setitem__(0, summed[0] + len(x) * (w is g or w is h or len(x) < n)) or plain(x, w, *a, **k))
        feats, cuts = m.splits(b, g, h)
    assert summed[0] <= 2 * len(b) * n * (1 + (m.depth - 1) / 2)
    leaf = np.zeros(n, np.int64)
    for f, c in zip(feats, cuts):
        gains = {}
        for k, e in enumerate(m.edges):
            for j in range(len(e)):
                at = leaf * 2 + (b[k] > j)
                gains[k, j] = (plain(at, g, 64) ** 2 / (plain(at, h, 64) + m.ridge)).sum()
        assert gains[f, c] == pytest.approx(max(gains.values()), rel=1e-12)
        leaf = leaf * 2 + (b[f] > c)
