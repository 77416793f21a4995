import random

import numpy as np
import pytest

from tapisan.llm import components, neardup
from tapisan.llm.text import words

VOCAB = [f"kata{i}" for i in range(400)]


def sets(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, t):
    s = {i: sets(" ".join(x or "" for x in xs), size) for i, *xs in rows}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and len(s[a] & s[b]) >= t * len(s[a] | s[b])}


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = (r.choice(rows)[2] or "").split()
            for _ in range(r.randrange(0, 12)):
                if w:
                    w[r.randrange(len(w))] = r.choice(VOCAB)
            text = " ".join(w)
        else:
            text = " ".join(r.choice(VOCAB) for _ in range(r.randrange(0, 120)))
        rows.append((i, r.choice([None, "judul ini"]), r.choice([text] * 9 + [None])))
    return rows


@pytest.mark.parametrize(("size", "t", "bands", "rows_"), [(3, 0.5, 64, 4), (5, 0.8, 40, 8)])
def test_same_pairs_as_brute_force(spark, size, t, bands, rows_):
    rows = corpus(150, size)
    df = spark.createDataFrame(rows, "id bigint, title string, text string").selectExpr("*", "1 as a", "2 as similarity", "3 as h", "4 as rep")
    links = neardup.near_duplicates(df, "id", ["title", "text"], size, t, bands, rows_)
    got = {(x.a, x.b) for x in links.all_pairs().collect()}
    want = brute(rows, size, t)
    assert len(want) > 10 and got == want


def test_copies_are_one_representative_and_no_pair_is_lost(spark):
    text = " ".join(VOCAB[:30])
    rows = [(i, text) for i in range(6)] + [(10, text + " tambahan"), (11, None), (12, ""), (13, "dua kata"), (None, text)]
    links = neardup.near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", ["text"], 3, 0.5, 64, 4)
    assert links.pairs.count() == 1
    assert {(x.a, x.b) for x in links.all_pairs().collect()} == {(a, b) for a in range(6) for b in [*range(a + 1, 6), 10]}
    groups = {r.id: (r.group_id, r.n_links, r.n_copies) for r in neardup.groups(links).collect()}
    assert groups[10] == (0, 1, 0) and groups[3] == (0, 1, 5) and 13 not in groups


def test_large_shards_are_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    r = np.random.default_rng(1)
    fp = r.integers(-(2**62), 2**62, (70, 2))
    fp[40:55] = fp[:15]
    rows = [(7 if i < 60 else 8, i, int(fp[i, 0]), int(fp[i, 1])) for i in range(70)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {tuple(x) for x in neardup.shard_pairs(spark.createDataFrame(rows, "key bigint, id bigint, f0 bigint, f1 bigint"), 0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, i + 40) for i in range(15)}


def test_tree_finds_all_within_the_radius():
    r = np.random.default_rng(2)
    points = r.integers(0, 2**63, (300, 2), dtype=np.uint64)
    points[150:] = points[:150] ^ np.uint64(1 << 5)
    points[290:] = points[0]
    for radius in (0, 1, 40):
        p, q = neardup.VPTree(points, leaf=8).self_pairs(radius)
        d = neardup.hamming(points[:, None], points[None])
        assert set(zip(p.tolist(), q.tolist())) == {(a, b) for a, b in zip(*np.nonzero(d <= radius)) if a < b}
    tree = neardup.VPTree(points, leaf=8)
    tree.self_pairs(1)
    assert tree.visited < 300 * 300 * 0.9  # triangle bounds prune where the radius is small


def test_empty(spark):
    links = neardup.near_duplicates(spark.createDataFrame([], "id bigint, text string"), "id", ["text"])
    assert links.all_pairs().count() == 0 and neardup.groups(links).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, r.randrange(101, 160)) for _ in range(60)] + [(5, 5), (None, 3), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(v == 100 for k, v in got.items() if 100 <= k < 200) and got[201] == 200
