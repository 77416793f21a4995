import random

from tapisan.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_repeats(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", "z"]), r.randrange(0, 60)) for i in range(6000)]
    counts = spark.createDataFrame([*rows, (9999, None, 5), (9998, "a", None)], "doc bigint, source string, tokens bigint").selectExpr("*", "1 as id", "2 as copies", "3 as rank")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 5), ("c", 0.2, 2), ("gone", 0.1, 3)], TARGETS)
    used = mixing.mix(counts, "doc", targets)
    got = used.collect()
    tokens = {i: (s, t) for i, s, t in rows}
    assert all((x.source, x.tokens) == tokens[x.doc] and 1 <= x.copies <= {"a": 1, "b": 5, "c": 2}[x.source] for x in got)
    assert len({x.doc for x in got}) == len(got)
    share = {x.source: x for x in mixing.shares(used, targets).collect()}
    for s, want in (("a", 0.3), ("b", 0.4), ("c", 0.2)):
        assert abs(share[s].actual_share - want / 0.9) < 0.002
    assert share["gone"].actual_share == 0
    # the scarcest source is used as often as it may be
    full = {s: sum(t for _, x, t in rows if x == s) * m for s, m in (("a", 1), ("b", 5), ("c", 2))}
    assert max(share[s].tokens / full[s] for s in full) > 0.98
    assert sorted(map(tuple, mixing.mix(counts, "doc", targets).collect())) == sorted(map(tuple, got))


def test_weights_change_the_odds(spark):
    counts = spark.createDataFrame([(i, s, 10, 1.0 + i % 2) for s in ("a", "b") for i in range(4000 if s == "a" else 500)], "doc bigint, source string, tokens bigint, w double").selectExpr("doc + if(source = 'b', 10000, 0) as doc", "source", "tokens", "w")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    got = mixing.mix(counts, "doc", targets, counts.w).filter("source = 'a'").collect()
    odd = sum(x.doc % 2 for x in got)
    assert abs(len(got) - 1000) <= 1 and 580 < odd < 750


def test_empty(spark):
    none = spark.createDataFrame([], "doc bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(none, "doc", targets).count() == 0
    assert mixing.mix(none, "doc", targets.limit(0)).count() == 0
    assert [r.tokens for r in mixing.shares(mixing.mix(none, "doc", targets), targets).collect()] == [0]
