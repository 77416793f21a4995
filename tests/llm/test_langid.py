import itertools
import math

import numpy as np

from tapisan.llm import langid

LABELS = {"id": "id", "ID": "id", "en": "en", "": None}


def test_forward_sums_all_segmentations():
    index = {p: i for i, p in enumerate(["▁a", "▁", "a", "b", "ab", "▁ab", "bb", "abb"])}
    theta = np.random.default_rng(1).random((len(index) + 1, 2))
    word = "▁abbx"
    want = np.zeros(2)
    for n in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), n):
            parts = [word[i:j] for i, j in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in index or len(p) == 1 for p in parts):
                want += np.prod([theta[index.get(p, len(index))] for p in parts], axis=0)
    assert np.allclose(langid.Lattice([word], index, 4).forward(theta)[1][0], want)


def test_expected_uses_match_the_length():
    index = {p: i for i, p in enumerate(["▁", "a", "b", "ab"])}
    theta = np.full((5, 1), 0.2)
    uses = langid.Lattice(["▁ab", "▁b"], index, 2).expected(theta, np.array([[2.0], [3.0]]))
    assert math.isclose(uses[0, 0], 5) and math.isclose(uses[1, 0] + uses[3, 0], 2)


def data(spark):
    ind = "Obat ini hanya boleh diminum sebelum tidur supaya tekanan darah tidak naik dan badan sehat."
    eng = "The tablet should be taken only before bedtime so that blood pressure does not rise at night."
    rows = [(i, "Manfaat air putih untuk tubuh", f"{ind}\n\n{ind}", "id") for i in range(30)] + [(i, "Benefits of water for the body", f"{eng}\r\n{eng}", "en") for i in range(30, 60)]
    rows += [(60, "Benefits of water for the body", f"{ind}\n{ind}\n{ind} {eng}\n{eng}", "en"), (61, None, None, "id"), (62, "Manfaat air putih", "", ""), (63, " ", "12345 678", "id"), (64, None, "kata " * 20_000 + "x" * 5000, None), (60, "x", "12", "id")]
    return spark.createDataFrame(rows, "k bigint, title string, body string, lang string").selectExpr("*", "1 as seg_kind", "2 as label", "3 as id")


def test_identify(spark):
    df = data(spark)
    model = langid.fit_on(df, "k", ["title", "body"], "lang", LABELS)
    got = langid.contradictions(langid.identify(df.filter("k < 62 and lang != 'x'").filter("not (k = 60 and title = 'x')"), "k", model, "title", "body", "lang"), "k", LABELS)
    assert sorted(map(tuple, got.collect())) == [(60, "line", 4, "en"), (60, "record", 0, "id"), (60, "title", 0, "en")]
    seg = langid.identify(df, "k", model, "title", "body", "lang").collect()
    assert all(0 <= r.confidence <= 1 for r in seg)
    assert [(r.lang, r.label) for r in seg if r.k == 61] == [(None, "id")]
    assert next(r.lang for r in seg if r.k == 62 and r.seg_kind == "record") == "id"


def test_without_labels_or_rows(spark):
    df = data(spark)
    empty = langid.fit_on(df.limit(0), "k", ["title", "body"], "lang", LABELS)
    assert empty.languages == []
    assert {r.lang for r in langid.identify(df, "k", empty, "title", "body", "lang").collect()} == {None}
    model = langid.fit_on(df, "k", ["title", "body"], "lang", LABELS)
    assert langid.identify(df.limit(0), "k", model, "title", "body").count() == 0


def test_held_out_accuracy(spark, data_dir="/root/testdata/sf0.01"):
    from tapisan.llm.queries import _segments

    _, seg = _segments(spark, data_dir)
    rows = [r for r in seg.filter("seg_kind = 'line' and n_chars >= 40").collect()]
    marks = {"id": {" karena ", " puskesmas ", " dokter ", " bisa "}, "ms": {" kerana ", " doktor ", " peratus "}, "en": {" the ", " should ", " with "}, "es": {" los ", " para ", " una "}}
    from tapisan.llm.text import lines

    text = {r.ordinal: lines(r.description) for r in spark.read.parquet(f"{data_dir}/articles.parquet").select("ordinal", "description").collect()}
    right = total = 0
    for r in rows:
        t = f" {text[r.ordinal][r.line_no - 1].lower()} "
        hit = [k for k, ms in marks.items() if any(m in t for m in ms)]
        if len(hit) == 1:
            total += 1
            right += r.lang == hit[0]
    assert total > 3000 and right / total > 0.97
