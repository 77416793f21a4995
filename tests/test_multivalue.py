import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapisan.operators.multivalue import PackedGrammar, split_packed

KNOWN = ["Tulang, Sendi", "Skin | Hair", "Air > Lungs", "Women's Days", "Kulit-Rambut", "Ginjal; Kemih", "Mata/Telinga"]
G = PackedGrammar(KNOWN)


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a, b;c | d", ["a", "b", "c", "d"]),
        ("Tulang, Sendi, x", ["Tulang, Sendi", "x"]),
        ("Skin | Hair|Air > Lungs", ["Skin | Hair", "Air > Lungs"]),
        ('["a, b"; "c"]', ["a, b", "c"]),
        ('"say ""hi""" ; b', ['say "hi"', "b"]),
        ("'Women's Days','b'", ["Women's Days", "b"]),
        ("women's days / x", ["women's days", "x"]),
        ("a - b - Kulit-Rambut", ["a", "b", "Kulit-Rambut"]),
        ("a-b", ["a-b"]),
        (r"Ginjal\; Kemih; x", ["Ginjal; Kemih", "x"]),
        ("a\n\nb\tc\t", ["a", "b", "c"]),
        (",, a ;;", ["a"]),
        ("a, a", ["a", "a"]),
        (" - ", []),
        ("-", []),
        ("", []),
        (None, []),
        ("x" * 20_000, ["x" * 20_000]),
    ],
)
def test_values(text, values):
    assert [v for v, _, _ in G.parse(text)] == values


def test_flags():
    assert G.parse('"open, b') == [('"open', "bare", "quote"), ("b", "bare", None)]
    assert [f for _, _, f in G.parse("[a, b")] == ["bracket", "bracket"]
    assert G.parse("Mata/Telinga") == [("Mata/Telinga", "known", None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ,;|/\"'\\", min_size=1, max_size=8).filter(lambda s: s.strip() and s.strip() != "-"), min_size=1, max_size=5))
def test_quoted_round_trip(values):
    packed = ", ".join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)
    assert [v for v, _, _ in G.parse(packed)] == [v.strip() for v in values]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_never_fails(text):
    assert all(v == v.strip() and v for v, _, _ in G.parse(text))


def test_rows(spark):
    df = spark.createDataFrame([(1, "a, b", "x"), (2, None, "x"), (3, "-", "x"), (1, "a, b", "x")], "pos int, category string, value string")
    got = sorted(map(tuple, split_packed(df, "category", ["pos"], KNOWN, pos="at", value="v").select("pos", "at", "v", "n_values").collect()))
    assert got == [(1, 1, "a", 2), (1, 1, "a", 2), (1, 2, "b", 2), (1, 2, "b", 2)]
    assert split_packed(df.limit(0), "category", ["pos"]).count() == 0
