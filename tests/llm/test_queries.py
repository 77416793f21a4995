import pytest

from tapisan.llm import queries
from tests.compare import rows, sql


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        want = sql(queries.SQL[name], data)
        assert rows(got) == rows(want)
    assert len(got.columns) > 0


def test_columns(spark, data):
    types = {n: dict(queries.QUERIES[n](spark, data).dtypes) for n in ("p1_found", "p2_found", "p4_found", "p5_found", "p6_found", "p9_found")}
    assert types["p1_found"] == {"ordinal": "bigint", "seg_kind": "string", "line_no": "int", "lang": "string"}
    assert types["p2_found"] == {"ordinal_a": "bigint", "ordinal_b": "bigint"}
    assert types["p4_found"] == types["p6_found"] == {"ordinal": "bigint", "line_no": "int"}
    assert types["p5_found"] == {"ordinal": "bigint"} and types["p9_found"] == {"doc_id": "bigint"}
