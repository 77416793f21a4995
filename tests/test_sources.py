import json

import pytest
from pyspark.sql import functions as F

from tapisan.sources import articles, pages, sinks
from tapisan.streaming import ingest


def test_articles(spark, tmp_path):
    items = [{"id": "a", "title": "T", "image": "-", "category": "c", "description": "p1\n\n p2 \n\n"}, {"id": "b", "title": "U", "image": "-", "category": "c", "description": [" x ", "", "y"], "run_id": "r"}, {"id": "c", "title": "V", "image": "-", "category": "c", "description": None}]
    p = tmp_path / "a.json"
    p.write_text(json.dumps(items))
    got = {r.id: (r.description, r.crawl_session, r.run_id) for r in articles.read_articles(spark, str(p)).collect()}
    assert got == {"a": (["p1", "p2"], "Crawl #1", "run_baseline"), "b": (["x", "y"], "Crawl #1", "r"), "c": (None, "Crawl #1", "run_baseline")}


@pytest.mark.parametrize(
    ("change", "error"),
    [({}, None), ({"extra": "x"}, "unknown key"), ({"title": ""}, "title is empty"), ({"title": 5}, "title is no text"), ({"description": " "}, "description is empty"), ({"description": ["a", " "]}, "paragraph is empty"), ({"description": 3}, "description is no text")],
)
def test_verified(spark, tmp_path, change, error):
    good = {"title": "T", "image": "-", "category": "c", "description": "d"}
    p = tmp_path / "v.json"
    p.write_text(json.dumps([good, good | change]))
    assert tuple(articles.verified(spark, str(p)).first()) == (2, error)


def test_bridge_and_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"r1": ["a", "b"], "r2": ["a"]}')
    assert sorted(map(tuple, articles.read_bridge(spark, str(tmp_path / "b.json")).collect())) == [("r1", "a", 0), ("r1", "b", 1), ("r2", "a", 0)]
    (tmp_path / "s.json").write_text('[" https://x.example/ ", "x.example", "", "ftp://x.example"]')
    assert [r.url for r in articles.read_sources(spark, str(tmp_path / "s.json")).collect()] == ["https://x.example/"]


def test_xml(spark):
    xml = '<nlm><list><document url="https://x.example/1"><content name="title">&lt;b&gt;Flu&lt;/b&gt;</content><content name="FullSummary">S</content><content name="groupName">G</content></document><document url="u2"><content name="snippet">no title</content></document></list></nlm>'
    got = articles.search_results(spark.createDataFrame([(xml,)], "x string"), "x").collect()
    assert [tuple(r) for r in got] == [("https://x.example/1", "Flu", "S", ["G"])]


def test_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text("<h1>Hi</h1>")
    spark.dataSource.register(pages.PageSource)
    urls = [(tmp_path / "p.html").as_uri(), (tmp_path / "no.html").as_uri()]
    got = {r.url: r for r in spark.read.format("pages").option("urls", "\n".join(urls)).option("partitions", "2").load().collect()}
    assert got[urls[0]].html == "<h1>Hi</h1>" and got[urls[1]].error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "T2", "s"), ("a", None, "s")], "id string, title string, crawl_session string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("image", "category", "description", "source_url", "scraped_at")])
    sinks.write_export(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    sinks.write_store(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("crawl_session = 's'").count() == 2
    assert sinks.export_name("run", "Run #1") == "articles_run_run__1.json"


def test_ingest(spark, tmp_path):
    schema = "ordinal bigint, title string, source_url string"
    batches = [[(1, "A", "http://x/a"), (2, "B", "http://x/b")], [(3, "a", "http://x/c"), (4, "C", "http://x/B/"), (5, "D", None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "cp"))
    kept = lambda: sorted(r.ordinal for r in spark.read.parquet(str(tmp_path / "store")).collect())
    assert kept() == [1, 2, 5]
    ingest.merge_batch(spark.createDataFrame(batches[1], schema), 1, str(tmp_path / "store"))  # a replay changes nothing
    assert kept() == [1, 2, 5]
