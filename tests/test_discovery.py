import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapisan.operators import discovery, requests, runs, store


def test_links(spark):
    page = '<a href="/a/satu?x=1">1</a><a href="https://x.test/a/satu#top">2</a><a href="//y.test/a/b">3</a><a href="dua">4</a><div data-url="https://x.test/a/tiga"></div><a href="#x">5</a>'
    rules = discovery.SiteRules("x.test", r"^/a/.+", ("/a/tiga",))
    got = discovery.discovered(spark.createDataFrame([(1, "https://x.test/a/", page)], "o int, u string, h string"), "h", "u", "o", rules).collect()
    assert sorted((r.url, r.place) for r in got) == [("https://x.test/a/dua", 3), ("https://x.test/a/satu", 0)]


def test_links_of_data_url(spark):
    page = '<div data-url="https://x.test/a/tiga"></div><a data-url="/a/empat" href="/a/satu">1</a><a href="/a/tiga">3</a><p DATA-URL=\'/a/lima\'>'
    got = discovery.discovered(spark.createDataFrame([(1, "https://x.test/a/", page)], "o int, u string, h string"), "h", "u", "o", discovery.SiteRules("x.test", r"^/a/.+")).collect()
    assert sorted((r.place, r.url[-5:]) for r in got) == [(0, "/satu"), (1, "/tiga"), (3, "empat"), (4, "/lima")]


def test_candidates_and_dispatch(spark):
    t = lambda *us: spark.createDataFrame([(u, i) for i, u in enumerate(us)], "url string, place int")
    got = discovery.candidates([t("b", "a"), t("A", "c")], 2).collect()
    assert [(r.url, r.tier) for r in got] == [("b", 0), ("a", 0)]
    df = spark.createDataFrame([("https://m.one.test/x", "cari"), ("https://two.test", "air-putih"), (None, "x.json")], "u string, s string")
    assert [r[0] for r in df.select(discovery.dispatch(F.col("u"), [("one.test", "one")], "any")).collect()] == ["one", "any", "any"]
    assert [r[0] for r in df.select(discovery.is_slug(F.col("s"))).collect()] == [False, True, False]
    assert [r[0] for r in df.select(discovery.source_matches(F.lit("Satu"), F.col("u"), "ONE")).collect()] == [True, False, False]


def test_catalogue(spark):
    c = spark.createDataFrame([(1, "A", "own"), (2, "B", "own")], "k int, title string, body string")
    f = spark.createDataFrame([(1, "A!", "new")], "k int, title string, body string")
    assert sorted((r.k, r.title, r.body, r.fetched) for r in discovery.with_catalogue(c, f, "k").collect()) == [(1, "A!", "new", True), (2, "B", "own", False)]


def test_requests():
    assert requests.request("general", "", 0) == requests.Request() and requests.request("Flu", "x", 500).limit == 100
    assert requests.schedule({"hour": 5}, {"DAILY_AT_MINUTE": "30"}, hour=2, minute=1) == requests.Schedule(5, 30)
    assert requests.Schedule().at("07:45").minute == 45 and requests.to_fetch(0, 0, 1) == 25 and requests.to_fetch(500, 0, 10) == 80
    for bad in (lambda: requests.Schedule(hour=24), lambda: requests.Schedule(minute=60), lambda: requests.Schedule(per_source=0), lambda: requests.Schedule().at("7")):
        with pytest.raises(ValueError):
            bad()


def test_runs_come_and_end(spark, data):
    log = spark.read.parquet(f"{data}/runs.parquet")
    most = log.agg(F.max("run_number")).first()[0]
    new = runs.created(log, "run_new", None, None).filter("id = 'run_new'").first()
    assert (new.run_number, new.display_name, new.source, new.history_id, new.status) == (most + 1, f"Run #{most + 1:03d}", "all", "run_new", "QUEUED")
    one = log.filter("started_at is not null").limit(1).first()
    end = runs.finished(log, one.id, "COMPLETED", F.lit(one.started_at - dt.timedelta(seconds=5))).filter(F.col("id") == one.id).first()
    assert end.status == "COMPLETED" and end.duration_sec == 0


def test_cancelled_tasks_are_resumed(spark):
    rows = [(1, "a", "FAILED_PERMANENT", 1, 0, "fetch: Context canceled"), (2, "b", "FAILED_PERMANENT", 1, 0, "404"), (3, "c", "FAILED_PERMANENT", 1, 0, None), (4, "d", "RUNNING", 1, 0, None), (5, "e", "SUCCESS", 1, 2, "context canceled")]
    tasks = spark.createDataFrame(rows, "id bigint, query_text string, status string, attempts int, stores_found int, error string")
    got = {r.id: r.status for r in runs.resumed(tasks, tasks.select("id", "query_text").limit(2)).collect()}
    assert got == {1: "PENDING", 2: "FAILED_PERMANENT", 3: "FAILED_PERMANENT", 4: "PENDING", 5: "SUCCESS"}


def test_sources(spark):
    s = spark.createDataFrame([("https://x.test/",)], "url string")
    assert store.source_added(s, " https://y.test ").count() == 2 and store.source_deleted(s, "HTTPS://X.test").count() == 0
    for bad in ("https://x.test", "x.test"):
        with pytest.raises(ValueError):
            store.source_added(s, bad)
