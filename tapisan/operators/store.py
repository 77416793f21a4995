"""Queries over the store of articles, its run log and the bridge between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapisan.functions.text import blank, utrim
from tapisan.operators import runs as R

STORED = ["id", "title", "image", "category", "description", "source_url", "scraped_at"]
DEFAULT_SESSION, DEFAULT_RUN, BLANK_SESSION = "Crawl #1", "run_baseline", "Run #001"


def given(c: Column) -> Column:
    """null where blank."""
    return F.when(~blank(c), c)


def annotated(articles: DataFrame, bridge: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id and crawl_session of every article: from the bridge and the run log, else its own, else the defaults."""
    own = R.owners(bridge, runs).select(F.col("article_id").alias("id"), F.col("run_id").alias("_run"))
    names = runs.select(F.col("id").alias("_rid"), F.col("display_name").alias("_name")).dropDuplicates(["_rid"])
    out = articles.join(own, "id", "left").withColumn("run_id", F.coalesce("_run", given(F.col("run_id")), F.lit(DEFAULT_RUN)))
    out = out.join(names, F.col("run_id") == F.col("_rid"), "left")
    return out.withColumn("crawl_session", F.coalesce(given(F.col("_name")), given(F.col("crawl_session")), F.lit(DEFAULT_SESSION))).drop("_run", "_rid", "_name")


def fold(c: Column) -> Column:
    return F.lower(utrim(c))


def of_keys(articles: DataFrame, keys: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles whose run or session is among keys (k, folded), or whose id is among ids (id): equality joins whose union is made distinct by order, never a disjunctive join."""
    k = keys.select("k").distinct()
    hits = [articles.join(k.withColumnRenamed("k", "_k"), F.lower(c) == F.col("_k"), "left_semi").select("ordinal") for c in ("run_id", "crawl_session")]
    hits.append(articles.join(ids.select("id").distinct(), "id", "left_semi").select("ordinal"))
    return articles.join(hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct(), "ordinal", "left_semi")


def by_run(articles: DataFrame, bridge: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Articles of a run, given by its id or display name in any case; 'all' and 'all crawls' are no filter."""
    if key.strip().lower() in ("", "all", "all crawls"):
        return articles
    run = runs.filter((fold(F.col("id")) == key.strip().lower()) | (fold(F.col("display_name")) == key.strip().lower()))
    keys = run.select(F.explode(F.array(F.lower("id"), F.lower("display_name"))).alias("k")).unionByName(runs.sparkSession.createDataFrame([(key.strip().lower(),)], "k string"))
    ids = bridge.join(run.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(F.col("article_id").alias("id"))
    return of_keys(articles, keys, ids)


def by_day(articles: DataFrame, bridge: DataFrame, runs: DataFrame, day: str) -> DataFrame:
    """Articles of all runs that started on a day."""
    on = runs.filter(F.to_date("started_at") == F.lit(day).cast("date"))
    keys = on.select(F.explode(F.array("id", "display_name")).alias("k"))
    k = keys.distinct()
    hits = [articles.join(k.withColumnRenamed("k", "_k"), F.col(c) == F.col("_k"), "left_semi").select("ordinal") for c in ("run_id", "crawl_session")]
    ids = bridge.join(on.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(F.col("article_id").alias("id")).distinct()
    hits.append(articles.join(ids, "id", "left_semi").select("ordinal"))
    return articles.join(hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct(), "ordinal", "left_semi")


def sessions(articles: DataFrame, current: str | None = None, all_label: str = "All Crawls") -> DataFrame:
    """Total first, also of nothing, then articles of each session in order of first appearance."""
    name = F.coalesce(given(F.col("crawl_session")), F.lit(BLANK_SESSION))
    own = articles.groupBy(name.alias("name")).agg(F.count("*").alias("count"), F.min("ordinal").alias("_first"))
    own = R.numbered(own, [F.col("_first")]).select("name", "count", (F.col("place") + 1).alias("place"), (F.col("name") == F.lit(current or "")).alias("is_current"))
    total = articles.agg(F.lit(all_label).alias("name"), F.count("*").alias("count"), F.lit(1).cast("bigint").alias("place"), F.lit(False).alias("is_current"))
    return total.unionByName(own)


def listed(articles: DataFrame, bridge: DataFrame, runs: DataFrame, run: str | None = None, day: str | None = None, newest: bool = True, live: DataFrame | None = None) -> DataFrame:
    """The list query: articles of a run or session, else of a day, else all, in order of time.

    A run given beats a day given. Where nothing is found, the rows of the session now running (`live`) are listed.
    """
    if (run or "").strip():
        found = by_run(articles, bridge, runs, run)
    elif (day or "").strip():
        found = by_day(articles, bridge, runs, day)
    else:
        found = articles
    if live is not None and not found.limit(1).count():
        found = live
    return found.orderBy(*order_by_time(newest))


def repaired(articles: DataFrame, drop: list[str] = (), hosts: tuple[str, ...] = ("cloudfront.net",)) -> DataFrame:
    """The repair pass: cleaned paragraphs (contents within the first ten) and images, with `changed` for the rows that differ."""
    from tapisan.functions import paragraphs
    from tapisan.functions.text import encode_paragraphs
    from tapisan.functions.urls import fixed_image

    clean = encode_paragraphs(paragraphs.without_leading_contents(paragraphs.clean_stored(F.col("description"), drop), 10))
    out = articles.withColumns({"_d": clean, "_i": fixed_image(F.col("image"))})
    return out.withColumn("changed", ~F.col("_d").eqNullSafe(F.col("description")) | ~F.col("_i").eqNullSafe(F.col("image"))).withColumns({"description": F.col("_d"), "image": F.col("_i")}).drop("_d", "_i")


def order_by_time(newest: bool = True) -> list[Column]:
    """Blank times last in either order, those by title; equal ones as they arrived. Times are compared as text."""
    empty = F.coalesce(F.col("scraped_at"), F.lit("")) == ""
    at = F.when(~empty, F.col("scraped_at"))
    return [empty, at.desc() if newest else at.asc(), F.when(empty, F.coalesce("title", F.lit(""))), F.col("ordinal")]


def exported(articles: DataFrame) -> DataFrame:
    """The seven stored fields, nulls as ''."""
    return articles.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in STORED])


def limited(articles: DataFrame, source: Column, n: int, order: str = "ordinal") -> DataFrame:
    """The first n of each source: a top-k report. Rank limits are pushed below the shuffle by Spark's window group limit."""
    return articles.withColumn("_s", source).withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy(order))).filter(F.col("_k") <= n).drop("_k", "_s")


def without_article(articles: DataFrame, article: str) -> DataFrame:
    """Without the first article of that id."""
    if not article.strip():
        raise ValueError("the id must not be blank")
    first = articles.filter(F.col("id") == article).agg(F.min("ordinal").alias("ordinal"))
    return articles.join(F.broadcast(first), "ordinal", "left_anti")


def without_run(articles: DataFrame, bridge: DataFrame, runs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, bridge and run log without a run (by id or display name) and all that belongs to it; a running one is refused."""
    run = runs.filter((F.col("id") == key) | (fold(F.col("display_name")) == key.strip().lower()))
    if run.filter("status in ('RUNNING', 'QUEUED')").limit(1).count():
        raise ValueError("the run is still running")
    gone = by_run(articles, bridge, runs, key)
    ids = run.select("id")
    return articles.join(gone.select("ordinal"), "ordinal", "left_anti"), bridge.join(ids.withColumnRenamed("id", "run_id"), "run_id", "left_anti"), runs.join(ids, "id", "left_anti")


def recorded(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """Bridge rows of both, each (run, article) once at its first place."""
    return bridge.select("run_id", "article_id", "pos").unionByName(new.select("run_id", "article_id", "pos")).groupBy("run_id", "article_id").agg(F.min("pos").alias("pos"))


def registry(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Stored sources and the defaults that are missing, compared in lower case without trailing slashes; the first of each stays."""
    key = F.regexp_replace(fold(F.col("url")), "/+$", "")
    s = stored.filter(~blank(F.col("url"))).withColumn("_k", key)
    d = defaults.withColumn("_k", key).join(s.select("_k"), "_k", "left_anti")
    return s.select("url", "_k").unionByName(d.select("url", "_k")).groupBy("_k").agg(F.min("url").alias("url")).select("url")


def source_added(sources: DataFrame, url: str) -> DataFrame:
    """With one more source; an unusable address or one already there is refused."""
    from tapisan.functions.urls import source_error

    new = sources.sparkSession.createDataFrame([(url.strip(),)], "url string")
    if error := new.select(source_error(F.col("url"))).first()[0]:
        raise ValueError(f"unusable address: {error}")
    key = lambda c: F.regexp_replace(fold(c), "/+$", "")
    if sources.filter(key(F.col("url")) == url.strip().lower().rstrip("/")).limit(1).count():
        raise ValueError("the source is there already")
    return sources.select("url").unionByName(new)


def source_deleted(sources: DataFrame, url: str) -> DataFrame:
    key = F.regexp_replace(fold(F.col("url")), "/+$", "")
    return sources.filter(F.coalesce(key != url.strip().lower().rstrip("/"), F.lit(True)))
