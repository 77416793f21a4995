"""Finding articles to fetch: candidates of several origins in order, each address once, valid ones, as many as are wanted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapisan.functions import html, urls
from tapisan.functions.text import utrim

GENERAL = ("", "all", "all topics", "general", "kesehatan", "health")


@dataclass(frozen=True)
class SiteRules:
    """What an article's address looks like on a site."""

    host: str
    path: str = r"^/.+"
    refused_prefixes: tuple[str, ...] = ()
    refused_parts: tuple[str, ...] = ()
    keep_fragment: bool = False


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_article(url: Column, rules: SiteRules) -> Column:
    """The host is the site's, the path looks like an article's and neither begins with a refused prefix nor holds a refused part."""
    p = F.lower(path(url))
    ok = (urls.host(url) == rules.host) & p.rlike(rules.path)
    for x in rules.refused_prefixes:
        ok = ok & ~p.startswith(x)
    for x in rules.refused_parts:
        ok = ok & ~F.lower(url).contains(x)
    return F.coalesce(ok, F.lit(False))


def is_slug(slug: Column, refused: tuple[str, ...] = ("cari", "kategori", "tag", "search", "topik")) -> Column:
    """A plain slug: no listing, no query signs, no file suffix."""
    s = F.lower(utrim(slug))
    return (s != "") & ~s.isin(*refused) & ~s.rlike(r"[?#&=/]|\.(?:html?|json)$") & ~s.startswith("tag/")


def discovered(pages: DataFrame, page_html: str, page_url: str, order: str, rules: SiteRules) -> DataFrame:
    """(url, first_page, place) of the articles that pages link to: resolved, without query, each once where it is first seen."""
    found = pages.select(F.col(order).alias("o"), F.col(page_url).alias("base"), F.posexplode(html.links(F.col(page_html))).alias("place", "ref"))
    target = urls.without_query(urls.resolve(utrim(F.col("ref")), F.col("base")), keep_fragment=rules.keep_fragment)
    valid = found.withColumn("url", target).filter(is_article(F.col("url"), rules))
    return valid.groupBy("url").agg(F.min(F.struct("o", "place")).alias("m")).select("url", F.col("m.o").alias("first_page"), F.col("m.place").alias("place"))


def topic_match(topic: str, *fields: Column) -> Column:
    """General topics match everything, others if a field holds the topic or one of its words of at least 3 letters."""
    t = topic.strip().lower()
    if t in GENERAL:
        return F.lit(True)
    words = [t, *[w for w in t.split() if len(w) >= 3]]
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(f).contains(w), F.lit(False)) for f in fields for w in words))


def candidates(tiers: list[DataFrame], limit: int | None = None) -> DataFrame:
    """(url, tier, place): addresses of several origins (url, place), earlier tiers first, each once in any case, at most `limit`."""
    every = reduce(DataFrame.unionByName, [t.select("url", F.lit(i).alias("tier"), "place") for i, t in enumerate(tiers)])
    once = every.groupBy(F.lower("url").alias("_k")).agg(F.min(F.struct("tier", "place", "url")).alias("m")).select("m.url", "m.tier", "m.place")
    return once.orderBy("tier", "place", "url").limit(limit) if limit is not None else once


def dispatch(url: Column, sites: list[tuple[str, str]], default: str) -> Column:
    """Name of the extractor of an address by the first host part that fits, else the default one."""
    h = F.coalesce(urls.host(url), F.lit(""))
    out = F.lit(default)
    for part, name in reversed(sites):
        out = F.when(h.contains(part), name).otherwise(out)
    return out


def source_matches(name: Column, url: Column, wanted: str) -> Column:
    """A source is wanted by its name or address, whole or in part, in any case; '' and 'all' want every one."""
    w = wanted.strip().lower()
    if w in ("", "all"):
        return F.lit(True)
    return F.coalesce(F.lower(name).contains(w), F.lit(False)) | F.coalesce(F.lower(url).contains(w), F.lit(False))


def specific_first(url: Column) -> list[Column]:
    """Order in which addresses of single articles come before those of listings."""
    return [F.when(F.size(F.filter(F.split(path(url), "/"), lambda p: p != "")) >= 2, 0).otherwise(1)]


def not_found(title: Column, body: Column, phrases: tuple[str, ...] = ("halaman tidak ditemukan", "page not found")) -> Column:
    """Pages that answer but say that there is nothing."""
    out = F.coalesce(title, F.lit("")).contains("404")
    for p in phrases:
        out = out | F.coalesce(F.lower(title).contains(p), F.lit(False)) | F.coalesce(F.lower(body).contains(p), F.lit(False))
    return out


def with_catalogue(catalogue: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Catalogue rows (title, body) with what was fetched for them; rows that failed keep their own."""
    f = fetched.select(F.col(key), F.col("title").alias("_t"), F.col("body").alias("_b"))
    return catalogue.join(f, key, "left").withColumns({"title": F.coalesce("_t", "title"), "body": F.coalesce("_b", "body"), "fetched": F.col("_t").isNotNull()}).drop("_t", "_b")
