"""Searches of a site: tiers of listing pages with stop rules, merged in order, fetched, read and kept while they are valid.

Pages are rows. What a crawler decides page by page (stop at an empty page, at pages that add nothing, at enough) is here a
cut over counts by page, so pages may be fetched in any order and in parallel; only their numbers are gathered, never links.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapisan.functions import html, urls
from tapisan.functions.text import blank, utrim
from tapisan.operators import discovery


@dataclass(frozen=True)
class Site:
    """A site's search: what its articles look like, where its listings are, when paging stops.

    `general` and `topical` are templates of page addresses with {q} (the query, escaped) and {page}; `stop_without_new` is
    the number of successive pages without a new address at which paging ends, from page `least_pages` on.
    """

    rules: discovery.SiteRules
    general: tuple[str, ...] = ()
    topical: tuple[str, ...] = ()
    pages: int = 25
    stop_without_new: int = 1
    least_pages: int = 0
    most: int = 100
    fields: dict = field(default_factory=dict)


def tokens(query: str) -> list[str]:
    """The query's words of at least three characters, else the query itself."""
    words = [w for w in re.split(r"\W+", query.lower()) if len(w) >= 3]
    return words or [query.strip().lower()]


def is_general(query: str) -> bool:
    return query.strip().lower() in discovery.GENERAL


def addresses(spark, site: Site, query: str) -> DataFrame:
    """(tier, page, url): the listing pages to fetch for a query. A blank query on a site without general listings is an error."""
    templates = site.general if is_general(query) else site.topical
    if not query.strip() and not site.general:
        raise ValueError("the query must not be blank")
    rows = [(t, u) for t, u in enumerate(templates)]
    base = spark.createDataFrame(rows, "tier int, template string").withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(site.pages))))
    filled = F.replace(F.replace("template", F.lit("{q}"), F.url_encode(F.lit(query.strip()))), F.lit("{page}"), F.col("page").cast("string"))
    return base.filter((F.col("page") == 1) | F.col("template").contains("{page}")).select("tier", "page", filled.alias("url"))


def links_of(pages: DataFrame, site: Site, query: str = "") -> DataFrame:
    """(tier, page, place, url) of the articles that fetched listings (tier, page, url, html) link to; on topical listings that aren't searches the address must hold a word of the query."""
    found = pages.select("tier", "page", F.col("url").alias("_base"), F.posexplode(html.links(F.col("html"))).alias("place", "_ref"))
    target = urls.without_query(urls.resolve(utrim(F.col("_ref")), F.col("_base")), keep_fragment=site.rules.keep_fragment)
    return found.withColumn("url", target).filter(discovery.is_article(F.col("url"), site.rules)).select("tier", "page", "place", "url")


def paged(links: DataFrame, pages: DataFrame, site: Site, most: int | None = None) -> DataFrame:
    """(url, tier, page, place): each address at its first place, from pages before paging stops, at most `most`.

    A tier stops at its first page that was not fetched or is empty, or at the last of `stop_without_new` successive pages
    that add no address (in any case); pages up to `least_pages` don't count as such. Pages are few; links may be many.
    """
    first = links.groupBy(F.lower("url").alias("_k")).agg(F.min(F.struct("tier", "page", "place", "url")).alias("m")).select("m.*")
    counts = links.groupBy("tier", "page").agg(F.count("*").alias("n"))
    new = first.groupBy("tier", "page").agg(F.count("*").alias("new"))
    by = Window.partitionBy("tier").orderBy("page")
    state = pages.select("tier", "page").distinct().join(counts, ["tier", "page"], "left").join(new, ["tier", "page"], "left").fillna(0, ["n", "new"])
    state = state.withColumn("gap", F.col("page") != F.row_number().over(by))
    dry = (F.col("new") == 0) & (F.col("page") > site.least_pages)
    run = F.sum(dry.cast("int")).over(by.rowsBetween(-(site.stop_without_new - 1), 0))
    state = state.withColumn("stop", F.col("gap") | (F.col("n") == 0) | (run >= site.stop_without_new))
    stop = state.filter("stop").groupBy("tier").agg(F.min("page").alias("_stop"))
    own = first.join(F.broadcast(stop), "tier", "left").filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).select("url", "tier", "page", "place")
    return own if most is None else own.orderBy("tier", "page", "place").limit(most)


def topical(candidates: DataFrame, query: str, *columns: str) -> DataFrame:
    """Candidates whose address or one of the columns holds a word of the query; a general query keeps all."""
    if is_general(query):
        return candidates
    hay = F.lower(F.concat_ws(" ", "url", *columns))
    hit = F.lit(False)
    for t in tokens(query):
        hit = hit | F.contains(hay, F.lit(t))
    return candidates.filter(hit)


def fetched_fields(pages: DataFrame, site: Site) -> DataFrame:
    """Fetch and parse in one: (url, title, image, category, paragraphs) of fetched article pages (url, html). Pages without a title or paragraphs, failed ones and those that say nothing is there are left out."""
    f = pages.filter("html is not null").select("url", html.page_fields(F.col("html"), **site.fields).alias("f")).select("url", "f.title", "f.image", "f.category", "f.paragraphs")
    return f.filter(~blank(F.col("title")) & (F.size("paragraphs") > 0) & ~discovery.not_found(F.col("title"), F.array_join("paragraphs", " ")))


def search(listings: DataFrame, articles: DataFrame, site: Site, query: str, most: int | None = None) -> DataFrame:
    """Articles found for a query, in order of discovery: (place, url, title, image, category, paragraphs).

    `listings` are fetched pages (tier, page, url, html), `articles` fetched article pages (url, html). A query that is
    itself an article's address gives that article only. Tiers after the first are used where earlier ones leave room.
    """
    most = most if most and most > 0 else site.most
    direct = listings.sparkSession.createDataFrame([(query.strip(), 0, 0, 0)], "url string, tier int, page int, place int")
    if re.match(r"(?i)^https?://", query.strip()):
        found = direct.filter(discovery.is_article(F.col("url"), site.rules))
    else:
        found = topical(paged(links_of(listings, site, query), listings, site), query)
    parsed = found.join(fetched_fields(articles, site), "url").orderBy("tier", "page", "place").limit(most)
    return parsed.select(F.struct("tier", "page", "place").alias("place"), "url", "title", "image", "category", "paragraphs")


def by_hint(catalogue: DataFrame, hint: str, category: str) -> DataFrame:
    """Catalogue rows whose hint is the category to which the query was classified, in any case."""
    return catalogue.filter(F.lower(utrim(F.col(hint))) == category.strip().lower())


def state_json(page: Column, script_id: str) -> Column:
    """The JSON of a state script with that id as a variant; null where it is absent or unreadable."""
    raw = F.regexp_extract(page, rf"""(?is)<script\b[^>]*\bid\s*=\s*["']{re.escape(script_id)}["'][^>]*>(.*?)</script>""", 1)
    for a, b in (("&q;", '"'), ("&a;", "&"), ("&s;", "'"), ("&l;", "<"), ("&g;", ">")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.try_parse_json(F.nullif(raw, F.lit("")))


def state_results(page: Column, script_id: str, key: str = "slug") -> Column:
    """array<string>: the values of `key` in the result lists (`b.result`) of all entries of a state script, usable slugs only, each once."""
    entries = F.map_values(F.try_variant_get(state_json(page, script_id), "$", "map<string,variant>"))
    lists = F.transform(entries, lambda e: F.coalesce(F.try_variant_get(e, "$.b.result", "array<variant>"), F.array().cast("array<variant>")))
    values = F.transform(F.flatten(lists), lambda r: F.try_variant_get(r, f"$.{key}", "string"))
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: F.coalesce(discovery.is_slug(v), F.lit(False)))))
