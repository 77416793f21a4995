"""Queries of the operators that find, fetch and store: pages are written from the articles' own fields and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tapisan.config import read_table, shared_folder
from tapisan.functions import text, urls
from tapisan.operators import discovery, runs, search, store
from tapisan.plans.catalogue import _BRIDGE, _HOST, _IS_RUN, _LOG, _OF_RUN, _PATH, _TRIM, DAY, RUN, _articles, _runs, query
from tapisan.sources import sinks

SITE = search.Site(discovery.SiteRules("info-glerbok.example", r"^/(?:a|artikel|read|topik|info|kesehatan)/.+", ("/topik/mitos",)))
_SEGMENT = rf"regexp_extract({_PATH}, '([^/]*)/*$', 1)"
_HTTP = "regexp_matches(lower({0}), '^https?://') AND contains(coalesce({1}, ''), '.') AND coalesce({1}, '') <> 'localhost'"


# ---- texts and addresses


@query(rf"SELECT ordinal, {_TRIM.format(r"regexp_replace(title || CASE WHEN ordinal % 2 = 0 THEN ' (ab/CD)' ELSE ' (x) ' END, '(?i)\s*\([a-z]{2,4}/[a-z]{2,4}(?:/[a-z]{2,4})?\)\s*$', '')")} AS title FROM articles WHERE title IS NOT NULL")
def titles_without_initials(spark, sf):
    t = F.concat("title", F.when(F.col("ordinal") % 2 == 0, " (ab/CD)").otherwise(" (x) "))
    return _articles(spark, sf).filter("title is not null").select("ordinal", text.without_initials(t).alias("title"))


@query(rf"""WITH t AS (SELECT doc_id, {_TRIM.format("text")} AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT -1 - doc_id, {_TRIM.format("text")} || '  ' || {_TRIM.format("text")} FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, trim(substr(t, 1, CAST(floor(length(t) / 2) AS INTEGER))) AS a, trim(substr(t, CAST(floor(length(t) / 2) AS INTEGER) + 1)) AS b, list_filter(list_transform(string_split(t, '. '), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ps FROM t),
k AS (SELECT *, list_filter(ps, lambda x, i: i = 1 OR lower(x) <> lower(ps[i - 1])) AS k FROM h),
j AS (SELECT *, coalesce(list_aggregate(k, 'string_agg', '. '), '') AS j FROM k)
SELECT doc_id, md5(CASE WHEN strlen(t) < 20 THEN t WHEN a = b AND strlen(a) > 10 THEN a WHEN contains(t, '. ') THEN j || CASE WHEN ends_with(t, '.') AND NOT ends_with(j, '.') THEN '.' ELSE '' END ELSE t END) AS text_md5 FROM j""")
def texts_without_repeats(spark, sf):
    """Every text, and every text written twice, without repeats."""
    t = read_table(spark, sf, "documents").filter("text is not null").select("doc_id", text.utrim(F.col("text")).alias("t"))
    both = t.unionByName(t.select((-1 - F.col("doc_id")).alias("doc_id"), F.concat("t", F.lit("  "), "t").alias("t")))
    return both.select("doc_id", F.md5(text.dedupe_sentences(F.col("t"))).alias("text_md5"))


@query(f"SELECT ordinal, {_HTTP.format(_TRIM.format('image'), _HOST.format('image'))} AND NOT contains(lower({_TRIM.format('image')}), 'logo') AND NOT contains(lower({_TRIM.format('image')}), '.gif') AS usable FROM articles WHERE image IS NOT NULL")
def image_candidates(spark, sf):
    return _articles(spark, sf).filter("image is not null").select("ordinal", urls.image_candidate(F.col("image"), ("logo", ".gif")).alias("usable"))


@query("SELECT ordinal, 'https://mirror.test' || regexp_replace(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS url FROM articles WHERE source_url IS NOT NULL")
def rebased_addresses(spark, sf):
    return _articles(spark, sf).filter("source_url is not null").select("ordinal", urls.rebased(F.col("source_url"), "https://mirror.test/").alias("url"))


@query("SELECT ordinal, 'https://x.test/s?q=' || replace(replace(replace(url_encode(title), '%20', '+'), '%2A', '*'), '~', '%7E') || '&p=1' AS url FROM articles WHERE title IS NOT NULL")
def search_addresses(spark, sf):
    return _articles(spark, sf).filter("title is not null").select("ordinal", urls.search_url("https://x.test/s?q={q}&p=1", F.col("title")).alias("url"))


@query(f"SELECT ordinal, {_SEGMENT} AS slug FROM articles WHERE {_TRIM.format(_SEGMENT)} <> '' AND NOT lower({_TRIM.format(_SEGMENT)}) IN ('cari', 'kategori', 'tag', 'search', 'topik') AND NOT regexp_matches(lower({_TRIM.format(_SEGMENT)}), '[?#&=/]|\\.(html?|json)$')")
def plain_slugs(spark, sf):
    slug = F.regexp_extract(discovery.path(F.col("source_url")), "([^/]*)/*$", 1)
    return _articles(spark, sf).select("ordinal", slug.alias("slug")).filter(discovery.is_slug(F.col("slug")))


@query(f"SELECT ordinal, CASE WHEN len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) >= 2 THEN 0 ELSE 1 END AS tier FROM articles WHERE source_url IS NOT NULL")
def specific_addresses(spark, sf):
    return _articles(spark, sf).filter("source_url is not null").select("ordinal", discovery.specific_first(F.col("source_url"))[0].cast("int").alias("tier"))


@query(f"SELECT ordinal, CASE WHEN contains(coalesce({_HOST.format('source_url')}, ''), 'glerbok') THEN 'first' WHEN contains(coalesce({_HOST.format('source_url')}, ''), 'well') THEN 'second' ELSE 'other' END AS extractor FROM articles")
def extractors(spark, sf):
    return _articles(spark, sf).select("ordinal", discovery.dispatch(F.col("source_url"), [("glerbok", "first"), ("well", "second")], "other").alias("extractor"))


@query("SELECT doc_id FROM documents WHERE contains(coalesce(title, ''), '404') OR contains(lower(title), 'halaman tidak ditemukan') OR contains(lower(text), 'halaman tidak ditemukan') OR contains(lower(title), 'page not found') OR contains(lower(text), 'page not found')")
def pages_not_found(spark, sf):
    return read_table(spark, sf, "documents").filter(discovery.not_found(F.col("title"), F.col("text"))).select("doc_id")


@query("SELECT url FROM trusted_sources WHERE contains(lower(site_name), 'info') OR contains(lower(url), 'info')")
def wanted_sources(spark, sf):
    return read_table(spark, sf, "trusted_sources").filter(discovery.source_matches(F.col("site_name"), F.col("url"), " Info ")).select("url")


@query(rf"SELECT ordinal, {_TRIM.format(r"regexp_replace(regexp_replace(title, ' \(2\)$', ''), '\|.*$', '')")} AS title FROM articles WHERE title IS NOT NULL")
def titles_without_suffix(spark, sf):
    return _articles(spark, sf).filter("title is not null").select("ordinal", text.strip_suffixes(F.col("title"), [" (2)"]).alias("title"))


@query("SELECT ordinal, list_aggregate(list_filter(ps, lambda x, i: list_position(list_transform(ps, lambda y: lower(y)), lower(x)) = i), 'string_agg', '|') AS names FROM (SELECT ordinal, string_split(category || ',' || upper(category), ',') AS ps FROM articles WHERE category IS NOT NULL)")
def distinct_names(spark, sf):
    ps = F.split(F.concat("category", F.lit(","), F.upper("category")), ",")
    return _articles(spark, sf).filter("category is not null").select("ordinal", F.array_join(text.distinct_folded(ps), "|").alias("names"))


@query("SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'id'")
def catalogue_of_hint(spark, sf):
    return search.by_hint(read_table(spark, sf, "documents"), "lang", "ID").select("doc_id")


@query("SELECT doc_id, upper(coalesce(title, '')) AS title, title IS NOT NULL AS fetched FROM documents WHERE title IS NOT NULL UNION ALL SELECT doc_id, title, false FROM documents WHERE title IS NULL")
def catalogue_fetched(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "title", F.col("text").alias("body"))
    fetched = d.filter("title is not null").select("doc_id", F.upper("title").alias("title"), "body")
    return discovery.with_catalogue(d, fetched, "doc_id").select("doc_id", "title", "fetched")


# ---- pages


def _listings(spark, sf):
    """Listing pages of 200 addresses each."""
    li = F.concat(F.lit('<li><a class="x" href="'), "source_url", F.lit('">x</a></li>'))
    plain = _articles(spark, sf).filter("source_url rlike '^https?://'").select((F.floor(F.col("ordinal") / 200) + 1).cast("int").alias("page"), "ordinal", li.alias("li"))
    pages = plain.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "li"))), lambda x: x["li"]), "").alias("html"))
    return pages.select(F.lit(0).alias("tier"), "page", F.lit("https://info-glerbok.example/list").alias("url"), "html")


_LINKS = r"""l AS (SELECT ordinal // 200 + 1 AS page, ordinal, regexp_replace(source_url, '\?[^#]*|#.*$', '') AS url FROM articles WHERE regexp_matches(source_url, '^https?://info-glerbok\.example/(a|artikel|read|topik|info|kesehatan)/.+') AND NOT regexp_matches(source_url, '/topik/mitos')),
p AS (SELECT DISTINCT ordinal // 200 + 1 AS page FROM articles WHERE regexp_matches(source_url, '^https?://')),
f AS (SELECT url, page FROM (SELECT url, page, row_number() OVER (PARTITION BY lower(url) ORDER BY page, ordinal) AS k FROM l) WHERE k = 1),
s AS (SELECT min(page) AS stop FROM p WHERE page NOT IN (SELECT page FROM f))"""


@query(f"WITH {_LINKS} SELECT url, page FROM f WHERE page < coalesce((SELECT stop FROM s), 1000000000)")
def paged_links(spark, sf):
    """Addresses from successive listing pages until one adds nothing."""
    pages = _listings(spark, sf)
    return search.paged(search.links_of(pages, SITE), pages, SITE).select("url", "page")


@query()
def site_search(spark, sf):
    """A search of one site over listings and pages written from the articles: found, fetched, read and valid."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<article><h1>"), esc("title"), F.lit("</h1><p>"), F.replace(esc("description"), F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></article>"))
    pages = _articles(spark, sf).filter(discovery.is_article(F.col("source_url"), SITE.rules)).groupBy(urls.without_query(F.col("source_url")).alias("url")).agg(F.min_by(page, "ordinal").alias("html"))
    return search.search(_listings(spark, sf), pages, SITE, "general").select("url", "title", F.size("paragraphs").alias("paragraphs"))


@query(f"SELECT ordinal, {_SEGMENT} AS slug FROM articles WHERE source_url IS NOT NULL AND {_TRIM.format(_SEGMENT)} <> '' AND NOT lower({_TRIM.format(_SEGMENT)}) IN ('cari', 'kategori', 'tag', 'search', 'topik') AND NOT regexp_matches(lower({_TRIM.format(_SEGMENT)}), '[?#&=/]|\\.(html?|json)$')")
def state_slugs(spark, sf):
    """Slugs read from the state script of a page."""
    slug = F.regexp_extract(discovery.path(F.col("source_url")), "([^/]*)/*$", 1)
    entry = F.struct(F.struct(F.array(F.struct(slug.alias("slug")), F.struct(F.lit("tag/x").alias("slug"))).alias("result")).alias("b"))
    value = F.replace(F.replace(F.to_json(F.struct(entry.alias("k1"), F.struct(F.lit(1).alias("x")).alias("k2"))), F.lit("&"), F.lit("&a;")), F.lit('"'), F.lit("&q;"))
    page = F.concat(F.lit('<html><script id="site-state" type="application/json">'), value, F.lit("</script></html>"))
    return _articles(spark, sf).filter("source_url is not null").select("ordinal", F.explode(search.state_results(page, "site-state")).alias("slug"))


# ---- the store


@query(_LOG + _BRIDGE + _OF_RUN + f" SELECT ordinal FROM articles WHERE {_IS_RUN}")
def listed_articles(spark, sf):
    """The list query with a run and a day: the run counts."""
    return store.listed(_articles(spark, sf), read_table(spark, sf, "run_articles"), _runs(spark, sf), RUN, DAY).select("ordinal")


@query()
def repair_counts(spark, sf):
    """What the repair pass changes."""
    return store.repaired(_articles(spark, sf).select("ordinal", "description", "image")).agg(F.count("*").alias("articles"), F.count_if("changed").alias("changed"))


@query("SELECT ordinal, title, source_url, coalesce(crawl_session, '') AS crawl_session FROM articles")
def stored_articles(spark, sf):
    """The store, written twice by the swapping sink and read again."""
    path = os.path.join(shared_folder(spark), f"store-{uuid.uuid4().hex}")
    a = _articles(spark, sf).select("ordinal", "title", "source_url", "crawl_session")
    sinks.write_store(a.filter("title is null"), path)
    sinks.write_store(a, path)
    back = spark.read.parquet(path)
    return back.select("ordinal", "title", "source_url", F.coalesce(F.col("crawl_session").cast("string"), F.lit("")).alias("crawl_session"))


@query(_LOG + ", n AS (SELECT max(run_number) + 1 AS run_number FROM log) SELECT 'run_new' AS id, run_number, printf('Run #%03d', run_number) AS display_name, 'Info' AS source, 'manual' AS trigger_kind, 'QUEUED' AS status FROM n")
def run_created(spark, sf):
    return runs.created(_runs(spark, sf), "run_new", " Info ").filter("id = 'run_new'").select("id", "run_number", "display_name", "source", "trigger_kind", "status")
