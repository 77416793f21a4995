"""Queries of the engine's own operators over the article tables, each with the SQL that must agree.

Those whose result SQL can't give on whole tables (order-dependent greedy checks by similarity, structural HTML work,
streams) have no SQL here and are held against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapisan.config import read_table
from tapisan.functions import html, paragraphs, text, urls
from tapisan.operators import classify, discovery, greedy, runs, store, validate

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Rules over words of this corpus; rules are a parameter of the classifier.
RULES = [
    ("Heart", ["tekanan darah", "denyut jantung", "degupan jantung", "heart rate", "blood pressure", "ritmo cardíaco", "presión arterial"]),
    ("Nutrition", ["pola makan", "tabiat makan", "asupan serat", "eating habits", "fibre intake", "hábitos de comida", "consumo de fibra"]),
    ("Respiratory", ["sesak napas", "batuk berdahak", "batuk berkahak", "shortness of breath", "wet cough", "tos con flema"]),
    ("Skin", ["alergi kulit", "alahan kulit", "ruam merah", "skin allergies", "red rashes", "manchas rojas"]),
    ("Sleep", ["kualitas tidur", "mutu tidur", "sleep quality", "calidad del sueño"]),
    ("Diabetes", ["kadar gula", "paras gula", "sugar levels", "nivel de azúcar"]),
]
KEYWORD_RULES = classify.Rules(RULES, default="General Health")
#: Named sources, by a part of their host.
NAMES = [("info-glerbok", "Info Glerbok"), ("wellgluzek", "WellGluzek"), ("medikagisul", "MedikaGisul")]
RUN, DAY = "Run #010", "2025-06-10"

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
_HOST = r"nullif(lower(regexp_extract(" + _TRIM + r", '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "articles")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- text and address functions


@query(f"""
SELECT ordinal, CASE WHEN t <> '' OR u <> '' THEN 'art_' || substr(sha256(t || '|' || u), 1, 12) END AS article_id
FROM (SELECT ordinal, {_TRIM.format("coalesce(title, '')")} AS t, {_TRIM.format("coalesce(source_url, '')")} AS u FROM articles)""")
def article_ids(spark, sf):
    return _articles(spark, sf).select("ordinal", text.article_id(F.col("title"), F.col("source_url")).alias("article_id"))


@query(f"""
SELECT ordinal, {_NORMAL.format("title")} AS normal_title, sha256({_NORMAL.format("title")}) AS title_hash FROM articles WHERE title IS NOT NULL""")
def normal_titles(spark, sf):
    n = text.normal(F.col("title"))
    return _articles(spark, sf).filter("title is not null").select("ordinal", n.alias("normal_title"), F.sha2(n, 256).alias("title_hash"))


_TO = "'" + '"' * 5 + "''" * 3 + "--'"
_FIX = r"regexp_replace(replace(translate({0}, '“”„«»‘’‚—–' || chr(65533) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173) || '*', " + _TO + r"), '…', '...'), '[^\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}\s\p{{Z}}]', '', 'g')"
_COLLAPSE = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g')"
_REMOVED = (
    r"regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\b(?:home|health topics|news|articles)\s*(?:[>/»|]\s*)+[^.\n!]+(?:[.!\n]|$)', '', 'g'),"
    r" '(?i)\b(?:skip to (?:main )?content|back to top|click here to read more|read (?:full )?article|continue reading|table of contents)\b[:\s\-.]*', '', 'g'),"
    r" '(?i)\b(?:advertisement|sponsored content|promoted story|advertorial)\b[:\s\-.]*[^.!\n]*(?:[.!\n]|$)', '', 'g')"
)
_PLAIN = r"regexp_replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', chr(160)), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '<[^>]*>', ' ', 'g')"
def _title_sql(c: str) -> str:
    return "trim(" + _COLLAPSE.format(_REMOVED.format(_FIX.format(_PLAIN.format(c)))) + r", ' -|/:' || chr(9) || chr(13) || chr(10))"



@query("SELECT ordinal, " + _title_sql("title") + " AS clean_title FROM articles WHERE title IS NOT NULL")
def clean_titles(spark, sf):
    return _articles(spark, sf).filter("title is not null").select("ordinal", text.clean_title(F.col("title")).alias("clean_title"))


_CLEAN_CAT = _title_sql("category")


@query(rf"""
WITH c AS (SELECT ordinal, {_CLEAN_CAT} AS clean FROM articles WHERE category IS NOT NULL),
p AS (SELECT ordinal, clean, list_filter(list_transform(string_split(clean, ','), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS parts FROM c),
t AS (SELECT ordinal, clean, list_transform(parts, lambda x: CASE WHEN x = lower(x) THEN list_aggregate(list_transform(regexp_extract_all(x, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', '') ELSE x END) AS parts FROM p)
SELECT ordinal, CASE WHEN len(parts) > 0 THEN list_aggregate(parts, 'string_agg', ' , ') ELSE clean END AS clean_category FROM t""")
def clean_categories(spark, sf):
    return _articles(spark, sf).filter("category is not null").select("ordinal", text.clean_category(F.col("category")).alias("clean_category"))


@query(rf"""
WITH p AS (SELECT ordinal, list_filter(list_transform(string_split(description, chr(10) || chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ps FROM articles WHERE description IS NOT NULL)
SELECT ordinal, len(ps) AS paragraphs, coalesce(list_aggregate(list_transform(ps, lambda x: strlen(x)), 'sum'), 0)::BIGINT AS bytes, coalesce(len(list_filter(ps, lambda x: strlen(x) >= 15)), 0) AS long_paragraphs, md5(coalesce(list_aggregate(ps, 'string_agg', chr(10) || chr(10)), '')) AS stored_md5 FROM p""")
def description_codec(spark, sf):
    ps = text.decode_paragraphs(F.col("description"))
    size = F.aggregate(ps, F.lit(0).cast("bigint"), lambda s, p: s + F.octet_length(p))
    return _articles(spark, sf).filter("description is not null").select("ordinal", F.size(ps).cast("bigint").alias("paragraphs"), size.alias("bytes"), F.size(F.filter(ps, lambda p: F.octet_length(p) >= 15)).cast("bigint").alias("long_paragraphs"), F.md5(text.encode_paragraphs(ps)).alias("stored_md5"))


@query(rf"""
WITH s AS (SELECT doc_id, string_split(text, '. ') AS parts FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM s),
k AS (SELECT doc_id, pos, {_TRIM.format("part")} AS part FROM u),
l AS (SELECT doc_id, lower(part) AS low, lag(lower(part)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k WHERE part <> '')
SELECT doc_id, count(*) AS sentences, count(*) FILTER (before IS NULL OR low <> before) AS kept FROM l GROUP BY doc_id""")
def sentence_repeats(spark, sf):
    """Sentences of each document before and after successive equal ones are dropped."""
    parts = F.filter(F.transform(F.split("text", r"\. "), text.utrim), lambda x: x != "")
    fold = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("last")), lambda s, x: F.struct((s["n"] + F.when(s["last"].isNull() | (s["last"] != F.lower(x)), 1).otherwise(0)).alias("n"), F.lower(x).alias("last")))
    return read_table(spark, sf, "documents").filter("text is not null").select("doc_id", F.size(parts).cast("bigint").alias("sentences"), fold["n"].alias("kept")).filter("sentences > 0")


@query()
def clean_paragraphs(spark, sf):
    ps = _articles(spark, sf).filter("description is not null").select("ordinal", paragraphs.clean_stored(F.col("description")).alias("ps"))
    return ps.select("ordinal", F.size("ps").alias("paragraphs"), F.md5(text.encode_paragraphs(F.col("ps"))).alias("stored_md5"))


@query()
def page_fields(spark, sf):
    """Articles written as pages and read again: title, image, category and paragraphs with the tier each came from."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ps = F.array_join(F.transform(text.decode_paragraphs(F.coalesce("description", F.lit(""))), lambda p: F.concat(F.lit("<p>"), escaped(p))), "")
    page = F.concat(F.lit("<html><head><script>x()</script><meta property='og:image' content='"), F.coalesce("image", F.lit("")), F.lit("'><meta name='keywords' content='"), F.replace(escaped(F.coalesce("category", F.lit(""))), F.lit("'"), F.lit("&#39;")), F.lit("'></head><body><nav><a href='/'>Home</a></nav><article><h1>"), escaped(F.coalesce("title", F.lit(""))), F.lit("</h1>"), ps, F.lit("</article><footer>x</footer></body></html>"))
    out = _articles(spark, sf).select("ordinal", html.page_fields(page).alias("f"))
    return out.select("ordinal", "f.title", "f.title_tier", "f.image", "f.image_tier", "f.category_tier", F.size("f.paragraphs").alias("blocks"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN regexp_extract(substr(text, 1, 500), '(?s)^(.{101,}[.!?])', 1) <> '' THEN regexp_extract(substr(text, 1, 500), '(?s)^(.{101,}[.!?])', 1) ELSE substr(text, 1, 500) || '...' END AS summary FROM documents WHERE text IS NOT NULL""")
def summaries(spark, sf):
    return read_table(spark, sf, "documents").filter("text is not null").select("doc_id", text.truncate_sentence(F.col("text")).alias("summary"))


@query(rf"""
SELECT ordinal, {_HOST.format("source_url")} AS host, nullif(lower(regexp_extract({_TRIM.format("source_url")}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '') AS scheme, regexp_replace(lower({_TRIM.format("source_url")}), '/+$', '') AS store_key, lower({_TRIM.format("source_url")}) AS dedup_key,
       regexp_replace(source_url, '[?#].*$', '') AS plain, regexp_replace(source_url, '\?[^#]*', '') AS no_query,
       CASE WHEN contains(source_url, 'page=all') THEN source_url WHEN contains(source_url, '?') THEN source_url || '&page=all' ELSE source_url || '?page=all' END AS one_page
FROM articles WHERE source_url IS NOT NULL""")
def url_parts(spark, sf):
    u = F.col("source_url")
    return _articles(spark, sf).filter("source_url is not null").select("ordinal", urls.host(u).alias("host"), urls.scheme(u).alias("scheme"), urls.store_key(u).alias("store_key"), urls.dedup_key(u).alias("dedup_key"), urls.without_query(u).alias("plain"), urls.without_query(u, keep_fragment=True).alias("no_query"), urls.all_pages(u).alias("one_page"))


_U, _I = _TRIM.format("coalesce(source_url, '')"), _TRIM.format("coalesce(image, '')")
_SCHEME = r"nullif(lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '')"
_HOSTOK = "(contains(coalesce({0}, ''), '.') AND coalesce({0}, '') <> 'localhost')"
_IMAGE_ERROR = f"CASE WHEN {_I} = '' THEN 'empty' WHEN {_I} = '-' OR starts_with({_I}, 'gambar/') THEN NULL WHEN {_SCHEME.format(_I)} IS NULL THEN 'malformed' WHEN {_SCHEME.format(_I)} NOT IN ('http', 'https') THEN 'scheme' WHEN NOT {_HOSTOK.format(_HOST.format('image'))} THEN 'host' END"
_URL_ERROR = f"CASE WHEN {_U} = '' THEN 'empty' WHEN NOT regexp_matches(lower({_U}), '^https?://') THEN 'scheme' WHEN NOT {_HOSTOK.format(_HOST.format('source_url'))} THEN 'host' END"


@query(f"SELECT ordinal, {_URL_ERROR} AS url_error, {_IMAGE_ERROR} AS image_error FROM articles")
def url_validation(spark, sf):
    return _articles(spark, sf).select("ordinal", urls.source_error(F.col("source_url")).alias("url_error"), urls.image_error(F.col("image")).alias("image_error"))


@query(rf"""
SELECT ordinal, CASE WHEN regexp_matches(lower(i), '\.(jpg|jpeg|png)\.webp$') OR (ends_with(lower(i), '.webp') AND contains(lower(i), 'cloudfront.net')) THEN regexp_replace(i, '\.webp$', '') ELSE i END AS fixed_image
FROM (SELECT ordinal, {_TRIM.format("image")} AS i FROM articles WHERE image IS NOT NULL)""")
def image_fixes(spark, sf):
    return _articles(spark, sf).filter("image is not null").select("ordinal", urls.fixed_image(F.col("image")).alias("fixed_image"))


# ---- checks of records

_SIZE = f"coalesce(list_aggregate(list_transform(list_filter(list_transform(string_split(description, chr(10) || chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> ''), lambda x: strlen(x)), 'sum'), 0)"
_REASON = f"CASE WHEN t = '' THEN 'empty_title' WHEN strlen(t) < 5 THEN 'short_title' WHEN size = 0 THEN 'empty_description' WHEN size < 10 THEN 'short_description' WHEN NOT blank_image AND image_error IS NOT NULL THEN 'bad_image' END"
_CHECKED = f"(SELECT ordinal, coalesce(title, '') AS t, {_SIZE} AS size, {_I} = '' AS blank_image, {_IMAGE_ERROR} AS image_error FROM articles)"


@query(f"SELECT ordinal, {_REASON} AS reason FROM {_CHECKED} WHERE {_REASON} IS NOT NULL")
def reject_reasons(spark, sf):
    why = validate.first_reason(F.col("title"), text.decode_paragraphs(F.col("description")), F.col("image"))
    return _articles(spark, sf).select("ordinal", why.alias("reason")).filter("reason is not null")


@query(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM {_CHECKED} GROUP BY 1")
def reject_counts(spark, sf):
    why = validate.first_reason(F.col("title"), text.decode_paragraphs(F.col("description")), F.col("image"))
    return _articles(spark, sf).groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT ordinal, CASE WHEN coalesce(title, '') = '' THEN 'empty_title' WHEN strlen(title) < 5 THEN 'short_title' WHEN """ + _TRIM.format("coalesce(category, '')") + """ = '' THEN 'empty_category' WHEN coalesce(description, '') = '' THEN 'empty_description' WHEN strlen(description) < 10 THEN 'short_description' END AS reason FROM articles""")
def worker_reasons(spark, sf):
    return _articles(spark, sf).select("ordinal", validate.first_reason_worker(F.col("title"), F.col("category"), F.col("description")).alias("reason"))


@query(f"""
SELECT ordinal, concat_ws('; ', CASE WHEN {_TRIM.format("coalesce(title, '')")} = '' THEN 'missing title' END, CASE WHEN {_I} = '' THEN 'missing image' WHEN {_IMAGE_ERROR} IS NOT NULL THEN 'invalid image' END, CASE WHEN {_TRIM.format("coalesce(category, '')")} = '' THEN 'missing category' END, CASE WHEN strlen(coalesce(description, '')) < 100 THEN 'short body' END, CASE WHEN {_URL_ERROR} IS NOT NULL THEN 'invalid url' END) AS reasons FROM articles""")
def page_reasons(spark, sf):
    c = F.col
    return _articles(spark, sf).select("ordinal", validate.all_reasons(c("title"), c("image"), c("category"), c("description"), c("source_url"), 100, True).alias("reasons"))


# ---- classification


def _rules_sql() -> str:
    t, b = (rf"regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{Nd}}\s\p{{Z}}''-]', ' ', 'g')" for c in ("title", "description"))
    rows = " UNION ALL ".join(f"SELECT {n} AS n, '{c}' AS category, '{k}' AS k, {len(k.split())} AS words, '(?i)\\b{'[\\s\\-]+'.join(k.split())}\\b' AS p" for n, (c, ks) in enumerate(RULES) for k in ks)
    return f"""
WITH k AS ({rows}), a AS (SELECT ordinal, {t} AS t, {b} AS b FROM articles),
h AS (SELECT a.ordinal, k.n, k.category, k.k, CASE WHEN regexp_matches(a.t, k.p) THEN 3 * words ELSE 0 END AS ts, CASE WHEN regexp_matches(a.b, k.p) THEN words ELSE 0 END AS bs FROM a, k),
s AS (SELECT ordinal, n, category, sum(ts) AS ts, sum(bs) AS bs, string_agg(k, '|' ORDER BY k) FILTER (ts > 0 OR bs > 0) AS keywords FROM h GROUP BY ordinal, n, category),
r AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY ts + bs DESC, ts DESC, n) AS place FROM s)
SELECT ordinal, CASE WHEN ts + bs > 0 THEN category ELSE 'General Health' END AS category, CAST(ts + bs AS BIGINT) AS score, CAST(ts AS BIGINT) AS title_score, CASE WHEN ts + bs > 0 THEN keywords ELSE '' END AS keywords FROM r WHERE place = 1"""


@query(_rules_sql())
def classified(spark, sf):
    out = classify.classify(_articles(spark, sf).select("ordinal", "title", "description"), "title", "description", KEYWORD_RULES, "c")
    return out.select("ordinal", "c.category", F.col("c.score").cast("bigint").alias("score"), F.col("c.title_score").cast("bigint").alias("title_score"), F.array_join(F.array_sort("c.keywords"), "|").alias("keywords"))


@query("SELECT category, count(*) AS n, sum(score)::BIGINT AS score FROM (" + _rules_sql() + ") GROUP BY category")
def classified_counts(spark, sf):
    return classified(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


# ---- duplicates


@query(f"""
WITH n AS (SELECT ordinal, {_NORMAL.format("coalesce(title, '')")} AS t, sha256(coalesce(description, '')) AS d FROM articles)
SELECT min(ordinal) AS first_ordinal, count(*) AS copies, t AS normal_title FROM n GROUP BY t, d HAVING count(*) > 1""")
def exact_copies(spark, sf):
    keyed = _articles(spark, sf).select("ordinal", text.normal(F.coalesce("title", F.lit(""))).alias("normal_title"), F.sha2(F.coalesce("description", F.lit("")), 256).alias("d"))
    return keyed.groupBy("normal_title", "d").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("copies")).filter("copies > 1").drop("d")


@query(f"""
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY ordinal) AS rn, ordinal, nullif(regexp_replace(lower({_U}), '/+$', ''), '') AS k, lower({_TRIM.format("coalesce(title, '')")}) AS n FROM articles),
g AS (SELECT 0::BIGINT AS rn, -1::BIGINT AS ordinal, true AS accepted, []::VARCHAR[] AS ks, []::VARCHAR[] AS ns
  UNION ALL
  SELECT rn, ordinal, ok, CASE WHEN ok AND k IS NOT NULL THEN list_append(ks, k) ELSE ks END, CASE WHEN ok THEN list_append(ns, n) ELSE ns END
  FROM (SELECT r.rn, r.ordinal, r.k, r.n, g.ks, g.ns, NOT (coalesce(list_contains(g.ks, r.k), false) OR list_contains(g.ns, r.n)) AS ok FROM g JOIN r ON r.rn = g.rn + 1))
SELECT ordinal, accepted FROM g WHERE rn > 0""")
def store_unique(spark, sf):
    return greedy.store_unique(_articles(spark, sf), "ordinal", "title", "source_url").select("ordinal", "accepted")


@query()
def fuzzy_unique(spark, sf):
    return greedy.fuzzy_unique(_articles(spark, sf).select("ordinal", "title", "source_url"), "ordinal", "title", "source_url").select("ordinal", "accepted")


@query()
def fuzzy_merge(spark, sf):
    """The later half of arrivals merged into a store that holds the earlier half."""
    a = _articles(spark, sf).select("ordinal", "title", "source_url")
    middle = a.agg(((F.min("ordinal") + F.max("ordinal")) / 2).cast("bigint").alias("m"))
    split = a.crossJoin(F.broadcast(middle))
    return greedy.merged(split.filter("ordinal <= m").drop("m"), split.filter("ordinal > m").drop("m"), "ordinal", "title", "source_url").select("ordinal", "accepted")


@query(f"""
WITH n AS (SELECT ordinal, nullif(lower({_U}), '') AS k, {_NORMAL.format("coalesce(title, '')")} AS t FROM articles),
f AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY k) AS fk, k, min(ordinal) OVER (PARTITION BY t) AS ft FROM n)
SELECT ordinal, CASE WHEN k IS NOT NULL AND fk < ordinal THEN 'url' ELSE 'title' END AS reason FROM f WHERE (k IS NOT NULL AND fk < ordinal) OR ft < ordinal""")
def duplicate_reasons(spark, sf):
    return greedy.reasons(_articles(spark, sf), "ordinal", "title", "source_url")


@query()
def similar_titles(spark, sf):
    return greedy.similar_titles(_articles(spark, sf).select(text.normal(F.col("title")).alias("t"))).select(F.col("t").alias("title_a"), F.col("u").alias("title_b"), F.round("similarity", 6).alias("similarity"))


# ---- the run log


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.sync_fields(runs.latest_state(read_table(spark, sf, "runs")))


def _sync_sql() -> str:
    """The steps of runs.sync_fields as chained CTEs."""
    steps, at = [], "runs"

    def step(sets: dict[str, str]) -> None:
        nonlocal at
        name = f"s{len(steps)}"
        steps.append(f"{name} AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in sets.items())}) FROM {at})")
        at = name

    def pair(a: str, b: str) -> None:
        for x, y in ((a, b), (b, a)):
            step({x: f"CASE WHEN coalesce({x}, 0) = 0 AND coalesce({y}, 0) > 0 THEN {y} ELSE coalesce({x}, 0) END"})

    for a, b in (("id", "history_id"), ("source", "trusted_source")):
        step({a: f"CASE WHEN coalesce({a}, '') = '' THEN coalesce({b}, '') ELSE {a} END"})
        step({b: f"CASE WHEN coalesce({b}, '') = '' THEN {a} ELSE {b} END"})
    pair("target_articles", "limit_n")
    pair("discovered_articles", "total_crawled")
    step({"saved_articles": "CASE WHEN coalesce(saved_articles, 0) = 0 THEN CASE WHEN coalesce(total_new, 0) > 0 THEN total_new ELSE coalesce(total_success, 0) END ELSE saved_articles END"})
    for c, o in (("total_success", "saved_articles"), ("total_new", "saved_articles"), ("valid_articles", "total_success")):
        step({c: f"CASE WHEN coalesce({c}, 0) = 0 THEN greatest({o}, 0) ELSE {c} END"})
    pair("duplicate_articles", "total_duplicate")
    pair("invalid_articles", "total_failed")
    pair("duration", "duration_sec")
    return f"""latest AS (SELECT * FROM runs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, coalesce(total_crawled, -1) DESC, coalesce(status, '') DESC) = 1),
""" + ",\n".join(steps).replace("FROM runs)", "FROM latest)", 1) + f",\nlog AS (SELECT * FROM {at})"


_LOG = "WITH " + _sync_sql()
_COUNTS = ["limit_n", "target_articles", "total_crawled", "discovered_articles", "valid_articles", "total_success", "total_new", "saved_articles", "total_duplicate", "duplicate_articles", "total_failed", "invalid_articles"]


@query(_LOG + f" SELECT id, history_id, source, trusted_source, {', '.join(_COUNTS)}, duration, duration_sec FROM log")
def synced_runs(spark, sf):
    return _runs(spark, sf).select("id", "history_id", "source", "trusted_source", *_COUNTS, "duration", "duration_sec")


@query(_LOG + """ SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS runs_count, CAST(sum(CASE WHEN total_new > 0 THEN total_new ELSE total_success END) AS BIGINT) AS total_items,
  string_agg(id, ',' ORDER BY started_at DESC, run_number DESC, id DESC) AS run_ids FROM log WHERE started_at IS NOT NULL GROUP BY 1""")
def run_days(spark, sf):
    return runs.run_days(_runs(spark, sf)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "runs_count", "total_items", F.array_join("run_ids", ",").alias("run_ids"))


@query(_LOG + ", d AS (SELECT max(CAST(started_at AS DATE)) AS d FROM log) SELECT id, display_name, status FROM log, d WHERE CAST(started_at AS DATE) = d")
def runs_of_last_day(spark, sf):
    log = _runs(spark, sf)
    last = log.agg(F.max(F.to_date("started_at"))).first()[0]
    return runs.on_day(log, F.lit(last)).select("id", "display_name", "status")


@query(_LOG + " SELECT id, run_number, status FROM log ORDER BY started_at DESC NULLS LAST, run_number DESC LIMIT 1")
def latest_run(spark, sf):
    return runs.latest(_runs(spark, sf)).select("id", "run_number", "status")


@query(_LOG + " SELECT id, source, cron_run_id FROM log WHERE lower(source) = 'info glerbok'")
def runs_of_source(spark, sf):
    return runs.of_source(_runs(spark, sf), " Info Glerbok ").select("id", "source", "cron_run_id")


@query(_LOG + ", p AS (SELECT min(lower(cron_run_id)) AS p FROM log WHERE cron_run_id <> '') SELECT id, cron_run_id FROM log, p WHERE lower(cron_run_id) = p")
def runs_of_parent(spark, sf):
    log = _runs(spark, sf)
    parent = log.filter("cron_run_id <> ''").agg(F.min(F.lower("cron_run_id"))).first()[0]
    return runs.of_source(log, parent=parent or "-").select("id", "cron_run_id")


@query(_LOG + f" SELECT id, run_number, status, total_new FROM log WHERE id = '{RUN}' OR lower(trim(display_name)) = lower('{RUN}')")
def run_detail(spark, sf):
    return runs.detail(_runs(spark, sf), RUN).select("id", "run_number", "status", "total_new")


@query(_LOG + ", p AS (SELECT id, row_number() OVER (ORDER BY started_at DESC NULLS LAST, run_number DESC, id) AS place FROM log) SELECT id, place FROM p")
def runs_newest_first(spark, sf):
    return runs.numbered(_runs(spark, sf), [F.col("started_at").desc_nulls_last(), F.col("run_number").desc(), F.col("id")]).select("id", F.col("place").cast("bigint").alias("place"))


@query("SELECT coalesce(max(run_number), 0) + 1 AS next_number FROM runs")
def next_run_number(spark, sf):
    return runs.next_number(read_table(spark, sf, "runs"))


@query(_LOG + """, e AS (SELECT id, unnest(map_entries(source_stats)) AS e FROM log WHERE source_stats IS NOT NULL)
SELECT id, e.key AS source_name, e.value.crawled AS crawled, e.value.success AS success, CASE WHEN e.value.status = 'FAILED' THEN 'FAILED' WHEN e.value.success >= e.value.target_n THEN 'SUCCESS' WHEN e.value.success > 0 THEN 'PARTIAL' ELSE 'NO_NEW_ARTICLES' END AS outcome FROM e""")
def source_outcomes(spark, sf):
    e = _runs(spark, sf).select("id", F.explode("source_stats").alias("source_name", "s"))
    return e.select("id", "source_name", "s.crawled", "s.success", runs.source_status(F.col("s.success"), F.col("s.failed"), F.coalesce("s.status", F.lit("")), F.col("s.target_n")).alias("outcome"))


@query(_LOG + """, e AS (SELECT id, unnest(map_values(source_stats)) AS s FROM log WHERE source_stats IS NOT NULL),
b AS (SELECT id, coalesce(bool_or(s.status = 'FAILED' OR (s.failed > 0 AND s.success = 0)), false) AS f, coalesce(bool_or(s.status = 'SUCCESS' OR s.success > 0), false) AS g FROM e GROUP BY id)
SELECT log.id, CASE WHEN coalesce(f, false) AND coalesce(g, false) THEN 'PARTIAL_SUCCESS' WHEN coalesce(f, false) THEN 'FAILED' ELSE 'COMPLETED' END AS outcome FROM log LEFT JOIN b ON log.id = b.id""")
def run_outcomes(spark, sf):
    return _runs(spark, sf).select("id", runs.run_status(F.col("source_stats")).alias("outcome"))


@query("""SELECT count(*) FILTER (coalesce(status, 'PENDING') = 'SUCCESS') AS completed, count(*) FILTER (coalesce(status, 'PENDING') = 'FAILED_PERMANENT') AS failed, count(*) FILTER (coalesce(status, 'PENDING') = 'RUNNING') AS running,
  count(*) FILTER (coalesce(status, 'PENDING') NOT IN ('SUCCESS', 'FAILED_PERMANENT', 'RUNNING')) AS pending, CAST(coalesce(sum(stores_found), 0) AS BIGINT) AS stores FROM crawl_tasks""")
def checkpoint_counts(spark, sf):
    return runs.checkpoint_counts(read_table(spark, sf, "crawl_tasks"))


@query("SELECT count(*) AS remaining FROM range(10, 81) r(id) WHERE id NOT IN (SELECT id FROM crawl_tasks WHERE status IN ('SUCCESS', 'FAILED_PERMANENT'))")
def checkpoint_remaining(spark, sf):
    return runs.remaining(read_table(spark, sf, "crawl_tasks"), 80, 10)


@query("""WITH w AS (SELECT id, 'query ' || id AS query_text FROM range(1, 121) r(id))
SELECT coalesce(t.id, w.id) AS id, coalesce(t.query_text, w.query_text) AS query_text, CASE WHEN t.status = 'RUNNING' OR t.status IS NULL THEN 'PENDING' ELSE t.status END AS status, coalesce(t.attempts, 0) AS attempts, coalesce(t.stores_found, 0) AS stores_found FROM crawl_tasks t FULL JOIN w ON t.id = w.id""")
def checkpoint_resumed(spark, sf):
    wanted = spark.range(1, 121).select("id", F.concat(F.lit("query "), F.col("id")).alias("query_text"))
    return runs.resumed(read_table(spark, sf, "crawl_tasks"), wanted)


@query("""WITH h AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'error' THEN 'FAILED_RETRY' WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM events)
SELECT id, arg_max(status, seq) AS status, count(*) FILTER (status = 'RUNNING') AS attempts FROM h GROUP BY id""")
def checkpoint_transitions(spark, sf):
    e = read_table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "FAILED_RETRY").when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "view", "RUNNING").otherwise("PENDING")
    h = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.lit(0).alias("stores_found"))
    return runs.transitions(h).select("id", "status", "attempts")


@query("""WITH t AS (SELECT count(*) AS processed, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS workers, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS s FROM events)
SELECT processed, errors, workers, round(least(100.0, processed / 20000.0 * 100), 6) AS progress, round(processed / (s / 60), 6) AS per_minute, printf('%02d:%02d:%02d', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60, CAST(floor(s) AS BIGINT) % 60) AS elapsed FROM t""")
def telemetry(spark, sf):
    t = runs.telemetry(read_table(spark, sf, "events"), "user_id", "event_type", "ts", 20000)
    return t.select("processed", "errors", "workers", F.round("progress", 6).alias("progress"), F.round("per_minute", 6).alias("per_minute"), "elapsed")


@query("""WITH l AS (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR AS w FROM events), d AS (SELECT event_id, w, date_trunc('day', w) + INTERVAL 1 HOUR AS t FROM l)
SELECT event_id, strftime(CASE WHEN t > w THEN t ELSE t + INTERVAL 24 HOUR END - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS next_run FROM d""")
def next_run_times(spark, sf):
    at = F.col("ts").cast("timestamp")
    return read_table(spark, sf, "events").select("event_id", F.date_format(runs.next_run(at, 1, 0), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


# ---- the store


@query("SELECT name, count, row_number() OVER (ORDER BY first) AS place FROM (SELECT 'All Crawls' AS name, count(*) AS count, -1 AS first FROM articles UNION ALL SELECT CASE WHEN " + _TRIM.format("coalesce(crawl_session, '')") + " = '' THEN 'Run #001' ELSE crawl_session END AS name, count(*) AS count, min(ordinal) AS first FROM articles GROUP BY 1)")
def session_counts(spark, sf):
    return store.sessions(_articles(spark, sf)).select("name", "count", "place")


_BRIDGE = ", b AS (SELECT DISTINCT run_id, article_id FROM run_articles)"
_OWNER = _BRIDGE + """, o AS (SELECT b.article_id, b.run_id FROM b JOIN log ON b.run_id = log.id QUALIFY row_number() OVER (PARTITION BY b.article_id ORDER BY coalesce(CAST(log.started_at AS TIMESTAMP), TIMESTAMP '1970-01-01') DESC, coalesce(log.run_number, -1) DESC, b.run_id DESC) = 1)"""


@query(_LOG + _OWNER + f""", n AS (SELECT id AS rid, any_value(display_name) AS name FROM log GROUP BY id),
x AS (SELECT a.ordinal, coalesce(o.run_id, CASE WHEN {_TRIM.format("coalesce(a.run_id, '')")} <> '' THEN a.run_id END, 'run_baseline') AS run_id, a.crawl_session FROM articles a LEFT JOIN o ON a.id = o.article_id)
SELECT x.ordinal, x.run_id, coalesce(nullif(n.name, ''), CASE WHEN {_TRIM.format("coalesce(x.crawl_session, '')")} <> '' THEN x.crawl_session END, 'Crawl #1') AS crawl_session FROM x LEFT JOIN n ON x.run_id = n.rid""")
def article_lineage(spark, sf):
    return store.annotated(_articles(spark, sf).select("ordinal", "id", "run_id", "crawl_session"), read_table(spark, sf, "run_articles"), _runs(spark, sf)).select("ordinal", "run_id", "crawl_session")


_OF_RUN = f", k AS (SELECT id, display_name FROM log WHERE id = '{RUN}' OR lower(display_name) = lower('{RUN}')), m AS (SELECT article_id FROM b WHERE run_id IN (SELECT id FROM k))"
_IS_RUN = f"(coalesce(lower(run_id) IN (SELECT lower(id) FROM k), false) OR coalesce(lower(crawl_session) IN (SELECT lower(display_name) FROM k), false) OR coalesce(lower(run_id) IN (SELECT lower(display_name) FROM k), false) OR coalesce(lower(crawl_session) IN (SELECT lower(id) FROM k), false) OR lower(coalesce(crawl_session, '')) = lower('{RUN}') OR lower(coalesce(run_id, '')) = lower('{RUN}') OR coalesce(id IN (SELECT article_id FROM m), false))"


@query(_LOG + _BRIDGE + _OF_RUN + f" SELECT ordinal FROM articles WHERE {_IS_RUN}")
def articles_of_run(spark, sf):
    return store.by_run(_articles(spark, sf), read_table(spark, sf, "run_articles"), _runs(spark, sf), RUN).select("ordinal")


_OF_DAY = f", k AS (SELECT id, display_name FROM log WHERE CAST(started_at AS DATE) = DATE '{DAY}'), m AS (SELECT article_id FROM b WHERE run_id IN (SELECT id FROM k))"


@query(_LOG + _BRIDGE + _OF_DAY + " SELECT ordinal FROM articles WHERE coalesce(run_id IN (SELECT id FROM k UNION ALL SELECT display_name FROM k), false) OR coalesce(crawl_session IN (SELECT id FROM k UNION ALL SELECT display_name FROM k), false) OR coalesce(id IN (SELECT article_id FROM m), false)")
def articles_of_day(spark, sf):
    return store.by_day(_articles(spark, sf), read_table(spark, sf, "run_articles"), _runs(spark, sf), DAY).select("ordinal")


@query(_LOG + _BRIDGE + _OF_RUN + f" SELECT {', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in store.STORED)} FROM articles WHERE {_IS_RUN}")
def export_of_run(spark, sf):
    return store.exported(store.by_run(_articles(spark, sf), read_table(spark, sf, "run_articles"), _runs(spark, sf), RUN))


@query(_LOG + _BRIDGE + _OF_RUN + f""" SELECT (SELECT count(*) FROM articles WHERE NOT {_IS_RUN}) AS articles_left, (SELECT count(*) FROM run_articles WHERE run_id NOT IN (SELECT id FROM k)) AS bridge_left, (SELECT count(*) FROM log WHERE id NOT IN (SELECT id FROM k)) AS runs_left""")
def run_deleted(spark, sf):
    a, b, r = store.without_run(_articles(spark, sf), read_table(spark, sf, "run_articles"), _runs(spark, sf), RUN)
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(a, "articles_left").crossJoin(one(b, "bridge_left")).crossJoin(one(r, "runs_left"))


@query("WITH f AS (SELECT min(ordinal) AS o FROM articles WHERE id = (SELECT min(id) FROM articles)) SELECT ordinal FROM articles WHERE ordinal <> (SELECT o FROM f)")
def article_deleted(spark, sf):
    a = _articles(spark, sf)
    return store.without_article(a, a.agg(F.min("id")).first()[0] or "-").select("ordinal")


def _places_sql(way: str) -> str:
    return f"SELECT ordinal, row_number() OVER (ORDER BY (coalesce(scraped_at, '') = ''), CASE WHEN coalesce(scraped_at, '') <> '' THEN scraped_at END {way}, CASE WHEN coalesce(scraped_at, '') = '' THEN coalesce(title, '') END NULLS FIRST, ordinal) AS place FROM articles"


@query(_places_sql("DESC NULLS LAST"))
def articles_newest(spark, sf):
    return runs.numbered(_articles(spark, sf), store.order_by_time(True)).select("ordinal", F.col("place").cast("bigint").alias("place"))


@query(_places_sql("ASC NULLS FIRST"))
def articles_oldest(spark, sf):
    return runs.numbered(_articles(spark, sf), store.order_by_time(False)).select("ordinal", F.col("place").cast("bigint").alias("place"))


@query(f"WITH s AS (SELECT ordinal, {_HOST.format('source_url')} AS host FROM articles), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ordinal) AS k FROM s) SELECT ordinal, host FROM r WHERE k <= 3")
def first_of_source(spark, sf):
    host = urls.host(F.col("source_url"))
    return store.limited(_articles(spark, sf), host, 3).select("ordinal", host.alias("host"))


@query(f"SELECT url, {_HOST.format('url')} AS host, CASE WHEN contains(coalesce({_HOST.format('url')}, ''), 'info-glerbok') THEN 'Info Glerbok' WHEN contains(coalesce({_HOST.format('url')}, ''), 'wellgluzek') THEN 'WellGluzek' WHEN contains(coalesce({_HOST.format('url')}, ''), 'medikagisul') THEN 'MedikaGisul' ELSE coalesce({_HOST.format('url')}, '') END AS display FROM trusted_sources")
def source_items(spark, sf):
    return read_table(spark, sf, "trusted_sources").select("url", urls.host(F.col("url")).alias("host"), urls.source_name(F.col("url"), NAMES).alias("display"))


@query(rf"""WITH s AS (SELECT url, regexp_replace(lower({_TRIM.format("url")}), '/+$', '') AS k FROM trusted_sources WHERE {_TRIM.format("coalesce(url, '')")} <> ''), d AS (SELECT 'https://' || h AS url, 'https://' || h AS k FROM (SELECT DISTINCT {_HOST.format("source_url")} AS h FROM articles) WHERE h IS NOT NULL)
SELECT min(url) AS url FROM (SELECT url, k FROM s UNION ALL SELECT url, k FROM d WHERE k NOT IN (SELECT k FROM s)) GROUP BY k""")
def registry_topped_up(spark, sf):
    hosts = _articles(spark, sf).select(urls.host(F.col("source_url")).alias("h")).filter("h is not null").distinct().select(F.concat(F.lit("https://"), F.col("h")).alias("url"))
    return store.registry(read_table(spark, sf, "trusted_sources"), hosts)


@query("WITH n AS (SELECT run_id, id AS article_id, 0 AS pos FROM articles WHERE run_id IS NOT NULL AND id IS NOT NULL) SELECT run_id, article_id, min(pos) AS pos FROM (SELECT run_id, article_id, pos FROM run_articles UNION ALL SELECT * FROM n) GROUP BY 1, 2")
def bridge_recorded(spark, sf):
    new = _articles(spark, sf).filter("run_id is not null and id is not null").select("run_id", F.col("id").alias("article_id"), F.lit(0).alias("pos"))
    return store.recorded(read_table(spark, sf, "run_articles"), new)


# ---- discovery

_RULES = discovery.SiteRules("info-glerbok.example", r"^/(?:a|artikel|read|topik|info|kesehatan)/.+", ("/topik/mitos",), ("ref=",))
_PATH = r"regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(rf"SELECT ordinal, coalesce({_HOST.format('source_url')} = 'info-glerbok.example' AND regexp_matches(lower({_PATH}), '^/(a|artikel|read|topik|info|kesehatan)/.+') AND NOT starts_with(lower({_PATH}), '/topik/mitos') AND NOT contains(lower(source_url), 'ref='), false) AS is_article FROM articles")
def article_addresses(spark, sf):
    return _articles(spark, sf).select("ordinal", discovery.is_article(F.col("source_url"), _RULES).alias("is_article"))


@query(r"SELECT min(first_page) AS first_page, url FROM (SELECT ordinal // 10 AS first_page, regexp_replace(source_url, '\?[^#]*', '') AS url FROM articles WHERE regexp_matches(source_url, '^https?://info-glerbok\.example/(a|artikel|read|topik|info|kesehatan)/.+') AND NOT regexp_matches(source_url, '/topik/mitos')) GROUP BY url")
def discovered_links(spark, sf):
    """Listing pages of ten addresses each, searched for the articles of one site."""
    plain = _articles(spark, sf).filter("source_url rlike '^https?://'").select((F.floor(F.col("ordinal") / 10)).alias("page"), "ordinal", F.concat(F.lit('<li><a class="x" href="'), "source_url", F.lit('">x</a></li>')).alias("li"))
    pages = plain.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "li"))), lambda x: x["li"]), "").alias("html")).withColumn("base", F.lit("https://info-glerbok.example/list"))
    rules = discovery.SiteRules(_RULES.host, _RULES.path, _RULES.refused_prefixes)
    return discovery.discovered(pages, "html", "base", "page", rules).select("url", "first_page")


@query("SELECT doc_id FROM documents WHERE contains(lower(title), 'manfaat') OR contains(lower(title), 'benefits') OR contains(lower(url), 'manfaat') OR contains(lower(url), 'benefits')")
def topic_documents(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.filter(discovery.topic_match("manfaat", F.col("title"), F.col("url")) | discovery.topic_match("Benefits", F.col("title"), F.col("url"))).select("doc_id")
