"""The pN_ queries of problems on texts, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapisan.config import read_table, small_rows, written
from tapisan.llm import history, langid, mainbody, mixing, neardup, packing, residue, tokens
from tapisan.llm import lines as repeated

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _article_links(spark: SparkSession, sf: str) -> neardup.Links:
    return neardup.near_duplicates(read_table(spark, sf, "articles"), "ordinal", ["title", "description"], size=3, threshold=0.5, bands=96, rows=4)


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _article_links(spark, sf).all_pairs().select(F.col("a").alias("ordinal_a"), F.col("b").alias("ordinal_b"))


SQL["p2_found"] = r"""
WITH w AS (SELECT ordinal, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[\p{L}\p{Nd}]+') AS w FROM articles),
s AS (SELECT DISTINCT ordinal, hash(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT ordinal, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
n AS (SELECT ordinal, count(*) AS n FROM s GROUP BY ordinal),
m AS (SELECT a.ordinal AS x, b.ordinal AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.ordinal < b.ordinal GROUP BY 1, 2)
SELECT x AS ordinal_a, y AS ordinal_b FROM m JOIN n p ON p.ordinal = x JOIN n q ON q.ordinal = y WHERE 2 * shared >= p.n + q.n - shared
"""


@query
def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(_article_links(spark, sf)).withColumnRenamed("id", "ordinal")


def _label_map(spark: SparkSession, sf: str) -> dict[str, str | None]:
    return {r[0]: r[1] for r in small_rows(read_table(spark, sf, "lang_labels").select("label", "lang"), 10_000, "lang_labels")}


def _segments(spark: SparkSession, sf: str):
    articles, known = read_table(spark, sf, "articles"), _label_map(spark, sf)
    model = langid.fit_on(articles, "ordinal", ["title", "description"], "lang", known)
    return known, langid.identify(articles, "ordinal", model, "title", "description", "lang")


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    known, segments = _segments(spark, sf)
    return langid.contradictions(segments, "ordinal", known)


@query
def p1_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every article and of every title and line that switches."""
    _, segments = _segments(spark, sf)
    return segments.filter("seg_kind = 'record' or lang != main_lang").select("ordinal", "seg_kind", "line_no", "lang", "confidence")


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated.repeated_lines(read_table(spark, sf, "articles"), "ordinal", "description", "source_url", wordless=True)


SQL["p4_found"] = r"""
WITH a AS (
  SELECT ordinal, description,
         nullif(regexp_replace(lower(regexp_extract(trim(source_url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^(www|m)\.', ''), '') AS site
  FROM articles),
sites AS (SELECT site, count(*) AS docs FROM a WHERE site IS NOT NULL GROUP BY site),
pieces AS (SELECT ordinal, site, unnest(string_split(description, chr(10))) AS piece, generate_subscripts(string_split(description, chr(10)), 1) AS pos FROM a WHERE site IS NOT NULL AND description IS NOT NULL),
l AS (SELECT *, regexp_replace(piece, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM pieces),
numbered AS (SELECT ordinal, site, line, row_number() OVER (PARTITION BY ordinal ORDER BY pos) AS line_no FROM l WHERE line <> ''),
formed AS (SELECT ordinal, site, line_no, trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{Nd}]+', ' ', 'g'), '\p{Nd}+', '0', 'g')) AS form FROM numbered),
n AS (SELECT site, form, count(DISTINCT ordinal) AS n FROM formed GROUP BY site, form)
SELECT f.ordinal, CAST(f.line_no AS INTEGER) AS line_no
FROM formed f JOIN n USING (site, form) JOIN sites USING (site)
WHERE n.n >= 8 AND n.n >= 0.05 * docs
"""


@query
def p4_clean_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Every article's description without the lines of its site's frequent clusters."""
    articles = read_table(spark, sf, "articles").select("ordinal", "description", "source_url")
    drop = repeated.repeated_lines(articles, "ordinal", "description", "source_url", exact=False)
    return repeated.without_lines(articles, "ordinal", "description", drop).select("ordinal", F.md5("description").alias("description_md5"), F.length("description").alias("n_chars"))


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    return history.replay(read_table(spark, sf, "articles"), "ordinal", "title", "source_url", "scraped_at")


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf).filter("not accepted").select("ordinal")


@query
def p5_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows accepted and refused in each day's batch; rows without a time are the batch without a day."""
    day = F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd")
    return _replayed(spark, sf).groupBy(day.alias("batch_day")).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("duplicates"))


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    articles = read_table(spark, sf, "articles")
    return mainbody.own_surrounding_lines(articles, "ordinal", "description", "source_url")


@query
def p6_main_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Every article's description with its own body only."""
    articles = read_table(spark, sf, "articles").select("ordinal", "description", "source_url")
    drop = mainbody.own_surrounding_lines(articles, "ordinal", "description", "source_url")
    return repeated.without_lines(articles, "ordinal", "description", drop).select("ordinal", F.md5("description").alias("description_md5"), F.length("description").alias("n_chars"))


def _residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(read_table(spark, sf, "documents"), "doc_id", "text")


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _residue(spark, sf).select("doc_id")


@query
def p9_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Residue of each source by kind, and how much of it was labelled by propagation."""
    kinds = _residue(spark, sf).join(read_table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return kinds.groupBy("source", "kind").agg(F.count("*").alias("n_docs"), F.count_if(~F.col("trusted")).alias("n_propagated"))


@query
def p9_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return residue.without_residue(documents, "doc_id", _residue(spark, sf))


def _packed(spark: SparkSession, sf: str) -> list[tuple[int, int, DataFrame, dict]]:
    counts = written(tokens.token_counts(read_table(spark, sf, "documents"), "doc_id", "text"), "counts")
    sizes = small_rows(read_table(spark, sf, "pack_sizes").select("pack_id", "capacity_tokens").orderBy("pack_id"), 100, "pack_sizes")
    return [(p, c, *packing.pack(counts, "doc_id", "tokens", c)) for p, c in sizes]


@query
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Each text, or piece of a text longer than the capacity, with its container, for every capacity."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(p).alias("pack_id"), "container_id", "doc_id", "piece_no", "start_token", "tokens") for p, _, d, _ in _packed(spark, sf)])


@query
def p7_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, fill and waste of every capacity, with the least number of containers that any packing needs."""
    out = []
    for p, c, d, _ in _packed(spark, sf):
        per = d.groupBy("container_id").agg(F.sum("tokens").alias("t"))
        out.append(per.agg(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity_tokens"), F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.ceil(F.sum("t") / c).alias("least_containers"), (1 - F.sum("t") / (F.count("*") * c)).alias("waste")))
    return reduce(DataFrame.unionByName, out)


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents, targets = read_table(spark, sf, "documents"), read_table(spark, sf, "source_targets")
    counts = tokens.token_counts(documents, "doc_id", "text", ["source", "title", "url", "fetched_at"])
    # complete records are up to twice as likely as those without title, address and time
    known = sum((F.col(c).isNotNull().cast("int") for c in ("title", "url")), F.col("fetched_at").isNotNull().cast("int"))
    return mixing.mix(counts, "doc_id", targets, 1 + known / 3), targets


@query
def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents used, with their copies."""
    return _mixed(spark, sf)[0]


@query
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of all tokens that each listed source has and should have."""
    return mixing.shares(*_mixed(spark, sf))
