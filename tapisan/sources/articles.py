"""Scans of the files that the article store is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapisan.functions.text import decode_paragraphs, utrim
from tapisan.operators.store import DEFAULT_RUN, DEFAULT_SESSION, STORED, given

ARTICLE = T.StructType([T.StructField(c, T.StringType() if c != "description" else T.VariantType()) for c in (*STORED, "crawl_session", "run_id")])


def paragraphs(description: Column) -> Column:
    """A description that is text or a list of texts, as array<string>; null stays null."""
    listed = F.filter(F.transform(F.try_variant_get(description, "$", "array<string>"), utrim), lambda x: x != "")
    return F.coalesce(listed, decode_paragraphs(F.try_variant_get(description, "$", "string")))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of articles; missing lineage gets the defaults."""
    raw = spark.read.schema(ARTICLE).option("multiLine", True).json(path)
    return raw.withColumns({"description": paragraphs(F.col("description")), "crawl_session": F.coalesce(given(F.col("crawl_session")), F.lit(DEFAULT_SESSION)), "run_id": F.coalesce(given(F.col("run_id")), F.lit(DEFAULT_RUN))})


def read_bridge(spark: SparkSession, path: str) -> DataFrame:
    """{run: [ids]} as (run_id, article_id, pos)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return text.select(F.explode("m").alias("run_id", "ids")).select("run_id", F.posexplode("ids").alias("pos", "article_id")).select("run_id", "article_id", "pos")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of addresses, trimmed, blank and unusable ones left out."""
    from tapisan.functions.urls import source_error

    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("url"))
    return text.select(utrim(F.col("url")).alias("url")).filter(source_error(F.col("url")).isNull())


KEYS = set(STORED)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(n, error): number of articles, and what is wrong with the first bad one, if any."""
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item"))
    v = items.withColumn("v", F.try_parse_json("item")).withColumn("keys", F.json_object_keys("item"))
    value = lambda k: F.try_variant_get(F.col("v"), f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{k}", "variant"))
    many = F.try_variant_get(F.col("v"), "$.description", "array<string>")
    error = F.when(~F.size("keys").between(4, 7), "number of keys").when(F.exists("keys", lambda k: ~k.isin(*KEYS)), "unknown key")
    for k in ("title", "image", "category"):
        error = error.when(~F.array_contains("keys", k), f"no {k}").when(kind(k) != "STRING", f"{k} is no text").when(value(k) == "", f"{k} is empty")
    error = error.when(~F.array_contains("keys", "description"), "no description").when((kind("description") == "STRING") & (utrim(value("description")) == ""), "description is empty")
    error = error.when(kind("description").startswith("ARRAY") & ((F.size(many) < 1) | F.exists(many, lambda p: F.coalesce(utrim(p), F.lit("")) == "")), "paragraph is empty").when(~(kind("description").startswith("ARRAY") | (kind("description") == "STRING")), "description is no text")
    return v.withColumn("error", error).agg(F.count("*").alias("n"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"))


DOCUMENT = "list struct<document: array<struct<_url: string, content: array<struct<_name: string, _VALUE: string>>>>>"


def search_results(df: DataFrame, xml: str) -> DataFrame:
    """(url, title, summary, groups) of the documents of a search answer in XML; documents without a title are left out.

    Malformed answers are an error, as FAILFAST says.
    """
    parsed = df.select(F.from_xml(F.col(xml), DOCUMENT, {"mode": "FAILFAST"}).alias("x")).select(F.explode("x.list.document").alias("d"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    of = lambda n: clean(F.try_element_at(F.transform(F.filter("d.content", lambda c: F.lower(c["_name"]) == n), lambda c: c["_VALUE"]), F.lit(-1)))
    groups = F.array_distinct(F.transform(F.filter("d.content", lambda c: F.lower(c["_name"]).isin("groupname", "mesh")), lambda c: clean(c["_VALUE"])))
    return parsed.select(F.col("d._url").alias("url"), of("title").alias("title"), F.coalesce(of("fullsummary"), of("snippet")).alias("summary"), groups.alias("groups")).filter("title is not null and title != ''")
