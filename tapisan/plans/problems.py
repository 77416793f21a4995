"""The pN_ queries of general problems; those tagged llm are in the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapisan.config import read_table, small_rows
from tapisan.operators.multivalue import split_packed

#: Most known names that may be shipped with the grammar.
MOST_NAMES = 20_000


def _values(spark: SparkSession, sf: str) -> DataFrame:
    names = [r[0] for r in small_rows(read_table(spark, sf, "categories").select("cat_name"), MOST_NAMES, "categories")]
    return split_packed(read_table(spark, sf, "articles"), "category", ["ordinal"], names, value="cat_value")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf).filter("n_values >= 2").select("ordinal", "pos", "cat_value")


def p3_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Articles and mentions of each value, folded, over packed and single fields."""
    return _values(spark, sf).groupBy(F.lower("cat_value").alias("cat_value")).agg(F.count("*").alias("mentions"), F.sum(F.when(F.col("n_values") > 1, 1).otherwise(0)).alias("packed_mentions"), F.sum(F.when(F.col("flag").isNotNull(), 1).otherwise(0)).alias("flagged"))


QUERIES = {"p3_found": p3_found, "p3_value_counts": p3_value_counts}
