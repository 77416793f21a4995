"""Where results go: the canonical store is Parquet, exports are JSON. Every sink that replaces something swaps it in whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapisan.operators.store import exported


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replaced(df: DataFrame, path: str, write) -> None:
    """Writes a new directory with write(writer, directory) beside `path` and swaps it in; a write that fails leaves the old one.

    The new version may be computed from the old one, which stays readable until the swap; it goes at last.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    p, fs = _fs(spark, path)
    try:
        write(df.write.mode("errorifexists").option("compression", "zstd"), fresh)
    except Exception:
        fs.delete(_fs(spark, fresh)[0], True)
        raise
    if fs.exists(p) and not fs.rename(p, _fs(spark, old)[0]):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(_fs(spark, fresh)[0], p):
        fs.rename(_fs(spark, old)[0], p)
        raise OSError(f"{fresh} can't be moved to {path}")
    fs.delete(_fs(spark, old)[0], True)


def write_store(articles: DataFrame, path: str) -> None:
    """The store as Parquet by session, for pruning; a session's rows are brought together first, split by AQE where they are many."""
    replaced(articles.hint("rebalance", "crawl_session"), path, lambda w, d: w.partitionBy("crawl_session").parquet(d))


def write_export(articles: DataFrame, path: str) -> None:
    """Seven fields, sorted by title, as JSON lines; sorted by range, in as many files as it takes."""
    replaced(exported(articles).orderBy(F.col("title"), F.col("id")), path, lambda w, d: w.option("compression", "none").option("ignoreNullFields", "false").json(d))


def export_name(kind: str, key: str = "") -> str:
    safe = "".join(c if c.isalnum() else "_" for c in key.strip().lower()).strip("_")
    return "articles.json" if kind == "all" else f"articles_{kind}_{safe}.json"


def write_table(df: DataFrame, path: str) -> None:
    """The run log, the bridge, the registry or the checkpoint, whole."""
    replaced(df, path, lambda w, d: w.parquet(d))


def append_bridge(new: DataFrame, path: str, batch: str) -> None:
    """Bridge rows of a batch in a folder of its own, so a batch that is written again replaces its own rows."""
    new.select("run_id", "article_id", "pos").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """A small file of settings, such as the schedule's, swapped in whole."""
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    p, fs = _fs(spark, path)
    out = fs.create(_fs(spark, fresh)[0], True)
    try:
        out.write(bytearray(json.dumps(settings, indent=2, sort_keys=True).encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(_fs(spark, fresh)[0], p):
        raise OSError(f"{fresh} can't be moved to {path}")


def read_settings(spark: SparkSession, path: str) -> dict:
    """What write_settings wrote; {} where there is no file, an error where it can't be read as an object."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return {}
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no object")
    return value
