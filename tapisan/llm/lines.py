"""Lines repeated across one site's documents.

Numbers, dates and names of each line are masked, the masked words get two locality-sensitive keys (each of four minimum
hashes), and the
case-folded words with numbers and months masked, which lines of one form always share, get a third; a cluster is a bucket of
equal keys within a site. A
cluster that comes back in many of the site's documents is boilerplate. Keys are made distinct within a document before
anything is shuffled, so a bucket's number of documents is a plain count with map-side partial sums, and neither a large
site nor a hot line is gathered anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapisan.config import written
from tapisan.llm.text import SPACE, WordHashes, lines, mixed, site_col, words

#: Share of the site's documents, and number of them, from which a line is boilerplate.
SHARE, LEAST = 0.05, 8
#: Most hot keys (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Seeds of the hash functions whose minima make the locality-sensitive keys, by band.
BANDS = ((11, 12, 13, 14), (21, 22, 23, 24))
FOLDED = (31, 32, 33, 34)
DIGITS = re.compile(r"\d+")
#: Names: words that begin with a capital after a word in small letters, a number, a colon or a comma.
NAME = re.compile(r"(?<=[a-zà-öø-ÿ0-9:,] )[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+")
#: Months in the four languages; a date is masked with them.
MONTHS = re.compile(r"\b(?:jan|feb|mar|apr|may|mei|jun|jul|aug|agu|ago|sep|okt|oct|nov|des|dec|dis|ene|abr|mac|ogos|dic)[a-z]*\b")


def form(line: str) -> str:
    """The line's words joined by single spaces, runs of digits replaced by 0."""
    return DIGITS.sub("0", " ".join(words(line)))


def masked(line: str) -> list[str]:
    """The words of the form with names as n and months as d."""
    return MONTHS.sub("d", form(NAME.sub("n", line))).split()


def band_keys(hashes: WordHashes, ws: list[list[str]], seeds: tuple[int, ...], start: int) -> np.ndarray:
    """A key of the minimum hashes of each list of words; 0 of an empty list."""
    out, n = np.zeros(len(ws), np.uint64), np.array([len(w) for w in ws], np.int64)
    if n.sum():
        h = hashes([w for x in ws for w in x])
        has = np.flatnonzero(n)
        first = np.r_[0, np.cumsum(n[has])[:-1]]
        key = np.full(len(has), start, np.uint64)
        for s in seeds:
            key = mixed(key ^ np.minimum.reduceat(mixed(h ^ mixed(np.array([s], np.uint64))), first))
        out[has] = key
    return out


def document_keys(df: DataFrame, id_col: str, body: str, url: str, wordless: bool = False) -> DataFrame:
    """(id, site, f, c, m0, m1): each document of a site with the form's hash and three keys of each line; 0 where a line has no words, but c is 1 there if `wordless`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, cache = WordHashes(), {}
        for b in batches:
            split = [lines(t) for t in b["body"]]
            new = list({x for ls in split for x in ls if x not in cache})
            if len(cache) > 200_000:
                cache.clear()
                new = list({x for ls in split for x in ls})
            forms = [form(x) for x in new]
            f = np.array([xxhash.xxh3_64_intdigest(x) if x else 0 for x in forms], np.uint64)
            mw = [masked(x) for x in new]
            c = band_keys(hashes, [MONTHS.sub("d", x).split() for x in forms], FOLDED, len(BANDS) + 1)
            if wordless:
                c[f == 0] = 1
            keys = np.stack([f, c, *(band_keys(hashes, mw, seeds, k + 1) for k, seeds in enumerate(BANDS))], axis=1)
            for x, row in zip(new, keys.view(np.int64)):
                cache[x] = row
            empty = np.zeros((0, 2 + len(BANDS)), np.int64)
            table = [np.array([cache[x] for x in ls]) if ls else empty for ls in split]
            yield pd.DataFrame({"id": b["id"], "site": b["site"], "f": [t[:, 0] for t in table], "c": [t[:, 1] for t in table], "m0": [t[:, 2] for t in table], "m1": [t[:, 3] for t in table]})

    base = df.select(F.col(f"`{id_col}`").alias("id"), site_col(F.col(f"`{url}`")).alias("site"), F.col(f"`{body}`").alias("body")).filter("site is not null and body is not null")
    return base.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, site string, f array<bigint>, c array<bigint>, m0 array<bigint>, m1 array<bigint>")


def hot_clusters(docs: DataFrame, sites: DataFrame, share: float, least: int) -> DataFrame:
    """(site, key) of clusters in at least `least` documents of their site and at least that share of them."""
    own = docs.select("site", F.explode(F.array_distinct(F.concat("c", "m0", "m1"))).alias("key")).filter("key != 0")
    n = own.groupBy("site", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.join(sites, "site").filter(F.col("n") >= share * F.col("docs")).select("site", "key")


def repeated_lines(df: DataFrame, id_col: str, body: str, url: str, share: float = SHARE, least: int = LEAST, exact: bool = True, wordless: bool = False) -> DataFrame:
    """(id, line_no) of the lines to remove: those of hot clusters and, if `exact`, only those whose form is itself as frequent.

    The share is of all document rows of the site, those without lines included. Documents without a site, null texts and
    blank lines have no rows; a line repeated within a document counts once for it and is reported at each place; an empty
    table gives an empty result. Equal forms share the key of their case-folded words, so no frequent form is lost by the
    clusters. Forms are compared by 64-bit hashes; lines without words have no rows unless `wordless`, which makes them one form.
    """
    sites = df.select(site_col(F.col(f"`{url}`")).alias("site")).filter("site is not null").groupBy("site").agg(F.count("*").alias("docs"))
    docs = written(document_keys(df, id_col, body, url, wordless), "keys")
    hot = hot_clusters(docs, sites, share, least)
    # a line is of a hot cluster if one of its keys is; hot keys of a site are few: at most bands * lines per document / share
    hot = written(hot, "hot")
    by_site = hot.groupBy("site").agg(F.collect_set("key").alias("hot"))
    if hot.count() <= BROADCAST_KEYS:
        by_site = F.broadcast(by_site)
    at = F.transform(F.arrays_zip("f", "c", "m0", "m1"), lambda x: F.when((x["c"] != 0) & F.arrays_overlap(F.array(x["c"], x["m0"], x["m1"]), F.col("hot")), x["f"]))
    found = docs.join(by_site, "site").select("id", "site", F.posexplode(at).alias("pos", "form")).filter("form is not null")
    found = found.select("id", "site", (F.col("pos") + 1).cast("int").alias("line_no"), "form")
    if exact:
        found = written(found, "found")
        n = found.select("site", "form", "id").distinct().groupBy("site", "form").agg(F.count("*").alias("n")).join(sites, "site").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("docs")))
        found = found.join(n.select("site", "form"), ["site", "form"], "left_semi")
    return found.select(F.col("id").alias(id_col), "line_no")


def without_lines(df: DataFrame, id_col: str, body: str, drop: DataFrame) -> DataFrame:
    """df with `body` free of the lines of `drop` (id, line_no); blocks that become empty vanish, others keep their gaps.

    Rows without lines to drop keep their text as it is.
    """
    gone = drop.groupBy(F.col(id_col).alias("_drop_id")).agg(F.collect_set("line_no").alias("_drop"))
    joined = df.join(gone, F.col(f"`{id_col}`") == F.col("_drop_id"), "left")
    parts = F.split(F.col(f"`{body}`"), "\n")
    blank = lambda x: F.trim(x, F.lit(SPACE)) == ""
    # number the lines that are not blank, then keep blanks and lines not dropped
    state = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.struct((s["n"] + F.when(blank(x), 0).otherwise(1)).alias("n"), F.when(~blank(x) & F.array_contains("_drop", s["n"] + 1), s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept")),
    )
    text = F.trim(F.regexp_replace(F.array_join(state["kept"], "\n"), r"\n\s*\n\s*\n+", "\n\n"), F.lit("\n"))
    return joined.withColumn(body, F.when(F.col("_drop").isNull(), F.col(f"`{body}`")).otherwise(text)).drop("_drop_id", "_drop")
