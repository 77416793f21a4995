"""Duplicates of new batches against everything accepted before.

A title's bit-difference fingerprint has two parts. Word blocks: each uncommon word is a block of its own, 32 bits of its
hash, so an edit changes the block of its word and leaves the others as they are. Parity bits: every pair of neighbouring
characters flips one of 256 bits, so an edit changes at most four (three if the length changes) and titles within d edits
differ in at most 4 d. The blocks, in the order of their bits, are rotated: each is stored together with each of the ROTATIONS
that follow it, so a table key is two whole blocks. A new title looks up exact matches of its keys, then the Hamming
distance of the parity bits and at last the text itself are verified. Accepted fingerprints are appended to the tables.

Two titles that keep two blocks of few are found. Titles of fewer than SPARSE uncommon words have too few keys for that and
meet all others the exact way: for each number d of edits that a partner may allow, a title is stored under its first runs
of Q characters (rare ones first), as many as hold d + 1 that don't overlap, its pivots: d edits leave one of them whole. Titles of at
most SHORT characters are stored under what remains when up to two characters are deleted. None of their pairs is missed.

Common words and the order of runs are fitted once, on all titles, and kept with the tables.
"""

from __future__ import annotations

import itertools
import math
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapisan.config import written
from tapisan.llm.text import SPACE, words

#: Least similarity 1 - edits / length of the longer.
SIMILARITY = 0.85
#: 64-bit words of the parity bits.
WORDS = [f"f{k}" for k in range(4)]
#: Blocks that follow a block in the order of their bits and share a key with it; a title of no more blocks has all pairs.
ROTATIONS = 8
#: Share of the titles from which a word is common; fewest uncommon words of a title that needs no exact way.
COMMON, SPARSE = 0.01, 4
#: Characters of a run; longest title whose pairs within SHORT meet by deletions (its partners allow at most two edits).
Q, SHORT = 4, 19
#: Numbers of edits told apart in the tables, from that among titles no longer; beyond, that of the longest partner counts.
LEVELS = 16
#: A run's frequency is kept if it is more than one in so many of all titles' runs (the bound of their number).
MOST_RUNS = 100_000
#: Slices of the stored tables by bits of the key; a batch reads those of its own keys only.
SLICES = 256
BITS = ", ".join(f"{c} bigint" for c in WORDS)


def instant_col(text: Column) -> Column:
    """The instant in microseconds; null if blank, unreadable or before 2000. No offset means +07:00."""
    p = r"^(\d{4}-\d{2}-\d{2})(?:[T ]+(\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,6})\d*)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
    t = F.trim(text, F.lit(SPACE))
    g = lambda i: F.regexp_extract(t, p, i)
    or_ = lambda c, d: F.when(c == "", F.lit(d)).otherwise(c)
    zone = F.regexp_replace(or_(F.upper(g(5)), "+07:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    stamp = F.try_to_timestamp(F.concat(g(1), F.lit(" "), or_(g(2), "00:00"), or_(g(3), ":00"), F.lit("."), or_(g(4), "0"), zone))
    return F.when(t.rlike(p) & (stamp >= F.lit("2000-01-01T00:00:00Z").cast("timestamp")), F.unix_micros(stamp))


def address_col(url: Column) -> Column:
    """The address that must be equal; null if blank."""
    u = F.regexp_replace(F.lower(F.trim(url, F.lit(SPACE))), r"[?#].*$", "")
    u = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.\-]*://", ""), r"^(?:www|m)\.", "")
    return F.nullif(F.regexp_replace(u, r"/+$", ""), F.lit(""))


class Fit:
    """What all titles tell: common words and how often the most frequent runs occur."""

    def __init__(self, common: frozenset[str] = frozenset(), runs: dict[str, int] | None = None):
        self.common, self.runs = common, dict(runs or {})


def fit(df: DataFrame, title: str) -> Fit:
    """Fitted on all different titles, counted as words and runs; only what is frequent comes to the driver. An empty table gives an empty fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"t": [" ".join(words(x)) for x in b["title"]]})

    own = written(df.select(F.col(f"`{title}`").alias("title")).mapInPandas(run, "t string").filter("t != ''").distinct(), "titles")
    count = lambda found: own.select(F.explode(found).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    n = own.count()
    # a title has few words, so that few can be in so many titles
    common = [r[0] for r in count(F.array_distinct(F.split("t", " "))).filter(F.col("n") > max(5, COMMON * n)).collect()]
    # fewer than MOST_RUNS runs can be so frequent; the order of the others is that of their hashes
    many = own.agg(F.sum(F.greatest(F.length("t") - (Q - 1), F.lit(0)))).first()[0] or 0
    runs = F.expr(f"if(length(t) < {Q}, array(), transform(sequence(1, length(t) - {Q - 1}), i -> substring(t, i, {Q})))")
    return Fit(frozenset(common), {r[0]: r[1] for r in count(runs).filter(F.col("n") > max(1, many / MOST_RUNS)).collect()})


def deletions(t: str, most: int) -> set[str]:
    """t without any up to `most` of its characters."""
    return {"".join(c for i, c in enumerate(t) if i not in gone) for k in range(most + 1) for gone in itertools.combinations(range(len(t)), k)}


def disjoint(places: list[int]) -> list[int]:
    """As many of the places as can begin runs that don't overlap."""
    out, free = [], 0
    for at in sorted(places):
        if at >= free:
            out.append(at)
            free = at + Q
    return out


def edits(n: float) -> int:
    """Most edits of a pair whose longer title has n characters."""
    return math.floor(n * (1 - SIMILARITY) + 1e-9)


def stored_runs(n: int, order: list) -> dict[int, int]:
    """Marks of the runs to store of a title of n characters by place: bit k, stored for level k, and bit 16 + k, a pivot of it.

    Level k is of pairs with k edits more than edits(n), the last of all beyond; order[i] is the rank of the run at place i.
    """
    places = sorted(range(len(order)), key=order.__getitem__)
    marks: dict[int, int] = {}
    least, most = edits(n), math.floor(n / SIMILARITY * (1 - SIMILARITY) + 1e-9)
    low = 0
    for k in range(min(LEVELS, most - least + 1)):
        pivots = (least + k if k < LEVELS - 1 else most) + 1
        low, high = max(low, pivots), len(places)
        while low < high:
            mid = (low + high) // 2
            if len(disjoint(places[:mid])) >= pivots:
                high = mid
            else:
                low = mid + 1
        end = low
        while end < len(places) and order[places[end]] == order[places[end - 1]]:  # all places of the last run
            end += 1
        for at in places[:end]:
            marks[at] = marks.get(at, 0) | 1 << k
        for at in disjoint(places[:end])[:pivots]:
            marks[at] |= 1 << 16 + k
    return marks


def block_keys(blocks: list[int]) -> list[int]:
    """A 64-bit key of each two blocks at most ROTATIONS apart in their order."""
    x = sorted(blocks)
    return [xxhash.xxh3_64_intdigest(f"{p} {q}") for i, p in enumerate(x) for q in x[i + 1 : i + 1 + ROTATIONS]]


def fingerprints(df: DataFrame, id_col: str, title: str, url: str, at: str, fitted: Fit) -> DataFrame:
    """(id, at, addr, t, f0..f3, keys, sparse): instant, address, normal title (null without words), parity bits, table keys, too few blocks."""
    common = fitted.common

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits: dict[str, int] = {}
        for b in batches:
            norm, fps, keys, sparse = [], np.zeros((len(b), len(WORDS)), np.int64), [], []
            for i, title_ in enumerate(b["title"]):
                ws = words(title_)
                t = " ".join(ws)
                norm.append(t or None)
                if t:
                    if len(bits) > 500_000:
                        bits.clear()
                    g = [t[k : k + 2] for k in range(max(1, len(t) - 1))]
                    for x in g:
                        if x not in bits:
                            bits[x] = xxhash.xxh3_64_intdigest(x) & 255
                    fps[i] = np.packbits(np.bincount(list(map(bits.__getitem__, g)), minlength=256).astype(np.uint8) & 1).view(np.int64)
                blocks = {xxhash.xxh32_intdigest(w) for w in ws if w not in common}
                keys.append(np.array(block_keys(list(blocks)), np.uint64).view(np.int64))
                sparse.append(bool(t) and len(blocks) < SPARSE)
            yield pd.DataFrame({"id": b["id"], "at": b["at"], "addr": b["addr"], "t": norm, **{c: fps[:, k] for k, c in enumerate(WORDS)}, "keys": keys, "sparse": sparse})

    base = df.select(F.col(f"`{id_col}`").alias("id"), instant_col(F.col(f"`{at}`")).alias("at"), address_col(F.col(f"`{url}`")).alias("addr"), F.col(f"`{title}`").alias("title"))
    return base.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, at bigint, addr string, t string, {BITS}, keys array<bigint>, sparse boolean")


def with_runs(titles: DataFrame, fitted: Fit) -> DataFrame:
    """(h, n, f0..f3, key, at) of titles (t, f0..f3): each stored run's key and its place and marks (place * 2**32 + marks)."""
    counts = fitted.runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, ats = [], []
            for t in b["t"]:
                own, places = [], []
                if len(t) <= SHORT:
                    own = [xxhash.xxh3_64_intdigest(f"-{x}") for x in deletions(t, int(min(SHORT, len(t) / SIMILARITY) * (1 - SIMILARITY) + 1e-9))]
                    places = [2**32 - 1] * len(own)
                if len(t) > SHORT * SIMILARITY:
                    g = [t[k : k + Q] for k in range(len(t) - Q + 1)]
                    hs = [xxhash.xxh3_64_intdigest(x) for x in g]
                    stored = stored_runs(len(t), [(counts.get(x, 0), h) for x, h in zip(g, hs)])
                    own += [hs[at] for at in stored]
                    places += [(at << 32) + marks for at, marks in stored.items()]
                keys.append(np.array(own, np.uint64).view(np.int64))
                ats.append(np.array(places, np.int64))
            yield b.drop(columns="t").assign(keys=keys, ats=ats)

    own = titles.select("t", F.xxhash64("t").alias("h"), F.length("t").alias("n"), *WORDS)
    return own.mapInPandas(run, f"h bigint, n int, {BITS}, keys array<bigint>, ats array<bigint>").select("h", "n", *WORDS, F.explode(F.arrays_zip("keys", "ats")).alias("z")).select("h", "n", *WORDS, F.col("z.keys").alias("key"), F.col("z.ats").alias("at"))


def alike() -> tuple[Column, Column]:
    """Of two sides p and s of (h, n, f0..f3): most edits, and whether lengths and parity bits allow them."""
    most = F.expr(f"cast(floor(greatest(p.n, s.n) * {1 - SIMILARITY!r} + 1e-9) as int)")
    bits = " + ".join(f"bit_count(p.{c} ^ s.{c})" for c in WORDS)
    return most, (F.col("p.h") != F.col("s.h")) & (F.expr("abs(p.n - s.n)") <= most) & (F.expr(bits) <= 4 * most - F.expr("abs(p.n - s.n)"))


def by_blocks(x: DataFrame, y: DataFrame) -> DataFrame:
    """(h, g) of titles of x and of y (t, f0..f3, keys) that share a key and pass the Hamming check, the lesser first."""
    side = lambda d: d.select(F.xxhash64("t").alias("h"), F.length("t").alias("n"), *WORDS, F.explode("keys").alias("key"))
    met = side(x).alias("p").join(side(y).alias("s"), "key").filter(alike()[1])
    return met.select(F.least("p.h", "s.h").alias("h"), F.greatest("p.h", "s.h").alias("g"))


def by_runs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(h, g) as by_blocks, the exact way, of titles of x and of y in the form of with_runs: a pivot of one is stored of the other."""
    most, close = alike()
    fewest = lambda p: F.expr(f"cast(floor({p}.n * {1 - SIMILARITY!r} + 1e-9) as int)")
    level = lambda p: F.least(most - fewest(p), F.lit(LEVELS - 1))
    bit = lambda p, first: F.call_function("shiftright", F.col(f"{p}.at"), level(p) + first).bitwiseAND(F.lit(1)) == 1
    moved = F.abs(F.shiftright("p.at", 32) - F.shiftright("s.at", 32)) <= most
    pivots = lambda d: d.filter(F.col("at").bitwiseAND(F.lit(2**32 - 1)) >= 2**16)
    met = lambda a, b: pivots(a).alias("p").join(b.alias("s"), "key").filter(close & moved & bit("p", 16) & bit("s", 0)).select(F.least("p.h", "s.h").alias("h"), F.greatest("p.h", "s.h").alias("g"))
    return met(x, y).unionByName(met(y, x))


def matching(x: DataFrame, y: DataFrame, fitted: Fit) -> DataFrame:
    """(t of x, u of y) of different titles of at least SIMILARITY; x, y: (t, f0..f3, keys, sparse). If x is y each pair comes once."""
    found = by_blocks(x, y)
    few = [d.filter("sparse") for d in (x, y)]
    sizes = sorted({r[0] for d in few for r in d.select(F.length("t")).distinct().collect()})
    if sizes:
        # only titles whose length a sparse one allows take part
        least, most = min(sizes) * SIMILARITY - 1, max(sizes) / SIMILARITY + 1
        a, b = (written(with_runs(d.filter(F.length("t").between(least, most)), fitted), "runs") for d in (x, y))
        of = lambda d, keys: d.join(keys.select(F.xxhash64("t").alias("h")), "h", "left_semi")
        found = found.unionByName(by_runs(of(a, few[0]), b)).unionByName(by_runs(a, of(b, few[1])))
    text = lambda d, h, t: d.select(F.xxhash64("t").alias(h), F.col("t").alias(t)).distinct()
    pairs = written(found.distinct(), "pairs")
    joined = pairs.join(text(x, "h", "t"), "h").join(text(y, "g", "u"), "g")
    if x is not y:
        joined = joined.unionByName(pairs.join(text(x, "g", "t"), "g").join(text(y, "h", "u"), "h"), allowMissingColumns=True)
    # written first, else the optimiser computes the distances of the text check before pairs are made distinct
    return verified(written(joined.select("t", "u").distinct(), "near"))


def verified(near: DataFrame) -> DataFrame:
    """The pairs (t, u) of at least SIMILARITY."""
    # beyond the edits that the longest title allows the distance needn't be finished
    longest = near.agg(F.max(F.greatest(F.length("t"), F.length("u")))).first()[0] or 0
    sure = near.withColumn("_e", F.levenshtein("t", "u", edits(longest))).filter("_e >= 0")
    return sure.filter(F.lit(1.0) - F.col("_e") / F.greatest(F.length("t"), F.length("u")) >= SIMILARITY).select("t", "u")


def resolve(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, accepted) of rows (id, at, addr, t): in the order of (at nulls first, id) a row is accepted unless it matches an
    accepted earlier one by addr, t or a link (t, u; either way) of titles.

    This is the lexicographically first maximal independent set. Each round decides every row whose earlier partners are
    decided; rows with one address or title are compared by the group's minimum only, so large groups cost no pairs.
    """
    at = F.struct(F.coalesce("at", F.lit(-(2**62))).alias("at"), F.col("id"))
    both = written(links.select("t", "u").unionByName(links.select(F.col("u").alias("t"), F.col("t").alias("u"))).distinct(), "links")
    state = written(rows.select("id", at.alias("o"), "addr", "t", F.lit(None).cast("boolean").alias("accepted")), "state")
    while True:
        # least order of an accepted and of an undecided row
        a, u = F.min(F.when(F.col("accepted"), F.col("o"))), F.min(F.when(F.col("accepted").isNull(), F.col("o")))
        by_addr = state.filter("addr is not null").groupBy("addr").agg(a.alias("aa"), u.alias("ua")).filter("aa is not null or ua is not null")
        by_t = state.filter("t is not null").groupBy("t").agg(a.alias("at"), u.alias("ut"))
        by_link = both.join(by_t.withColumnRenamed("t", "u"), "u").groupBy("t").agg(F.min("at").alias("al"), F.min("ut").alias("ul"))
        open_ = state.filter("accepted is null").join(by_addr, "addr", "left").join(by_t, "t", "left").join(by_link, "t", "left")
        taken = F.least("aa", "at", "al") < F.col("o")
        free = F.coalesce(F.least("ua", "ut", "ul") >= F.col("o"), F.lit(True))
        decided = open_.select("id", "o", "addr", "t", F.when(F.coalesce(taken, F.lit(False)), False).when(free, True).alias("accepted"))
        state = written(state.filter("accepted is not null").unionByName(decided), "state")
        if not state.filter("accepted is null").limit(1).count():
            return state.select("id", "accepted")


def replay(df: DataFrame, id_col: str, title: str, url: str, at: str) -> DataFrame:
    """(id, at, accepted) of every row, as if each UTC day had been checked as a batch against all accepted before.

    Null titles, blank titles and blank addresses match nothing; rows without a readable time come first, by id; an empty
    table gives an empty result. All table keys meet once, in one shuffle of keys.
    """
    fitted = fit(df, title)
    rows = written(fingerprints(df, id_col, title, url, at, fitted), "fingerprints")
    titles = rows.filter("t is not null").groupBy("t").agg(*[F.first(c).alias(c) for c in (*WORDS, "keys", "sparse")])
    links = written(matching(titles, titles, fitted), "links")
    # rows without any partner are accepted at once
    n = F.count("*").alias("n")
    addr = rows.filter("addr is not null").groupBy("addr").agg(n).filter("n > 1").select("addr", F.lit(1).alias("by_addr"))
    t = rows.filter("t is not null").groupBy("t").agg(n).filter("n > 1").select("t").unionByName(links.select("t")).unionByName(links.select(F.col("u").alias("t"))).distinct().withColumn("by_t", F.lit(1))
    marked = written(rows.select("id", "at", "addr", "t").join(addr, "addr", "left").join(t, "t", "left"), "marked")
    some = resolve(marked.filter("by_addr is not null or by_t is not null"), links)
    alone = marked.filter("by_addr is null and by_t is null").select("id", F.lit(True).alias("accepted"))
    return marked.select("id", "at").join(some.unionByName(alone), "id").select(F.col("id").alias(id_col), "at", "accepted")


class History:
    """The tables of accepted rows in a folder that all executors reach; `add` checks a batch and appends what it accepts.

    A batch is one folder, written once and again if the batch is retried; its own folder is left out when it is checked,
    so a retried batch changes nothing. The tables are cut in slices by their key, and a batch reads the slices of its own
    keys only: addresses, whole titles, two blocks, and runs where a title is sparse.
    """

    def __init__(self, spark: SparkSession, folder: str, fitted: Fit | None = None, slices: int = SLICES):
        self.spark, self.folder, self.fitted, self.slices = spark, folder, fitted or Fit(), slices

    def stored(self, batch_id: str) -> DataFrame | None:
        """All slices of the other batches; None before the first."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [x.getPath().getParent() for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(p, "batch=*/_SUCCESS")) or []]
        paths = [str(x) for x in done if x.getName() != f"batch={batch_id}"]
        return self.spark.read.option("basePath", self.folder).schema(f"key bigint, kind string, h bigint, n int, at bigint, addr string, t string, {BITS}, sparse boolean, batch string, slice int").parquet(*paths) if paths else None

    def entries(self, rows: DataFrame) -> DataFrame:
        """The table rows of rows (addr, t, f0..f3, keys, sparse), whose texts stand in those of kind addr and title only."""
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
        own = rows.filter("t is not null").dropDuplicates(["t"]).withColumns({"h": F.xxhash64("t"), "n": F.length("t")})
        row = lambda d, key, kind, at=zero, addr=none, t=none: d.select(key.alias("key"), F.lit(kind).alias("kind"), "h", "n", at.alias("at"), addr.alias("addr"), t.alias("t"), *WORDS, "sparse")
        addr = rows.filter("addr is not null").withColumns({"h": F.xxhash64("addr"), "n": F.lit(0)})
        # the order of runs is fixed by the fit, so they can be stored for all titles and looked up by sparse ones
        runs = with_runs(own, self.fitted).join(own.select("h", "sparse"), "h")
        parts = [row(addr, F.col("h"), "addr", addr=F.col("addr")), row(own, F.col("h"), "title", t=F.col("t")), row(own, F.explode("keys"), "block"), row(runs, F.col("key"), "run", F.col("at"))]
        return reduce(DataFrame.unionByName, parts).withColumn("slice", F.pmod("key", F.lit(self.slices)).cast("int"))

    def looked_up(self, old: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        """Rows of the other batches with the keys (key, kind); only their slices are read. At most `slices` numbers come to the driver."""
        slices = [r[0] for r in keys.select(F.pmod("key", F.lit(self.slices)).cast("int")).distinct().collect()]
        return written(old.filter(F.col("slice").isin(slices)).join(keys.select("key", "kind").distinct(), ["key", "kind"], "left_semi"), name)

    def add(self, batch: DataFrame, batch_id: str, id_col: str, title: str, url: str, at: str) -> DataFrame:
        """(id, accepted) of the batch's rows, written before it returns."""
        rows = written(fingerprints(batch, id_col, title, url, at, self.fitted), "batch")
        mine = written(self.entries(rows), "entries")
        old = self.stored(batch_id)
        refused = rows.filter("false").select("id")
        if old is not None:
            met = self.looked_up(old, mine, "met")
            same = lambda kind, c: rows.join(met.filter(F.col("kind") == kind).select(c).distinct(), c, "left_semi").select("id")
            most, close = alike()
            moved = F.abs(F.shiftright("p.at", 32) - F.shiftright("s.at", 32)) <= most
            exact = (F.col("p.kind") == "block") | (moved & (F.col("p.sparse") | F.col("s.sparse")))
            both = mine.filter("kind in ('block', 'run')").alias("p").join(met.alias("s"), (F.col("p.key") == F.col("s.key")) & (F.col("p.kind") == F.col("s.kind")))
            near = written(both.filter(close & exact).select("p.h", F.col("s.h").alias("g")).distinct(), "near")
            texts = self.looked_up(old, near.select(F.col("g").alias("key"), F.lit("title").alias("kind")), "texts")
            pairs = near.join(rows.select(F.xxhash64("t").alias("h"), "t").distinct(), "h").join(texts.select(F.col("h").alias("g"), F.col("t").alias("u")).distinct(), "g").select("t", "u")
            by_link = rows.join(verified(written(pairs, "pairs")).select("t").distinct(), "t", "left_semi").select("id")
            refused = same("addr", "addr").unionByName(same("title", "t")).unionByName(by_link).distinct()
        refused = written(refused, "refused")
        rest = written(rows.join(refused, "id", "left_anti"), "rest")
        own = rest.filter("t is not null").dropDuplicates(["t"])
        verdict = written(resolve(rest, matching(own, own, self.fitted)).unionByName(refused.withColumn("accepted", F.lit(False))), "verdict")
        new = self.entries(rest.join(verdict.filter("accepted"), "id", "left_semi"))
        new.repartition("slice").sortWithinPartitions("slice", "key").write.mode("overwrite").option("compression", "zstd").partitionBy("slice").parquet(os.path.join(self.folder, f"batch={batch_id}"))
        return verdict.select(F.col("id").alias(id_col), "accepted")
