"""Greedy duplicate checks in a given order: a row is refused if it conflicts with an accepted earlier one; refused rows
block nothing. That is the lexicographically first maximal independent set of the conflict graph, found in rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapisan.config import written
from tapisan.functions import text, urls


def first_independent(rows: DataFrame, cliques: list[str], links: DataFrame | None = None, linked: str | None = None) -> DataFrame:
    """(o, accepted) of rows (o unique and ordered, the clique columns, `linked`).

    Rows that share a value of a clique column conflict, and rows whose `linked` values are the ends (t, u) of a link.
    Cliques are compared by their least accepted and least open row only, so a large one costs no pairs. A row is decided
    once all its earlier partners are; the rounds are as many as the longest chain of such dependencies.
    """
    both = None if links is None else written(links.select("t", "u").unionByName(links.select(F.col("u").alias("t"), F.col("t").alias("u"))).distinct(), "links")
    keep = ["o", *dict.fromkeys([*cliques, *([linked] if linked else [])])]
    marked = rows.select(*keep)
    for c in cliques:
        more = rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).filter("_n > 1").select(c, F.lit(True).alias(f"_{c}"))
        marked = marked.join(more, c, "left")
    if both is not None:
        marked = marked.join(both.select(F.col("t").alias(linked)).distinct().withColumn("_link", F.lit(True)), linked, "left")
    marked = written(marked, "marked")
    # rows without a partner are accepted at once and take no part in the rounds
    partner = F.coalesce(*[F.col(c) for c in marked.columns if c not in keep], F.lit(False))
    alone = marked.filter(~partner).select("o", F.lit(True).alias("accepted"))
    state = written(marked.filter(partner).select(*keep, F.lit(None).cast("boolean").alias("accepted")), "state")
    while True:
        taken, open_ = F.min(F.when(F.col("accepted"), F.col("o"))), F.min(F.when(F.col("accepted").isNull(), F.col("o")))
        now, firsts, waits = state.filter("accepted is null"), [], []
        for i, c in enumerate(cliques):
            now = now.join(state.filter(F.col(c).isNotNull()).groupBy(c).agg(taken.alias(f"a{i}"), open_.alias(f"w{i}")), c, "left")
            firsts.append(f"a{i}")
            waits.append(f"w{i}")
        if both is not None:
            by = state.filter(F.col(linked).isNotNull()).groupBy(F.col(linked).alias("u")).agg(taken.alias("x"), open_.alias("y"))
            near = both.join(by, "u").groupBy(F.col("t").alias(linked)).agg(F.min("x").alias("al"), F.min("y").alias("wl"))
            now = now.join(near, linked, "left")
            firsts.append("al")
            waits.append("wl")
        least = lambda cs: F.least(*cs) if len(cs) > 1 else F.col(cs[0])
        verdict = F.when(F.coalesce(least(firsts) < F.col("o"), F.lit(False)), False).when(F.coalesce(least(waits) >= F.col("o"), F.lit(True)), True)
        state = written(state.filter("accepted is not null").unionByName(now.select(*keep, verdict.alias("accepted"))), "state")
        if not state.filter("accepted is null").limit(1).count():
            return state.select("o", "accepted").unionByName(alone)


def sketch(t: Column, k: int) -> Column:
    """Word k of a 256-bit sketch in which every pair of neighbouring characters flips one bit, so an edit changes at most four."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(t, i, F.lit(2))), F.lit(256)))
    return F.aggregate(F.filter(pairs, lambda h: F.floor(h / 64) == k), F.lit(0).cast("bigint"), lambda x, h: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))))


#: Texts whose lengths and sketches a pass holds as arrays (172 bytes each), tasks of a pass, and bits of the sketch of runs of three.
PART, TASKS, FINE = 50_000, 48, 1024
SKETCHES = ["i", "n", "s0", "s1", "s2", "s3", "fine"]


def with_fine(titles: DataFrame) -> DataFrame:
    """titles (i, n, s0..s3, t) with `fine` for t, FINE bits of which every run of three characters flips one: an edit changes at most six."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        for b in batches:
            out = []
            for t in b.column(6).to_pylist():
                if len(place) > 500_000:
                    place.clear()
                g = [t[k : k + 3] for k in range(max(1, len(t) - 2))]
                for x in g:
                    if x not in place:
                        place[x] = xxhash.xxh3_64_intdigest(x) % FINE
                out.append(np.packbits(np.bincount([place[x] for x in g], minlength=FINE).astype(np.uint8) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(6)), pa.array(out, pa.binary())], names=SKETCHES)

    return titles.select(*SKETCHES[:6], "t").mapInArrow(run, "i bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, fine binary")


def alike(titles: DataFrame, part: pa.Table, threshold: float) -> DataFrame:
    """(i, j) of titles (SKETCHES) and those of the part behind them by (n, i) whose lengths and sketches allow the threshold."""
    n, i, *s = (part.column(c).to_numpy() for c in ("n", "i", "s0", "s1", "s2", "s3"))
    order = np.lexsort((i, n))
    n, i, s = n[order], i[order], [c.view(np.uint64)[order] for c in s]
    words = FINE // 64
    fine = np.frombuffer(b"".join(part.column("fine").to_pylist()), np.uint64).reshape(-1, words)[order]
    most = np.floor(n * (1 - threshold) + 1e-9).astype(np.int64)
    # grows with n
    least, limit, finer = n - most, np.minimum(4 * most, 256).astype(np.uint16), 6 * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, c, total = np.empty(len(n), np.uint64), np.empty(len(n), np.uint8), np.empty(len(n), np.uint16)
        for b in batches:
            ids, lengths, *own = (b.column(k).to_numpy() for k in range(6))
            mine = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(-1, words)
            own = [w.view(np.uint64) for w in own]
            lows, tops, highs = np.searchsorted(n, lengths, "left"), np.searchsorted(n, lengths, "right"), np.searchsorted(least, lengths, "right")
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, me in enumerate(ids):
                lo = lows[k] + np.searchsorted(i[lows[k] : tops[k]], me, "right")
                hi = highs[k]
                if lo >= hi:
                    continue
                m = hi - lo
                xs, cs, sums = x[:m], c[:m], total[:m]
                sums[:] = 0
                for w in range(3):
                    np.bitwise_xor(s[w][lo:hi], own[w][k], out=xs)
                    np.bitwise_count(xs, out=cs)
                    sums += cs
                at = np.flatnonzero(sums <= limit[lo:hi])
                at = at[sums[at] + np.bitwise_count(s[3][lo + at] ^ own[3][k]) <= limit[lo + at]]
                at = at[np.bitwise_count(fine[lo + at] ^ mine[k]).sum(axis=1, dtype=np.int64) <= finer[lo + at]]
                left.append(np.full(len(at), me))
                right.append(i[lo + at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["i", "j"])

    return titles.select(*SKETCHES).mapInArrow(run, "i bigint, j bigint")


def similar_titles(titles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(t, u, similarity) of distinct texts t < u with 1 - edits / longer >= threshold, none missed.

    Texts within d edits differ in length by at most d and in at most 4 d and 6 d bits of their sketches. All texts of lengths that
    allow the threshold are compared by their sketches, which go to the tasks as arrays of about PART texts; nothing but the
    pairs that pass is shuffled, with their texts. An empty text is similar to none. The price of missing none is the number
    of comparisons, which grows with the square of the texts: this is for stores of up to about a million titles.
    """
    base = titles.select("t").filter("t is not null and t != ''").distinct().repartition(TASKS, "t")
    base = base.withColumn("n", F.length("t")).withColumns({f"s{k}": sketch(F.col("t"), k) for k in range(4)})
    base = written(written(base, "texts").withColumn("i", F.monotonically_increasing_id()), "titles")
    parts = max(1, -(-base.count() // PART))
    sketches = written(with_fine(base), "sketches")
    part = lambda k: sketches.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).toArrow()
    # told out anew so that a pass has TASKS tasks however small the files are
    own = sketches.repartition(TASKS, "i")
    near = reduce(DataFrame.unionByName, [written(alike(own, part(k), threshold), "near") for k in range(parts)])
    text_of = lambda own, name: base.select(F.col("i").alias(own), F.col("t").alias(name))
    pairs = near.join(text_of("i", "x"), "i").join(text_of("j", "y"), "j").select(F.least("x", "y").alias("t"), F.greatest("x", "y").alias("u"))
    # beyond the edits that the longest text allows the distance needn't be finished
    edits = F.levenshtein("t", "u", int((base.agg(F.max("n")).first()[0] or 0) * (1 - threshold) + 1e-9))
    pairs = pairs.withColumn("e", edits).filter("e >= 0").select("t", "u", (F.lit(1.0) - F.col("e") / F.greatest(F.length("t"), F.length("u"))).alias("similarity"))
    return written(pairs.filter(F.col("similarity") >= threshold), "similar")


def store_unique(df: DataFrame, order: str, title: str, url: str) -> DataFrame:
    """df with `accepted`: rows that the store keeps. Equal addresses (without trailing slashes) and equal titles, both trimmed and in lower case, conflict; blank addresses don't, blank titles do."""
    rows = df.select(F.col(order).alias("o"), F.nullif(urls.store_key(F.coalesce(F.col(url), F.lit(""))), F.lit("")).alias("k"), F.lower(text.utrim(F.coalesce(F.col(title), F.lit("")))).alias("n"))
    return df.join(first_independent(rows, ["k", "n"]).withColumnRenamed("o", order), order)


def fuzzy_unique(df: DataFrame, order: str, title: str, url: str, threshold: float = 0.85) -> DataFrame:
    """df with `accepted` by address, normal title (two untitled rows conflict) and title similarity. A threshold outside (0, 1] is 0.85."""
    threshold = threshold if 0 < threshold <= 1 else 0.85
    rows = written(df.select(F.col(order).alias("o"), F.nullif(urls.dedup_key(F.coalesce(F.col(url), F.lit(""))), F.lit("")).alias("k"), text.normal(F.coalesce(F.col(title), F.lit(""))).alias("n")), "keys")
    links = similar_titles(rows.select(F.col("n").alias("t")), threshold)
    return df.join(first_independent(rows, ["k", "n"], links, "n").withColumnRenamed("o", order), order)


def merged(stored: DataFrame, new: DataFrame, order: str, title: str, url: str, threshold: float = 0.85) -> DataFrame:
    """New rows with `accepted`: they must pass the fuzzy check behind the stored rows that pass it, and no stored row, passing or not, may have their address or title. Stored rows stay stored."""
    cols = [order, title, url]
    tagged = stored.select(F.struct(F.lit(0).alias("s"), F.col(order).alias("i")).alias("oo"), *cols[1:]).unionByName(new.select(F.struct(F.lit(1).alias("s"), F.col(order).alias("i")).alias("oo"), *cols[1:]))
    passed = fuzzy_unique(tagged, "oo", title, url, threshold).filter("oo.s = 1 and accepted").select(F.col("oo.i").alias(order))
    url_key = lambda d: d.select(F.nullif(urls.store_key(F.coalesce(F.col(url), F.lit(""))), F.lit("")).alias("_k")).filter("_k is not null").distinct()
    title_key = lambda d: d.select(F.lower(text.utrim(F.coalesce(F.col(title), F.lit("")))).alias("_n")).distinct()
    free = new.join(passed, order, "left_semi").withColumn("_k", F.nullif(urls.store_key(F.coalesce(F.col(url), F.lit(""))), F.lit(""))).withColumn("_n", F.lower(text.utrim(F.coalesce(F.col(title), F.lit("")))))
    free = free.join(url_key(stored), "_k", "left_anti").join(title_key(stored), "_n", "left_anti").drop("_k", "_n")
    kept = store_unique(free, order, title, url).filter("accepted").select(order, F.lit(True).alias("accepted"))
    return new.join(kept, order, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def reasons(df: DataFrame, order: str, title: str, url: str) -> DataFrame:
    """(order, reason) of rows that an earlier row of the same address or normal title precedes, whatever became of it."""
    keyed = df.select(F.col(order).alias("o"), F.nullif(urls.dedup_key(F.coalesce(F.col(url), F.lit(""))), F.lit("")).alias("k"), text.normal(F.coalesce(F.col(title), F.lit(""))).alias("n"))
    first = [keyed.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("o").alias(f"first_{c}")) for c in ("k", "n")]
    both = reduce(lambda d, f: d.join(f, f.columns[0], "left"), first, keyed)
    why: Column = F.when(F.col("first_k") < F.col("o"), "url").when(F.col("first_n") < F.col("o"), "title")
    return both.select(F.col("o").alias(order), why.alias("reason")).filter("reason is not null")
