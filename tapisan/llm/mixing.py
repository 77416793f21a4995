"""Sources mixed to target shares of all tokens, by Pareto order sampling.

Each source gets a budget of tokens in proportion to its target; the whole is as large as the scarcest source allows at its
most repeats. A document is expected to be used as often as its budget and weight say: the whole part of that are certain
copies, the rest is its chance of one more. Documents are ranked by random odds over the odds of that chance, and the
lowest are taken until the budget is filled. Budgets are cut in a histogram of the ranks, so no source is gathered in one
task, however large; the last few tokens are filled with single documents that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapisan.config import small_rows, written

#: Cells of the histogram of ranks; levels a weight may have; listed sources; rounds that fill what is left of budgets.
CELLS, MOST_LEVELS, MOST_SOURCES, FILL_ROUNDS = 4096, 1000, 10_000, 6


def budgets(have: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """Tokens of each source: shares of those that have tokens, as many as the scarcest allows. Absent sources get none."""
    live = [(s, w, r) for s, w, r in targets if have.get(s) and w and w > 0 and r and r > 0]
    shares = sum(w for _, w, _ in live)
    total = min((have[s] * r / (w / shares) for s, w, r in live), default=0.0)
    return {s: total * w / shares for s, w, _ in live}


def expected_scale(levels: list[tuple[float, int]], budget: float, most: int) -> float:
    """The factor of weights at which min(most, factor * weight) copies of all documents make the budget. levels: (weight, tokens)."""
    low, high = 0.0, 1.0
    make = lambda f: sum(min(most, f * w) * t for w, t in levels)
    while make(high) < budget * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if make(mid) < budget else (low, mid)
    return high


def mix(counts: DataFrame, id_col: str, targets: DataFrame, weight: Column | None = None, seed: int = 1) -> DataFrame:
    """(id, source, tokens, copies) of the documents used, copies of 1 to the source's max_repeats.

    counts: (id, source, tokens) and what `weight` needs; targets: (source, target_share, max_repeats). Sources that aren't
    listed, null sources and documents without tokens are never used; a listed source without documents is left out and its
    share goes to the others; equal ids are told apart only by their rows. Weights must be positive and take few values
    (at most MOST_LEVELS in all sources). Empty tables give an empty result.
    """
    listed = [(r[0], r[1], r[2]) for r in small_rows(targets.filter("source is not null").select("source", "target_share", "max_repeats"), MOST_SOURCES, "targets")]
    base = counts.filter("tokens > 0").filter(F.col("source").isin([s for s, _, _ in listed]) if listed else F.lit(False))
    base = written(base.select(F.col(id_col).alias("id"), "source", "tokens", (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")), "mixable")
    levels: dict[str, list[tuple[float, int]]] = {}
    for r in small_rows(base.groupBy("source", "w").agg(F.sum("tokens").alias("t")), MOST_LEVELS * max(1, len(listed)), "weights"):
        levels.setdefault(r[0], []).append((r[1], r[2]))
    want = budgets({s: sum(t for _, t in ls) for s, ls in levels.items()}, listed)
    plan = [(s, want[s], int(r), expected_scale(levels[s], want[s], int(r))) for s, _, r in listed if s in want]
    plan_df = F.broadcast(counts.sparkSession.createDataFrame(plan, "source string, budget double, most int, factor double"))
    e = F.least(F.col("most").cast("double"), F.col("factor") * F.col("w"))
    near = F.round("e")
    certain = F.when(F.abs(F.col("e") - near) < 1e-9, near).otherwise(F.floor("e")).cast("int")
    docs = base.join(plan_df, "source").withColumn("e", e).withColumn("certain", certain).withColumn("p", F.greatest(F.lit(0.0), F.col("e") - F.col("certain")))
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # ranks as odds / (1 + odds), so that their histogram has even cells
    docs = docs.withColumn("rank", F.when(F.col("p") > 1e-12, q / (1 + q))).withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(F.col("rank") * CELLS)).cast("int"))
    docs = written(docs.select("id", "source", "tokens", "most", "budget", "certain", "rank", "cell"), "ranked")
    left = docs.groupBy("source").agg((F.first("budget") - F.sum(F.col("certain") * F.col("tokens"))).alias("rest"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = docs.filter("rank is not null").groupBy("source", "cell").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(upto)).join(left, "source")
    # cells that fit as a whole, and the one in which the budget ends
    cells = cells.select("source", "cell", (F.col("upto") <= F.col("rest")).alias("whole"), ((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest"))).alias("last"), (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))
    inside = Window.partitionBy("source", "cell").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = docs.join(cells.filter("whole or last"), ["source", "cell"], "left")
    ends = ranked.filter("last").withColumn("sum", F.sum("tokens").over(inside)).withColumn("extra", (F.col("sum") <= F.col("room")).cast("int"))
    rest = ranked.filter("last is null or not last").withColumn("extra", F.coalesce(F.col("whole"), F.lit(False)).cast("int"))
    keep = ["id", "source", "tokens", "most", "budget", "rank", (F.col("certain") + F.col("extra")).alias("copies")]
    used = written(rest.select(*keep).unionByName(ends.select(*keep)), "used")
    for _ in range(FILL_ROUNDS):
        gap = used.groupBy("source").agg((F.first("budget") - F.sum(F.col("copies") * F.col("tokens"))).alias("gap"))
        # the largest document that fits in what is left and may be used once more; ties by rank
        best = used.join(F.broadcast(gap), "source").filter("copies < most and tokens <= gap").groupBy("source").agg(F.max(F.struct("tokens", F.coalesce(-F.col("rank"), F.lit(-2.0)).alias("r"), "id")).alias("b"))
        best = written(best.select("source", F.col("b.id").alias("id"), F.lit(1).alias("more")), "fill")
        if not best.limit(1).count():
            break
        used = used.join(F.broadcast(best), ["source", "id"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")
    return used.filter("copies > 0").select(F.col("id").alias(id_col), "source", "tokens", "copies")


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, docs, most_copies) of every listed source."""
    own = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    total = own.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.filter("source is not null").join(own, "source", "left").crossJoin(F.broadcast(total))
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
