"""Items of varying length into containers of fixed capacity, by a configuration linear program.

The program has a variable for each way to fill a container and a row for each length of the histogram. It is solved by
multiplicative weights: a length's price falls as it is covered, a knapsack dynamic program finds the dearest filling at
these prices, and the fillings' amounts are added up. The amounts are rounded down to whole containers; what is left is
priced and filled again in whole containers until nothing is left. Lengths are counted on a grid of at most GRID steps of
the capacity, rounded up, so the program has the same size for any number of items, and only the histogram, never an item,
comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapisan.config import written

#: Steps of the capacity on which lengths are counted; rounds of multiplicative weights; salts of an item's rank.
GRID, ROUNDS, SALTS = 2048, 600, 64
#: Rate at which a price falls with its length's coverage, and coverage added in a round.
RATE, STEP = 0.25, 0.5
#: What is added to a length's price in the rounding for being large and for being left.
LARGE, MUCH = 0.15, 0.02


def dearest(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The filling (multiplicity of each size) of highest total price: an unbounded knapsack. sizes ascend.

    Fillings of up to half the capacity come first, from sizes that are worth more than any filling of smaller ones. A
    filling of the whole is the item at which it passes the half, what comes before it and what comes after it, and each of
    these two is one of up to half.
    """
    half = capacity // 2
    best, took = np.zeros(half + 1), np.full(half + 1, -1)
    few = int(np.searchsorted(sizes, half, side="right"))
    own, worth, at, n, k = np.zeros(few, np.int64), np.zeros(few), np.zeros(few, np.int64), 0, 0
    for c in range(int(sizes[0]) if few else half + 1, half + 1):
        best[c] = best[c - 1]
        if n:
            value = best[c - own[:n]] + worth[:n]
            top = int(value.argmax())
            if value[top] > best[c] + 1e-15:
                best[c], took[c] = value[top], at[top]
        if k < few and sizes[k] == c:
            if price[k] > best[c] + 1e-15:
                best[c], took[c] = price[k], k
                own[n], worth[n], at[n] = c, price[k], k
                n += 1
            k += 1
    out = np.zeros(len(sizes), np.int64)

    def add(c: int) -> None:
        while c > 0:
            if took[c] >= 0:
                out[took[c]] += 1
                c -= int(sizes[took[c]])
            else:
                c -= 1

    # the item that passes the half (none if all is of up to half), and the room of the parts before and after it
    most, parts = float(best[half]), (half,)
    fit = slice(few, int(np.searchsorted(sizes, capacity, side="right")))
    if fit.stop > few:
        value = price[fit] + best[capacity - sizes[fit]]
        top = int(value.argmax())
        if value[top] > most + 1e-15:
            most, parts = value[top], (few + top, 0, capacity - int(sizes[few + top]))
    if n:
        # row i: what comes after item i and the first part of 0 to half, as windows of the best fillings from full to empty
        after = np.lib.stride_tricks.sliding_window_view(np.r_[best, np.full(capacity - half, best[half])][::-1], half + 1)
        value = after[own[:n]]
        value += best
        both = value.max(axis=1) + worth[:n]
        i = int(both.argmax())
        if both[i] > most + 1e-15:
            first = int(value[i].argmax())
            parts = (int(at[i]), first, min(capacity - int(own[i]) - first, half))
    if len(parts) > 1:
        out[parts[0]] += 1
    for c in parts[-2:] if len(parts) > 1 else parts:
        add(c)
    return out


def filled(sizes: np.ndarray, use: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """use, cut to what is left of each size, its gap filled with the largest sizes that are left and fit."""
    use = np.minimum(use, left)
    gap = capacity - int((use * sizes).sum())
    for k in range(int(np.searchsorted(sizes, gap, side="right")) - 1, -1, -1):
        n = min(gap // int(sizes[k]), int(left[k] - use[k]))
        if n > 0:
            use[k] += n
            gap -= n * int(sizes[k])
    return use


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Fractional amounts of fillings that cover the demand, and a lower bound of the containers needed (by the best dual)."""
    n = len(sizes)
    covered, found, bound = np.zeros(n), {}, 0.0
    # prices start at the share of a container that a length takes, the dual of a program without waste
    share = sizes / capacity
    for _ in range(rounds):
        price = share * np.exp(-RATE * (covered - covered.mean()))
        use = dearest(sizes, price, capacity)
        worth = float((use * price).sum())
        bound = max(bound, float((price * demand).sum()) / worth)
        use = np.minimum(use, demand)
        at = use > 0
        # as much as covers a given part of the demand of the length it covers most
        step = STEP * float((demand[at] / use[at]).min())
        covered += step * use / demand
        key = use.tobytes()
        found[key] = (use, found.get(key, (use, 0.0))[1] + step)
    scale = 1 / max(float((covered * share * demand).sum() / (share * demand).sum()), 1e-9)
    return [(use, x * scale) for use, x in found.values()], bound


def whole(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Whole containers (filling, how many) that hold exactly the demand, and the program's lower bound."""
    if not len(sizes):
        return [], 0.0
    fractional, bound = solve(sizes, demand, capacity, rounds)
    left, out = demand.copy(), []
    for use, x in sorted(fractional, key=lambda c: -float((c[0] * sizes).sum()) - 1e-9 * c[1]):
        # full fillings first; a filling that what is left no longer allows is cut down
        at = use > 0
        m = min(int(x), int((left[at] // use[at]).min()))
        if m > 0 and (use * sizes).sum() >= 0.98 * capacity:
            out.append((use, m))
            left -= m * use
    # the rest in whole containers, priced by length so that large items go first, dearer where much is left
    while left.any():
        at = np.flatnonzero(left)
        price = sizes[at] / capacity * (1 + LARGE * sizes[at] / capacity + MUCH * left[at] / demand[at])
        use = np.zeros_like(left)
        use[at] = filled(sizes[at], dearest(sizes[at], price, capacity), left[at], capacity)
        k = use > 0
        m = max(1, int(0.5 * (left[k] // use[k]).min()))
        out.append((use, m))
        left -= m * use
    return out, bound


def pieces(counts: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, tokens): items longer than the capacity cut in full pieces and a rest, others whole."""
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    n = F.greatest(F.lit(1), F.ceil(size / capacity)).cast("int")
    out = counts.select(F.col(id_col).alias("id"), size.alias("_size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    return out.select("id", "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("_size") - start).alias("tokens"))


def pack(counts: DataFrame, id_col: str, size_col: str, capacity: int, grid: int = GRID) -> tuple[DataFrame, dict]:
    """(id, piece_no, start_token, tokens, container_id) and a summary (containers, lower bound).

    Items that fit are never cut; longer ones become full pieces and a rest. Items without tokens (null or 0) take no room
    and go into container 0. Equal items are told apart by id. No items give no rows and no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    step = max(1, -(-capacity // grid))
    cells = capacity // step
    cut = written(pieces(counts, id_col, size_col, capacity), "pieces")
    # cells are rounded up; a length above the last whole cell fills a container of its own
    cell = F.when(F.col("tokens") > cells * step, cells).otherwise(F.ceil(F.col("tokens") / step)).cast("int")
    cut = cut.withColumn("cell", cell)
    histogram = sorted((r[0], r[1]) for r in cut.filter("cell > 0").groupBy("cell").count().collect())
    sizes, demand = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    plan, bound = whole(sizes, demand, cells)
    ranges, base, used = [], 0, np.zeros(len(sizes), np.int64)
    for use, m in plan:
        for k in np.flatnonzero(use):
            n = int(use[k]) * m
            ranges.append((int(sizes[k]), int(used[k]), int(used[k]) + n, base, m))
            used[k] += n
        base += m
    schema = T.StructType([T.StructField("cell", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("low", "high", "base", "many")])
    places = counts.sparkSession.createDataFrame(ranges, schema)
    # ranks within a length, without gathering a frequent length in one task
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("cell", "salt").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("cell", "salt").orderBy("id", "piece_no")
    ranked = salted.withColumn("rank", F.row_number().over(inner) - 1).join(F.broadcast(offsets), ["cell", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    # the places are bounded by the program's size, whatever the number of items
    placed = ranked.join(F.broadcast(places), ["cell"], "left").filter(F.col("low").isNull() | ((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))))
    container = F.when(F.col("low").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("base") + (F.col("rank") - F.col("low")) % F.col("many"))
    return placed.select(F.col("id").alias(id_col), "piece_no", F.col("start").alias("start_token"), "tokens", container.alias("container_id")), {"containers": base, "lower_bound": bound}
