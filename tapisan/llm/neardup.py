"""Near-duplicates by fingerprints in overlapping shards, each searched with a vantage-point tree.

Each text is a set of word shingles with a sketch of `bands * rows` minimum hashes. One bit of each of the first 256
makes a fingerprint, whose Hamming distance estimates the similarity: texts of similarity s differ in (1 - s) / 2 of the
bits. In this space unrelated texts all lie about half the bits apart, while the radius that keeps texts of similarity
0.5 is more than a third of them, so triangle bounds of one tree over everything prune nothing. Therefore texts are first
put in overlapping shards, one for each band of the sketch, and each shard is searched with a tree of its own: near texts
that part in one shard meet in another. Pairs within the radius are then verified with their exact shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapisan.config import written
from tapisan.llm.text import MinHash, WordHashes, mixed, shingles, similarity, words

#: Rows of a shard searched as one leaf, and rows of a shard held together; larger shards are split in blocks that meet pairwise.
LEAF, BLOCK = 24, 4096


def radius(bits: int, threshold: float, sigmas: float = 4.0) -> int:
    """Hamming radius beyond which a pair of at least that similarity lies only by a deviation of `sigmas`."""
    p = (1 - threshold) / 2
    return min(bits, math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p))))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class VPTree:
    """Vantage-point tree over fingerprints (n x words of 64 bits); self_pairs gives all pairs within r.

    A node keeps the distances' bounds of its inner and outer half; a query goes into a half only if its ball of radius r
    overlaps the half's ring. Queries go down in groups, so each node costs one vectorised distance computation.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf, self.visited = points, leaf, 0
        self.root = self.build(np.arange(len(points)))

    def build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        vantage, rest = at[0], at[1:]
        d = hamming(self.points[rest], self.points[vantage])
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        halves = []
        for part in (order[:half], order[half:]):
            halves.append((int(d[part].min()), int(d[part].max()), self.build(rest[part])) if len(part) else None)
        return vantage, halves

    def search(self, node, queries: np.ndarray, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(queries):
            return
        if isinstance(node, np.ndarray):
            self.visited += len(queries) * len(node)
            q, p = np.nonzero(hamming(self.points[queries][:, None], self.points[node][None]) <= r)
            yield queries[q], node[p]
            return
        vantage, halves = node
        self.visited += len(queries)
        d = hamming(self.points[queries], self.points[vantage])
        hit = queries[d <= r]
        yield hit, np.full(len(hit), vantage)
        for half in halves:
            if half:
                low, high, child = half
                yield from self.search(child, queries[(d + r >= low) & (d - r <= high)], r)

    def self_pairs(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        found = list(self.search(self.root, np.arange(len(self.points)), r))
        q, p = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        return q[q < p], p[q < p]


def sketches(df: DataFrame, id_col: str, text_cols: list[str], size: int, bands: int, rows: int) -> DataFrame:
    """(id, h, f0..f3, keys): hash of the shingle set, fingerprint, band keys. Texts without shingles have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, minhash = WordHashes(), MinHash(max(256, bands * rows))
        band = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for b in batches:
            out = []
            for i, text in zip(b["id"].tolist(), b["text"].tolist()):
                s = shingles(hashes(words(text)), size)
                if not len(s):
                    continue
                m = minhash(s)
                k = m[: bands * rows].reshape(bands, rows).astype(np.uint64)
                key = band.copy()
                for r in range(rows):
                    key = mixed(key ^ k[:, r])
                f = np.packbits(((m[:256] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(bool)).view(np.int64)
                h = mixed(np.bitwise_xor.reduce(mixed(s + np.uint64(7)), keepdims=True) + np.uint64(len(s)))[0]
                out.append((i, h.view(np.int64), f[0], f[1], f[2], f[3], key.view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "h", "f0", "f1", "f2", "f3", "keys"])

    text = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text_cols])
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text")).filter("id is not null").mapInPandas(run, "id bigint, h bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint, keys array<bigint>")


def shard_pairs(shards: DataFrame, r: int) -> DataFrame:
    """Pairs (a < b) of rows of the same shard `key` whose 128-bit fingerprints (f0, f1) are within r.

    A shard's rows stream through one task; beyond BLOCK rows they go out again in blocks, and each pair of blocks is
    searched by a task of its own, so no task holds an unbounded shard and none of its pairs are lost.
    """

    def tree_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return VPTree(fp).self_pairs(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last shard of a batch waits for the next batch; once it holds more than BLOCK rows it is split in blocks
        rest: tuple | None = None
        split_key, block = None, 0

        def emit(a, b, key=None, blk=None, i=None, f=None):
            n = len(a) if a is not None else len(i)
            none = lambda t: pa.nulls(n, t)
            cols = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))] if a is not None else [none(pa.int64())] * 2
            cols += [none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64())] if key is None else [pa.array(key), pa.array(np.full(n, blk, np.int32)), pa.array(i), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "block", "id", "f0", "f1"])

        def pairs(key, ids, fp):
            n = len(key)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, n])
            big = sizes > LEAF
            small = np.repeat(~big, sizes)
            for off in range(1, int(sizes[~big].max(initial=1))):
                at = np.flatnonzero((key[off:] == key[:-off]) & small[off:])
                if not len(at):
                    break
                at = at[hamming(fp[at], fp[at + off]) <= r]
                if len(at):
                    yield emit(ids[at], ids[at + off])
            for s, z in zip(starts[big].tolist(), sizes[big].tolist()):
                p, q = tree_pairs(fp[s : s + z])
                if len(p):
                    yield emit(ids[s:][p], ids[s:][q])

        for b in batches:
            if not b.num_rows:
                continue
            key, ids = b.column("key").to_numpy(), b.column("id").to_numpy()
            fp = np.stack([b.column(c).to_numpy() for c in ("f0", "f1")], axis=1).view(np.uint64)
            if rest is not None:
                key, ids, fp = np.r_[rest[0], key], np.r_[rest[1], ids], np.concatenate([rest[2], fp])
            last = int(np.searchsorted(key, key[-1]))
            if split_key is not None and key[0] == split_key:
                upto = last if key[-1] != split_key else len(key)
                end = int(np.searchsorted(key, split_key, side="right"))
                for at in range(0, end, BLOCK):
                    cut = slice(at, min(end, at + BLOCK))
                    yield emit(None, None, key[cut], block, ids[cut], fp[cut])
                    block += 1
                key, ids, fp, last = key[end:], ids[end:], fp[end:], max(0, last - end)
                if not len(key):
                    rest = None
                    continue
            if last:
                yield from pairs(key[:last], ids[:last], fp[:last])
            rest = (key[last:], ids[last:], fp[last:])
            if len(rest[0]) > BLOCK:
                split_key, block = rest[0][0], 0
                for at in range(0, len(rest[0]), BLOCK):
                    cut = slice(at, at + BLOCK)
                    yield emit(None, None, rest[0][cut], block, rest[1][cut], rest[2][cut])
                    block += 1
                rest = None
        if rest is not None and len(rest[0]):
            yield from pairs(*rest)

    schema = "a bigint, b bigint, key bigint, block int, id bigint, f0 bigint, f1 bigint"
    out = written(shards.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema).distinct(), "shards")
    blocks = out.filter("block is not null")
    most = blocks.groupBy("key").agg(F.max("block").alias("most"))
    spread = blocks.join(most, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("most"))))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "f0", "f1")

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["i"].iat[0], p["j"].iat[0]
        fp = np.stack([p["f0"].to_numpy(), p["f1"].to_numpy()], axis=1).view(np.uint64)
        ids, blk = p["id"].to_numpy(), p["block"].to_numpy()
        a, b = VPTree(fp).self_pairs(r)
        keep = (blk[a] != blk[b]) if i != j else np.full(len(a), True)
        a, b = ids[a[keep]], ids[b[keep]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    met = spread.groupBy("key", "i", "j").applyInPandas(meet, "a bigint, b bigint")
    return out.filter("a is not null").select("a", "b").unionByName(met.distinct())


class Links:
    """The result of near_duplicates: `members` (id, rep), `pairs` (a < b, similarity) of representatives."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs

    def all_pairs(self) -> DataFrame:
        """(a < b, similarity) of all rows, copies expanded."""
        m = self.members
        p = self.pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
        across = p.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
        more = m.filter("id != rep").select("rep").distinct()
        own = m.join(more, "rep", "left_semi")
        within = own.select("rep", F.col("id").alias("a")).join(own.select("rep", F.col("id").alias("b")), "rep").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
        return across.unionByName(within)


def near_duplicates(df: DataFrame, id_col: str, text_cols: list[str], size: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 8) -> Links:
    """Texts whose sets of runs of `size` words have a similarity of at least `threshold`.

    A pair of similarity s meets in no shard with a chance of (1 - s^rows)^bands. Copies (equal sets) are one
    representative, found by a hash aggregate, so a group of copies of any size is one row of a shard. Null texts are
    empty; texts of fewer than `size` words have no set and no links; null ids are dropped; equal ids count as one row.
    Columns other than the id and the texts aren't read.
    """
    own = written(sketches(df, id_col, text_cols, size, bands, rows), "sketches")
    reps = own.groupBy("h").agg(F.min(F.struct("id", "f0", "f1", "keys")).alias("r"))
    shards = reps.select("r.id", "r.f0", "r.f1", F.explode("r.keys").alias("key"))
    fp = own.select("id", "f0", "f1", "f2", "f3")
    met = shard_pairs(shards, radius(128, threshold))
    bits = sum((F.bit_count(F.col(f"x.f{k}").bitwiseXOR(F.col(f"y.f{k}"))) for k in range(1, 4)), F.bit_count(F.col("x.f0").bitwiseXOR(F.col("y.f0"))))
    near = met.join(fp.alias("x"), F.col("a") == F.col("x.id")).join(fp.alias("y"), F.col("b") == F.col("y.id")).filter(bits <= radius(256, threshold)).select("a", "b")
    members = own.select("id", "h").join(reps.select("h", F.col("r.id").alias("rep")), "h").select("id", "rep").distinct()
    return Links(members, verified(df, id_col, text_cols, written(near, "near"), size, threshold))


def verified(df: DataFrame, id_col: str, text_cols: list[str], pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least the threshold, with it."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text_cols])
    texts = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"))
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    both = ends.join(texts, "id").groupBy("a", "b").agg(F.min_by("text", "id").alias("x"), F.max_by("text", "id").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            s = [similarity(shingles(hashes(words(x)), size), shingles(hashes(words(y)), size)) for x, y in zip(b["x"], b["y"])]
            out = b[["a", "b"]].assign(similarity=np.array(s, float))
            yield out[out["similarity"] >= threshold]

    return both.mapInPandas(run, "a bigint, b bigint, similarity double")


def groups(links: Links) -> DataFrame:
    """(id, group_id, n_links) of every row that has a copy or a link; group_id is the smallest id reached by links."""
    from tapisan.llm.components import components

    comp = components(links.pairs)
    n = links.pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    copies = links.members.groupBy("rep").agg(F.count("*").alias("copies"))
    out = links.members.join(copies, "rep").join(n, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").filter("copies > 1 or n_links is not null")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
