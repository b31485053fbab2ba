"""Exact top-k inner products by ball trees, one for each shard.

Vectors are dealt into shards of bounded size by a hash of their key; a task builds a shard's ball tree once for all blocks that it is asked. Queries are dealt into
blocks of bounded size, and every block meets every shard. A block goes down a tree with all queries that may still gain
from a node: the upper bound of a query with a ball is its product with the centre plus its length times the radius, the
child with the greater bound comes first, and queries whose k-th score beats the bound leave. Shards of a block that
land in one task share the k-th scores found so far; across tasks they start from those of a first pass over one shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

K, SCALE, EVERY = 20, 64, 20
#: Vectors in a shard, in a leaf, and queries in a block.
SHARD, LEAF, BLOCK = 16_384, 128, 1_024
#: Blocks that a shard is sent for at once.
CHUNK = 16
#: Blocks whose k-th scores a task remembers from one shard to the next.
REMEMBERED = 4096
LONG = np.iinfo(np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The integer inner products of rows of ``q`` with rows of ``x``, exactly, by the narrowest numbers that hold them.

    A product that doesn't fit 64 bits raises OverflowError: it has no score of the type that is promised.
    """
    most = int(max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))) * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * q.shape[1]
    if most < 1 << 52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most <= LONG.max:
        return q @ x.T
    wide = q.astype(object) @ x.T.astype(object)
    if wide.size and (wide.max() > LONG.max or wide.min() <= LONG.min):
        raise OverflowError("an inner product of quantised vectors doesn't fit a long")
    return wide.astype(np.int64)


class BallTree:
    """A ball tree over integer vectors; nodes are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.arange(len(x))
        f = x.astype(np.float64)
        self.lo, self.hi, self.left, self.right, self.centre, self.radius = [], [], [], [], [], []

        def grow(lo: int, hi: int) -> int:
            own = order[lo:hi]
            at = len(self.lo)
            c = f[own].mean(axis=0)
            far = ((f[own] - c) ** 2).sum(axis=1)
            for s, v in zip((self.lo, self.hi, self.left, self.right, self.centre, self.radius), (lo, hi, -1, -1, c, float(np.sqrt(far.max()))), strict=True):
                s.append(v)
            if hi - lo > LEAF and far.max() > 0:
                a = f[own[far.argmax()]]
                b = f[own[((f[own] - a) ** 2).sum(axis=1).argmax()]]
                side = np.argsort(f[own] @ (b - a), kind="stable")
                order[lo:hi] = own[side]
                mid = (lo + hi) // 2
                self.left[at] = grow(lo, mid)
                self.right[at] = grow(mid, hi)
            return at

        grow(0, len(x))
        self.ids, self.x = ids[order], x[order]
        self.most = float(np.abs(f).max(initial=0.0))

    def search(self, q: np.ndarray, best: np.ndarray, who: np.ndarray, k: int) -> None:
        """Improves ``best`` (scores, descending) and ``who`` (ids) of every query in place; absent places hold the least score."""
        qf = q.astype(np.float64)
        length = np.sqrt((qf**2).sum(axis=1))
        slack = 1e-9 * (1 + length * (self.most * np.sqrt(q.shape[1])))

        def bound(node: int, who_asks: np.ndarray) -> np.ndarray:
            return qf[who_asks] @ self.centre[node] + length[who_asks] * self.radius[node] + slack[who_asks]

        def visit(node: int, asks: np.ndarray) -> None:
            asks = asks[bound(node, asks) >= best[asks, -1]]  # an equal score may still bring a smaller id
            if not len(asks):
                return
            lo, hi = self.lo[node], self.hi[node]
            if self.left[node] < 0:
                for s in range(lo, hi, 4 * LEAF):  # leaves are larger only where all rows are equal
                    e = min(hi, s + 4 * LEAF)
                    scores = products(q[asks], self.x[s:e])
                    ids = np.broadcast_to(self.ids[s:e], scores.shape)
                    none = LONG.min
                    both, names = np.hstack([best[asks], scores]), np.hstack([who[asks], ids])
                    names = np.where(both == none, np.iinfo(np.int64).max, names)
                    first = np.lexsort((names, -np.maximum(both, none + 1)), axis=1)[:, :k]
                    best[asks], who[asks] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
                return
            a, b = self.left[node], self.right[node]
            if bound(a, asks).max() < bound(b, asks).max():
                a, b = b, a
            visit(a, asks)
            visit(b, asks)

        visit(0, np.arange(len(q)))


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine, F.lit(False))


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): components times 64, rounded down, of the vectors that take part: no null, none that is not finite.

    A component whose 64-fold is no long stops the query, as no integer of the promised type holds it.
    """
    rows = vectors.where(_usable(F.col(vector)) & F.col(key).isNotNull())
    whole = lambda x: F.when(F.abs(x.cast("double") * SCALE) < float(1 << 62), F.floor(x.cast("double") * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for an integer score")).cast("long"))
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, whole).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of ``vectors`` (id, v) for each row of ``queries`` (id, v).

    Score is the integer inner product, exact whatever the size of components (a score that is no long stops the query); ties go to
    the smaller id; a query's own row, one with its id and its vector, is no candidate of it, other rows with its id are. There are fewer rows for a query
    if there are fewer candidates. Repeated rows of candidates are candidates each; repeated queries get the same
    rows each. Vectors of another length than the most frequent have no product with the rest and take no part. Empty tables give an empty table.
    """
    most = k + 1  # the query's own row leaves at the end
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = durable(vectors, "top-vectors")
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return empty
    width, n = sizes[0]["d"], sizes[0]["count"]
    queries = durable(queries.where(F.size("v") == width), "top-queries")
    asked = queries.count()
    if not asked:
        return empty
    shards, blocks = -(-n // SHARD), -(-asked // BLOCK)
    # repeated keys would all hash to one shard or block, so the vector takes part in the deal as well
    deal = lambda m, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(m).cast("long")).cast("int")

    def packed(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy())
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(x).max() <= np.iinfo(k).max)  # as narrow as the components allow
        copies = rows["copies"].to_numpy(np.int64).tobytes() if "copies" in rows else None
        return pd.DataFrame({"cell": [int(cell[0])], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "x": [x.astype(kind).tobytes()], "copies": [copies]})

    def unpacked(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = np.frombuffer(ids, np.int64)
        return n, np.frombuffer(x, f"<i{len(x) // (len(n) * width)}").reshape(-1, width).astype(np.int64)

    trees = vectors.where(F.size("v") == width).groupBy(deal(shards, 59).alias("cell")).applyInPandas(packed, "cell int, ids binary, x binary, copies binary")
    trees = durable(trees, "top-shards")
    # equal queries are one query with a number of copies
    different = queries.groupBy("id", "v").agg(F.count("*").alias("copies"))
    asks = durable(different.groupBy(deal(blocks, 61).alias("cell")).applyInPandas(packed, "cell int, ids binary, x binary, copies binary"), "top-blocks")
    out = "block int, id long, v binary, copies long, own long, best array<bigint>, who array<bigint>"
    none, last = LONG.min, LONG.max

    held: dict[int, np.ndarray] = {}  # each task gets its own copy

    def search(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        tree = BallTree(*unpacked(shard["ids"][0], shard["x"][0])) if len(shard) and len(asked) else None
        for row in asked.itertuples(index=False) if tree is not None else ():
            qid, q = unpacked(row.qids, row.q)
            best, who = np.full((len(q), most), none), np.full((len(q), most), last)
            if row.floor is not None:  # scores to beat; an equal one still counts
                best[:] = np.frombuffer(row.floor, np.int64)[:, None]
            if row.block in held:
                best = np.maximum(best, held[row.block][:, None])
            tree.search(q, best, who, most)
            if len(held) >= REMEMBERED:
                held.clear()
            held[row.block] = best[:, -1].copy()
            own = [int(products(r[None], r[None])[0, 0]) for r in q]
            found.append(pd.DataFrame({"block": row.block, "id": qid, "v": [r.tobytes() for r in q], "copies": np.frombuffer(row.copies, np.int64), "own": own, "best": best.tolist(), "who": who.tolist()}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({n: [] for n in ("block", "id", "v", "copies", "own", "best", "who")}, dtype=object)

    def meet(pairs: DataFrame, of_shard: Column, chunks: int) -> DataFrame:
        """Each block of ``pairs`` with its shard: a shard is sent once for every CHUNK blocks and never written beside each of them, nor broadcast."""
        shards_ = shard_rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        pairs = pairs.select("shard", F.floor(of_shard / CHUNK).cast("int").alias("chunk"), "block", "qids", "q", "copies", "floor")
        return pairs.groupBy("shard", "chunk").cogroup(shards_.groupBy("shard", "chunk")).applyInPandas(search, out)

    shard_rows = trees.select(F.col("cell").alias("shard"), "ids", "x")
    ask_rows = asks.select(F.col("cell").alias("block"), F.col("ids").alias("qids"), F.col("x").alias("q"), "copies")
    # first pass: every block with one shard, for the scores to beat
    first = ask_rows.withColumn("shard", F.pmod(F.col("block"), F.lit(shards))).withColumn("floor", F.lit(None).cast("binary"))
    first = durable(meet(first, F.col("block") / shards, -(-blocks // (shards * CHUNK))), "top-first")
    done = first
    if shards > 1:

        def floors(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            at = rows["best"].map(lambda b: b[-1])
            return pd.DataFrame({"block": [int(cell[0])], "qids": [rows["id"].to_numpy(np.int64).tobytes()], "q": [b"".join(rows["v"])], "copies": [rows["copies"].to_numpy(np.int64).tobytes()], "floor": [at.to_numpy(np.int64).tobytes()]})

        ready = first.groupBy("block").applyInPandas(floors, "block int, qids binary, q binary, copies binary, floor binary")
        ready = ready.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != F.pmod(F.col("block"), F.lit(shards)))
        done = first.union(durable(meet(ready, F.col("block"), -(-blocks // CHUNK)), "top-rest"))
    rows = done.select("id", "v", "copies", "own", F.explode(F.arrays_zip("best", "who")).alias("z")).select("id", "v", "copies", "own", F.col("z.best").alias("score"), F.col("z.who").alias("vec_id")).where(F.col("vec_id") != last)
    order = Window.partitionBy("id", "v").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, 0)
    mine = (F.col("vec_id") == F.col("id")) & (F.col("score") == F.col("own"))
    rows = rows.withColumn("mine", mine).withColumn("met", F.sum(F.col("mine").cast("int")).over(order)).withColumn("rank", F.row_number().over(order) - (F.col("met") > 0).cast("int"))
    rows = rows.where(~(F.col("mine") & (F.col("met") == 1)) & (F.col("rank") <= k))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % EVERY == 0))
