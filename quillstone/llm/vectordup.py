"""Near-duplicate embeddings by product quantisation.

Every vector goes to its nearest coarse list and is coded there by the nearest codeword of its residual in each of several
subspaces. A vector then probes the lists with the nearest centroids: a table of inner products with all codewords gives the
approximate cosine of each member (asymmetric distance), the length of the part that the code misses bounds the error, and
members whose bound reaches the threshold are compared exactly, in double precision.

A direction of search counts a link for the vector that probes. If the other one doesn't probe back, the link is counted for it
as well, so every link found counts once on both sides and no list of pairs is needed. What leaves a task is a count for each
vector and a spanning forest of the links found. Equal vectors are one vector with a multiplicity. Long lists are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, components, durable, table

THRESHOLD = 0.9
#: The bounded sample that centroids and codebooks are fitted on, rounds of k-means, and the greatest number of lists.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 8, 8192
#: Subspaces of a code and codewords in each; a vector probes this many lists and one more for each doubling of their number.
SUBSPACES, CODEWORDS, PROBES = 8, 64, 2
#: Vectors in a block and queries compared at once; products with centroids that are in memory at once.
BLOCK, AT_ONCE, CELLS = 4096, 256, 4_000_000


def _slices(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose products with so many centroids are of bounded size."""
    step = max(1, CELLS // max(1, columns))
    return (slice(i, i + step) for i in range(0, rows, step))


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = (centres**2).sum(1)
    return np.concatenate([(length - 2 * x[s] @ centres.T).argmin(axis=1) for s in _slices(len(x), len(centres))] or [np.zeros(0, dtype=np.int64)])


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _closest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


class Index:
    """Coarse centroids and the codebooks of their residuals, from unit vectors; and coding by them."""

    def __init__(self, sample: np.ndarray, lists: int, probes: int | None = PROBES) -> None:
        self.centres = _kmeans(sample, max(1, min(lists, len(sample))), 1)
        rest = sample - self.centres[self.nearest(sample, 1)[:, 0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, c], min(CODEWORDS, len(rest)), 2 + i) for i, c in enumerate(self.cuts)]
        lists = len(self.centres)
        self.probes = lists if probes is None else min(lists, probes + int(np.ceil(np.log2(lists))))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest centroids of each vector, nearest first."""
        if n == 1:
            return _closest(x, self.centres)[:, None]
        length = (self.centres**2).sum(1)
        out = np.empty((len(x), n), dtype=np.int64)
        for s in _slices(len(x), len(self.centres)):
            far = length - 2 * x[s] @ self.centres.T
            some = np.argpartition(far, n - 1, axis=1)[:, :n]
            out[s] = np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(axis=1, kind="stable"), 1)
        return out

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what they miss) of vectors in their lists."""
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.cuts)), dtype=np.uint8)
        missed = np.zeros(len(x))
        for i, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            far = (book**2).sum(1) - 2 * rest[:, c] @ book.T
            codes[:, i] = far.argmin(axis=1)
            missed += ((rest[:, c] - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def bound(self, q: np.ndarray, which: int, codes: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of unit vectors ``q`` with the coded members of list ``which``."""
        out = np.add.outer(q @ self.centres[which], missed)
        for i, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, c] @ book.T)[:, codes[:, i]]
        return out


def _units(column: pa.Array) -> list[pa.Array]:
    """Unit vectors in double precision; null where a vector is null, empty, zero, or holds null or non-finite components."""
    held = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(held, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten()  # without what null rows may cover
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).copy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = sizes > 0
    fine[row[~np.isfinite(x)]] = False
    most = np.zeros(len(sizes))
    np.maximum.at(most, row, np.where(np.isfinite(x), np.abs(x), 0.0))
    fine &= most > 0
    keep = fine[row]
    x, row = x[keep], row[keep]
    x = np.ldexp(x, -np.frexp(most)[1][row])  # keeps squares of very large and very small components finite
    x /= np.sqrt(np.bincount(row, weights=x * x, minlength=len(sizes)))[row]
    ends = np.concatenate([[0], np.cumsum(np.where(fine, sizes, 0))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(x), mask=pa.array(~fine))]


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges between two arrays of ids."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _compare(index: Index, which: int, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
    """Links between probing vectors ``q`` and members ``x`` of one list: rows (a, b, links), b null for counts."""
    mat = lambda s: np.frombuffer(b"".join(s), dtype="<f8").reshape(len(s), -1)
    xv, qv = mat(x["v"]), mat(q["v"])
    codes = np.frombuffer(b"".join(x["codes"]), dtype=np.uint8).reshape(len(x), -1)
    probes = np.frombuffer(b"".join(x["probes"]), dtype="<i4").reshape(len(x), -1)
    xi, qi = x["id"].to_numpy(), q["id"].to_numpy()
    xn, qn, ql, missed = x["n"].to_numpy(), q["n"].to_numpy(), q["own"].to_numpy(), x["missed"].to_numpy()
    q_links, x_links = np.zeros(len(q), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    edges: list[np.ndarray] = []
    for s in range(0, len(q), AT_ONCE):
        part = qv[s : s + AT_ONCE]
        i, j = np.nonzero(index.bound(part, which, codes, missed) >= THRESHOLD - 1e-9)
        hit = np.zeros(len(i), dtype=bool)
        for t in range(0, len(i), 65536):
            hit[t : t + 65536] = np.einsum("ij,ij->i", part[i[t : t + 65536]], xv[j[t : t + 65536]]) >= THRESHOLD
        hit &= qi[s + i] != xi[j]
        i, j = s + i[hit], j[hit]
        if not len(i):
            continue
        np.add.at(q_links, i, xn[j])
        back = (probes[j] == ql[i][:, None]).any(axis=1)
        np.add.at(x_links, j[~back], qn[i[~back]])
        nodes, low = _forest(qi[i], xi[j])
        keep = nodes != low
        edges.append(np.column_stack([nodes[keep], low[keep]]))
    pairs = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), dtype=np.int64)
    ids = np.concatenate([qi, xi])
    links = np.concatenate([q_links, x_links])
    ids, links = ids[links > 0], links[links > 0]
    return pd.DataFrame({"a": np.concatenate([ids, pairs[:, 0]]), "b": pd.array([*[None] * len(ids), *pairs[:, 1].tolist()], dtype="Int64"), "links": np.concatenate([links, np.zeros(len(pairs), dtype=np.int64)])})


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", probes: int | None = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``.

    A vector that is null, empty, zero, or holds null or non-finite components links with nothing and is its own component; so
    does one whose length isn't the most frequent. Links are pairs of rows with cosine of at least 0.9 that the index finds; with
    ``probes`` None every list is probed and all links are found. Repeated keys, with one vector or several, count as separate rows but share a component; rows with a null key have no component. Ties need no rule:
    results depend on sets only. An empty table gives an empty table; other columns are ignored.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("raw"))
    rows = arrow_columns(rows, "raw", [T.StructField("v", T.ArrayType(T.DoubleType()))], _units).drop("raw")
    rows = durable(rows.withColumn("ok", F.col("v").isNotNull() & F.col("id").isNotNull()), "vec-units")
    common = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    width = common[0]["d"] if common else 0
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == width)).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(43)))
    # one row for each different vector; of the vectors of one id one goes by the id, the others by a number beyond all ids
    least = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    lowest = least.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("first"))
    beyond = F.lit(1 << 62) + F.pmod(F.xxhash64("id", "h1", "h2"), F.lit(1 << 61))
    least = durable(least, "vec-least").join(durable(lowest, "vec-lowest"), "id")
    copies = least.select("h1", "h2", "n", F.col("id").alias("least"), F.when(F.struct("h1", "h2") == F.col("first"), F.col("id")).otherwise(beyond).alias("head"))
    copies = durable(copies, "vec-copies")
    total = copies.count()
    heads = rows.where("ok").withColumnRenamed("id", "least").join(copies, ["h1", "h2", "least"]).groupBy(F.col("head").alias("id")).agg(F.first("v").alias("v"), F.first("n").alias("n"))
    result = rows.select("id", "h1", "h2", "ok")
    if total == 0:
        return result.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    heads = durable(heads, "vec-heads")
    sample = heads.select("v", F.xxhash64("id", F.lit(47)).alias("h")).orderBy("h").limit(SAMPLE).select("v").toPandas()  # a bounded sample
    index = Index(np.stack(sample["v"].to_numpy()).astype(np.float64), min(MOST_LISTS, int(np.ceil(np.sqrt(total)))), probes)
    shared = heads.sparkSession.sparkContext.broadcast(index)  # MOST_LISTS centroids at most

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if not batch.num_rows:
                continue
            near = idx.nearest(x, idx.probes)
            codes, missed = idx.code(x, near[:, 0])
            cells = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n"), cells(x.astype("<f8")), pa.array(near[:, 0].astype(np.int32)), cells(codes), pa.array(missed), cells(near.astype("<i4")), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                names=["id", "n", "v", "own", "codes", "missed", "probes", "near"],
            )

    coded = durable(heads.select("id", "n", "v").mapInArrow(code, "id long, n long, v binary, own int, codes binary, missed double, probes binary, near array<int>"), "vec-coded")
    members = coded.groupBy(F.col("own").alias("list")).agg(F.count("*").alias("nx"))
    asking = coded.select(F.explode("near").alias("list")).groupBy("list").agg(F.count("*").alias("nq"))
    # one row a list, MOST_LISTS at most, so it may be broadcast: how many blocks either side is cut into
    cuts = durable(members.join(asking, "list").select("list", F.ceil(F.col("nx") / BLOCK).cast("int").alias("bx"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("bq")), "vec-cuts")
    draw = lambda n: F.pmod(F.xxhash64("id", F.lit(53)), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = coded.withColumnRenamed("own", "list").join(F.broadcast(cuts), "list").withColumn("xb", draw(F.col("bx"))).withColumn("qb", every(F.col("bq"))).select("list", "xb", "qb", "id", "n", "v", "codes", "missed", "probes")
    q = coded.withColumn("list", F.explode("near")).join(F.broadcast(cuts), "list").withColumn("qb", draw(F.col("bq"))).withColumn("xb", every(F.col("bx"))).select(*[F.col(c).alias(c) for c in ("list", "xb", "qb", "id", "n", "v", "own")])  # names of its own, for the cogroup

    def links(cell: tuple, asks: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(has):
            return pd.DataFrame({"a": pd.array([], dtype="Int64"), "b": pd.array([], dtype="Int64"), "links": pd.array([], dtype="Int64")})
        return _compare(shared.value, int(cell[0]), asks, has)

    found = q.groupBy("list", "xb", "qb").cogroup(x.groupBy("list", "xb", "qb")).applyInPandas(links, "a long, b long, links long")
    found = durable(found, "vec-found")
    counts = found.where("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("links").alias("links"))
    result = result.join(copies, ["h1", "h2"], "left").withColumn("head", F.when(F.col("ok"), F.col("head")).otherwise(F.col("id")))
    # the vectors of one id belong together; where ids have one vector each, no row is left of this
    several = result.where("ok").groupBy("id").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low <> high").select("id")
    same = durable(result.where("ok").join(several, "id").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "vec-same")
    roots = components(found.where("b is not null").select("a", "b").union(same), "vec").withColumnRenamed("node", "head")
    result = result.join(counts, "head", "left").join(roots, "head", "left")
    own = F.when(F.col("ok"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(0).cast("long")
    component = F.coalesce("root", "head")
    return result.select(F.col("id").alias(key), own.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
