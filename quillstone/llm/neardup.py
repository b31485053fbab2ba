"""Near-duplicate documents by ProbMinHash.

A document is its five-word shingles, once as a set (all weights 1) and once weighted by ``1 + ln(count)``. Each shingle is a
Poisson process whose rate is its weight and whose arrivals fall on random positions of the signature; a position keeps the
shingle that arrives first. Two documents agree in a position with the probability Jaccard similarity of their weighted shingles;
with all weights 1 that is the Jaccard similarity of the sets, which is the one that is verified. Shingles take turns, and one stops
as soon as its next arrival is later than all positions of its document (early termination).

Bands of both signatures make candidates, so repeated passages, which lower the weighted similarity only, hide no pair. The
two signatures of a document without repeats are the same and give one set of bands. In each bucket the most central document, the one
whose buckets hold most documents, is compared with every other, so a bucket of n documents costs n comparisons and not n squared.

What shares a bucket and is still apart is settled without a list of all pairs. Documents that met centres of one class are a group, and
each is written as its difference to the group's hub. Two documents differ by the difference of those differences, so those
that are close to the hub are linked by their sizes alone, and any other link needs a shared, rare shingle in both
differences (prefix filter). Groups by such a shingle are compared if they are small and treated in the same way, with
what most of them share as the hub, if they are large; a group by a shingle has at most half of its parent's documents. The rows made grow with
the documents and their differences, and every link that the bands offer is found: similarity is verified exactly, at least 0.8 Jaccard of
the shingle sets. Classes are the connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, components, durable, free_name, table

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 0.0007.
BANDS, ROWS = 24, 6
#: A group of at most so many documents is compared pair by pair; a larger one is divided first.
FEW = 32
#: Documents that share one rare shingle of their differences are compared pair by pair up to this number.
POSTED = 256
#: Word hashes that a worker keeps, and shingles that are signed together.
WORDS_KEPT, TOGETHER = 100_000, 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) <= 48:
            self[word] = h
        return h


_HASHES = _Hashes()


def _forget() -> None:
    _HASHES.clear()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words (white-space separated, lower case), repeats included; one run for a shorter text."""
    found = text.lower().split() if text else []
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=n)
    width = min(n, words)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * _BASE + w[i : n - width + 1 + i]
    return _mix(out + np.uint64(width))


def sign(docs: list[np.ndarray], size: int = BANDS * ROWS, weighted: bool = True) -> np.ndarray:
    """The signatures, one row of ``size`` hashes for each document; documents are arrays of shingle hashes and not empty.

    Without ``weighted`` repeats do not count: documents are sets.
    """
    sets = [np.unique(x, return_counts=True) for x in docs]
    d = np.repeat(np.arange(len(docs)), [len(x) for x, _ in sets])
    h = np.concatenate([x for x, _ in sets]) if sets else np.zeros(0, dtype=np.uint64)
    rate = 1.0 + np.log(np.concatenate([c for _, c in sets])) if sets else np.zeros(0)
    if not weighted:
        rate = np.ones(len(h))
    first = np.full(len(docs) * size, np.inf)
    who = np.zeros(len(docs) * size, dtype=np.uint64)
    time, seed = np.zeros(len(h)), h.copy()
    while len(h):
        seed = seed + _ODD
        r = _mix(seed)
        time = time - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        at = d * size + (_mix(r ^ _ODD) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        who[at[won]] = h[won]
        last = first.reshape(-1, size).max(axis=1)
        on = time < last[d]
        d, h, rate, time, seed = d[on], h[on], rate[on], time[on], seed[on]
    return who.reshape(-1, size)


def bands(signatures: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature."""
    x = signatures.reshape(-1, n, rows)
    out = np.arange(1, n + 1, dtype=np.uint64)[None, :] * _ODD
    for i in range(rows):
        out = _mix(out ^ x[:, :, i]) + _BASE
    return out.view(np.int64)


def _bands_of(texts: pa.Array) -> list[pa.Array]:
    """The bands of the set signature and those of the weighted one that differ."""
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []
    some: list[bool] = []
    total = 0

    def flush() -> None:
        nonlocal total
        if held:
            own = bands(sign(held, weighted=False))
            repeats = np.array([len(np.unique(x)) < len(x) for x in held])
            other = own.copy()
            if repeats.any():
                other[repeats] = bands(sign([x for x, r in zip(held, repeats, strict=True) if r]))
            differs = np.concatenate([np.ones_like(own, dtype=bool), own != other], axis=1)
            parts.append(np.concatenate([own, other], axis=1)[differs])
            sizes.append(differs.sum(axis=1))
        held.clear()
        total = 0

    for t in texts.to_pylist():
        s = shingles(t)
        some.append(bool(len(s)))
        if len(s):
            held.append(s)
            total += len(s)
            if total >= TOGETHER:
                flush()
    flush()
    has = np.array(some, dtype=bool)
    n = np.zeros(len(some), dtype=np.int64)
    n[has] = np.concatenate(sizes) if sizes else 0
    return [_lists(n, parts)]


def _lists(sizes: np.ndarray, parts: list[np.ndarray]) -> pa.Array:
    """A list array of so many numbers a row, taken from ``parts`` in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), pa.int64()))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays without repeats have in common."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _measure(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the shingles of each, na and nb, and those in common. ``texts`` (node, text) meets each side in turn."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").select("a", "b", F.struct("left", "right").alias("__both"))

    def work(column: pa.Array) -> list[pa.Array]:
        out, kept, kept_text = [], np.zeros(0, dtype=np.uint64), None
        for x, y in zip(column.field("left").to_pylist(), column.field("right").to_pylist(), strict=True):
            if y != kept_text:  # pairs with one centre follow one another
                kept, kept_text = np.unique(shingles(y)), y
            own = np.unique(shingles(x))
            out.append((len(own), len(kept), shared(own, kept)))
        return [pa.array([v[i] for v in out], pa.int64()) for i in range(3)]

    return arrow_columns(two, "__both", [T.StructField(n, T.LongType()) for n in ("na", "nb", "common")], work, _forget).select("a", "b", "na", "nb", "common")


def _similar(common: Column, na: Column, nb: Column) -> Column:
    return common >= F.lit(SIMILARITY) * (na + nb - common) - F.lit(1e-9)


def _edits(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``members`` (g, node, hub, ...) without hub, with n, the shingles of the node, and edits: those that only it or only the hub has."""
    hubs = members.select("g", "hub").distinct().join(texts.select(F.col("node").alias("hub"), F.col("text").alias("right")), "hub").groupBy("g").agg(F.first("right").alias("right"))
    rows = members.drop("hub").join(texts.select("node", F.col("text").alias("left")), "node").dropDuplicates(["g", "node"])
    rows = durable(rows, "near-members").join(durable(hubs, "near-hubs"), "g")
    rows = rows.select(*members.drop("hub").columns, F.struct("left", "right").alias("__both"))

    def work(column: pa.Array) -> list[pa.Array]:
        n, out, kept, kept_text = [], [], np.zeros(0, dtype=np.uint64), None
        for x, y in zip(column.field("left").to_pylist(), column.field("right").to_pylist(), strict=True):
            if y != kept_text:
                kept, kept_text = np.unique(shingles(y)), y
            own = np.unique(shingles(x))
            n.append(len(own))
            out.append(np.setxor1d(own, kept, assume_unique=True).view(np.int64))
        return [pa.array(n, pa.int64()), _lists(np.array([len(x) for x in out], dtype=np.int64), out)]

    return arrow_columns(rows, "__both", [T.StructField("n", T.LongType()), T.StructField("edits", T.ArrayType(T.LongType()))], work, _forget).drop("__both")


def _near(n: Column, apart: Column) -> Column:
    """Whether sets of ``n`` shingles in all that differ in ``apart`` have a Jaccard similarity of at least 0.8: (n - d) / (n + d) >= 4 / 5."""
    return n >= 9 * apart


def settle(rows: DataFrame) -> DataFrame | None:
    """Links (a, b) between the rows (g, node, root, n, u, marks, edits) of each group ``g``, enough of them to join all that are linked.

    Two rows of a group differ in ``u`` of each and in what one of their ``edits`` has and the other hasn't. Rows of one ``root``, or with a mark
    in common, are known to be linked. A round takes from ``edits`` what most of the group share; if the sizes of two rows' edits
    already make them near, both are near the row with the most room as well, and are linked to that. Of the other rows, two that are near
    share one of their rarest common edits; how many, follows from the sizes. Those that share one are compared if they are few and are the
    next round's group if they are many.
    """
    found: list[DataFrame] = []
    level = 0
    while True:
        level += 1
        total = durable(rows.groupBy("g").agg(F.count("*").alias("m")), "near-total")
        times = durable(rows.select("g", F.explode("edits").alias("e")).groupBy("g", "e").agg(F.count("*").alias("f")).where("f > 1"), "near-times")
        times = durable(times.join(total, "g"), "near-often")
        # at most twice as many as a row of the group has edits on average
        most = durable(times.where("2 * f > m").groupBy("g").agg(F.collect_list("e").alias("most")), "near-most")
        other = F.array_union(F.array_except("edits", "most"), F.array_except("most", "edits"))
        rows = durable(rows.join(most, "g", "left").withColumn("edits", F.when(F.col("most").isNull(), F.col("edits")).otherwise(other)).drop("most"), "near-edits")
        rare = durable(times.select("g", "e", F.when(F.expr("2 * f > m"), F.col("m") - F.col("f")).otherwise(F.col("f")).alias("f")).where("f > 1"), "near-rare")
        common = rows.select("g", "node", F.explode("edits").alias("e")).join(rare, ["g", "e"])
        common = common.groupBy("g", "node").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("s")).select("g", "node", F.col("s.e").alias("common"))
        empty = F.array().cast("array<bigint>")
        rows = rows.join(common, ["g", "node"], "left").withColumn("common", F.coalesce("common", empty)).withColumn("c", F.size("common").cast("long"))
        rows = rows.withColumn("u", F.col("u") + F.size("edits") - F.col("c")).drop("edits").withColumn("room", F.col("n") - 9 * (F.col("u") + F.col("c")))
        rows = durable(rows, "near-common")
        group = rows.groupBy("g").agg(F.max(F.struct("room", "node")).alias("best"), F.min("u").alias("least"), F.max("n").alias("longest"))
        rows = durable(rows.join(durable(group, "near-group"), "g"), "near-grouped")
        close = F.col("room") + F.col("best.room") >= 0
        found.append(rows.where(close & (F.col("node") != F.col("best.node"))).select(F.col("node").alias("a"), F.col("best.node").alias("b")))
        rows = rows.withColumn("marks", F.when(close, F.col("marks").bitwiseOR(F.lit(1 << level).cast("long"))).otherwise(F.col("marks")))
        # a partner has at most a quarter more shingles, so so many differences at most
        limit = F.floor((F.col("n") + F.least("longest", F.floor(F.col("n") * 1.25))) / 9)
        share = F.greatest(F.lit(1), F.col("c") + F.col("u") + F.col("least") - limit)
        able = rows.where(F.col("u") + F.col("least") <= limit).withColumn("first", F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("c") - share + 1).cast("int")))
        posts = durable(able.select("g", "node", "root", "n", "u", "c", "marks", F.posexplode("first").alias("at", "e")), "near-posts")
        keys = posts.groupBy("g", "e").agg(F.count("*").alias("k"), F.bit_and("marks").alias("all"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        keys = durable(keys.where("k > 1 and all = 0 and r0 <> r1").select("g", "e", "k"), "near-keys")
        posts = durable(posts.join(keys, ["g", "e"]), "near-posted")
        x, y = posts.where(F.col("k") <= POSTED).alias("x"), posts.where(F.col("k") <= POSTED).alias("y")
        apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.marks").bitwiseAND(F.col("y.marks")) == 0)
        # what both share from this edit on is no more than the shorter rest
        rest = F.least(F.col("x.c") - F.col("x.at"), F.col("y.c") - F.col("y.at"))
        fits = _near(F.col("x.n") + F.col("y.n"), F.greatest(F.lit(0), F.col("x.c") + F.col("y.c") - 2 * rest) + F.col("x.u") + F.col("y.u"))
        pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.e") == F.col("y.e")) & apart & fits).select(F.col("x.g").alias("g"), F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        own = lambda n: rows.select("g", F.col("node").alias(n), F.col("n").alias(f"n{n}"), (F.col("u") + F.col("c")).alias(f"d{n}"), F.col("common").alias(f"c{n}"))
        pairs = durable(pairs, "near-cross").join(own("a"), ["g", "a"]).join(own("b"), ["g", "b"])
        differ = F.col("da") + F.col("db") - 2 * F.size(F.array_intersect("ca", "cb"))
        found.append(durable(pairs.where(_near(F.col("na") + F.col("nb"), differ)).select("a", "b").distinct(), "near-found"))
        large = posts.where(F.col("k") > POSTED)
        if large.isEmpty():
            break
        large = large.select("g", "node", "marks", F.xxhash64("g", "e").alias("sub"))
        rows = large.join(rows.select("g", "node", "root", "n", "u", F.col("common").alias("edits")), ["g", "node"]).select(F.col("sub").alias("g"), "node", "root", "n", "u", "marks", "edits")
        rows = durable(rows, "near-rows")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def node_of(key: str, text: str) -> Column:
    """A document's key; a null key is replaced by a negative number drawn from the text."""
    return F.coalesce(F.col(key).cast("long"), -2 - F.pmod(F.xxhash64(text), F.lit(1 << 62)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, class_id, kept) for each row of ``docs``: the smallest key among its near duplicates, and whether it is this one's.

    Null texts and texts without words are near no other and are kept. A text of fewer than five words is one shingle. Equal texts
    share a class. Rows of one key are one document, so repeated rows share ``kept``; a null key gets a negative number from
    its text. Other columns of ``docs`` are ignored. Very long texts
    are shingled whole, a slice of a batch at a time. Ties between centres and hubs go to the smallest key. An empty table gives an empty table.
    """
    source = docs.select(node_of(key, text).alias("node"), F.col(text).alias("text"))
    hashed = source.select("node", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(41)).alias("h2"), "text")
    rows = durable(arrow_columns(hashed, "text", [T.StructField("bands", T.ArrayType(T.LongType()))], _bands_of, _forget).drop("text"), "near-rows")
    some = F.size("bands") > 0
    heads = rows.where(some).groupBy("h1", "h2").agg(F.min("node").alias("head"))
    heads = durable(heads, "near-heads")
    # one row for each different text, under its smallest key
    keys = rows.where(some).withColumnRenamed("node", "head").join(heads, ["h1", "h2", "head"]).groupBy("h1", "h2", "head").agg(F.first("bands").alias("bands"))
    buckets = keys.select(F.col("head").alias("node"), F.explode("bands").alias("bucket"))
    # tables of their own, so that the joins below may split a hot bucket
    counts = durable(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-counts")
    shared_ = durable(buckets.join(counts, "bucket"), "near-buckets")
    # the centre of a bucket is the document whose buckets hold most; ties go to the smallest key
    mass = durable(shared_.groupBy("node").agg(F.sum("n").alias("mass")), "near-mass")
    ranked = shared_.join(mass, "node").select("bucket", "node", F.struct((-F.col("mass")).alias("m"), "node").alias("rank"))
    centre = ranked.groupBy("bucket").agg(F.min("rank").alias("best")).select("bucket", F.col("best.node").alias("b"))
    met = durable(shared_.join(durable(centre, "near-centres"), "bucket"), "near-met")
    pairs = durable(met.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "near-pairs")
    measured = durable(_measure(pairs, source), "near-measured")
    links = measured.where(_similar(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b").distinct()
    classes = components(links, "near")
    # documents of different classes that meet in a bucket, and the class of its centre
    placed = met.join(classes, "node", "left").select("bucket", "node", "b", F.coalesce("root", "node").alias("root"))
    placed = durable(placed.join(classes.withColumnRenamed("node", "b").withColumnRenamed("root", "g"), "b", "left").withColumn("g", F.coalesce("g", "b")), "near-placed")
    split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    placed = durable(placed.join(durable(split, "near-split"), "bucket"), "near-apart")
    group = placed.select("g", "node").distinct().groupBy("g").agg(F.count("*").alias("m"))
    hubs = placed.select("g", "b").distinct().join(mass.withColumnRenamed("node", "b"), "b").groupBy("g").agg(F.min(F.struct((-F.col("mass")).alias("m"), "b")).alias("best")).select("g", F.col("best.b").alias("hub"))
    placed = durable(placed.join(durable(group.join(hubs, "g"), "near-hub"), "g"), "near-kinds")
    few = placed.where(F.col("m") <= FEW).join(measured.select(F.col("a").alias("node"), "b", "na", "common").distinct(), ["node", "b"], "left")
    x, y = few.alias("x"), few.alias("y")
    # what both have in common lies inside or outside of the centre
    within = F.least("x.common", "y.common") + F.least(F.col("x.na") - F.col("x.common"), F.col("y.na") - F.col("y.common"))
    able = F.coalesce(_similar(within, F.col("x.na"), F.col("y.na")), F.lit(True))
    cross = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node")) & able)
    cross = cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = durable(cross.join(known, ["a", "b"], "left_anti").distinct(), "near-cross")
    more = _measure(cross, source).where(_similar(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b").distinct()
    many = placed.where(F.col("m") > FEW).select("g", "node", "root", "hub").distinct()
    many = _edits(durable(many, "near-many"), source)
    many = durable(many.withColumn("u", F.lit(0).cast("long")).withColumn("marks", (F.col("root") == F.col("g")).cast("long")), "near-edits")
    more = durable(more if many.isEmpty() else more.union(settle(many)), "near-more")
    if not more.isEmpty():
        # classes that a link joins become one
        named = lambda n: classes.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
        joined = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        merged = components(joined, "near").select(F.col("node").alias("root"), F.col("root").alias("low"))
        # a class of one document has no row in classes yet
        every = classes.union(merged.select(F.col("root").alias("node"), "root").join(classes, "node", "left_anti"))
        classes = durable(every.join(merged, "root", "left").select("node", F.coalesce("low", "root").alias("root")), "near-classes")
    member = rows.select("node", "h1", "h2", some.alias("some")).join(heads, ["h1", "h2"], "left")
    member = member.select("node", F.when(F.col("some"), F.col("head")).otherwise(F.col("node")).alias("head"))
    found = member.join(classes.withColumnRenamed("node", "head"), "head", "left").select("node", F.coalesce("root", "head").alias("class_id"))
    return found.withColumn("kept", F.col("node") == F.col("class_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of one document of each class: that with the smallest key, once.

    See ``near_duplicates`` for null, empty and repeated rows; a kept document's repeated rows become one.
    """
    node = free_name(docs, "__node")
    kept = near_duplicates(docs, key, text).where("kept").select(F.col("node").alias(node)).distinct()
    return docs.withColumn(node, node_of(key, text)).join(kept, node, "left_semi").dropDuplicates([node]).drop(node)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("node").alias("doc_id"), "class_id", "kept")
