"""Exemplar retrieval: exact nearest neighbours in blocks, the vote that may abstain, and lexical retrieval by postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in a block of queries and of memory.
QUERY_BLOCK, MEMORY_BLOCK = 512, 8192
#: Rows of queries and of memory that meet in a task of lexical retrieval, and those of both that are compared at a time.
LEXICAL_QUERIES, LEXICAL_MEMORY, LEXICAL_STEP, LEXICAL_CHUNK = 8192, 8192, 1024, 128
#: Where all rows ask all rows: rows of a block, blocks of a domain of some size at least, rows compared at a time, pairs held at a time, share of
#: rows from which a token is counted by a matrix product, most of such tokens, and rows for each row that a token must have to get a number.
EACH_BLOCK, EACH_CUTS, EACH_STEP, EACH_HELD, EACH_DENSE, EACH_TOKENS, EACH_ROWS = 12288, 4, 256, 2_000_000, 0.05, 1024, 200_000
#: Similarity below which a memory row is no neighbour, fewest neighbours of a vote, and the cap of a confidence.
MIN_SIMILARITY, MIN_NEIGHBOURS, CAP = 0.70, 3, 0.95
# Stop words of lexical profiles.
PROFILES = {
    "exact": (),
    "fr-en": tuple(
        "a an the this that these those of to for in on at with by and i me my you your we our he his she her it its they their "
        "is are was were be been how what which can do does "
        "le la les l un une des du de d et en pour avec sur dans au aux à je j tu nous vous il elle ils elles ce cet cette ces est sont "
        "comment quel quelle quels quelles moi me mon ma mes ton ta tes son sa ses votre vos".split()
    ),
}


def nearest(queries: DataFrame, memory: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, rank, id, d2): the ``k`` rows of ``memory`` nearest to each query with the same key.

    Both sides are (id, key, v): integers of at most 2 ** 28 in ``width`` places; a null key meets nothing. d2 is the squared distance,
    exact; ties go to the smaller id; a query never finds its own id. Blocks of bounded size meet inside a key: the blocks of queries
    are repeated for every block of memory and joined by key and block, so a hot key is spread over as many
    tasks as it has blocks, and no pair is written out: a task returns its k best for each query.
    """

    def blocks(side: DataFrame, size: int) -> DataFrame:
        counts = side.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("cuts"))
        return side.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts").cast("long")).cast("int"))

    def pack(side: DataFrame, size: int, tag: str) -> DataFrame:
        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"key": [key[0]], "block": [key[1]], f"{tag}ids": [rows["id"].to_numpy(np.int64).tobytes()], f"{tag}x": [np.stack(rows["v"].to_numpy()).astype(np.int64).tobytes()]})

        return blocks(side.where(F.col("key").isNotNull()), size).groupBy("key", "block").applyInPandas(one, f"key string, block int, {tag}ids binary, {tag}x binary")

    def best(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                qi, q = np.frombuffer(r.qids, np.int64), np.frombuffer(r.qx, np.int64).reshape(-1, width)
                mi, m = np.frombuffer(r.mids, np.int64), np.frombuffer(r.mx, np.int64).reshape(-1, width)
                d2 = (q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * (q @ m.T)
                d2 = np.where(qi[:, None] == mi[None, :], np.iinfo(np.int64).max, d2)
                order = np.lexsort((np.broadcast_to(mi, d2.shape), d2), axis=1)[:, :k]
                near = np.take_along_axis(d2, order, 1)
                keep = near < np.iinfo(np.int64).max
                yield pd.DataFrame({"query_id": np.repeat(qi, order.shape[1])[keep.ravel()], "id": mi[order].ravel()[keep.ravel()], "d2": near.ravel()[keep.ravel()]})

    memory = memory.select("id", F.col("key").cast("string").alias("key"), "v")
    m = pack(memory, MEMORY_BLOCK, "m")
    cuts = memory.where(F.col("key").isNotNull()).groupBy("key").agg(F.ceil(F.count("*") / MEMORY_BLOCK).cast("int").alias("cuts"))
    q = pack(queries.select("id", F.col("key").cast("string").alias("key"), "v"), QUERY_BLOCK, "q").drop("block").join(cuts, "key")
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    found = q.join(m, ["key", "block"]).select("qids", "qx", "mids", "mx").mapInPandas(best, "query_id long, id long, d2 long")
    order = Window.partitionBy("query_id").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "d2")


def vote(neighbours: DataFrame, memory: DataFrame, queries: DataFrame, features: int, scale: float, minimum: float = MIN_SIMILARITY, fewest: int = MIN_NEIGHBOURS, cap: float = CAP) -> DataFrame:
    """(query_id, status, reason, label, neighbours, confidence): a label if enough similar neighbours agree, else an abstention.

    ``memory`` is (id, label), ``queries`` (query_id). Neighbours below ``minimum`` don't count; fewer than ``fewest`` abstain with
    too_few_similar, different labels with mixed_labels. Confidence is the mean similarity in millionths, capped; 0 when abstaining.
    """
    sim = F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(F.col("d2").cast("double")) / F.lit(scale * features**0.5))
    near = neighbours.withColumn("sim", F.floor(sim * 1_000_000).cast("long")).where(F.col("sim") >= int(minimum * 1_000_000)).join(memory, "id")
    per = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("top"), F.sum("sim").alias("total"))
    all_ = queries.select("query_id").join(per, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("n") < fewest, "too_few_similar").when(F.col("low") != F.col("top"), "mixed_labels")
    sure = F.least(F.lit(int(cap * 1_000_000)).cast("long"), F.expr("total div n"))
    return all_.withColumn("reason", reason).select(
        "query_id", F.when(F.col("reason").isNull(), "suggest").otherwise("abstain").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.when(F.col("reason").isNull(), F.col("low")).alias("label"), F.col("n").alias("neighbours"), F.when(F.col("reason").isNull(), sure).otherwise(F.lit(0).cast("long")).alias("confidence"),
    )


def tokens(text: Column) -> Column:
    """Different words of letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def content(words: Column, profile: str = "exact") -> Column:
    """``words`` without the stop words of a profile; unknown profiles are refused. A row that is left without words makes no candidates."""
    if profile not in PROFILES:
        raise ValueError(f"lexical profile must be one of {', '.join(PROFILES)}")
    return F.array_except(words, F.array(*map(F.lit, PROFILES[profile]))) if PROFILES[profile] else words


def lexical(queries: DataFrame, memory: DataFrame, k: int = 5, num: int = 34, den: int = 100) -> DataFrame:
    """(query_id, rank, id, sim, score): the best ``k`` of ``memory`` by Jaccard similarity of at least num/den times a weight.

    Both sides are (id, domain, tokens), memory also weight (in thousandths); the tokens of a row are different. sim and score are
    integers in millionths; order is by score, sim, then id. A row never finds itself, and a null domain meets nothing.

    Prefixes of rare tokens are no help where common words alone reach the similarity: they would look up nearly all tokens and write out nearly all
    pairs. Instead blocks of bounded numbers of rows meet inside a domain, a task counts the shared tokens of all its pairs in memory and returns
    its k best for each query. Every pair is compared, but for those that sizes and weights alone keep out of a query's k best.
    """

    def side(rows: DataFrame, *more: str) -> DataFrame:
        # one string is a third of the shuffled bytes of an array; the signs that part tokens are escaped in them, so equal tokens stay equal and others different
        plain = lambda t: F.coalesce(F.replace(F.replace(t, F.lit("\x01"), F.lit("\x01a")), F.lit("\x00"), F.lit("\x01b")), F.lit("\x01n"))
        found = rows.where(F.col("domain").isNotNull() & (F.size("tokens") > 0))
        return found.select("id", F.col("domain").cast("string").alias("domain"), F.size("tokens").alias("size"), F.array_join(F.transform("tokens", plain), "\x00").alias("words"), *more)

    def cuts(rows: DataFrame, size: int, out: str) -> DataFrame:
        return F.broadcast(rows.where(F.col("domain").isNotNull()).groupBy(F.col("domain").cast("string").alias("domain")).agg(F.ceil(F.count("*") / size).cast("int").alias(out)))  # one row for each domain

    # each side's rows go to their own block, once for every block of the other side
    both = cuts(memory, LEXICAL_MEMORY, "m").join(cuts(queries, LEXICAL_QUERIES, "q"), "domain")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = side(memory, F.col("weight").cast("long").alias("weight")).join(F.broadcast(both), "domain").withColumn("mb", dealt("m")).withColumn("qb", every("q")).drop("m", "q")
    q = side(queries).join(F.broadcast(both), "domain").withColumn("qb", dealt("q")).withColumn("mb", every("m")).drop("m", "q")
    q = q.select(*[F.col(n).alias(f"q_{n}") for n in q.columns])  # both sides may come from the same rows
    keys = ["domain", "mb", "qb"]
    found = q.groupBy(*[f"q_{n}" for n in keys]).cogroup(m.groupBy(*keys)).applyInArrow(lambda asks, has: _lexical_best(asks, has, k, num, den), "query_id long, id long, sim long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "sim", "score")


def _lexical_best(asks: pa.Table, has: pa.Table, k: int, num: int, den: int) -> pa.Table:
    """The ``k`` best rows of ``has`` (id, size, words, weight) for each of ``asks`` (q_id, q_size, q_words)."""
    names = ("query_id", "id", "sim", "score")
    out: list[tuple[np.ndarray, ...]] = []
    if asks.num_rows and has.num_rows:
        # heavy rows first: what they reach rules out light ones
        has, asks = has.sort_by([("weight", "descending"), ("size", "ascending")]), asks.sort_by("q_size")
        size, weight, ids = (has[n].to_numpy().astype(np.int64) for n in ("size", "weight", "id"))
        words = pc.split_pattern(has["words"].combine_chunks(), "\x00")
        coded = words.flatten().dictionary_encode()
        starts, codes = words.offsets.to_numpy() - words.offsets[0].as_py(), coded.indices.to_numpy()
        for at in range(0, asks.num_rows, LEXICAL_STEP):
            out += _lexical_step(asks.slice(at, LEXICAL_STEP), coded.dictionary, ids, size, weight, starts, codes, k, num, den)
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))


def _lexical_step(asks: pa.Table, known: pa.Array, ids: np.ndarray, size: np.ndarray, weight: np.ndarray, starts: np.ndarray, codes: np.ndarray, k: int, num: int, den: int) -> list[tuple[np.ndarray, ...]]:
    q_id, q_size = (asks[n].to_numpy().astype(np.int64) for n in ("q_id", "q_size"))
    words = pc.split_pattern(asks["q_words"].combine_chunks(), "\x00")
    code = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy()
    owner = np.repeat(np.arange(len(q_id)), np.diff(words.offsets.to_numpy()))[code >= 0]
    used, place = np.unique(code[code >= 0], return_inverse=True)
    row_of = np.full(len(known), -1, np.int32)
    row_of[used] = np.arange(len(used), dtype=np.int32)
    bits = np.zeros((len(used), len(q_id)), np.uint8)  # a row for each token, a column for each query
    bits[place, owner] = 1
    best = [np.zeros((len(q_id), 0), np.int64)] * 3  # score, sim and id, in order
    floor = np.full(len(q_id), -1, np.int64)
    asked = np.arange(len(q_id))
    width = 0
    held: list[tuple[np.ndarray, ...]] = []
    least, most = q_size.min(), q_size.max()
    done: list[tuple[np.ndarray, ...]] = []

    def settle() -> None:
        """Keeps the k best of each query, and its k-th score as what others must reach."""
        nonlocal held
        if not held:
            return
        a, s, v, i = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((i, -v, -s, a))
        a, s, v, i = a[order], s[order], v[order], i[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < k
        held = [(a[keep], s[keep], v[keep], i[keep])]
        last = rank == k - 1
        floor[a[last]] = s[last]

    pending = 0
    for lo in range(0, len(ids), LEXICAL_CHUNK):
        hi = min(len(ids), lo + LEXICAL_CHUNK)
        top = weight[lo] * 1000  # the greatest score times den of all in this chunk and after it
        live = np.flatnonzero(floor[asked] <= top * 1000)
        if not len(live):
            break
        if len(live) * 4 <= len(asked) * 3:
            asked, bits = asked[live], np.ascontiguousarray(bits[:, live])
            least, most = q_size[asked].min(), q_size[asked].max()
        rows = np.flatnonzero((size[lo:hi] * den >= least * num) & (size[lo:hi] * num <= most * den)) + lo
        if not len(rows):
            continue
        shared = np.zeros((len(rows), len(asked)), np.int64)
        for n, r in enumerate(rows):
            at = row_of[codes[starts[r] : starts[r + 1]]]
            at = at[at >= 0]
            for x in range(0, len(at), 255):  # so many ones fit eight bits
                shared[n] += np.add.reduce(bits[at[x : x + 255]], axis=0, dtype=np.uint8)
        every = size[rows][:, None] + q_size[asked][None, :] - shared
        fine = (shared * den >= every * num) & (shared > 0)
        i, j = np.nonzero(fine)
        s, e, w, a = shared[i, j], every[i, j], weight[rows[i]], asked[j]
        score = s * 1000 * w // e
        keep = (score >= floor[a]) & (ids[rows[i]] != q_id[a])
        held.append((a[keep], score[keep], (s * 1_000_000 // e)[keep], ids[rows[i]][keep]))
        pending += int(keep.sum())
        if pending > 4 * k * len(q_id):
            settle()
            pending = 0
    settle()
    for a, s, v, i in held:
        done.append((q_id[a], i, v, s))
    return done


def lexical_each(rows: DataFrame, weights: DataFrame, usual: int, k: int = 5, num: int = 34, den: int = 100) -> DataFrame:
    """What ``lexical`` finds when every row asks all rows: (query_id, rank, id, sim, score).

    ``rows`` is (id, domain, tokens), the tokens of a row different and not null; ``weights`` (id, weight), where rows without one weigh ``usual``; a null
    id meets nothing. Blocks of a domain meet once for both directions, so a row goes to as many tasks as its domain has blocks, as the
    numbers of its tokens in a few hundred bytes. All pairs whose sizes allow the similarity are counted exactly: common tokens by a
    product of matrices, the others by their postings. The numbered tokens come to the driver: those of 2 rows and more, or on large
    tables of one row in EACH_ROWS; others travel as they are, and a token of one row only counts in its size.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("domain").isNotNull()).select("id", F.col("domain").cast("string").alias("domain"), "tokens")
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"))  # with rows of no tokens, so that no text is read for it
    least = max(2, (counts.agg(F.sum("n")).first()[0] or 0) // EACH_ROWS)
    known = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least).toArrow()
    known = known.sort_by([("n", "descending")])["token"].combine_chunks()
    packed = rows.where(F.size("tokens") > 0).select("id", "domain", F.size("tokens").alias("size"), "tokens").mapInArrow(lambda batches: _lexical_pack(batches, known, least > 2), "id long, domain string, size int, codes binary, other array<string>")
    few = F.least(F.lit(EACH_CUTS), F.ceil(F.col("n") / 512))
    cuts = F.broadcast(counts.select("domain", F.greatest(F.ceil(F.col("n") / EACH_BLOCK), few).cast("int").alias("cuts")))  # one row for each domain
    dealt = packed.join(weights.select("id", F.col("weight").cast("long").alias("weight")), "id", "left").withColumn("weight", F.coalesce("weight", F.lit(usual).cast("long"))).join(cuts, "domain")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts").cast("long")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    meet = dealt.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("cuts", "with")
    found = meet.groupBy("domain", "low", "high").applyInArrow(lambda key, both: _lexical_meet(both, key[1].as_py(), key[2].as_py(), k, num, den), "query_id long, id long, sim long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "sim", "score")


def _lexical_pack(batches, known: pa.Array, others: bool):
    """Tokens as their places in ``known``: sorted differences in bytes of seven bits, the last of each with its high bit clear."""
    for batch in batches:
        lists = batch.column("tokens")
        code = pc.index_in(lists.flatten(), value_set=known)
        there = np.asarray(pc.is_valid(code))
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = np.sort((owner[there] << 32) + pc.drop_null(code).to_numpy())
        row, value = at >> 32, at & 0xFFFFFFFF
        step = np.diff(value, prepend=0)
        first = np.diff(row, prepend=-1) > 0
        step[first] = value[first]
        wide = 1 + sum((step >> (7 * n) > 0).astype(np.int64) for n in range(1, 5))
        ends = np.cumsum(wide)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        for n in range(5):
            has = wide > n
            out[(ends - wide)[has] + n] = (step[has] >> (7 * n) & 127) | np.where(wide[has] > n + 1, 128, 0)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, wide, len(lists)))]).astype(np.int32)
        codes = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        rest = np.concatenate([[0], np.cumsum(np.bincount(owner[~there], minlength=len(lists)))]) if others else np.zeros(len(lists) + 1)
        other = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), lists.flatten().filter(pa.array(~there)) if others else pa.array([], pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("domain"), batch.column("size"), codes, other], ["id", "domain", "size", "codes", "other"])


def _lexical_unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The row and the number of each token that ``_lexical_pack`` has written; what travelled as it is gets numbers after all others."""
    row, code = [], []
    at = 0
    for chunk in rows["codes"].chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        ends = np.flatnonzero(raw < 128) + 1
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        value = np.zeros(len(ends), np.int64)
        for n in range(int((ends - starts).max(initial=0))):
            has = starts + n < ends
            value[has] |= (raw[starts[has] + n] & 127).astype(np.int64) << (7 * n)
        edges = np.searchsorted(starts, offsets - offsets[0])
        owner = np.repeat(np.arange(len(chunk)), np.diff(edges))
        total = np.concatenate([[0], np.cumsum(value)])
        row.append((owner + at).astype(np.int32))
        code.append((total[1:] - total[edges[owner]]).astype(np.int32))
        at += len(chunk)
    row, code = np.concatenate(row), np.concatenate(code)
    other = pa.chunked_array(rows["other"].chunks, pa.list_(pa.string())).combine_chunks()
    if len(flat := other.flatten()):
        row = np.concatenate([row, np.repeat(np.arange(len(other), dtype=np.int32), pc.list_value_length(other).to_numpy())])
        code = np.concatenate([code, flat.dictionary_encode().indices.to_numpy() + code.max(initial=-1) + 1])
    return row, code


def _lexical_meet(both: pa.Table, low: int, high: int, k: int, num: int, den: int) -> pa.Table:
    """The ``k`` best of block ``high`` for each row of block ``low``, and the other way round; (id, size, weight, block, codes, other)."""
    row, code = _lexical_unpack(both)
    ids, size, weight, block = (both[n].to_numpy().astype(np.int64) for n in ("id", "size", "weight", "block"))
    many = int(code.max(initial=-1)) + 1

    def side(of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a block by size, and the place of the row and the number of each of their tokens."""
        own = np.flatnonzero(block == of)
        own = own[np.argsort(size[own], kind="stable")]
        place = np.full(len(ids), -1, np.int32)
        place[own] = np.arange(len(own), dtype=np.int32)
        at = place[row]
        here = at >= 0
        return own, at[here], code[here]

    a, a_row, a_code = side(low)
    b, b_row, b_code = side(high)
    del row, code
    found: list[list[tuple[np.ndarray, ...]]] = [[], []]
    if len(a) and len(b):
        a_n, b_n = np.bincount(a_code, minlength=many), np.bincount(b_code, minlength=many)
        meets = a_n.astype(np.float64) * b_n
        dense = np.argsort(-meets, kind="stable")[:EACH_TOKENS]
        dense = dense[meets[dense] > EACH_DENSE**2 * len(a) * len(b)]
        column = np.full(many, -1, np.int32)
        column[dense] = np.arange(len(dense), dtype=np.int32)
        # shared tokens beyond the sum of both rows' least: whole numbers below 2 ** 24, so exact
        a_least, b_least = (size[x] * num // (num + den) for x in (a, b))

        def matrix(n: int, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
            m = np.zeros((n, len(dense) + 2), np.float32)
            of = column[codes]
            m[at[of >= 0], of[of >= 0]] = 1
            return m

        def by(first: np.ndarray, then: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            both = np.sort((first[keep].astype(np.int64) << 32) + then[keep])
            return both >> 32, (both & 0xFFFFFFFF).astype(np.int32)

        a_m, b_m = matrix(len(a), a_row, a_code), matrix(len(b), b_row, b_code)
        a_m[:, -2], a_m[:, -1], b_m[:, -2], b_m[:, -1] = -a_least, 1, 1, -b_least
        rare = (column < 0) & (a_n > 0) & (b_n > 0)
        posted = by(b_code, b_row, rare[b_code])[1]
        starts = np.concatenate([[0], np.cumsum(np.where(rare, b_n, 0))])
        asking, a_rare = by(a_row, a_code, rare[a_code])
        a_starts = np.searchsorted(asking, np.arange(len(a) + 1))
        del asking, a_row, a_code, b_row, b_code
        steps, one = np.arange(len(posted)), np.float32(1)
        held, pending = [], 0

        def settle() -> None:
            """Keeps the k best of what is held, both ways where the blocks are two."""
            i, j, shared, every = (np.concatenate(x) for x in zip(*held, strict=True))
            for n, (asks, has) in enumerate([(i, j), (j, i)][: 1 + (low != high)]):
                more = (asks, shared * 1000 * weight[has] // every, shared * 1_000_000 // every, ids[has])
                found[n] = [_lexical_first(*map(np.concatenate, zip(*found[n], more, strict=True)), k)]
            held.clear()

        for at in range(0, len(a), EACH_STEP):
            to = min(len(a), at + EACH_STEP)
            lo = np.searchsorted(size[b], -(-size[a[at]] * num // den))
            hi = np.searchsorted(size[b], size[a[to - 1]] * den // num, "right")
            if lo >= hi:
                continue
            over = np.full((to - at, len(b)), -1, np.float32)
            np.matmul(a_m[at:to], b_m[lo:hi].T, out=over[:, lo:hi])
            for n in range(at, to):
                t = a_rare[a_starts[n] : a_starts[n + 1]]
                first, count = starts[t], starts[t + 1] - starts[t]
                if total := int(count.sum()):
                    which = steps[:total] + np.repeat(first - np.cumsum(count) + count, count)
                    np.add.at(over[n - at], posted[which], one)
            over = over[:, lo:hi]
            i, j = np.divmod(np.flatnonzero(over >= 0), hi - lo)
            shared = over[i, j].astype(np.int64)
            i, j = i + at, j + lo
            shared += a_least[i] + b_least[j]
            every = size[a[i]] + size[b[j]] - shared
            fine = (shared * den >= every * num) & (shared > 0) & (ids[a[i]] != ids[b[j]])
            held.append((a[i[fine]], b[j[fine]], shared[fine], every[fine]))
            pending += int(fine.sum())
            if pending > EACH_HELD:
                settle()
                pending = 0
        if held:
            settle()
    columns = [np.concatenate(x) for x in zip(*found[0], *found[1], strict=True)] or [np.zeros(0, np.int64)] * 4
    return pa.table({"query_id": ids[columns[0]], "id": columns[3], "sim": columns[2], "score": columns[1]})


def _lexical_first(asks: np.ndarray, score: np.ndarray, sim: np.ndarray, has: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` first of each asking row by score, sim and id."""
    order = np.lexsort((has, -sim, -score, asks))
    asks = asks[order]
    keep = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
    return asks[keep], score[order][keep], sim[order][keep], has[order][keep]


def lexical_verdict(found: DataFrame, queries: DataFrame, fewest: int = 2, cap: int = 950_000) -> DataFrame:
    """(query_id, status, reason, top_id, neighbours, confidence): the first match, or an abstention if fewer than ``fewest`` are found."""
    per = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("id", "rank").alias("top"), F.max("sim").alias("sim"))
    all_ = queries.select(F.col("id").alias("query_id")).join(per, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = F.col("n") >= fewest
    reason = F.when(F.col("n") == 0, "no_similar_memories").when(~ok, "too_few_similar_memories").otherwise("")
    return all_.select("query_id", F.when(ok, "suggest").otherwise("abstain").alias("status"), reason.alias("reason"), F.when(ok, F.col("top")).alias("top_id"), F.col("n").alias("neighbours"), F.when(ok, F.least(F.lit(cap).cast("long"), F.col("sim"))).otherwise(F.lit(0).cast("long")).alias("confidence"))


def edit_neighbours(queries: DataFrame, memory: DataFrame, k: int = 3) -> DataFrame:
    """(query, rank, form, distance, sim): the forms of the same family nearest in edit distance; both sides are (form, family), without repeats.

    sim is one minus the distance over the longer length, in millionths. A form isn't its own neighbour.
    """
    pairs = queries.select(F.col("form").alias("query"), "family").join(memory.select("form", "family"), "family").where("query <> form")
    pairs = pairs.withColumn("distance", F.levenshtein("query", "form"))
    longest = F.greatest(F.length("query"), F.length("form"))
    pairs = pairs.withColumn("sim", F.expr("1000000L") - F.floor(F.col("distance") * F.lit(1_000_000).cast("long") / longest))
    order = Window.partitionBy("query").orderBy("distance", "form")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "form", "distance", F.col("sim").cast("long").alias("sim"))


def hamming_neighbours(queries: DataFrame, gallery: DataFrame, bits: int = 64, most: int = 3) -> DataFrame:
    """(query_id, id, distance, verdict): gallery hashes within ``most`` bits of a query's; both sides are (id, hash).

    Hashes are cut into ``most`` + 1 bands: two that differ in at most ``most`` bits are equal in one of them, so an equi-join finds all.
    """
    bands = most + 1
    width = -(-bits // bands)
    band = lambda i: F.call_function("shiftrightunsigned", "hash", F.lit(i * width)).bitwiseAND(F.lit((1 << width) - 1))
    cut = lambda side: side.withColumn("band", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), band(i).alias("v")) for i in range(bands)])))
    q = cut(queries).select(F.col("id").alias("query_id"), F.col("hash").alias("qh"), "band")
    pairs = q.join(cut(gallery), "band").where("query_id <> id").select("query_id", "id", F.bit_count(F.col("qh").bitwiseXOR(F.col("hash"))).alias("distance")).where(F.col("distance") <= most).distinct()
    return pairs.withColumn("verdict", F.when(F.col("distance") <= 3, "duplicate").otherwise("similar"))
