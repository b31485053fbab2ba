"""Source mixing: targets by water filling, rates, rounding, odd inputs."""

import math

from pyspark.sql import functions as F

from quillstone.llm import mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: cap * sizes[s] for s in over}


def test_targets_match_repeated_capping(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 500, None: 40}, {"x": 7}, {"a": 0, "b": 50}, {"a": 1, "b": 1, "c": 10000}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_words(spark):
    rows = spark.createDataFrame([("a b\tc\n d",), ("",), (None,), ("  ",), ("x y z",)], "t string")
    assert [r[0] for r in rows.select(mixing.words(F.col("t"))).collect()] == [4, 0, 0, 0, 2]


def test_mix_of_documents(spark, small):
    rows = mixing.op1(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source").toPandas()
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken >= 0).all()
    both = rows.merge(docs, on="doc_id")
    for _, g in both.groupby("source"):
        assert g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g["size"].max()
    again = mixing.op1(spark, small).toPandas()
    assert sorted(map(tuple, rows.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_odd_rows(spark):
    schema = "doc_id long, n long, source string, size string, copies int"
    rows = [(1, 5, "a", "x", 7), (1, 5, "a", "x", 7), (None, 3, None, None, None), (4, 0, "b", "y", 1), (5, None, "b", None, None), (6, 100000, "a", "z", 0)]
    got = mixing.mix_sources(spark.createDataFrame(rows, schema), F.col("n"))
    out = got.collect()
    assert len(out) == 6 and {"size_", "copies_", "size", "copies"} <= set(got.columns)
    assert all(0 <= r["copies"] <= 3 for r in out) and {r["size_"] for r in out} == {"x", "y", "z", None}
    assert mixing.mix_sources(spark.createDataFrame([], schema), F.col("n")).count() == 0


def test_rates_meet_targets_exactly_on_many_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 997 + 1).alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = mixing.mix_sources(docs, F.col("n")).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("rate") * F.col("size")).alias("r"), F.sum(F.col("copies") * F.col("size")).alias("c")).collect()
    for r in got:
        assert math.isclose(r["r"], r["t"], rel_tol=1e-5) and abs(r["c"] - r["t"]) <= 1500


def test_columns_with_internal_looking_names_stay(spark):
    from quillstone.llm import licenses, sharding

    docs = spark.createDataFrame([(i, "ab"[i % 2], f"w{i} " * (i + 1), f"in{i}", i, "k") for i in range(12)], "doc_id long, source string, text string, `__in` string, `__size` int, `__key` string")
    for found in (mixing.mix_sources(docs, mixing.words(F.col("text"))), sharding.shard(docs, F.col("text"), shards=3), licenses.scan_licenses(docs)):
        rows = {r["doc_id"]: (r["__in"], r["__size"], r["__key"]) for r in found.collect()}
        assert rows == {i: (f"in{i}", i, "k") for i in range(12)}
