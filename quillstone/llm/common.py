"""What the operators of this subpackage share: shared storage, scans, prefix sums, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a folder of this machine, but for local sessions only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir() + "/quillstone-checkpoints"


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``durable`` has written in this process, once no result that reads them is needed; their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores if a column of ``df`` already bears it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns that bear one of ``names`` renamed by underscores, so that results can take those names."""
    for c in df.columns:
        if c.lower() in names:
            df = df.withColumnRenamed(c, free_name(df, c + "_"))
    return df


def running_sum(df: DataFrame, part: list[str], order: list[str | Column], value: Column, out: str, salt: Column, salts: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``part`` that come before, this row excluded.

    Rows are ordered by ``salt`` (an integer expression from 0 to ``salts`` - 1), then ``order``. No task gets a
    whole ``part``: a first pass sums each (part, salt), a second accumulates those few sums, and the rows are
    then scanned within their salt only.
    """
    s, v, base, within = (free_name(df, n) for n in ("__salt", "__value", "__base", "__in"))
    rows = df.withColumn(s, salt.cast("int")).withColumn(v, value)
    sums = rows.groupBy(*part, s).agg(F.sum(v).alias(base))
    before = Window.partitionBy(*part).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inner = Window.partitionBy(*part, s).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(within, F.coalesce(F.sum(v).over(inner), F.lit(0)))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*part, s]]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    joined = rows.alias("r").join(sums.alias("b"), cond)
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col(f"r.{within}") + F.col(f"b.{base}")).alias(out))


def components(edges: DataFrame, name: str, kind: str = "bigint") -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b), by distributed contraction.

    Each round sends every node the smallest label around it and then replaces labels by their own label
    (pointer jumping), so rounds grow with the logarithm of the diameter. A round is two joins and one written
    table; nothing but one count reaches the driver. Null ends are ignored.
    """
    edges = edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a is not null and b is not null and a <> b")
    both = durable(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        best = labels.join(near, "node").select("node", F.least("root", "low").alias("new"), "root")
        # the node that was this one's label follows it to the new, smaller label
        pull = best.where("new < root").groupBy(F.col("root").alias("node")).agg(F.min("new").alias("hook"))
        step = best.join(pull, "node", "left").select("node", F.least("new", F.coalesce("hook", "new")).alias("new"), "root")
        step = durable(step, f"{name}-step")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        labels = durable(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("root"), F.col("root").alias("was")), f"{name}-labels")
        if labels.where("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def give_back() -> None:
    """Returns freed memory to the system at the end of a partition: a worker goes on to other stages, and its heap would keep their sum."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


#: Bytes of a batch that a worker looks at together, so that what it makes of them stays small.
SLICE = 4_000_000


def arrow_columns(docs: DataFrame, column: str, fields: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]], done: Callable[[], None] | None = None) -> DataFrame:
    """``docs`` with ``fields`` appended, made from ``column`` slice by slice in Python workers; no shuffle.

    Columns that bear the names of ``fields`` are renamed by underscores. ``done`` runs at the end of a partition, to let go of what
    a worker, which other stages use after this one, has kept.
    """
    given = free_name(docs, "__in")
    docs = docs.withColumn(given, F.col(column))
    docs = make_room(docs, *[f.name for f in fields])
    names = [c for c in docs.columns if c != given]
    schema = T.StructType([*[docs.schema[c] for c in names], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *work(part.column(len(names)))], names=[*names, *(f.name for f in fields)])
        if done is not None:
            done()
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in names], given).mapInArrow(run, schema)


def sample_by_group(docs: DataFrame, group: str, key: str, most: int, where: Column) -> DataFrame:
    """About ``most`` rows for each value of ``group``, or all if there are fewer; ``where`` limits the rows.

    Rows are drawn by their hashed ``key`` at the rate that the group's count asks for, so no rows are gathered or ordered. Rows
    of one key are taken or left together.
    """
    draw = F.call_function("shiftrightunsigned", F.xxhash64(F.col(key).cast("string"), F.lit(29)), F.lit(11)) / F.lit(2.0**53)
    g, n = free_name(docs, "__g"), free_name(docs, "__n")
    rows = docs.where(where)
    counts = rows.groupBy(F.col(group).alias(g)).agg(F.count("*").alias(n))
    # one row for each value of a label, so the sample is drawn where the rows are
    return rows.join(F.broadcast(counts), F.col(group) == F.col(g)).where(draw * F.col(n) < most).drop(g, n)


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])
