"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.storage import forget, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out from every fit."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int) -> DataFrame:
    """At most max_rows labelled documents outside the held-out fold, chosen by a hash of the id.

    Repeated label rows of one id count once (the smallest values), and of document rows that repeat
    an id the smallest is taken. The choice is made on the narrow label rows, so only max_rows ids
    ever meet the texts.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & (fold() != 1))
        .groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
        .dropna(subset=columns)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    picked = picked.select(F.col("doc_id").alias("label_id"), *[F.col(c).alias(f"label_{c}") for c in columns])
    # at most max_rows narrow rows: a proven bound for the broadcast
    rows = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    own = [c for c in rows.columns if c != "label_id"]
    rest = [c for c in own if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest])


def trained(sample: DataFrame, train: Callable[[pa.Table], object]):
    """train(sample) in one executor task, the sample being bounded; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(table))], pa.binary())], ["model"])

    told = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(told[0]) if told else train(None)  # no task runs over an empty table


def running(rows: DataFrame, order: str, value: str, name: str, by: list[str] | None = None, block: int = 4096) -> DataFrame:
    """rows with the sum of `value` over all rows of smaller integer `order` (of the same `by`; null equals null).

    Summed within blocks of the order and over the blocks' sums, so no task takes more than a block of rows,
    or one row for each block.
    """
    by, at = by or [], F.floor(F.col(order) / block)
    inner = Window.partitionBy(*by, "run_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run_block", at).withColumn("run_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    sums = rows.groupBy(*by, "run_block").agg(F.sum(value).alias("run_sum"))
    outer = Window.partitionBy(*by).orderBy("run_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"run_{c}") for c in by], F.col("run_block").alias("run_at"), F.coalesce(F.sum("run_sum").over(outer), F.lit(0)).alias("run_before"))
    on = F.col("run_block") == F.col("run_at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"run_{c}"))
    return rows.join(sums, on).withColumn(name, F.col("run_in") + F.col("run_before")).drop("run_block", "run_in", "run_at", "run_before", *[f"run_{c}" for c in by])


BUCKETS = 1 << 20


def _near(docs: DataFrame, ids: DataFrame, key: str, found: bool) -> DataFrame:
    """The rows of docs whose key's bucket holds an id, or holds none: told by a bitmap of BUCKETS bits, 128 KB in all."""
    names = docs.columns
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS))
    near = ids.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("near_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("near_bits"))
    rows = docs.withColumn("near_bucket", bucket).join(F.broadcast(near), F.bitmap_bucket_number("near_bucket") == F.col("near_part"), "left")
    spot = F.bitmap_bit_position("near_bucket")
    byte = F.conv(F.hex(F.substring("near_bits", F.shiftright(spot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("1") == F.floor(byte / F.pow(F.lit(2), F.pmod(spot, F.lit(8)))) % 2, F.lit(False))
    return rows.filter(hit if found else ~hit).select(*[F.col(f"`{c}`") for c in names])


def maybe_named(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key may be among ids (one column id): others stay out of later shuffles.

    What is broadcast is a bitmap of fixed size whatever the corpus.
    """
    return _near(docs, ids, key, True)


def unnamed(docs: DataFrame, ids: DataFrame, key: str = "doc_id", also: str | None = None) -> DataFrame:
    """The rows whose key (and column `also`) is not among ids (id, and `also`). Only rows of a shared bucket are shuffled."""
    sure, rest = _near(docs, ids, key, False), _near(docs, ids, key, True)
    on = F.col(key) == F.col("id")
    if also:
        ids = ids.withColumnRenamed(also, "id_also")
        on = on & (F.col(also) == F.col("id_also"))
    return sure.unionByName(rest.join(ids.hint("merge"), on, "left_anti"))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not among those taken."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Fewer rows at once for the Python workers: rows here are whole documents.

    Besides, unions are taken as dealt anyhow: Spark 4.1 can claim a partitioning for them that they lack.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
