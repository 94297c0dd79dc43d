"""Sharding by a two-pass external shuffle, with DataFrame operations only.

Pass 1 scatters the records uniformly over buckets by a seeded hash of their content; the number of
buckets follows both the rows and the bytes, so that a bucket fits in memory.  Pass 2 numbers the records
of each bucket in an order of its own (so that the order in which records arrive does not matter; Spark's
sort spills if it must) and applies a seeded Fisher-Yates shuffle to the numbers (Spark's
shuffle(array, seed)): no array ever holds a record.  Buckets follow each other; their offsets come from a
two-level running sum of the bucket sizes, so no task sees more than a few thousand of them.  The record at
global place g goes to shard g mod n, slot g div n: the law is `rows`, shard sizes differ by one at most,
and slots have no gaps.

Defined results: rows are kept as they are, repeated rows and nulls in any column included (rows that are
equal in every column share a bucket); an empty table gives an empty result.  Clashing input columns (size,
text_crc32, law, shard, slot, grown_shard, in upper or lower case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, col, held, others, released

#: Rows and bytes of text of a bucket on average, and buckets summed up in one group of the running sum.
BUCKET_ROWS = 2048
BUCKET_BYTES = 1 << 25
GROUP_BUCKETS = 2048
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def external_shuffle(
    df: DataFrame, *, seed: int = 20240607, shards: int = 8, text_col: str = "text", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Every row of df, with size, text_crc32, law, shard, slot and grown_shard."""
    spark = df.sparkSession
    kept = others(df, ADDED)
    text = F.coalesce(col(text_col), F.lit(""))
    measured = df.select(
        held(kept),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), *[col(c) for c in kept if c.lower() != text_col.lower()], F.crc32(F.encode(text, "UTF-8"))).alias("key"),
    )
    rows, size = df.select((F.octet_length(text) + 1).cast("long").alias("size")).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = max(1, -(-rows // bucket_rows), -(-size // bucket_bytes))
    scattered = measured.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(n_buckets)))
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    sums = counts.groupBy("group").agg(F.sum("n").alias("n"))
    before_group = sums.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("group_before"))
    before = counts.select("bucket", "group", "n", (F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")).alias("within"))
    offsets = before.join(before_group, "group").select("bucket", "n", (F.col("within") + F.col("group_before")).alias("before"))

    # A number of partitions of our own: the seed of shuffle() counts on the partition's index.
    tasks = max(1, min(n_buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_buckets // 64)))
    orders = (
        offsets.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .select("bucket", "before", F.shuffle(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(seed)).alias("order"))
    )
    numbered = scattered.repartition(tasks, "bucket").withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("key", "size")))
    placed = numbered.join(orders.hint("shuffle_hash"), "bucket")
    place = F.col("before") + F.element_at("order", F.col("at")) - 1
    return placed.select(
        *released(kept, F.col(ROW)),
        F.col("size"),
        F.col("text_crc32"),
        F.lit("rows").alias("law"),
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, *, seed: int = 20240607, shards: int = 8) -> None:
    """The shuffled records as Parquet files, a folder for each shard, in slot order."""
    out = external_shuffle(df, seed=seed, shards=shards)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
