"""Two-pass external shuffle into shards of equal row counts.

First pass: a seeded hash of the row scatters the records uniformly into buckets of about `bucket_bytes`, so
that each fits in memory. Second pass: each bucket is put in the order of its hashes and then shuffled by
Fisher-Yates with a generator seeded by (seed, bucket). Bucket offsets place it in the global order, shard s
holds a contiguous share of that order, and the shards are written as Parquet.

The law is `rows`: shard sizes differ by one row at most. The result depends on the rows and the seed, not on
partitions or the order of input (but for two different rows of one 64-bit hash). Null ids and null texts are records
like others; repeated rows are kept, and between rows that are equal in every column either order is the same result.
Equal rows have equal hashes; where those of one row alone would overfill a bucket, each copy gets a hash of its own
(`_spread`), so a bucket holds about its size whatever is repeated, and a text larger than that stands alone. (A
table with a column of maps, which Spark can't group by, isn't spread.) An empty table gives no rows. A column named
like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewright.llm.common import dealt, fresh_path, written

SHARDS, SEED, BUCKET_BYTES = 16, 20_240_229, 8 << 20
#: Bucket offsets are two longs each; up to so many (32 MB) they are broadcast, beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20
MADE = ("law", "shard", "slot")
#: Copies of a hot row that one row deals out again.
DEALT = 100_000


def _shuffled(seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(bucket: pa.Table) -> pa.Table:
        order = bucket.column("_bw_key").to_numpy().argsort(kind="stable")
        number = bucket.column("_bw_bucket")[0].as_py() if bucket.num_rows else 0
        np.random.Generator(np.random.PCG64([seed, number])).shuffle(order)  # Fisher-Yates
        return bucket.take(order).append_column("_bw_at", pa.array(np.arange(len(order)), pa.int64()))

    return run


def _spread(keyed: DataFrame, counts: DataFrame, seed: int, buckets: int, bucket_bytes: int) -> DataFrame:
    """keyed with new keys for rows whose copies alone fill a bucket: each copy gets one of its own.

    Copies of a row are put together to one row and their number (pre-aggregated for each task), and dealt out again
    by the number among them, so the keys don't depend on where the copies stood. Only the rows of buckets far beyond
    their size are looked at.
    """
    large = counts.where(F.col("_bw_bytes") > 4 * bucket_bytes).select("_bw_bucket")  # a share of the buckets
    if not large.limit(1).count():
        return keyed
    sizes = keyed.join(F.broadcast(large), "_bw_bucket", "left_semi").groupBy("_bw_key").agg(F.sum("_bw_size").alias("bytes"))
    hot = written(sizes.where(F.col("bytes") > bucket_bytes).select("_bw_key"), "hot")  # less than one for each bucket
    same = keyed.join(F.broadcast(hot), "_bw_key", "left_semi")
    once = same.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_bw_many"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_bw_many - 1) div {DEALT}")))
    many = once.withColumn("_bw_part", parts).repartition("_bw_key", "_bw_part")
    number = F.explode(F.sequence(F.col("_bw_part") * DEALT, F.least(F.col("_bw_part") * DEALT + DEALT, F.col("_bw_many")) - 1))
    again = many.withColumn("_bw_number", number).withColumn("_bw_key", F.xxhash64(F.lit(seed), "_bw_key", "_bw_number"))
    again = again.withColumn("_bw_bucket", F.pmod("_bw_key", F.lit(buckets)))
    return keyed.join(F.broadcast(hot), "_bw_key", "left_anti").select(*keyed.columns).unionByName(again.select(*keyed.columns))


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """docs with `law` string, `shard` int and `slot` long, rows of a bucket in shuffled order."""
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    kept = [c for c in docs.columns if c not in MADE]
    rows = docs.select(*kept)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    total = total or 0
    buckets = max(1, -(-total // bucket_bytes))
    hashable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    keyed = rows.withColumn("_bw_size", size).withColumn("_bw_key", F.xxhash64(F.lit(seed), *hashable)).withColumn("_bw_bucket", F.pmod("_bw_key", F.lit(buckets)))
    count = lambda df: df.groupBy("_bw_bucket").agg(F.count(F.lit(1)).alias("_bw_n"), F.sum("_bw_size").alias("_bw_bytes"))
    counts = written(count(keyed), "buckets")
    if len(hashable) == len(kept):
        spread = _spread(keyed, counts, seed, buckets, bucket_bytes)
        keyed, counts = spread, counts if spread is keyed else written(count(spread), "buckets")
    keyed = keyed.drop("_bw_size")
    schema = T.StructType([*keyed.schema.fields, T.StructField("_bw_at", T.LongType())])
    placed = dealt(keyed, total, "_bw_bucket").groupBy("_bw_bucket").applyInArrow(_shuffled(seed), schema)
    offsets = counts.selectExpr("_bw_bucket", "sum(_bw_n) OVER (ORDER BY _bw_bucket ROWS UNBOUNDED PRECEDING) - _bw_n AS _bw_first")
    offsets = F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets
    at = placed.join(offsets, "_bw_bucket").withColumn("_bw_at", F.col("_bw_first") + F.col("_bw_at"))
    shard = F.expr(f"_bw_at * {shards} div {max(n, 1)}")
    at = at.withColumn("law", F.lit("rows")).withColumn("shard", shard.cast("int"))
    return at.withColumn("slot", F.expr(f"_bw_at - (shard * {n}L + {shards - 1}) div {shards}")).select(*kept, *MADE)


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Write the shards, rows of each file in the order of their slots, and read them back."""
    shuffled.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)


def digests(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The contract's rows, from the written shards."""
    shuffled = external_shuffle(docs.select("doc_id", "text"), shards, seed, bucket_bytes)
    back = write_shards(shuffled, fresh_path(docs.sparkSession, "shards"))
    text = F.coalesce("text", F.lit(""))
    return back.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
