"""Operators on streams of reads.

Row-wise operators, searches and id lists take a streaming table as they are. Statistics run in complete mode.
What depends on the whole file (places, order, pairs by place) raises when the query starts, as Spark says which
step can't stream; put it inside foreachBatch to apply it to each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basewright.functions import exprs as X
from basewright.operators import aggregate, rowwise, select
from basewright.schema import READS

def kept(stream: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads whose whole id isn't in a list."""
    return select.remove(stream, ids)[0]


def gc_counts(stream: DataFrame) -> DataFrame:
    """Reads by GC percentage; `aggregate.gc_histogram` of the sink's table adds the empty rows and the shares."""
    return stream.groupBy(X.gc_bucket(F.col("seq")).alias("gc")).agg(F.count(F.lit(1)).alias("n"))


STATELESS = {"remove": kept} | {f.__name__: f for f in (select.search, select.grep, rowwise.trim, rowwise.cut_adapters, rowwise.mask, rowwise.rescore, rowwise.reverse, rowwise.rename, rowwise.to_fasta, rowwise.to_sam, rowwise.flatten, rowwise.slide)}
MERGEABLE = {"gc_histogram": gc_counts} | {f.__name__: f for f in (aggregate.size, aggregate.summary, aggregate.lengths, aggregate.kmers, aggregate.cycle_bases, aggregate.cycle_qualities)}


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Reads from Parquet files as they come to a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(stream: DataFrame, operator: str | Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, name: str | None = None, **options) -> StreamingQuery:
    """Run an operator over a stream until stopped; the mode follows from the kind of operator."""
    f = operator if callable(operator) else STATELESS.get(operator) or MERGEABLE.get(operator)
    if f is None:
        raise ValueError(f"{operator} needs the whole file; apply it inside foreachBatch")
    if f is rowwise.rename and options.get("prefix") is not None:
        raise ValueError("numbered names need the whole file; on a stream rename takes a label only")
    mode = "complete" if f in MERGEABLE.values() else "append"
    writer = f(stream, **options).writeStream.outputMode(mode).format(sink).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()
