"""Contiguous shards of near equal bytes from global prefix sums.

Rows are put in one order (hash of the text, then doc_id), each partition's total is computed, the
running sums of those totals give every partition its global offset, and the global byte position of a row,
divided by the target, is its shard. Copies of a text stand next to each other in that order; a group of
copies goes to the shard in which it begins unless it is larger than a set share of a shard, when it is cut
like any other run of rows. Only totals per partition and per shard reach the driver or are broadcast.

Null and empty texts have no bytes and count as equal. Repeated rows are placed each on their own. An empty
table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dist import stage

SHARDS, OVERHEAD, WHOLE_GROUP = 40, 16, 0.05
#: Rows of ids and sizes that one partition sorts, at most.
PART_ROWS = 2_000_000


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, whole_group: float = WHOLE_GROUP) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row. whole_group: the share of a shard up to which a group of copies is kept whole."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    placed = stage(rows.repartitionByRange(parts, "hash", "size", "doc_id").withColumn("part", F.spark_partition_id()), "shard")

    totals = sorted(placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect())  # one row for each partition
    before, bytes_, n = [], 0, 0
    for t in totals:
        before.append((t.part, bytes_, n))
        bytes_, n = bytes_ + t.bytes, n + t.n
    offsets = F.broadcast(spark.createDataFrame(before, "part int, bytes_before long, rows_before long"))
    in_part = Window.partitionBy("part").orderBy("hash", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    position = placed.join(offsets, "part", "left").select(
        "doc_id", "size", "text_crc32", "hash",
        (F.col("bytes_before") + F.coalesce(F.sum("size").over(in_part), F.lit(0))).alias("byte"),
        (F.col("rows_before") + F.count(F.lit(1)).over(in_part)).alias("row"),
    )
    position = stage(position, "position")
    target = max(bytes_, 1) / shards
    groups = position.groupBy("hash", F.col("size").alias("group_size")).agg(F.count(F.lit(1)).alias("n"), F.min("byte").alias("begin"))
    groups = stage(groups.where((F.col("n") > 1) & (F.col("n") * F.col("group_size") <= whole_group * target)).select(F.col("hash").alias("group"), "group_size", "begin"), "groups")
    cut = position.join(groups, (F.col("hash") == F.col("group")) & (F.col("size") == F.col("group_size")), "left")
    middle = F.coalesce(F.col("begin").cast("double"), F.col("byte") + F.col("size") / 2)
    cut = stage(cut.select("doc_id", "size", "text_crc32", "row", F.least(F.lit(shards - 1), F.floor(middle / target).cast("int")).alias("shard")), "cut")
    begins = F.broadcast(cut.groupBy("shard").agg(F.min("row").alias("begin")))  # at most one row for each shard
    return cut.join(begins, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("begin")).alias("slot"))
