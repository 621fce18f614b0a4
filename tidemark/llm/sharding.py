"""Proportional stratified interleaving: shards of equal row counts that all hold the mixture of sources.

Rows are ranked within their source in a seeded shuffle (a hash of id and text). A row's
fractional rank is (rank + phase) / rows of its source, the phase being a hash of the source
that keeps small sources from meeting at one place. Sorted by fractional rank, any stretch of
fractions holds every source in proportion, give or take a row; so the order is
cut into shards whose row counts differ by one at most. (Very many sources of a row or two are
spread at random, so they shift the cuts a little, by about the root of their number.)

No sort of a whole source or table: hashes and fractions are spread evenly by construction,
so their leading bits are the buckets in which windows number rows; counts by
bucket, summed up in order, are what comes before. Only DataFrame functions; texts
are read once and never shuffled (unless carried).

Null or empty texts have size 8 and crc32 0. A null source is a source of its own, apart from the
empty one. Null and repeated ids, ties and repeated rows are rows like any other: all get a seat;
rows equal in id and text are ordered as they come, which changes no result. An empty table gives an
empty table. Only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import jobs

SHARDS, SEED = 24, "tidemark"
#: Rows of a bucket, about; leading bits of a hash of 60 bits.
PER_BUCKET, HASH_BITS = 20_000, 60
#: Prefix sums over all buckets go by stretches, of which there are so many at most.
STRETCHES = 4096


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _bits(rows: int, partitions: int) -> int:
    """log2 of the number of buckets: small buckets, and enough of them for all partitions."""
    return math.ceil(math.log2(max(rows / PER_BUCKET, 4 * partitions, 1)))


def _before(counts: DataFrame, bucket: str, shift: int) -> DataFrame:
    """Rows in earlier buckets, by bucket: prefix sums inside stretches of buckets, and over the stretches."""
    counts = counts.withColumn("stretch", F.shiftright(bucket, shift))
    sums = counts.groupBy("stretch").agg(F.sum("count").alias("n"))
    ahead = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # STRETCHES rows at most
    sums = sums.select("stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("stretch").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(sums, "stretch").select(bucket, (F.col("ahead") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("ahead"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, source, size, text_crc32, rank in the source, fraction, shard, slot (gapless from 0 in its shard).

    carry: columns that go along, as the struct `carried`; without them some 60 bytes a row are shuffled.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    named = lambda c: F.col(f"`{c}`")
    data = F.encode(F.coalesce(named(text_col), F.lit("")), "UTF-8")
    rows = docs.select(named(id_col).alias("id"), named(source_col).alias("source"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *([F.struct(*map(named, carry)).alias("carried")] if carry else []))
    written = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(" ")), "text_crc32", "size")
    rows = rows.withColumns({"stratum": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "h": _hash60(written)})
    rows = jobs.materialize(rows, "seats")  # texts are read once; what follows reads this narrow table
    total = max(1, rows.count())
    bits = _bits(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shift = max(0, bits - int(math.log2(STRETCHES)))

    rows = rows.withColumn("bucket", F.shiftright("h", HASH_BITS - bits))
    counts = rows.groupBy("stratum", "bucket").count()
    own = Window.partitionBy("stratum")
    earlier = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("ahead"), F.sum("count").over(own).alias("of"))
    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("h", "id", "text_crc32", "size")
    rows = rows.join(counts, ["stratum", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(in_bucket) - 1)
    phase = F.shiftright(_hash60(F.concat_ws(":", F.lit(seed), "stratum")), HASH_BITS - 32) / F.lit(float(1 << 32))
    rows = rows.withColumn("fraction", (F.col("rank") + phase) / F.col("of")).drop("bucket", "ahead", "of")

    ranked = jobs.materialize(rows.withColumn("bucket", F.least(F.floor(F.col("fraction") * (1 << bits)), F.lit((1 << bits) - 1))), "ranked")
    before = _before(ranked.groupBy("bucket").count(), "bucket", shift)
    in_order = Window.partitionBy("bucket").orderBy("fraction", "stratum", "rank")
    seated = ranked.join(before, "bucket").withColumn("at", F.col("ahead") + F.row_number().over(in_order) - 1)
    seated = seated.withColumn("shard", F.expr(f"at * {shards} div {total}"))  # sizes differ by one at most
    slot = F.col("at") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return seated.select(F.col("id").alias(id_col), "source", "size", "text_crc32", "rank", "fraction", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), *(["carried"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, per_file: int = 100_000, **names: str) -> None:
    """Write the rows as folders shard=N of Parquet files, each file a stretch of per_file slots in order."""
    rows = interleave(docs, shards, carry=tuple(docs.columns), **names).select("shard", "slot", "carried")
    rows = rows.repartition("shard", F.expr(f"slot div {per_file}")).sortWithinPartitions("shard", "slot")
    rows.withColumnRenamed("carried", "row").write.partitionBy("shard").parquet(path)
