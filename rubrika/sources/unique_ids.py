"""Ids that occur once in a source: checks within a batch and against its other batches.

Within a batch ids are counted with partial sums in the tasks. Against other batches the ids meet the
key table, stored by bucket of the id's hash: only buckets of the batch's ids are read, and a
Bloom filter of them, counted before it is broadcast, lets through the few old keys that may be
among them before anything is shuffled. So of the old keys next to nothing travels, and of the new
rows only ids do.

Of rows with one id the first by ``created_at`` stays, then by a hash of the row; of rows that are the
same in all columns one stays. Which that is does not depend on tasks or order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16
# Bits per id of the Bloom filter and bits set by each; about 1 old key in 700 passes by mistake.
BITS_PER_ID = 16
SEEDS = (11, 23, 47)
# A filter of up to this many words of 64 bits (16 bytes a row) may be broadcast; for batches of more
# ids, the keys of their buckets are joined without it.
BLOOM_WORDS = 2_000_000
# Up to this many repeated ids may be broadcast.
BROADCAST_IDS = 200_000

IN_BATCH = "id is repeated in the batch"
IN_LOG = "id is in another batch of the source"


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(BUCKETS)).cast("int").alias("bucket")


def write_keys(rows: DataFrame, path: str, batch: dict, attempt: str) -> None:
    """Adds the accepted ids of an attempt to the key table: one file per bucket, in order of id."""
    keys = rows.where("status = 'accepted'").select(
        "id",
        F.lit(batch["batch_id"]).cast("long").alias("batch_id"),
        F.lit(attempt).alias("attempt"),
        F.lit(batch["source"]).alias("source"),
        F.lit(batch["run"]).alias("run"),
        bucket(F.col("id")),
    )
    spread = keys.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "id")
    spread.write.mode("append").partitionBy("source", "run", "bucket").parquet(path)


def _places(key: Column, bits: int) -> list[tuple[Column, Column]]:
    """Word and bit of each of an id's places in the filter."""
    found = []
    for seed in SEEDS:
        place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))
        found.append((F.floor(place / 64).cast("long"), F.pmod(place, F.lit(64)).cast("int")))
    return found


def bloom(ids: DataFrame, bits: int) -> DataFrame:
    """``word, set``: the words of a Bloom filter of the ids that have a bit set."""
    places = F.array(*[F.struct(word.alias("word"), bit.alias("bit")) for word, bit in _places(F.col("id"), bits)])
    each = ids.select(F.explode(places).alias("place")).select("place.word", "place.bit")
    return each.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))


def may_be_in(keys: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """The keys all of whose places are set: a lookup in the broadcast filter for each place."""
    names = keys.columns
    for k, (word, bit) in enumerate(_places(F.col("id"), bits)):
        words = F.broadcast(filter_.select(F.col("word").alias(f"_word{k}"), F.col("set").alias(f"_set{k}")))
        keys = keys.withColumns({f"_at{k}": word, f"_bit{k}": bit})
        hit = (F.col(f"_at{k}") == F.col(f"_word{k}")) & F.expr(f"(shiftrightunsigned(_set{k}, _bit{k}) & 1L) = 1L")
        keys = keys.join(words, hit, "left_semi").select(*names)
    return keys


def known(ids: DataFrame, older: DataFrame, words: int = BLOOM_WORDS) -> DataFrame:
    """Those of the distinct ``ids`` that are among ``older`` (id, bucket)."""
    n = ids.count()
    touched = [row[0] for row in ids.select(bucket(F.col("id"))).distinct().collect()]  # at most BUCKETS
    older = older.where(F.col("bucket").isin(touched)).select("id")
    bits = 64
    while bits < BITS_PER_ID * n:
        bits *= 2
    if bits // 64 <= words:
        older = may_be_in(older, bloom(ids, bits), bits)
    return ids.join(older.distinct(), "id", "left_semi")


def reject_repeated(checked: DataFrame, older: DataFrame) -> DataFrame:
    """Checked rows; of accepted ones with a repeated id, all but one are rejected, and all
    whose id is among ``older``. ``checked`` must be a stored table, as it is read more than once."""
    columns = checked.columns
    order = F.struct("created_at", F.xxhash64(*columns).alias("row_hash"))
    accepted = checked.where("status = 'accepted'")
    counted = accepted.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))
    old = known(accepted.select("id").distinct(), older).select("id", F.lit(True).alias("old"))
    found = counted.join(old, "id", "left").where("n > 1 OR old")
    found = found.select(F.col("id").alias("_id"), "best", F.coalesce("old", F.lit(False)).alias("old"))
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    joined = checked.join(found, (F.col("id") == F.col("_id")) & (F.col("status") == "accepted"), "left")
    joined = joined.withColumn("_first", order == F.col("best"))

    settled = joined.where("_id IS NULL OR old OR NOT _first")
    refused = F.col("_id").isNotNull()
    settled = settled.withColumns(
        {
            "reason": F.when(refused, F.when(F.col("old"), IN_LOG).otherwise(IN_BATCH)).otherwise(F.col("reason")),
            "status": F.when(refused, F.lit("rejected")).otherwise(F.col("status")),
        }
    ).select(*columns)
    # Rows alike in all columns stand together as one with a number.
    alike = joined.where("_first AND NOT old").groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    copies = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    again = F.col("_copy") > 1
    copies = copies.withColumns(
        {"status": F.when(again, F.lit("rejected")).otherwise(F.col("status")), "reason": F.when(again, F.lit(IN_BATCH))}
    ).select(*columns)
    return settled.union(copies)
