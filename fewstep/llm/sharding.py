"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: an offset and a skip, both
from the shard's name. Shards take turns claiming their next free slot until none is left. A document's
key hashes to a slot, and the table names the shard. Adding or removing one shard moves few documents
beyond those that must move, and shards differ by one slot at most.

The table has a fixed number of slots (SLOTS), whatever the corpus holds, so broadcasting it is safe;
the placement is one hash and one lookup. Keys spread evenly by hash, so a source or a group of copies
with a third of all rows spreads over all shards.

Nulls: a null key hashes as the empty string. Rows with equal keys go to the same shard. Columns named
slot or shard are replaced; others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewstep.sources.tables import table

#: Slots of the table: a prime, over 100 times the number of shards.
SLOTS = 8191
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot, the index in shards of its owner."""
    if not shards or len(shards) > slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("fill() needs a prime number of slots and from one shard to as many as slots")
    at = [_number("offset:" + s) % slots for s in shards]
    skip = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def lookup(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as rows of slot and shard."""
    return spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill(shards, slots))], "slot int, shard string")


def slot_of(key, slots: int = SLOTS) -> F.Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard of each row."""
    df = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return df.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot", "left").select(*[c for c in df.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """Writes a folder of Parquet files per shard. files_per_shard spreads a shard over as many tasks."""
    part = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed = place(df, key, shards, slots)
    placed.repartition(len(shards) * files_per_shard, F.col("shard"), part).write.partitionBy("shard").parquet(path)


def op6_shard(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source"))


OP6_SQL = f"""
WITH hashed AS (
  SELECT doc_id, source, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INT AS slot FROM documents)
SELECT doc_id, source, slot, format('shard-{{:03d}}', {fill()}[slot + 1]) AS shard FROM hashed
"""
