"""Sharding by jump consistent hashing: a row's key and the number of shards decide where it goes.

A key walks along increasing shard numbers, each the next one at which it would move if shards were
added one by one. The walk does not depend on the number of shards, so one walk gives the shard
among n (the last stop below n) and among n + 1; with one more shard a row either stays or moves into
the new one, and only a share of 1 / (n + 1) moves. There is no table of the ring and nothing to send
to the tasks. The walk's generator is the published one, key * 2862933555777941757 + 1 modulo 2**64,
in halves of 32 bits, as whole numbers are checked for overflow here. All of it is built-in functions.

Places within a shard: shards are cut into ``BUCKETS`` fixed buckets by further bits of the key's
hash; a place is the number of rows in the buckets before, a running sum over at most ``BUCKETS``
rows a shard, plus the place within the bucket. So no task holds a shard, and places don't depend on
partitions. Equal rows are counted in map tasks before they shuffle and dealt out again after.

Defined cases: a null text is empty, of size ``ROW_BYTES``; a null id is the key ''; rows that share an id share
a shard; fully equal rows take neighbouring slots. An empty table gives no rows. Texts of any length
are measured whole. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.storage import stage

SHARDS = 40
BUCKETS = 4096
ROW_BYTES = 16
#: Multiplier of the generator (fixed value).
MULTIPLIER = 2862933555777941757
FIRST_STOPS = 24
CHUNK = 1 << 16


def key_hash(key: Column) -> tuple[Column, Column, Column]:
    """Two halves of 32 bits of a key's hash, and its bucket."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    part = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    return part(1, 8), part(9, 8), F.pmod(part(17, 8), F.lit(BUCKETS))


def jump(high: Column, low: Column, shards: int) -> Column:
    """Struct of a key's shard among ``shards`` (``at``) and among one more (``grown``)."""
    mask, half = F.lit((1 << 32) - 1), F.lit((1 << 16) - 1)
    by_high, by_low = (F.lit(x).cast("long") for x in divmod(MULTIPLIER, 1 << 32))

    def step(state: Column, _: Column) -> Column:
        h, l, j = state["h"], state["l"], state["j"]
        upper = F.shiftright(l, 16) * by_low
        lower = l.bitwiseAND(half) * by_low + F.shiftleft(upper.bitwiseAND(half), 16) + 1
        carry = F.shiftright(lower, 32) + F.shiftright(upper, 16)
        product = (l * by_high).bitwiseAND(mask) + (h.bitwiseAND(half) * by_low).bitwiseAND(mask) + F.shiftleft((F.shiftright(h, 16) * by_low).bitwiseAND(half), 16)
        new_h, new_l = (carry + product).bitwiseAND(mask), lower.bitwiseAND(mask)
        next_j = F.floor((j + 1) * (F.lit(float(1 << 31)) / (F.shiftright(new_h, 1) + 1))).cast("long")
        moved = F.struct(new_h.alias("h"), new_l.alias("l"), next_j.alias("j"), F.when(j < shards, j).otherwise(state["at"]).alias("at"), j.alias("grown"))
        return F.when(j <= shards, moved).otherwise(state)

    zero = F.lit(0).cast("long")
    start = F.struct(high.alias("h"), low.alias("l"), zero.alias("j"), zero.alias("at"), zero.alias("grown"))
    walk = lambda stops, begin: F.aggregate(F.sequence(F.lit(1), F.lit(stops)), begin, step)
    first = walk(min(FIRST_STOPS, shards + 1), start)
    if shards + 1 <= FIRST_STOPS:
        return first
    # a walk of more stops than the first ones is rare; it goes on for its rows only
    return F.aggregate(F.array(first), start, lambda _, s: F.when(s["j"] <= shards, walk(shards + 1, s)).otherwise(s))


def shards_of(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of ``docs``."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    equal = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    high, low, bucket = key_hash(F.col("doc_id"))
    placed = equal.select("*", high.alias("h"), low.alias("l"), bucket.alias("bucket")).select("doc_id", "size", "text_crc32", "n", "bucket", jump(F.col("h"), F.col("l"), shards).alias("s"))
    rows = stage(placed.select("doc_id", "size", "text_crc32", "n", "bucket", F.col("s.at").cast("int").alias("shard"), F.col("s.grown").cast("int").alias("grown_shard")), "shards")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).select("shard", "bucket", before(Window.partitionBy("shard").orderBy("bucket")).alias("start"))
    inside = before(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    found = rows.join(starts, ["shard", "bucket"]).withColumn("first", F.col("start") + inside)
    runs = found.withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    each = runs.withColumn("k", F.explode(F.expr(f"sequence(c * {CHUNK}, least(n, (c + 1) * {CHUNK}) - 1)")))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("k")).alias("slot"), "grown_shard")
