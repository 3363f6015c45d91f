"""Exact dedup by two-pass Bloom filtering.

Pass 1 folds the hash of every text into a blocked Bloom filter of two planes: bits that
were set once and bits that were set again. Only blocks with a bit in the second plane are
kept. Pass 2 tests each row: if any of its bits lacks in the second plane, no other row has
its text and it goes straight through; the other rows, the possibly repeated ones, shuffle
by digest and are settled exactly, so false positives cost a shuffle and never a result.

Large groups: the groups of the possibly repeated rows are reduced in map tasks and staged, a
narrow row each. Those of more than a ``1 / HOT`` part of all rows, fewer than ``HOT``, join by
broadcast, so a text that a third of all rows hold is in no single task; the others join by shuffle.

Scale: the filter has a word of 64 bits for each four rows and at most ``MAX_WORDS`` words.
Its second plane is the only broadcast, of 16 bytes for each word that it keeps, 64 MB at
most whatever the input. Beyond 16 million rows it fills up: more rows shuffle, narrow ones,
and the plan tends to an ordinary aggregation. A group of copies that holds a third of all
rows is first reduced in each map task.

Defined cases: null text counts as empty, and empty texts are equal to each other. A null id
sorts after all others. Of rows with the same text and the same id one stays. Other columns
ride along whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import stage

MAX_WORDS = 1 << 22
ROWS_A_WORD = 4
HOT = 4096


def normal_form(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normal form, as 32 bytes."""
    return F.unhex(F.sha2(normal_form(text).cast("binary"), 256))


def _with_places(df: DataFrame, digest: str, words: int) -> DataFrame:
    """Adds the digest's word of the filter and the mask of its three bits there."""
    bits = [f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({digest}), {at}) & 63 as int))" for at in (40, 46, 52)]
    return df.withColumns({"__word": F.expr(f"pmod(xxhash64({digest}), {words}L)"), "__mask": F.expr(" | ".join(bits))})


def repeated_plane(digests: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Pass 1 over a column ``__digest``: (words of the second plane that have bits, filter size)."""
    words = min(MAX_WORDS, max(64, rows // ROWS_A_WORD + 1))
    seen = _with_places(digests, "__digest", words).groupBy("__word", "__mask").agg(F.count(F.lit(1)).alias("n"))
    planes = seen.groupBy("__word").agg(F.collect_list(F.struct("__mask", "n")).alias("masks"))
    twice = F.expr(
        """aggregate(masks, named_struct('once', 0L, 'twice', 0L),
             (p, m) -> named_struct('once', p.once | m.__mask,
                                    'twice', p.twice | (p.once & m.__mask) | if(m.n > 1, m.__mask, 0L)),
             p -> p.twice)"""
    )
    return planes.select("__word", twice.alias("__twice")).where("__twice <> 0"), words


def with_maybe(df: DataFrame, plane: DataFrame, words: int) -> DataFrame:
    """Pass 2: ``__maybe`` is false for rows whose text certainly occurs once."""
    placed = _with_places(df, "__digest", words)
    joined = placed.join(F.broadcast(plane), "__word", "left")
    return joined.withColumn("__maybe", F.expr("coalesce((__twice & __mask) = __mask, false)")).drop("__word", "__mask", "__twice")


def joined_groups(rows: DataFrame, groups: DataFrame, size: str, every: int, key: str = "__digest") -> DataFrame:
    """Rows with the columns of their group, by ``key``. ``size``: the column of a group's number of rows.

    Groups of more than ``every / HOT`` rows are fewer than ``HOT`` and are broadcast.
    """
    hot = F.col(size) * HOT > every
    names = [*rows.columns, *(c for c in groups.columns if c != key)]
    marked = rows.join(F.broadcast(groups.where(hot).withColumn("__hot", F.lit(True))), key, "left")
    large = marked.where("__hot").select(*names)
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(groups.where(~hot), key).select(*names)
    return large.unionByName(rest)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (bytes).

    The digests are staged, so the text is read and hashed once.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("__digest"))
    digests = stage(narrow.withColumn("__row", F.monotonically_increasing_id()), "exact-digests")
    every = digests.count()
    plane, words = repeated_plane(digests.select("__digest"), every)
    tested = with_maybe(digests, plane, words)
    once = tested.where(~F.col("__maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__digest").alias("text_sha256")
    )
    maybe = tested.where("__maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row")))
    groups = stage(maybe.groupBy("__digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    settled = joined_groups(maybe, groups, "group_size", every).select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("__row") == F.col("first.row")).alias("kept"), F.col("__digest").alias("text_sha256")
    )
    return once.unionByName(settled)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows that occur once pass without a shuffle; of each group of copies the first row is
    picked by an aggregation that reduces within map tasks first.
    """
    names = docs.columns
    digest = text_digest(F.col(text_col))
    plane, words = repeated_plane(docs.select(digest.alias("__digest")), docs.count())
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    packed = docs.select(row.alias("__row"), digest.alias("__digest"), F.col(id_col).alias("__id"))
    tested = with_maybe(packed, plane, words)
    once = tested.where(~F.col("__maybe")).select("__row")
    first = F.min_by("__row", F.struct(F.col("__id").isNull(), F.col("__id")))
    copies = tested.where("__maybe").groupBy("__digest").agg(first.alias("__row")).select("__row")
    kept = once.unionByName(copies)
    return kept.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)])
