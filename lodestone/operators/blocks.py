"""Blocks of documents: neighbours within a band, chunk packing, duplicate groups.

Defined cases: blocks with null or blank content are skipped in chunks; of blocks at one place the
smaller id comes first; blocks with a null document, page or place have no neighbours; repeated
blocks stand as often as they are given; empty tables give no rows; further columns are left alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

#: Kinds of blocks that begin a section (fixed values).
HEADINGS = ("title", "section_header", "heading")


def block_content() -> Column:
    """Distinct forms of a block's content, normalised, in one line."""
    forms = F.transform(F.array("markdown", "latex", "table_json", "text"), tx.normalized)
    return F.array_join(F.array_distinct(F.filter(forms, lambda x: x != "")), " ")


def neighbours(blocks: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Blocks of the same document and page within ``window`` places of each anchor.

    The band is spread into its ``2 window + 1`` places, so the join is an equality join.
    Rows (anchor_id, block_id, reading_order).
    """
    places = F.explode(F.sequence(F.col("reading_order") - window, F.col("reading_order") + window)).alias("reading_order")
    spread = anchors.select(F.col("block_id").alias("anchor_id"), "doc_id", "page_num", places)
    return spread.join(blocks.select("block_id", "doc_id", "page_num", "reading_order"), ["doc_id", "page_num", "reading_order"]).select("anchor_id", "block_id", "reading_order")


def pack_blocks(blocks: DataFrame, max_tokens: int, overlap_tokens: int = 0) -> DataFrame:
    """Chunks of at most ``max_tokens`` words, in reading order, with an overlapping tail.

    ``blocks(doc_id, page_num, reading_order, block_id, modality, content)``. A chunk is closed by
    the block that would overflow it and carries the section of the last heading read so far. Where
    chunks end depends on all blocks before, so a document's word counts are walked once in an
    Arrow function; which blocks a chunk holds, its texts and names are a plan over the blocks.
    Rows (doc_id, chunk_no, chunk_id, block_ids, text, section, duplicate_group, page_start, page_end,
    modalities, tokens). Blocks without content are skipped.
    """

    @F.pandas_udf("array<struct<begin:int,stop:int>>")
    def walk(costs: pd.Series) -> pd.Series:
        def one(cost: list[int]) -> list[dict]:
            out, begin, held = [], 0, 0
            for i, c in enumerate(cost):
                if i > begin and held + c > max_tokens:
                    out.append({"begin": begin, "stop": i})
                    begin, held = i, 0
                    while overlap_tokens > 0 and begin > out[-1]["begin"] and (begin == i or held + cost[begin - 1] <= overlap_tokens):
                        begin -= 1
                        held += cost[begin]
                held += c
            return [*out, {"begin": begin, "stop": len(cost)}] if len(cost) else out

        return costs.map(one)

    order = ["page_num", "reading_order", "block_id"]
    flat = blocks.select("doc_id", *order, "modality", tx.normalized(F.col("content")).alias("content")).where("content <> ''")
    row = F.struct(*order, "modality", "content", tx.word_count(F.col("content")).cast("int").alias("cost"))
    each = flat.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("b"))
    cut = each.select("doc_id", "b", F.posexplode(walk(F.col("b.cost"))).alias("chunk_no", "r"))
    read = F.slice("b", 1, F.least(F.col("r.stop") + 1, F.size("b")))  # the block that closed the chunk has been read too
    heading = F.filter(read, lambda x: x["modality"].isin(*HEADINGS))
    chunk = cut.select("doc_id", "chunk_no", F.slice("b", F.col("r.begin") + 1, F.col("r.stop") - F.col("r.begin")).alias("c"), F.coalesce(F.substring(F.try_element_at(heading, F.lit(-1))["content"], 1, 200), F.lit("")).alias("section"))
    head = lambda x: F.concat(F.lit("[page "), x["page_num"].cast("string"), F.lit(" | "), x["modality"], F.lit(" | "), x["block_id"].cast("string"), F.lit("]"))
    body = F.array_join(F.transform("c", lambda x: F.concat(head(x), F.lit(" "), x["content"])), " ")
    text = tx.normalized(F.when(F.col("section") != "", F.concat(F.lit("Section: "), "section", F.lit(" "), body)).otherwise(body))
    first, last = F.element_at("c", 1), F.element_at("c", -1)
    named = chunk.withColumns({"text": text, "duplicate_group": tx.duplicate_group(F.array_join(F.col("c.content"), " "))})
    return named.select(
        "doc_id", "chunk_no", tx.prefixed_id("chunk", F.col("doc_id"), first["block_id"], last["block_id"], F.col("duplicate_group")).alias("chunk_id"),
        F.col("c.block_id").alias("block_ids"), "text", "section", "duplicate_group", first["page_num"].alias("page_start"), last["page_num"].alias("page_end"),
        F.array_sort(F.array_distinct("c.modality")).alias("modalities"), tx.word_count(F.col("text")).alias("tokens"),
    )


def duplicate_groups(chunks: DataFrame, text: Column) -> DataFrame:
    """Groups of chunks whose texts differ in case and punctuation only: (duplicate_group, members, first_id)."""
    return chunks.groupBy(tx.duplicate_group(text).alias("duplicate_group")).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"))
