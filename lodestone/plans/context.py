"""From retrieved records to a cited context: budgets, labels, planned queries, extractive answers.

Defined cases: null texts are empty; a record keeps the number of its first appearance, of several at
one place the smaller key comes first; a reply that can't be read gives the question alone.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

MOST_FRACTION = 0.60


def context_budget(window: Column, fraction: Column, reserved: Column) -> Column:
    """Tokens for context: a share of the window, 60 % at most, less what is reserved; never below 0."""
    share = F.greatest(F.lit(1), F.floor(window * F.least(fraction, F.lit(MOST_FRACTION))))
    return F.greatest(F.lit(0), share - reserved).cast("long")


def cited(admitted: DataFrame, letter: str = "S") -> DataFrame:
    """Adds ``label``: records are numbered by their first appearance in a conversation, so a record keeps its number.

    ``admitted(conv_id, seq, key)``: what each tool call kept, in order.
    """
    first = admitted.groupBy("conv_id", "key").agg(F.min("seq").alias("seq"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "key"))
    labels = first.select("conv_id", "key", F.concat(F.lit(f"[{letter}"), number, F.lit("]")).alias("label"))
    return admitted.join(labels, ["conv_id", "key"])


def context_blocks(records: DataFrame) -> DataFrame:
    """Records (qid, place, label, source, section_path, content) as one context text for each query."""
    head = F.concat_ws(" :: ", F.nullif("source", F.lit("")), F.nullif("section_path", F.lit("")))
    block = F.concat("label", F.lit(" "), head, F.lit("\n"), "content")
    parts = F.sort_array(F.collect_list(F.struct("place", block.alias("block"))))
    return records.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"))


def extractive_answer(records: DataFrame, most: int = 4, chars: int = 300) -> DataFrame:
    """The answer without a model: the beginnings of the first records, with their labels."""
    first = records.withColumn("__k", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("__k") <= most)
    line = F.concat("label", F.lit(" "), F.substring(tx.normalized(F.col("content")), 1, chars))
    return first.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))


def message_parts(reply: Column) -> dict[str, Column]:
    """Content, thinking, reason of the end and number of tool calls of a model's reply in JSON.

    The message stands in ``message``; thinking may have three names, in it or beside it.
    """
    names = ("thinking", "reasoning", "reasoning_content")
    filled = lambda path: F.nullif(F.get_json_object(reply, path), F.lit(""))
    thinking = [filled(f"$.message.{n}") for n in names] + [filled(f"$.{n}") for n in names]
    calls = F.from_json(F.get_json_object(reply, "$.message.tool_calls"), "array<string>")
    return {
        "content": F.coalesce(F.get_json_object(reply, "$.message.content"), F.lit("")), "thinking": F.coalesce(*thinking, F.lit("")),
        "done_reason": F.coalesce(F.get_json_object(reply, "$.done_reason"), F.lit("")), "tool_calls": F.coalesce(F.size(calls), F.lit(0)),
    }


def json_tokens(value: object) -> int:
    return -(-len(json.dumps(value, ensure_ascii=False)) // 4) + tx.OVERHEAD_TOKENS


def fitted_field(item: dict, field: str, budget: int, flag: str = "content_truncated") -> tuple[dict | None, bool]:
    """The item with one text field cut so that its JSON keeps to a budget; None if not even an empty one does."""
    if json_tokens(item) <= budget:
        return item, False
    if budget < tx.LEAST_BLOCK_TOKENS:
        return None, True
    text = str(item.get(field) or "")
    bare = {**item, field: tx.TRUNCATION_NOTICE, flag: True}
    room = 4 * (budget - tx.OVERHEAD_TOKENS) - len(json.dumps(bare, ensure_ascii=False))
    # the characters of the text, escaped as JSON does, as far as there is room
    sizes = itertools.accumulate(len(json.dumps(c, ensure_ascii=False)) - 2 for c in text)
    kept = text[: sum(1 for _ in itertools.takewhile(lambda n: n <= room, sizes))].rstrip()
    return ({**bare, field: kept + tx.TRUNCATION_NOTICE}, True) if kept else (None, True)


def prompt_tokens(messages: DataFrame) -> DataFrame:
    """Tokens of each conversation's messages (conv_id, role, content, and name, tool_name, tool_calls where given)."""
    keys = [c for c in ("role", "content", "name", "tool_name", "tool_calls") if c in messages.columns]
    each = tx.OVERHEAD_TOKENS + sum((tx.token_estimate(F.col(c)) for c in keys), F.lit(0))
    return messages.groupBy("conv_id").agg(F.sum(each).alias("tokens"))


def planned(raw: str | None, question: str, most: int) -> list[str]:
    """Search queries from a planner's reply: the question, then a JSON list, a fenced one, or lines; each once."""
    text = (raw or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL | re.IGNORECASE)
    body = fence[1].strip() if fence else text
    try:
        read = json.loads(body) if body else []
        found = [str(x) for x in read] if isinstance(read, list) else [read] if isinstance(read, str) else []
    except ValueError:
        found = [line.strip().strip("\"'").rstrip(",").strip("\"' ") for line in body.splitlines()]
    once: dict[str, str] = {}
    for q in (x.strip() for x in [question, *found]):
        if q:
            once.setdefault(q.lower(), q)
    return list(once.values())[:most]


def planned_queries(replies: DataFrame, most: int = 4) -> DataFrame:
    """Rows (qid, ordinal, question) from planner replies (qid, question, reply)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.qid, i, q) for r in f.itertuples(index=False) for i, q in enumerate(planned(r.reply, r.question, most))]
            yield pd.DataFrame(rows, columns=["qid", "ordinal", "question"])

    kind = replies.schema["qid"].dataType.simpleString()
    return replies.select("qid", "question", "reply").mapInPandas(run, f"qid {kind}, ordinal int, question string")
