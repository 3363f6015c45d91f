"""Table functions for SQL: planned queries of a reply, and contexts fitted to a budget.

``plan_queries(reply, question, most)`` is called with LATERAL. ``fit_context(TABLE (...), budget)`` takes rows
(qid, place, id, content), which it asks Spark to part by qid and to order by place, and gives the rows that
a budget of tokens admits; the one that crosses it is cut, and later, smaller ones still count. A task
holds a row at a time.

Defined cases: null contents and questions are empty; an id comes once for a qid; a budget of 0 or less admits
nothing; a table without one of the columns is an error before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lodestone.functions import text as tx
from lodestone.plans import context

_TAIL = re.compile("[ \\t\\n\\x0b\\f\\r\\u00a0\\u2000-\\u200a\\u3000]+\\Z")


@udtf(returnType="ordinal int, query string")
class PlanQueries:
    def eval(self, reply: str, question: str, most: int) -> Iterator[tuple]:
        for i, query in enumerate(context.planned(reply, question or "", most)):
            yield i, query


def cost(text: str) -> int:
    return -(-len(text) // 4) + tx.OVERHEAD_TOKENS


def cut_to(text: str, budget: int) -> str:
    """A text that does not fit, cut to a budget with a notice; empty if there is no room."""
    if budget < tx.LEAST_BLOCK_TOKENS:
        return ""
    short = _TAIL.sub("", text[: max(0, 4 * (budget - tx.OVERHEAD_TOKENS) - len(tx.TRUNCATION_NOTICE))])
    return short + tx.TRUNCATION_NOTICE if short else ""


@udtf
class FitContext:
    def __init__(self):
        self.used, self.seen = 0, set()

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"qid", "place", "id", "content"} <= set(rows.dataType.fieldNames()):
            raise ValueError("fit_context needs a table with qid, place, id and content")
        kept = StructType([rows.dataType[c] for c in ("qid", "place", "id")])
        return AnalyzeResult(kept.add("content", "string").add("tokens", "long").add("truncated", "boolean"), partitionBy=[PartitioningColumn("qid")], orderBy=[OrderingColumn("place"), OrderingColumn("id")])

    def eval(self, row, budget: int) -> Iterator[tuple]:
        left = budget - self.used
        content = row["content"] or ""
        whole = cost(content) <= left
        text = content if whole else cut_to(content, left)
        if left <= 0 or row["id"] in self.seen or not (whole or text):
            return
        self.seen.add(row["id"])
        self.used += cost(text)
        yield row["qid"], row["place"], row["id"], text, cost(text), not whole


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("plan_queries", PlanQueries)
    spark.udtf.register("fit_context", FitContext)
