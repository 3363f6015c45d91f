"""Streaming: incremental index builds, event logs, thinking and answer streams, progress lines.

Defined cases: an empty micro-batch changes nothing, and one that comes again gives the same table;
null texts are empty; a tag cut by the end of a conversation is text; lines that are no progress
lines give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.store import ChunkStore

#: What begins a progress line (fixed value).
PROGRESS_MARK = "__RAG_PROGRESS__ "


def incremental_build(stream: DataFrame, store: ChunkStore, to_records: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the records of its sources; of several rows of one source the largest by all
    columns counts. Doing a batch again gives the same table, and only the touched buckets are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            last = batch.groupBy("source_hash").agg(F.max(F.struct(*[c for c in batch.columns if c != "source_hash"])).alias("r"))
            store.replace_source(to_records(last.select("source_hash", "r.*").select(*batch.columns)))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def split_thinking(stream: DataFrame, key: str = "conv_id", order: str = "seq", text: str = "content", done: str | None = None) -> DataFrame:
    """Rows (key, seq, kind, content) of a token stream with <think> parts; the state is carried between batches.

    A tag may be cut anywhere: what could be the beginning of one is held back. ``done`` names a
    column that marks the last row of a conversation; with it comes what was held back.
    """

    def run(keys: tuple, frames, state: GroupState):
        inside, held = state.get if state.exists else (False, "")
        out = []
        for f in frames:
            for row in f.sort_values(order).itertuples(index=False):
                parts, inside, held = think_parts(held + (getattr(row, text) or ""), inside)
                if done and getattr(row, done) and held:
                    parts, held = [*parts, ("thinking" if inside else "answer", held)], ""
                out += [(keys[0], getattr(row, order), kind, part) for kind, part in parts]
        state.update((inside, held))
        yield pd.DataFrame(out, columns=[key, order, "kind", "content"])

    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {order} long, kind string, content string"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "inside boolean, held string", "append", GroupStateTimeout.NoTimeout)


def thinking_and_answer(text: Column) -> tuple[Column, Column]:
    """The thinking and the answer of whole texts; a part that is not closed goes to the end."""
    body = F.coalesce(text, F.lit(""))
    part = r"(?s)<think>(.*?)(?:</think>|\z)"
    return F.array_join(F.regexp_extract_all(body, F.lit(part), F.lit(1)), ""), F.regexp_replace(body, part, "")


def think_parts(text: str, inside: bool) -> tuple[list[tuple[str, str]], bool, str]:
    """Pieces of a text as (thinking or answer, piece), whether it ends inside, and what is held back."""
    out = []
    while True:
        tag = "</think>" if inside else "<think>"
        at = text.find(tag)
        if at < 0:
            hold = next((n for n in range(len(tag) - 1, 0, -1) if text.endswith(tag[:n])), 0)
            piece, held = text[: len(text) - hold], text[len(text) - hold :]
            if piece:
                out.append(("thinking" if inside else "answer", piece))
            return out, inside, held
        if at:
            out.append(("thinking" if inside else "answer", text[:at]))
        text, inside = text[at + len(tag) :], not inside


def progress_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Progress lines as columns; a line that isn't one, or holds no JSON object, gives no row."""
    fields = "phase string, done long, total long, unit string, rate_per_min double, eta_seconds double"
    body = F.from_json(F.substring(F.col(column), F.lit(len(PROGRESS_MARK) + 1), F.length(column)), fields)
    return lines.where(F.col(column).startswith(PROGRESS_MARK)).select(body.alias("p")).where("p.phase IS NOT NULL").select("p.*")


def event_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream in windows of event time (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
