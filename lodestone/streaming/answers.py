"""Answer streams with state and timers: thinking and answer parts, notices, sessions that end.

A conversation's state is what it is inside of, what may be the beginning of a tag and is held back, and
what it has said so far. It ends with a row that is marked done, or when no row has come for
``timeout``: then what was held back leaves, a notice says that the answer was cut off, and the state goes.
Time is that of the events, or, as ``clock`` says, of the machine; then state also has a time to live.

Defined cases: null texts are empty; rows of a batch go by ``seq``, ties by text; rows after the end begin a new
session; rows later than the watermark do not come, as Spark drops them; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.incremental import think_parts

#: Notices at the end of an answer (fixed values).
THOUGHT_TO_THE_LIMIT = (
    "The model reached its token limit while still producing its thinking. The token budget has been raised for future requests; "
    "retry the question or increase LOCAL_RAG_NUM_PREDICT for longer answers."
)
ONLY_THOUGHT = "The model ended before producing final answer text."
LIMIT_REACHED = "The model reached its token limit, so the answer may be incomplete."
#: Our own, for a stream that stopped without an end.
TIMED_OUT = "The stream stopped before the answer was complete."
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def end_notice(thought: bool, answered: bool, reason: str) -> str | None:
    """What to say at the end of an answer, if anything."""
    if thought and not answered:
        return THOUGHT_TO_THE_LIMIT if reason == "length" else ONLY_THOUGHT
    return LIMIT_REACHED if reason == "length" else None


class AnswerParts(StatefulProcessor):
    """Rows (key, seq, ts, content, done_reason) to rows (key, seq, kind, content); kind is thinking, answer or notice."""

    def __init__(self, timeout_ms: int, ttl_ms: int | None):
        self.timeout_ms, self.ttl_ms = timeout_ms, ttl_ms  # a time to live goes by the machine's clock only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "inside boolean, held string, thought boolean, answered boolean, seq long, due long", self.ttl_ms)

    def _out(self, key: tuple, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "seq", "kind", "content"])

    def _closed(self, state: tuple, seq: int, reason: str, late: bool) -> list:
        inside, held, thought, answered = state
        rows = [(seq, "thinking" if inside else "answer", held)] if held else []
        thought, answered = thought or (bool(held) and inside), answered or (bool(held) and not inside)
        notice = TIMED_OUT if late else end_notice(thought, answered, reason)
        return rows + ([(seq, "notice", notice)] if notice else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.session.get() if self.session.exists() else (False, "", False, False, -1, None)
        inside, held, thought, answered, _, due = known
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["seq", "content"], na_position="first", kind="stable")
        out, latest, open_ = [], None, True
        for row in frame.itertuples(index=False):
            parts, inside, held = think_parts(held + (row.content if isinstance(row.content, str) else ""), inside)
            out += [(row.seq, kind, part) for kind, part in parts]
            thought |= any(kind == "thinking" for kind, _ in parts)
            answered |= any(kind == "answer" for kind, _ in parts)
            latest = row.ts if latest is None else max(latest, row.ts)
            open_ = not isinstance(row.done_reason, str)
            if not open_:
                out += self._closed((inside, held, thought, answered), row.seq, row.done_reason, False)
                inside, held, thought, answered = False, "", False, False
        if due is not None:
            self.handle.deleteTimer(due)
        if open_:
            now = int(latest.timestamp() * 1000) if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
            due = now + self.timeout_ms
            self.handle.registerTimer(due)
            self.session.update((inside, held, thought, answered, int(frame.seq.iloc[-1]), due))
        else:
            self.session.clear()
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.session.exists():
            return
        inside, held, thought, answered, seq, _ = self.session.get()
        self.session.clear()
        yield self._out(key, self._closed((inside, held, thought, answered), seq, "", True))

    def close(self) -> None:
        pass


def answer_parts(stream: DataFrame, key: str = "conv_id", timeout: int = 120, late: str = "30 seconds", clock: str = "event", ttl: int = 86_400) -> DataFrame:
    """Parts of a token stream (key, seq long, ts timestamp, content, done_reason), done_reason null but at the end.

    ``timeout`` and ``ttl`` in seconds, ``ttl`` for the clock ``processing``. Needs the RocksDB state store, which this sets for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = stream.schema[key].dataType.simpleString()
    if clock not in ("event", "processing"):
        raise ValueError(f"unknown clock {clock}")
    marked = stream.select(stream[key].alias("key"), "seq", "ts", "content", "done_reason")
    by_event = clock == "event"
    processor = AnswerParts(timeout * 1000, None if by_event else ttl * 1000)
    out = (marked.withWatermark("ts", late) if by_event else marked).groupBy("key").transformWithStateInPandas(
        processor, f"key {kind}, seq long, kind string, content string", "append", "eventTime" if by_event else "processingTime"
    )
    return out.withColumnRenamed("key", key)
