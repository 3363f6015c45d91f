"""Answer streams: parts, notices, time-outs, and a restart from the checkpoint."""

from datetime import datetime, timedelta

import pytest

from lodestone.streaming import answers

START = datetime(2026, 1, 1)


def rows(spark, path, given):
    """A file of a stream: (conv_id, seq, second, content, done_reason)."""
    data = [(c, s, START + timedelta(seconds=t), x, d) for c, s, t, x, d in given]
    spark.createDataFrame(data, "conv_id string, seq long, ts timestamp, content string, done_reason string").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, table, **options):
    schema = "conv_id string, seq long, ts timestamp, content string, done_reason string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = answers.answer_parts(stream, **options)
    query = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/{table}").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()


def found(spark, tmp_path, table):
    return sorted((r.conv_id, r.seq, r.kind, r.content) for r in spark.read.parquet(f"file://{tmp_path}/{table}").collect())


def test_parts_notices_restart_and_time_out(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        where = f"file://{tmp_path}/in"
        rows(spark, where, [("a", 1, 0, "<thi", None), ("b", 1, 0, "<think>long", None), ("b", 2, 1, None, "length"), ("c", 1, 2, "half an ans", None), ("c", 2, 3, "wer <thi", None)])
        run(spark, tmp_path, "out")
        first = found(spark, tmp_path, "out")
        assert first == [("b", 1, "thinking", "long"), ("b", 2, "notice", answers.THOUGHT_TO_THE_LIMIT), ("c", 1, "answer", "half an ans"), ("c", 2, "answer", "wer ")]
        # a new query from the checkpoint: the tag that was cut by the restart is whole again
        rows(spark, where, [("a", 2, 10, "nk>deep</think>so ", None), ("a", 3, 11, "it is", "stop")])
        run(spark, tmp_path, "out")
        later = [r for r in found(spark, tmp_path, "out") if r not in first]
        assert later == [("a", 2, "answer", "so "), ("a", 2, "thinking", "deep"), ("a", 3, "answer", "it is")]
        # time passes by other conversations: c times out, its held text leaves, a notice follows, once
        rows(spark, where, [("d", 1, 1000, "x", "stop")])
        run(spark, tmp_path, "out")
        rows(spark, where, [("e", 1, 2000, "y", "length")])
        run(spark, tmp_path, "out")
        every = found(spark, tmp_path, "out")
        assert [r for r in every if r[0] == "c"] == [("c", 1, "answer", "half an ans"), ("c", 2, "answer", "<thi"), ("c", 2, "answer", "wer "), ("c", 2, "notice", answers.TIMED_OUT)]
        assert [r for r in every if r[0] in "de"] == [("d", 1, "answer", "x"), ("e", 1, "answer", "y"), ("e", 1, "notice", answers.LIMIT_REACHED)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("thought, answered, reason, said", [(True, False, "length", answers.THOUGHT_TO_THE_LIMIT), (True, False, "", answers.ONLY_THOUGHT), (False, True, "length", answers.LIMIT_REACHED), (True, True, "stop", None)])
def test_end_notices(thought, answered, reason, said):
    assert answers.end_notice(thought, answered, reason) == said
