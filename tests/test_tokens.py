"""Signed tokens against hashlib and hmac."""

import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from lodestone.functions import tokens


def plain(ups, dups, issued, secret):
    body = json.dumps({"upload_hashes": sorted(ups), "duplicate_hashes": sorted(dups), "expires_at": issued + 900}, sort_keys=True, separators=(",", ":")).encode()
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return f"{part(body)}.{part(hmac.new(secret, body, hashlib.sha256).digest())}"


def test_tokens(spark):
    rows = [(i, [f"h{j}" for j in range(i)], [f"h{j}" for j in range(0, i, 2)], 1000 + i) for i in range(40)]
    table = spark.createDataFrame(rows, "i int, ups array<string>, dups array<string>, at long")
    for secret in (b"k", b"s" * 64, b"long " * 40):
        made = table.withColumn("token", tokens.signed(F.col("ups"), F.col("dups"), F.col("at"), secret))
        assert {r.i: r.token for r in made.collect()} == {i: plain(u, d, at, secret) for i, u, d, at in rows}
        check = lambda token, now, ups="ups", key=secret: made.select(tokens.valid(token, F.col(ups), F.col("dups"), now, key).alias("v"))
        verdicts = lambda *a, **k: {r.v for r in check(*a, **k).collect()}
        assert verdicts(F.col("token"), F.col("at") + 900) == {True} and verdicts(F.col("token"), F.col("at") + 901) == {False}
        assert verdicts(F.col("token"), F.col("at"), key=b"other") == {False}
    for bad in (None, "", "x", "a.b", ".", "....", "é.é"):
        assert verdicts(F.lit(bad), F.col("at")) == {False}
    assert {r.v for r in table.where("i > 1").select(tokens.valid(tokens.signed(F.col("ups"), F.col("dups"), F.col("at"), b"k"), F.slice("ups", 1, 1), F.col("dups"), F.col("at"), b"k").alias("v")).collect()} == {False}
    nulls = spark.range(1).select(tokens.signed(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(5), b"k").alias("t")).first().t
    assert nulls == plain([], [], 5, b"k")
