"""Vector functions. Simple ones are column expressions; the embedder is an Arrow UDF.

Defined cases: a null vector gives null; vectors of different length count over the shorter one; a
vector of length 0 has similarity 0 and stays as it is when normalised; null texts are empty.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
_TOKEN = re.compile(r"[A-Za-z0-9_]+")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 if a norm is 0."""
    size = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size)
    scale = norm(x) * norm(y)
    return F.when(scale == 0, 0.0).otherwise(dot(x, y) / scale)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def fit_dimension(v: Column, dim: int) -> Column:
    """Cut or padded with zeros to a dimension."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def normalised(v: Column) -> Column:
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


class _Codes(dict):
    """Twice the bucket of a token, plus 1 for a negative sign; each token is hashed once."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        code = self[token] = 2 * (int.from_bytes(h[:4], "little") % self.dim) + (h[4] & 1)
        return code


def hash_vector(text: str, dim: int, codes: _Codes | None = None) -> np.ndarray:
    """Signed counts of hashed tokens, scaled to length 1: the deterministic stand-in for a model."""
    known = _Codes(dim) if codes is None else codes
    code = np.fromiter(map(known.__getitem__, _TOKEN.findall(text.lower())), np.int64)
    v = np.bincount(code >> 1, weights=1.0 - 2.0 * (code & 1), minlength=dim)
    length = float(np.sqrt((v * v).sum()))
    return v / (length or 1.0)


def embedded(records: DataFrame, embed_texts, content: str = "content") -> DataFrame:
    """Adds ``vector`` to records; equal texts, anywhere in the table, are embedded once."""
    known = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    texts = records.groupBy(known.alias("__text")).agg(F.first(content).alias("__content"))
    made = texts.select("__text", embed_texts(F.col("__content")).alias("vector"))
    return records.withColumn("__text", known).join(made, "__text").drop("__text")


def embed(text: Column, dim: int = 64, prefix: str = DOCUMENT_PREFIX) -> Column:
    """Vectors of texts in Arrow batches; equal texts and equal tokens of a batch are computed once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        values = texts.fillna("")
        codes = _Codes(dim)
        known = {t: hash_vector(prefix + t, dim, codes).astype(np.float32) for t in values.unique()}
        return values.map(known)

    return run(text)
