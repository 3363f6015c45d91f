"""Signed tokens of requests as column expressions: a payload, its HMAC-SHA256, and when it expires.

Defined cases: null lists are empty; a null token, one of another form, a changed payload or another key is not
valid; a token is valid up to and including the second at which it expires. Signatures are compared as
values, not in constant time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = 900
_BLOCK = 64


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC of a binary column, by the definition over SHA-256; the key is padded on the driver."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret).ljust(_BLOCK, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    digest = lambda x: F.unhex(F.sha2(x, 256))
    return digest(F.concat(outer, digest(F.concat(inner, message))))


def _to_url(value: Column) -> Column:
    return F.rtrim(F.translate(F.base64(value), "+/=\r\n", "-_ "))


def _from_url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))), F.lit("base64"))


def _listed(hashes: Column) -> Column:
    return F.sort_array(F.coalesce(hashes, F.array().cast("array<string>")))


def signed(uploads: Column, duplicates: Column, issued: Column, secret: bytes, seconds: int = SECONDS) -> Column:
    """Token that lets an upload replace its duplicates; ``issued`` in seconds of the epoch."""
    payload = F.to_json(F.struct(_listed(duplicates).alias("duplicate_hashes"), (issued + seconds).cast("long").alias("expires_at"), _listed(uploads).alias("upload_hashes")))
    body = payload.cast("binary")
    return F.concat(_to_url(body), F.lit("."), _to_url(hmac_sha256(body, secret)))


def valid(token: Column, uploads: Column, duplicates: Column, now: Column, secret: bytes) -> Column:
    """Whether a token is ours, is for these uploads and duplicates, and has not expired."""
    parts = F.split(F.coalesce(token, F.lit("")), r"\.", 2)
    body, sign = _from_url(F.element_at(parts, 1)), _from_url(F.try_element_at(parts, F.lit(2)))
    read = F.from_json(body.cast("string"), "duplicate_hashes array<string>, expires_at long, upload_hashes array<string>")
    same = (_listed(read["upload_hashes"]) == _listed(uploads)) & (_listed(read["duplicate_hashes"]) == _listed(duplicates))
    return F.coalesce((sign == hmac_sha256(body, secret)) & same & (F.coalesce(read["expires_at"], F.lit(0)) >= now), F.lit(False))
