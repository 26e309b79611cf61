"""Authentication of messages by expressions: shared secrets, and HMAC-SHA256 from the hash alone (RFC 2104)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
#: Headers that may carry a signature, and fields of a body that may carry the secret; the first with a value counts.
SIGNATURE_HEADERS, SECRET_FIELDS = ("x-signature-sha256", "x-signature", "x-hub-signature-256"), ("secret", "token", "webhook_secret")


def padded(key: str | bytes, byte: int) -> bytes:
    """The key, hashed if it is longer than a block, with every byte of the block turned by ``byte``."""
    key = key.encode() if isinstance(key, str) else key
    key = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    return bytes(k ^ byte for k in key.ljust(BLOCK, b"\0"))


def hmac_sha256(key: str | bytes, body: Column) -> Column:
    """The lower-case hex digest of a binary or string column; null for null."""
    inner = F.sha2(F.concat(F.lit(padded(key, 0x36)), body.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(padded(key, 0x5C)), F.unhex(inner)), 256)


def signature(headers: Column) -> Column:
    """The digest that a map of headers with lower-case names carries, without the prefix ``sha256=``, in lower case."""
    given = F.coalesce(*[F.nullif(F.trim(F.element_at(headers, F.lit(h))), F.lit("")) for h in SIGNATURE_HEADERS])
    return F.lower(F.trim(F.regexp_replace(given, "(?i)^sha256=", "")))


def signed(key: str | bytes, body: Column, headers: Column) -> Column:
    """Whether the signature in the headers is the body's. Hashes of both are compared, so no prefix of a match takes longer."""
    if not key:
        return F.lit(True)
    return F.coalesce(F.sha2(signature(headers), 256) == F.sha2(hmac_sha256(key, body), 256), F.lit(False))


def secret_known(expected: str, query: Column, headers: Column, body: Column) -> Column:
    """Whether the query (a map), a header, the bearer token or a field of the JSON body holds the secret; never for an empty one."""
    if not expected:
        return F.lit(False)
    bearer = F.regexp_extract(F.coalesce(F.element_at(headers, F.lit("authorization")), F.lit("")), r"(?i)^bearer (.*)$", 1)
    asked = F.coalesce(F.element_at(query, F.lit("secret")), F.element_at(query, F.lit("token")))
    held = [asked, F.trim(F.element_at(headers, F.lit("x-webhook-secret"))), F.trim(bearer), *[F.get_json_object(body, f"$.{f}") for f in SECRET_FIELDS]]
    found = F.lit(False)
    for h in held:
        found = found | F.coalesce(F.sha2(h, 256) == hashlib.sha256(expected.encode()).hexdigest(), F.lit(False))
    return found
