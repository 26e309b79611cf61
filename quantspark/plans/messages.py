"""Messages at the door: signatures of every event, and what is let in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.authentication import padded, signed
from ..registry import query
from ..sources.tables import read

_KEY = "events-signing-key"
#: Events' own signatures, as senders would make them: some prefixed, in capitals, missing, empty, or those of another body.
_KINDS = {3: "another body", 5: "prefix", 7: "missing", 8: "empty", 9: "capitals"}


def _hash(pad: int, tail: str) -> str:
    return f"sha256(from_hex('{padded(_KEY, pad).hex()}') || {tail})"


_DIGEST = _hash(0x5C, f"from_hex({_hash(0x36, 'encode({body})')})")


@query(f"""WITH s AS (SELECT event_type, CAST(event_id % 10 AS INTEGER) AS kind, {_DIGEST.format(body="props")} AS want, {_DIGEST.format(body="concat(props, ' ')")} AS other FROM events),
g AS (SELECT event_type, want, CASE kind WHEN 3 THEN other WHEN 7 THEN NULL WHEN 8 THEN '' ELSE want END AS given FROM s),
v AS (SELECT event_type, coalesce(given = want, false) AS ok, coalesce(given, '') = '' AS bare FROM g)
SELECT event_type, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE NOT ok AND bare) AS BIGINT) AS unsigned, CAST(count(*) FILTER (WHERE NOT ok AND NOT bare) AS BIGINT) AS forged FROM v GROUP BY event_type""")
def signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's body against the signature in its headers: accepted, unsigned and forged messages by type."""
    from ..functions.authentication import hmac_sha256, signature

    e = read(spark, sf_dir, "events").withColumn("kind", (F.col("event_id") % 10).cast("int"))
    own, other = hmac_sha256(_KEY, F.col("props")), hmac_sha256(_KEY, F.concat("props", F.lit(" ")))
    given = F.when(F.col("kind") == 3, other).when(F.col("kind") == 5, F.concat(F.lit("sha256="), own)).when(F.col("kind") == 7, None).when(F.col("kind") == 8, "").when(F.col("kind") == 9, F.upper(own)).otherwise(own)
    e = e.withColumn("headers", F.create_map(F.lit("x-signature"), given))
    x = e.select("event_type", signed(_KEY, F.col("props"), F.col("headers")).alias("ok"), signature(F.col("headers")).isNull().alias("bare"))
    n = lambda c: F.count_if(c).alias
    return x.groupBy("event_type").agg(F.count("*").alias("messages"), n(F.col("ok"))("accepted"), n(~F.col("ok") & F.col("bare"))("unsigned"), n(~F.col("ok") & ~F.col("bare"))("forged"))
