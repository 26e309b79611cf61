"""Quality rules: a ledger of failure bits and measurements, versioned policies and ablations over it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table, text_col, words_col

SYMBOLS = "#*$%&|<>"
#: Rules in order of their bits; each fails where its condition over the ledger's measurements holds.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "symbols": "100 * n_symbols > 25 * n_words",
    "exclamations": "100 * n_exclamations > 25 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
    "long_words": "word_chars > 40 * n_words",
    "stuttering": "100 * n_stutters > 25 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: Policies by version: the mask of rules that reject.
POLICIES = {1: BASE, 2: BASE | BITS["symbols"] | BITS["exclamations"], 3: sum(BITS.values())}
CURRENT = 3
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capitals", "n_stutters"]


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame) -> DataFrame:
    """``(doc_id, MEASURES...)``. Every measurement is made once, within the row; nothing is shuffled.

    Three-word windows are compared by their 64-bit hashes: sorted with their places, equal neighbours are windows
    found twice, and the distinct places that they cover are counted, in n log n steps for a text of n words.
    """
    x = docs.select("doc_id", text_col().alias("t")).withColumn("w", words_col(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0)
    windows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    joined = F.concat_ws("", "w")
    x = x.withColumn("l", lines).withColumn("h", windows).select(
        "doc_id", "h", "w", F.size("w").cast("long").alias("n_words"), F.length(joined).cast("long").alias("word_chars"), _removed(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.size("l").cast("long").alias("n_lines"), _removed(F.col("t"), "!").cast("long").alias("n_exclamations"),
        (F.length(joined) - F.length(F.regexp_replace(joined, r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
    )
    stutters = F.size(F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("w", i) == F.get("w", i - 1)))
    x = x.withColumn("n_stutters", F.when(F.size("w") >= 2, stutters).otherwise(0).cast("long"))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    ordered = F.when(twice, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    x = x.withColumn("s", ordered)
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    places = F.filter("s", lambda e, i: F.when(i > 0, same(F.get("s", i - 1), e)).otherwise(False) | same(F.get("s", i + 1), e))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return x.withColumn("n_repeat_words", F.when(F.col("s").isNotNull(), F.size(covered)).otherwise(0).cast("long")).select("doc_id", *MEASURES)


def rule_ledger(docs: DataFrame) -> DataFrame:
    """Adds ``failed``, a bit for each rule, to the measurements of ``docs(doc_id, text)``.

    A null text counts as empty; repeated rows and null doc_ids stay as they are; an empty table gives none.
    """
    bits = sum((F.when(F.expr(f"coalesce({rule}, false)"), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measure(docs).withColumn("failed", bits.cast("long"))


def apply_policy(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """``kept`` under a policy: no bit of its mask is set. Needs no text: policies are applied to stored ledgers."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and rule of its mask: documents failing the rule, and those that only this rule rejects."""
    spec = [(v, name, mask, BITS[name]) for v, mask in POLICIES.items() for name in RULES if mask & BITS[name]]
    aggs = []
    for i, (_, _, mask, bit) in enumerate(spec):
        own = F.col("failed").bitwiseAND(F.lit(mask))
        aggs += [F.count_if(own.bitwiseAND(F.lit(bit)) != 0).alias(f"f{i}"), F.count_if(own == bit).alias(f"o{i}")]
    rows = [F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only")) for i, (v, name, _, _) in enumerate(spec)]
    return ledger.agg(*aggs).select(F.inline(F.array(*rows)))


def op6_rules(spark, sf_dir: str) -> DataFrame:
    kept = apply_policy(rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT r, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w),
tri AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lag(a) OVER o AS z FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r),
stu AS (SELECT r, count(*) AS n_stutters FROM tri WHERE a = z GROUP BY r),
lin AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lin WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_excl,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_cap, coalesce(n_stutters, 0) AS n_stutters
  FROM w LEFT JOIN cov USING (r) LEFT JOIN lc USING (r) LEFT JOIN stu USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_dup_lines > 50 * n_lines OR 100 * n_symbols > 25 * n_words OR 100 * n_excl > 25 * n_words
           OR 100 * n_cap > 50 * word_chars OR word_chars > 40 * n_words OR 100 * n_stutters > 25 * n_words) AS kept
FROM b
"""
