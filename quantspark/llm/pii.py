"""Personal data by weak supervision: base patterns, voting labelers, reliabilities by expectation-maximisation, a span classifier.

DataFrame and SQL functions only. Candidate spans beyond the base patterns are runs of key-like characters; labelers vote
on each, and one aggregation counts patterns of votes and features over all documents. What comes back is bounded by
the number of patterns (3^L) and feature groups, whatever the corpus; EM and the classifier's weights are sums over it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, table, text_col

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns. A match can only begin where its first run of characters does, or where the match
#: before ended; saying so keeps long runs from being scanned from each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A candidate: a run of key-like characters with a digit, or a name and its value.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{9,}+"
#: Gazetteer of words that go before secrets and personal numbers.
NAMES_OF_SECRETS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "key", "credential", "auth", "bearer", "ssn", "iban", "account", "passport", "private")
#: Known shapes of keys and numbers.
KNOWN = r"^(?:AKIA[A-Z0-9]{12,}|ASIA[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_=-]{16,}|[A-Za-z_-]{2,24}=[A-Za-z0-9+/_=-]{8,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$"
CONTEXT = 32
ROUNDS, ACCEPT = 25, 0.5
LABELERS = ("regex", "gazetteer", "context", "mixture")
#: What stands before an assigned value, and before a word of prose.
ASSIGNED, PROSE = r"(?:[:=]|\bis)\s*[\"']?$", r"[A-Za-z,;.]\s$"
#: Spans gathered before they are put aside together, so that long lists are not copied for every span.
TOGETHER = 128
_SPAN = "array<struct<start:int,end:int>>"


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<text, start, end>>`` of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches are each taken once; their lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("g"), found.alias("m"))
    span = "struct<text:string,start:int,end:int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("near"), F.array().cast(f"array<array<{span}>>").alias("far"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["g"]
        end = start + F.coalesce(F.length(p["m"]), F.lit(0))
        own = F.struct(p["m"].alias("text"), start.alias("start"), end.alias("end"))
        full = F.size(acc["near"]) >= TOGETHER
        near = F.when(p["m"].isNull(), acc["near"]).when(full, F.array(own)).otherwise(F.array_append(acc["near"], own))
        far = F.when(p["m"].isNotNull() & full, F.array_append(acc["far"], acc["near"])).otherwise(acc["far"])
        return F.struct(end.alias("at"), near.alias("near"), far.alias("far"))

    return F.aggregate(parts, zero, step, lambda acc: F.flatten(F.array_append(acc["far"], acc["near"])))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_HINT = {"email": "@", "ip": ".", "phone": "+"}


def base_spans(text: Column, kind: str) -> Column:
    """``array<struct<start, end>>`` of a base kind."""
    there = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else F.lit(True)
    there = there if kind == "email" else there & text.rlike("[0-9]")
    good = F.filter(match_spans(text, PATTERNS[kind]), lambda m: _passes(kind, m["text"]))
    return F.when(there, F.transform(good, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))).otherwise(F.array().cast(_SPAN))


def _votes(value: Column, before: Column) -> list[Column]:
    """1 for personal, -1 against, 0 abstains; one column a labeler."""
    letters, digits = F.regexp_count(value, F.lit("[A-Za-z]")), F.regexp_count(value, F.lit("[0-9]"))
    turns = F.regexp_count(value, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    named = "(?i)(?:^|[^a-z])(?:" + "|".join(NAMES_OF_SECRETS) + ")(?:[^a-z]|$)"
    return [
        F.when(value.rlike(KNOWN), 1).when(turns == 0, -1).otherwise(0),
        F.when(F.concat(before, F.lit(" "), value).rlike(named), 1).otherwise(0),
        F.when(F.concat(before, value).rlike("[A-Za-z_]=[A-Za-z0-9+/_-]{8,}$") | before.rlike(ASSIGNED), 1).when(before.rlike(PROSE), -1).otherwise(0),
        F.when((turns >= 3) & (digits >= 3) & (letters >= 3) & (F.length(value) >= 12), 1).when((turns <= 1) & ~value.rlike(KNOWN), -1).otherwise(0),
    ]


def _features(value: Column, before: Column) -> list[Column]:
    """Numbers of the classifier's active features, one a group."""
    n = F.length(value)
    turns = F.regexp_count(value, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    return [
        F.when(n < 12, 0).when(n < 16, 1).when(n < 24, 2).when(n < 48, 3).otherwise(4),
        5 + F.least(F.floor(turns / 2), F.lit(3)).cast("int"),
        F.when(value.contains("="), 9).when(F.endswith(before, F.lit('"')) | F.endswith(before, F.lit("'")), 10).when(F.endswith(before, F.lit(" ")), 11).otherwise(12),
        F.when(value.rlike("^[A-Z0-9]+$"), 13).when(value.rlike("^[0-9+/=-]+$"), 14).when(value.rlike("^[a-z0-9=_-]+$"), 15).otherwise(16),
    ]


N_FEATURES = 17


def candidate_spans(text: Column) -> Column:
    """``array<struct<start, end, pattern, features>>``: candidates with the labelers' votes as a number in base 3."""

    def view(m: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), m["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), m["start"]))
        code = sum(((v + 1) * 3**i for i, v in enumerate(_votes(m["text"], before))), F.lit(0)).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), code.alias("pattern"), F.array(*_features(m["text"], before)).alias("features"))

    return F.when(text.rlike("[0-9]"), F.transform(match_spans(text, CANDIDATE), view)).otherwise(F.array().cast("array<struct<start:int,end:int,pattern:int,features:array<int>>>"))


@dataclass(frozen=True)
class Model:
    """The span classifier: log odds of its prior and of each feature; and what EM says of the labelers."""

    prior: float
    weights: tuple[float, ...]
    reliability: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]  # by labeler: chances of votes -1, 0, 1 among personal spans, and among others


def expectation_maximisation(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], list]:
    """Chance of being personal by pattern of votes, and each labeler's chances of votes by class.

    Votes are taken as independent given the class, with add-one smoothing; it starts from labelers that are right in
    7 of 10 votes.
    """
    names = range(len(LABELERS))
    vote = {p: [p // 3**j % 3 for j in names] for p in counts}
    total = sum(counts.values())
    share, good, bad = 0.5, [[0.1, 0.2, 0.7] for _ in names], [[0.6, 0.3, 0.1] for _ in names]

    def posterior() -> dict[int, float]:
        out = {}
        for p, v in vote.items():
            a, b = share, 1 - share
            for j in names:
                a, b = a * good[j][v[j]], b * bad[j][v[j]]
            out[p] = a / (a + b)
        return out

    for _ in range(rounds):
        q = posterior()
        mass = sum(q[p] * n for p, n in counts.items())
        new_good = [[(sum(q[p] * n for p, n in counts.items() if vote[p][j] == v) + 1) / (mass + 3) for v in range(3)] for j in names]
        new_bad = [[(sum((1 - q[p]) * n for p, n in counts.items() if vote[p][j] == v) + 1) / (total - mass + 3) for v in range(3)] for j in names]
        share, good, bad = (mass + 1) / (total + 2), new_good, new_bad
    return posterior(), [(tuple(good[j]), tuple(bad[j])) for j in names]


def fit(counts: dict[tuple[int, tuple[int, ...]], int]) -> Model:
    """A naive Bayes span classifier fitted to the EM posteriors of ``counts`` of (pattern of votes, features)."""
    by: dict[int, int] = {}
    for (pattern, _), n in counts.items():
        by[pattern] = by.get(pattern, 0) + n
    q, reliability = expectation_maximisation(by)
    good, bad = [0.0] * N_FEATURES, [0.0] * N_FEATURES
    g = b = 0.0
    for (pattern, features), n in sorted(counts.items()):
        g, b = g + q[pattern] * n, b + (1 - q[pattern]) * n
        for f in features:
            good[f] += q[pattern] * n
            bad[f] += (1 - q[pattern]) * n
    weights = tuple(log((x + 1) / (g + 4)) - log((y + 1) / (b + 4)) for x, y in zip(good, bad, strict=True))
    return Model(log((g + 1) / (b + 1)), weights, tuple(reliability))


def train(docs: DataFrame) -> Model:
    """The classifier of all candidates of ``docs(text)``: one aggregation, whose rows are bounded by construction."""
    spans = docs.select(F.explode(candidate_spans(text_col())).alias("c")).groupBy("c.pattern", "c.features").count()
    return fit({(r["pattern"], tuple(r["features"])): r["count"] for r in spans.collect()})  # at most 3^L * 5 * 4 * 4 * 4 rows


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` and ``pii``: an array of structs by kind (email, ip, card, phone, secret), each an array of spans.

    Base spans always stay; a candidate is added as a secret if the classifier's odds pass ACCEPT and it overlaps no base
    span. Offsets are code points, end exclusive. A null or empty text has no spans; rows are never dropped or joined.
    """
    model = train(docs) if model is None else model
    text, own = text_col(), own_prefix(docs)
    x = docs.withColumns({own + k: base_spans(text, k) for k in KINDS[:4]} | {own + "c": candidate_spans(text)})
    base = F.concat(*[F.col(own + k) for k in KINDS[:4]])
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    weights = F.array(*map(F.lit, model.weights))
    odds = lambda c: F.aggregate(c["features"], F.lit(model.prior), lambda acc, f: acc + F.get(weights, f))
    chosen = F.filter(own + "c", lambda c: (odds(c) > log(ACCEPT / (1 - ACCEPT))) & free(c))
    secret = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    return x.withColumn("pii", F.struct(*[F.col(own + k).alias(k) for k in KINDS[:4]], secret.alias("secret"))).drop(own + "c", *[own + k for k in KINDS[:4]])


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""

    def one(kind: str) -> Column:
        return F.transform(F.col(f"pii.{kind}"), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.concat_ws(",", *map(one, kinds))


def redact(text: Column, pii: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one's kind stands for all."""

    def named(kind: str) -> Column:
        return F.transform(pii[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.array_sort(F.concat(*map(named, KINDS)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    joined = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n[:4], F.sha2(listed(KINDS[:4]), 256).alias("base_sha256"), listed(KINDS).alias("spans"), *n[4:])
