"""Conversation structure repair: the cheapest edits that give roles ``(s?(ua)+)?``, by layers of equal cost.

Layer c holds, for each turn, the bit set of grammar states from which the rest can be repaired at cost c or less (as
approximate matchers hold, for each number of errors, the states reached). A layer follows from those that one edit is
cheaper; the first layer that holds the start gives the cost, and a walk through the layers gives the least audit.

Conversations of bounded length are repaired in one pass over rows sorted by conversation and turn. Longer ones are cut into
chunks of rows: a chunk's costs between grammar states are a 4 x 4 table, tables are composed, and chunks are walked apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sent_if_small, stored, table

SPACES = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after s, after u, after a. The role that each awaits (an s can only be kept), and moves.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
AWAITED = ("user", "user", "assistant", "user")
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
EMIT = ((AFTER_S, None, None, None), (AFTER_U, AFTER_U, None, AFTER_U), (None, None, AFTER_A, None), (None, None, None, None))  # by initial s, u, a, other
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 40
#: By bit set of later states: the states that lead there by the awaited role, and by each initial.
BEFORE = [sum(1 << s for s in range(4) if later >> NEXT[s] & 1) for later in range(16)]
BEFORE_KEPT = [[sum(1 << s for s in range(4) if to[s] is not None and later >> to[s] & 1) for later in range(16)] for to in EMIT]
#: A row is its initial (0 to 3), plus 4 if truncated, or plus 8 if it has to go.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Rows of a piece whose layers are held at once, rows of a chunk (a power of two), rows and bytes of a conversation that one task takes.
PIECE, CHUNK_BITS, LONG_ROWS, LONG_BYTES = 64, 12, 20_000, 64 << 20


def layers(rows: list[int], accept: list[int], wanted: int) -> list[list[int]]:
    """Layers 0, 1, ... of a piece until the first position holds the states ``wanted``; ``accept[s]`` is the cost from state s after it."""
    n, out = len(rows), []
    while not out or out[-1][0] & wanted != wanted:
        c = len(out)
        inserted = out[c - INSERT] if c >= INSERT else None
        deleted = out[c - DELETE] if c >= DELETE else None
        one, five, six = (out[c - k] if c >= k else None for k in (REROLE, TRUNCATED, TRUNCATED + REROLE))
        now = [0] * (n + 1)
        bits = sum(1 << s for s in range(4) if accept[s] <= c)
        now[n] = bits | (BEFORE[inserted[n]] if inserted else 0)
        for i in range(n - 1, -1, -1):
            x, bits = rows[i], BEFORE[inserted[i]] if inserted else 0
            if deleted:
                bits |= deleted[i + 1]
            if x < 4:
                bits |= BEFORE_KEPT[x][now[i + 1]]
                if one:
                    bits |= BEFORE[one[i + 1]]
            elif x < 8:
                if five:
                    bits |= BEFORE_KEPT[x - 4][five[i + 1]]
                if six:
                    bits |= BEFORE[six[i + 1]]
            now[i] = bits
        out.append(now)
    return out


def first_layers(found: list[list[int]]) -> list[int]:
    """The cost from each state at the first position."""
    return [next((c for c, layer in enumerate(found) if layer[0] >> s & 1), NEVER) for s in range(4)]


def reachable(rows: list[int], accept: list[int]) -> int:
    """States from which some state that ``accept`` allows can be reached; an s cannot be inserted, and comes first."""
    ends = [accept[s] < NEVER for s in range(4)]
    s_row = any(x in (0, 4) for x in rows)
    late = ends[AFTER_U] or ends[AFTER_A]
    return (late or ends[START] or ends[AFTER_S] and s_row) | (late or ends[AFTER_S]) << 1 | late << 2 | late << 3


def backward(rows: list[int], accept: list[int]) -> list[list[int]]:
    """Costs from each state at the start of every piece, and after the last: piece by piece from the end, from costs less their least."""
    out = [accept]
    for at in range((len(rows) - 1) // PIECE * PIECE, -1, -PIECE):
        accept = out[-1]
        base = min(accept)
        piece = rows[at : at + PIECE]
        own = [a - base if a < NEVER else NEVER for a in accept]
        out.append([c + base if c < NEVER else NEVER for c in first_layers(layers(piece, own, reachable(piece, own)))])
    return out[::-1]


def walk(rows: list[int], costs: list[list[int]], state: int) -> tuple[str, list[tuple[int, str, str | None]], int]:
    """The least audit from ``state``, its edits as (row or the row before which to insert, letter, new role), and the last state."""
    edits = []
    for p, at in enumerate(range(0, len(rows), PIECE) if rows else [0]):
        piece, accept = rows[at : at + PIECE], costs[p + 1] if rows else costs[0]
        base = min(accept)
        accept = [a - base if a < NEVER else NEVER for a in accept]
        found = layers(piece, accept, 1 << state)
        i, c = 0, next(c for c, layer in enumerate(found) if layer[0] >> state & 1)
        has = lambda cost, at, to: cost >= 0 and found[cost][at] >> to & 1  # noqa: E731, B023
        while i < len(piece) or accept[state] != c:
            x = piece[i] if i < len(piece) else 8
            extra = TRUNCATED if x >= 4 else 0
            kept = EMIT[x % 4][state] if x < 8 else None
            if i < len(piece) and has(c - DELETE, i + 1, state):
                edits.append((at + i, "D", None))
                i, c = i + 1, c - DELETE
            elif has(c - INSERT, i, NEXT[state]):
                edits.append((at + i, "I", AWAITED[state]))
                state, c = NEXT[state], c - INSERT
            elif kept is not None and has(c - extra, i + 1, kept):
                edits.append((at + i, "K", None))
                i, state, c = i + 1, kept, c - extra
            else:
                edits.append((at + i, "R", AWAITED[state]))
                i, state, c = i + 1, NEXT[state], c - extra - REROLE
    return "".join(e[1] for e in edits), edits, state


FINAL = [0, NEVER, NEVER, 0]


def initial(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


def repaired(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of a conversation's rows in order."""
    seen, rows, faults = set(), [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        body, row = text.rstrip(SPACES), initial(role)
        if not body:
            fault, row = 0, row + 8
        elif (role, text) in seen:
            fault, row = 1, row + 8
        elif body[-1] not in ".!?":
            fault, row = 2, row + 4
        else:
            fault = None
        if fault is not None:
            faults[fault] += 1
        seen.add((role, text))
        rows.append(row)
    known = {t for t in turns if t is not None}
    illegal = sum((a % 4, b % 4) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    costs = backward(rows, FINAL)
    audit, edits, _ = walk(rows, costs, START)
    lines = [f"{role or roles[i]}:{'' if letter == 'I' else texts[i]}" for i, letter, role in edits if letter != "D"]
    return max(known) - min(known) + 1 - len(known) if known else 0, *faults, illegal, costs[0][START], audit, lines


def _whole(texts: bool):
    """Rows ``(conv_id, turn, role, text, copies)`` sorted by conversation and turn -> a row a conversation."""

    def done(conv, held) -> tuple:
        rows = [r for r in held for _ in range(r[4])]
        *counts, lines = repaired([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        joined = "\n".join(lines)
        return (conv, *counts, hashlib.sha256(joined.encode()).hexdigest(), *([joined] if texts else []))

    def out(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * (2 + texts)
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_COLUMNS, *(["repaired"] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, results = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    results.append(done(held[0][0], held))
                    held = []
                held.append(row)
            if results:
                yield out(results)
                results = []
        if held:
            yield out([done(held[0][0], held)])

    return run


_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _rows_out(f, names: str):
    """A function of a row's values that gives rows, over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_KINDS[n.split()[1]] for n in names.split(", ")]
        for b in batches:
            rows = [o for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for o in f(*row)]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [n.split()[0] for n in names.split(", ")])

    return run


_KINDS = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _map(df: DataFrame, f, names: str) -> DataFrame:
    return df.mapInArrow(_rows_out(f, names), names)


def _costs_of(conv, chunk, pos, rows):
    """A chunk's costs from each state to each, the illegal pairs within, and its first and last initials."""
    columns = [backward(rows, [0 if t == s else NEVER for t in range(4)])[0] for s in range(4)]
    illegal = sum((a % 4, b % 4) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    yield conv, chunk, [c for column in columns for c in column], illegal, rows[0] % 4, rows[-1] % 4


def _compose(conv, chunks):
    """From the chunks in order: what is left to pay from each state after every chunk, and the conversation's cost and illegal pairs."""
    accept, after = FINAL, []
    for c in reversed(chunks):
        after.append(accept)
        accept = [min(NEVER, min(c["costs"][4 * t + s] + accept[t] for t in range(4))) for s in range(4)]
    illegal = sum(c["illegal"] for c in chunks) + sum((a["last"], b["first"]) not in LEGAL for a, b in zip(chunks, chunks[1:], strict=False))
    for c, own in zip(chunks, reversed(after), strict=True):
        yield conv, c["chunk"], own, accept[START], illegal


def _ends(conv, chunk, pos, rows, accept):
    """The state after a chunk, walked from each state before it."""
    costs = backward(rows, accept)
    yield conv, chunk, [walk(rows, costs, s)[2] if costs[0][s] < NEVER else -1 for s in range(4)]


def _starts(conv, chunks):
    state = START
    for c in chunks:
        yield conv, c["chunk"], state
        state = c["ends"][state]


def _edits(conv, chunk, pos, rows, accept, state):
    for k, (i, letter, role) in enumerate(walk(rows, backward(rows, accept), state)[1]):
        yield conv, chunk, k, None if letter == "I" else pos[i], letter, role


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits with texts, sorted by conversation, chunk and place: the audit and the digest, without holding texts."""
    conv, audit, digest, empty = None, [], None, True

    def out():
        return pa.record_batch([pa.array([conv]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv", "audit", "repaired_sha256"])

    for b in batches:
        for own, letter, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != conv:
                if conv is not None:
                    yield out()
                conv, audit, digest, empty = own, [], hashlib.sha256(), True
            audit.append(letter)
            if letter != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
    if conv is not None:
        yield out()


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of any length, by chunks of rows in a global order; only the digest reads one of them in one task, as a stream."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    x = rows.withColumn("row", F.monotonically_increasing_id()).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    x = x.select(key.alias("conv"), "turn", "role", "text", "row", "copy").orderBy("conv", F.asc_nulls_first("turn"), "role", "text", "row", "copy")
    x = stored(x.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "long")
    first = x.groupBy("conv", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("same")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    blank, short = F.rtrim(F.col("text"), F.lit(SPACES)) == "", ~F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(short, "truncated")
    start = F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring("role", 1, 1)), F.lit(0))
    facts = x.join(first, "pos", "left").select("conv", "turn", "pos", fault.alias("fault"), F.when(start > 0, start - 1).otherwise(3).alias("initial"))
    facts = checkpoint(facts.select("conv", "turn", "pos", "fault", (F.col("initial") + F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNotNull(), 8).otherwise(0)).cast("long").alias("row")))
    chunk = F.shiftright("pos", CHUNK_BITS).alias("chunk")
    chunks = facts.groupBy("conv", chunk).agg(F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("r")).select("conv", "chunk", F.col("r.pos").alias("pos"), F.col("r.row").alias("rows"))
    chunks = checkpoint(chunks)
    costs = _map(chunks, _costs_of, "conv string, chunk long, costs array<long>, illegal long, first long, last long")
    ordered = lambda df, *names: df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", *names))).alias("chunks"))
    after = checkpoint(_map(ordered(costs, "costs", "illegal", "first", "last"), _compose, "conv string, chunk long, accept array<long>, cost long, illegal long"))
    both = chunks.join(after.select("conv", "chunk", "accept"), ["conv", "chunk"]).select("conv", "chunk", "pos", "rows", "accept")
    starts = _map(ordered(_map(both, _ends, "conv string, chunk long, ends array<long>"), "ends"), _starts, "conv string, chunk long, state long")
    edits = _map(both.join(starts, ["conv", "chunk"]).select("conv", "chunk", "pos", "rows", "accept", "state"), _edits, "conv string, chunk long, place long, pos long, letter string, role string")
    lines = edits.withColumnRenamed("role", "new").join(x.select("pos", "role", "text"), "pos", "left")
    lines = lines.repartition("conv").sortWithinPartitions("conv", "chunk", "place").select("conv", "letter", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = lines.mapInArrow(_joined, "conv string, audit string, repaired_sha256 string")
    many = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = facts.groupBy("conv").agg(gaps, many("blank"), many("duplicate"), many("truncated"))
    total = after.groupBy("conv").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    return counts.join(total, "conv").join(digest, "conv").withColumn("conv_id", F.try_to_number("conv", F.lit("S9999999999999999999")).cast("long")).select(*_COLUMNS)


def repair(rows: DataFrame, texts: bool = False, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """A row a conversation of ``rows(conv_id, turn, role, text, copies)``: faults, the least cost, the least audit, and the result's digest.

    A row stands ``copies`` times in a row (0: not at all, but its conversation is in the result). Rows are taken by turn, nulls
    first, equal turns by role and text. Null roles and texts are one space; rows without conv_id are one conversation. ``texts``
    adds the repaired conversation (column ``repaired``, whole in a row; only for conversations within the bounds).
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.col("copies").cast("int"))
    size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("b")).where((F.col("n") > long_rows) | (F.col("b") > long_bytes))
    size = checkpoint(size.select(F.col("conv_id").alias("long_id")))
    long = None
    if size.count():
        own = F.col("conv_id").eqNullSafe(F.col("long_id"))
        long, rows = rows.join(sent_if_small(size), own, "left_semi"), rows.join(sent_if_small(size), own, "left_anti")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    out = rows.mapInArrow(_whole(texts), _SCHEMA + (", repaired string" if texts else ""))
    return out if long is None else out.unionByName(_long(long), allowMissingColumns=True)


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by a checksum of conversation and turn: one in twenty rows dropped, emptied, stripped of stops, repeated, given to the user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = shown("role"), shown("text")
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op12_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The contract in DuckDB SQL: a recursive relation over rows keeps, for each grammar state, the least (cost, audit) and its lines."""
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
    edit = lambda b, cost, letter, line=None: f"CASE WHEN {b} IS NOT NULL THEN struct_pack(c := {b}.c + {cost}, a := {b}.a || '{letter}', t := {f'list_append({b}.t, {line})' if line else f'{b}.t'}) END"
    best = lambda *options: f"list_min([{', '.join(options)}])"
    free = lambda x, condition="true": f"CASE WHEN NOT f.gone AND {condition} THEN {x} END"
    kept = lambda b, s: free(edit(b, "f.extra", "K", "f.role || ':' || f.text"), f"f.initial = '{s}'")
    turned = lambda b, role: free(edit(b, "f.extra + 1", "R", f"'{role}:' || f.text"))
    step = {
        0: [edit("b0", 2, "D")], 1: [edit("b1", 2, "D"), kept("b0", "s")], 2: [edit("b2", 2, "D"), *(f(b, k) for b in ("b0", "b1", "b3") for f, k in ((kept, "u"), (turned, "user")))],
        3: [edit("b3", 2, "D"), kept("b2", "a"), turned("b2", "assistant")],
    }
    moved = ", ".join(f"{best(*options)} AS n{s}" for s, options in step.items())
    two = best("n2", *(edit(b, 5, "I", "'user:'") for b in ("n0", "n1", "n3")))
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) // 2, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END)))"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS cid, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {crc} % 20 AS kind FROM c),
d AS (SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text FROM (SELECT * FROM h WHERE kind <> 0 UNION ALL SELECT * FROM h WHERE kind = 3) q),
o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {spaces}) AS body FROM d),
w AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) AS before FROM o),
f AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM w),
walk AS (
  SELECT cid, CAST(0 AS BIGINT) AS i, b0, CAST(b1 AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS b1, b2, {edit("b2", 5, "I", "'assistant:'")} AS b3
  FROM (SELECT cid, b0, {none} AS b1, {edit("b0", 5, "I", "'user:'")} AS b2 FROM (SELECT DISTINCT cid, struct_pack(c := CAST(0 AS BIGINT), a := '', t := CAST([] AS VARCHAR[])) AS b0 FROM c) p) q
  UNION ALL
  SELECT cid, i, n0, n1, m2, {best("n3", edit("m2", 5, "I", "'assistant:'"))} FROM (SELECT *, {two} AS m2 FROM (SELECT walk.cid, f.i, {moved} FROM walk JOIN f ON f.cid = walk.cid AND f.i = walk.i + 1) x) y),
e AS (SELECT cid, arg_max({best("b0", "b3")}, i) AS r FROM walk GROUP BY cid),
g AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY cid)
SELECT n.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(r.c AS BIGINT) AS cost, r.a AS audit, sha256(array_to_string(r.t, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM c) n JOIN e ON e.cid = n.cid LEFT JOIN g ON g.cid = n.cid"""


SQL = _sql()
