"""Repairs against the cheapest edits found by trying all, and long conversations against whole ones."""

import hashlib
import re
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from quantspark.llm import repair as rp



def plain_edits(rows):
    """(cost, audit, lines) by best-first search over (cost, audit); rows are (role, text, fault)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, lines = heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        tail = (i, roles[-1:] if roles else "")
        if tail in done:
            continue
        done.add(tail)
        options = [(5, "I", i, r[0], f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((2, "D", i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options.append((more, "K", i + 1, role[:1], f"{role}:{text}"))
                options += [(more + 1, "R", i + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for c, letter, j, emitted, line in options:
            if letter != "D" and (not emitted or not re.fullmatch("s|u|s?(ua)+|s?(ua)*u", roles + emitted)):
                continue
            heappush(queue, (cost + c, audit + letter, j, roles + emitted, lines if line is None else (*lines, line)))


def plain(rows):
    """The contract over (conv_id, turn, role, text)."""
    out, convs = [], defaultdict(list)
    show = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        own = convs[conv]
        if kind:
            row = (turn is not None, turn or 0, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, turn)
            own.extend([row] * (2 if kind == 3 else 1))
    for conv, own in convs.items():
        seen, marked, n = set(), [], defaultdict(int)
        for _, _, role, text, _ in sorted(own, key=lambda r: r[:4]):

            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            n[fault] += 1
        turns = {r[4] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = plain_edits(marked)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


ODD = [
    (900, 0, "assistant", "Only a."), (901, 0, "system", "Only s."), (902, None, "user", "Hi."), (902, 3, None, "x."), (902, 9, "user", None), (903, 1, "", "y."), (903, 1, "user", "y."), (903, 1, "user", "y."),
    (None, 0, "user", "null conv."), (None, None, None, None), (904, 5, "User", "Upper."), (904, 6, "tool", "t. "), (904, 7, "assistant", "ok! \n"), (904, 8, "assistant", "no stop"), (905, 2, "user", " \t\n\x0b\x0c\r"),
    (906, -3, "system", "A."), (906, 40, "system", "B."), (906, 41, "user", "C" * 100_000), (906, 42, "user", "D?"), (907, 0, "assistant", "é."), (907, 0, "system", "é."),
]


@pytest.fixture(scope="module")
def talks(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return df.unionAll(spark.createDataFrame(ODD, df.schema)).repartition(3)


def test_whole_table(talks):
    got = rp.repair(rp.damage(talks)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(map(tuple, talks.collect())), key=key)


def test_short_bounds_send_all_through_chunks(talks, monkeypatch):
    got = rp.repair(rp.damage(talks), long_rows=2).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(map(tuple, talks.collect())), key=key)


def test_one_conversation_holds_a_third_of_the_rows(spark):
    kinds = [("system", "Go."), ("user", "What?"), ("assistant", "That."), ("assistant", "cut"), ("user", ""), ("tool", "x!"), ("user", "Again?")]
    rows = [(1, i, *(kinds[(i * i + i // 7) % 7])) for i in range(9000)]
    rows = [(c, t, r, x if (t or 0) % 3 else x.replace(".", f" {t}.").replace("?", f" {t}?")) for c, t, r, x in rows] + [(1, 77, "user", "What?")] * 500 + [(2 + i, i % 3, *kinds[i % 7]) for i in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7).withColumn("copies", F.lit(1))
    whole = {r.conv_id: tuple(r) for r in rp.repair(df).collect()}
    cut = {r.conv_id: tuple(r) for r in rp.repair(df, long_rows=1000).collect()}
    assert whole == cut and len(whole[1][7]) >= 9500 and whole[1][6] > 1000


def test_pieces_do_not_change_the_audit(monkeypatch):
    import random

    rng = random.Random(5)
    for _ in range(300):
        rows = [rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 9]) for _ in range(rng.randrange(0, 9))]
        marked = [("suax"[x % 4] + str(i), str(i), "blank" if x >= 8 else "truncated" if x >= 4 else None) for i, x in enumerate(rows)]
        cost, audit, _ = plain_edits(marked)
        for size in (1, 2, 64):
            monkeypatch.setattr(rp, "PIECE", size)
            costs = rp.backward(rows, rp.FINAL)
            assert (costs[0][0], rp.walk(rows, costs, 0)[0]) == (cost, audit)


def test_texts_and_clashing_columns(spark, talks):
    df = rp.damage(talks)
    out = rp.repair(df.withColumn("cost", F.lit(1)).withColumn("row", F.lit("x")), texts=True).collect()
    assert all(hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256 for r in out)
    assert rp.repair(df.where("false")).count() == 0
    gone = rp.repair(df.where("conv_id = 900").withColumn("copies", F.lit(0))).first()
    assert tuple(gone) == (900, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_sql_says_the_same(talks):
    import duckdb
    import pyarrow as pa

    rows = list(map(tuple, talks.collect()))
    con = duckdb.connect()
    con.register("conversations", pa.table(dict(zip(("conv_id", "turn", "role", "text"), zip(*rows, strict=True), strict=True))))
    assert sorted(con.execute(rp.SQL).fetchall(), key=key) == sorted(plain(rows), key=key)
