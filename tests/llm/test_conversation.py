"""Conversation repair against a search over whole edit sequences that shares nothing with the dynamic program."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import conversation as C

SCHEMA = "conv_id long, turn long, role string, text string, key string, phase string, pos string, gone boolean"
BLANK = "\t\n\x0b\x0c\r "


def _cheapest(rows):
    """Least (cost, audit) by uniform-cost search over prefixes of edits; rows: (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if (audit, i) in done:
            continue
        done.add((audit, i))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        steps = [("I", 2, i, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, must, cut = rows[i]
            steps.append(("D", 3, i + 1, None, None))
            if not must:
                steps += [("K", cut, i + 1, role, text)] if role else []
                steps += [("R", 2 + cut, i + 1, r, text) for r in ("user", "assistant")]
        for edit, price, at, role, text in steps:
            seen = initials + (role[:1] if role else "")
            if re.fullmatch("s?(ua)*u?", seen) and cost + price <= 3 * len(rows):
                heapq.heappush(heap, (cost + price, audit + edit, at, seen, out if role is None else (*out, (role, text))))


def _expected(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, edits, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        edits.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = _cheapest(edits)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}, out


def _conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " \t", "", None, "ok.  \n", "é!", "a. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "User"]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            out.append((c, rng.choice([t, t, 2 * t, None, 1]), rng.choice(roles), rng.choice(texts)))
    out += [out[0], out[0], (None, 0, "user", "Null id."), (None, 1, "assistant", "Right."), (n, None, None, None), (n, None, None, None)]
    return out


@pytest.mark.parametrize("spill", [1, 1 << 20])
def test_repair_equals_a_search_over_edits(spark, spill):
    rows = _conversations(spill, 60)
    df = spark.createDataFrame([(*r, "k", "p", "q", False) for r in rows], SCHEMA).repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a conversation spans batches
    try:
        got = {r["conv_id"]: r.asDict() for r in C.audits(df, spill_bytes=spill).collect()}
        fixed = {}
        for r in C.repaired_rows(df, spill_bytes=spill).orderBy("conv_id", "at").collect():
            fixed.setdefault(r["conv_id"], []).append(r)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    ids = {r[0] for r in rows}
    assert set(got) == ids
    for c in ids:
        want, out = _expected([r[1:] for r in rows if r[0] == c])
        assert {k: got[c][k] for k in want} == want, (c, [r[1:] for r in rows if r[0] == c])
        assert "".join(r["edit"] for r in fixed[c]) == want["audit"]
        assert [(r["role"], r["text"]) for r in fixed[c] if r["edit"] != "D"] == list(out)
        assert [r["at"] for r in fixed[c]] == list(range(len(want["audit"])))


def test_damage_and_conversations_without_rows(spark):
    rows = _conversations(5, 80) + [(500 + i, i, "user", "Hi there. Well") for i in range(200)]
    df = spark.createDataFrame([(*r, "k", "p", "q", True) for r in rows], SCHEMA)
    damaged = C.damage(df)
    left, ids = {}, set()
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        ids.add(conv)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    got = {r["conv_id"]: r.asDict() for r in C.audits(damaged, gone_col="gone").collect()}
    assert set(got) == ids and set(ids) - set(left)  # some conversation has lost all its rows
    for c in ids:
        want, _ = _expected(left.get(c, []))
        assert {k: got[c][k] for k in want} == want


def test_giant_conversation_spills_and_repairs(spark):
    n = 30_000
    rows = [(1, i, "assistant" if i % 3 else "user", f"Line {i // 2}.") for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (C.audits(df, spill_bytes=s).collect()[0] for s in (1000, 1 << 20))
    assert a == b and a["gaps"] == 0
    kept = C.repaired_rows(df, spill_bytes=1000).where("edit <> 'D'").orderBy("at").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == a["repaired_sha256"]
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    assert sum(price[e] for e in a["audit"]) == a["cost"]  # no row is truncated


def test_pointers_come_back_in_reverse():
    for bound in (1, 3, 7, 1000):
        p = C.Pointers(bound)
        for i in range(100):
            p.push(i)
        assert [p.pop() for _ in range(100)] == list(range(99, -1, -1))
        p.close()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.audits(df).collect() == [] and C.repaired_rows(df).collect() == [] and C.audits(C.damage(df), gone_col="gone").collect() == []
    with pytest.raises(ValueError, match="missing column"):
        C.audits(df.drop("role"))
