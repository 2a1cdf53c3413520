"""Conversation repair against a search over all edits, long conversations in small chunks and odd rows included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from cairnflow.llm import conversation_repair as repair
from cairnflow.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, kind int, back string, copies int, first string, cost long"
WORD, STOP = re.compile(r"[^\x20\x09-\x0D]"), ".!?"


def damaged(rows):
    found = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        found += [(c, t, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return found


def cheapest(rows, faults):
    """(cost, audit, repaired turns), the least audit of the least cost, by trying every edit everywhere."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, last, inserted):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = *rows[i], faults[i]
            cost, audit, rest = best(i + 1, last, 0)
            found.append((cost + 2, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] == after[last] or (last == "" and role[:1] == "s"):
                    cost, audit, rest = best(i + 1, role[:1], 0)
                    found.append((cost + extra, "K" + audit, ((role, text), *rest)))
                for initial, name in names.items():
                    if initial == after[last]:
                        cost, audit, rest = best(i + 1, initial, 0)
                        found.append((cost + extra + 1, "R" + audit, ((name, text), *rest)))
        if inserted < 3:
            cost, audit, rest = best(i, after[last], inserted + 1)
            found.append((cost + 5, "I" + audit, ((names[after[last]], ""), *rest)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows, conv_ids):
    found = []
    for c in set(conv_ids):
        here = [(t, role, text) for d, t, role, text in rows if d == c]
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, *_ in here if t is not None}
        seen, faults = set(), []
        for _, role, text in here:
            chars = WORD.findall(text)
            faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in STOP else "")
            seen.add((role, text))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(here, here[1:]))
        cost, audit, turns = cheapest([r[1:] for r in here], faults)
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        found.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return found


def order(row):
    return tuple((x is not None, x) for x in row)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 2, "f", 3) for r in rows], SCHEMA).repartition(4)


def made(seed, conversations=60):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", " ", "", "\t\n", "Why? ", "é! ", "a.b", "x　", "Hm. \n"] + [f"t{i}{rnd.choice(['.', '', '!', ' '])}" for i in range(30)]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", None, "User", "aide"]
    rows = []
    for c in range(conversations):
        for t in range(rnd.randint(1, 9)):
            turn = rnd.choice([t, t, t, t, t * 3, None, -t, 0])
            rows.append((c if c else None, turn, rnd.choice(roles), rnd.choice([*texts, None])))
    return rows + [rows[5]] * 3 + [(7, 2**63 - 1, "user", "late."), (7, -(2**63), "user", "early.")]


@pytest.mark.parametrize("seed, chunk", [(1, repair.CHUNK), (2, 1), (3, 3)])
def test_damage_and_repair(spark, seed, chunk):
    rows = made(seed)
    table_ = frame(spark, rows)
    got = repair.inspect(table_, repair.damage(table_), chunk)
    assert got.columns == ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]
    want = brute(damaged(rows), [r[0] for r in rows])
    want = [(c, min(g, 2**63 - 1), *rest) for c, g, *rest in want]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_given_table(spark):
    conversations = table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in conversations.collect()]
    got = repair.inspect(conversations, repair.damage(conversations)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute(damaged(rows), [r[0] for r in rows]), key=order)


def test_giant_conversation_in_many_chunks(spark):
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), f"text {t}{rnd.choice(['.', ''])}") for t in range(30_000)]
    rows += [(1, 40_000, "user", "again.")] * 5_000 + [(2, 0, "user", "é" * 200_000 + "?"), (2, 1, "assistant", "ok.")]
    got = {r.conv_id: r for r in repair.inspect(frame(spark, rows), chunk=700).collect()}
    whole = {r.conv_id: r for r in repair.inspect(frame(spark, rows)).collect()}
    assert got == whole
    assert len(got[1].audit.replace("I", "")) == 35_000 and got[1].duplicate == 4_999 and got[1].gaps == 10_000
    assert tuple(got[2])[1:8] == (0, 0, 0, 0, 0, 0, "KK")
    turns = repair.repair(frame(spark, rows), chunk=700).where("conv_id = 1").orderBy("turn").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns)) and [r.turn for r in turns] == list(range(len(turns)))
    text = "\n".join(f"{r.role}:{r.text}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == got[1].repaired_sha256
    assert "".join(r.edit for r in turns) == got[1].audit.replace("D", "")


def test_empty_tables(spark):
    rows = frame(spark, [(1, 0, "user", "a."), (None, 0, "user", "b.")])
    nothing = hashlib.sha256(b"").hexdigest()
    assert repair.inspect(rows.limit(0)).collect() == []
    assert {tuple(r)[1:] for r in repair.inspect(rows, rows.limit(0)).collect()} == {(0, 0, 0, 0, 0, 0, "", nothing)}
