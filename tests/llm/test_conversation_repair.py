"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from orbweave.llm import conversation_repair as cr
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost int"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """(cost, audit, repaired turns) by a heap over whole edit strings; turns are (initial, must go, truncated, role, text)."""
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in grammar:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(turns):
            initial, gone, cut, role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if not gone:
                more = 5 if cut else 0
                if (state, initial) in grammar:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial, (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in grammar:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, new[0], (*out, (new, text))))
    raise AssertionError


def plain_report(rows):
    kept = {}
    for r in plain_damage(rows):
        kept.setdefault(r[0], []).append(r)
    out = set()
    for conv in {r[0] for r in rows}:
        mine = sorted(kept.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))
        counts, turns, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, _, role, text in mine:
            bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        numbers = {r[1] for r in mine if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, repaired = plain_repair(turns)
        made = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(made.encode()).hexdigest()))
    return out


def odd_rows(seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "ux"]
    texts = ["Yes.", "No!", "so", "", None, " \t\n", "Why?  \n", "Why? x", "é.", "a\x0b", "long " * 300 + "."]
    rows = []
    for conv in [*range(40), None, None]:
        for turn in range(draw.randrange(12)):
            rows.append((conv, None if draw.random() < 0.05 else turn * draw.choice([1, 1, 1, 2]), draw.choice(roles), draw.choice(texts)))
    hot = [(1000, t, draw.choice(roles[:5]), draw.choice([f"Turn {t}.", f"Turn {t % 60}.", "cut off", ""])) for t in range(900)]
    return rows + rows[:20] + hot + [(-5, -(1 << 62), "user", "a."), (-5, (1 << 62), "assistant", "b.")]


def found(df):
    rows = [tuple(r[n] for n in NAMES) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_odd_conversations_in_blocks_of_any_size(spark):
    rows = odd_rows(3)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = plain_report(rows)
    for size in (1, 7, 4096):
        assert found(cr.report(cr.repair(cr.damage(df), block_rows=size))) == want


def test_audits_of_all_short_conversations():
    """Dial and the walk against the plain search for every sequence of up to four codes, cut into blocks at every place."""
    names = ["x", "s", "u", "a"]
    draw = random.Random(1)
    for _ in range(3000):
        codes = bytes(draw.randrange(12) for _ in range(draw.randrange(8)))
        turns = [(names[c // 3], c % 3 == cr.GONE, c % 3 == cr.CUT, "r", str(i)) for i, c in enumerate(codes)]
        cost, audit, _ = plain_repair(turns)
        known = cr.distances(codes, cr.CLOSING, upto_start=True)
        said, state = cr.walk(codes, known, cr.START)
        assert (known[0], said + cr.close(state)) == (cost, audit)
        cut = draw.randrange(len(codes) + 1)
        behind = cr.distances(codes[cut:], cr.CLOSING)
        ahead = cr.distances(codes[:cut], behind[:4])
        said, state = cr.walk(codes[:cut], ahead, cr.START)
        rest, state = cr.walk(codes[cut:], behind, state)
        assert said + rest + cr.close(state) == audit


def test_table_and_turns(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(cr.op12_conversation_repair(spark, SF)) == plain_report(rows)
    turns = cr.repaired_turns(cr.repair(cr.damage(table))).collect()
    said = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.order, r.at)):
        said.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("s?(ua)+", "".join(v)) for v in said.values())


def test_empty_table(spark):
    assert cr.report(cr.repair(cr.damage(spark.createDataFrame([], SCHEMA)))).count() == 0
