"""Structure repair against a search over all edits, and its chunks against one long chunk."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from meterspark.llm import conversations as c

_SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def cheapest(rows):
    """Dijkstra over (rows done, initials so far) with the edits so far as tie-break."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while True:
        cost, audit, done, initials, lines = heapq.heappop(heap)
        if done == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(lines)
        state = (done, initials[-2:] if len(initials) > 2 else initials)
        if state in seen:
            continue
        seen.add(state)
        options = [("I", 5, done, r, "") for r in ("user", "assistant")]
        if done < len(rows):
            role, text, fault = rows[done]
            extra = 5 if fault == "truncated" else 0
            options.append(("D", 2, done + 1, None, ""))
            if fault not in ("blank", "duplicate"):
                options += [("R", 1 + extra, done + 1, r, text) for r in ("user", "assistant")]
                if role:
                    options.append(("K", extra, done + 1, role, text))
        for letter, price, after, role, text in options:
            now = initials + (role[0] if role else "")
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + price, audit + letter, after, now, lines + ((f"{role}:{text}",) if role else ())))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            last = text.rstrip(_SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {t for t, *_ in own if t is not None}
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made(seed, convs=150):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "no", "", " \n", "Go on!", "a?\t", None, "w " * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in range(convs):
        for turn in range(int(rng.integers(0, 9))):
            turn = None if rng.random() < 0.05 else turn * int(rng.integers(1, 3))
            role = roles[int(rng.choice(6, p=[0.4, 0.35, 0.15, 0.04, 0.03, 0.03]))]
            rows.append((None if conv == 7 else conv, turn, role, texts[int(rng.integers(len(texts)))]))
    rows += [(1000, None, "user", "Yes.")] * 3 + [(1001, 4, "system", "Hello.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("chunk", "block"), [(128, 1 << 20), (3, 5), (2, 40)])
def test_equals_a_search_over_all_edits(spark, chunk, block):
    rows = made(chunk)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS kind", "3 AS code", "'x' AS digest", "4 AS part")
    got = {r[0]: tuple(r)[1:] for r in c.repair_conversations(frame.repartition(3), chunk=chunk, block_rows=block).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    order = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    for conv in want:
        assert dict(zip(order, got[conv])) == dict(zip(order, want[conv])), conv


def test_one_conversation_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    roles = rng.choice(["user", "assistant", "system"], 400, p=[0.5, 0.4, 0.1])
    rows = [(1, t, str(roles[t]), str(rng.choice(["Yes.", "", f"n {t}", f"m {t}!"]))) for t in range(400)] + [(2, 0, "user", "A?")]
    got = {r[0]: tuple(r)[1:] for r in c.repair_conversations(spark.createDataFrame(rows, SCHEMA), chunk=4, block_rows=16).collect()}
    assert got == expected(rows)


def test_no_rows(spark):
    assert c.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_chunks_decide_like_one_chunk(seed):
    rng = np.random.default_rng(seed)
    codes = (rng.integers(0, 4, 700) | rng.choice([0, 0, 0, c._CUT, c._BLANK, c._AGAIN], 700)).astype(np.uint8)
    ends = rng.random(700) < 0.02
    right = np.array([3, 9, 4, 1])
    whole, vector, passes = c.decide(codes, ends, right, 700)
    assert passes == 1
    for chunk in (1, 7, 64):
        letters, start, passes = c.decide(codes, ends, right, chunk)
        assert (letters == whole).all() and (start == vector).all() and passes > 1


def test_required_deletions_pass_costs_through_every_chunk():
    codes = np.full(60, c._BLANK, np.uint8)
    letters, start, passes = c.decide(codes, np.zeros(60, bool), np.array([0, 1, 6, 2]), 10)
    assert (letters == c.decide(codes, np.zeros(60, bool), np.array([0, 1, 6, 2]), 60)[0]).all()
    assert passes == 6  # no chunk forgets what follows it
    assert (start == np.array([0, 1, 6, 2])).all()


def test_transfer_equals_the_vectors():
    rng = np.random.default_rng(3)
    codes = (rng.integers(0, 4, 90) | rng.choice([0, c._CUT, c._BLANK], 90)).astype(np.uint8)
    for right in ([0, 10, 5, 0], [7, 0, 3, 3]):
        through = (c.transfer(codes, 8) + np.array(right)[:, None]).min(axis=0)
        assert (through - through.min() == c.decide(codes, np.zeros(90, bool), np.array(right), 8)[1]).all()
