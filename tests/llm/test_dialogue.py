"""Repair of conversations against an exhaustive search, and its odd cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from boxloom.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, uid string, seg int, conv int"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if way == 1:
            text = ""
        elif way == 2:
            text = re.sub("[.!?]", "", text)
        elif way == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, lines) of the ordered (role, text) rows of a conversation."""
    faults, seen = [], set()
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    n, queue = len(rows), [(0, "", 0, "", ())]
    done = set()
    while queue:  # uniform cost, then by the audit; every role is tried, no state is thought of as known
        cost, audit, i, said, lines = heapq.heappop(queue)
        if (i, said[-1:], len(said) > 0 and said == "s") in done and i < n:
            continue
        if i == n and re.fullmatch("(s?(ua)+)?", said):
            return *(faults.count(f) for f in "bdt"), illegal, cost, audit, lines
        done.add((i, said[-1:], said == "s"))
        more = []
        for role in ("user", "assistant"):
            more.append((cost + 2, audit + "I", i, said + role[0], (*lines, f"{role}:")))
        if i < n:
            role, text = rows[i]
            extra = faults[i] == "t"
            more.append((cost + 3, audit + "D", i + 1, said, lines))
            if faults[i] not in ("b", "d"):
                more.append((cost + extra, audit + "K", i + 1, said + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                more += [(cost + 2 + extra, audit + "R", i + 1, said + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        for state in more:
            if re.fullmatch("(s?(ua)*u?)?", state[3]):
                heapq.heappush(queue, state)
    raise AssertionError("no repair")


def plain_results(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        kept = [r for r in plain_damage(rows) if r[0] == conv]
        kept.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        turns = {r[1] for r in kept if r[1] is not None}
        b, d, t, illegal, cost, audit, lines = plain_repair([r[2:] for r in kept])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, b, d, t, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def talk(rng, conv, n):
    texts = ["Yes.", "No", "  ", "Why?", "ok!", "", "a longer text.\nof two lines. ", "日本。"]
    rows = []
    for i in range(n):
        role = rng.choice(["system", None, "", "tool", "user", "assistant"]) if rng.random() < 0.25 else ("user", "assistant")[i % 2]
        turn = None if rng.random() < 0.05 else i if rng.random() < 0.9 else rng.randint(0, n + 3)
        rows.append((conv, turn, role, None if rng.random() < 0.05 else f"{rng.choice(texts)} {rng.choice(['', '', f'x{i}.'])}"))
    return rows


def run(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "x", 7, 9) for r in rows], SCHEMA)
    return {r["conv_id"]: tuple(r)[1:] for r in dialogue.damaged_repairs(table, **kw).collect()}


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randint(1, 7))] + talk(rng, None, 6)
    rows += [(500, None, None, None), (501, 0, "user", "word " * 40_000), (502, 3, "system", "Alone."), (503, 1, "user", "Same."), (503, 1, "user", "Same.")]
    want = plain_results(rows)
    got = run(spark, rows)
    assert got == want
    assert len(got) == 65


def test_short_segments_give_the_same(spark):
    rng = random.Random(8)
    rows = [r for conv in range(12) for r in talk(rng, conv, rng.randint(1, 16))]
    assert run(spark, rows, segment=3, fan=2) == plain_results(rows)


def test_search_equals_exhaustive_search():
    rng = random.Random(1)
    for _ in range(200):
        rows = [r[2:] for r in plain_damage(talk(rng, 1, rng.randint(0, 8)))]
        b, d, t, illegal, cost, audit, _ = plain_repair(rows)
        seen, codes = set(), ""
        for role, text in rows:
            last = text.rstrip(dialogue.SPACES)[-1:]
            codes += dialogue.code(role[:1], dialogue.BLANK if not last else dialogue.DUPLICATE if (role, text) in seen else dialogue.TRUNCATED if last not in ".!?" else dialogue.FINE)
            seen.add((role, text))
        got = dialogue.cheapest(codes)
        assert (got[0], dialogue.audit_of(got[1])) == (cost, audit), codes


def test_segments_of_every_entry_and_end_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(chr(65 + rng.randrange(16)) for _ in range(rng.randint(2, 30)))
        cuts = sorted({0, len(codes), *(rng.randrange(1, len(codes)) for _ in range(3))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        found = [dialogue.searched(p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)]
        way = dialogue.route([dialogue.Node(c, r) for c, r, _ in found], dialogue.START, dialogue.END)
        script = "".join(f[2][s * 5 + t] for f, (s, t) in zip(found, way))
        cost = sum(f[0][s * 5 + t] for f, (s, t) in zip(found, way))
        assert (cost, script) == dialogue.cheapest(codes), codes


def test_long_segment_ends():
    rng = random.Random(4)
    codes = "".join(rng.choice("EFEFEFFFABIMQ") for _ in range(dialogue.SEGMENT))
    assert all(len(re.findall("[DKUA]", s)) == len(codes) for s in dialogue.searched(codes, False, False)[2] if s)


def test_repaired_rows(spark):
    table = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hello?"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    lines = dialogue.repair(table).lines().orderBy("uid", "at").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in lines] == [("system", "Be kind.", "K"), ("user", "Hi!", "K"), ("assistant", "Hello?", "R")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.damaged_repairs(empty).collect() == []
