import hashlib
import random
import zlib
from functools import cache

import pytest

from loglathe.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, part string, cost int"
WHITE = " \t\n\x0b\x0c\r"


def _cheapest(rows):
    """(cost, audit, repaired rows) by dynamic programming over all edits; rows are (role, text, fault)."""

    def follow(state, initial):
        if initial == "s":
            return "s" if state == "" else None
        if initial == "u":
            return "u" if state != "u" else None
        return "a" if initial == "a" and state == "u" else None

    @cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        made = "assistant" if state == "u" else "user"
        if inserts < 3:
            c, a, r = best(i, made[0], inserts + 1)
            ways.append((c + 3, "I" + a, ((made, ""), *r)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, r = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if follow(state, role[:1]):
                    c, a, r = best(i + 1, follow(state, role[:1]), 0)
                    ways.append((c + more, "K" + a, ((role, text), *r)))
                c, a, r = best(i + 1, made[0], 0)
                ways.append((c + 3 + more, "R" + a, ((made, text), *r)))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # keeps the recursion shallow
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def _plain(rows):
    """The contract, row by row."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        held = convs.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        held += [((turn is not None, turn or 0), "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort()
        turns = [t for (has, t), *_ in held if has]
        seen, marked, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
        for _, role, text in held:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
            n[fault] += 1
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, left = _cheapest(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def _rows(seed, convs=120):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Ua"]
    texts = ["yes.", "no!", "ok", "why?", "", None, " \t", "a. ", ". x", "long text. \n", "é?", "b  "]
    rows = []
    for conv in range(convs):
        tidy = r.random() < 0.5
        for i in range(r.choice([1, 2, 3, 5, 8, 8, 14])):
            role = ("system" if i == 0 and r.random() < 0.3 else ("user", "assistant")[i % 2]) if tidy else r.choice(roles)
            text = f"turn {i}." if tidy and r.random() < 0.8 else r.choice(texts)
            rows.append((conv if conv else None, r.choice([i, i, i, i * 2, None]), role, text, "x", 1))
    # a long conversation over many chunks, one of one turn only, and one row very often
    rows += [(5000, i if i % 50 else None, r.choice(roles[:6]), r.choice(texts) if r.random() < 0.2 else f"t {i}{r.choice('.! ')}", "x", 1) for i in range(700)]
    rows += [(5001, 7, r.choice(roles), f"t {i}.", "x", 1) for i in range(150)]
    rows += [(5002, 3, "user", "same.", "x", 1)] * 300
    rows += [(5003, t, "user", "same.", "x", 1) for t in range(200)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_edits(spark, tmp_path, seed):
    rows = _rows(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_repair"](spark, str(tmp_path)).collect()}
    want = _plain(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repaired_rows_have_the_digest(spark):
    rows = _rows(3)
    df = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    convs = {}
    for x in sorted(repair.repaired_rows(df).collect(), key=lambda x: (x.part, x.no, x.place)):
        convs.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    for conv, (*_, digest) in _plain(rows).items():
        assert hashlib.sha256("\n".join(convs.get(conv, [])).encode()).hexdigest() == digest


def test_auction_finds_every_distance():
    r = random.Random(4)
    for _ in range(400):
        steps = tuple((k, r.randint(1, 3) if k == repair.FORCED else 1) for k in r.choices(range(9), k=r.randint(1, 7)))
        costs = repair.transfer(steps)
        for state in range(4):
            for leave in (repair.ACCEPTED, (None, None, 5, 2), (1, 4, None, 3)):
                # a chunk that is not the last, by its costs from state to state
                ways = [costs[4 * state + e] + leave[e] for e in range(4) if costs[4 * state + e] is not None and leave[e] is not None]
                assert repair.cheapest(steps, state, leave, False)[0] == min(ways)
        names = ["system", "user", "assistant", "tool"]
        rows = []
        for k, n in steps:
            rows += [(names[k % 4], "x", "blank" if k == repair.FORCED else "truncated" if k >= 4 else "")] * n
        cost, audit, _ = _cheapest(tuple(rows))
        got_cost, letters = repair.cheapest(steps, 0, repair.ACCEPTED, True)
        copies = iter(n for _, n in steps)
        assert (got_cost, "".join(x if x == "I" else x * next(copies) for x in letters)) == (cost, audit)


def test_empty(spark):
    assert repair.summaries(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
