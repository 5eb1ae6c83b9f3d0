"""Conversation repair against the cheapest of all edits, found by trying them."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from spreadlab.llm import repair

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, conv long, gone boolean, pointers string, fault long"
LEGAL = re.compile(r"(s?(ua)+)?")


def hurt(rows):
    out, ids = defaultdict(list), set()
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        ids.add(c)
        if kind == 1:
            x = ""
        elif kind == 2:
            x = re.sub("[.!?]", "", x)
        elif kind == 4:
            r = "user"
        if kind:
            out[c] += [(t, r, x)] * (2 if kind == 3 else 1)
    return {c: sorted(out[c], key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2])) for c in ids}


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", x)
        out.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, kinds):
    """Least (cost, audit, repaired) by memoised search over (row, what stands before); the start is ''."""

    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        after = "u" if last in ("", "s", "a") else "a"
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            c, a, out = best(i, after, inserted + 1)
            found.append((c + 2, "I" + a, ({"u": "user:", "a": "assistant:"}[after], *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = best(i + 1, last, 0)
            found.append((c + 3, "D" + a, out))
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                if role[:1] == after or (role[:1] == "s" and last == ""):
                    c, a, out = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                c, a, out = best(i + 1, after, 0)
                found.append((c + 2 + more, "R" + a, ({"u": "user:", "a": "assistant:"}[after] + text, *out)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def expected(rows):
    out = {}
    for c, said in hurt(rows).items():
        kinds = faults(said)
        turns = [t for t, *_ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        cost, audit, lines = cheapest(said, kinds)
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        out[c] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unit", "", None])
            text = rng.choice(["Yes.", "No", "why?", " \n", "", None, "größer!  ", f"turn {t}.", "a\nb."])
            rows.append((rng.choice([c, c, c, c, None]) if rng.random() < 0.02 else c, rng.choice([t, t, t, 2 * t, None]), role, text))
    rows += [(None, None, None, None), (None, 3, "user", "x."), (7, 10**12, "user", "x."), (7, 1, "user", "x " * 200_000 + ".")]
    return rows + rows[:3]


def repaired(spark, rows, parts=3, **params):
    df = spark.createDataFrame([(*r, 9, False, "p", 5) for r in rows], SCHEMA).repartition(parts)
    hurt_rows = repair.damaged(df)
    assert hurt_rows.columns == ["conv_id", "turn", "role", "text", "gone"]
    return {r[0]: tuple(r)[1:] for r in repair.repair(hurt_rows, gone="gone", **params).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_edits(spark, seed):
    rows = conversations(seed, 250)
    assert repaired(spark, rows) == expected(rows)


def test_spilled_pointers_give_the_same_audit(spark):
    rng = random.Random(3)
    rows = conversations(4, 15) + [(900, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(120)]
    want = expected(rows)
    assert repaired(spark, rows, spill_rows=2) == want == repaired(spark, rows, parts=1, spill_rows=7)


def test_batches_of_a_few_rows_carry_the_state(spark):
    rows = conversations(5, 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert repaired(spark, rows, parts=1) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dropped_conversation_and_empty_table(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(*gone, "user", "Hi.")]) == {gone[0]: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repaired(spark, []) == {}
