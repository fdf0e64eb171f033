"""Conversation repair against exhaustive search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tableflow.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """(alive rows by conversation, in order); every conversation has an entry."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]  # noqa: B018
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(r, key=order) for c, r in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(SPACE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, marks):
    """(cost, audit, turns) of all edits with at most one empty turn before a
    row and two behind the last."""
    def go(k, turns, cost, audit):
        if k == len(rows):
            for extra in range(3):
                for more in itertools.product(("user", "assistant"), repeat=extra):
                    done = [*turns, *[(r, "") for r in more]]
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "#" for r, _ in done)):
                        yield cost + 3 * extra, audit + "I" * extra, done
            return
        _, role, text = rows[k]
        yield from go(k + 1, turns, cost + 4, audit + "D")
        if marks[k] not in ("blank", "duplicate"):
            add = 3 if marks[k] == "truncated" else 0
            for before in ((), ("user",), ("assistant",)):
                head, c = [*turns, *[(r, "") for r in before]], cost + 3 * len(before) + add
                yield from go(k + 1, [*head, (role, text)], c, audit + "I" * len(before) + "K")
                for new in ("user", "assistant"):
                    yield from go(k + 1, [*head, (new, text)], c + 3, audit + "I" * len(before) + "R")

    return go(0, [], 0, "")


def expected(rows):
    marks = faults(rows)
    cost, audit, turns = min(every_repair(rows, marks), key=lambda x: (x[0], x[1]))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha


def some_rows(seed, conversations, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "  ", "", None, "One. Two", "So it is.\n", "a　"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for c in range(conversations):
        for k in range(r.randrange(1, longest + 1)):
            rows.append((None if c == 3 else c, None if r.random() < 0.1 else k + r.randrange(2), r.choice(roles), r.choice(texts)))
    for c in range(conversations, conversations + 20):
        rows += [(c, k, role, f"{c} {k}.") for k, role in enumerate(["system", "user", "assistant"][c % 2 :])]
    return rows


def test_repairs_equal_exhaustive_search(spark):
    rows = some_rows(5, 160, 4)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {g.conv_id: tuple(g[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for g in repair.repair_report(repair.damaged(df), F.col("alive")).collect()}
    want = {c: expected(r) for c, r in damage(rows).items()}
    assert got == want
    assert any(x[5] == 0 and x[6] for x in want.values()) and any(not x[6] for x in want.values())


def test_segments_do_not_change_the_edits(monkeypatch):
    r = random.Random(8)
    for _ in range(300):
        kinds = bytes(r.randrange(12) for _ in range(r.randrange(12)))
        whole = repair.cheapest(kinds)
        monkeypatch.setattr(repair, "SEGMENT", r.randrange(1, 5))
        assert repair.cheapest(kinds) == whole
        monkeypatch.undo()


def test_long_conversation(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(3000)]
    turns[2000] = (1, 2000, "assistant", "Turn 2000.")
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = repair.repair_report(df).first()
    assert (got.cost, got.audit) == (3, "K" * 2000 + "R" + "K" * 999)
    spoken = repair.repaired_turns(df).orderBy("position").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in spoken).encode()).hexdigest() == got.repaired_sha256
    assert [t.position for t in spoken] == list(range(3000)) and spoken[2000].edit == "R"


@pytest.mark.parametrize("roles,audit,cost", [(["user"], "KI", 3), (["system"], "D", 4), (["assistant"], "IK", 3), (["user", "user", "assistant"], "DKK", 4), (["system", "user", "assistant"], "KKK", 0)])
def test_small_cases(spark, roles, audit, cost):
    rows = [(7, k, role, f"Text {k}.") for k, role in enumerate(roles)]
    got = repair.repair_report(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert (got.cost, got.audit) == min([(cost, audit), (got.cost, got.audit)])
    assert expected([r[1:] for r in rows])[5:7] == (got.cost, got.audit)


def test_empty_and_clashing_names(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, `alive` string, cost string, `a.b` int, kind int, audit string, digest string"
    assert repair.repair_report(repair.damaged(spark.createDataFrame([], schema)), F.col("alive")).count() == 0
    row = (1, 5, "user", "Hello there.", "x", "y", 1, 2, "z", "w")
    assert repair.repair_report(spark.createDataFrame([row, row], schema)).first().duplicate == 1
