"""Operator 11 against plain versions: every edit sequence of small conversations, and a table of costs and strings for larger ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from skyquad.llm import common, conversation

SF = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """conv_id -> rows (turn, role, text) after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        got = out.setdefault(conv, [])
        role, text = word(role), word(text)
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            got += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for got in out.values():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        out.append("blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANK)[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired rows) by the least (cost, audit) of what follows each row and last initial."""
    kinds = faults(rows)

    @cache
    def rest(i, q, idle):
        found = [(0, "", ())] if i == len(rows) and q in ("", "a") else []

        def go(cost, letter, line, to, j, idle=0):
            c, a, lines = rest(j, to, idle)
            found.append((cost + c, letter + a, (*line, *lines)))

        for role in ("user", "assistant"):
            if (q, role[0]) in NEXT and idle < 3:
                go(2, "I", (f"{role}:",), role[0], i, idle + 1)
            if i < len(rows) and kinds[i] in ("", "truncated") and (q, role[0]) in NEXT:
                go(2 + (kinds[i] == "truncated"), "R", (f"{role}:{rows[i][2]}",), role[0], i + 1)
        if i < len(rows):
            go(3, "D", (), q, i + 1)
            one = rows[i][1][:1]
            if kinds[i] in ("", "truncated") and (not one or (q, one) in NEXT):
                go(kinds[i] == "truncated", "K", (f"{rows[i][1]}:{rows[i][2]}",), one and NEXT[q, one] or q, i + 1)
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def every(rows):
    """(cost, audit) over all edit sequences with up to two inserts at each place."""
    kinds, found = faults(rows), []
    for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        for acts in itertools.product("DKua", repeat=len(rows)):
            if any(a != "D" and k in ("blank", "duplicate") for a, k in zip(acts, kinds, strict=True)):
                continue
            roles, audit, cost = inserts[0], "I" * len(inserts[0]), 2 * len(inserts[0])
            for (_, role, _), kind, a, more in zip(rows, kinds, acts, inserts[1:], strict=True):
                cost += 3 if a == "D" else (kind == "truncated") + 2 * (a != "K")
                roles += "" if a == "D" else role[:1] if a == "K" else a
                audit += a if a in "DK" else "R"
                roles, audit, cost = roles + more, audit + "I" * len(more), cost + 2 * len(more)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def wanted(rows):
    out = {}
    for conv, got in damage(rows).items():
        kinds, turns = faults(got), {t for t, *_ in got if t is not None}
        first = [r[:1] for _, r, _ in got]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        cost, audit, lines = cheapest(got)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_conversation(conversation.op11_conversation_repair(spark, SF)) == wanted(rows)


def random_rows(seed, conversations, length):
    r = random.Random(seed)
    texts = ["one.", "two!", "three", "", " \n", "four? ", "five", None, "six."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", ""]
    return [(c, r.choice([t, t, t, t + 5, None]), r.choice(roles), r.choice(texts) if r.random() < 0.3 else f"text {r.randrange(400)}{r.choice(['.', '', '?'])}") for c in range(conversations) for t in range(r.randrange(1, length))]


@pytest.mark.parametrize(("most_rows", "most"), [(1024, 10**6), (2, 10**6), (3, 0)])
def test_segments_change_nothing(spark, most_rows, most):
    """Whole conversations, and ones cut into segments of two or three rows, by broadcast and by shuffle."""
    rows = random_rows(4, 60, 14) + [(None, 1, "user", "no id"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert by_conversation(conversation.repair(conversation.damaged(docs), most_rows, 1 << 20, most)) == wanted(rows)


def test_every_edit_sequence_of_small_conversations():
    r = random.Random(2)
    for _ in range(60):
        rows = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", "", f"c{i}."])) for i in range(r.randrange(1, 4))]
        kinds = ["again" if k == "duplicate" else k or "fine" for k in faults(rows)]
        want = every(rows)
        assert cheapest(rows)[:2] == want
        state, audit, _ = conversation.edited([(role, text, 1, k) for (_, role, text), k in zip(rows, kinds, strict=True)], 0, conversation._start(), conversation.end_costs(), True)
        assert audit == want[1] and state in (0, 3)


def test_a_long_conversation_and_many_equal_rows(spark):
    rows = [("long", t, ("user", "assistant")[t % 2 if t % 50 else 1], f"line {t}.") for t in range(4000)] + [("same", 3, "user", "again and again.")] * 500 + [("same", t, "user", "again and again.") for t in range(4, 30)]
    docs = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = by_conversation(conversation.repair(conversation.as_they_are(docs), 100))
    kept = [(t, r, x) for _, t, r, x in rows[:4000]]
    assert got["same"][1:6] == (0, 525, 0, 525, 3 * 525 + 2) and got["same"][6] == "K" + "D" * 525 + "I"
    assert got["long"][5] == conversation.backward([(r[:1], False) for _, r, _ in kept], conversation.end_costs())[0][0] and len(got["long"][6]) >= 4000


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.repair(conversation.damaged(empty)).collect() == []
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    long = "x y. " * 200_000
    wide = spark.createDataFrame([(gone, 0, "user", "hello.", "k", 1), (None, None, None, None, None, None), (7, 5, "user", long, "k", 2), (7, 6, "assistant", "fine.", "k", 3)], "conv_id long, turn long, role string, text string, kind string, n long")
    rows = [tuple(r)[:4] for r in wide.collect()]
    got = by_conversation(conversation.repair(conversation.damaged(common.written(wide, "odd"))))
    assert got == wanted(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
