"""Operator 11: conversation structure repair along the tight arcs of an edit graph.

A conversation is a path through a graph whose nodes are (rows read, state of
the pattern). Costs from the start and costs to the end tell which arcs lie on a
cheapest path; from the start, the set of nodes that the edits so far lead to is
moved on by the least letter of such an arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import STRIP, broadcast_to, forget, small_batches, written

#: Rows and code points of a segment, the unit in which a long conversation is worked on.
ROWS, CHARS = 1024, 1 << 22
#: Keys of texts seen at several turns, and open segments, that may be broadcast.
BROADCAST = 500_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_FAR = 1 << 50
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. A state's own edit to u or a leads to _TO.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_TO = (2, 2, 3, 2)
_ENDS = (0, 3)
_ROLE = {2: "user", 3: "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: What a segment tells about its turns and roles, to be put together in order.
_STATS = "lo long, hi long, turns long, tail_turn long, blank long, duplicate long, truncated long, illegal long, head string, tail string"


def arcs(item: tuple, q: int) -> list[tuple[str, int, int]]:
    """(letter, state, cost) of the edits that read an item in state q, in the order of the letters. An item is (rows to delete,) or (role's initial, whether truncated)."""
    if len(item) == 1:
        return [("D" * item[0], q, DELETE * item[0])]
    more = TRUNCATED * item[1]
    kept = q if item[0] == "" else _STEP.get((q, item[0]))
    out = [("D", q, DELETE), ("R", _TO[q], REROLE + more)]
    return out if kept is None else [out[0], ("K", kept, KEEP + more), out[1]]


def _inserted(cost: list[int]) -> list[int]:
    """Costs of the states of one node layer after edits that read nothing."""
    two = min(cost[2], min(cost[0], cost[1], cost[3]) + INSERT)
    return [cost[0], cost[1], two, min(cost[3], two + INSERT)]


def _insertable(cost: list[int]) -> list[int]:
    """Costs to the end of the states of one layer, with edits that read nothing before."""
    three = min(cost[3], cost[2] + INSERT)
    two = min(cost[2], three + INSERT)
    return [min(cost[0], two + INSERT), min(cost[1], two + INSERT), two, min(three, two + INSERT)]


def forward(items: list[tuple], before: list[int]) -> list[list[int]]:
    """Least costs from the start of each layer's states, inserts included but for those of the last layer."""
    layers = [list(before)]
    for item in items:
        here = layers[-1] = _inserted(layers[-1])
        after = [_FAR] * 4
        for q in range(4):
            if here[q] < _FAR:
                for _, to, cost in arcs(item, q):
                    after[to] = min(after[to], here[q] + cost)
        layers.append(after)
    return layers


def backward(items: list[tuple], after: list[int]) -> list[list[int]]:
    """Least costs to the end of each layer's states; after: of the last layer, inserts included."""
    layers = [list(after)]
    for item in reversed(items):
        layers.append(_insertable([min(cost + layers[-1][to] for _, to, cost in arcs(item, q)) for q in range(4)]))
    return layers[::-1]


def end_costs() -> list[int]:
    return _insertable([0 if q in _ENDS else _FAR for q in range(4)])


def steps(items: list[tuple]) -> list[list[int]]:
    """Least costs of a segment from each state to each."""
    return [forward(items, [0 if q == p else _FAR for q in range(4)])[-1] for p in range(4)]


def through(cost: list[int], matrix: list[list[int]]) -> list[int]:
    return [min(cost[p] + matrix[p][q] for p in range(4)) for q in range(4)]


def back_through(matrix: list[list[int]], cost: list[int]) -> list[int]:
    return [min(matrix[p][q] + cost[q] for q in range(4)) for p in range(4)]


def traverse(items: list[tuple], start: int, before: list[int], after: list[int], last: bool) -> tuple[list[tuple[int, str, int]], int]:
    """The edits (items read so far, letters, state after them) by the least letter at each step, and the state at the end.

    Only tight arcs are taken: cost from the start, the arc's own and the cost
    to the end add up to the least. The inserts of the last layer belong to the
    next segment, if there is one.
    """
    ahead, behind = forward(items, before), backward(items, after)
    ahead[-1] = _inserted(ahead[-1])
    best = min(a + b for a, b in zip(ahead[0], behind[0], strict=True))
    out, i, front = [], 0, {start}
    while True:
        moves = [(letter, i + 1, to, cost, q) for q in front for letter, to, cost in arcs(items[i], q)] if i < len(items) else []
        if i < len(items) or last:
            moves += [("I", i, _TO[q], INSERT, q) for q in front]
        tight = [(letter, j, to) for letter, j, to, cost, q in moves if ahead[i][q] + cost + behind[j][to] == best]
        if not tight:
            return out, min(front)
        letter = min(t[0] for t in tight)
        (j,) = {j for at, j, _ in tight if at == letter}
        front = {to for at, _, to in tight if at == letter}
        out.append((i, letter, min(front)))
        i = j


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows of a conversation after the damage, equal ones once with their number.

    The damage is chosen by crc32 of "conv_id:turn" modulo 20 (see README); a
    conversation of which it leaves nothing keeps one row with n = 0.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    here = lambda c: F.when(h != 0, c)
    text = F.when(h == 1, "").when(h == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    out = rows.select("conv_id", here(F.col("turn").cast("long")).alias("turn"), here(F.when(h == 4, "user").otherwise(word("role"))).alias("role"), here(text).alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("n"))
    return out.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))


def as_they_are(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) without damage, nulls of role and text as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role"), word("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))


def with_faults(rows: DataFrame, most: int = BROADCAST) -> DataFrame:
    """rows with kind: blank, again (role and text stand at an earlier turn), truncated, fine, or none where n is 0.

    Only roles and texts that stand at several turns of a conversation are
    looked up; they are found by a partial aggregation over hashes.
    """
    (th, th2), order = (F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = rows.withColumns({"th": th, "th2": th2})
    filled = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    several = keyed.filter(filled).groupBy("conv_id", "role", "th", "th2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    several = written(several.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("th").alias("_h"), F.col("th2").alias("_h2"), "first"), "repeated_turns")
    met = keyed.join(broadcast_to(several, several.count(), most), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("th") == F.col("_h")) & (F.col("th2") == F.col("_h2")), "left")
    later = F.coalesce(~order.eqNullSafe(F.col("first")) & F.col("_r").isNotNull(), F.lit(False))
    last = F.right(F.rtrim(F.col("text"), F.lit(STRIP)), F.lit(1))
    kind = F.when(F.col("n") == 0, "none").when(~filled, "blank").when(later, "again").when(~last.isin(".", "!", "?"), "truncated").otherwise("fine")
    return met.select("conv_id", "turn", "role", "text", "n", kind.alias("kind"))


class _Segment:
    """Rows of one conversation in order, as they come."""

    def __init__(self, conv: Any, k: int) -> None:
        self.conv, self.k, self.rows, self.chars, self.last_turn = conv, k, [], 0, None
        self.stats = {"lo": None, "hi": None, "turns": 0, "tail_turn": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": None, "tail": None}

    def add(self, turn: int | None, role: str | None, text: str | None, n: int, kind: str) -> None:
        if kind == "none":
            return
        s = self.stats
        self.rows.append((role, text, n, kind))
        self.chars += len(text)
        if turn is not None and turn != s["tail_turn"]:
            s["turns"] += 1
            s["lo"] = turn if s["lo"] is None else s["lo"]
            s["hi"] = s["tail_turn"] = turn
        s["blank"] += n if kind == "blank" else 0
        s["duplicate"] += n if kind == "again" else 0 if kind == "blank" else n - 1
        s["truncated"] += kind == "truncated"
        one = role[:1]
        s["illegal"] += (n - 1) + (s["tail"] is not None and s["tail"] + one not in ("su", "ua", "au"))
        s["head"] = one if s["head"] is None else s["head"]
        s["tail"] = one


def items_of(rows: list[tuple]) -> tuple[list[tuple], list[int]]:
    """The items of rows (role, text, n, kind), and the row of each."""
    items, at = [], []
    for i, (role, _, n, kind) in enumerate(rows):
        if kind in ("fine", "truncated"):
            items.append((role[:1], kind == "truncated"))
            at.append(i)
        if copies := n if kind in ("blank", "again") else n - 1:
            items.append((copies,))
            at.append(i)
    return items, at


def edited(rows: list[tuple], start: int, before: list[int], after: list[int], last: bool) -> tuple[int, str, str]:
    """State at the end, letters, and the repaired rows joined by newlines."""
    items, at = items_of(rows)
    edits, state = traverse(items, start, before, after, last)
    lines = []
    for i, letter, to in edits:
        if letter == "I":
            lines.append(f"{_ROLE[to]}:")
        elif letter[0] != "D":
            role, text, *_ = rows[at[i]]
            lines.append(f"{role if letter == 'K' else _ROLE[to]}:{text}")
    return state, "".join(letter for _, letter, _ in edits), "\n".join(lines)


def _start() -> list[int]:
    return [0, _FAR, _FAR, _FAR]


def segments(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """Conversations in segments: whole ones with their result, the others as lists of rows with the costs between states.

    Rows are dealt by range of (conv_id, turn, role, text), so that a long
    conversation is spread over tasks, and cut into segments where a task ends,
    or at most_rows rows or most_chars code points.
    """
    keys = ["conv_id", "turn", "role", "text"]
    kind_of = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind_of}, part int, k long, whole boolean, cost long, audit string, repaired_sha256 string, {_STATS}, matrix array<long>, role array<string>, text array<string>, n array<long>, kind array<string>"
    small_batches(rows.sparkSession)

    def done(s: _Segment, part: int, whole: bool) -> dict:
        out = {"conv_id": s.conv, "part": part, "k": s.k, "whole": whole, **s.stats}
        if whole:
            items = items_of(s.rows)[0]
            total = min(a + b for a, b in zip(_start(), backward(items, end_costs())[0], strict=True))
            _, audit, text = edited(s.rows, 0, _start(), end_costs(), True)
            return out | {"cost": total, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        lists = {c: [r[i] for r in s.rows] for i, c in enumerate(("role", "text", "n", "kind"))}
        return out | lists | {"matrix": [x for row in steps(items_of(s.rows)[0]) for x in row]}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, k, open_left, now = TaskContext.get().partitionId(), [], 0, True, None
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = None

        def rows_out() -> pa.RecordBatch:
            nonlocal held
            table = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], kinds[c]) for c in names], names=names)
            held = []
            return table

        size = 0
        for b in batches:
            if kinds is None:
                long, text = pa.int64(), pa.string()
                kinds = {c: long for c in names} | {c: text for c in ("audit", "repaired_sha256", "head", "tail")} | {"conv_id": b.schema.field("conv_id").type, "part": pa.int32(), "whole": pa.bool_(), "matrix": pa.list_(long), "n": pa.list_(long)} | {c: pa.list_(text) for c in ("role", "text", "kind")}
            for conv, *row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "kind")], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        held.append(done(now, part, not open_left))
                        size += now.chars
                        open_left, k = False, k + 1
                    now = _Segment(conv, k)
                elif len(now.rows) >= most_rows or now.chars >= most_chars:
                    held.append(done(now, part, False))
                    size += now.chars
                    open_left, k = True, k + 1
                    now = _Segment(conv, k)
                now.add(*row)
                if size > most_chars or len(held) > 1000:
                    yield rows_out()
                    size = 0
        if now is not None:  # the conversation may go on in the next task
            held.append(done(now, part, False))
        if held:
            yield rows_out()

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(cut, schema)


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")


def bounds(cut: DataFrame) -> DataFrame:
    """(part, k, before, after, last): the least costs from a conversation's start to each of its segments, and from there to its end.

    A row of costs for each segment goes to one task for each conversation, a
    thousandth of its rows.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(group: list[tuple]) -> pa.RecordBatch:
            square = [[list(m[i : i + 4]) for i in range(0, 16, 4)] for *_, m in group]
            before, after = [_start()], [end_costs()]
            for m in square[:-1]:
                before.append(through(before[-1], m))
            for m in reversed(square[1:]):
                after.append(back_through(m, after[-1]))
            n = len(group)
            return pa.record_batch([pa.array([g[1] for g in group], pa.int32()), pa.array([g[2] for g in group], pa.int64()), pa.array(before, pa.list_(pa.int64())), pa.array(after[::-1], pa.list_(pa.int64())), pa.array([i == n - 1 for i in range(n)])], names=["part", "k", "before", "after", "last"])

        group: list[tuple] = []
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "part", "k", "matrix")], strict=True):
                if group and row[0] != group[-1][0]:
                    yield ended(group)
                    group = []
                group.append(row)
        if group:
            yield ended(group)

    return _by_conversation(cut.select("conv_id", "part", "k", "matrix")).mapInArrow(scanned, "part int, k long, before array<long>, after array<long>, last boolean")


def _walked(cut: DataFrame, kind_of: str) -> DataFrame:
    """For each segment and each state at its start that a cheapest path may have: the state at its end, letters and repaired rows."""
    own = [x.split()[0] for x in _STATS.split(", ")]
    schema = f"conv_id {kind_of}, part int, k long, start int, finish int, cost long, audit string, text string, {_STATS}"
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                rows = list(zip(r["role"], r["text"], r["n"], r["kind"], strict=True))
                behind = backward(items_of(rows)[0], r["after"])[0]
                total = min(x + y for x, y in zip(_inserted(r["before"]), behind, strict=True))
                for q in range(4):
                    if r["before"][q] + behind[q] == total:
                        state, audit, text = edited(rows, q, r["before"], r["after"], r["last"])
                        out.append((r["conv_id"], r["part"], r["k"], q, state, total, audit, text, *[r[c] for c in own]))
            kinds = [b.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.string() if c in ("head", "tail") else pa.int64() for c in own]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(len(names))], names=names)

    return cut.mapInArrow(walk, schema)


def _joined(walked: DataFrame, kind_of: str) -> DataFrame:
    """One row for each conversation from its segments in order, hashed as they come: no task holds a conversation's text."""
    own = [x.split()[0] for x in _STATS.split(", ")]
    schema = f"conv_id {kind_of}, cost long, audit string, repaired_sha256 string, {_STATS}"
    names = [x.split()[0] for x in schema.split(", ")]

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([now["conv_id"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest(), *[now[c] for c in own]], kinds, strict=True)], names=names)

        for b in batches:
            kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), *[pa.string() if c in ("head", "tail") else pa.int64() for c in own]]
            for r in b.to_pylist():
                if now is None or r["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield row()
                    now = {"conv_id": r["conv_id"], "cost": r["cost"], "audit": [], "hash": hashlib.sha256(), "state": 0, "any": False, "at": None} | {c: None if c in ("lo", "hi", "tail_turn", "head", "tail") else 0 for c in own}
                if (r["part"], r["k"]) == now["at"] or r["start"] != now["state"]:
                    continue  # another start of a segment that has been taken, or of this one
                now["at"], now["state"] = (r["part"], r["k"]), r["finish"]
                now["audit"].append(r["audit"])
                if r["text"]:
                    now["hash"].update((b"\n" if now["any"] else b"") + r["text"].encode())
                    now["any"] = True
                now["turns"] += r["turns"] - (r["lo"] is not None and r["lo"] == now["tail_turn"])
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += r[c]
                if r["head"] is not None:
                    now["illegal"] += now["tail"] is not None and now["tail"] + r["head"] not in ("su", "ua", "au")
                    now["tail"] = r["tail"]
                if r["lo"] is not None:
                    now["lo"] = r["lo"] if now["lo"] is None else now["lo"]
                    now["hi"] = now["tail_turn"] = r["hi"]
        if now is not None:
            yield row()

    return _by_conversation(walked).mapInArrow(assembled, schema)


def repair(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS, most: int = BROADCAST) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows (conv_id, turn, role, text, n); see damaged() and as_they_are().

    Rows stand by turn, null turns first, then by role and text (ties); n equal
    ones stand side by side, all but the first as duplicates. An empty role has
    no initial, so that keeping it changes nothing. A null conv_id is one
    conversation. A row of n = 0 stands for a conversation without rows: zeros,
    an empty audit, the hash of an empty text. Conversations of any length are
    worked on in segments; one row's text is held whole. An empty table gives an
    empty result; other columns are not looked at.
    """
    spark, kind_of = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    held = written(rows.select("conv_id", "turn", "role", "text", "n"), "conversation_rows")
    cut = written(segments(with_faults(held, most), most_rows, most_chars), "conversation_segments")
    forget(held)
    finished = ["conv_id", "cost", "audit", "repaired_sha256", *[x.split()[0] for x in _STATS.split(", ")]]
    unfinished = cut.filter("not whole").drop("audit", "cost")
    small_batches(spark)
    costs = written(bounds(unfinished), "conversation_bounds")
    split = _joined(_walked(unfinished.join(broadcast_to(costs, costs.count(), most), ["part", "k"]), kind_of), kind_of)
    out = cut.filter("whole").select(*finished).unionByName(split.select(*finished))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return out.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
