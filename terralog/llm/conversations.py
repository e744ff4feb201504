"""Conversation structure repair: the cheapest edits as the lightest derivation over (rows read, state) items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import batches
from terralog.session import freeze

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
FOLLOW = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled message leads from each state
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
SEGMENT_ROWS = 1024  # rows and characters of one conversation that are repaired at once
SEGMENT_CHARS = 4 << 20

Row = tuple[str, int, int]  # initial of the role, fault, copies
Weight = tuple[int, str]


def lightest(rows: Sequence[Row], entry: int, goals: Iterable[int], first_only: bool) -> dict[int, Weight]:
    """Least (cost, audit) with which the rows lead from the ``entry`` state to each of the ``goals``.

    Items are (rows read, state).  Deductions keep, rerole, delete or insert, and their weights are superior functions:
    the cost only grows and the audit is only appended to, so the agenda pops items in the order of their final weights,
    and an item is final when it is popped (``first_only``: the first goal ends the search).  Copies of a row are
    deleted with it, right behind it; an insertion between them would not come before "D".
    """
    goals, found, final = set(goals), {}, set()
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    while agenda:
        cost, audit, at, state = heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(rows):
            if state in goals:
                found[state] = (cost, audit)
                if first_only or len(found) == len(goals):
                    break
        else:
            initial, fault, copies = rows[at]
            gone, spent, late = "D" * (copies - 1), cost + DELETE * (copies - 1), CUT_OFF if fault == TRUNCATED else 0
            heappush(agenda, (spent + DELETE, audit + "D" + gone, at + 1, state))
            if fault not in (BLANK, DUPLICATE):
                heappush(agenda, (spent + REROLE + late, audit + "R" + gone, at + 1, FOLLOW[state]))
                if (state, initial) in KEEPS:
                    heappush(agenda, (spent + KEEP + late, audit + "K" + gone, at + 1, KEEPS[state, initial]))
        heappush(agenda, (cost + INSERT, audit + "I", at, FOLLOW[state]))
    return found


Span = dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]


def joined(left: Span, right: Span) -> Span:
    """Deductions with two antecedents: spans from p to q and from q to r give one from p to r, of added costs and audits."""
    out: Span = {}
    for (p, q), (cost, audit, states) in left.items():
        for (start, r), (more, rest, after) in right.items():
            if start == q and ((p, r) not in out or (cost + more, audit + rest) < out[p, r][:2]):
                out[p, r] = (cost + more, audit + rest, states + after)
    return out


def joined_all(spans: Sequence[Span]) -> Span:
    """Neighbours are joined pairwise, level by level, so audits are copied as often as the tree is high."""
    while len(spans) > 1:
        spans = [joined(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0]


def edited(rows: Iterable[tuple[str, str, int]], state: int, audit: str) -> list[tuple[str, str]]:
    """(role, text) of the messages that the audit's edits make of the rows (role, text, copies)."""
    out, letters = [], iter(audit)

    def put(role: str | None, text: str) -> None:
        nonlocal state
        after = KEEPS[state, role[:1]] if role is not None else FOLLOW[state]
        out.append((role if role is not None else NAMES[after], text))
        state = after

    for role, text, copies in rows:
        for _ in range(copies):
            while (letter := next(letters)) == "I":
                put(None, "")
            if letter != "D":
                put(role if letter == "K" else None, text)
    for _ in letters:
        put(None, "")
    return out


# --- rows --------------------------------------------------------------------------------------------------------------


def _plain(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def messages_of(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) of ``conv_id, turn, role, text``; null role and text become one space."""
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), _plain("role").alias("role"),
        _plain("text").alias("text"), F.lit(1).cast("bigint").alias("copies"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``messages_of`` with damage by the checksum of conversation and turn: of 20 remainders, 0 drops the row, 1 empties
    the text, 2 takes out its sentence ends, 3 repeats the row, 4 makes its role user."""
    at = F.col("_at")
    return (
        messages_of(rows)
        .withColumn("_at", F.crc32(F.concat(_plain("conv"), F.lit(":"), _plain("turn"))) % 20)
        .withColumn("text", F.when(at == 1, F.lit("")).when(at == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("copies", F.when(at == 0, 0).when(at == 3, 2).otherwise(1).cast("bigint"))
        .withColumn("role", F.when(at == 4, F.lit("user")).otherwise(F.col("role")))
        .drop("_at")
    )


def _faulty(messages: DataFrame) -> DataFrame:
    """One row per distinct (conv, turn, role, text) with its copies and the fault of the first of them.

    Equal rows are counted before they are shuffled.  A row is a duplicate where an earlier turn has its role and text;
    the least turn per (conv, role, text) is an aggregate, and it comes back by an equi join on the row's own digest,
    which is unique, so neither a long conversation nor a text that it repeats makes a hot key.
    """
    said = F.concat_ws(":", _plain("conv"), F.length("role").cast("string"), "role", "text")
    marked = messages.withColumn("said", F.unhex(F.sha2(said, 256)))
    marked = marked.withColumn("own", F.unhex(F.sha2(F.concat(_plain("turn"), F.lit(":"), F.hex("said")), 256)))
    rows = marked.groupBy("own").agg(
        F.first(F.struct("conv", "turn", "role", "text", "said")).alias("row"), F.sum("copies").alias("copies")
    ).select("own", "row.*", "copies")
    firsts = marked.filter("copies > 0").groupBy("said").agg(F.min(F.struct("turn", "own")).alias("least"))
    firsts = firsts.select(F.col("least.own").alias("own"), F.lit(True).alias("is_first"))
    ends = F.expr(r"trim(TRAILING ' \t\n\u000B\f\r' FROM text)")
    last = F.substring(F.col("ends"), -1, 1)
    fault = (
        F.when(F.col("ends") == "", BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    )
    return rows.join(firsts, "own", "left").withColumn("ends", ends).select("conv", "turn", "role", "said", "text", "copies", fault.alias("fault"))


# --- segments ----------------------------------------------------------------------------------------------------------

_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
_PLAIN = "conv bigint, part bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", lo bigint, hi bigint, head string, tail string"
_ROWS = "array<struct<role:string,text:string,copies:bigint>>"
_MESSAGES = "array<struct<role:string,text:string>>"
_SEGMENT = f"{_PLAIN}, costs array<bigint>, audits array<string>, whole boolean, cost bigint, audit string, messages {_MESSAGES}, rows {_ROWS}"
_LONG, _TEXT = pa.int64(), pa.string()
_SEGMENT_ARROW = pa.schema(
    [("conv", _LONG), ("part", _LONG)]
    + [(c, _LONG) for c in _COUNTS]
    + [("lo", _LONG), ("hi", _LONG), ("head", _TEXT), ("tail", _TEXT), ("costs", pa.list_(_LONG)), ("audits", pa.list_(_TEXT))]
    + [("whole", pa.bool_()), ("cost", _LONG), ("audit", _TEXT), ("messages", pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT)])))]
    + [("rows", pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT), ("copies", _LONG)])))]
)


def _measured(rows: list[tuple]) -> dict:
    """Counts of a run of rows (turn, role, text, copies, fault); rows without copies count for nothing."""
    out = dict.fromkeys(_COUNTS, 0) | {"lo": None, "hi": None, "head": None, "tail": None}
    for turn, role, _, copies, fault in rows:
        initial = role[:1]
        if out["tail"] is not None and out["tail"] + initial not in LEGAL:
            out["illegal"] += 1
        out["illegal"] += copies - 1
        out["head"], out["tail"] = initial if out["head"] is None else out["head"], initial
        out["n"] += copies
        out["blank"] += copies if fault == BLANK else 0
        out["duplicate"] += copies if fault == DUPLICATE else 0 if fault == BLANK else copies - 1
        out["truncated"] += fault == TRUNCATED
        if turn is not None and turn != out["hi"]:
            out["turns"], out["hi"] = out["turns"] + 1, turn
            out["lo"] = turn if out["lo"] is None else out["lo"]
    return out


def _segment(conv: int | None, part: int, rows: list[tuple], whole: bool) -> dict:
    rows = [r for r in rows if r[3]]
    plain = [(r[1], r[2], r[3]) for r in rows]
    edges = [(r[1][:1], r[4], r[3]) for r in rows]
    out = {"conv": conv, "part": part, "whole": whole} | _measured(rows)
    if whole:
        [(cost, audit)] = lightest(edges, START, ENDS, True).values()
        return out | {"cost": cost, "audit": audit, "messages": [{"role": r, "text": t} for r, t in edited(plain, START, audit)]}
    spans = [lightest(edges, p, range(4), False) for p in range(4)]
    costs, audits = zip(*[spans[p].get(q, (None, None)) for p in range(4) for q in range(4)])
    return out | {"costs": list(costs), "audits": list(audits), "rows": [{"role": r, "text": t, "copies": n} for r, t, n in plain]}


def _segments(parts: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Ordered rows to segments.  A conversation that begins and ends inside the task is repaired at once, one that may
    go on in another task or is long is cut, and each piece lists its spans between states."""
    base, count, conv, held, chars, cut = TaskContext.get().partitionId() << 32, 0, None, [], 0, True
    out, size, begun = [], 0, False

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal out, size
        if out:
            yield pa.RecordBatch.from_pylist(out, _SEGMENT_ARROW)
        out, size = [], 0

    def close(whole: bool) -> None:
        nonlocal held, chars, count, size
        out.append(_segment(conv, base + count, held, whole))
        size, count, held, chars = size + chars + 1000, count + 1, [], 0

    for batch in batches(parts, 4 << 20):
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "fault")]
        for this, *row in zip(*columns):
            if begun and this != conv:
                close(not cut)
                cut = False
            elif len(held) >= segment_rows or chars >= SEGMENT_CHARS:
                cut = True
                close(False)
            conv, begun = this, True
            held.append(row)
            chars += len(row[2] or "")
            if size > SEGMENT_CHARS:
                yield from flush()
    if begun:
        close(False)
    yield from flush()


_WHOLE = "conv bigint, part bigint, entry int, first boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, own string"


def _merged(table: pa.Table) -> pa.Table:
    """All segments of one conversation, without their texts: counts, cost and audit of the whole, entry and audit of each."""
    rows = table.sort_by("part").to_pylist()
    spans = [{(k // 4, k % 4): (c, a, (k % 4,)) for k, (c, a) in enumerate(zip(r["costs"], r["audits"])) if c is not None} for r in rows]
    chain = joined_all(spans)
    cost, audit, exits = min((chain[START, q] for q in ENDS if (START, q) in chain), key=lambda w: w[:2])
    total, last, hi = {c: sum(r[c] for r in rows) for c in _COUNTS}, None, None
    for r in rows:
        if r["n"]:
            total["illegal"] += last is not None and last + r["head"] not in LEGAL
            last = r["tail"]
        if r["lo"] is not None:
            total["turns"] -= r["lo"] == hi
            hi = r["hi"]
    known = [r["lo"] for r in rows if r["lo"] is not None]
    gaps = hi - known[0] + 1 - total["turns"] if known else 0
    entries, out = (START, *exits[:-1]), []
    for k, (r, entry, leave) in enumerate(zip(rows, entries, exits)):
        of_whole = {c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit} if not k else {}
        out.append({"conv": r["conv"], "part": r["part"], "entry": entry, "first": not k, "own": spans[k][entry, leave][1]} | of_whole)
    kinds = {"entry": pa.int32(), "first": pa.bool_(), "audit": _TEXT, "own": _TEXT}
    names = [c.split()[0] for c in _WHOLE.split(", ")]
    return pa.Table.from_pylist(out, pa.schema([(c, kinds.get(c, _LONG)) for c in names]))


def _rewritten(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = _SEGMENT_ARROW.field("messages").type
    for batch in batches(parts, 4 << 20):
        made = [
            [{"role": r, "text": t} for r, t in edited([(x["role"], x["text"], x["copies"]) for x in rows], entry, own)]
            for rows, entry, own in zip(*[batch.column(c).to_pylist() for c in ("rows", "entry", "own")])
        ]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(made, kind)], ["at", "messages"])


_OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repaired(messages: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Repaired conversations of ``messages`` (``messages_of`` or ``damaged``).

    Returns conv_id, part, whole, messages (role, text) and, on the first part of each conversation, gaps, blank,
    duplicate, truncated, illegal, cost and audit (null on further parts).  Most conversations are one part; one that is
    long, or lies on the border of two tasks, is several, in the order of ``part``.

    Rows go by turn (null first), then role, then digest of the text.  A null conversation is one like any other.  A
    conversation without rows (all of no copies) gets zeros, an empty audit and no messages.  Rows are range-partitioned
    in this order, so a conversation that holds a third of all rows is spread over tasks; its segments report the least
    weight between every two states, and only these (no texts) meet in one task, where they are joined pairwise.  What
    grows there is the audit, a character or two per row, which is one value of the result anyway.
    """
    ordered = _faulty(messages).repartitionByRange("conv", "turn", "role", "said").sortWithinPartitions("conv", "turn", "role", "said")
    cut = freeze(ordered.select("conv", "turn", "role", "text", "copies", "fault").mapInArrow(lambda parts: _segments(parts, segment_rows), _SEGMENT))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    done = cut.filter("whole").withColumn("gaps", gaps).select(F.col("conv").alias("conv_id"), "part", "whole", *_OUT, "messages")
    pieces = cut.filter("not whole")
    merged = freeze(pieces.drop("rows", "messages", "audit", "cost", "whole").groupBy("conv").applyInArrow(_merged, _WHOLE))
    held = pieces.select("part", "rows").join(merged.select("part", "entry", "own"), "part")
    texts = held.mapInArrow(_rewritten, f"at bigint, messages {_MESSAGES}")
    rest = merged.join(texts, F.col("part") == F.col("at"))
    return done.unionByName(rest.select(F.col("conv").alias("conv_id"), "part", F.lit(False).alias("whole"), *_OUT, "messages"))


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per conversation over its parts, which come in order; the running digest is all that is held."""
    now, digest, begun = None, None, False
    for batch in batches(parts, 4 << 20):
        keys, lines = [], []
        for conv, text, empty in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "lines", "empty")]):
            if not begun or conv != now:
                if begun:
                    keys.append(now), lines.append(digest.hexdigest())
                now, digest, begun, some = conv, hashlib.sha256(), True, False
            if not empty:
                digest.update((("\n" if some else "") + text).encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array(keys, _LONG), pa.array(lines, _TEXT)], ["conv", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([now], _LONG), pa.array([digest.hexdigest()], _TEXT)], ["conv", "repaired_sha256"])


def repair_digest(found: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: its counts, cost, audit and the SHA-256 of its ``role:text`` lines.

    A digest over a whole conversation is made in order by nature: the parts of a cut one pass through one task, a part at a time.
    """
    found = freeze(found)
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    one = found.filter("whole").select("conv_id", *_OUT, F.sha2(lines, 256).alias("repaired_sha256"))
    pieces = found.filter("not whole")
    ordered = pieces.select("conv_id", "part", lines.alias("lines"), (F.size("messages") == 0).alias("empty")).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    hashes = ordered.mapInArrow(_hashed, "conv bigint, repaired_sha256 string")
    heads = pieces.filter("audit is not null")
    rest = heads.join(hashes, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", *_OUT, "repaired_sha256")
    return one.unionByName(rest)
