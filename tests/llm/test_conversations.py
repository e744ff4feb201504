"""Conversation repair against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terralog.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def said(conv, role, text):
    return hashlib.sha256(":".join([" " if conv is None else str(conv), str(len(role)), role, text]).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
        out += [(conv, turn, "user" if at == 4 else role, text)] * (0 if at == 0 else 2 if at == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), said(r[0], r[2], r[3])))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows, found):
    """(cost, audit, lines) of the cheapest repair: the least of (cost, audit) per initials so far, kept as plain strings."""
    now = {"": (0, "", [])}

    def put(table, key, value):
        key = key[:1] * (key[:1] == "s") + ("u" if key[-1:] == "u" else "a" if key[-1:] == "a" else "")  # all that matters later
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(table):
        for _ in range(3):
            for key, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if legal(key, role[0]):
                        put(table, key + role[0], (cost + 3, audit + "I", lines + [role + ":"]))
        return table

    def legal(key, initial):
        return {"": initial in ("s", "u"), "s": initial == "u"}.get(key, initial == ("a" if key.endswith("u") else "u"))

    for (_, _, role, text), fault in zip(rows, found):
        after = {}
        for key, (cost, audit, lines) in inserted(now).items():
            put(after, key, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 if fault == "truncated" else 0
            if legal(key, role[:1]):
                put(after, key + role[:1], (cost + late, audit + "K", lines + [f"{role}:{text}"]))
            for name in ("user", "assistant"):
                if legal(key, name[0]):
                    put(after, key + name[0], (cost + late + 3, audit + "R", lines + [f"{name}:{text}"]))
        now = after
    return min((v for k, v in inserted(now).items() if k == "" or k.endswith("a")), key=lambda v: v[:2])


def wanted(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = in_order(damage([r for r in rows if r[0] == conv]))
        found, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = best_edits(mine, found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got_of(spark, rows, parts=3, segment_rows=C.SEGMENT_ROWS):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit(1) for c in ("conv", "part", "said", "own", "copies", "fault")})
    out = C.repair_digest(C.repaired(C.damaged(df), segment_rows)).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def made(seed, convs, most):
    r, out = random.Random(seed), []
    for conv in range(convs):
        for turn in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unit"])
            text = r.choice(["Yes.", "No", "  ", "", None, "Well?  ", "Größe!", f"line {turn}\nmore.", "x" * 50])
            out.append((conv, r.choice([turn, turn, 2 * turn, None]), role, text))
    return out


def all_repairs(rows, found):
    """Every sequence of edits with up to three insertions, by brute force."""
    edits = {"blank": "D", "duplicate": "D"}
    best = None
    for choice in itertools.product(*[edits.get(f, "DKRr") for f in found]):
        for gaps in itertools.product(*[("", "u", "a", "ua", "au")] * (len(rows) + 1)):
            cost = audit = initials = ""
            cost = 0
            for k in range(len(rows) + 1):
                initials, audit, cost = initials + gaps[k], audit + "I" * len(gaps[k]), cost + 3 * len(gaps[k])
                if k < len(rows):
                    c = choice[k]
                    initials += {"D": "", "K": rows[k][2][:1] or "?", "R": "u", "r": "a"}[c]
                    audit += c.upper()
                    cost += {"D": 4, "K": 0}.get(c, 3) + (3 if found[k] == "truncated" and c != "D" else 0)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_agenda_against_all_edits():
    r = random.Random(4)
    for _ in range(60):
        rows = in_order([(1, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", "", "c?"])) for t in range(r.randrange(0, 4))])
        found = faults(rows)
        code = {"": C.NO_FAULT, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.TRUNCATED}
        edges = [(row[2][:1], code[f], 1) for row, f in zip(rows, found)]
        [got] = C.lightest(edges, C.START, C.ENDS, True).values()
        assert got == all_repairs(rows, found) == best_edits(rows, found)[:2]
        spans = [{(p, q): (*w, (q,)) for p in range(4) for q, w in C.lightest([e], p, range(4), False).items()} for e in edges]
        if spans:
            whole = C.joined_all(spans)
            assert min(whole[C.START, q][:2] for q in C.ENDS if (C.START, q) in whole) == got


@pytest.mark.parametrize("segment_rows", [1024, 3])
def test_repair(spark, segment_rows):
    rows = made(segment_rows, 60, 12) + [(None, 3, "user", "Hi."), (None, 4, "assistant", "Ho."), (None, None, None, None)]
    rows += [(777, t % 40 if t % 7 else None, "user" if t % 2 else "assistant", f"text {t % 90}.") for t in range(400)]  # a long one
    rows += [(778, 1, "user", "same.")] * 50 + [(779, 1, "user", "x" * 300_000)]
    assert got_of(spark, rows, segment_rows=segment_rows) == wanted(rows)


def test_a_conversation_of_which_nothing_is_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = got_of(spark, [(gone, 0, "user", "Hello."), (gone, 0, "user", "Hello.")])
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair_digest(C.repaired(C.damaged(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_parts_hold_the_messages(spark):
    rows = spark.createDataFrame([(1, t, "user" if t % 3 else "assistant", f"text {t}.") for t in range(40)], SCHEMA)
    found = C.repaired(C.messages_of(rows), 5).orderBy("part").collect()
    roles = [m.role[0] for r in found for m in r.messages]
    assert re.fullmatch("(ua)+", "".join(roles)) and len(found) > 3
    assert [r.audit is not None for r in found] == [True] + [False] * (len(found) - 1)
