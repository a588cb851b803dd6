"""Conversation repair against a plain search over all edit scripts."""

import hashlib
import random
import zlib

import pytest

from undertone.llm import turn_repair


def best_script(shape):
    """(cost, audit) of the cheapest script, least audit first: a search over (row, letters so far)."""
    after = {"start": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {(len(shape), p): ((0, "") if p in ("start", "a") else (10**9, "")) for p in after}
    for i in range(len(shape), -1, -1):
        for p in after:
            best.setdefault((i, p), (10**9, ""))
        if i < len(shape):
            row = shape[i]
            extra = 5 if row.isupper() else 0
            for p in after:
                options = [(2 + best[i + 1, p][0], "D" + best[i + 1, p][1])]
                for letter, q in after[p].items():
                    cost, audit = best[i + 1, q]
                    if row.lower() == letter:
                        options.append((cost + extra, "K" + audit))
                    elif letter != "s" and row != "x":
                        options.append((cost + extra + 1, "R" + audit))
                best[i, p] = min(options[:1] if row == "x" else options)
        for _ in range(4):
            for p in after:
                for letter, q in after[p].items():
                    if letter != "s":
                        best[i, p] = min(best[i, p], (best[i, q][0] + 5, "I" + best[i, q][1]))
    return best[0, "start"]


@pytest.mark.parametrize("kept", [3, 256])
def test_scripts_are_the_cheapest_and_least(monkeypatch, kept):
    monkeypatch.setattr(turn_repair, "KEPT", kept)
    rng = random.Random(5)
    shapes = ["", "s", "S", "x", "xx", "sxu", "a", "u", "ua", "sua", "saau", "oo", "UA", "SUA", "aauu" * 6]
    shapes += ["".join(rng.choice("uuuaaasxoUASO") for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    shapes += ["s" + "".join(rng.choice(["ua", "ua", "ua", "u", "a", "x", "A", "s"]) for _ in range(60)) for _ in range(20)]
    shapes += ["s" * 30 + "ua" * 5, "ua" * 300, "u" * 200, "a" * 101, "U" * 60, "o" * 77]
    for shape in shapes:
        cost, audit, turns = turn_repair.aligned(shape)
        assert (cost, audit) == best_script(shape), shape
        assert len(turns) == sum(letter != "D" for letter in audit)


def plain_repair(rows):
    """The report of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen, shape = [], set(), ""
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        shape += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        faults.append(fault)
    cost, audit = best_script(shape)
    out, k = [], 0
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        role, text = ("user" if not out or out[-1][0][:1] != "u" else "assistant"), ""
        if letter != "I":
            text = rows[k][2]
            role = rows[k][1] if letter == "K" else role
            k += 1
        out.append((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in turn_repair.FAULTS],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_reports_of_difficult_conversations(spark):
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "why", "", None, " \t\r", "ä 漢?", "ok. "]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(roles[:2] * 3 + roles), rng.choice(texts[:2] * 4 + texts)))
    rows += [(None, t, "user", "Same.") for t in range(6)] + [(900, None, None, None)] * 3
    rows += [(901, 0, "user", "word " * 60_000 + "."), (901, 1, "assistant", "x" * 300_000)]
    rows += [(902, t, "ua"[t % 2] + "x", f"turn {t}.") for t in range(700)]
    frame = spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "conv_id bigint, turn int, role string, text string, fault string, _turns int")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in turn_repair.repair_report(frame).collect()}
    want = {conv: plain_repair(kept) for conv, kept in plain_damage(rows).items()}
    assert got == want
    assert any(not kept for kept in plain_damage(rows).values())


def test_repaired_turns_follow_the_grammar(spark):
    import re

    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate(
        [("system", "Be kind."), ("assistant", "Hello."), ("assistant", "cut"), ("user", "Why?"), ("user", "Why?")][c % 3:])]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    for row in turn_repair.repaired(frame).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][:1] for t in row["repaired"]))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    report = turn_repair.repair_report(empty)
    assert report.columns == COLUMNS and not report.count()
