"""Repair of conversations against every sequence of edits, whole and in pieces."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evenhand.llm import repair

WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """Each row's first fault."""
    found = []
    for i, row in enumerate(rows):
        said = row[1].strip(WHITE)
        found.append("blank" if not said else "duplicate" if row in rows[:i] else "truncated" if said[-1] not in ".!?" else "")
    return found


def cheapest(initials, faults):
    """All edits with up to two inserts before each row and at the end."""
    best = None
    options = ["".join(p) for p in itertools.product(["", "I", "II"], "DKR")]
    for edits in itertools.product(options, repeat=len(initials)):
        for end in ("", "I", "II"):
            audit, cost, left, due, fits = "".join(edits) + end, 0, iter(zip(initials, faults)), "u", True
            made = ""
            for edit in audit:
                initial, fault = next(left) if edit != "I" else ("", "")
                if edit == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    fits = False
                    break
                cost += 3 * (edit != "K") + 3 * (fault == "truncated")
                now = initial if edit == "K" else due
                made += now
                due = due if now == "s" else "a" if due == "u" else "u"
            if fits and re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def stepwise(initials, faults):
    """The same row by row over the four places in a dialogue, keeping the least (cost, audit) of each."""
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}

    def inserted(tops):
        for _ in range(3):
            for (place, role), to in after.items():
                if place in tops and role in "ua":
                    cost, audit = tops[place]
                    tops[to] = min(tops.get(to, (99e9, "")), (cost + 3, audit + "I"))
        return tops

    tops = {"0": (0, "")}
    for initial, fault in zip(initials, faults):
        made = {}
        for place, (cost, audit) in inserted(tops).items():
            ways = [(place, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(to, more, "K") for (p, r), to in after.items() if p == place and r == initial]
                ways += [(to, 3 + more, "R") for (p, r), to in after.items() if p == place and r in "ua"]
            for to, price, edit in ways:
                made[to] = min(made.get(to, (99e9, "")), (cost + price, audit + edit))
        tops = made
    return min(v for p, v in inserted(tops).items() if p in "0p")


def parsed(initials, faults):
    path = repair.Path()
    for initial, fault in zip(initials, faults):
        path.read(initial, fault)
    return repair.finished(path.tops())


def test_parser_equals_all_edits():
    kinds = ["", "", "truncated", "blank"]
    for initials in itertools.product(["s", "u", "a", "t"], repeat=3):
        for faults in (("", "", ""), ("truncated",) * 3, ("", "blank", "truncated")):
            assert parsed(initials, faults) == cheapest(initials, faults) == stepwise(initials, faults)
    rnd = random.Random(4)
    for n in [0, 1, 2, 4, 7, 15, 60, 400] * 60:
        initials, faults = rnd.choices(["s", "u", "a", "t", ""], [1, 4, 4, 2, 1], k=n), rnd.choices(kinds, k=n)
        assert parsed(initials, faults) == stepwise(initials, faults)


def test_long_runs_in_bounded_steps():
    """Situations are looked up, so a long run needs no more of them than a short one."""
    parsed("t" * 50 + "ua" * 50, [""] * 150)
    known = repair.step.cache_info().currsize
    cost, audit = parsed("t" * 20_000 + "ua" * 20_000, [""] * 60_000)
    assert repair.step.cache_info().currsize == known and cost == 60_000 and audit == "R" * 20_000 + "K" * 40_000


def expected(rows):
    """Verdicts of rows (conversation, turn, role, text, dropped) by plain means."""
    found = {}
    for conversation in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conversation and not r[4]]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2]))
        said = [(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in mine]
        faults, turns = faults_of(said), [r[1] for r in mine if r[1] is not None]
        initials = [role[:1] for role, _ in said]
        cost, audit = stepwise(initials, faults)
        text = "\n".join(f"{role}:{text}" for role, text in repair.repaired(audit, iter(said)))
        found[conversation] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                               sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                               hashlib.sha256(text.encode()).hexdigest())
    return found


def conversations(seed, n=400):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", " \n", None, "x" * 3000 + "?", "Why?"]
    rows = []
    for conversation in [*range(n), None]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((conversation, None if rnd.random() < .03 and turn == 0 else turn + (turn > 3 and rnd.random() < .2),
                         rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(texts), rnd.random() < .1))
    # One conversation with a third of the rows, some of them many times.
    rows += [(7, 20 + i // 2, ("user", "assistant")[i % 2], rnd.choice([*texts, f"Number {i}."]), False) for i in range(len(rows) // 2)]
    # Ties of turn and role would be ordered by a hash of the text, which the plain version does not know.
    return list({(r[0], r[1], r[2] or " "): r for r in rows}.values())


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_verdicts_equal_plain_ones(spark, parts):
    rows = conversations(parts)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean").withColumn("part", F.lit("x"))
    verdicts = repair.repair_conversations(df.repartition(3), dropped=F.col("dropped"), parts=parts).persist()
    assert {r[0]: tuple(r[1:]) for r in verdicts.collect()} == expected(rows)
    turns = repair.repaired_turns(df, verdicts, dropped=F.col("dropped"), parts=parts).collect()
    for row in verdicts.collect():
        lines = [f"{t.role}:{t.text}" for t in sorted((t for t in turns if t.conversation == row.conversation), key=lambda t: t.place)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == row.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi.", False)] * 5 + [(2, None, None, None, False), (3, 1, "user", "Gone.", True), (4, None, "user", "Who?", False),
                                                (4, 3, "assistant", "Me.", False)]
    schema = "conv_id int, turn int, role string, text string, dropped boolean"
    for parts in (1, 7):
        found = {r[0]: tuple(r[1:-1]) for r in repair.repair_conversations(
            spark.createDataFrame(rows, schema), dropped=F.col("dropped"), parts=parts).collect()}
        assert found == {1: (0, 0, 4, 0, 4, *stepwise("uuuuu", ["", *["duplicate"] * 4])), 2: (0, 1, 0, 0, 0, 4, "D"), 3: (0, 0, 0, 0, 0, 0, ""),
                         4: (0, 0, 0, 0, 0, 0, "KK")}
    assert repair.repair_conversations(spark.createDataFrame([], schema)).collect() == []
    assert repair.repaired_turns(spark.createDataFrame([], schema), repair.repair_conversations(spark.createDataFrame([], schema))).collect() == []


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    made = {}
    for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        made.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.dropped))
    for conversation, turn, role, text in rows:
        name = f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}"
        fate, role, text = zlib.crc32(name.encode()) % 20, role or " ", text or " "
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        assert made[conversation, turn] == [("user" if fate == 4 else role, text, fate == 0)] * (2 if fate == 3 else 1)
