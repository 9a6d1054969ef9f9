"""Repair of conversations: a generalised LR parser over the grammar of roles, with edits that cost.

Rows may be kept, deleted or given another role, and rows may be inserted. The stacks that survive a row share their lower
parts; stacks with equal tops are merged, the one of least (cost, audit) staying, which loses nothing because what may
follow depends on the top alone in this grammar. Costs relative to the cheapest stack and the order of audits are small
numbers, so each situation is worked out once and then looked up, and a row costs the same in conversations of any length.

Rows are dealt by range of (conversation, turn), so a conversation of any size is spread over tasks. One that crosses a
border between tasks is parsed in pieces, each from every possible stack top, and the pieces are then put together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import range_parts
from evenhand.plans.runtime import attach, stage

# Costs of the edits, what ends a row, white space, and neighbours that are legal.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS, WHITE = ".!?", " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
# A dialogue is empty, or an optional system row (B) and one pair (Q) or more; terminals are initials of roles.
GRAMMAR = (("T", ""), ("T", "BP"), ("B", ""), ("B", "s"), ("P", "Q"), ("P", "PQ"), ("Q", "ua"))
END = "$"
# The cheapest stack can be brought to where any other may lead by two inserts and a delete at most, so a stack that is
# dearer by more is on no cheapest path.
SLACK = 2 * INSERT + DELETE


# --- the parser ---------------------------------------------------------------------------------------------

def _closure(items: Iterable[tuple[int, int]]) -> frozenset[tuple[int, int]]:
    found, todo = set(), list(items)
    while todo:
        rule, dot = item = todo.pop()
        if item not in found:
            found.add(item)
            todo += [(r, 0) for r, (head, _) in enumerate(GRAMMAR) if GRAMMAR[rule][1][dot:dot + 1] == head]
    return frozenset(found)


@lru_cache
def _follow() -> dict[str, set[str]]:
    """The terminals that may come after each symbol."""
    heads = {head for head, _ in GRAMMAR}
    empty, first, follow = set(), {h: set() for h in heads}, {h: set() for h in heads} | {"T": {END}}
    for _ in range(2 * len(GRAMMAR)):
        for head, body in GRAMMAR:
            after, may_end = set(follow[head]), True
            for symbol in reversed(body):
                if symbol in heads:
                    follow[symbol] |= after
                    after = first[symbol] | (after if symbol in empty else set())
                else:
                    after, may_end = {symbol}, False
                may_end = may_end and symbol in empty
            begins = set()
            for symbol in body:
                begins |= first[symbol] if symbol in heads else {symbol}
                if symbol not in empty:
                    break
            first[head] |= begins
            if may_end:
                empty.add(head)
    return follow


class Stack(NamedTuple):
    """A node of the graph of stacks: an automaton state on top of another node."""

    state: frozenset[tuple[int, int]]
    below: Stack | None


def _goto(state: frozenset[tuple[int, int]], symbol: str) -> frozenset[tuple[int, int]]:
    return _closure((r, dot + 1) for r, dot in state if GRAMMAR[r][1][dot:dot + 1] == symbol)


def _reduced(stack: Stack, ahead: str) -> Iterator[Stack]:
    """The stack and all that its reductions lead to where ``ahead`` comes next; an accepted one has no state."""
    yield stack
    for rule, dot in stack.state:
        head, body = GRAMMAR[rule]
        if dot == len(body) and ahead in _follow()[head]:
            under = stack
            for _ in body:
                under = under.below
            if head == "T" and under.below is None:
                yield Stack(frozenset(), under)
            elif state := _goto(under.state, head):
                yield from _reduced(Stack(state, under), ahead)


def _shift(stack: Stack, terminal: str) -> Stack | None:
    for reduced in _reduced(stack, terminal):
        if state := _goto(reduced.state, terminal):
            return Stack(state, reduced)
    return None


START = Stack(_closure((r, 0) for r, (head, _) in enumerate(GRAMMAR) if head == "T"), None)


@lru_cache
def _tops() -> list[Stack]:
    """A stack for each possible top, the empty one first."""
    found = [START]
    for stack in found:
        for terminal in "sua":
            made = _shift(stack, terminal)
            if made and all(made.state != other.state for other in found):
                found.append(made)
    return found


@lru_cache
def _shifts() -> list[dict[str, int]]:
    """For each top, the top that each terminal leads to."""
    states = [t.state for t in _tops()]
    return [{x: states.index(made.state) for x in "sua" if (made := _shift(t, x))} for t in _tops()]


@lru_cache
def _accepting() -> list[bool]:
    return [any(not s.state for s in _reduced(t, END)) for t in _tops()]


# A frontier holds (top, cost above the cheapest, place of its audit among all audits) of every stack that survives.
Frontier = tuple[tuple[int, int, int], ...]


def _inserted(frontier: Frontier) -> dict[int, tuple[int, int, str]]:
    """The best (cost, place, edits) to have each top after inserting rows."""
    best, todo = {}, [(cost, place, "", top) for top, cost, place in frontier]
    while todo:
        cost, place, edits, top = least = min(todo)
        todo.remove(least)
        if top not in best:
            best[top] = (cost, place, edits)
            todo += [(cost + INSERT, place, edits + "I", _shifts()[top][x]) for x in ROLES if x in _shifts()[top]]
    return best


class Step(NamedTuple):
    """Where a row leads: the next frontier, the cost all its stacks share, and their (place before, edits)."""

    frontier: Frontier
    cost: int
    came: tuple[tuple[int, str], ...]


@lru_cache(maxsize=None)
def step(frontier: Frontier, initial: str, fault: str) -> Step:
    """Read one row; a blank or duplicate one must go, a truncated one costs more where it stays."""
    best: dict[int, tuple[int, int, str]] = {}
    for top, (cost, place, edits) in _inserted(frontier).items():
        moves = [(top, DELETE, "D")]
        if fault not in ("blank", "duplicate"):
            more, shifts = TRUNCATED * (fault == "truncated"), _shifts()[top]
            moves += [(shifts[x], more, "K") for x in shifts if x == initial]
            moves += [(shifts[x], RENAME + more, "R") for x in ROLES if x in shifts]
        for to, price, edit in moves:
            made = (cost + price, place, edits + edit)
            if to not in best or made < best[to]:
                best[to] = made
    least = min(cost for cost, _, _ in best.values())
    kept = {top: v for top, v in best.items() if v[0] - least <= SLACK}
    came = tuple(sorted((place, edits) for _, place, edits in kept.values()))
    after = tuple((top, cost - least, came.index((place, edits))) for top, (cost, place, edits) in sorted(kept.items()))
    return Step(after, least, came)


class Path:
    """The steps of a run of rows from one stack top on."""

    def __init__(self, top: int = 0):
        self.frontier, self.cost, self.steps = ((top, 0, 0),), 0, []

    def read(self, initial: str, fault: str) -> None:
        made = step(self.frontier, initial if initial in ("s", "u", "a") else "", fault)
        self.frontier, self.cost = made.frontier, self.cost + made.cost
        self.steps.append(made.came)

    def audit(self, place: int) -> str:
        edits = []
        for came in reversed(self.steps):
            place, made = came[place]
            edits.append(made)
        return "".join(reversed(edits))

    def tops(self) -> list[tuple[int, int, str]]:
        """(top, cost, audit) of every stack that survives."""
        return [(top, self.cost + cost, self.audit(place)) for top, cost, place in self.frontier]


def finished(tops: Iterable[tuple[int, int, str]]) -> tuple[int, str]:
    """The least (cost, audit) that ends a dialogue, inserting what is missing at the end."""
    ends = []
    for top, cost, audit in tops:
        ends += [(c, audit + edits) for t, (c, _, edits) in _inserted(((top, cost, 0),)).items() if _accepting()[t]]
    return min(ends)


def repaired(audit: Iterable[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) that an audit leaves; the place in the dialogue decides each new role."""
    due = "u"
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        yield (role if edit == "K" else ROLES[due], text)
        if edit != "K" or role[:1] != "s":
            due = "a" if due == "u" else "u"


# --- conversations, whole or in pieces ------------------------------------------------------------------------

class Piece:
    """Neighbouring rows of one conversation: its counts, and the paths from the tops it may start from."""

    def __init__(self, conversation, whole: bool):
        self.conversation, self.seen, self.rows = conversation, set(), [] if whole else None
        self.paths = [Path(top) for top in ([0] if whole else range(len(_tops())))]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.turns, self.initials, self.last = [], [], None

    def read(self, turn, role: str, text: str, repeats: bool | None) -> None:
        """Take in a row; ``repeats`` says that an earlier turn has it, None that only the rows here need be looked at."""
        said = text.strip(WHITE)
        if repeats is None:
            key = (role, hashlib.md5(text.encode()).digest())
            repeats = key in self.seen
            self.seen.add(key)
        else:
            repeats, self.last = repeats or self.last == (turn, role, text), (turn, role, text)
        fault = "blank" if not said else "duplicate" if repeats else "" if said[-1] in ENDS else "truncated"
        if fault:
            self.counts[fault] += 1
        if self.initials:
            self.counts["illegal"] += self.initials[-1] + role[:1] not in LEGAL
        self.initials = [*self.initials[:1], role[:1]]
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.counts["turns"] += 1
            self.turns = [*self.turns[:1], turn]
        for path in self.paths:
            path.read(role[:1], fault)
        if self.rows is not None:
            self.rows.append((role, text))

    def drop_rows(self) -> None:
        self.rows = None

    def summary(self) -> str:
        return json.dumps({"counts": self.counts, "turns": self.turns, "initials": self.initials,
                           "tops": [path.tops() for path in self.paths]})


def _verdict(conversation, counts: dict[str, int], turns: list, cost: int, audit: str, sha: str | None) -> dict:
    gaps = turns[-1] - turns[0] + 1 - counts["turns"] if turns else 0
    return {"conversation": conversation, "gaps": gaps, **{c: counts[c] for c in COUNTS}, "cost": cost, "audit": audit,
            "repaired_sha256": sha}


COUNTS = ("blank", "duplicate", "truncated", "illegal")
VERDICT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _digest(rows: Iterable[tuple[str, str]]) -> str:
    """Of repaired rows, one at a time."""
    sha, lead = hashlib.sha256(), ""
    for role, text in rows:
        sha.update(f"{lead}{role}:{text}".encode())
        lead = "\n"
    return sha.hexdigest()


def _whole_of(piece: Piece) -> dict:
    cost, audit = finished(piece.paths[0].tops())
    return _verdict(piece.conversation, piece.counts, piece.turns, cost, audit, _digest(repaired(audit, iter(piece.rows))))


def _pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[Piece, bool]]:
    """The pieces of a task's sorted rows in turn, each followed by whether a border of the task may cut it."""
    piece, first = None, True
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conversation, turn, role, text, dropped, repeats in zip(*columns[:6]):
            if piece is None or piece.conversation != conversation:
                if piece is not None:
                    yield piece, first
                    first = False
                piece = Piece(conversation, whole)
                if first:
                    piece.drop_rows()
            if not dropped:
                piece.read(turn, role, text, None if whole else bool(repeats))
    if piece is not None:
        yield piece, True


def _batches(rows: Iterable[dict], schema: pa.Schema, together: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == together:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _verdict_schema(kind: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    longs = [(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")]
    return pa.schema([("conversation", kind), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string()), *more])


def _begun(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    """The first batch that has rows, and all batches from it on."""
    for batch in batches:
        if batch.num_rows:
            return batch, chain([batch], batches)
    return None, batches


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of the conversations inside a task; of those at its borders only the name."""
    first, every = _begun(batches)
    if first is not None:
        schema = _verdict_schema(first.schema.field(0).type, ("border", pa.bool_()))
        yield from _batches(({"conversation": piece.conversation, "border": True} if border else
                             {**_whole_of(piece), "border": False} for piece, border in _pieces(every, True)), schema)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, every = _begun(batches)
    if first is not None:
        part = first.column(6)[0].as_py()
        schema = pa.schema([("conversation", first.schema.field(0).type), ("part", pa.int32()), ("summary", pa.string())])
        yield from _batches(({"conversation": p.conversation, "part": part, "summary": p.summary()}
                             for p, _ in _pieces(every, False)), schema)


def _joined(table: pa.Table) -> pa.Table:
    """One conversation's verdict from its pieces, without the digest of its rows."""
    rows = sorted(table.select(["part", "summary"]).to_pylist(), key=lambda r: r["part"])
    counts = dict.fromkeys((*COUNTS, "turns"), 0)
    turns, initial, tops = [], None, {0: (0, "")}
    for piece in (json.loads(r["summary"]) for r in rows):
        for name, n in piece["counts"].items():
            counts[name] += n
        if piece["turns"]:
            counts["turns"] -= bool(turns) and turns[-1] == piece["turns"][0]
            turns = [(turns or piece["turns"])[0], piece["turns"][-1]]
        if piece["initials"]:
            counts["illegal"] += initial is not None and initial + piece["initials"][0] not in LEGAL
            initial = piece["initials"][-1]
        reached: dict[int, tuple[int, str]] = {}
        for top, (cost, audit) in tops.items():
            for to, price, edits in piece["tops"][top]:
                made = (cost + price, audit + edits)
                reached[to] = min(reached.get(to, made), made)
        tops = reached
    cost, audit = finished((top, *v) for top, v in tops.items())
    schema = _verdict_schema(table.schema.field("conversation").type)
    return pa.Table.from_pylist([_verdict(table.column("conversation")[0].as_py(), counts, turns, cost, audit, None)], schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """Conversations of a task in turn, each with its repaired rows: a first row brings the audit, then come the rows."""
    def records() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    source = records()
    ahead = next(source, None)
    while ahead is not None:
        conversation, _, _, audit, *_ = ahead
        ahead = next(source, None)

        def rows() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conversation and ahead[4]:
                row, ahead = ahead, next(source, None)
                yield row[2], row[3]

        mine = rows()
        yield conversation, repaired(audit, mine)
        for _ in mine:
            pass


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, every = _begun(batches)
    if first is not None:
        schema = pa.schema([("conversation", first.schema.field(0).type), ("sha", pa.string())])
        yield from _batches(({"conversation": c, "sha": _digest(rows)} for c, rows in _streamed(every)), schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, every = _begun(batches)
    if first is not None:
        schema = pa.schema([("conversation", first.schema.field(0).type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        yield from _batches(({"conversation": c, "place": place, "role": role, "text": text}
                             for c, rows in _streamed(every) for place, (role, text) in enumerate(rows)), schema)


# --- the operator ---------------------------------------------------------------------------------------------

def _prepared(rows: DataFrame, conversation: str, turn: str, role: str, text: str, dropped: Column | None) -> DataFrame:
    """The columns needed, nulls of role and text being one space; a dropped row keeps its conversation's name alive."""
    spoken = lambda c: F.when(~F.col("dropped"), F.coalesce(F.col(c), F.lit(" "))).otherwise("")
    chosen = rows.select(F.col(conversation).alias("conversation"), F.col(turn).cast("bigint").alias("turn"),
                         F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
                         (F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))).alias("dropped"))
    return chosen.withColumns({"role": spoken("role"), "text": spoken("text")})


def _sorted(rows: DataFrame, parts: int, repeats: Column) -> DataFrame:
    """Rows dealt by range and sorted: by conversation, turn (null first), role, and a hash of the text."""
    order = ["conversation", "turn", "role", F.xxhash64("text")]
    return rows.withColumn("repeats", repeats).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select(
        "conversation", "turn", "role", "text", "dropped", "repeats", F.spark_partition_id().alias("part"))


def repair_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", dropped: Column | None = None, parts: int | None = None) -> DataFrame:
    """What is wrong with every conversation, and its cheapest repair (``repaired_turns`` applies it).

    Returns ``conversation``, ``gaps`` (turns missing between the first and the last), rows that are ``blank``,
    ``duplicate`` (role and text seen before) or ``truncated`` (no full stop, exclamation or question mark at the end), each
    row by its first fault, ``illegal`` neighbours, the ``cost`` and ``audit`` of the cheapest repair, and the sha256 of the
    repaired rows. The audit names the edits (keep, delete, rerole, insert) in order; of equal costs the least in ASCII.

    A null role or text is one space, so it is blank. A null turn comes first and is in no gap; a null conversation is one of
    its own. Ties of turn are ordered by role and a hash of the text. Repeated rows are duplicates. Rows marked ``dropped``
    count nowhere, and a conversation of such rows only has zeros, an empty audit and the hash of nothing. An empty table
    gives no rows. Turns are whole numbers. Other columns are not looked at.
    """
    ready = _prepared(rows, conversation, turn, role, text, dropped)
    kind = ready.dtypes[0][1]
    parts = parts or range_parts(ready, F.octet_length("text") + 32)
    judged = stage(_sorted(ready, parts, F.lit(None).cast("boolean")).mapInArrow(
        _judge, f"conversation {kind}, {VERDICT}, border boolean"), "judged")
    # Two names a task at most: conversations that begin or end a task, among them all that are cut.
    names = judged.filter("border").select("conversation").distinct()
    cut = attach(ready, names, ["conversation"], 2 * parts, ["turn", "text"], how="left_semi")
    joined = stage(_cut_verdicts(cut, parts, kind), "joined")
    shas = _with_audits(cut, joined, parts).mapInArrow(_digests, f"conversation {kind}, sha string")
    named = shas.select(F.col("conversation").alias("__c"), "sha")
    whole = joined.drop("repaired_sha256").join(named, F.col("conversation").eqNullSafe(F.col("__c"))).drop("__c")
    return judged.filter("not border").drop("border").unionByName(whole.withColumnRenamed("sha", "repaired_sha256"))


def _cut_verdicts(cut: DataFrame, parts: int, kind: str) -> DataFrame:
    """Verdicts of conversations whose rows lie in several tasks."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keyed = cut.withColumns({"key": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")), "order": order})
    again = stage(keyed.filter("not dropped").groupBy("conversation", "key").agg(
        F.min("order").alias("since"), F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    known = attach(keyed, again, ["conversation", "key"], 3 * again.count(), ["turn", "text"])
    pieces = _sorted(known, parts, F.coalesce(F.col("order") > F.col("since"), F.lit(False))).mapInArrow(
        _summarise, f"conversation {kind}, part int, summary string")
    return stage(pieces, "pieces").groupBy("conversation").applyInArrow(_joined, f"conversation {kind}, {VERDICT}")


def _with_audits(rows: DataFrame, verdicts: DataFrame, parts: int) -> DataFrame:
    """Rows dealt and sorted by conversation, each conversation led by a row that holds its audit as text.

    A digest is made from a conversation's rows one after the other, so these stream through one task, a batch at a time.
    """
    lead = verdicts.select("conversation", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                           F.col("audit").alias("text"), F.lit(False).alias("follows"))
    spoken = rows.filter("not dropped").select("conversation", "turn", "role", "text", F.lit(True).alias("follows"))
    return lead.unionByName(spoken).repartition(parts, "conversation").sortWithinPartitions(
        "conversation", "follows", "turn", "role", F.xxhash64("text"), "text")


def repaired_turns(rows: DataFrame, verdicts: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", dropped: Column | None = None, parts: int | None = None) -> DataFrame:
    """(``conversation``, ``place``, ``role``, ``text``): the rows that the audits of ``repair_conversations`` leave, in order
    of ``place``. Nulls, ties and empty tables are treated as there; a conversation that is repaired to nothing has no rows."""
    ready = _prepared(rows, conversation, turn, role, text, dropped)
    kind = ready.dtypes[0][1]
    parts = parts or range_parts(ready, F.octet_length("text") + 32)
    return _with_audits(ready, verdicts, parts).mapInArrow(
        _turns, f"conversation {kind}, place bigint, role string, text string")


def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults put in by a checksum of conversation and turn, to test repairs with.

    Of twenty rows one is ``dropped`` (marked, not removed), one loses its text, one its full stops, exclamation and question
    marks, one comes twice, and one gets the role user. Nulls count as one space. Keeps the four columns only.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conversation), F.lit(":"), said(turn))) % 20
    marked = rows.select(conversation, turn, said(role).alias(role), said(text).alias(text), fate.alias("__fate"))
    copies = F.explode(F.when(F.col("__fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    without = F.regexp_replace(text, "[.!?]", "")
    return marked.select(
        conversation, turn, F.when(F.col("__fate") == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(F.col("__fate") == 1, "").when(F.col("__fate") == 2, without).otherwise(F.col(text)).alias(text),
        (F.col("__fate") == 0).alias("dropped"), copies.alias("__copy")).drop("__copy")
