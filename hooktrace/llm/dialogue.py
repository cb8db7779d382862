"""Repair of conversations whose turns are missing, repeated, blank, cut off or out of order.

A repaired conversation has an optional system turn and then user and assistant turns in pairs, or
no turn at all. Rows are kept (0), given another role (3) or deleted (4; blank rows and repeated
ones must be), turns without text are inserted (3), and a cut-off row that stays costs 3 more. The
cheapest edits are found by Viterbi over what the conversation ended with so far; among equally
cheap ones those whose initials (D, I, K, R) come first in ASCII order.

Survivors are leaves of a tree of backpointers. A node counts its references, the children that some
survivor descends from; without any it is freed. As soon as all survivors descend from one child of the root, that child's edits
are certain, are handed out and become the root. So memory holds only the part of a conversation
that is still undecided.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# What the repaired turns end with: none yet, a system turn, a user turn, an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
RELABEL = CUT_OFF = INSERT = 3
DELETE = 4
_ROLE = {USER: "user", ASSISTANT: "assistant"}
# The state after one more user or assistant turn.
_NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {"u": USER, "a": ASSISTANT}
# Turns that are inserted after the last row.
_TAIL = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
# What is left to do from x never costs more than from y plus _DETOUR[x][y]: from y's best way to go
# on, one for x is made by inserting a turn or two in front, or by deleting a system row.
_DETOUR = {
    NONE: {SYSTEM: 0, USER: 3, ASSISTANT: 0},
    SYSTEM: {NONE: 6, USER: 3, ASSISTANT: 6},
    USER: {NONE: 7, SYSTEM: 3, ASSISTANT: 3},
    ASSISTANT: {NONE: 4, SYSTEM: 0, USER: 3},
}

FAULTS = ("blank", "duplicate", "truncated")
_ANY = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


class _Node:
    """The edits of one row on one way through the conversation."""

    __slots__ = ("parent", "edits", "turns", "kids", "live")

    def __init__(self, parent: _Node | None, edits: str, turns: tuple[int, ...]):
        self.parent, self.edits, self.turns = parent, edits, turns
        self.kids: set[_Node] = set()
        self.live = False


class Survivors:
    """Viterbi over the rows of one conversation; edits come out as soon as they are certain.

    ``step`` and ``finish`` return a list of (edits of one row, states after its turns): the edits are
    inserts and then K, R or D; a kept system row has the state SYSTEM. ``finish`` ends with the
    inserts after the last row, for no row.
    """

    def __init__(self):
        self.root = _Node(None, "", ())
        self.root.live = True
        # State: (cost, place in the ASCII order of all survivors, node).
        self.best: dict[int, tuple[int, int, _Node]] = {NONE: (0, 0, self.root)}

    def step(self, initial: str, must_go: bool, cut_off: bool) -> list[tuple[str, tuple[int, ...]]]:
        ways: dict[int, tuple[int, int, str, int, tuple[int, ...]]] = {}

        def offer(state: int, cost: int, source: int, edits: str, turns: tuple[int, ...]) -> None:
            # Survivors of a row have equally many letters but I, and end with another: none is the
            # start of another, so the order of two ways is that of their survivors, then of the edits.
            way = (cost, self.best[source][1], edits, source, turns)
            if state not in ways or way[:3] < ways[state][:3]:
                ways[state] = way

        for source, (cost, _, _) in self.best.items():
            offer(source, cost + DELETE, source, "D", ())
            if must_go:
                continue
            stay = cost + (CUT_OFF if cut_off else 0)
            if initial == "s" and source == NONE:
                offer(SYSTEM, stay, source, "K", (SYSTEM,))
            # An insert before a deleted row can as well come after it (D before I), and two
            # inserts in a row are never cheapest.
            for before in ((), (_NEXT[source],)):
                last = before[0] if before else source
                state, paid, mark = _NEXT[last], stay + INSERT * len(before), "I" * len(before)
                if _KEPT.get(initial) == state:
                    offer(state, paid, source, mark + "K", (*before, state))
                offer(state, paid + RELABEL, source, mark + "R", (*before, state))
        dominated = [y for y in ways if any(x != y and ways[x][0] + _DETOUR[x][y] < ways[y][0] for x in ways)]
        for state in dominated:
            del ways[state]
        old = self.best
        self.best = {}
        for place, state in enumerate(sorted(ways, key=lambda s: ways[s][1:3])):
            cost, _, edits, source, turns = ways[state]
            parent = old[source][2]
            node = _Node(parent, edits, turns)
            node.live = True
            parent.kids.add(node)
            self.best[state] = (cost, place, node)
        for _, _, node in old.values():
            node.live = False
            self._free(node)
        return self._certain()

    def _free(self, node: _Node) -> None:
        while not node.live and not node.kids and node.parent is not None:
            parent, node.parent = node.parent, None
            parent.kids.discard(node)
            node = parent

    def _certain(self) -> list[tuple[str, tuple[int, ...]]]:
        out = []
        while not self.root.live and len(self.root.kids) == 1:
            (self.root,) = self.root.kids
            self.root.parent = None
            out.append((self.root.edits, self.root.turns))
        return out

    def finish(self) -> tuple[int, list[tuple[str, tuple[int, ...]]]]:
        """The cost of all edits, and those not handed out yet."""
        cost, _, end = min((c + INSERT * len(_TAIL[s]), place, s) for s, (c, place, _) in self.best.items())
        for state, (_, _, node) in self.best.items():
            if state != end:
                node.live = False
                self._free(node)
        self.best[end][2].live = False
        return cost, [*self._certain(), ("I" * len(_TAIL[end]), _TAIL[end])]


class Conversation:
    """The rows of one conversation in order, one at a time; turns come out repaired.

    ``add`` and ``close`` yield (edit, row or None, role, text); the role and text of a deleted row are
    its own. Rows are (turn, role, text, duplicate).
    """

    def __init__(self):
        self.survivors = Survivors()
        self.waiting: deque = deque()
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = self.rows = 0
        self.first = self.last = self.before = None
        self.cost = 0

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else int(self.last - self.first + 1 - self.turns)

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if fault:
            self.faults[fault] += 1
        if self.rows and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before, self.rows = role[:1], self.rows + 1
        self.waiting.append((turn, role, text))
        yield from self._out(self.survivors.step(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def close(self) -> Iterator[tuple]:
        self.cost, rest = self.survivors.finish()
        yield from self._out(rest)

    def _out(self, certain: list[tuple[str, tuple[int, ...]]]) -> Iterator[tuple]:
        for edits, turns in certain:
            for i, edit in enumerate(edits):
                if edit == "I":
                    yield edit, None, _ROLE[turns[i]], ""
                    continue
                turn, role, text = self.waiting.popleft()
                yield edit, turn, _ROLE[turns[i]] if edit == "R" else role, text


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the crc32 of ``conv_id:turn``, and ``dropped`` for those that are gone.

    Null roles and texts become one space, and so do null numbers in the hash.
    """
    space = F.lit(" ")
    name = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = name("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, each with its first fault, sorted by conversation and turn.

    One shuffle: the window's partitions lie within a conversation, so it only sorts. Spark's sorts
    spill, and the window numbers rows as they pass.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), dropped.alias("dropped"),
    )
    dealt = rows.repartition("conv")
    same = Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.col("text").rlike(_ANY), "blank")
        .when(F.col("seen") > 1, "duplicate")
        .when(~F.col("text").rlike(_ENDED), "truncated")
    )
    marked = dealt.withColumn("seen", F.row_number().over(same)).withColumn("fault", fault).drop("seen")
    in_order = marked.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")
    # Turns travel as text, so that nulls beside large integers stay exact.
    return in_order.withColumn("turn", F.col("turn").cast("string"))


_MISSING = object()


def _walk(batches: Iterator[pd.DataFrame], begin, edit, end) -> Iterator[pd.DataFrame]:
    """Conversations one after the other; frames of what ``edit`` and ``end`` return, about 10,000 rows each."""
    name, state, talk, out = _MISSING, None, None, []
    for frame in batches:
        columns = (frame[c].tolist() for c in ("conv", "turn", "role", "text", "dropped", "fault"))
        for conv, turn, role, text, dropped, fault in zip(*columns):
            if conv != name:
                if talk is not None:
                    out.extend(edit(state, x) for x in talk.close())
                    out.append(end(name, talk, state))
                name, talk = conv, Conversation()
                state = begin(conv)
            if not dropped:
                out.extend(edit(state, x) for x in talk.add(None if turn is None else int(turn), role, text, fault))
        out = [x for x in out if x is not None]
        if len(out) > 10_000:
            yield pd.DataFrame(out)
            out = []
    if talk is not None:
        out.extend(edit(state, x) for x in talk.close())
        out.append(end(name, talk, state))
    out = [x for x in out if x is not None]
    if out:
        yield pd.DataFrame(out)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation: conv_id, seq (from 0), edit (K, R, D or I), turn, role and text.

    ``rows`` has conv_id, turn, role and text; other columns are left out. Rows of a conversation go
    by turn, nulls first, then by role and text; a null role or text counts as one space, a null
    conv_id is a conversation like others, rows with ``dropped`` set (a column that may be missing)
    are no part of it. Without the rows of edit D this is the repaired conversation: its turns
    are those of ``seq``. An inserted turn has no text and a null turn. An empty table has no edits.

    A conversation is a sequence, so one task reads it, as a sorted stream: it holds one batch of
    rows and the rows whose edits are not certain yet, however long the conversation is. Those
    stay few, unless ways that differ far back are equally cheap.
    """

    def made(state, x):
        state["seq"] += 1
        edit, turn, role, text = x
        return {"conv": state["conv"], "seq": state["seq"] - 1, "edit": edit, "turn": turn, "role": role, "text": text}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _walk(batches, lambda conv: {"conv": conv, "seq": 0}, made, lambda *_: None):
            yield frame.astype({"turn": "Int64"}) if "turn" in frame else frame

    edits = _in_order(rows).mapInPandas(run, "conv string, seq long, edit string, turn long, role string, text string")
    conv = F.col("conv").cast(dict(rows.dtypes)["conv_id"]).alias("conv_id")
    return edits.select(conv, "seq", "edit", "turn", "role", "text")


def summarise(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and initials of its edits, and a digest of its repair.

    Rows, order and nulls as in ``repair``. ``gaps`` counts turn numbers that are missing between the
    first and the last; ``blank``, ``duplicate`` and ``truncated`` count rows by their first fault,
    ``illegal`` neighbours whose roles do not follow one another; ``audit`` has the initials of the
    edits in order; ``repaired_sha256`` is that of the repaired ``role:text`` lines, hashed
    as they become certain. A conversation whose rows are all dropped has zeros, an empty audit and
    the digest of the empty text. An empty table has no rows.
    """

    def begin(conv):
        return {"hash": hashlib.sha256(), "audit": [], "any": False}

    def edit(state, x):
        letter, _, role, text = x
        state["audit"].append(letter)
        if letter != "D":
            state["hash"].update((("\n" if state["any"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            state["any"] = True

    def end(conv, talk, state):
        return {
            "conv": conv, "gaps": talk.gaps, **talk.faults, "illegal": talk.illegal, "cost": talk.cost,
            "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest(),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _walk(batches, begin, edit, end)

    schema = (
        "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string"
    )
    found = _in_order(rows).mapInPandas(run, schema)
    conv: Column = F.col("conv").cast(dict(rows.dtypes)["conv_id"]).alias("conv_id")
    return found.select(conv, *[c for c in found.columns if c != "conv"])
