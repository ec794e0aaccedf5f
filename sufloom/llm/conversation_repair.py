"""Repair of conversations whose turns are missing, empty, repeated, cut off or out of order.

A conversation is right if its roles' initials are `(s?(ua)+)?`: perhaps a system turn, then user and assistant in turn.
The cheapest edits make it so: keep a row (0, K), give it another role, user or assistant (3, R), delete it (4, D; rows that
are blank or repeat an earlier row must be), or insert an empty turn anywhere (3, I); a truncated row that stays costs 3 more.
Of edits of equal cost the initials that come first in ASCII order win.

Method: a Viterbi pass over the rows in order, with four states (nothing yet, after s, after u, after a). The survivors of
the states are paths in a tree of backpointers whose nodes count their references; a survivor that is replaced frees the
nodes only it needs. Once the survivors of all states have an ancestor in common, the edits up to it are certain and are
emitted, so what is held is the unresolved end of the paths and nothing else. Equal costs are decided by comparing the
complete unresolved ends, down to where the two paths part. Survivors that can't win any more (the first two states, once
another one is ahead by what they could make good) are dropped, or the tree would be held by them for ever.

Spark shuffles each row once, by conversation; repeats are found by a window over the same partitioning and rows ordered
by a second sort in the task, both of which spill. The pass reads a task's rows as a stream, in bounded batches. A
conversation's audit is one string and its digest runs over its lines in order, so one task reads all of a conversation:
that holds its audit (a byte an edit) and the unresolved end, however many rows there are. Rows of roles other than user,
assistant and system at every turn can keep two paths apart, and these rows' texts held, to the end of the conversation.

Rows are ordered by turn, nulls first, then by role and text. Defined results: a null role or text is one space, and so are
null ids where a row's checksum is taken; rows with a null conv_id are one conversation. An empty role has no initial and
is never kept as it is. Repeated rows are rows of their own, so all but the first are duplicates. A conversation without
rows (all dropped) has zeros, an empty audit and the digest of an empty string. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sufloom.llm.common import small_batches

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}  # the state after an initial, from each state
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
EDITS = "conv_id long, place long, edit string, turn long, role string, text string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Node:
    """The last edit of a path; parent is the edit before it. refs: children, and states whose survivor this is."""

    __slots__ = ("parent", "edit", "row", "role", "depth", "refs", "held")

    def __init__(self, parent, edit, row=None, role=None):
        self.parent, self.edit, self.row, self.role = parent, edit, row, role
        self.depth, self.refs, self.held = (parent.depth + 1 if parent else 0), 0, 0
        if parent:
            parent.refs += 1


def comes_before(a: Node, x: str, b: Node, y: str) -> bool:
    """Whether the edits up to a, then x, come before those up to b, then y. Equal costs over the same rows mean that neither
    is the other's beginning."""
    left, right = [x], [y]
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1]


class Repair:
    """The cheapest edits of one conversation, fed row by row. feed() and finish() give the edits that are certain, in order,
    as nodes with edit, row (what was fed) and role."""

    def __init__(self):
        self.root = Node(None, "")
        self.alive: dict[int, tuple[int, Node]] = {}
        self._hold({0: (0, self.root)})
        self._inserted()
        self.most = 0  # the greatest number of unresolved edits so far

    def _hold(self, states: dict[int, tuple[int, Node]]) -> None:
        old, self.alive = self.alive, states
        for _, node in states.values():
            node.refs += 1
            node.held += 1
        for _, node in old.values():
            self._free(node)

    def _free(self, node: Node) -> None:
        node.refs -= 1
        node.held -= 1
        while node.refs == 0 and node is not self.root:
            parent = node.parent
            parent.refs -= 1
            node = parent

    def _better(self, cost: int, parent: Node, edit: str, than) -> bool:
        return than is None or cost < than[0] or (cost == than[0] and comes_before(parent, edit, than[1], than[2]))

    def _inserted(self) -> None:
        """Empty turns behind the survivors: u after nothing, s or a; then a after u."""
        states = dict(self.alive)
        for sources, target, initial in (((0, 1, 3), 2, "u"), ((2,), 3, "a")):
            best = None
            for s in sources:
                if s in states and self._better(states[s][0] + 3, states[s][1], INSERT, best):
                    best = (states[s][0] + 3, states[s][1], INSERT)
            own = states.get(target)
            if best and (own is None or best[0] < own[0] or (best[0] == own[0] and self._shorter(best, own[1]))):
                states[target] = (best[0], Node(best[1], INSERT, None, NAMES[initial]))
        self._hold(states)

    @staticmethod
    def _shorter(best, node: Node) -> bool:
        return comes_before(best[1], best[2], node.parent, node.edit) if node.parent else False

    def feed(self, row, initial: str, must_go: bool, truncated: bool) -> Iterator[Node]:
        best: dict = {}

        def offer(target, cost, parent, edit, role):
            if target is not None and self._better(cost, parent, edit, best.get(target)):
                best[target] = (cost, parent, edit, role)

        for state, (cost, node) in self.alive.items():
            offer(state, cost + 4, node, DELETE, None)
            if not must_go:
                stays = cost + (3 if truncated else 0)
                if initial in NEXT:
                    offer(NEXT[initial][state], stays, node, KEEP, initial)
                for other in "ua":
                    if other != initial:
                        offer(NEXT[other][state], stays + 3, node, REROLE, NAMES[other])
        self._hold({t: (cost, Node(parent, edit, row if edit != DELETE else None, role)) for t, (cost, parent, edit, role) in best.items()})
        self._inserted()
        self._drop()
        yield from self._certain()

    def _drop(self) -> None:
        """Leave out survivors that can't win. What can follow nothing can follow an assistant turn, but for a system turn,
        whose deletion costs 4; what can follow a system turn can follow an assistant turn."""
        if 3 not in self.alive:
            return
        states, (cost, node) = dict(self.alive), self.alive[3]
        if 0 in states and states[0][0] > cost + 4:
            del states[0]
        if 1 in states and (states[1][0] > cost or (states[1][0] == cost and comes_before(node, "", states[1][1], ""))):
            del states[1]
        if len(states) < len(self.alive):
            self._hold(states)

    def _certain(self) -> Iterator[Node]:
        if self.root.held or self.root.refs > 1:
            self.most = max(self.most, max(n.depth for _, n in self.alive.values()) - self.root.depth)
            return
        path, node = [], next(iter(self.alive.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and not self.root.held and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            yield self.root

    def finish(self) -> tuple[int, list[Node]]:
        """The least cost, and the edits that were still open."""
        ends = [self.alive[s] for s in (0, 3) if s in self.alive]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or (c == cost and comes_before(n, "", node, "")):
                cost, node = c, n
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return cost, path[::-1]


def fault(text: str, seen: bool) -> str:
    """blank, duplicate, truncated or nothing: a row's first fault."""
    end = text.rstrip(SPACE)
    return "blank" if not end else "duplicate" if seen else "truncated" if end[-1] not in ".!?" else ""


class Conversation:
    """One conversation's counts and edits, as its rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.turns, self.least, self.last = 0, None, 0, None, None

    def add(self, turn, role: str, text: str, seen: bool) -> Iterator[Node]:
        found, initial = fault(text, seen), role[:1]
        if found:
            self.faults[found] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns, self.least, self.last = self.turns + 1, turn if self.least is None else self.least, turn
        yield from self.repair.feed((turn, role, text), initial, found in ("blank", "duplicate"), found == "truncated")

    def gaps(self) -> int:
        return self.last - self.least + 1 - self.turns if self.turns else 0


def repaired(node: Node) -> tuple:
    """turn, role, text of the row that an edit leaves: all null for a deleted one."""
    if node.edit == DELETE:
        return None, None, None
    turn, role, text = node.row or (None, None, "")
    return turn, role if node.edit == KEEP else node.role, text


def conversations_of(batches) -> Iterator[tuple[str, Conversation, Node | int | None]]:
    """("edit", conversation, node) for each edit and ("end", conversation, cost) for each conversation of a task's sorted rows."""
    now = None

    def close(c):
        cost, rest = c.repair.finish()
        yield from (("edit", c, n) for n in rest)
        yield "end", c, cost

    for batch in batches:
        for conv_id, turn, role, text, copies, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "seen"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield from close(now)
                now = Conversation(conv_id)
            for i in range(copies):
                for node in now.add(turn, role, text, seen or i > 0):
                    yield "edit", now, node
    if now is not None:
        yield from close(now)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) as crc32(conv_id:turn) % 20 damages them: 0 drops a row (0 copies), 1 empties
    its text, 2 takes its full stops, question and exclamation marks, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    draw = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") <= 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 0, "").when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) by conversation and in order within each task, with seen: an earlier row of
    the conversation has the same role and text. One shuffle."""
    rows = small_batches(rows).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    order = [F.col("turn").asc_nulls_first()]
    number = F.row_number().over(Window.partitionBy("conv_id", "role", "text", (F.col("copies") > 0)).orderBy(*order))
    marked = rows.repartition("conv_id").withColumn("seen", number > 1)
    return marked.sortWithinPartitions("conv_id", *order, "role", "text")


def repair_edits(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R, D, I), turn, role, text: the edits of each conversation, with the row that each leaves."""

    def run(batches):
        out, place = [], 0
        for kind, c, x in conversations_of(batches):
            if kind == "end":
                place = 0
                continue
            out.append((c.conv_id, place, x.edit, *repaired(x)))
            place += 1
            if len(out) >= 2000:
                yield _batch(out, EDITS)
                out = []
        if out:
            yield _batch(out, EDITS)

    return in_order(rows).mapInArrow(run, EDITS)


def repair_summaries(rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation: counts before the repair, and cost, audit and digest of the lines `role:text` after it."""

    def run(batches):
        out, audit, digest, lines = [], [], hashlib.sha256(), 0
        for kind, c, x in conversations_of(batches):
            if kind == "edit":
                audit.append(x.edit)
                _, role, text = repaired(x)
                if role is not None:
                    digest.update(f"{'\n' if lines else ''}{role}:{text}".encode())
                    lines += 1
                continue
            out.append((c.conv_id, c.gaps(), *c.faults.values(), c.illegal, x, "".join(audit), digest.hexdigest()))
            audit, digest, lines = [], hashlib.sha256(), 0
            if len(out) >= 2000:
                yield _batch(out, SUMMARY)
                out = []
        if out:
            yield _batch(out, SUMMARY)

    return in_order(rows).mapInArrow(run, SUMMARY)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
