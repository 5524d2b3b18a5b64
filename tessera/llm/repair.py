"""Repair of the structure of conversations: the cheapest edits after which the roles follow a grammar.

The rows of a conversation are read once, in order, by a generalised LR parser of the role grammar.  Its stacks
share their lower parts; at each row a stack may keep it, give it another role, delete it, or have an empty row put
before it, each at its cost.  Stacks with equal tops accept the same rest, so they merge into the one with the
smallest (cost, audit), the audit being the initials of its edits.  A stack that costs more than the cheapest one and
all it takes to go on as any other goes, else the one that deletes every row would stay.  Actions before the last row
that all stacks agree on are passed on at once, so a conversation of any length is streamed.

Faults are found by Spark before: a row is blank, or its role and text stood earlier in the conversation (a window
over equal rows, so that no task has to remember what it saw), or it ends without a closing mark.

Defined cases: a null role or text counts as one space; a null turn comes first; rows with the same turn come by
role and text; rows without an id are one conversation; a conversation that has lost all its rows still gives its
summary; an empty table gives nothing; other columns are not taken, so their names can't clash.  A conversation goes
to one task, as the digest of its repaired text is sequential, but it is never held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, map_arrow

#: a conversation may have a system row first, then user and assistant rows in turn
GRAMMAR = (("conversation", ()), ("conversation", ("pairs",)), ("conversation", ("s", "pairs")), ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
RETAG, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: with this much, a stack can end or go on as any other one: the system row deleted, or a row put in
CATCH_UP = DELETE + 2 * INSERT
BLANK = " \t\n\x0b\x0c\r"
END = ""


# --- the parser's tables


class Tables:
    """Shifts and reductions of an SLR(1) automaton; where a state has several, all are followed."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar = (("start", (grammar[0][0],)), *grammar)
        heads = {left for left, _ in grammar}
        follow = self._follow(grammar, heads)
        first = self._closure(frozenset({(0, 0)}), grammar)
        numbers, todo = {first: 0}, [first]
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], list[int]] = {}
        while todo:
            items = todo.pop()
            own = numbers[items]
            for rule, dot in items:
                left, right = grammar[rule]
                if dot == len(right):
                    for t in follow[left]:
                        self.reduce.setdefault((own, t), []).append(rule)
            for symbol in {grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}:
                moved = frozenset((r, d + 1) for r, d in items if d < len(grammar[r][1]) and grammar[r][1][d] == symbol)
                target = self._closure(moved, grammar)
                if target not in numbers:
                    numbers[target] = len(numbers)
                    todo.append(target)
                self.goto[own, symbol] = numbers[target]

    @staticmethod
    def _closure(items: frozenset, grammar) -> frozenset:
        found = set(items)
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            if dot < len(grammar[rule][1]):
                new = {(k, 0) for k, (left, _) in enumerate(grammar) if left == grammar[rule][1][dot]} - found
                found |= new
                todo.extend(new)
        return frozenset(found)

    @staticmethod
    def _follow(grammar, heads) -> dict[str, set[str]]:
        empty = {left for left, right in grammar if not right}
        first: dict[str, set[str]] = {h: set() for h in heads}
        follow: dict[str, set[str]] = {h: set() for h in heads} | {"start": {END}}
        before = None
        while before != (before := str((first, follow, empty))):
            for left, right in grammar:
                if all(x in empty for x in right):
                    empty.add(left)
                for k, x in enumerate(right):
                    if all(y in empty for y in right[:k]):
                        first[left] |= first.get(x, {x})
                    if x in heads:
                        for y in right[k + 1 :]:
                            follow[x] |= first.get(y, {y})
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[left]
        return follow


class Stack(tuple):
    """(state, stack below or None); equal stacks are one object by the parser's tables of steps."""

    __slots__ = ()


_TABLES = Tables()
_BOTTOM = Stack((0, None))


def _reduced(stack: Stack, terminal: str) -> Iterator[Stack]:
    """The stack and what its reductions before this terminal make of it."""
    todo = [stack]
    while todo:
        now = todo.pop()
        yield now
        for rule in _TABLES.reduce.get((now[0], terminal), ()):
            left, right = _TABLES.grammar[rule]
            below = now
            for _ in right:
                below = below[1]
            target = _TABLES.goto.get((below[0], left))
            if target is not None:
                todo.append(Stack((target, below)))


@lru_cache(maxsize=4096)
def shifted(stack: Stack, terminal: str) -> tuple[Stack, ...]:
    return tuple(Stack((target, s)) for s in _reduced(stack, terminal) if (target := _TABLES.goto.get((s[0], terminal))) is not None)


@lru_cache(maxsize=4096)
def accepts(stack: Stack) -> bool:
    """Whether the input may end here: the start symbol's rule is complete."""
    return any(0 in _TABLES.reduce.get((s[0], END), ()) and s[1] == _BOTTOM for s in _reduced(stack, END))


class Edit:
    """An edit and, through `before`, all earlier ones of its stack; `depth` of them."""

    __slots__ = ("before", "depth", "action", "role", "text")

    def __init__(self, before: Edit | None, action: str, role: str | None = None, text: str | None = None):
        self.before, self.action, self.role, self.text = before, action, role, text
        self.depth = before.depth + 1 if before else 0


def _smaller(x: Edit, y: Edit) -> bool:
    """Whether x's audit is less than y's; they are compared back to their last common edit."""
    a, b = [], []
    while x is not y:
        if x.depth >= y.depth:
            a.append(x.action)
            x, skip = x.before, y.depth == x.depth
        else:
            skip = True
        if skip and y.depth > x.depth:
            b.append(y.action)
            y = y.before
    return a[::-1] < b[::-1]


def _common(edits: list[Edit]) -> Edit:
    """The last edit that all have."""
    edits = list({id(e): e for e in edits}.values())
    while len(edits) > 1:
        deepest = max(e.depth for e in edits)
        edits = list({id(e): e for e in (e.before if e.depth == deepest else e for e in edits)}.values())
    return edits[0]


class Repairer:
    """Takes rows one at a time; `settled` gives the edits that no later row can change."""

    def __init__(self):
        self.done = Edit(None, "")
        self.heads: dict[int, tuple[int, Edit, Stack]] = {}
        self._offer(self.heads, 0, self.done, _BOTTOM)
        self._insert(self.heads)
        self.rows, self.look = 0, 32

    @staticmethod
    def _offer(heads: dict, cost: int, edit: Edit, stack: Stack) -> bool:
        old = heads.get(stack[0])
        if old is None or cost < old[0] or (cost == old[0] and _smaller(edit, old[1])):
            heads[stack[0]] = (cost, edit, stack)
            return True
        return False

    def _insert(self, heads: dict) -> None:
        todo = list(heads.values())
        while todo:
            cost, edit, stack = todo.pop()
            for terminal, role in ROLES.items():
                for target in shifted(stack, terminal):
                    old = heads.get(target[0])
                    if old is None or cost + INSERT <= old[0]:
                        new = Edit(edit, "I", role, "")
                        if self._offer(heads, cost + INSERT, new, target):
                            todo.append(heads[target[0]])

    def take(self, role: str, text: str, delete: bool, cut_short: bool) -> None:
        heads: dict = {}
        extra = CUT_SHORT if cut_short else 0
        initial = role[:1]
        for cost, edit, stack in self.heads.values():
            self._offer(heads, cost + DELETE, Edit(edit, "D"), stack)
            if delete:
                continue
            for target in shifted(stack, initial) if initial else ():
                self._offer(heads, cost + extra, Edit(edit, "K", role, text), target)
            for terminal, new in ROLES.items():
                if terminal != initial:
                    for target in shifted(stack, terminal):
                        self._offer(heads, cost + extra + RETAG, Edit(edit, "R", new, text), target)
        self._insert(heads)
        least = min(cost for cost, _, _ in heads.values())
        self.heads = {state: head for state, head in heads.items() if head[0] <= least + CATCH_UP}
        self.rows += 1

    def _since(self, edit: Edit) -> list[Edit]:
        out = []
        while edit is not self.done:
            out.append(edit)
            edit = edit.before
        return out[::-1]

    def settled(self) -> list[Edit]:
        """Edits that all stacks share; looked for at growing distances while there are none."""
        if self.rows < self.look:
            return []
        last = _common([h[1] for h in self.heads.values()])
        out = self._since(last)
        self.look = self.rows + (32 if out else min(self.rows, 1 << 16))
        self.done = last
        last.before = None
        return out

    def finish(self) -> tuple[int, list[Edit]]:
        best = None
        for cost, edit, stack in self.heads.values():
            if accepts(stack) and (best is None or cost < best[0] or (cost == best[0] and _smaller(edit, best[1]))):
                best = (cost, edit)
        return best[0], self._since(best[1])


# --- Spark


def _damage(key: Column) -> Column:
    return F.crc32(key) % 20


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and lost: one row in 20 is lost, emptied, stripped of its marks, repeated or given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = _damage(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), twice.alias("_copy")).drop("_copy")


def find_faults(rows: DataFrame) -> DataFrame:
    """Adds `fault`: blank, duplicate, truncated or null.  Rows with `lost` are no rows, and stay as a mark of their conversation."""
    said = F.rtrim(F.col("text"), F.lit(BLANK))
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    ordered = W.partitionBy("conv_id", "lost", "_same").orderBy("turn")
    fault = F.when(F.col("lost"), None).when(said == "", "blank").when(F.row_number().over(ordered) > 1, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("_same", same).select("conv_id", "turn", "role", "text", "lost", fault.alias("fault"))


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_STRUCT = pa.struct([(k, pa.int64()) for k in SUMMARY])


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation in order: conv_id, part, action (K, R, D or I), role and text (null where deleted).

    A last row without action has the summary: gaps, faults, illegal neighbours and the cost.
    """

    def run(batches):
        now, out, parser, seen = object(), [], None, {}

        def put(edits: list[Edit]):
            for e in edits:
                out.append((now, seen["part"], e.action, e.role, e.text, None))
                seen["part"] += 1

        def close():
            if parser:
                cost, edits = parser.finish()
                put(edits)
                gaps = seen["last"] - seen["first"] + 1 - seen["turns"] if seen["turns"] else 0
                out.append((now, seen["part"], None, None, None, {"gaps": gaps, "cost": cost} | {k: seen[k] for k in ("blank", "duplicate", "truncated", "illegal")}))

        def flush():
            names = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), _STRUCT)
            cols = zip(*out, strict=True) if out else [[]] * 6
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, names, strict=True)], names=["conv_id", "part", "action", "role", "text", "summary"])
            out.clear()
            return made

        for b in batches:
            size = 0
            for c, turn, role, text, lost, fault in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if parser is None or c != now:
                    close()
                    now, parser = c, Repairer()
                    seen = {"part": 0, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initial": None}
                if lost:
                    continue
                if turn is not None and turn != seen["last"]:
                    seen["first"], seen["last"], seen["turns"] = turn if seen["turns"] == 0 else seen["first"], turn, seen["turns"] + 1
                if fault:
                    seen[fault] += 1
                if seen["initial"] is not None and seen["initial"] + role[:1] not in ("su", "ua", "au"):
                    seen["illegal"] += 1
                seen["initial"] = role[:1]
                parser.take(role, text, fault in ("blank", "duplicate"), fault == "truncated")
                put(parser.settled())
                size += len(text)
                if size > 4 << 20:
                    yield flush()
                    size = 0
            yield flush()
        close()
        yield flush()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt.select("conv_id", "turn", "role", "text", "lost", "fault"), run, "conv_id long, part long, action string, role string, text string, summary struct<" + ", ".join(f"{k}: long" for k in SUMMARY) + ">")


def digest(edits: DataFrame) -> DataFrame:
    """One row for each conversation from the edits of repair(), which stand together and in order, read one at a time."""

    def run(batches):
        audit, sha, some = [], hashlib.sha256(), False
        for b in batches:
            rows = []
            for c, action, role, text, summary in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if summary is None:
                    audit.append(action)
                    if action != "D":
                        sha.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                        some = True
                else:
                    rows.append((c, *(summary[k] for k in SUMMARY), "".join(audit), sha.hexdigest()))
                    audit, sha, some = [], hashlib.sha256(), False
            kinds = (*[pa.int64()] * (len(SUMMARY) + 1), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["conv_id", *SUMMARY, "audit", "repaired_sha256"])

    return map_arrow(edits.select("conv_id", "action", "role", "text", "summary"), run, "conv_id long, " + ", ".join(f"{k} long" for k in SUMMARY) + ", audit string, repaired_sha256 string")
