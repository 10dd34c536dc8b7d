"""Chat formatting with minimum-cost role repair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandline.llm.text import arrow_schema
from strandline.session import cut

ROLES = ("system", "user", "assistant")
#: States of the automaton: nothing yet, or the role of the last message.  A chat has at most one system message,
#: first; then user and assistant take turns, and the assistant has the last word.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 2, 5, 3
#: Empty messages that close a chat, by its last state.
TAIL = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
FAR = 1 << 60


def _options() -> dict[tuple[int, int | None], list[tuple[int, int, str, int | None]]]:
    """For each state and role, what may be done with a turn, in order of preference: cost, new state, action, insertion."""
    table = {}
    for state in NEXT:
        for role in (SYSTEM, USER, ASSISTANT, None):
            away = lambda q, role=role: 0 if q == role else RELABEL
            found = [(away(q), q, "keep" if q == role else "relabel", None) for q in NEXT[state]]
            if state != START:
                found.append((MERGE + away(state), state, "merge", None))
            found += [(INSERT + away(q), q, "keep" if q == role else "relabel", x) for x in NEXT[state] if x != SYSTEM for q in NEXT[x]]
            table[state, role] = found
    return table


OPTIONS = _options()
END_COST = [INSERT * len(TAIL[s]) for s in range(4)]
CODE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}


def back_over(roles: list, after: list[int]) -> list[list[int]]:
    """Least cost from each state before each turn to the end, given the costs after the last turn."""
    costs = [after]
    for role in reversed(roles):
        last = costs[-1]
        costs.append([min(c + last[q] for c, q, _, _ in OPTIONS[s, role]) for s in range(4)])
    costs.reverse()
    return costs


def choose(roles: list, costs: list[list[int]], state: int) -> list[tuple[int, int, str, int | None]]:
    """The first option of least cost at every turn: so the repair doesn't depend on how the turns are split up."""
    path = []
    for i, role in enumerate(roles):
        option = next(o for o in OPTIONS[state, role] if o[0] + costs[i + 1][o[1]] == costs[i][state])
        path.append(option)
        state = option[1]
    return path


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Consecutive rows of one conversation within a partition."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row[:width])
    if rows:
        yield key, rows


def _edges(batches, make):
    """Of a partition's runs only the first and the last can go on in another; ``make`` sums up their roles."""
    first = last = None
    for n, (key, rows) in enumerate(_runs(batches, 2)):
        last = (n, None if key is None else str(key), make(n == 0, [CODE.get(r[1]) for r in rows]))
        first = first or last
    pid = TaskContext.get().partitionId()
    found = [] if first is None else [first] if first[0] == last[0] else [first, last]
    yield pa.RecordBatch.from_arrays(
        [pa.array([pid] * len(found), pa.int32()), pa.array([x[0] > 0 for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int64()))],
        ["pid", "later", "conv", "sums"],
    )


def repair_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Repair the roles of every conversation at least cost and render it.

    Returns a row for each turn: ``conv_id, turn, role, text_hash, new_role, action`` (keep, relabel or merge),
    ``inserted`` (role of an empty message put before it), ``cost`` and ``rendered``; the ``rendered`` pieces of a
    conversation in order of ``turn, role, text_hash`` are its repaired text, closing messages included.

    Turns are sorted over partitions, so that a conversation of any length is spread out.  The automaton's least
    costs over a run of turns are a small min-plus matrix; those of runs that cross partitions are combined on the
    driver (two a partition), which fixes the costs to the end and then the state at each boundary.

    A null or unknown role costs a relabel whatever it becomes; a null text is empty; a null conv_id is a
    conversation of its own; turns that tie go by role, then by the hash of their text; repeated rows are turns of their
    own, next to each other; an empty table gives an empty frame; other columns are ignored.  A task holds the rows of
    one conversation in its partition, not more.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(role_col).cast("string").alias("role"), F.col(turn_col).alias("turn"), F.col(text_col).cast("string").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "text_hash"]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    summary = "pid int, later boolean, conv string, sums array<bigint>"
    unit = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    # Matrix of a run, row by row: least cost from each state to each.
    by_run = lambda first, roles: [c for column in (back_over(roles, unit[j])[0] for j in range(4)) for c in column]
    found = sorted(rows.select("conv_id", "role").mapInArrow(lambda b: _edges(b, by_run), summary).collect(), key=lambda r: (r.pid, r.later))
    after: dict[tuple[int, bool], list[int]] = {}
    going_on: set[tuple[int, bool]] = set()
    costs, conv = END_COST, object()
    for r in reversed(found):
        if r.conv == conv:
            going_on.add((r.pid, r.later))
        else:
            costs = END_COST
        after[r.pid, r.later], conv = costs, r.conv
        costs = [min(min(r.sums[4 * j + i] + costs[j] for j in range(4)), FAR) for i in range(4)]

    def ends(first: bool, roles: list) -> list[int]:
        pid = TaskContext.get().partitionId()
        costs = back_over(roles, after.get((pid, not first), END_COST))
        return [(choose(roles, costs, s) or [(0, s)])[-1][1] for s in range(4)]

    begin: dict[int, int] = {}
    state, conv = START, object()
    for r in sorted(rows.select("conv_id", "role").mapInArrow(lambda b: _edges(b, ends), summary).collect(), key=lambda r: (r.pid, r.later)):
        if r.conv != conv:
            state = START
        if not r.later:
            begin[r.pid] = state
        state, conv = r.sums[state], r.conv

    out = arrow_schema(_result_schema(rows))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held = None
        for n, run in enumerate(_runs(batches, 5)):
            if held:  # not the partition's last run
                yield _rendered(held[1], after.get((pid, False), END_COST) if held[0] == 0 else END_COST, begin.get(pid, START) if held[0] == 0 else START, held[0] == 0 and (pid, False) in going_on, out)
            held = n, run[1]
        if held:
            at = (pid, held[0] > 0)
            yield _rendered(held[1], after[at], begin.get(pid, START) if held[0] == 0 else START, at in going_on, out)

    return rows.select("conv_id", "role", "turn", "text", "text_hash").mapInArrow(render, _result_schema(rows))


def _result_schema(rows: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text_hash bigint, new_role string, action string, inserted string, cost bigint, rendered string"


def _rendered(rows: list[tuple], after: list[int], state: int, goes_on: bool, schema: pa.Schema) -> pa.RecordBatch:
    roles = [CODE.get(r[1]) for r in rows]
    path = choose(roles, back_over(roles, after), state)
    name = lambda s: ROLES[s - 1]
    empty = lambda s: f"<|im_start|>{name(s)}\n<|im_end|>\n"
    out = []
    for i, ((conv, role, turn, text, text_hash), (cost, new, action, inserted)) in enumerate(zip(rows, path)):
        if action == "merge":
            piece = "\n" + (text or "")
        else:
            piece = ("<|im_end|>\n" if state != START else "") + (empty(inserted) if inserted else "") + f"<|im_start|>{name(new)}\n{text or ''}"
        if i == len(rows) - 1 and not goes_on:
            piece += "<|im_end|>\n" + "".join(map(empty, TAIL[new]))
            cost += END_COST[new]
        out.append((conv, turn, role, text_hash, name(new), action, name(inserted) if inserted else None, cost, piece))
        state = new
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
