"""Chat formatting by minimum-cost role repair.

Legal conversations are those an automaton accepts: an optional system turn first, then user and assistant turns in
alternation, beginning with a user turn. Each given turn is kept, relabelled, merged into the turn before it, or
preceded by an empty turn of the missing role; a dynamic program over the automaton's states finds the cheapest repair of
the whole conversation, and the repaired sequence is rendered.

The program is run in segments: a segment's effect is a small matrix of least costs from every state before it to every
state after it, and matrices are chained to the states at each segment's borders. So a conversation of any length,
even a third of all rows, is never gathered in one task: tasks hold a segment, and one task per conversation holds its
borders. Segments are runs of turn numbers; where these hold too many rows (ties) they are split by a hash of the text.

Defined cases: exact repeats of a turn (same conversation, turn, role and text) count once, with ``copies``; turns with
the same number are ordered by a hash of role and text; null turns come last; a null conversation is a conversation of its
own; unknown or null roles must be relabelled; a null text is empty; an empty table gives an empty result; other columns
of the input are ignored. Equal costs are settled for keeping, then merging, then relabelling, then inserting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import cut

ROLES = ("system", "user", "assistant")
# States: what the last rendered turn was. START: nothing yet.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
MERGE, RELABEL, INSERT = 2, 3, 4  # costs of a repair; keeping a turn costs nothing
SEGMENT_TURNS, SEGMENT_ROWS = 4096, 8192
_PATTERNS = 50_000  # role sequences whose costs a worker remembers; most conversations share a few
_SHORT = 64  # turns of the longest one it remembers: under a kilobyte each, so that they take some 60 MB at most; longer ones are reckoned anew
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}  # the legal turns
_ALIASES = {"human": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant"}
_STATE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
_NAME = {v: k for k, v in _STATE.items()}
_INF = 1 << 40


def _moves(role: int) -> list[tuple[int, int, int, int, int]]:
    """Ways to take one turn of ``role`` (0: none known): (state before, state after, cost, rank among equals, inserted state or 0)."""
    found = []
    for before in range(STATES):
        if before != START:  # merge into the turn before
            found.append((before, before, MERGE + (RELABEL if role != before else 0), 1 if role == before else 4, 0))
        for gap in (0, USER, ASSISTANT):
            if gap and gap not in NEXT[before]:
                continue
            for after in NEXT[gap or before]:
                same = role == after
                found.append((before, after, (0 if same else RELABEL) + (INSERT if gap else 0), (0 if same else 2) + (3 if gap else 0), gap))
    return sorted(found, key=lambda m: (m[2], m[3], m[0], m[1], m[4]))


MOVES = {role: _moves(role) for role in range(STATES)}


def _matrices() -> np.ndarray:
    out = np.full((STATES, STATES, STATES), _INF, np.int64)
    for role, moves in MOVES.items():
        for before, after, cost, _, _ in moves:
            out[role, before, after] = min(out[role, before, after], cost)
    return out


_MATRIX = _matrices()


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs through two segments, one after the other."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _INF)


def segment_matrix(roles: bytes) -> np.ndarray:
    """Least costs from each state before turns of these roles, a byte each, to each state after them."""
    return _known_matrix(roles) if len(roles) <= _SHORT else _matrix(roles)


def _matrix(roles: bytes) -> np.ndarray:
    total = np.full((STATES, STATES), _INF, np.int64)
    np.fill_diagonal(total, 0)
    for role in roles:
        total = chain(total, _MATRIX[role])
    return total


def repair(roles: bytes, enter: int, leave: int) -> list[list[int]]:
    """[state after, inserted state or 0, cost] of each turn on the cheapest way from ``enter`` to ``leave``."""
    return (_known_way(roles, enter, leave) if len(roles) <= _SHORT else _way(roles, enter, leave)).tolist()


def _way(roles: bytes, enter: int, leave: int) -> np.ndarray:
    best = np.full((len(roles) + 1, STATES), _INF, np.int64)
    best[len(roles), leave] = 0
    for k in range(len(roles) - 1, -1, -1):
        best[k] = np.minimum((_MATRIX[roles[k]] + best[k + 1][None, :]).min(axis=1), _INF)
    state, out = enter, []
    for k, role in enumerate(roles):
        for before, after, cost, _, gap in MOVES[role]:
            if before == state and cost + best[k + 1, after] == best[k, state]:
                out.append((after, gap, cost))
                state = after
                break
    return np.array(out, np.int8).reshape(-1, 3)  # a turn costs at most a few of each


_known_matrix, _known_way = lru_cache(maxsize=_PATTERNS)(_matrix), lru_cache(maxsize=_PATTERNS)(_way)


def role_state(role: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    for alias, meant in _ALIASES.items():
        name = F.when(name == alias, F.lit(meant)).otherwise(name)
    state = F.lit(0)
    for known, number in _STATE.items():
        state = F.when(name == known, F.lit(number)).otherwise(state)
    return state.cast("int")


def segments(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct turns with the segment each falls into: ``conv``, ``seg``, ``sub``, ``turn``, ``role``, ``text``, ``state``, ``h``, ``copies``."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"state": role_state(F.col("role")), "h": F.xxhash64("role", "text"), "seg": F.floor(F.col("turn") / SEGMENT_TURNS), "late": F.col("turn").isNull()})
    # Blocks of too many rows (turns that share a number) are cut finer: by number, then by leading bits of the hash.
    sizes = rows.groupBy("conv", "late", "seg").agg(F.count("*").alias("n")).filter(F.col("n") > SEGMENT_ROWS)
    sizes = cut(sizes.select(F.col("conv").alias("_c"), F.col("late").alias("_l"), F.col("seg").alias("_s"), "n"))
    if sizes.isEmpty():
        return rows.withColumns({"seg": F.col("seg") * SEGMENT_TURNS, "sub": F.lit(0).cast("long")})
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("late") == F.col("_l")) & F.col("seg").eqNullSafe(F.col("_s"))
    heavy, bits = F.col("n").isNotNull(), F.ceil(F.log2(F.col("n") / SEGMENT_ROWS))
    run = F.when(bits > 0, F.expr(f"shiftright(h, 64 - cast(least(ceil(log2(n / {SEGMENT_ROWS})), 40) as int))")).otherwise(F.lit(0))
    cut_finer = {"seg": F.when(heavy, F.col("turn")).otherwise(F.col("seg") * SEGMENT_TURNS), "sub": F.when(heavy, run).otherwise(F.lit(0)).cast("long")}
    return rows.join(sizes, same, "left").withColumns(cut_finer).drop("_c", "_l", "_s", "n")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by ``keys`` as frames of whole groups, with ``_group`` numbered in each."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        # only what comes after the last change of a key may go on in the next batch
        first = held[0].iloc[:1][keys]
        if len(held) > 1 and _equal(first, batch.iloc[-1:][keys]):
            continue
        whole = _numbered(pd.concat(held, ignore_index=True), keys)
        last = whole["_group"].iloc[-1]
        if last:
            yield whole[whole["_group"] < last]
        held = [whole[whole["_group"] == last].drop(columns="_group")]
    if held:
        yield _numbered(pd.concat(held, ignore_index=True), keys)


def _equal(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return all((x is y) or x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a.iloc[0], b.iloc[0], strict=True))


def _numbered(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    new = np.zeros(len(frame), bool)
    for k in keys:
        now, was = frame[k], frame[k].shift()
        new |= ((now != was) & ~(now.isna() & was.isna())).to_numpy()
    new[0] = False
    return frame.assign(_group=np.cumsum(new))


def _ranges(group: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return list(zip(edges, edges[1:], strict=False))


KEYS = ["conv", "late", "seg", "sub"]
_CARRIED = ("conv", "turn", "seg", "sub")


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in _groups(batches, KEYS):
        ranges, states = _ranges(frame["_group"].to_numpy()), frame["state"].tolist()
        heads = frame.iloc[[a for a, _ in ranges]][KEYS]
        yield heads.assign(costs=[segment_matrix(bytes(states[a:b])).ravel().tolist() for a, b in ranges])


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states at the borders of each conversation's segments, on its cheapest repair."""
    for frame in _groups(batches, ["conv"]):
        enter, leave, total, place = [], [], [], []
        costs = frame["costs"].tolist()
        for a, b in _ranges(frame["_group"].to_numpy()):
            mats = [np.array(c, np.int64).reshape(STATES, STATES) for c in costs[a:b]]
            best = np.zeros((len(mats) + 1, STATES), np.int64)
            for k in range(len(mats) - 1, -1, -1):
                best[k] = np.minimum((mats[k] + best[k + 1][None, :]).min(axis=1), _INF)
            state = START
            for k, m in enumerate(mats):
                enter.append(state)
                state = int(np.argmin(m[state] + best[k + 1]))
                leave.append(state)
                total.append(int(best[0, START]))
                place.append(k)
        yield frame[KEYS].assign(enter=enter, leave=leave, total=total, place=place)


OUT = ["conv", "turn", "role", "text", "copies", "new_role", "action", "inserted", "cost", "merged", "total", "seg_no", "pos"]


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A segment's first row is its border, the others are its turns."""
    for frame in _groups(batches, KEYS):
        states, parts, keep = frame["state"].tolist(), [], []
        enters, leaves, totals, places = (frame[c].tolist() for c in ("enter", "leave", "total", "place"))
        for a, b in _ranges(frame["_group"].to_numpy()):
            before = int(enters[a])
            way = repair(bytes(int(x) for x in states[a + 1 : b]), before, int(leaves[a]))
            keep += range(a + 1, b)
            for pos, (after, gap, cost) in enumerate(way):
                merged = not gap and after == before and after != START
                action = "merge" if merged else "insert" if gap else "keep" if after == states[a + 1 + pos] else "relabel"
                parts.append((_NAME[after], action, _NAME.get(gap), cost, merged, int(totals[a]), int(places[a]), pos))
                before = after
        out = frame.iloc[keep][["conv", "turn", "role", "text", "copies"]].reset_index(drop=True)
        yield pd.concat([out, pd.DataFrame(parts, columns=OUT[5:])], axis=1)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct turn of the repaired conversations, in order of ``position``.

    Columns: the conversation, ``position`` (segment number, then place in it, as one LONG), the turn, ``role`` as given,
    ``new_role``, ``action`` (keep, merge, relabel, insert), ``inserted`` (role of an empty turn put before), ``cost``,
    ``conversation_cost``, ``copies`` and ``rendered``: the turn's part of the rendered conversation, which is these
    parts joined in order, and a last end mark. The end mark of a turn stands at the head of the next part, for only
    that part knows whether it is merged into the turn.
    """
    rows = segments(turns, conv_col, turn_col, role_col, text_col)
    keys = KEYS
    types = {f.name: f.dataType for f in rows.schema if f.name in _CARRIED}

    def carried(df: DataFrame) -> DataFrame:
        # as text, for pandas would make nullable integers floating-point numbers
        return df.select(*[F.col(c).cast("string").alias(c) if c in _CARRIED else F.col(c) for c in df.columns])

    def restored(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])

    place = "conv string, late boolean, seg string, sub string"
    # a segment's turns stand in one partition, in order; turns of one number by hash, so that runs of the hash are runs of the order
    skinny = rows.select(*keys, "turn", "state", "h").repartition(*keys).sortWithinPartitions(*keys, F.col("turn").asc_nulls_last(), "h")
    mats = restored(carried(skinny.select(*keys, "state")).mapInPandas(_costs, f"{place}, costs array<long>"))
    mats = mats.repartition("conv").sortWithinPartitions(*keys)
    borders = restored(carried(mats).mapInPandas(_borders, f"{place}, enter long, leave long, total long, place long"))
    # each segment's border travels with its turns and stands first, so turns are moved once and no join is needed
    both = rows.withColumn("border", F.lit(1)).unionByName(borders.withColumn("border", F.lit(0)), allowMissingColumns=True)
    both = both.repartition(*keys).sortWithinPartitions(*keys, "border", F.col("turn").asc_nulls_last(), "h", "role", "text")
    out = carried(both.drop("border", "h")).mapInPandas(
        _repaired,
        "conv string, turn string, role string, text string, copies long, new_role string, action string, inserted string, cost long, merged boolean, total long, seg_no long, pos long",
    )
    out = restored(out)
    position = (F.col("seg_no") * F.lit(1 << 32) + F.col("pos")).alias("position")
    empty = F.when(F.col("inserted").isNotNull(), F.concat(F.lit("<|"), "inserted", F.lit("|>\n<|end|>\n"))).otherwise(F.lit(""))
    opens = F.concat(empty, F.lit("<|"), "new_role", F.lit("|>\n"), "text")
    first = (F.col("seg_no") == 0) & (F.col("pos") == 0)
    rendered = F.when(F.col("merged"), F.concat(F.lit("\n"), "text")).when(first, opens).otherwise(F.concat(F.lit("<|end|>\n"), opens))
    return out.select(
        F.col("conv").alias(conv_col), position, F.col("turn").alias(turn_col), F.col("role").alias(role_col), "new_role", "action", "inserted", "cost",
        F.col("total").alias("conversation_cost"), "copies", rendered.alias("rendered"),
    )
