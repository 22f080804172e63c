"""Repair of the turn structure of conversations by weighted interval parsing.

A sound conversation has the roles (system? (user assistant)+)?. Rows are
edited at least cost: keep (0), rerole to user or assistant (3), delete (4,
the only edit of a blank or repeated row), insert an empty user or assistant
row anywhere (3); a row that is cut off and not deleted costs 3 more.

The repair grammar is in Chomsky normal form. Its nonterminals are pairs of
states of the role pattern: [p, q] derives the rows, and edits, that lead from
state p to q.

    [p, q] -> [p, r] [r, q]
    [p, q] -> row, by an edit, with any inserted rows before and behind it

The cell of a span of rows holds, for every nonterminal, the least (cost,
audit), where the audit has the edits' initials in order. Cells are combined
bottom-up by span length: single rows, then spans of two, four and so on.
With these nonterminals every split of a span gives the same cell, so one
split is combined where a general grammar needs all: two audits of one span and
nonterminal with equal cost are never prefixes of each other (they have one
letter per row, so the longer one would have more inserts and cost more),
hence the least audit of a whole is made of least audits of its parts.

Rows of a conversation come in the order of turn (nulls first), role, text.
A null role or text is one space. A first character of a role other than s, u
and a, or none, cannot be kept. A null conversation id is an id like any
other. Other columns are ignored. A conversation becomes one row, so it has to
fit into a task. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, ship

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3

# The role pattern: start, after system, after user, after assistant.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_SOUND = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL = ("su", "ua", "au")

Cell = dict[tuple[int, int], tuple[int, str]]


def _put(cell: Cell, at: tuple[int, int], value: tuple[int, str]) -> bool:
    if at in cell and cell[at] <= value:
        return False
    cell[at] = value
    return True


def combine(left: Cell, right: Cell) -> Cell:
    """[p, q] -> [p, r] [r, q]"""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                _put(out, (p, q), (cost + more, audit + rest))
    return out


def _closure() -> Cell:
    """What inserted rows alone derive, the empty sequence included."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    insert: Cell = {(p, q): (INSERT, "I") for (p, role), q in _NEXT.items() if role in _ROLES}
    while any([_put(cell, at, value) for at, value in combine(cell, insert).items()]):
        pass
    return cell


CLOSURE = _closure()


@lru_cache(maxsize=None)
def row_cell(kind: str) -> Cell:
    """The cell of one row: its role's initial in lower case, in upper case if cut off; x is to be deleted, o no role."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "x":
        cut = CUT_OFF if kind.isupper() else 0
        for (p, role), q in _NEXT.items():
            if role == kind.lower():
                _put(cell, (p, q), (KEEP + cut, "K"))
            if role in _ROLES:
                _put(cell, (p, q), (REROLE + cut, "R"))
    return combine(combine(CLOSURE, cell), CLOSURE)


def parse(kinds: str) -> tuple[int, str]:
    """The least (cost, audit) of a conversation given by the kinds of its rows."""
    cells = [row_cell(k) for k in kinds] or [CLOSURE]
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return min(cells[0][0, q] for q in _SOUND if (0, q) in cells[0])


_parse_short = lru_cache(maxsize=1 << 16)(parse)


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of the edited conversation."""
    out, state, at = [], 0, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit != "K":
            role = _ROLES["a" if state == 2 else "u"]
        out.append((role, text))
        state = _NEXT[state, role[0]]
    return out


FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns")


def _judge(conv: object, rows: list[tuple]) -> tuple:
    """What is wrong with a conversation, and its repair; rows are (turn, role, text, is_blank, is_cut_off)."""
    kinds, seen = [], set()
    blank = duplicate = truncated = illegal = 0
    for _, role, text, is_blank, is_cut in rows:
        again = (role, text) in seen
        seen.add((role, text))
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if is_blank:
            blank, kind = blank + 1, "x"
        elif again:
            duplicate, kind = duplicate + 1, "x"
        elif is_cut:
            truncated, kind = truncated + 1, kind.upper()
        kinds.append(kind)
    for one, two in zip(rows, rows[1:]):
        illegal += one[1][:1] + two[1][:1] not in _LEGAL
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    word = "".join(kinds)
    cost, audit = (_parse_short if len(word) <= 32 else parse)(word)
    fixed = repaired([(r[1], r[2]) for r in rows], audit)
    return conv, gaps, blank, duplicate, truncated, illegal, cost, audit, [{"role": r, "text": t} for r, t in fixed]


def _repair(schema: pa.Schema, rows_out: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        current, held = None, []
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conv != current:
                    done.append(_judge(current, held))
                    held = []
                current = conv
                held.append(tuple(row))
            if len(done) >= rows_out:
                yield out()
        if held:
            done.append(_judge(current, held))
        if done:
            yield out()
    return run


def repair(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, its faults, the cheapest repair and the repaired turns (role, text).

    `blank`, `duplicate` and `truncated` count rows by their first fault:
    nothing but ASCII white space, role and text of an earlier row, a last
    visible character other than `.`, `!` and `?`. `gaps` counts missing turn
    numbers between the least and the greatest, `illegal` adjacent roles that
    are not system-user, user-assistant or assistant-user.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(messages.sparkSession)

    def solid(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(" "))

    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                           solid(role).alias("role"), solid(text).alias("text"))
    end = F.rtrim(F.col("text"), F.lit(WHITESPACE))
    rows = rows.select("*", (end == "").alias("is_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("is_cut"))
    kind = dict(messages.dtypes)[conv_id]
    counts = ", ".join(f"{n} long" for n in FIELDS[1:7])
    schema = f"conv_id {kind}, {counts}, audit string, turns array<struct<role string, text string>>"
    grouped = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    spark_schema = messages.sparkSession.createDataFrame([], schema).schema
    return grouped.mapInArrow(_repair(to_arrow_schema(spark_schema)), schema)
