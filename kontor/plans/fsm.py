"""A finite-state scan over ordered rows, split into stretches.

Some parses are sequential: whether a line starts a record depends on every
line before it in the document.  Running that per document would put a whole
document in one task.  Instead:

1. the rows are range-partitioned by (key, order) and sorted: one shuffle, and a
   long key lies in as many tasks as it needs;
2. each task walks its rows once, in pieces of at most ``block_rows``.  A key that
   begins in the task starts in the initial state.  The task's first key may have
   begun in an earlier task, so it is walked from every possible entry state;
   walks that meet in one state go on as one, which takes a few rows as a rule;
3. what the walks give is stored, with the entry states it holds for, and with one
   row per first and last key of a task: the exit state and last "marked" row for
   each entry state;
4. per key, a linear fold of these few rows gives every stretch's entry state, and
   of the stored rows those that hold for it stay.

The machine is a table ``next_state[state][symbol]`` over small integers;
``marks`` lists the (state, symbol) pairs that mark a row (a record start).
The order column must be a non-negative integer (a line number); rows without a
key are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.plans.lineage import cut_lineage
from kontor.plans.prefix import running_total

DEFAULT_BLOCK_ROWS = 1 << 16
OPENING_ROWS = 256               # walked from every entry state before walks are compared

# columns that walks add: the stretch's first row, whether its entry state is open, the entry
# states that a row holds for (a bit each); of a function row, exit and mark by entry state
ADDED = [("_at", pa.int64()), ("_open", pa.bool_()), ("_for", pa.int64()),
         ("_exit", pa.list_(pa.int32())), ("_last", pa.list_(pa.int64()))]

#: ``gather(rows, symbols, state_before, mark, whole)``: rows of one key in order, -1 for a
#: mark that lies before the stretch (or nowhere); a table with the columns key and ``mark``.
Gather = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, bool], pa.Table]


def fsm_scan(df: DataFrame, key: str, order: str, symbol: str | Column,
             table: list[list[int]], initial: int, marks: set[tuple[int, int]],
             block_rows: int = DEFAULT_BLOCK_ROWS, gather: Gather | None = None,
             gathered: str | None = None,
             store: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Add ``state_before`` (int) and ``mark`` (the ``order`` value of the
    latest marked row at or before this row within its key, or null).

    With ``gather`` the rows are what it makes (schema ``gathered``) of runs of rows.  A run
    that is ``whole`` holds all rows of each of its marks; rows of a mark that lie on both
    sides of a cut between tasks, or are more than ``block_rows``, come in runs that are not.
    ``store`` writes the walks' rows, which are read more than once.
    """
    if gather is None:
        gather = _with_states
        gathered = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema),
                              "state_before int, mark bigint"])
    ordered = (df.filter(F.col(key).isNotNull()).repartitionByRange(key, order)
               .sortWithinPartitions(key, order)
               .withColumn("_sym", F.col(symbol) if isinstance(symbol, str) else symbol))
    machine = _Machine(table, initial, marks, block_rows, gather, key, order)
    walked = store(ordered.mapInArrow(
        machine.walk, f"{gathered}, _at long, _open boolean, _for long, _exit array<int>, "
                      "_last array<long>"))

    # fold the stretches' functions per key, in order: a linear pass over at most two
    # small rows per task (the function table, not the rows)
    def fold(functions: pa.Table) -> pa.Table:
        functions = functions.sort_by("_at")
        s, m = initial, None
        entries, marks_in = [], []
        for ex, last in zip(functions["_exit"].to_pylist(), functions["_last"].to_pylist()):
            entries.append(s)
            marks_in.append(m)
            m = m if last[s] is None else last[s]
            s = ex[s]
        return pa.table({"_of": functions[key], "_from": functions["_at"],
                         "_entry": pa.array(entries, pa.int32()),
                         "_entry_mark": pa.array(marks_in, pa.int64())})

    key_type = df.schema[key].dataType.simpleString()
    entries = (walked.filter(F.col("_exit").isNotNull()).select(key, "_at", "_exit", "_last")
               .groupBy(key).applyInArrow(
                   fold, f"_of {key_type}, _from long, _entry int, _entry_mark long"))
    rows = walked.filter(F.col("_exit").isNull()).join(
        F.broadcast(entries),
        F.col("_open") & (F.col(key) == F.col("_of")) & (F.col("_at") == F.col("_from")), "left")
    holds = F.expr("shiftright(_for, _entry) & 1") == 1
    kept = [c for c in walked.columns if c not in dict(ADDED)]
    return rows.filter(~F.col("_open") | holds).select(*[
        F.coalesce("mark", "_entry_mark").alias("mark") if c == "mark" else F.col(f"`{c}`")
        for c in kept])


def _with_states(rows, syms, before, mark, whole):
    return (rows.append_column("state_before", pa.array(before.astype(np.int32)))
            .append_column("mark", pa.array(mark, pa.int64(), mask=mark < 0)))


class _Walk:
    """One way through a stretch: the entry states it holds for, where it is, and the rows of
    the mark it is in (``loose``: rows of that mark have been given out, or lie before)."""

    def __init__(self, entries: list[int], state: int, loose: bool):
        self.entries, self.state, self.mark, self.loose = entries, state, -1, loose
        self.held: list[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]] = []

    def same_as(self, other: _Walk) -> bool:
        return ((self.state, self.mark, self.loose) == (other.state, other.mark, other.loose)
                and np.array_equal(self.states_held(), other.states_held()))

    def states_held(self) -> np.ndarray:
        return np.concatenate([h[2] for h in self.held]) if self.held else np.empty(0, np.int64)


class _Machine:
    def __init__(self, table, initial, marks, block_rows, gather, key, order):
        self.steps = [list(map(int, row)) for row in table]
        self.n_states, self.initial = len(table), initial
        self.stays = [all(s == t for t in row) for s, row in enumerate(self.steps)]
        self.is_mark = np.zeros((len(table), len(table[0])), dtype=bool)
        for s, y in marks:
            self.is_mark[s, y] = True
        self.block_rows, self.gather, self.key, self.order = block_rows, gather, key, order
        self.schema: pa.Schema | None = None             # of what is put out

    def walk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task, sorted by key and order."""
        own, walks, at, opening, first = None, [], 0, False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(self.key).dictionary_encode().indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(starts):
                run = pa.Table.from_batches([batch.slice(a, b - a)])
                name = run[self.key][0].as_py()
                if not walks or name != own:
                    if walks:
                        yield from self.end(walks, own, at, opening, False)
                    own, at, opening, first = name, run[self.order][0].as_py(), first, False
                    if self.schema is None:
                        none = np.empty(0, np.int64)
                        made = self.gather(run.slice(0, 0).drop_columns("_sym"), none, none, none,
                                           True)
                        self.schema = pa.schema([*made.schema, *(pa.field(*x) for x in ADDED)])
                    walks = ([_Walk([s], s, True) for s in range(self.n_states)] if opening
                             else [_Walk([*range(self.n_states)], self.initial, False)])
                i = 0
                while i < run.num_rows:
                    n = min(self.block_rows, OPENING_ROWS) if len(walks) > 2 else self.block_rows
                    for w in walks:
                        for out in self.go(w, run.slice(i, n)):
                            yield from self.tagged(out, w, at, opening)
                    walks, i = self.met(walks), i + n
        if walks:
            yield from self.end(walks, own, at, opening, True)

    def go(self, w: _Walk, piece: pa.Table) -> Iterator[pa.Table]:
        """Walk ``piece``; gathers what lies before the mark that its last row is in."""
        syms = piece["_sym"].to_numpy().astype(np.int64)
        pos = piece[self.order].to_numpy().astype(np.int64)
        piece = piece.drop_columns("_sym")
        if self.stays[w.state]:
            states = np.full(len(syms) + 1, w.state, np.int64)
        else:
            # the entry state is known: one step a row
            steps = self.steps
            states = np.fromiter(itertools.accumulate(
                syms.tolist(), lambda s, y: steps[s][y], initial=w.state), np.int64, len(syms) + 1)
        before = states[:-1]
        mark = np.maximum.accumulate(np.where(self.is_mark[before, syms], pos, -1))
        mark = np.where(mark >= 0, mark, w.mark)
        old = int(np.searchsorted(mark, w.mark, "right"))        # rows of the mark it came in
        cut = int(np.searchsorted(mark, mark[-1], "left")) if mark[-1] != w.mark else 0
        part = lambda a, b: (piece.slice(a, b - a), syms[a:b], before[a:b], mark[a:b])
        if mark[-1] != w.mark:
            if w.loose:
                yield from self.gathered([*w.held, part(0, old)], False)
                yield from self.gathered([part(old, cut)], True)
            else:
                yield from self.gathered([*w.held, part(0, cut)], True)
            w.held, w.loose = [], False
        w.held.append(part(cut, len(syms)))
        w.state, w.mark = int(states[-1]), int(mark[-1])
        if w.loose or sum(len(h[1]) for h in w.held) > self.block_rows:
            yield from self.gathered(w.held, False)
            w.held, w.loose = [], True

    def gathered(self, runs: list, whole: bool) -> Iterator[pa.Table]:
        if sum(len(r[1]) for r in runs):
            out = self.gather(pa.concat_tables([r[0] for r in runs]),
                              *(np.concatenate([r[i] for r in runs]) for i in (1, 2, 3)), whole)
            if out.num_rows:
                yield out

    @staticmethod
    def met(walks: list[_Walk]) -> list[_Walk]:
        """Walks that are where another one is go on as that one."""
        kept: list[_Walk] = []
        for w in walks:
            same = next((k for k in kept if w.same_as(k)), None)
            if same is None:
                kept.append(w)
            else:
                same.entries = same.entries + w.entries
        return kept

    def end(self, walks: list[_Walk], own, at: int, opening: bool,
            last: bool) -> Iterator[pa.RecordBatch]:
        """The rows still held, and what the stretch does to each entry state; the task's
        last key may go on in another task."""
        for w in walks:
            for out in self.gathered(w.held, not (last or w.loose)):
                yield from self.tagged(out, w, at, opening)
            w.held = []
        if not (opening or last):
            return
        walk_of = {s: w for w in walks for s in w.entries}
        column = {
            self.key: [own], "_at": [at], "_open": [opening],
            "_exit": [[walk_of[s].state for s in range(self.n_states)]],
            "_last": [[None if walk_of[s].mark < 0 else walk_of[s].mark
                       for s in range(self.n_states)]]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(column.get(f.name, [None]), f.type) for f in self.schema],
            schema=self.schema)

    def tagged(self, out: pa.Table, w: _Walk, at: int, opening: bool) -> list[pa.RecordBatch]:
        n = out.num_rows
        holds_for = sum(1 << s for s in w.entries)
        for (name, kind), value in zip(ADDED, (at, opening, holds_for, None, None)):
            column = pa.nulls(n, kind) if value is None else pa.repeat(pa.scalar(value, kind), n)
            out = out.append_column(name, column)
        return out.combine_chunks().to_batches()


def line_blocks(df: DataFrame, key: str, order: str, block_rows: int) -> DataFrame:
    """``df`` with ``_blk``: the block of each row, ascending with ``order`` within ``key``;
    at most ``block_rows`` different numbers in a block.  For jobs that need blocks by counts;
    ``fsm_scan`` cuts its rows by ranges."""
    shift = max(0, (block_rows // 2).bit_length() - 1)
    stretch = block_rows - (1 << shift) + 1          # places in which a block's ranges begin
    ranges = (df.groupBy(key, F.shiftright(order, shift).alias("_range"))
              .agg(F.count(F.lit(1)).alias("_n")))
    # 65,536 ranges at most under one key of the level above, of any 63-bit numbers
    levels = [F.shiftright("_range", bits) for bits in (48, 32, 16)]
    placed = running_total(ranges, [key], ["_range"], "_n", "_to", levels)
    blocks = placed.select(key, F.col("_range").alias("_own"),
                           F.expr(f"(_to - _n) div {stretch}").alias("_blk"))
    named = blocks.withColumnRenamed(key, "_own_key")
    return df.join(named, (F.col(key) == F.col("_own_key"))
                   & (F.shiftright(order, shift) == F.col("_own"))).drop("_own_key", "_own")
