"""Sweeps over the time of an entity: which row answers for which piece, where windows can't say it because rows expire.

The rows of a partition come sorted by entity; a task holds the rows of some entities at once, and the rows of one entity
cost n log n, however they overlap. Only positions are worked out row by row: values are taken by position, as Arrow columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc

#: Rows of whole groups that are swept together, at least.
CHUNK = 20_000


def latest(f: list, u: list, order: list, points: list) -> list[int]:
    """For each piece between consecutive points, the position of the row of highest order that covers it; -1 if none does.
    All boundaries of the rows must be among the points."""
    rows = sorted(range(len(f)), key=f.__getitem__)
    out, heap, k = [], [], 0
    for p in points[:-1]:
        while k < len(rows) and f[rows[k]] <= p:
            heappush(heap, (-order[rows[k]], rows[k]))
            k += 1
        while heap and u[heap[0][1]] <= p:
            heappop(heap)
        out.append(heap[0][1] if heap else -1)
    return out


def covering(f: list, u: list, ids: list, points: list) -> list[list]:
    """For each piece between consecutive points the ids of the rows that cover it."""
    begins: dict = {}
    ends: dict = {}
    for a, b, own in zip(f, u, ids, strict=True):
        begins.setdefault(a, []).append(own)
        ends.setdefault(b, []).append(own)
    out, open_ = [], set()
    for p in points[:-1]:
        open_.difference_update(ends.get(p, ()))
        open_.update(begins.get(p, ()))
        out.append(list(open_))
    return out


def whole_groups(key: str, work: Callable[[pa.Table, list[tuple[int, int]]], pa.Table | pa.RecordBatch]):
    """For mapInArrow over rows sorted by key: work(rows, [(start, stop) of each group]) for portions of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def batches_of(made: pa.Table | pa.RecordBatch) -> list[pa.RecordBatch]:
            return made.to_batches() if isinstance(made, pa.Table) else [made]

        def portion(rows: pa.Table, last: bool) -> tuple[pa.Table | pa.RecordBatch | None, int]:
            keys = rows.column(key).combine_chunks()
            changes = pc.indices_nonzero(pc.not_equal(keys[1:], keys[:-1])).to_pylist()
            starts = [0, *(i + 1 for i in changes)]
            ends = [*starts[1:], rows.num_rows]
            groups = list(zip(starts, ends, strict=True)) if last else list(zip(starts, ends, strict=True))[:-1]
            return (work(rows, groups), groups[-1][1]) if groups else (None, 0)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                rows = pa.Table.from_batches(held).combine_chunks()
                made, done = portion(rows, False)
                held = rows.slice(done).to_batches()
                if made is not None:
                    yield from batches_of(made)
        if held:
            made, _ = portion(pa.Table.from_batches(held).combine_chunks(), True)
            if made is not None:
                yield from batches_of(made)

    return run


def comparable(column: pa.ChunkedArray) -> list:
    """Boundaries as values that compare: whole numbers for dates and times, which may lie beyond what Python knows."""
    kind = column.type
    if pa.types.is_date32(kind):
        column = column.cast(pa.int32())
    elif pa.types.is_timestamp(kind):
        column = column.cast(pa.int64())
    return column.to_pylist()


def taken(column: pa.ChunkedArray, at: list[int]) -> pa.Array:
    """The column's values at these positions; null at -1."""
    found = column.take(pa.array([None if i < 0 else i for i in at], pa.int64()))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def eclipsed():
    """From _part, _live, _rid, _f, _u and any other columns: these others and those three with _eclipsed, whether a live row is
    on no piece of its part's time the one of highest _rid."""

    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        f, u, rid, live = comparable(rows.column("_f")), comparable(rows.column("_u")), rows.column("_rid").to_pylist(), rows.column("_live").to_pylist()
        gone = [False] * groups[-1][1]
        for i, j in groups:
            some = [k for k in range(i, j) if live[k]] if j - i > 1 else []
            if len(some) > 1:
                at, to = [f[k] for k in some], [u[k] for k in some]
                seen = latest(at, to, [rid[k] for k in some], sorted({*at, *to}))
                for x in set(range(len(some))).difference(seen):
                    gone[some[x]] = True
        return rows.slice(0, len(gone)).drop_columns(["_part", "_live"]).append_column("_eclipsed", pa.array(gone, pa.bool_()))

    return whole_groups("_part", work)


def pieces(entity: list[str], payload: list[str], given: list[str], kept_old: list[str], named: bool = False):
    """From the source and target rows of entities (_g, _target, _rid, _f, _u, _causal, _e_* and _v_*): the pieces between
    their boundaries that some row covers.

    _g, _p, _n; _sourced; _tf, _tu and _t_* of the target row that covers the piece; _last (the covering source row of highest
    _rid) with its _lf, _lu and _by (its _causal), and _s_* of it, for kept_old those of the last covering row that has a
    value; _next_to (the lowest _rid among rows that touch the piece), _first_rid and _cause (the least _causal) of the
    entity; _is_new (no target row) and the identity _e_*, a new entity's from its last row that has one. named: also _ids, the
    _rid of all source rows that cover the piece.
    """

    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        f, u, rid = comparable(rows.column("_f")), comparable(rows.column("_u")), rows.column("_rid").to_pylist()
        target, causal = rows.column("_target").to_pylist(), rows.column("_causal").to_pylist()
        held = {c: rows.column(f"_v_{c}").is_valid().to_pylist() for c in kept_old}
        known = {c: rows.column(f"_e_{c}").is_valid().to_pylist() for c in entity}
        n = rows.num_rows
        p_at, n_at, t_at, s_at, g_at, cause_at, next_to, first_rid, is_new, ids = ([] for _ in range(10))
        column_at = {c: [] for c in kept_old}
        entity_at = {c: [] for c in entity}
        for i, j in groups:
            ours = [k for k in range(i, j) if not target[k]]
            theirs = [k for k in range(i, j) if target[k]]
            where: dict = {}  # each boundary, with where to take it from: starts lie before ends
            for k in range(i, j):
                where.setdefault(f[k], k)
                where.setdefault(u[k], n + k)
            points = sorted(where)

            def over(some: list[int], order: list) -> list[int]:
                if not some:
                    return [-1] * (len(points) - 1)
                found = latest([f[k] for k in some], [u[k] for k in some], order, points)
                return [-1 if x < 0 else some[x] for x in found]

            last = over(ours, [rid[k] for k in ours])
            old = over(theirs, theirs)
            by_column = {c: over([k for k in ours if held[c][k]], [rid[k] for k in ours if held[c][k]]) for c in kept_old}
            begins: dict = {}
            ends: dict = {}
            for k in ours:
                begins[f[k]] = min(begins.get(f[k], rid[k]), rid[k])
                ends[u[k]] = min(ends.get(u[k], rid[k]), rid[k])
            lowest = min((rid[k] for k in ours), default=None)
            cause = min(ours, key=causal.__getitem__, default=-1)
            identity = {c: theirs[0] if theirs else max((k for k in ours if known[c][k]), key=rid.__getitem__, default=-1) for c in entity}
            all_of = covering([f[k] for k in ours], [u[k] for k in ours], [rid[k] for k in ours], points) if named else None
            for x in range(len(points) - 1):
                if last[x] < 0 and old[x] < 0:
                    continue
                p_at.append(where[points[x]])
                n_at.append(where[points[x + 1]])
                t_at.append(old[x])
                s_at.append(last[x])
                g_at.append(i)
                cause_at.append(cause)
                near = [y for y in (begins.get(points[x + 1]), ends.get(points[x])) if y is not None]
                next_to.append(min(near) if near else None)
                first_rid.append(lowest)
                is_new.append(not theirs)
                if named:
                    ids.append(all_of[x])
                for c in kept_old:
                    column_at[c].append(by_column[c][x])
                for c in entity:
                    entity_at[c].append(identity[c])
        edges = pa.chunked_array([*rows.column("_f").chunks, *rows.column("_u").chunks])
        out = {
            "_g": taken(rows.column("_g"), g_at), "_p": taken(edges, p_at), "_n": taken(edges, n_at), "_sourced": pa.array([x >= 0 for x in s_at], pa.bool_()),
            "_tf": taken(rows.column("_f"), t_at), "_tu": taken(rows.column("_u"), t_at), "_last": taken(rows.column("_rid"), s_at), "_lf": taken(rows.column("_f"), s_at),
            "_lu": taken(rows.column("_u"), s_at), "_by": taken(rows.column("_causal"), s_at), "_next_to": pa.array(next_to, pa.int64()), "_first_rid": pa.array(first_rid, pa.int64()),
            "_cause": taken(rows.column("_causal"), cause_at), "_is_new": pa.array(is_new, pa.bool_()),
        }
        out |= {f"_e_{c}": taken(rows.column(f"_e_{c}"), entity_at[c]) for c in entity}
        out |= {f"_s_{c}": taken(rows.column(f"_v_{c}"), column_at.get(c, s_at)) for c in given}
        out |= {f"_t_{c}": taken(rows.column(f"_v_{c}"), t_at) for c in payload}
        if named:
            out["_ids"] = pa.array(ids, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return whole_groups("_g", work)
