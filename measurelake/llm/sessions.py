"""Gap sessionisation of a click stream by composable state maps.

The session that a click joins depends on all of its client's earlier clicks,
so a client cannot simply be cut up.  What a stretch of time does to a session,
however, is a small function: the start of the session that comes in decides
the start of the session that goes out, piece by piece (`Stretch`).

1. `chunked` takes each click once and cuts clients into time chunks: a day,
   and the days of heavy clients into up to 4,096 parts.
2. `_summaries` turns each chunk into its map; clicks are read in order, a
   chunk of any size by batches whose maps are composed.
3. The maps are folded to days, days to blocks of 256 days and so on (up), and
   the state before each block, day and chunk is found from above (down): a
   prefix scan whose groups are bounded by the calendar, never by the rows.
4. `_replay` goes through every chunk again with the state that comes in and
   emits the parts of sessions, which `sessionise` adds up.

Rows are dealt by (client, chunk) in both passes; Spark reuses that exchange.
Nothing but the number of rows and the range of the times reaches the driver,
and only the list of heavy (client, day) cells, at most 4,096, is broadcast.

Defined cases: clicks without an id, a client or a time take no part; of rows
with one id the smallest in (time, client, late, final, cents) is taken; a null
arrival is not late; a null kind or value is not final; a null value, one that
is not finite or is 1e15 and more counts as nothing; equal times
are in order of id; a late click at a session's first time belongs to it (to
the last of several that start then), one before the client's first session to
none.  An empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampType

MINUTE = 60_000_000
DAY = 1440 * MINUTE
#: Days to a block, blocks to a larger block, and so on.
FAN = 256
#: A day of a client with more than this share of all rows is cut into parts; there can be no more such days.
HEAVY_CELLS = 4096
LIGHT_ROWS = 1000
#: Values from here on are not told in cents.
WHOLE = 1e15


@dataclass(frozen=True)
class Rules:
    """When a session ends; times in microseconds."""

    gap: int = 15 * MINUTE
    longest: int = 60 * MINUTE
    late: int = 15 * MINUTE
    final_kinds: tuple[str, ...] = ("purchase", "signup")
    final_value: float = 60.0


class Stretch(NamedTuple):
    """What a stretch of a client's time does to the session that comes in.

    With ``edges`` e_1 < ... < e_n, a session that began in [e_j, e_j+1) goes out
    as ``outcomes[j]`` (start, id); the first outcome also holds for a session
    that its first click ends.  An ``open`` stretch leaves a session that began
    at the last edge or later as it is.  A stretch of late clicks alone has no
    ``first`` and changes nothing.
    """

    first: int | None
    last: int | None
    final: bool
    edges: list[int]
    outcomes: list[tuple[int, int]]
    open: bool


class State(NamedTuple):
    """The session that a client is in: its start and id, its last click and whether that was final."""

    start: int
    session: int
    last: int
    final: bool


def after(state: State | None, s: Stretch, gap: int) -> State | None:
    """The state behind a stretch."""
    if s.first is None:
        return state
    out = s.outcomes[0]
    if state is not None and not state.final and s.first - state.last < gap:
        piece = bisect_right(s.edges, state.start)
        out = s.outcomes[piece] if piece < len(s.outcomes) else (state.start, state.session)
    return State(*out, s.last, s.final)


def compose(a: Stretch, b: Stretch, gap: int) -> Stretch:
    """Stretch ``a``, then ``b``, as one."""
    if a.first is None or b.first is None:
        return b if a.first is None else a
    if a.final or b.first - a.last >= gap:
        return Stretch(a.first, b.last, b.final, [], [b.outcomes[0]], False)
    edges = list(a.edges)
    outcomes = [after(State(*o, a.last, False), b, gap)[:2] for o in a.outcomes]
    if a.open:
        piece = bisect_right(b.edges, a.edges[-1])
        edges += b.edges[piece:]
        outcomes += b.outcomes[piece:]
    is_open = a.open and b.open
    kept = [j for j, edge in enumerate(edges) if j + 1 == len(outcomes) or outcomes[j] != outcomes[j + 1]]
    outcomes = [outcomes[j] for j in kept] + ([] if is_open else [outcomes[-1]])
    return Stretch(a.first, b.last, b.final, [edges[j] for j in kept], outcomes, is_open)


# --- rows


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; times without a zone are taken as UTC whatever the session's zone."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(col)
    whole = F.unix_date(col.cast("date")).cast("long") * DAY + F.hour(col).cast("long") * 60 * MINUTE + F.minute(col).cast("long") * MINUTE
    return whole + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("long")


def _floor(t: Column, width) -> Column:
    return t - F.pmod(t, width)


def chunked(clicks: DataFrame, rules: Rules) -> tuple[DataFrame, list[int]]:
    """Each click once with its chunk's first time ``at``, and the widths of the scan's levels."""
    t = micros(clicks, "ts")
    given = clicks.select(
        F.col("click_id").cast("long").alias("click"),
        F.col("client_id").cast("long").alias("client"),
        t.alias("t"),
        F.coalesce(micros(clicks, "arrived_at") - t > rules.late, F.lit(False)).alias("late"),
        F.coalesce(F.col("kind").isin(*rules.final_kinds) & (F.col("value") >= rules.final_value), F.lit(False)).alias("final"),
        F.when(F.abs("value") < WHOLE, F.floor(F.col("value").cast("double") * 100 + 0.5)).otherwise(0).cast("long").alias("cents"),
    ).filter("click IS NOT NULL AND client IS NOT NULL AND t IS NOT NULL")

    span = given.agg(F.count("*"), F.min("t"), F.max("t")).first()
    total, low, high = span[0], span[1] or 0, span[2] or 0
    widths = [DAY]
    while (high - low) // widths[-1] >= FAN:
        widths.append(widths[-1] * FAN)

    most = max(LIGHT_ROWS, total // HEAVY_CELLS)
    cells = given.groupBy("client", _floor(F.col("t"), F.lit(DAY)).alias("day")).agg(F.count("*").alias("n"))
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / most))).cast("long")
    heavy = cells.filter(F.col("n") > most).select(F.col("client").alias("h_client"), F.col("day").alias("h_day"), parts.alias("parts"))

    once = given.groupBy("click").agg(F.min(F.struct("t", "client", "late", "final", "cents")).alias("c")).select("click", "c.*")
    day = _floor(F.col("t"), F.lit(DAY))
    placed = once.join(F.broadcast(heavy), (F.col("client") == F.col("h_client")) & (day == F.col("h_day")), "left")
    width = (F.lit(DAY) / F.coalesce("parts", F.lit(1))).cast("long")
    rows = placed.select("client", _floor(F.col("t"), width).alias("at"), "t", "late", "click", "final", "cents")
    return rows.repartition("client", "at"), widths


# --- summaries


class _Timely:
    """The timely clicks of a batch, in order, by runs of (client, chunk)."""

    def __init__(self, batch: pa.RecordBatch, rules: Rules):
        self.client, self.at, t, late, click, final = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("client", "at", "t", "late", "click", "final"))
        n = batch.num_rows
        new = np.ones(n, bool)
        new[1:] = (self.client[1:] != self.client[:-1]) | (self.at[1:] != self.at[:-1])
        self.run = np.cumsum(new) - 1
        self.first_row = np.flatnonzero(new)
        self.rows = np.flatnonzero(~late)
        self.t, self.click, self.final, self.r = t[self.rows], click[self.rows], final[self.rows], self.run[self.rows]
        n = len(self.rows)
        begins = np.ones(n, bool)
        begins[1:] = self.r[1:] != self.r[:-1]
        self.begins = begins
        self.starts = np.flatnonzero(begins)
        self.ends = np.append(self.starts[1:], n).astype(np.int64)
        self.nth = np.cumsum(begins) - 1
        by_final = np.zeros(n, bool)
        by_final[1:] = self.final[:-1]
        by_gap = np.zeros(n, bool)
        by_gap[1:] = np.diff(self.t) >= rules.gap
        self.by_final, self.by_gap = by_final & ~begins, by_gap & ~begins
        self.hard = self.by_final | self.by_gap
        segments = np.append(np.flatnonzero(begins | self.hard), n)
        self.segment_end = segments[np.searchsorted(segments, np.arange(n), "right")] if n else np.zeros(0, np.int64)
        #: Times within a run, made to ascend over all runs.
        self.wide = int((self.t[self.ends - 1] - self.t[self.starts]).max(initial=0)) + rules.longest + 1
        self.base = self.nth * self.wide - self.t[self.starts][self.nth] if n else np.zeros(0, np.int64)
        self.key = self.t + self.base
        self.longest = rules.longest

    def too_late(self, at: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The first click over the longest time after ``start`` (default: after the click itself), in the run of click ``at`` or its end."""
        started = self.key[at] if start is None else start + self.base[at]
        return np.searchsorted(self.key, started + self.longest, "right")


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int64()))


_ELEMENT = "client long, at long, first long, last long, final boolean, edges array<long>, starts array<long>, sessions array<long>, open boolean"
_ELEMENT_ARROW = pa.schema(
    [("client", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("final", pa.bool_())]
    + [(n, pa.list_(pa.int64())) for n in ("edges", "starts", "sessions")]
    + [("open", pa.bool_())]
)


def _elements(client, at, stretches: list[Stretch]) -> pa.RecordBatch:
    columns = [client, at, [s.first for s in stretches], [s.last for s in stretches], [s.final for s in stretches], [s.edges for s in stretches]]
    columns += [[[o[k] for o in s.outcomes] for s in stretches] for k in (0, 1)] + [[s.open for s in stretches]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ELEMENT_ARROW)], schema=_ELEMENT_ARROW)


def _stretch(batch: pa.RecordBatch, i: int) -> Stretch:
    first, last, final, edges, starts, sessions, is_open = (batch.column(n)[i].as_py() for n in _ELEMENT_ARROW.names[2:])
    return Stretch(first, last, final, edges, list(zip(starts, sessions)), is_open)


def _maps(batch: pa.RecordBatch, rules: Rules) -> pa.RecordBatch:
    """The map of each run of a sorted batch."""
    c = _Timely(batch, rules)
    n, runs = len(c.rows), len(c.first_row)
    here = np.arange(n)
    after_ = np.minimum(c.segment_end, c.too_late(here)) if n else here
    end = c.ends[c.nth] if n else here
    goes_to = np.where(after_ < end, after_, here)
    while True:  # to the session that is open at the run's end, by doubling
        further = goes_to[goes_to]
        if np.array_equal(further, goes_to):
            break
        goes_to = further
    # The clicks that may end a session which came in: before the first hard end, within the longest time.
    head_end = after_[c.starts] if n else here
    in_head = here < head_end[c.nth] if n else np.zeros(0, bool)
    closed = head_end < c.ends
    behind = np.where(closed, goes_to[np.minimum(head_end, max(n - 1, 0))], -1) if n else head_end
    follows = np.full(n, -1)  # the outcome of the piece after a click's own
    follows[:-1] = goes_to[1:]
    follows[head_end - 1] = behind
    edge = in_head & (goes_to != follows)
    counts = np.bincount(c.nth[edge], minlength=len(c.starts))
    # Outcomes: those of the kept clicks, then the last one of closed runs.
    owner = np.concatenate([c.nth[edge], np.flatnonzero(closed)])
    order = np.argsort(owner, kind="stable")
    outcome = np.concatenate([goes_to[edge], behind[closed]])[order]

    spread = np.zeros(runs, np.int64), np.zeros(runs, np.int64)
    filled = c.r[c.starts]
    spread[0][filled], spread[1][filled] = counts, counts + closed
    has = np.zeros(runs, bool)
    has[filled] = True
    first, last = np.zeros(runs, np.int64), np.zeros(runs, np.int64)
    final, is_open = np.zeros(runs, bool), np.ones(runs, bool)
    first[filled], last[filled], final[filled], is_open[filled] = c.t[c.starts], c.t[c.ends - 1], c.final[c.ends - 1], ~closed
    columns = [
        pa.array(c.client[c.first_row]),
        pa.array(c.at[c.first_row]),
        pa.array(first, mask=~has),
        pa.array(last, mask=~has),
        pa.array(final),
        _lists(c.t[edge] - rules.longest, spread[0]),
        _lists(c.t[outcome], spread[1]),
        _lists(c.click[outcome], spread[1]),
        pa.array(is_open),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ELEMENT_ARROW)


def _joined(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], gap: int) -> Iterator[pa.RecordBatch]:
    """Elements in order, those of one key composed; an element of its own passes as it is."""
    pending: tuple[tuple, int, Stretch] | None = None

    def told(p) -> pa.RecordBatch:
        return _elements([p[0][0]], [p[1]], [p[2]])

    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], batch.num_rows)
        out = pa.RecordBatch.from_arrays([batch.column(n) for n in _ELEMENT_ARROW.names], schema=_ELEMENT_ARROW)
        at = out.column("at").to_numpy()
        own = 0  # rows from here on may pass together
        for j in np.flatnonzero((ends - begins > 1) | (begins == 0) | (ends == batch.num_rows)):
            a, b = int(begins[j]), int(ends[j])
            if own < a:
                yield out.slice(own, a - own)
            own = b
            key = tuple(int(c[a]) for c in columns)
            if pending is not None and pending[0] != key:
                yield told(pending)
                pending = None
            for i in range(a, b):
                s = _stretch(out, i)
                pending = (key, int(at[i]), s) if pending is None else (key, pending[1], compose(pending[2], s, gap))
            if b < batch.num_rows:
                yield told(pending)
                pending = None
    if pending is not None:
        yield told(pending)


# --- states


_STATE = "client long, at long, start long, session long, last long, final boolean"
_STATE_ARROW = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("session", pa.int64()), ("last", pa.int64()), ("final", pa.bool_())])
_GIVEN = ("in_start", "in_session", "in_last", "in_final")


def _carried(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], gap: int) -> Iterator[pa.RecordBatch]:
    """The state before each element; the first of a key takes the state that is given with it."""
    key, state = None, None
    for batch in batches:
        n = batch.num_rows
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        new[0] = key != tuple(int(c[0]) for c in columns)
        has = batch.column("first").is_valid().to_numpy(zero_copy_only=False)
        first, last, starts = (pc.fill_null(batch.column(c), 0).to_numpy() if c != "starts" else batch.column(c) for c in ("first", "last", "starts"))
        final, is_open = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("final", "open"))
        edges = np.diff(batch.column("edges").offsets.to_numpy())
        offsets = starts.offsets.to_numpy()
        flat = [batch.column(c).values.to_numpy() for c in ("starts", "sessions")]
        # Most elements go out the same whatever comes in: no edges, or a gap or final click right before.
        before = np.maximum.accumulate(np.where(has, np.arange(n), -1))
        before = np.concatenate([[-1], before[:-1]])
        begun = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        within = (before >= 0) & (before >= begun)
        apart = within & (final[before] | (first - last[before] >= gap))
        told = has & (apart | ((edges == 0) & ~is_open))
        out = np.zeros((2, n), np.int64)
        at0 = offsets[:-1][told]
        for row, values in zip(out, flat):
            row[told] = values[at0]
        # What comes in with a key: given with its first element, or carried over from the batch before.
        given = [batch.column(c) for c in _GIVEN]
        known = given[0].is_valid().to_numpy(zero_copy_only=False)[np.maximum(begun, 0)]
        comes = [pc.fill_null(c, False if pa.types.is_boolean(c.type) else 0).to_numpy(zero_copy_only=False)[np.maximum(begun, 0)] for c in given]
        carried_on = begun < 0
        known = np.where(carried_on, state is not None, known)
        if state is not None:
            comes = [np.where(carried_on, value, c) for c, value in zip(comes, state)]
        # An outcome matters if an element of the key follows, here or in the next batch.
        matters = np.append(~new[1:], True)
        for i in np.flatnonzero(has & ~told & matters):
            j = int(before[i])
            source = [out[0, j], out[1, j], last[j], final[j]] if within[i] else [c[i] for c in comes] if known[i] else None
            taken = None if source is None else State(*map(int, source[:3]), bool(source[3]))
            out[0, i], out[1, i] = after(taken, _stretch(batch, int(i)), gap)[:2]
        values = [np.where(within, own[np.where(within, before, 0)], c) for own, c in zip((out[0], out[1], last, final), comes)]
        valid = within | known
        arrays = [batch.column("client"), batch.column("at"), *[pa.array(v, mask=~valid) for v in values]]
        yield pa.RecordBatch.from_arrays(arrays, schema=_STATE_ARROW)
        key = tuple(int(c[-1]) for c in columns)
        if has[-1] or within[-1]:
            j = n - 1 if has[-1] else int(before[-1])
            state = State(int(out[0, j]), int(out[1, j]), int(last[j]), bool(final[j]))
        else:
            state = State(*(int(c[-1]) for c in comes[:3]), bool(comes[3][-1])) if known[-1] else None


# --- replay


_PART = (
    "client long, session long, start long, part_t long, part_click long, last long, final boolean, "
    "n_clicks long, n_late long, cents long, reason string, path string"
)
_PART_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("client", "session", "start", "part_t", "part_click", "last")]
    + [("final", pa.bool_())]
    + [(n, pa.int64()) for n in ("n_clicks", "n_late", "cents")]
    + [("reason", pa.string()), ("path", pa.string())]
)
_REASONS = np.array(["end", "gap", "length"], object)


def _replay(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    """Parts of sessions: their clicks in a chunk (or a batch of it), late clicks, and why they ended."""
    key, state = None, None
    for batch in batches:
        c = _Timely(batch, rules)
        n, runs = len(c.rows), len(c.first_row)
        # The state before each run.
        given = [batch.column(x).take(pa.array(c.first_row)) for x in _GIVEN]
        known = given[0].is_valid().to_numpy(zero_copy_only=False)
        start, session, last = (pc.fill_null(x, 0).to_numpy().copy() for x in given[:3])
        final = pc.fill_null(given[3], False).to_numpy(zero_copy_only=False).copy()
        if key == (int(c.client[0]), int(c.at[0])):
            known = known.copy()
            known[0] = state is not None
            if state is not None:
                start[0], session[0], last[0], final[0] = state

        # Which clicks start a session, and why the one before ended (0 end, 1 gap, 2 length).
        why = np.where(c.by_final, 0, np.where(c.by_gap, 1, -1))
        opens = c.hard.copy()
        own = c.r[c.starts]
        t0 = c.t[c.starts]
        ended = np.select([final[own], t0 - last[own] >= rules.gap, t0 - start[own] > rules.longest], [0, 1, 2], -1)
        ended = np.where(known[own], ended, 3)
        opens[c.starts], why[c.starts] = ended >= 0, ended
        goes_on = ended < 0
        segment = np.flatnonzero(c.begins | c.hard)
        fresh = segment[opens[segment]]
        reached = [c.too_late(fresh), c.too_late(c.starts[goes_on], start[own][goes_on])]
        bound = [c.segment_end[fresh], c.segment_end[c.starts[goes_on]]]
        at, end = np.concatenate(reached), np.concatenate(bound)
        while len(at):
            at, end = at[at < end], end[at < end]
            opens[at], why[at] = True, 2
            at = c.too_late(at)

        # Parts: from each such click, and from the first click of a run whose session goes on.
        begins = np.flatnonzero(opens | c.begins)
        part = np.cumsum(opens | c.begins) - 1
        stop = np.append(begins[1:], n).astype(np.int64)
        run = c.r[begins]
        is_own = opens[begins]
        part_start = np.where(is_own, c.t[begins], start[run])
        part_session = np.where(is_own, c.click[begins], session[run])
        follows = np.full(len(begins), -1)
        if len(begins) > 1:
            follows[:-1] = np.where(run[1:] == run[:-1], why[begins[1:]], -1)
        cents = batch.column("cents").to_numpy()[c.rows]
        sums = np.add.reduceat(cents, begins) if n else np.zeros(0, np.int64)
        ids = pc.cast(pa.array(c.click), pa.string())
        paths = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins, n), pa.int32()), ids), ",") if n else pa.array([], pa.string())

        # Late clicks: to the part before them in their run, or to the session that came in.
        late = np.setdiff1d(np.arange(batch.num_rows), c.rows, assume_unique=True)
        near = np.searchsorted(c.rows, late) - 1
        in_run = (near >= 0) & (c.r[np.maximum(near, 0)] == c.run[late]) if n else np.zeros(len(late), bool)
        n_late = np.bincount(part[near[in_run]], minlength=len(begins)) if n else np.zeros(0, np.int64)
        came = np.bincount(c.run[late[~in_run]], minlength=runs)
        closed = np.full(runs, -1)
        closed[own] = np.where(known[own], ended, -1)
        extra = np.flatnonzero(known & ((came > 0) | (closed >= 0)))

        def reasons(codes):
            found = (codes >= 0) & (codes < 3)
            return pa.array(np.where(found, _REASONS[np.where(found, codes, 0)], None), pa.string())

        def columns(client, session, start, t, click, last, final, n_clicks, n_late, cents, reason, path, empty):
            whole = [client, session, start, t, click, last, final, n_clicks, n_late, cents]
            nulls = [False] * 3 + [empty] * 4 + [False] * 3
            arrays = [pa.nulls(len(client), f.type) if e else pa.array(v, f.type) for v, e, f in zip(whole, nulls, _PART_ARROW)]
            return pa.RecordBatch.from_arrays([*arrays, reasons(reason), path], schema=_PART_ARROW)

        if n:
            yield columns(c.client[c.rows[begins]], part_session, part_start, c.t[begins], c.click[begins], c.t[stop - 1], c.final[stop - 1], stop - begins, n_late, sums, follows, paths, False)
        if len(extra):
            zero = np.zeros(len(extra), np.int64)
            yield columns(c.client[c.first_row[extra]], session[extra], start[extra], zero, zero, zero, zero, zero, came[extra], zero, closed[extra], pa.nulls(len(extra), pa.string()), True)

        key = (int(c.client[-1]), int(c.at[-1]))
        if n and c.r[-1] == runs - 1:
            state = State(int(part_start[-1]), int(part_session[-1]), int(c.t[-1]), bool(c.final[-1]))
        else:
            state = State(int(start[-1]), int(session[-1]), int(last[-1]), bool(final[-1])) if known[-1] else None


# --- the operator


def sessionise(clicks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per session: client, session (its first click), start, last, n_clicks, n_late, cents, closed_by and path.

    Needs columns click_id, ts, arrived_at, client_id, kind and value.
    """
    rows, widths = chunked(clicks, rules)
    by_row = ["client", "at", "t", "late", "click"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _joined((_maps(b, rules) for b in batches if b.num_rows), ("client", "at"), rules.gap)

    elements = rows.sortWithinPartitions(*by_row).mapInArrow(summarise, _ELEMENT)
    levels = []
    for width in widths:
        dealt = elements.withColumn("block", _floor(F.col("at"), F.lit(width))).repartition("client", "block")

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _joined((b for b in batches if b.num_rows), ("client", "block"), rules.gap)

        levels.append(dealt)
        elements = dealt.sortWithinPartitions("client", "block", "at").mapInArrow(fold, _ELEMENT)
        elements = elements.withColumn("at", _floor(F.col("at"), F.lit(width)))

    def carry(keys: tuple[str, ...]):
        return lambda batches: _carried((b for b in batches if b.num_rows), keys, rules.gap)

    unknown = [F.lit(None).cast("boolean" if n == "in_final" else "long").alias(n) for n in _GIVEN]
    top = elements.repartition("client").sortWithinPartitions("client", "at").select("*", *unknown)
    states = top.mapInArrow(carry(("client",)), _STATE)
    for dealt in reversed(levels):
        given = _named(states, "block")
        within = dealt.join(given.hint("shuffle_hash"), ["client", "block"], "left").sortWithinPartitions("client", "block", "at")
        states = within.mapInArrow(carry(("client", "block")), _STATE)
    given = _named(states, "at")
    again = rows.join(given.hint("shuffle_hash"), ["client", "at"], "left").sortWithinPartitions(*by_row)
    parts = again.mapInArrow(lambda batches: _replay((b for b in batches if b.num_rows), rules), _PART)

    piece = F.when(F.col("path").isNotNull(), F.struct("part_t", "part_click", "path", "final"))
    found = parts.groupBy("client", "session").agg(
        F.min("start").alias("start"),
        F.max("last").alias("last"),
        F.sum("n_clicks").alias("n_clicks"),
        F.sum("n_late").alias("n_late"),
        F.sum("cents").alias("cents"),
        F.max("reason").alias("reason"),
        F.sort_array(F.collect_list(piece)).alias("pieces"),
    )
    at_end = F.when(F.element_at("pieces", -1)["final"], "end").otherwise("none")
    path = F.array_join(F.transform("pieces", lambda p: p["path"]), ",")
    return found.select("client", "session", "start", "last", "n_clicks", "n_late", "cents", F.coalesce("reason", at_end).alias("closed_by"), path.alias("path"))


def _named(states: DataFrame, key: str) -> DataFrame:
    return states.select(
        "client", F.col("at").alias(key), F.col("start").alias("in_start"), F.col("session").alias("in_session"), F.col("last").alias("in_last"), F.col("final").alias("in_final")
    )


#: Starts are found segment by segment: clicks without a gap or final click between them, cut by length from start to start.
ORACLE_SQL = """WITH RECURSIVE g AS (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS t, epoch_us(arrived_at) - epoch_us(ts) > 900000000 AS late,
  coalesce(kind IN ('purchase', 'signup') AND value >= 60, false) AS final, CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT) AS cents
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND click_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS i, lag(t) OVER w AS pt, lag(final) OVER w AS pf FROM g WHERE NOT coalesce(late, false) WINDOW w AS (PARTITION BY client_id ORDER BY t, click_id)),
h AS (SELECT *, CASE WHEN pt IS NULL THEN 'first' WHEN pf THEN 'end' WHEN t - pt >= 900000000 THEN 'gap' END AS hard FROM o),
s AS (SELECT *, count(hard) OVER (PARTITION BY client_id ORDER BY i) AS seg FROM h),
n AS (SELECT a.client_id, a.seg, a.i, min(b.i) AS j FROM s a JOIN s b ON a.client_id = b.client_id AND a.seg = b.seg AND b.t > a.t + 3600000000 GROUP BY 1, 2, 3),
r AS (SELECT client_id, seg, i, hard AS why FROM s WHERE hard IS NOT NULL UNION ALL SELECT r.client_id, r.seg, n.j, 'length' FROM r JOIN n USING (client_id, seg, i)),
p AS (SELECT s.*, r.why, max(CASE WHEN r.i IS NOT NULL THEN s.i END) OVER (PARTITION BY s.client_id ORDER BY s.i) AS sess FROM s LEFT JOIN r USING (client_id, seg, i)),
a AS (SELECT client_id, sess, arg_min(click_id, i) AS session_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
  arg_max(final, i) AS fin, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY i)) AS path_sha256, arg_min(why, i) AS why FROM p GROUP BY 1, 2),
x AS (SELECT *, lead(start_us) OVER w AS next_us, lead(why) OVER w AS next_why FROM a WINDOW w AS (PARTITION BY client_id ORDER BY sess)),
l AS (SELECT x.client_id, x.sess, count(*) AS n_late FROM x JOIN g ON g.client_id = x.client_id AND g.late AND g.t >= x.start_us AND (x.next_us IS NULL OR g.t < x.next_us) GROUP BY 1, 2)
SELECT x.client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents, coalesce(next_why, CASE WHEN fin THEN 'end' ELSE 'none' END) AS closed_by, path_sha256
FROM x LEFT JOIN l ON x.client_id = l.client_id AND x.sess = l.sess"""
