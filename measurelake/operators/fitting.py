"""Many penalised logistic models in shared passes over one table.

Cross-validation, tuning and resampling fit thousands of models to the same
rows, each to its own part of them.  Here no part is ever gathered: every pass
scans the table once, each task adds up what Newton's step of every model needs
(loss, gradient and the d x d curvature, weighted by the model's training
rows), the sums are shuffled by model, and the steps are solved where the sums
meet.  The driver holds coefficients only.  A pass costs rows x models x d^2,
its shuffle models x d^2 a task, whatever the number of rows.

A model minimises, over its training rows and its own standardised features,

    sum of log losses + (1 / c) * ((1 - mix) / 2 * |b|^2 + mix * |b|_1),

the intercept being penalised like a coefficient if asked for (`Models.whole`).
Steps that do not lower the objective are halved.  With mix > 0 the quadratic
model is minimised by coordinate descent (a proximal Newton step).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import inference

#: Rows that a task multiplies at once, and floats of a chunk of sums.
BLOCK_ROWS = 256
CHUNK_FLOATS = 1 << 17
#: Rows read at once by a Newton pass, and floats of one array in its inner loop (small enough for a core's cache).
PASS_ROWS, PASS_FLOATS = 2048, 1 << 16
#: Relative size of a Newton step after which a model is done: what is left is of the size of its square.
TOLERANCE = 1e-6
MOST_PASSES = 60


def _spread(df: DataFrame) -> DataFrame:
    """A small table in as many partitions as there are cores; a pass computes far more than it reads."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


Kernel = Callable[[dict[str, np.ndarray]], np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Columns as arrays, array columns as matrices, in blocks of rows."""
    rows = rows or BLOCK_ROWS
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            out = {}
            for name, column in zip(part.schema.names, part.columns):
                if pa.types.is_list(column.type):
                    out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                else:
                    out[name] = column.to_numpy(zero_copy_only=False)
            yield out


def sums(rows: DataFrame, kernel: Kernel, size: int, largest: bool = False) -> np.ndarray:
    """The sum (or maximum) over all blocks of rows of what ``kernel`` makes of a block, ``size`` floats."""
    join = np.maximum if largest else np.add

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches):
            own = kernel(block)
            total = own if total is None else join(total, own)
        if total is not None:
            parts = [total[a : a + CHUNK_FLOATS].astype(float).tobytes() for a in range(0, size, CHUNK_FLOATS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part"])

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for part in table.column("part"):
            own = np.frombuffer(part.as_buffer())
            total = own if total is None else join(total, own)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, part binary"
    found = rows.mapInArrow(add, schema).groupBy("chunk").applyInArrow(merge, schema).collect()
    if not found:
        return np.zeros(size) if not largest else np.full(size, -np.inf)
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(found, key=lambda r: r["chunk"])])


@dataclass
class Models:
    """Models of one design (columns of x): each learns from a training set, by number, under a penalty."""

    columns: np.ndarray
    training: np.ndarray
    c: np.ndarray
    mix: np.ndarray
    whole: bool = False  # the intercept is penalised too
    coefficients: np.ndarray = field(default=None)  # raw: columns, then the intercept, by model
    passes: np.ndarray = field(default=None)

    def __len__(self) -> int:
        return len(self.c)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows by models."""
        return x[:, self.columns] @ self.coefficients[:-1] + self.coefficients[-1]


def moments(rows: DataFrame, weights: Kernel, sets: int, d: int) -> np.ndarray:
    """Of each training set: weight, sums and sums of squares of the columns, about the first row's values."""

    def kernel(block):
        x, w = block["x"], weights(block)
        return np.concatenate([w.sum(0)[None], x.T @ w, (x * x).T @ w]).ravel()

    return sums(rows, kernel, (1 + 2 * d) * sets).reshape(1 + 2 * d, sets)


def _halves(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _descend(h: np.ndarray, g: np.ndarray, b: np.ndarray, l1: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Minimum of g'(u - b) + (u - b)'h(u - b)/2 + sum of l1 |u| by coordinate descent, over a stack of models."""
    u, slope = b.copy(), g.copy()  # slope of the quadratic part at u
    for _ in range(sweeps):
        moved = 0.0
        for j in range(b.shape[1]):
            curve = h[:, j, j]
            free = u[:, j] - slope[:, j] / curve
            new = np.sign(free) * np.maximum(np.abs(free) - l1[:, j] / curve, 0)
            step = new - u[:, j]
            slope += step[:, None] * h[:, :, j]
            u[:, j] = new
            moved = max(moved, float(np.abs(step).max(initial=0)))
        if moved < 1e-10:
            break
    return u


def fit(rows: DataFrame, weights: Kernel, sets: int, designs: list[Models], d: int, scales: np.ndarray | None = None, near: bool = False) -> None:
    """Fit all models of all designs; ``weights`` gives the rows' weights in each training set (rows by sets).

    ``rows`` has y (0 or 1) and x (array of ``d`` doubles) and whatever
    ``weights`` needs.  Features are standardised by the population moments of
    each training set; a constant feature keeps its unit.  Models start from zero, or (``near``) from
    the model of the same design and penalty that all rows give.
    """
    about = moments(rows, lambda block: np.ones((len(block["y"]), 1)), 1, d)[:, 0]
    n = max(about[0], 1)
    centre, spread = about[1 : d + 1] / n, np.sqrt(np.maximum(about[d + 1 :] / n - (about[1 : d + 1] / n) ** 2, 0))
    spread = np.where(spread > 0, spread, 1.0)

    def shifted(block):
        return block | {"x": (block["x"] - centre) / spread}

    own = moments(rows, lambda b: weights(b), sets, d) if scales is None else scales
    # Moments of the shifted columns, from those of the raw ones.
    total = np.maximum(own[0], 1e-300)
    mean = own[1 : d + 1] / total
    sd = np.sqrt(np.maximum(own[d + 1 :] / total - mean**2, 0))
    sd = np.where(sd > 1e-9 * np.maximum(np.abs(mean), spread[:, None]), sd, spread[:, None])
    mean, sd = (mean - centre[:, None]) / spread[:, None], sd / spread[:, None]

    # State by design: coefficients on the model's own scale now and before, the objective before, and what is not done.
    now = [np.zeros((len(m.columns) + 1, len(m))) for m in designs]
    if near:
        starts, of = [], []
        for m in designs:
            kinds, at = np.unique(np.stack([m.c, m.mix]), axis=1, return_inverse=True)
            starts.append(Models(m.columns, np.zeros(kinds.shape[1], int), kinds[0], kinds[1], m.whole))
            of.append(at.ravel())
        fit(rows, lambda block: np.ones((len(block["y"]), 1)), 1, starts, d)
        for k, m in enumerate(designs):
            b = starts[k].coefficients[:, of[k]]
            # From raw columns to the model's own scale.
            c, s = centre[m.columns][:, None], spread[m.columns][:, None]
            mu, own_sd = mean[m.columns][:, m.training] * s + c, sd[m.columns][:, m.training] * s
            now[k] = np.concatenate([b[:-1] * own_sd, b[-1:] + (b[:-1] * mu).sum(0)[None]])
    before = [x.copy() for x in now]
    value = [np.full(len(m), np.inf) for m in designs]
    active = [np.arange(len(m)) for m in designs]
    for m in designs:
        m.passes = np.zeros(len(m), int)

    def to_shifted(k: int, which: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = designs[k]
        mu, s = mean[m.columns][:, m.training[which]], sd[m.columns][:, m.training[which]]
        raw = b[:-1] / s
        return np.concatenate([raw, b[-1:] - (raw * mu).sum(0)[None]])

    for _ in range(MOST_PASSES):
        jobs = []  # (design, models of a chunk): sums of bounded size, solved together
        for k, m in enumerate(designs):
            size = len(m.columns) + 1
            each = max(1, CHUNK_FLOATS // (1 + size + size * (size + 1) // 2))
            jobs += [(k, active[k][a : a + each]) for a in range(0, len(active[k]), each)]
        if not jobs:
            break
        raw = [to_shifted(k, which, now[k][:, which]) for k, which in jobs]

        def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray | None] = [None] * len(jobs)
            for block in _blocks(batches, PASS_ROWS):
                block = shifted(block)
                w = weights(block)
                y = block["y"].astype(float)[:, None]
                last = None
                for job, (k, which) in enumerate(jobs):
                    m = designs[k]
                    if last is None or not np.array_equal(last, m.columns):  # designs of the same columns follow each other
                        last = m.columns
                        x = np.concatenate([block["x"][:, last], np.ones((len(y), 1))], axis=1)
                        i, j = _halves(x.shape[1])
                        pairs = x[:, i] * x[:, j]
                    if total[job] is None:
                        total[job] = np.zeros((1 + x.shape[1] + len(i), len(which)))
                    tall = max(BLOCK_ROWS, PASS_FLOATS // len(which))
                    wide = max(1, PASS_FLOATS // min(tall, len(y)))
                    for a in range(0, len(y), tall):
                        for c in range(0, len(which), wide):
                            r, models = slice(a, a + tall), slice(c, c + wide)
                            score = x[r] @ raw[job][:, models]
                            e = np.abs(score)
                            np.exp(np.negative(e, out=e), out=e)
                            p = np.where(score >= 0, 1.0, e)
                            p /= 1 + e
                            used = w[r][:, m.training[which[models]]]
                            loss = np.maximum(score, 0)
                            loss += np.log1p(e, out=e)
                            loss -= y[r] * score
                            off = used * (p - y[r])
                            found = total[job][:, models]
                            found[0] += np.einsum("ij,ij->j", used, loss)
                            found[1 : 1 + x.shape[1]] += x[r].T @ off
                            used *= p
                            used *= 1 - p
                            found[1 + x.shape[1] :] += pairs[r].T @ used
            if total[0] is not None:
                parts = [t.tobytes() for t in total]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(jobs)), pa.int32()), pa.array(parts, pa.binary())], ["job", "part"])

        def solve(table: pa.Table) -> pa.Table:
            job = table.column("job")[0].as_py()
            k, which = jobs[job]
            m, size = designs[k], len(designs[k].columns) + 1
            found = sum(np.frombuffer(p.as_buffer()) for p in table.column("part")).reshape(-1, len(which))
            mu, s = mean[m.columns][:, m.training[which]].T, sd[m.columns][:, m.training[which]].T
            # To the model's own scale: z = A (x, 1).
            a = np.zeros((len(which), size, size))
            at = np.arange(size - 1)
            a[:, at, at], a[:, at, -1], a[:, -1, -1] = 1 / s, -mu / s, 1
            h = np.zeros((len(which), size, size))
            i, j = _halves(size)
            h[:, i, j] = h[:, j, i] = found[1 + size :].T
            g = np.einsum("mij,jm->mi", a, found[1 : 1 + size])
            h = a @ h @ a.transpose(0, 2, 1)
            b, old = now[k][:, which].T, before[k][:, which].T
            penalised = np.ones(size)
            penalised[-1] = m.whole
            l2 = ((1 - m.mix[which]) / m.c[which])[:, None] * penalised
            l1 = (m.mix[which] / m.c[which])[:, None] * np.append(np.ones(size - 1), 0.0)
            objective = found[0] + (l2 * b * b).sum(1) / 2 + (l1 * np.abs(b)).sum(1)
            worse = objective > value[k][which] + 1e-12 * np.abs(value[k][which])
            h[:, np.arange(size), np.arange(size)] += l2 + 1e-10 * np.maximum(h[:, np.arange(size), np.arange(size)], 1e-12)
            g = g + l2 * b
            new = b - np.linalg.solve(h, g[:, :, None])[:, :, 0]
            if (l1 > 0).any():
                new = _descend(h, g, b, l1)
            step = np.where(worse[:, None], (old - b) / 2, new - b)
            out = np.concatenate([[np.where(worse, value[k][which], objective)], np.where(worse[:, None], old, b).T, (b + step).T])
            return pa.table({"job": pa.array([job], pa.int32()), "part": pa.array([out.tobytes()], pa.binary())})

        schema = "job int, part binary"
        solved = rows.mapInArrow(accumulate, schema).groupBy("job").applyInArrow(solve, schema).collect()
        if not solved:
            break
        for job, part in solved:
            k, which = jobs[job]
            size = len(designs[k].columns) + 1
            out = np.frombuffer(part).reshape(-1, len(which))
            value[k][which] = out[0]
            before[k][:, which], now[k][:, which] = out[1 : 1 + size], out[1 + size :]
            designs[k].passes[which] += 1
        for k in range(len(designs)):
            moved = np.abs(now[k] - before[k]).max(axis=0) > TOLERANCE * (1 + np.abs(now[k]).max(axis=0))
            active[k] = np.flatnonzero(moved)
    for k, m in enumerate(designs):
        b = to_shifted(k, np.arange(len(m)), now[k])
        raw_ = b[:-1] / spread[m.columns][:, None]
        m.coefficients = np.concatenate([raw_, b[-1:] - (raw_ * centre[m.columns][:, None]).sum(0)[None]])


# --- order statistics


def _sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = np.ascontiguousarray(values + 0.0, np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def order_statistics(rows: DataFrame, values: Callable[[dict], tuple[np.ndarray, np.ndarray]], place: Callable[[np.ndarray], np.ndarray], groups: int) -> np.ndarray:
    """For each group the value at ``place(counts)`` (from 0) in ascending order; nan for a group without values.

    ``values`` gives a block's values and whether each counts, rows by groups.
    Values are chosen eight bits at a time from counts, so no task ever sorts or
    holds a group.
    """
    prefix = np.zeros(groups, np.uint64)
    left = count = None
    for shift in range(56, -8, -8):

        def kernel(block, shift=shift, prefix=prefix):
            v, used = values(block)
            key = _sortable(v)
            if shift < 56:
                used = used & (key >> np.uint64(shift + 8) == prefix)
            digit = (key >> np.uint64(shift)) & np.uint64(255)
            at = np.broadcast_to(np.arange(groups) * 256, v.shape) + digit.astype(np.int64)
            return np.bincount(at[used], minlength=groups * 256).astype(float)

        found = sums(rows, kernel, groups * 256).reshape(groups, 256)
        if count is None:
            count = found.sum(1).astype(np.int64)
            left = place(count).astype(np.int64)
        run = found.cumsum(1)
        digit = np.minimum((run <= left[:, None]).sum(1), 255)
        left = left - np.where(digit > 0, np.take_along_axis(run, np.maximum(digit - 1, 0)[:, None], 1)[:, 0], 0).astype(np.int64)
        prefix = (prefix << np.uint64(8)) | digit.astype(np.uint64)
    back = np.where(prefix >> np.uint64(63), prefix & np.uint64((1 << 63) - 1), ~prefix).view(np.float64)
    return np.where(count > 0, back, np.nan)


#: Rows of a model's scores that are ordered together.
AUC_ROWS = 1 << 16


def auc_of(rows: DataFrame, values: Callable[[dict], tuple[np.ndarray, np.ndarray]], models: int, auc_rows: int | None = None) -> DataFrame:
    """model (from 0) and auc of many models' scores; null with one class only.

    ``values`` gives a block's scores and weights (rows by models), a weight of class 0 being negative.
    Scores travel packed, not as rows: a piece for each block, model and range of scores.  A
    range is ordered in one task, so the ranges are as many as the rows ask for; where they are cut
    (by counts of equal steps between the least and the greatest score) does not change the result.
    """
    ranges = -(-rows.count() // (auc_rows or AUC_ROWS))
    edges = np.zeros((0, models))
    if ranges > 1:
        ends = sums(rows, lambda b: np.concatenate([-values(b)[0].min(0), values(b)[0].max(0)]), 2 * models, largest=True)
        low, step, steps = -ends[:models], (ends[models:] + ends[:models]) / (16 * ranges), 16 * ranges
        step = np.where(step > 0, step, 1.0)

        def kernel(block):
            at = np.clip(((values(block)[0] - low) / step).astype(np.int64), 0, steps - 1) + np.arange(models) * steps
            return np.bincount(at.ravel(), minlength=models * steps).astype(float)

        run = sums(rows, kernel, models * steps).reshape(models, steps).cumsum(1)
        share = run[:, -1:] * np.arange(1, ranges) / ranges
        cut = (run[:, None, :] < share[:, :, None]).sum(2).T  # ranges - 1 by models
        edges = low + (cut + 1) * step

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, PASS_ROWS):
            score, weight = values(block)
            score, weight = score.T + 0.0, np.broadcast_to(weight, score.shape).T.astype(np.int32)
            found = []
            for m in range(models):
                part = np.searchsorted(edges[:, m], score[m]) if ranges > 1 else np.zeros(score.shape[1], int)
                for r in np.unique(part):
                    own = (part == r) & (weight[m] != 0)
                    found.append((m, int(r), score[m][own].tobytes(), weight[m][own].tobytes()))
            names, kinds = ["model", "range", "s", "w"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def order(table: pa.Table) -> pa.Table:
        s, w = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("s", np.float64), ("w", np.int32)))
        at = np.argsort(s)
        s, w = s[at], w[at]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
        p, n = (np.add.reduceat(x, starts) if len(s) else np.zeros(0) for x in (np.maximum(w, 0).astype(float), np.maximum(-w, 0).astype(float)))
        row = {"p": p.sum(), "n": n.sum(), "u": p @ (n.cumsum() - n / 2)}
        return pa.table({c: table.column(c).slice(0, 1) for c in ("model", "range")} | {c: pa.array([float(v)]) for c, v in row.items()})

    found = rows.mapInArrow(pack, "model int, range int, s binary, w binary").groupBy("model", "range").applyInArrow(order, "model int, range int, p double, n double, u double")
    before = Window.partitionBy("model").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = found.withColumn("b", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    return each.groupBy("model").agg(F.try_divide(F.sum(F.col("u") + F.col("p") * F.col("b")), F.sum("p") * F.sum("n")).alias("auc"))


# --- nested cross-validation


@dataclass(frozen=True)
class Folds:
    """Repeated outer folds and, for each held fold, inner ones; a unit's folds are hashes of its id."""

    outer: int = 5
    repeats: int = 20
    inner: int = 4
    seed: int = 29

    def marked(self, rows: DataFrame, unit: str) -> DataFrame:
        """``rows`` with outer (by repeat) and inside (by repeat and held fold); units of one id stay together."""
        r = F.sequence(F.lit(0), F.lit(self.repeats - 1))
        deal = lambda salt, k: lambda i: F.pmod(F.xxhash64(F.lit(self.seed + salt), i, F.col(unit)), F.lit(k)).cast("int")
        held = F.sequence(F.lit(0), F.lit(self.repeats * self.outer - 1))
        return rows.withColumn("outer", F.transform(r, deal(0, self.outer))).withColumn("inside", F.transform(held, deal(7919, self.inner)))

    @property
    def sets(self) -> int:
        """Training sets: of each repeat and held fold, without each inner fold and then with all."""
        return self.repeats * self.outer * (self.inner + 1)

    def parts(self, block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Whether a row is held (rows by repeat and held fold), and its inner fold there."""
        held = block["outer"][:, :, None] == np.arange(self.outer)
        return held.reshape(len(held), -1), block["inside"]

    def weights(self, block: dict[str, np.ndarray]) -> np.ndarray:
        held, inside = self.parts(block)
        out = np.ones((*held.shape, self.inner + 1))
        out[:, :, : self.inner] = inside[:, :, None] != np.arange(self.inner)
        return (out * ~held[:, :, None]).reshape(len(held), -1)


@dataclass(frozen=True)
class Family:
    """Candidates of a model: penalties, and all columns together or each alone."""

    name: str
    penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    mix: float = 0.0
    single: bool = False
    whole: bool = True


FAMILIES = (Family("ridge"), Family("elastic_net", mix=0.5, whole=False), Family("best_single", single=True))


@dataclass
class Nested:
    """What nested cross-validation has chosen: by repeat and held fold, a design's column of coefficients."""

    folds: Folds
    chosen: dict[str, np.ndarray]  # family: coefficients (d + 1 by repeat and held fold)
    inner: dict[str, np.ndarray]  # family: coefficients of the inner models at the chosen candidate (d + 1 by set without the full ones)
    penalty: dict[str, np.ndarray]
    feature: dict[str, np.ndarray]  # -1 for all columns
    thresholds: dict[str, np.ndarray]

    def oof(self, rows: DataFrame, unit: str) -> DataFrame:
        """Out-of-fold rows: family, repeat, fold, unit, y, score, probability, threshold and the 95 % call."""
        folds, chosen, thresholds = self.folds, self.chosen, self.thresholds
        kind = rows.schema[unit].dataType.simpleString()
        schema = f"family string, repeat int, fold int, {unit} {kind}, y int, score double, probability double, threshold double, above boolean"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in schema.split(", ")]
            for batch in batches:
                done = 0
                for block in _blocks(iter([batch])):
                    n = len(block["y"])
                    ids = batch.column(unit).slice(done, n)
                    done += n
                    fold = block["outer"]
                    at = np.arange(folds.repeats) * folds.outer + fold  # rows by repeat
                    row = np.repeat(np.arange(n), folds.repeats)
                    for family, b in chosen.items():
                        score = np.take_along_axis(block["x"] @ b[:-1] + b[-1], at, 1).ravel()
                        cut = thresholds[family][at].ravel()
                        columns = [pa.array([family] * len(row)), pa.array(np.tile(np.arange(folds.repeats, dtype=np.int32), n)), pa.array(fold.ravel().astype(np.int32)), ids.take(pa.array(row))]
                        columns += [pa.array(block["y"][row].astype(np.int32)), pa.array(score), pa.array(1 / (1 + np.exp(-np.clip(score, -500, 500)))), pa.array(cut), pa.array(score > cut)]
                        yield pa.RecordBatch.from_arrays(columns, names)

        return self.folds.marked(rows.select(unit, "y", "x"), unit).mapInArrow(run, schema)


def one_se(mean: np.ndarray, error: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Of each row's candidates: the strongest penalty whose mean loss is within one standard error of the least; of equal ones the least loss, then the first."""
    best = mean.argmin(1)
    at = np.arange(len(mean))
    able = mean <= (mean[at, best] + error[at, best])[:, None]
    strongest = np.where(able, penalties, np.inf).min(1)
    able &= penalties == strongest[:, None]
    return np.where(able, mean, np.inf).argmin(1)


def nested_cv(rows: DataFrame, unit: str, d: int, folds: Folds = Folds(), families: tuple[Family, ...] = FAMILIES) -> Nested:
    """Tune, fit and set thresholds for every family, repeat and held fold, all at once.

    ``rows`` has the unit's id, y and x; rows with a null in y or x are the
    caller's to drop.  Candidates are judged by the mean over inner folds of the
    log loss; an inner fold without rows does not count.  The threshold is the
    95 % order statistic (higher) of the inner out-of-fold scores of class 0.
    """
    data = folds.marked(rows.select(unit, "y", "x"), unit).select("y", "x", "outer", "inside")
    data = _spread(data).persist()
    try:
        designs, of = [], {}
        for family in families:
            c = np.repeat(np.array(family.penalties), folds.sets)
            training = np.tile(np.arange(folds.sets), len(family.penalties))
            columns = [np.array([j]) for j in range(d)] if family.single else [np.arange(d)]
            of[family.name] = range(len(designs), len(designs) + len(columns))
            designs += [Models(x, training, c, np.full(len(c), family.mix), family.whole) for x in columns]
        fit(data, folds.weights, folds.sets, designs, d, near=True)

        # Losses on the inner folds left out: candidates (design, penalty) by repeat, held fold and inner fold.
        cells, j = folds.repeats * folds.outer, folds.inner
        inner_sets = np.array([s for s in range(folds.sets) if s % (j + 1) != j])
        sizes = [len(m.c) // folds.sets for m in designs]
        starts = np.cumsum([0, *sizes]) * len(inner_sets)

        def judge(block):
            """Each row in the one inner fold of a cell that leaves it out."""
            held, inside = folds.parts(block)
            at = np.arange(cells) * j + inside
            row, cell = np.nonzero(~held)
            at = at[row, cell]
            count = lambda w=None: np.bincount(at, w, len(inner_sets)).astype(float)
            out = [count()]
            turn = np.where(block["y"] == 1, -1.0, 1.0)[row]
            for m, size in zip(designs, sizes):
                x = block["x"][:, m.columns]
                for p in range(size):
                    b = m.coefficients[:, p * folds.sets + inner_sets]
                    if len(m.columns) == 1:
                        score = x[row, 0] * b[0, at] + b[1, at]
                    else:
                        score = (x @ b[:-1] + b[-1])[row, at]
                    score = score * turn
                    loss = np.maximum(score, 0) + np.log1p(np.exp(-np.abs(score)))
                    out.append(count(np.clip(loss, -np.log1p(-1e-8), -np.log(1e-8))))
            return np.concatenate(out)

        judged = sums(data, judge, (1 + sum(sizes)) * len(inner_sets))
        number, losses = judged[: len(inner_sets)], judged[len(inner_sets) :]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (losses.reshape(-1, len(inner_sets)) / number).reshape(-1, cells, j)
        good = np.isfinite(mean)
        k = good.sum(2)
        average = np.where(good, mean, 0).sum(2) / np.maximum(k, 1)
        deviation = np.sqrt((np.where(good, mean - average[:, :, None], 0) ** 2).sum(2) / np.maximum(k - 1, 1)) / np.sqrt(np.maximum(k, 1))

        nested = Nested(folds, {}, {}, {}, {}, {})
        for family in families:
            own = [int(starts[i]) // len(inner_sets) + p for i in of[family.name] for p in range(sizes[i])]
            penalties = np.tile(family.penalties, len(of[family.name]))
            pick = one_se(average[own].T, np.where(k > 1, deviation, 0.0)[own].T, penalties)
            design, at = np.divmod(pick, len(family.penalties))
            chosen, inside_ = np.zeros((d + 1, cells)), np.zeros((d + 1, cells, j))
            for cell in range(cells):
                m = designs[of[family.name][design[cell]]]
                first = at[cell] * folds.sets + cell * (j + 1)
                places = np.append(m.columns, d)
                chosen[places, cell] = m.coefficients[:, first + j]
                inside_[places, cell] = m.coefficients[:, first : first + j]
            nested.chosen[family.name], nested.inner[family.name] = chosen, inside_.reshape(d + 1, -1)
            nested.penalty[family.name] = penalties[pick]
            nested.feature[family.name] = np.where(design * family.single + family.single > 0, design, -1)

        names = [f.name for f in families]

        def inner_scores(block):
            held, inside = folds.parts(block)
            used = np.tile(~held & (block["y"] == 0)[:, None], (1, len(names)))
            found = []
            for name in names:
                b = nested.inner[name]
                score = (block["x"] @ b[:-1] + b[-1]).reshape(len(held), cells, j)
                found.append(np.take_along_axis(score, inside[:, :, None], 2)[:, :, 0])
            return np.concatenate(found, axis=1), used

        higher = lambda n: np.ceil((np.maximum(n, 1) - 1) * 0.95 - 1e-9)
        cut = order_statistics(data, inner_scores, higher, cells * len(names)).reshape(len(names), cells)
        nested.thresholds.update(zip(names, cut))
        return nested
    finally:
        data.unpersist()


# --- judgement of scores


def calibration(df: DataFrame, by: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """Intercept and slope of a logistic recalibration of the score within each group, with why there is none.

    The groups' keys and extremes go to the driver (there are as many as there
    are models to judge); their rows meet nowhere.  Statuses: estimable,
    nonestimable_constant_score, nonestimable_complete_separation_increasing
    and _decreasing.
    """
    spark = df.sparkSession
    used = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score))
    of = lambda f, y: f(F.when(F.col(label) == y, F.col(score)))
    ends = used.groupBy(*by).agg(*[of(f, y).alias(f"{n}{y}") for y in (0, 1) for n, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n"))
    groups = sorted(ends.collect(), key=lambda r: tuple(map(repr, r[: len(by)])))

    def status(r) -> str:
        known = [v for v in (r["low0"], r["low1"], r["high0"], r["high1"]) if v is not None]
        if np.allclose(known, known[0]):
            return "nonestimable_constant_score"
        if None in (r["low0"], r["low1"]):
            return "nonestimable_one_class"
        if r["high0"] <= r["low1"]:
            return "nonestimable_complete_separation_increasing"
        return "nonestimable_complete_separation_decreasing" if r["high1"] <= r["low0"] else "estimable"

    found = [status(r) for r in groups]
    able = [i for i, s in enumerate(found) if s == "estimable"]
    out = {}
    if able:
        keys = spark.createDataFrame([(*groups[i][: len(by)], n) for n, i in enumerate(able)], ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "") + "set int")
        same = F.lit(True)
        for c in by:
            same = same & df[c].eqNullSafe(keys[c])
        x = F.array(df[score].cast("double")).alias("x")
        rows = used.join(F.broadcast(keys), same).select(df[label].alias("y"), x, "set", (df[weight].cast("double") if weight else F.lit(1.0)).alias("w"))
        rows = _spread(rows).persist()
        try:
            one = Models(np.array([0]), np.arange(len(able)), np.full(len(able), 1e12), np.zeros(len(able)))
            fit(rows, lambda b: (b["set"][:, None] == np.arange(len(able))) * b["w"][:, None], len(able), [one], 1)
        finally:
            rows.unpersist()
        out = {i: one.coefficients[:, n] for n, i in enumerate(able)}
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "")
    data = [(*r[: len(by)], r["n"], s, *((float(out[i][0]), float(out[i][1])) if i in out else (None, None))) for i, (r, s) in enumerate(zip(groups, found))]
    return spark.createDataFrame(data, schema + "n long, status string, slope double, intercept double")


def metric_block(oof: DataFrame, by: list[str], label: str = "y", score: str = "score", probability: str = "probability", above: str = "above") -> DataFrame:
    """AUC, Brier score, calibration with its status, and the confusion at one half and at the 95 % threshold, of each group.

    A rate whose denominator is empty is null.  Calibration is of the label on the
    log odds, of probabilities kept 1e-6 away from 0 and 1.
    """
    p = F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = inference.auc(oof, by, label, score)
    half = inference.confusion(oof, by, label, F.col(probability) >= 0.5, F.col(probability))
    high = inference.confusion(oof, by, label, F.col(above))
    named = lambda df, prefix: df.select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in ("sensitivity", "specificity", "balanced_accuracy")])
    fitted = calibration(oof.withColumn("__z", F.log(p / (1 - p))), by, label, "__z")
    fitted = fitted.select(*by, F.col("slope").alias("calibration_slope"), F.col("intercept").alias("calibration_intercept"), F.col("status").alias("calibration_status"))
    out = out.join(half.select(*by, "brier"), by).join(named(half, "half"), by).join(named(high, "q95"), by)
    return out.join(F.broadcast(fitted), by, "left")  # a row a group, made on the driver


# --- resampling and subsets


#: Distribution function of Poisson(1) at 0, 1, ...
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.maximum(np.arange(13), 1)))


def optimism(rows: DataFrame, unit: str, d: int, draws: int, inner: int = 4, seed: int = 1, penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """draw, c, apparent and original: AUC of a ridge model tuned and fitted in each bootstrap draw, there and on all units.

    A unit counts Poisson(1) times in a draw, by a hash of draw and unit; its copies share an inner fold.
    """
    u = lambda salt, i: F.xxhash64(F.lit(seed + salt), i, F.col(unit))
    share = lambda i: F.pmod(u(0, i), F.lit(1 << 52)) / F.lit(float(1 << 52))
    cdf = F.array(*[F.lit(float(c)) for c in _POISSON])
    numbered = F.sequence(F.lit(0), F.lit(draws - 1))
    times = F.transform(numbered, lambda i: F.size(F.filter(cdf, lambda c: c < share(i))))
    inside = F.transform(numbered, lambda i: F.pmod(u(1, i), F.lit(inner)).cast("int"))
    data = _spread(rows.select("y", "x", times.alias("times"), inside.alias("inside"))).persist()
    sets = draws * (inner + 1)

    def weights(block):
        apart = np.ones((*block["times"].shape, inner + 1))
        apart[:, :, :inner] = block["inside"][:, :, None] != np.arange(inner)
        return (apart * block["times"][:, :, None]).reshape(len(apart), -1)

    try:
        c = np.repeat(np.array(penalties), sets)
        model = Models(np.arange(d), np.tile(np.arange(sets), len(penalties)), c, np.zeros(len(c)), whole=True)
        fit(data, weights, sets, [model], d, near=True)
        b = model.coefficients.reshape(d + 1, len(penalties), draws, inner + 1)

        def judge(block):
            valid = (block["inside"][:, :, None] == np.arange(inner)) * block["times"][:, :, None]
            score = block["x"] @ b[:-1, :, :, :inner].reshape(d, -1) + b[-1, :, :, :inner].reshape(-1)
            score = score.reshape(len(valid), len(penalties), draws, inner)
            y = block["y"].astype(float)[:, None, None, None]
            loss = (np.logaddexp(0, score) - y * score) * valid[:, None]
            return np.concatenate([valid.sum(0).ravel().astype(float), loss.sum(0).ravel()])

        judged = sums(data, judge, (1 + len(penalties)) * draws * inner)
        number = judged[: draws * inner].reshape(1, draws, inner)
        mean = judged[draws * inner :].reshape(len(penalties), draws, inner) / np.maximum(number, 1)
        pick = one_se(mean.mean(2).T, mean.std(2, ddof=1).T / np.sqrt(inner), np.array(penalties))
        chosen = b[:, pick, np.arange(draws), inner]
    finally:
        data.unpersist()

    def both(block):
        """Each draw's scores with its own weights, and with each row once."""
        sign = np.where(block["y"] == 1, 1, -1)[:, None]
        found = block["x"] @ chosen[:-1] + chosen[-1]
        return np.tile(found, 2), sign * np.concatenate([block["times"], np.ones_like(block["times"])], axis=1)

    judged = auc_of(_spread(rows.select("y", "x", times.alias("times"))), both, 2 * draws)
    of = lambda first, name: judged.filter((F.col("model") >= first) & (F.col("model") < first + draws)).select((F.col("model") - first).alias("draw"), F.col("auc").alias(name))
    apparent, original = of(0, "apparent"), of(draws, "original")
    used = rows.sparkSession.createDataFrame([(i, float(penalties[k])) for i, k in enumerate(pick)], "draw int, c double")
    return F.broadcast(used).join(apparent, "draw").join(original, "draw")


def subset_sweep(rows: DataFrame, unit: str, subsets: list[tuple[int, tuple[int, ...]]], d: int, folds: int = 5, c: float = 1.0, seed: int = 29) -> DataFrame:
    """id and auc: the out-of-fold AUC of a ridge model on each subset (id, columns), all folds of all subsets fitted together."""
    data = rows.select("y", "x", F.pmod(F.xxhash64(F.lit(seed), F.col(unit)), F.lit(folds)).cast("int").alias("fold"))
    kept = _spread(data).persist()
    try:
        designs = [Models(np.array(columns), np.arange(folds), np.full(folds, c), np.zeros(folds), whole=True) for _, columns in subsets]
        fit(kept, lambda b: (b["fold"][:, None] != np.arange(folds)).astype(float), folds, designs, d, near=True)
    finally:
        kept.unpersist()
    ids = np.array([i for i, _ in subsets], np.int64)
    all_of = np.zeros((folds, d + 1, len(subsets)))
    for s, m in enumerate(designs):
        all_of[:, np.append(m.columns, d), s] = m.coefficients.T

    def values(block):
        found = np.empty((len(block["y"]), len(ids)))
        for f in np.unique(block["fold"]):
            own = block["fold"] == f
            found[own] = block["x"][own] @ all_of[f, :-1] + all_of[f, -1]
        return found, np.where(block["y"] == 1, 1, -1)[:, None]

    names = rows.sparkSession.createDataFrame(list(enumerate(ids.tolist())), "model int, id long")
    return auc_of(_spread(data), values, len(ids)).join(F.broadcast(names), "model").select("id", "auc")
