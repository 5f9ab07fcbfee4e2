"""Several kinds of model judged on the same folds, none of which gathers a fold's rows.

Linear models are fitted in shared passes.  The Gaussian-kernel machine is solved in its dual by
working sets: the distinct rows stay spread over the tasks with their multipliers and decision
values, each round a bounded number of rows of each fold is solved against each other in one
task a fold, and every task adds their change to its own rows' decision values.  A set has the rows
between their bounds, rows drawn from all that violate the optimum (the worst alone lie on
one side of the machine's surface and undo each other's steps), and the settled rows next to it.
No task ever holds more of the kernel than rows of a block by a working set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import numeric
from . import fitting

#: Rows of a fold that are solved together: their kernel is that many squared, in single precision.
WORKING_SET = 4096
#: How far a margin may be from the optimum's conditions.
SLACK = 1e-3
MOST_ROUNDS = 5000
#: Rounds between cuts of the lineage.
CUT = 10
#: Columns of a kernel that are computed and added up at once.
TILE = 512

_STATE = "row long, y int, x array<double>, size array<double>, multiplier array<double>, value array<double>"
_CHOSEN = "fold int, kind int, key double, row long, y int, x array<double>, size double, multiplier double, value double"
#: Kinds of rows in a working set: between its bounds and in order, in violation of the optimum, settled at a bound.
FREE, VIOLATED, SETTLED = 0, 1, 2


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values, float).ravel()))


def _left(z: np.ndarray, gamma: float) -> np.ndarray:
    """Rows whose product with `_right` is -gamma times the squared distance."""
    return np.column_stack([2 * gamma * z, -gamma * (z * z).sum(1), np.ones(len(z))])


def _right(z: np.ndarray, gamma: float) -> np.ndarray:
    return np.column_stack([z, np.ones(len(z)), -gamma * (z * z).sum(1)]).T


def _kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Gaussian kernel and the constant that stands for the offset; distances in double precision."""
    return np.exp(np.minimum(left @ right, 0).astype(np.float32)) + np.float32(1)


def _weighted(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Kernel times weights, a tile at a time."""
    out = np.zeros(len(left))
    for a in range(0, len(weight), TILE):
        out += _kernel(left, right[:, a : a + TILE]) @ weight[a : a + TILE].astype(np.float32)
    return out


def _kept(df: DataFrame) -> DataFrame:
    """Computed once, in the folder that driver and executors share if there is one (a lost executor then loses nothing)."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def _machine(rows: DataFrame, folds: int, d: int, c: float = 1.0, working_set: int | None = None) -> DataFrame:
    """The distinct rows with, for each fold, the size in its training rows and the decision value under its machine.

    ``rows`` has y (0 or 1), x and fold.  Equal rows of one label share a multiplier of as many
    times the bound, which has the same optimum.
    """
    held = [F.count_if(F.col("fold") == f).cast("double").alias(f"n{f}") for f in range(folds)]
    distinct = rows.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), *held)
    zero = F.array_repeat(F.lit(0.0), folds)
    # Multiplicity in the training rows of each fold.
    size = F.array(*[F.col("n") - F.col(f"n{f}") for f in range(folds)])
    state = distinct.select(F.monotonically_increasing_id().alias("row"), "y", "x", size.alias("size"), zero.alias("multiplier"), zero.alias("value"))
    # Dealt out evenly, so that a task's share of a working set is that of any other.
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, state.rdd.getNumPartitions())
    state = _kept(state.repartition(tasks))
    most = working_set or WORKING_SET
    share = -(-2 * most // tasks) + 64

    moments = fitting.moments(state, lambda b: b["size"], folds, d)
    total = np.maximum(moments[0], 1.0)
    mean = (moments[1 : d + 1] / total).T
    variance = np.maximum((moments[d + 1 :] / total).T - mean**2, 0)
    sd = np.where(variance > 1e-14 * np.maximum(mean**2, 1e-300), np.sqrt(variance), 1.0)
    gamma = 1 / np.maximum(np.where(sd > 0, variance / sd**2, 0).sum(1), 1e-12)

    def pick(seed: int):
        """At most ``share`` rows of each fold and kind."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            draw = np.random.default_rng(seed)
            best: dict[tuple[int, int], list[np.ndarray]] = {}
            for block in fitting._blocks(batches):
                sign = np.where(block["y"] == 1, 1.0, -1.0)[:, None]
                slope = 1 - sign * block["value"]
                below, above = block["multiplier"] < c * block["size"], block["multiplier"] > 0
                bad = (below & (slope > SLACK)) | (above & (slope < -SLACK))
                kind = np.where(bad, VIOLATED, np.where(below & above, FREE, SETTLED))
                key = np.where(kind == SETTLED, np.abs(slope), draw.random(slope.shape))
                for f in range(folds):
                    for k in (FREE, VIOLATED, SETTLED):
                        at = np.flatnonzero((kind[:, f] == k) & (block["size"][:, f] > 0))
                        own = [key[at, f], block["row"][at], block["y"][at], block["x"][at], block["size"][at, f], block["multiplier"][at, f], block["value"][at, f]]
                        own = [np.concatenate(p) for p in zip(best[f, k], own)] if (f, k) in best else own
                        keep = slice(None) if len(own[0]) <= share else np.argpartition(own[0], share - 1)[:share]
                        best[f, k] = [p[keep] for p in own]
            for (f, k), own in best.items():
                if n := len(own[0]):
                    columns = [pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(own[0]), pa.array(own[1]), pa.array(own[2].astype(np.int32)), _lists(own[3]), *map(pa.array, own[4:])]
                    yield pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in _CHOSEN.split(", ")])

        return run

    def solve(table: pa.Table) -> pa.Table:
        kind, f = table.column("kind").to_numpy(), table.column("fold")[0].as_py()
        n = np.bincount(kind, minlength=3)
        # Half of a set at least is for rows in violation, if there are as many; without any the fold is done.
        n[FREE] = min(n[FREE], max(most // 2, most - n[VIOLATED]))
        n[VIOLATED] = min(n[VIOLATED], most - n[FREE])
        n[SETTLED] = min(n[SETTLED], most - n[FREE] - n[VIOLATED])
        order = np.lexsort([table.column("row").to_numpy(), table.column("key").to_numpy(), kind])
        order = np.concatenate([order[kind[order] == k][: n[k]] for k in (FREE, VIOLATED, SETTLED)])
        own = table.take(pa.array(np.sort(order)))
        sign = np.where(own.column("y").to_numpy() == 1, 1.0, -1.0)
        old = new = own.column("multiplier").to_numpy()
        if n[VIOLATED]:
            z = (own.column("x").combine_chunks().flatten().to_numpy().reshape(len(own), -1) - mean[f]) / sd[f]
            m, side = _kernel(_left(z, gamma[f]), _right(z, gamma[f])), sign.astype(np.float32)
            m *= side[:, None]
            m *= side
            new = numeric.box_ascent(m, 1 - sign * own.column("value").to_numpy(), old, c * own.column("size").to_numpy(), SLACK / 2)
        found = pa.table({"fold": own.column("fold"), "row": own.column("row"), "x": own.column("x"), "multiplier": pa.array(new), "change": pa.array((new - old) * sign)})
        return found.filter(pa.array((new != old) | (own.column("kind").to_numpy() == VIOLATED)))

    def chosen(state: DataFrame, seed: int) -> dict[int, tuple]:
        # One partition a fold: hashes, and adaptive planning, would solve several in one task.
        rows = state.mapInArrow(pick(seed), _CHOSEN).repartitionById(folds, F.col("fold"))
        found = rows.groupBy("fold").applyInArrow(solve, "fold int, row long, x array<double>, multiplier double, change double").toPandas()
        return {int(f): (own["row"].to_numpy(), np.stack(own["x"].to_numpy()), own["multiplier"].to_numpy(), own["change"].to_numpy()) for f, own in found.groupby("fold")}

    def moved(changes: dict[int, tuple]):
        ready = {}
        for f, (row, x, multiplier, change) in changes.items():
            by_row, some = np.argsort(row), change != 0
            ready[f] = (row[by_row], multiplier[by_row], _right((x[some] - mean[f]) / sd[f], gamma[f]), change[some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in fitting._blocks(batches):
                multiplier, value = block["multiplier"].copy(), block["value"].copy()
                for f, (row, new, right, change) in ready.items():
                    at = np.minimum(np.searchsorted(row, block["row"]), len(row) - 1)
                    mine = row[at] == block["row"]
                    multiplier[mine, f] = new[at[mine]]
                    value[:, f] += _weighted(_left((block["x"] - mean[f]) / sd[f], gamma[f]), right, change)
                columns = [pa.array(block["row"]), pa.array(block["y"]), _lists(block["x"]), _lists(block["size"]), _lists(multiplier), _lists(value)]
                yield pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in _STATE.split(", ")])

        return run

    before = None
    for done in range(MOST_ROUNDS):
        changes = chosen(state, done)  # computes the state and keeps it
        if before is not None:
            before.unpersist()
        if not changes:
            break
        before, state = state, state.mapInArrow(moved(changes), _STATE)
        state = _kept(state) if done % CUT == CUT - 1 else state.persist()
    else:
        raise RuntimeError(f"kernel machine: rows still violate the optimum after {MOST_ROUNDS} rounds")
    return state


def kernel_values(rows: DataFrame, folds: int, d: int, c: float = 1.0, working_set: int | None = None) -> DataFrame:
    """y, fold, n and value: decision values of the distinct rows held out in each fold, under the machine of the other folds.

    ``rows`` has y (0 or 1), x and fold.
    """
    state = _machine(rows, folds, d, c, working_set)
    # A row is in the training rows of every fold but its own.
    total = (F.aggregate("size", F.lit(0.0), lambda s, n: s + n) / (folds - 1)).alias("total")
    each = state.select("y", total, F.posexplode(F.arrays_zip("value", "size")).alias("fold", "p"))
    return each.select("y", "fold", (F.col("total") - F.col("p.size")).cast("long").alias("n"), "p.value").filter("n > 0")


def _aucs(rows: DataFrame, values, models: int) -> list[float | None]:
    found = {r["model"]: r["auc"] for r in fitting.auc_of(rows, values, models).collect()}
    return [found.get(m) for m in range(models)]


def compare(rows: DataFrame, folds: int, d: int) -> DataFrame:
    """held, model, n and out-of-fold auc of ridge, elastic net, Gaussian-kernel machine and the best single feature.

    ``rows`` has y (0 or 1), x (``d`` doubles) and fold.  The best feature is the one that parts
    the training labels best, turned the way it does there.  What is returned is as small as the
    folds, so it is computed here and no plan is left.
    """
    kept = fitting._spread(rows.select("y", "x", "fold")).persist()
    kinds = {"ridge": fitting.Models(np.arange(d), np.arange(folds), np.ones(folds), np.zeros(folds))}
    kinds["elastic_net"] = fitting.Models(np.arange(d), np.arange(folds), np.full(folds, 0.1), np.full(folds, 0.5))
    fitting.fit(kept, lambda b: (b["fold"][:, None] != np.arange(folds)).astype(float), folds, list(kinds.values()), d)
    b = np.concatenate([m.coefficients for m in kinds.values()], axis=1)
    held = np.tile(np.arange(folds), len(kinds))

    def values(block):
        """Of every linear model on its held fold, then of every feature on the held and on the training rows of every fold."""
        sign, own = np.where(block["y"] == 1, 1, -1)[:, None], block["fold"][:, None]
        each = np.repeat(own == np.arange(folds), d, axis=1)
        score = np.concatenate([block["x"] @ b[:-1] + b[-1], *[np.tile(block["x"], folds)] * 2], axis=1)
        return score, sign * np.concatenate([own == held, each, ~each], axis=1)

    def decided(block):
        total = block["size"].sum(1, keepdims=True) / (folds - 1)
        return block["value"], np.where(block["y"] == 1, 1, -1)[:, None] * np.rint(total - block["size"])

    count = {r["fold"]: r["count"] for r in kept.groupBy("fold").count().collect()}
    aucs = _aucs(kept, values, len(held) + 2 * folds * d)
    linear, test, training = aucs[: len(held)], *(np.reshape(np.array(aucs[len(held) :], object), (2, folds, d)))
    state = _machine(kept, folds, d)
    machine = _aucs(state, decided, folds)
    state.unpersist()
    kept.unpersist()
    found = []
    for f in sorted(count):
        apart = [-1.0 if a is None else abs(a - 0.5) for a in training[f]]
        best = apart.index(max(apart))
        auc, rising = test[f][best], training[f][best] is not None and training[f][best] >= 0.5
        found.append((f, "best_single", count[f], auc if rising or auc is None else 1 - auc))
        found += [(f, name, count[f], linear[i * folds + f]) for i, name in enumerate(kinds)]
        found.append((f, "rbf_svm", count[f], machine[f]))
    return rows.sparkSession.createDataFrame(found, "held int, model string, n long, auc double")
