"""Exact top-k inner-product search by a Voronoi kNN join.

Vectors become whole numbers, floor(scale * component).  Appending the
component sqrt(M - |x|^2) to data vectors (M: the largest squared norm) and 0
to queries turns the inner-product order into the distance order, which pivots
can bound.  The plan:

1. a sample of data vectors serves as pivots, a quarter of the square root of
   the rows between bounds; every vector belongs to its nearest pivot's cell;
2. one small summary per cell - rows, smallest and largest distance to the
   pivot, the k + 1 nearest distances - is gathered (its size depends on the
   number of pivots only);
3. from the summaries each query group gets an upper bound of the distance of
   its k-th neighbour, and by it each query the list of cells that may hold a
   neighbour (triangle and hyperplane bounds); only there it is copied to;
4. cells are cut into slices of data rows and panels of queries of ``BLOCK_BYTES``
   of vector each, solved locally, and the slices' best k merged.

With n rows and m queries in a cell, n * m / panel + n * m / slice vectors are
shuffled, so both are as large as a task's memory allows, whatever the width.
So a cell that holds a third of all rows is many tasks, and nothing is dropped.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, as data or query; vectors of different lengths are compared over
the components that both have; ties go to the smaller id; equal ids on several
rows are one candidate each, answer as one query, and never meet each other;
rows without an id take no part;
scores beyond the range of a long are clipped to it; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage_table

#: Fewest and most pivots; the driver holds the distances between them.
PIVOTS = (48, 2048)
#: Bytes of the vectors of a slice of data rows, or of a panel of queries.
BLOCK_BYTES = 1 << 23
#: Distances to pivots, or scores, that are held at a time.
CELLS_AT_ONCE = 1 << 21
#: Sums of products below this are exact in doubles, in any order.
EXACT = float(1 << 53)
#: Relative slack on every bound, for rounding in the distances.
SLACK = 1e-9

_FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), lengths)
    places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = values
    return out


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products, clipped to the range of a long."""
    largest = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(queries.shape[1], 1)
    if largest < EXACT:
        return (queries @ data.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    products = whole(queries).astype(object) @ whole(data).astype(object).T
    return np.clip(products, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of each query's best k: highest score, then smallest id."""
    out = [[], [], []]
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    for query, row in zip(query_ids, scores):
        use = np.flatnonzero(ids != query)
        if len(use) > k:
            floor = np.partition(row[use], len(use) - k)[len(use) - k]
            use = use[row[use] >= floor]
        use = use[np.argsort(-row[use].astype(object) if len(use) and row[use].min() == -(1 << 63) else -row[use], kind="stable")][:k]
        out[0].append(np.full(len(use), query))
        out[1].append(ids[use])
        out[2].append(row[use])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and whole-number vector of the rows that take part."""
    x = F.col(vector_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    kept = vectors.filter(x.isNotNull() & F.forall(x, finite)).filter(F.col(id_col).isNotNull())
    # floor() gives a long; doubles past 2^53 are whole already.
    whole = F.transform(
        x,
        lambda v: F.when(
            F.abs(v.cast("double") * scale) < F.lit(2.0**53), F.floor(v.cast("double") * scale).cast("double")
        ).otherwise(v.cast("double") * scale),
    )
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _squared(col: str) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, x: a + x * x)


def _cells_needed(
    own: np.ndarray, to_pivots: np.ndarray, gaps: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray
) -> np.ndarray:
    """Which cells may hold a neighbour within ``limit`` of each query (rows), by the two bounds."""
    rows = np.arange(len(own))
    triangle = np.maximum(to_pivots - high, low - to_pivots)
    nearest = to_pivots[rows, own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (to_pivots**2 - nearest[:, None] ** 2) / (2 * gaps[own])
    plane = np.where(gaps[own] > 0, plane, 0)
    bound = np.maximum(triangle, plane)
    return bound <= (limit[own] * (1 + 1e-6) + SLACK * (1 + to_pivots.max(initial=0)))[:, None]


def knn_join(
    data: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    pivots: int | None = None,
    slice_rows: int | None = None,
    slice_queries: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id and score of the best ``k`` rows for every row where ``is_query`` holds.

    ``is_query`` is an expression over column vec_id.  Pivots and slices follow
    the rows and the width unless given.
    """
    spark = data.sparkSession
    whole = stage_table(whole_vectors(data, id_col, vector_col, scale), "knn-vectors")
    rows, width, largest = whole.agg(
        F.count("*"), F.max(F.size("v")), F.max(_squared("v"))
    ).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not rows:
        return empty
    pivots = pivots or int(min(max(rows**0.5 / 4, PIVOTS[0]), PIVOTS[1]))
    block = max(1024, BLOCK_BYTES // (8 * max(width, 1)))
    slice_rows, slice_queries = slice_rows or block, slice_queries or block
    # Pivots: a bounded sample, the distinct vectors of the rows whose ids have the smallest hashes.
    chosen = whole.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(pivots).collect()
    chosen = list(dict.fromkeys(tuple(row.v) for row in chosen))
    centre = np.zeros((len(chosen), width + 1))
    for n, vector in enumerate(chosen):
        centre[n, : len(vector)] = vector
    # The extra component of data vectors; pivots are data vectors.
    centre[:, width] = np.sqrt(np.maximum(largest - (centre**2).sum(1), 0))
    square = (centre**2).sum(1)
    gaps = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * centre @ centre.T, 0))

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + square - 2 * x @ centre.T, 0))

    def lifted(x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(largest - (x**2).sum(1), 0))
        return np.concatenate([x, extra[:, None]], 1)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CELLS_AT_ONCE // len(centre))
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                yield batch.slice(a, most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            d = distances(lifted(_matrix(batch.column(1), width), False))
            cell = d.argmin(1)
            near = d[np.arange(len(d)), cell]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(near)],
                ["vec_id", "v", "cell", "d"],
            )

    def assign_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            d = distances(lifted(_matrix(batch.column(1), width), True))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["cell", "d"]
            )

    placed = stage_table(
        whole.mapInArrow(assign, "vec_id long, v array<double>, cell int, d double"), "knn-cells"
    )
    asked = placed.filter(is_query).select("vec_id", "v")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, near, far = np.zeros(len(centre), np.int64), {}, np.zeros(len(centre))
        for batch in batches:
            cell, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell):
                mine = d[cell == c]
                count[c] += len(mine)
                far[c] = max(far[c], mine.max())
                near[c] = np.sort(np.concatenate([near.get(c, mine[:0]), mine]))[: k + 1]
        used = np.array(sorted(near), np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used),
                pa.array(count[used]),
                pa.array(far[used]),
                pa.array([near[c].tolist() for c in used], pa.list_(pa.float64())),
            ],
            ["cell", "n", "far", "near"],
        )

    shape = "cell int, n long, far double, near array<double>"
    merged = (
        placed.select("cell", "d")
        .mapInArrow(summarise, shape)
        .groupBy("cell")
        .agg(
            F.sum("n").alias("n"),
            F.max("far").alias("far"),
            F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"),
        )
        .collect()
    )
    count = np.zeros(len(centre), np.int64)
    low, high = np.full(len(centre), np.inf), np.full(len(centre), -np.inf)
    nearest: list[list[float]] = [[]] * len(centre)
    for row in merged:
        count[row.cell], high[row.cell], low[row.cell], nearest[row.cell] = row.n, row.far, row.near[0], row.near
    groups = asked.mapInArrow(assign_queries, "cell int, d double").groupBy("cell")
    reach = {r.cell: (r.n, r.d) for r in groups.agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()}
    if not reach:
        return empty
    # The (k + 1)-th smallest upper bound leaves room for the query's own row.
    limit = np.full(len(centre), np.inf)
    for cell, (_, radius) in reach.items():
        bounds = np.sort(np.concatenate([radius + gaps[cell, c] + np.array(nearest[c]) for c in range(len(centre))]))
        if len(bounds) > k:
            limit[cell] = bounds[k]
    slices = np.maximum(1, -(-count // slice_rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            x = _matrix(batch.column(1), width)
            d = distances(lifted(x, True))
            needed = _cells_needed(d.argmin(1), d, gaps, low, high, limit) & (count > 0)
            at, cell = np.nonzero(needed)
            for a in range(0, len(at), 4096):
                part = pa.array(at[a : a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(part), batch.column(1).take(part), pa.array(cell[a : a + 4096].astype(np.int32))],
                    ["vec_id", "v", "cell"],
                )

    sent = asked.mapInArrow(send, "vec_id long, v array<double>, cell int")
    sent = stage_table(sent, "knn-queries")
    loads = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    panels = np.array([max(1, -(-loads.get(c, 0) // slice_queries)) for c in range(len(centre))])

    def spread(frame: DataFrame, own: np.ndarray, other: np.ndarray, query: bool) -> DataFrame:
        """A row for each block (cell, slice of data, slice of queries) that the row takes part in."""
        sizes = spark.createDataFrame(
            [(c, int(a), int(b)) for c, (a, b) in enumerate(zip(own, other))], "cell int, own int, other int"
        )
        mine = F.pmod(F.xxhash64("vec_id"), F.col("own")).cast("int")
        out = frame.join(F.broadcast(sizes), "cell").withColumn("mine", mine)
        out = out.withColumn("across", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
        s, p = ("across", "mine") if query else ("mine", "across")
        return out.select("cell", F.col(s).alias("s"), F.col(p).alias("p"), F.lit(query).alias("q"), "vec_id", "v")

    used = placed.select("vec_id", "v", "cell")
    blocks = spread(used, slices, panels, False).unionByName(spread(sent, panels, slices, True))

    def solve(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids, q = block["vec_id"].to_numpy(), block["q"].to_numpy()
        x = _matrix(block["v"].combine_chunks(), width)
        at_once = max(1, CELLS_AT_ONCE // max(1, int((~q).sum())))
        found = [
            _best(_scores(x[ask], x[~q]), ids[~q], ids[ask], k)
            for ask in np.split(np.flatnonzero(q), range(at_once, int(q.sum()), at_once))
        ]
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    found = blocks.groupBy("cell", "s", "p").applyInArrow(solve, _FOUND)
    # Top k by row number: Spark cuts each partition to k rows per query before it shuffles them.
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
