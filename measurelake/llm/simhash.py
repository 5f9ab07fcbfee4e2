"""Near-duplicate detection by SimHash and a segment-popcount grid join.

Words are split at ASCII white space after lower-casing A-Z; shingles are four
words, repeats included (a shorter text is one shingle; a text without words
has fingerprint zero and is linked like any other).  A fingerprint bit is set
if it is set in over half of the shingle hashes (XXH64, seed 42).

Fingerprints link at ``max_distance`` or fewer differing bits.  Each distinct
fingerprint is embedded as a vector of bit counts, one per two-bit segment;
the Manhattan distance of two such vectors is a lower bound of the Hamming
distance.  The segments form ``max_distance + 2`` blocks at least.  Differing bits
spoil at most ``max_distance`` blocks, so two linked fingerprints agree in the
popcounts of at least two whole blocks: every pair of blocks is one grid, the
popcounts in it the cell, and only fingerprints that share a cell are compared
- first by the Manhattan bound, then exactly.  From some ten million
fingerprints on there are more blocks, and grids of three or more of them
(``agreeing_blocks``): cells stay small, and any number finds the same links.
No pair list is emitted: each
cell contributes a spanning forest of its links, so a dense group of n copies
costs about n edges.  Cells over ``cell_rows`` fingerprints are cut into
chunks which are compared chunk against chunk.

``similar_representatives`` groups texts by the similarity of their shingle sets
instead.  Texts at a Jaccard similarity of 0.8 differ in some 15 % of the bits of
a fingerprint, far beyond any radius that a grid can serve, so each set is dealt
by hash into parts of about ``PART_SHINGLES`` shingles and every part has a
fingerprint of its own.  Of ``PARTS`` parts some are the same in both texts; they
meet in the grid, at Manhattan distance 0, and the sets are verified exactly.
Texts are dealt at two sizes of parts, powers of two, so that similar texts of
different lengths share one; short sets are dealt several times.  A pair at
similarity 0.8 has no part in common with probability below 1 in 1,000, at 0.9
below 1 in a million.

Components come from alternating large-star and small-star rounds; every round
is written to the shared folder.

Defined cases: null text is text without words; repeated rows give repeated
result rows with the same component; rows with a null id get a result row but
never name a component unless all members are null; long texts are counted in
blocks of hashes; other columns of the input, whatever their names, do not
matter; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stage_table

SEED = 42
SEGMENTS = 32
CELL_ROWS = 20_000
SMALL_CELL = 48
ROW_COST = 100
MOST_AGREEING = 6
MAX_ROUNDS = 60
#: Least Jaccard similarity of two shingle sets, as a fraction of whole numbers.
SIMILARITY = (4, 5)
PART_SHINGLES = 4
PARTS = 16
BUCKET_NODES = 2048
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _shingle_hashes(data: bytes, width: int) -> np.ndarray:
    words = data.split()
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    starts = [0] + [e + 1 for e in ends]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])),
        np.uint64,
        len(words) - width + 1,
    )


_BLOCK = 1 << 18


def simhash(text: str | None, width: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    hashes = _shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), width)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        octets = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id (of the id column's type) and fp, the unsigned fingerprint's bits as a long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.as_py(), width) for t in batch.column(1)]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def segment_popcounts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, one row per fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, SEGMENTS, 64 // SEGMENTS).sum(2, dtype=np.uint8)


def agreeing_blocks(n: int, max_distance: int) -> int:
    """How many blocks a grid takes for ``n`` fingerprints: the least cost of rows sent and pairs compared.

    A segment's popcount carries 1.5 bits; a row written, shuffled and sorted
    costs about ``ROW_COST`` comparisons.
    """

    def cost(k: int) -> float:
        grids = math.comb(max_distance + k, k)
        bits = 1.5 * SEGMENTS * k / (max_distance + k)
        return grids * n * (ROW_COST + n / 2 / 2**bits)

    return min(range(2, MOST_AGREEING + 1), key=cost)


def grid_cells(fps: np.ndarray, max_distance: int, agree: int = 2) -> np.ndarray:
    """The cell of each fingerprint in every grid of ``agree`` blocks: an int64 array, fingerprints by grids."""
    blocks = max_distance + agree
    counts = segment_popcounts(fps).astype(np.int64)
    edges = np.linspace(0, SEGMENTS, blocks + 1).astype(int)
    codes = []
    for a, b in zip(edges[:-1], edges[1:]):
        code = np.zeros(len(fps), np.int64)
        for s in range(a, b):
            code = code * 3 + counts[:, s]
        codes.append(code)
    span = 3 ** int(np.diff(edges).max())
    cells = []
    for g, chosen in enumerate(itertools.combinations(range(blocks), agree)):
        cell = np.full(len(fps), g, np.int64)
        for i in chosen:
            cell = cell * span + codes[i]
        cells.append(cell)
    return np.stack(cells, axis=1)


def _near(point: np.uint64, popcounts: np.ndarray, fps: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Positions within ``limit`` bits: the Manhattan lower bound first, then exactly."""
    bound = np.abs(counts.astype(np.int8) - popcounts.astype(np.int8)).sum(1)
    maybe = np.flatnonzero(bound <= limit)
    return maybe[np.bitwise_count(fps[maybe] ^ point) <= limit]


def _forest(fps: np.ndarray, side: np.ndarray | None, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``fps``; with ``side``, of links between the two sides.

    Breadth first: what a visited point links to leaves the unvisited rest at
    once, so a dense group is used up by its first few points.
    """
    edges: list[tuple[int, int]] = []
    counts = segment_popcounts(fps)
    rest = {s: np.flatnonzero(side == s) for s in (0, 1)} if side is not None else {0: np.arange(len(fps))}
    for seed in range(len(fps)):
        own = int(side[seed]) if side is not None else 0
        at = np.searchsorted(rest[own], seed)
        if at >= len(rest[own]) or rest[own][at] != seed:
            continue
        rest[own] = np.delete(rest[own], at)
        queue = [seed]
        while queue:
            p = queue.pop()
            other = 1 - int(side[p]) if side is not None else 0
            left = rest[other]
            if not len(left):
                continue
            hit = _near(fps[p], counts[p], fps[left], counts[left], limit)
            if len(hit):
                found = left[hit]
                edges += [(p, int(q)) for q in found]
                queue += found.tolist()
                rest[other] = np.delete(left, hit)
    return edges


def _cell_links(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, limit: int) -> np.ndarray:
    """Links within runs of equal keys (keys sorted), as an (n, 2) array of fingerprints."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    sizes = ends - starts
    out = []
    small = sizes <= SMALL_CELL
    size_of = np.repeat(np.where(small, sizes, 0), sizes)
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    counts = segment_popcounts(fps)
    for step in range(1, int(sizes[small].max(initial=1))):
        a = np.flatnonzero(place + step < size_of)
        b = a + step
        a, b = a[sides[a] < 2], b[sides[a] < 2]
        bound = np.abs(counts[a].astype(np.int8) - counts[b].astype(np.int8)).sum(1)
        a, b = a[bound <= limit], b[bound <= limit]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= limit
        out.append(np.stack([fps[a][linked], fps[b][linked]], 1))
    for s, e in zip(starts[~small], ends[~small]):
        side = sides[s:e]
        two = side if side.any() else None
        found = _forest(fps[s:e], two, limit)
        if found:
            out.append(fps[s:e][np.array(found)])
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def near_links(prints: DataFrame, max_distance: int = 4, cell_rows: int = CELL_ROWS, agree: int | None = None) -> DataFrame:
    """Links (u < v) that connect exactly what all links within ``max_distance`` connect.

    ``prints`` has distinct fingerprints in column fp; their number sets ``agree``, the blocks of a grid.
    """
    agree = agreeing_blocks(prints.count(), max_distance) if agree is None else agree
    grids = math.comb(max_distance + agree, agree)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            cells = grid_cells(np.ascontiguousarray(fps).view(np.uint64), max_distance, agree)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel()), pa.array(np.repeat(fps, grids))], ["cell", "fp"]
            )

    spark = prints.sparkSession
    keyed = prints.select("fp").mapInArrow(spread, "cell long, fp long")
    keyed = stage_table(keyed, "simhash-cells")
    # Cells past cell_rows are rare; their keys, a bounded list, decide on chunking.
    large = keyed.groupBy("cell").count().filter(F.col("count") > cell_rows)
    chunks = F.ceil(F.col("count") / F.lit(cell_rows)).cast("int")
    large = large.select("cell", chunks.alias("n"))
    if large.isEmpty():
        parts = keyed.select("cell", "fp", F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("side"))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        joined = keyed.join(large, "cell", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        joined = joined.withColumn("mine", mine)
        # The chunk pairs (c1, c2), c1 <= c2, that this row's chunk takes part in.
        joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        parts = joined.select(
            "cell",
            "fp",
            F.least("mine", "other").alias("c1"),
            F.greatest("mine", "other").alias("c2"),
            (F.col("mine") > F.col("other")).cast("int").alias("side"),
        )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def solve(columns):
            cell, fps, c1, c2, side = columns
            new = (np.diff(cell) != 0) | (np.diff(c1) != 0) | (np.diff(c2) != 0)
            keys = np.concatenate([[0], np.cumsum(new)])
            # Between two chunks only links across count: each chunk is compared with itself elsewhere.
            across = c1 != c2
            found = _cell_links(keys, fps.view(np.uint64), np.where(across, side, 0), max_distance)
            found = found.view(np.int64)
            u, v = found.min(1), found.max(1)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGES)

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if len(held[0]) < 2:
                continue
            changed = (np.diff(held[0]) != 0) | (np.diff(held[2]) != 0) | (np.diff(held[3]) != 0)
            last = np.flatnonzero(changed)
            if not len(last):
                continue
            cut = int(last[-1]) + 1
            yield solve([np.ascontiguousarray(h[:cut]) for h in held])
            held = [h[cut:] for h in held]
        if len(held[0]):
            yield solve([np.ascontiguousarray(h) for h in held])

    parts = parts.withColumns({c: F.col(c).cast("long") for c in ("c1", "c2", "side")})
    sorted_parts = parts.repartition("cell", "c1", "c2").sortWithinPartitions("cell", "c1", "c2", "fp")
    return sorted_parts.mapInArrow(link, "u long, v long").filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u < v) are stars: no v has two edges or is the u of another."""
    sides = edges.select(F.col("v").alias("node"), F.lit(1).alias("below")).unionAll(edges.select("u", F.lit(0)).distinct())
    roles = sides.groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n"))
    return roles.filter("below > 1 or (below = 1 and n > 1)").isEmpty()


def components(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``edges`` (u, v).

    Large-star then small-star until every edge runs from its component's
    smallest node; minima are taken by aggregation and joined back, so that a
    node of many edges is never gathered.
    """
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    edges = stage_table(edges, "cc")
    for _ in range(rounds):
        if _settled(edges):
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v")
        edges = large.filter("u <> v").distinct()
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        small = edges.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        edges = stage_table(small.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "cc")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4
) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    prints = stage_table(fingerprints(docs, id_col, text_col, width), "simhash")
    members = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-members")
    links = near_links(members, max_distance)
    rooted = components(links)
    labelled = members.join(rooted, members.fp == rooted.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    lowest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = labelled.join(lowest, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(_shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), width))


def part_cells(hashes: np.ndarray) -> np.ndarray:
    """The grid cells, as signed 64-bit keys, of a shingle set's parts."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    bits = None
    out = []
    low = max(1, (len(hashes) // PART_SHINGLES).bit_length() - 1)
    for level in (low, low + 1):
        rounds = max(1, PARTS >> level)
        salts = np.arange(rounds, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)
        mixed = (hashes ^ salts) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        part = (mixed >> np.uint64(64 - level)).astype(np.int64)
        turn, at = np.nonzero(part < PARTS)
        group = turn * PARTS + part[turn, at]
        order = np.argsort(group, kind="stable")
        group, at = group[order], at[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        if not len(starts):
            continue
        octets = hashes[at].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        sizes = np.diff(np.append(starts, len(group)))
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        prints = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        # At distance 0 there is one grid, of all segments; the key holds the part's name and its cell.
        cell = grid_cells(prints, 0)[:, 0].view(np.uint64)
        name = (group[starts] + (level << 20)).astype(np.uint64)
        key = (cell ^ (name * np.uint64(0xA24BAED4963EE407))) * np.uint64(0x9FB21C651E98DF25)
        out.append(key ^ (key >> np.uint64(32)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _similar(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links within one cell, breadth first: exact Jaccard similarity of the sets."""
    over, under = SIMILARITY
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), bool)
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(nodes))
    flat, starts = codes, np.cumsum(sizes) - sizes
    queue: list[int] = []
    left = np.ones(len(nodes), bool)

    def take(gone: np.ndarray) -> None:
        nonlocal rest, flat, starts
        keep = ~np.isin(rest, gone)
        flat = flat[np.repeat(keep, sizes[rest])]
        rest = rest[keep]
        left[gone] = False
        starts = np.cumsum(sizes[rest]) - sizes[rest]

    for seed in range(len(nodes)):
        if not left[seed]:
            continue
        take(np.array([seed]))
        queue.append(seed)
        while queue and len(rest):
            p = queue.pop()
            mark[parts[p]] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[parts[p]] = False
            hit = rest[under * shared >= over * (sizes[p] + sizes[rest] - shared)]
            if len(hit):
                edges += [(int(nodes[p]), int(nodes[q])) for q in hit]
                queue += hit.tolist()
                take(hit)
        queue.clear()
    return edges


def _compare_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every cell; rows are (bucket, c1, c2, node, hashes) in order of cell and chunks."""

    def solve(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = np.array(_similar(np.array(nodes, np.int64), sets) or np.zeros((0, 2)), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], schema=_EDGES)

    at, nodes, sets = None, [], []
    for batch in batches:
        for *key, node, data in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at:
                if len(nodes) > 1:
                    yield solve(nodes, sets)
                at, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(np.frombuffer(data, np.uint64))
    if len(nodes) > 1:
        yield solve(nodes, sets)


def similar_links(sketched: DataFrame, rows: DataFrame, row_col: str, text_col: str, width: int, bucket_nodes: int) -> DataFrame:
    """Links (u < v) that connect what all links at ``SIMILARITY`` connect.

    ``sketched`` has node, row and cells of the texts to compare; their texts are in ``rows``.
    """
    celled = sketched.select("node", F.explode("cells").alias("bucket"))
    shared = celled.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"))
    # Cells with the same members are compared once.
    shared = shared.filter("n > 1").groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    chunks = F.ceil(F.col("n") / F.lit(bucket_nodes)).cast("int")
    inside = stage_table(celled.join(shared.select("bucket", chunks.alias("n")), "bucket"), "similar-buckets")
    wanted = inside.select("node").distinct().join(sketched.select("node", "row"), "node")
    wanted = stage_table(wanted, "similar-nodes")
    texts = rows.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).join(wanted, "row").select("node", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = pa.array([shingle_set(t.as_py(), width).tobytes() for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "hashes"])

    sets = stage_table(texts.mapInArrow(hashed, "node long, hashes binary"), "similar-sets")
    # A cell of n chunks is compared as every two of them; one chunk alone with itself.
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    parts = inside.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    parts = parts.filter("n = 1 OR mine <> other").select(
        "bucket", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), "node"
    )
    dealt = parts.join(sets, "node").select("bucket", "c1", "c2", "node", "hashes")
    dealt = dealt.repartition("bucket", "c1", "c2").sortWithinPartitions("bucket", "c1", "c2", "node")
    return dealt.mapInArrow(_compare_sets, "u long, v long").distinct()


def similar_representatives(
    rows: DataFrame, id_col: str, row_col: str, text_col: str = "text", width: int = 5, bucket_nodes: int | None = None
) -> DataFrame:
    """The key (column ``row_col``) of the first row, by id, of every group of similar texts; null ids come last."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
                digests = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string())
                cells = pa.array([part_cells(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digests, cells], ["id", "row", "digest", "cells"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, row_col)]
    given = rows.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    sketched = given.mapInArrow(sketch, f"id {kinds[0]}, row {kinds[1]}, digest string, cells array<bigint>")
    # Nodes are numbered in the pass that writes them.
    sketched = stage_table(sketched.withColumn("node", F.monotonically_increasing_id()), "similar")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "node", "row")
    firsts = stage_table(sketched.groupBy("digest").agg(F.min(first).alias("first")).select("first", F.col("first.node").alias("node")), "similar-firsts")
    nodes = sketched.select("node", "row", "cells").join(firsts.select("node"), "node", "left_semi")
    rooted = components(similar_links(nodes, rows, row_col, text_col, width, bucket_nodes or BUCKET_NODES))
    labelled = firsts.join(rooted, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("first"))
    return lowest.select(F.col("first.row").alias(row_col))
