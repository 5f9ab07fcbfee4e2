"""Ranked lexical search over a two-level quantised index.

`build_index` cuts documents into blocks and writes, in one pass and without a
shuffle, a row per block and term: the documents that hold it, its counts in
them (second level) and its impacts as bytes rounded upwards (first level).
The levels are columns of one table, so a search that needs bounds reads bytes
alone.  An impact is what a term adds to a score for each unit of its weight.

`search` ranks all documents for each query:

1. document frequencies of the queries' terms, from the index;
2. per block, bytes times weights bound every document's score from above and,
   one step of a byte lower, from below; a task passes on what reaches the kth
   lower bound that it has seen;
3. of these, every document whose upper bound reaches the kth lower bound of
   all is scored again from the counts, in whole numbers.

Queries are taken in panels of a bounded size, whose terms and weights are
known to every task; documents never leave their block.

Defined cases: a null text has no terms; queries without terms and documents
that score nothing are in no result; rows with the same query id are one query
with the terms of all; repeated documents are ranked once each, equal scores by
ascending id, null ids last; an empty table on either side gives no rows.  Of
documents with one text in a block only the k of smallest id can be among the k
best, so the others need no bound.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import ascii_lower, stage_table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_DOCS = 4096
BLOCK_BYTES = 8_000_000
#: The queries of a panel, and the bytes of their terms (one query may have more).
PANEL_QUERIES = 512
PANEL_BYTES = 8_000_000
#: If no more blocks than these hold candidates, the others are left out before the shuffle.
KNOWN_BLOCKS = 200_000
#: Impacts are parts of this.
FULL = 1_000_000
STEPS = 255

_LETTERS = np.zeros(256, np.uint8)  # what a byte is within a term; 0 parts terms
_LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, mapped by `_LETTERS`, and where each begins."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return _LETTERS[data], at - at[0]


def _begins(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where terms begin."""
    begins = data != 0
    inner = begins[:-1].copy()
    heads = at[1:-1]
    inner[heads[(heads > 0) & (heads < len(data))] - 1] = False
    begins[1:] &= ~inner
    return np.flatnonzero(begins)


def lengths(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text."""
    data, at = _bytes_of(texts)
    return np.diff(np.searchsorted(_begins(data, at), at))


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, and for every occurrence its term and its text."""
    data, at = _bytes_of(texts)
    begins = _begins(data, at)
    kept = data != 0
    before = np.concatenate([[0], np.cumsum(kept)])
    offsets = np.append(before[begins], before[-1])
    flat = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[kept]))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(at, begins, "right") - 1


@dataclass(frozen=True)
class Index:
    """Rows of terms and, with a null term, of a block's documents; N documents with a term, L terms in all."""

    rows: DataFrame
    n_docs: int
    n_terms: int


_INDEX = "block long, term string, df int, docs array<int>, impact binary, tf array<int>, ids array<long>, lengths array<int>, twins array<int>"
_INTS = pa.list_(pa.int32())
_INDEX_ARROW = pa.schema(
    [("block", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("docs", _INTS), ("impact", pa.binary()), ("tf", _INTS)]
    + [("ids", pa.list_(pa.int64())), ("lengths", _INTS), ("twins", _INTS)]
)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term with ``tf`` occurrences in a document of ``n`` terms adds for each unit of its weight, of `FULL`."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _block(block: int, ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    names, term, doc = _terms(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    pairs, tf = np.unique(term.astype(np.int64) * len(texts) + doc, return_counts=True)
    at, doc = pairs // len(texts), pairs % len(texts)
    u = (impacts(tf, n[doc], n_docs, n_terms) * STEPS + FULL - 1) // FULL if len(tf) else tf
    begins = np.searchsorted(at, np.arange(len(names) + 1)).astype(np.int32)
    flat_bytes = pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(begins), pa.py_buffer(u.astype(np.uint8))])

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(begins), pa.array(values.astype(np.int32)))

    rows, none = len(names), pa.nulls(len(names), _INTS)
    columns = [pa.array(np.full(rows, block)), names.cast(pa.string()), pa.array(np.diff(begins)), lists(doc), flat_bytes, lists(tf), pa.nulls(rows, pa.list_(pa.int64())), none, none]
    whole = pa.RecordBatch.from_arrays(columns, schema=_INDEX_ARROW)
    for a in range(0, rows, 8192):
        yield whole.slice(a, 8192)
    twins = pc.fill_null(texts, "").dictionary_encode().indices
    own = [[block], [None], [None], [None], [None], [None], [ids.to_pylist()], [n.astype(np.int32)], [twins.to_numpy()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(own, _INDEX_ARROW)], schema=_INDEX_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all documents; the table lies in the shared folder."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = lengths(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])

    total = given.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        held, size = [], 0

        def told():
            both = pa.Table.from_batches(held).combine_chunks()
            ids, texts = (both.column(i).chunk(0) for i in (0, 1))
            return _block(block, ids, texts, n_docs, n_terms)

        for batch in batches:
            bytes_of = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            a = 0
            while a < batch.num_rows:
                room = np.searchsorted(np.cumsum(bytes_of[a:]), BLOCK_BYTES - size, "right")
                full = sum(h.num_rows for h in held)
                take = int(min(room, BLOCK_DOCS - full, batch.num_rows - a)) or (0 if held else 1)
                if take:
                    held.append(batch.slice(a, take))
                    size += int(bytes_of[a : a + take].sum())
                    a += take
                if a < batch.num_rows:
                    yield from told()
                    held, size, block = [], 0, block + 1
        if held:
            yield from told()

    return Index(stage_table(given.mapInArrow(build, _INDEX), "ranked-index"), n_docs, n_terms)


# --- search


class _Panel:
    """Some queries, the weights of their terms and which query holds which term; sent to every task."""

    def __init__(self, pairs: list[tuple[object, str]]):
        self.queries = list(dict.fromkeys(q for q, _ in pairs))
        self.terms = list(dict.fromkeys(t for _, t in pairs))
        number = {q: i for i, q in enumerate(self.queries)}
        place = {t: i for i, t in enumerate(self.terms)}
        held: list[list[int]] = [[] for _ in self.terms]
        for q, t in pairs:
            held[place[t]].append(number[q])
        self.held = [np.array(h) for h in held]
        self.weights = np.zeros(len(self.terms), np.int64)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block together; they come in order of block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if held and held[-1].column(0)[0].as_py() != int(block[a]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _about(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """A block's ids, lengths and twins, from its row with a null term (term -1 here)."""
    own = table.filter(pc.equal(table.column("t"), -1)).slice(0, 1)
    return own.column("ids")[0].as_py(), np.array(own.column("lengths")[0].values), np.array(own.column("twins")[0].values)


_FOUND = "block long, query int, doc int, upper long, lower long"
_FOUND_ARROW = pa.schema([("block", pa.int64()), ("query", pa.int32()), ("doc", pa.int32()), ("upper", pa.int64()), ("lower", pa.int64())])


def _rank_among_twins(ids: list, twins: np.ndarray) -> np.ndarray:
    """How many documents of the same text and a smaller id a block has, for each of its documents."""
    key = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
    order = np.lexsort((np.arange(len(ids)), key, twins))
    same = twins[order]
    begins = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
    return rank


def _bounded(batches: Iterator[pa.RecordBatch], panel: _Panel, k: int) -> Iterator[pa.RecordBatch]:
    """First level: what may be among the k best, with bounds in weight times steps."""
    best = np.zeros((len(panel.queries), k), np.int64)
    for table in _by_block(batches):
        ids, n, twins = _about(table)
        wanted = _rank_among_twins(ids, twins) < k
        upper = np.zeros((len(panel.queries), len(ids)), np.int64)
        lower = np.zeros_like(upper)
        terms = table.filter(pc.greater_equal(table.column("t"), 0)).combine_chunks()
        for t, docs, impact in zip(terms.column("t").to_pylist(), terms.column("docs"), terms.column("impact")):
            docs, u = np.asarray(docs.values), np.frombuffer(impact.as_buffer(), np.uint8).astype(np.int64)
            where = np.ix_(panel.held[t], docs)
            upper[where] += panel.weights[t] * u
            lower[where] += panel.weights[t] * np.maximum(u - 1, 0)
        upper[:, ~wanted] = 0
        lower[:, ~wanted] = 0
        both = np.concatenate([best, lower], axis=1)
        best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        query, doc = np.nonzero((upper > 0) & (upper >= best.min(axis=1, keepdims=True)))
        block = table.column(0)[0].as_py()
        columns = [np.full(len(query), block), query.astype(np.int32), doc.astype(np.int32), upper[query, doc], lower[query, doc]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_FOUND_ARROW)


_SCORED = "query int, id long, score long, block long, doc int"
_SCORED_ARROW = pa.schema([("query", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("block", pa.int64()), ("doc", pa.int32())])


def _rescored(batches: Iterator[pa.RecordBatch], panel: _Panel, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """Second level: exact scores of the candidates of each block."""
    for table in _by_block(batches):
        asked = table.filter(pc.equal(table.column("t"), -2))
        if not asked.num_rows:
            continue
        ids, n, _ = _about(table)
        query, doc = (asked.column(c).to_numpy() for c in ("query", "doc"))
        chosen = np.unique(doc)
        place = np.full(len(ids), -1)
        place[chosen] = np.arange(len(chosen))
        score = np.zeros((len(panel.queries), len(chosen)), np.int64)
        terms = table.filter(pc.greater_equal(table.column("t"), 0)).combine_chunks()
        for t, docs, tf in zip(terms.column("t").to_pylist(), terms.column("docs"), terms.column("tf")):
            docs, tf = np.asarray(docs.values), np.asarray(tf.values).astype(np.int64)
            here = place[docs] >= 0
            docs = docs[here]
            if len(docs):
                score[np.ix_(panel.held[t], place[docs])] += panel.weights[t] * impacts(tf[here], n[docs].astype(np.int64), n_docs, n_terms)
        total = score[query, place[doc]]
        named = pa.array(ids, pa.int64()).take(pa.array(doc))
        columns = [pa.array(query), named, pa.array(total), pa.array(np.full(len(doc), table.column(0)[0].as_py())), pa.array(doc)]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCORED_ARROW).filter(pc.greater(columns[2], 0))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (query, term)."""
    terms = F.regexp_extract_all(ascii_lower(F.col(f"`{text_col}`")), F.lit(TERM), F.lit(0))
    return queries.select(F.col(f"`{id_col}`").alias("query_id"), F.explode(terms).alias("term")).distinct()


def _search_panel(index: Index, pairs: DataFrame, k: int) -> DataFrame | None:
    spark = index.rows.sparkSession
    panel = _Panel([tuple(r) for r in pairs.collect()])
    if not panel.terms or not index.n_terms:
        return None
    numbered = spark.createDataFrame(list(enumerate(panel.terms)), "t int, term string")
    own = index.rows.filter("term IS NULL").withColumn("t", F.lit(-1))
    held = index.rows.join(F.broadcast(numbered), "term")  # a panel's terms are bounded
    counts = held.groupBy("t").agg(F.sum("df").alias("df")).collect()
    for t, df in counts:
        panel.weights[t] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1)))

    about = ["ids", "lengths", "twins"]
    first = ["block", "t", "docs", "impact", *about]
    dealt = held.select(first).unionByName(own.select(first)).repartition("block").sortWithinPartitions("block", "t")
    found = dealt.mapInArrow(lambda batches: _bounded(batches, panel, k), _FOUND)
    found = stage_table(found, "ranked-candidates")
    by_lower = Window.partitionBy("query").orderBy(F.desc("lower"))
    reached = found.withColumn("n", F.row_number().over(by_lower)).filter(F.col("n") <= k)
    reached = reached.groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("least"))
    kept = found.join(F.broadcast(reached), "query").filter("upper >= least")  # a row a query of the panel

    asked = kept.select("block", F.lit(-2).alias("t"), "query", "doc")
    second = ["block", "t", "docs", "tf", *about]
    level = held.select(second).unionByName(own.select(second))
    blocks = kept.select("block").distinct()
    if blocks.count() <= KNOWN_BLOCKS:
        level = level.join(F.broadcast(blocks), "block", "left_semi")
    dealt = level.unionByName(asked, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "t")
    n_docs, n_terms = index.n_docs, index.n_terms
    scored = dealt.mapInArrow(lambda batches: _rescored(batches, panel, n_docs, n_terms), _SCORED)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "doc")
    best = scored.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(panel.queries)), f"query int, query_id {pairs.schema['query_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "query").select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query: query_id, rank, doc_id, score."""
    spark = index.rows.sparkSession
    pairs = query_terms(queries, id_col, text_col)
    size = pairs.agg(F.count_distinct("query_id"), F.sum(F.octet_length("term"))).first()
    panels = max(1, math.ceil((size[0] or 0) / PANEL_QUERIES), math.ceil((size[1] or 0) / PANEL_BYTES))
    panel_of = F.pmod(F.xxhash64("query_id"), F.lit(panels))
    found = [_search_panel(index, pairs.filter(panel_of == p) if panels > 1 else pairs, k) for p in range(panels)]
    found = [f for f in found if f is not None]
    if not found:
        kind = queries.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OF = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')"

#: Every document against every item.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, {_OF} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
i AS (SELECT DISTINCT item_id, unnest({_OF}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
r AS (SELECT item_id, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN f USING (term), s GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""
