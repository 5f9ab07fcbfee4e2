"""Exact search, near-duplicates, packing and the pipeline against brute force."""

import collections
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from measurelake.llm import common, langid, packing, pii, queries, simhash, voronoi_knn

SF = "/root/testdata/sf0.01"


# --- exact search


def brute_knn(rows, k, div):
    used = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)]
    out = set()
    for q in {i for i, _ in used if i % div == 0}:
        found = []
        for i, v in used:
            if i == q:
                found += [(-max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, w)))), j) for j, w in used if j != q]
        out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("options", [{}, {"pivots": 7, "slice_rows": 40, "slice_queries": 2}])
def test_knn_table(spark, options):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {tuple(r) for r in voronoi_knn.knn_join(df, F.col("vec_id") % 50 == 0, **options).collect()}
    assert got == brute_knn([(r.vec_id, r.embedding) for r in df.collect()], 5, 50)
    if not options:
        assert got == {tuple(r) for r in queries.op2_voronoi_knn(spark, SF).select("query_id", "rank", "vec_id", "score").collect()}


def test_knn_cases(spark):
    rows = [(i, [float(i % 3), 1.0, -2.5]) for i in range(30)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf")]), (150, []), (200, [1e30, 1.0, 2.0]), (250, [1.0]), (300, [-1e30, 3.0]), (None, [1.0, 1.0])]
    schema = "vec_id long, embedding array<float>, cell int, d string, v int"
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], schema)
    got = {tuple(r) for r in voronoi_knn.knn_join(df, F.col("vec_id") % 50 == 0, pivots=4, slice_rows=5).collect()}
    assert got == brute_knn(rows, 5, 50)
    assert voronoi_knn.knn_join(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = df.filter("vec_id = 0")
    assert voronoi_knn.knn_join(one, F.col("vec_id") % 50 == 0).count() == 0
    assert voronoi_knn.knn_join(df, F.col("vec_id") < 0).count() == 0


def test_knn_many_copies(spark):
    rng = np.random.default_rng(0)
    vectors = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(300, 8))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in voronoi_knn.knn_join(df, F.col("vec_id") % 20 == 0, pivots=6, slice_rows=64, slice_queries=4).collect()}
    assert got == brute_knn(rows, 5, 20)


# --- near-duplicates


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[a : a + width]) for a in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, limit=4):
    unique = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(unique)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(unique)):
        for j in np.flatnonzero(np.bitwise_count(unique[i + 1 :] ^ unique[i]) <= limit):
            parent[find(i)] = find(i + 1 + int(j))
    root = {int(p): find(i) for i, p in enumerate(unique)}
    least = {}
    for d, p in zip(ids, prints):
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    return [least.get(root[p]) for p in prints]


def test_near_duplicates_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_simhash(spark, SF).orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    prints = [brute_fingerprint(docs[d]) for d in ids]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == brute_components(ids, prints)
    assert len(set(ids)) > len({r.component_id for r in rows})


def test_near_duplicates_cases(spark):
    rows = [(5, None), (3, ""), (7, " \t"), (1, "a b c"), (2, "A  B\x0bc"), (2, "a b c"), (None, "z z z z z"), (9, "É é x y z w"), (4, "word " * 60_000), (8, "word " * 59_999)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, fp int, cell string")
    got = simhash.near_duplicates(df).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([d for d, _ in rows], prints)
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=key) == sorted(zip([d for d, _ in rows], prints, want), key=key)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 60])
def test_links_of_dense_groups(spark, cell_rows):
    """Clouds of close fingerprints, with chains between them; small chunks force the chunked comparison."""
    rng = np.random.default_rng(5)
    bits = lambda n: np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False)])
    prints = []
    for _ in range(4):
        centre = rng.integers(0, 2**63, dtype=np.uint64)
        prints += [centre ^ bits(rng.integers(1, 4)) for _ in range(250)]
        for _ in range(20):
            centre = centre ^ bits(4)
            prints.append(centre)
    prints = sorted({int(p) for p in prints} | {int(x) for x in rng.integers(0, 2**63, 200)})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    links = simhash.near_links(df, 4, cell_rows)
    assert links.count() < 40 * len(prints)
    rooted = {r.node: r.root for r in simhash.components(links).collect()}
    label = [rooted.get(int(np.uint64(p).view(np.int64)), int(np.uint64(p).view(np.int64))) for p in prints]
    want = brute_components(list(range(len(prints))), prints)
    assert len(set(label)) == len(set(want)) == len(set(zip(label, want)))


@pytest.mark.parametrize("agree", [2, 3, 4, 6])
def test_links_with_any_number_of_blocks(spark, agree):
    """Every number of agreeing blocks finds what comparing all pairs finds, at the limit of four bits too."""
    rng = np.random.default_rng(agree)
    base = rng.integers(0, 2**63, 40, np.uint64)
    flipped = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base for k in (1, 4, 5)]
    prints = sorted({*map(int, base), *flipped})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    rooted = {r.node: r.root for r in simhash.components(simhash.near_links(df, 4, agree=agree)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want = brute_components(list(range(len(prints))), prints)
    groups = collections.defaultdict(list)
    for fp, c in zip(signed, want):
        groups[c].append(fp)
    assert [rooted.get(fp, fp) for fp in signed] == [min(groups[c]) for c in want]


def test_blocks_grow_with_the_table():
    sizes = [simhash.agreeing_blocks(n, 4) for n in (0, 1, 10**5, 10**6, 10**8, 10**10, 10**12)]
    assert sizes[:4] == [2] * 4 and sizes == sorted(sizes) and sizes[4] > 2
    fps = np.random.default_rng(0).integers(0, 2**63, 100, np.uint64)
    for agree in range(2, simhash.MOST_AGREEING + 1):
        cells = simhash.grid_cells(fps, 4, agree)
        assert (cells >= 0).all() and len(np.unique(cells)) > 50 * cells.shape[1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100}
    assert simhash.components(edges.limit(0)).count() == 0


# --- packing


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check_packing(rows, ids_of):
    """Round trip: every id in exactly one piece, sequences gapless, at most 4096 long, little padding."""
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        at, ids = 0, ids_of[doc]
        for start, length, crc, total in sorted(own):
            assert start == at and length > 0 and total == len(ids)
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
            at += length
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        total += at
    assert padding <= 0.01 * total


def test_packing_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], brute_ids([d.text for d in docs])))
    check_packing(queries.op5_packing(spark, SF).collect(), ids)


def test_packing_cases(spark):
    odd = ["á ́b<|endoftext|>x it's  \t\x0b\x1c Σας ΣΑΣ\r\n<|startoftext|>", "", None, "  ", "it 's 's' don't x", "<|endoftext|", "İstanbul ß 漢字  x", "x" * 9000, "word " * 30_000, "I'LL you'RE 12 3.4 — “q” ½²", "a\u0085b  c"]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(odd)], "doc_id long, text string, start int, length string")
    check_packing(packing.pack_documents(df, queries.tokenizer_path()).collect(), dict(enumerate(brute_ids(odd))))
    assert packing.pack_documents(df.limit(0), queries.tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack_documents(twice, queries.tokenizer_path()).agg(F.sum("length")).first()[0] == 8


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 50)
    tokenizer = packing.WordTokenizer(queries.tokenizer_path())
    text = "The quick brown fox, it's fine. " * 40
    assert list(tokenizer.encode_long(text)) == brute_ids([text])[0][:-1]


@pytest.mark.parametrize("n", [1, 39, 40, 41, 63, 100, 819, 820, 1365, 2000, 2048, 3000, 4095, 4096, 4097, 10_000])
def test_harmonic_cuts(n):
    cuts = packing.harmonic_cuts(n, 4096, 40)
    assert sum(cuts) == n and all(c > 0 and 4096 - (4096 // c) * c <= 40 for c in cuts)


# --- pipeline


def test_pipeline_stages(spark):
    """Each stage's decisions against brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"row": F.lit(1), "spans": F.lit("s"), "score": F.lit(2.0)})
    columns = docs.columns
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, inputs[-1], SF)
        assert out.columns == columns, name
        inputs.append(common.stage_table(out, "test"))
    frames = [{r.doc_id: r for r in x.collect()} for x in inputs]
    assert len(frames[1]) >= 0.99 * len(frames[0])
    from .test_shingles import brute_kept

    assert set(frames[2]) == brute_kept([(d, r.text) for d, r in frames[1].items()])
    from .test_text_operators import brute_contamination, brute_spans

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination([(d, r.text) for d, r in frames[2].items()], items) if r[5]}
    assert set(frames[3]) == set(frames[2]) - bad and bad
    assert set(frames[4]) == set(frames[3])
    changed = 0
    for d, r in frames[4].items():
        before = frames[3][d].text
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if brute_spans(before):
            changed += 1
            assert r.text != before
    assert changed
    last = corpus_pipeline.STAGES[-1][1](spark, inputs[-1], SF).collect()
    order = sorted(frames[4])
    check_packing(last, dict(zip(order, brute_ids([frames[4][d].text for d in order]))))


def test_pipeline_clashing_columns(spark):
    """Columns under names that the stages use inside come through with their values."""
    names = ["row", "row_key", "__row", "__lang", "lang_found", "lang_score", "found_spans", "found_row", "spans", "node", "a.b", "first", "P"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).drop("n_chars")
    docs = common.stage_table(base.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names]), "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = common.stage_table(out, "clash")
    rows = docs.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_rows_keep_their_keys(spark):
    """Keys do not depend on how files are packed into partitions."""
    table = common.stage_table(spark.range(1000).repartition(40), "keys")
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    seen = []
    for n in (1, 7, 40):
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        seen.append({(r.id, r.k) for r in common.with_rows(table.filter("id > 3"), "k").collect()})
    spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)
    assert seen[0] == seen[1] == seen[2] and len({k for _, k in seen[0]}) == 996
    numbered = common.with_rows(table.groupBy("id").count(), "k")
    assert numbered.select("k").distinct().count() == 1000


def test_pipeline_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "the and of with that this in", "en", None, None), (7_000_001, None, None, None, None), (7_000_002, "", "en", "s", 0)], base.schema)
    rows = base.unionByName(odd).unionByName(base.limit(3))
    docs = common.stage_table(rows, "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage_table(stage(spark, docs, SF), "odd")
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and 7_000_001 not in ids
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_knn_sizes():
    """Products are exact whatever the width: sums past 2^53 go another way."""
    rng = np.random.default_rng(1)
    for width, top in ((4096, 2**21), (3000, 2**26), (5, 2**40)):
        q, x = rng.integers(-top, top, (3, width)).astype(float), rng.integers(top // 2, top, (4, width)).astype(float)
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, c)))) for c in x] for r in q]
        assert voronoi_knn._scores(q, x).tolist() == want
