"""Pattern packing: round trips, the fit against optimum conditions, and sequences against their lower bound."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from measurelake.llm import pattern_packing as pp, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def expected(whole, text, end):
    return whole.encode(text or "", add_special_tokens=False).ids + [end]


def check(rows, texts, whole, capacity, end):
    """rows: (doc_id, piece, start, length, crc, sequence, offset[, ids]); texts: (id, text), ids distinct."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append(r)
    for doc, text in texts:
        ids = expected(whole, text, end)
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want = [(p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        own = sorted(by_doc[doc])
        assert [tuple(r[1:5]) for r in own] == want, doc
        if own and len(own[0]) > 7:
            assert [i for r in own for i in r[7]] == ids
    assert len(by_doc) == len(texts)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[3]
        assert at <= capacity
    return len(by_sequence)


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "x\n  y", "x \n y", "x\n\n y", "\n", "it's John's  ", "<|endoftext|> x", "é ñandú 日本 語", "a\xa0 b", "a　b c", "tab\t x", "1 23 4,5", "!!! ?", "emoji 🙂 x", "\x00 a\x00"]


def test_tokenizer(whole):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices(["a", "Bc", " ", " ", "\n", "  ", "é", "'s", "1", ".", "\t", "日", "\xa0", " the", "<|endoftext|>"], k=rng.randrange(0, 60))) for _ in range(1500)]
    ours = pp.ByteTokenizer(PATH)
    for _ in range(2):  # the second time from the store
        for text, ids in zip(texts, ours.encode_texts(texts)):
            assert ids.tolist() == expected(whole, text, 0)[:-1], repr(text)


def test_long_text(whole, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices(["ab", " cd", "  ", " \n", "\n ", "é", " x ", "."], k=4000))
    ours = pp.ByteTokenizer(PATH)
    want = expected(whole, text, 0)[:-1]
    for block in (50, 333, 5000):
        monkeypatch.setattr(pp, "BLOCK_CHARS", block)
        assert ours.encode_long(text).tolist() == want
    assert ours.encode_long("").tolist() == []


def test_whole_table(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [tuple(r) for r in queries.op13_pattern_packing(spark, SF).collect()]
    n = check(rows, texts, whole, 2048, 0)
    tokens = sum(r[3] for r in rows)
    assert n <= max(-(-tokens // 2048) * 1.002 + 1, sum(2 * r[3] > 2048 for r in rows))


def test_cases(spark, whole, monkeypatch):
    monkeypatch.setattr(pp, "BLOCK_CHARS", 300)
    texts = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "one two three four " * i) for i in range(40)] + [(500, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS worker", "2 AS length", "'x' AS ids", "7 AS n")
    rows = [tuple(r) for r in pp.pack_patterns(df.repartition(3), PATH, 32, 5, with_ids=True).collect()]
    check(rows, texts, whole, 32, 5)
    assert pp.pack_patterns(df.limit(0), PATH).count() == 0
    again = df.union(df).union(df.selectExpr("CAST(NULL AS long)", "text", "1", "2", "'x'", "7")).repartition(2)
    rows = pp.pack_patterns(again, PATH, 32, 5).collect()
    assert len(rows) == 3 * sum(-(-len(expected(whole, t, 5)) // 32) for _, t in texts)
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places)
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 32


def test_one_length(spark):
    df = spark.range(700).selectExpr("id AS doc_id", "'a b c' AS text")
    rows = pp.pack_patterns(df, PATH, 10, 0).collect()
    assert len({r.sequence_id for r in rows}) == 350


def test_fit_is_optimal():
    """At the optimum no used pattern has a gradient and no unused one a negative one."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 41)
    h[0] = h[40] = 0
    chosen = pp.patterns(h)
    assert (chosen.sum(axis=1) == 40).all() and len({tuple(c) for c in chosen.tolist()}) == len(chosen)
    brute = {(a, b, 40 - a - b) for a in range(41) for b in range(max(a, 1), 41) if b <= 40 - a - b and (a == 0 or h[a]) and h[b] and h[40 - a - b]}
    assert {tuple(c) for c in chosen.tolist()} == brute
    x = pp.fit(chosen, h, 20_000)
    matrix = np.zeros((41, len(chosen)))
    for p, c in enumerate(chosen):
        for n in c:
            matrix[n, p] += n > 0
    gradient = matrix.T @ (np.arange(41) / 41 * (matrix @ x - h))
    assert (x >= 0).all() and gradient.min() > -1e-3 and abs(gradient[x > 1e-6]).max() < 1e-3


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 64, 200]))
    h = np.zeros(capacity + 1, np.int64)
    n = int(rng.choice([5, 400, 20_000]))
    np.add.at(h, np.clip((rng.exponential(capacity / 3, n)).astype(int) + 1, 1, capacity), 1)
    found = pp.plan(h)
    length = np.repeat(np.arange(capacity + 1), h)
    number = np.concatenate([np.arange(c) for c in h])
    sequence, offset = found.place(length, number)
    used = np.zeros((found.sequences, capacity), int)
    for s, o, k in zip(sequence, offset, length):
        used[s, o : o + k] += 1
    assert used.max() == 1 and (used[:, :-1] >= used[:, 1:]).all() and used.sum(axis=1).min() > 0
    bound = max(-(-int(length.sum()) // capacity), int((2 * length > capacity).sum()))
    assert found.sequences <= bound * 1.01 + 1
