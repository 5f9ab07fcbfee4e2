"""Language ID, the class language model and the quality network."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelake.llm import brown_lm, common, langid, quality_cnn, queries

SF = "/root/testdata/sf0.01"


def crc(doc, n):
    return zlib.crc32(str("" if doc is None else doc).encode()) % n


def test_language_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    assert len(rows) == len(docs) and all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert np.mean([r.score >= langid.REJECT for r in rows]) > 0.99 and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score string"
    rows = [(1, None, "en", "x", "y"), (2, "", "de", "x", "y"), (3, "123 ...", "en", "x", "y"), (4, "the and of", None, "x", "y"), (None, "der die das", "de", "x", "y"), (5, "the cat " * 200_000, "en", "x", "y"), (5, "the cat", "en", "x", "y"), (6, "the cat sat", "en", "x", "y")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.lang_pred) for r in langid.languages_of(df).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en")} <= got
    assert langid.languages_of(df.limit(0)).count() == 0
    nothing = langid.languages_of(df.filter("lang is null"))
    assert [(r.lang_pred, r.score) for r in nothing.collect()] == [("und", 0.0)]
    kept = langid.identify(df, langid.train(df), out=("a", "b"))
    assert kept.columns == [*df.columns, "a", "b"] and {r.score for r in kept.collect()} == {"y"}


def test_kneser_ney_sums_to_one():
    """After every context the probabilities of all symbols, seen or not, add to one."""
    import pandas as pd

    texts = ["abracadabra", "banana bandana"]
    symbols, counts = langid.normalise(texts)
    unique, n = np.unique(langid.grams(symbols, counts), return_counts=True)
    model = langid.KneserNey(pd.DataFrame({"lang": "x", "gram": unique.view(np.int64), "n": n}))
    known = np.unique(symbols)
    for context in ("abr", "ana", "zzz", " ba"):
        base = np.uint64(0)
        for c in context:
            base = (base << np.uint64(16)) | np.uint64(ord(c))
        packed = (base << np.uint64(16)) | np.append(known, np.uint64(0x4E00))
        assert np.exp(model._backed_off(packed, 4)).sum() == pytest.approx(1.0, abs=1e-5)


def brute_entropy(train, text):
    """Interpolated Kneser-Ney 4-grams from the definition: nats per symbol of ``text`` after ``train``."""
    line = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    tokens = lambda t: "".join(w + " " for w in line(t))
    counts = [collections.Counter() for _ in range(5)]
    for t in train:
        s = "   " + tokens(t)
        counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for size in (3, 2, 1):
        counts[size].update(g[1:] for g in counts[size + 1])
    floor = 1 / (len(counts[1]) + 1)

    def p(gram):
        if not gram:
            return floor
        table = counts[len(gram)]
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
        after = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        return max(table[gram] - d, 0) / total + d * len(after) / total * p(gram[1:])

    s = "   " + tokens(text)
    return -sum(math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s))) / max(len(s) - 3, 1)


def small_model(train):
    import pandas as pd

    parts = []
    for lang, texts in train.items():
        symbols, counts = langid.normalise(texts)
        unique, n = np.unique(langid.grams(symbols, counts), return_counts=True)
        parts.append(pd.DataFrame({"lang": lang, "gram": unique.view(np.int64), "n": n}))
    return langid.KneserNey(pd.concat(parts))


TRAIN = {"x": ["Abracadabra, abra!", "cad 12 dab", ""], "y": ["banana bandana", "nab a band"]}
ASKED = ["abra", "Nana band", "", "q", " cadab-ra 7", "ban  dan", "x y z", "abracadabra " * 40]


def test_kneser_ney_brute_force():
    entropy, n = small_model({"x": TRAIN["x"]}).cross_entropy(ASKED)
    for text, e, k in zip(ASKED, entropy[:, 0], n):
        if k:
            assert e == pytest.approx(brute_entropy(TRAIN["x"], text), rel=1e-5)


def test_texts_are_scored_alone(monkeypatch):
    """The result of a text is the same, bit for bit, in any block, and when it is dealt with in portions."""
    model = small_model(TRAIN)
    alone = np.concatenate([model.cross_entropy([t])[0] for t in ASKED])
    assert (model.cross_entropy(ASKED)[0] == alone).all()
    assert (model.cross_entropy(ASKED[::-1])[0][::-1] == alone).all()
    for block in (1, 2, 5, 13):
        monkeypatch.setattr(langid, "BLOCK_CHARS", block)
        entropy, n = model.cross_entropy(ASKED)
        assert entropy == pytest.approx(alone, rel=1e-12)


def test_language_ties():
    """Equal models: the first language by name."""
    model = small_model({"b": TRAIN["x"], "a": TRAIN["x"]})
    assert langid.Identifier(model).predict(["abra", ""])[0] == ["a", "und"]


def test_languages_at_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [{(r.doc_id, r.lang_pred, r.score) for r in langid.languages_of(docs.repartition(n)).collect()} for n in (1, 8)]
    assert found[0] == found[1]


def brute_base(rows):
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, (_, t) in enumerate(rows)}
    counts = collections.Counter(w for i, (d, _) in enumerate(rows) if crc(d, 10) for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    bottom = math.log10(n + 0.1 * (v + 1))
    return sorted(
        ((d, len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, sum(math.log10(counts[w] + 0.1) - bottom for w in tokens[i])) for i, (d, _) in enumerate(rows)), key=str
    )


def same_base(got, want):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)


def test_language_model_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op6_brown_lm(spark, SF).collect()
    same_base(got, brute_base(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_cases(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "RESIDENT", 20)
    monkeypatch.setattr(brown_lm, "ITEMS", 10)
    rows = [(i, " a b" * i + f" c\x0bd É é{i % 5}") for i in range(30)] + [(31, ""), (32, "  "), (33, None), (33, None), (None, "x"), (34, "w" * 100_000), (36, "w" * 100_000), (35, "a b " * 100_000)]
    df = spark.createDataFrame([(d, t, "q", 1) for d, t in rows], "doc_id long, text string, word string, row int")
    same_base(brown_lm.scores_of(df).collect(), brute_base(rows))
    assert brown_lm.scores_of(df.limit(0)).count() == 0
    model, others = brown_lm.train(df)
    kept = brown_lm.score(df, model, others)
    assert kept.columns[:3] == ["doc_id", "word", "row"] and {r.word for r in kept.collect()} == {"q"}


def test_exchange_finds_alternation():
    """Two sets of words that always alternate end in different classes."""
    bigrams = np.zeros((7, 7))
    bigrams[:3, 3:6] = bigrams[3:6, :3] = 50
    bigrams[6, :3] = bigrams[3:6, 6] = 5
    of = brown_lm.exchange_clusters(bigrams, 3)
    assert len(set(of[:3])) == 1 and len(set(of[3:6])) == 1 and of[0] != of[3] and of[6] == 2


def known_words(model, others):
    """word: (n, class) of all training words."""
    out = {w: (int(model.counts[i]), int(model.classes[i])) for w, i in model.of.items()}
    table = {r.word: (r.n, r["class"]) for r in others.collect()}
    assert all(out.get(w, x) == x for w, x in table.items())
    return out | table


@pytest.mark.parametrize("resident", [3, 1000])
def test_class_model_is_a_distribution(spark, monkeypatch, resident):
    """Probabilities of all known words and the end after a context, with one unknown word per class, add to one."""
    monkeypatch.setattr(brown_lm, "ITEMS", 2)
    monkeypatch.setattr(brown_lm, "RESIDENT", resident)
    df = spark.createDataFrame([(i, "a b c a d e f b " * 3 + f"x{i}") for i in range(1, 9)], "doc_id long, text string")
    model, others = brown_lm.train(df)
    emission = np.full(brown_lm.CLASSES, brown_lm.ALPHA)
    for n, c in known_words(model, others).values():
        emission[c] += n + brown_lm.ALPHA
    emission = emission / 10**model.denominator
    emission[model.end_class] = 1.0
    assert 10**model.transition @ emission == pytest.approx(np.ones(brown_lm.CLASSES))


def brute_scores(train, rows, model, known):
    """Class-bigram scores from the definition, given the classes of the words."""
    words = lambda t: [w.decode("utf-8", "surrogatepass") for w in (t or "").encode("utf-8", "surrogatepass").lower().split()]
    ending = lambda w: int(model.item_classes[len(model.items.words) + brown_lm.ending(w)])
    condition = lambda w: known[w][1] if model.of.get(w, model.placed) < model.placed else ending(w)
    own = lambda w: known[w][1] if w in known else ending(w)
    size, end = brown_lm.CLASSES, model.end_class
    moves = np.zeros((size, size))
    for t in train:
        before = end
        for w in words(t):
            moves[before, own(w)] += 1
            before = condition(w)
        moves[before, end] += 1
    prior = (moves.sum(0) + 1) / (moves.sum() + size)
    transition = (moves + brown_lm.PRIOR * prior) / (moves.sum(1, keepdims=True) + brown_lm.PRIOR)
    mass = np.zeros(size)
    for n, c in known.values():
        mass[c] += n + brown_lm.ALPHA
    mass += brown_lm.ALPHA
    out = []
    for t in rows:
        before, total = end, 0.0
        for w in words(t):
            total += math.log10(transition[before, own(w)] * (known.get(w, (0,))[0] + brown_lm.ALPHA) / mass[own(w)])
            before = condition(w)
        out.append(total + math.log10(transition[before, end]))
    return out


def test_class_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "RESIDENT", 300)
    monkeypatch.setattr(brown_lm, "PLACED", 100)
    monkeypatch.setattr(brown_lm, "ITEMS", 40)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(9_000_001, None), (9_000_002, "unseen " * 5)], "doc_id long, text string")
    learn = df.filter("doc_id < 9000000 and doc_id % 3 > 0")
    model, others = brown_lm.train(learn)
    known = known_words(model, others)
    train = [r.text for r in learn.collect()]
    counts = collections.Counter(w for t in train for w in t.encode().lower().split())
    assert {w: n for w, (n, _) in known.items()} == {w.decode(): n for w, n in counts.items()}
    got = brown_lm.score(df, model, others).collect()
    want = dict(zip([r.doc_id for r in df.collect()], brute_scores(train, [r.text for r in df.collect()], model, known)))
    assert {r.doc_id: r.score for r in got} == {d: pytest.approx(x, rel=1e-9) for d, x in want.items()}


def test_best_classes_by_brute_force():
    """The class of greatest gain in the log likelihood of the class bigrams."""
    rng = np.random.default_rng(8)
    table = rng.integers(0, 40, (5, 5)).astype(float)
    f = lambda x: float(x * np.log(max(x, 1)))
    for _ in range(50):
        code = np.unique(rng.integers(0, 10, 6))
        n = rng.integers(1, 4, len(code))
        gains = []
        for c in range(4):
            sides = np.zeros(10)
            sides[code] = n
            gain = sum(f(table[:, c][j] + sides[j]) - f(table[:, c][j]) + f(table[c][j] + sides[5 + j]) - f(table[c][j]) for j in range(5))
            gain -= f(table[:, c].sum() + sides[:5].sum()) - f(table[:, c].sum()) + f(table[c].sum() + sides[5:].sum()) - f(table[c].sum())
            gains.append(gain)
        best = brown_lm.best_classes(np.zeros(len(code), np.int64), code, n, 1, table)[0]
        assert gains[best] == pytest.approx(max(gains))


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.op8_quality(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = (np.array([s for s, y in held if y == want]) for want in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.97


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "x", 3), (4, "word " * 100_000, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 1)], "doc_id long, quality int")
    got = quality_cnn.quality_of(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_cnn.quality_of(docs, labels.limit(0)).count() == 5
    assert quality_cnn.quality_of(docs.limit(0), labels).count() == 0


def test_quality_sample_is_bounded(spark, monkeypatch):
    """At most TRAIN_BYTES go to the driver, and most of that; none of a text beyond TEXT_BYTES."""
    seen = []
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 20_000)
    monkeypatch.setattr(quality_cnn, "TEXT_BYTES", 1_000)
    monkeypatch.setattr(quality_cnn.ByteCNN, "fit", lambda self, texts, labels: seen.append(texts))
    for copies in (100, 1_000):
        docs = spark.createDataFrame([(i, "x" * (10 + i % 200)) for i in range(copies)] + [(-1, "y" * 5_000)], "doc_id long, text string")
        quality_cnn.train(docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality")))
    small, large = (sum(map(len, t)) for t in seen)
    assert len(seen[0]) == 100 and 10_000 < large <= 20_000 and small < 20_000
    assert not any("y" in t for texts in seen for t in texts)


def test_quality_of_a_text_alone():
    """A text's score does not depend on the rows beside it."""
    net = quality_cnn.ByteCNN(1)
    net.weight[:] = np.random.default_rng(0).normal(size=quality_cnn.FILTERS)
    texts = ["short", None, "long text " * 50_000, "", "mid " * 300]
    assert net.score(texts) == pytest.approx([net.score([t])[0] for t in texts], abs=1e-6)


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        chunks, counts = quality_cnn.chunks_of(["a" * n])
        assert counts[0] == len(chunks)
        covered = (len(chunks) - 1) * quality_cnn.HOP + quality_cnn.CHUNK
        assert n <= covered < max(n, 1) + quality_cnn.CHUNK


def test_gradient():
    """Backward pass against finite differences."""
    net = quality_cnn.ByteCNN(1)
    net.weight[:] = np.random.default_rng(0).normal(size=quality_cnn.FILTERS)
    texts, labels = ["hello world " * 60, "§§§ %%%"], np.array([1.0, 0.0], np.float32)
    grads = net._gradients(texts, labels)

    def loss():
        p = net.score(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, at in (("weight", (3,)), ("bias", (2,)), ("filters", (5, 1)), ("embed", (ord("o"), 2))):
        value, h = getattr(net, name), 1e-2
        old = value[at]
        value[at] = old + h
        up = loss()
        value[at] = old - h
        down = loss()
        value[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * h), abs=2e-3)


def test_endings():
    words = ["a", "ab", "abc.", "é!", "...", "x\x0b", "日本語", ""]
    assert brown_lm.endings(words).tolist() == [brown_lm.ending(w) for w in words] and len(brown_lm.endings([])) == 0


# --- bounded samples


def test_sample_is_bounded(spark):
    """Strictly, whatever ids, repeats and long texts there are; nothing fits: the beginning of one text."""
    rows = [("a", 0, f"text {i}") for i in range(4000)] + [("a", 0, "text 1")] * 4000
    rows += [("b", m, "x" * 5000) for m in (0, 1)] * 50 + [("c", 0, "y" * 300 + str(i)) for i in range(3)] + [("d", 0, "")] * 9
    df = spark.createDataFrame(rows, "group string, mark int, text string")
    drawn = lambda df, *bounds, **more: common.bounded_sample(df.select("group", "mark", *common.text_keys(F.col("text"))), df, "test", *bounds, **more)
    got = {}
    for r in drawn(df, 1000).collect():
        got.setdefault(r.group, []).append(r.text)
    sizes = {g: sum(len(t) + common.SAMPLE_TEXT for t in texts) for g, texts in got.items()}
    assert all(n <= 1000 for n in sizes.values()) and sizes["a"] > 900 and sizes["c"] > 900
    assert len(set(got["a"])) == len(got["a"]) and got["d"] == [""]
    assert len(got["b"]) == 1 and set(got["b"][0]) == {"x"}
    again = {(r.group, r.text) for r in drawn(df.repartition(7), 1000).collect()}
    assert again == {(g, t) for g, texts in got.items() for t in texts}
    shared = drawn(df, 1000, total=2000).collect()
    assert sum(len(r.text) + common.SAMPLE_TEXT for r in shared) <= 2000
    assert drawn(df.limit(0), 10).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """One id 4,000 times, null ids and one huge text learn no more than the bound."""
    monkeypatch.setattr(langid, "TRAIN_CHARS", 1000)
    seen = []
    real = langid.KneserNey.__init__
    monkeypatch.setattr(langid.KneserNey, "__init__", lambda self, rows: seen.append(int(rows.n.sum())) or real(self, rows))
    for ids in ([5] * 4000, [None] * 4000):
        docs = spark.createDataFrame([(i, f"some words number {n % 977} here", "en") for n, i in enumerate(ids)], "doc_id long, text string, lang string")
        assert langid.identify(docs, langid.train(docs)).filter("lang_pred = 'en'").count() == 4000
    huge = spark.createDataFrame([(1, "the cat sat " * 20_000, "en"), (3, "der hund lag " * 20_000, "de")], "doc_id long, text string, lang string")
    langid.train(huge)
    assert len(seen) == 3 and all(0 < n <= 4 * 2 * 1100 for n in seen)


def test_quality_learns_from_whole_bins(spark, monkeypatch):
    """Forty ids of a hundred rows each: some are learned from, and the scores part the labels."""
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 50_000)
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "%$# @!% *&^ ") * 70 + str(n)) for i in range(40) for n in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scores = quality_cnn.quality_scores(docs, quality_cnn.train(docs, labels)).groupBy(F.col("doc_id") % 2).agg(F.avg("score")).collect()
    scores = dict(map(tuple, scores))
    assert scores[1] > 0.5 > scores[0]
    monkeypatch.setattr(quality_cnn, "TEXT_BYTES", 10)  # all texts are longer
    assert quality_cnn.train(docs, labels).weight.any()
