"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased and reduced to letters, with one space for everything
between them.  Every language gets a character 4-gram model: counts at the
highest order, continuation counts below, one absolute discount per order, and
a uniform floor.  All models share sorted hash arrays (one per order) that hold
every language's interpolated log probability and back-off weight of an n-gram;
n-grams no language has seen back off through the contexts' weights.  The
prediction is the language of the lowest cross-entropy per character.

The score is a calibrated confidence between 0 and 1: a logistic function of
the log-likelihood margin to the second-best language, times one that falls off
when the cross-entropy is far above what texts of that length in that language
have.  ``score < REJECT`` or language "und" is a rejection.

Models are learned from a bounded sample of labelled rows, in expectation
``TRAIN_CHARS`` characters per language and ``TOTAL_CHARS`` over all, chosen by
a hash of the id (labels and ids choose rows; they are never inputs of a
prediction); an eighth of it is set aside for calibration.  What reaches the
driver is the counts of all distinct 4-grams of the sample, no more than its
characters.

Defined cases: text that is null or has no letter is "und" with score 0;
rows with null lang are predicted but not learned from; with nothing to learn
from every row is "und"; a text's result depends on the text alone, so repeated
rows repeat; of languages with equal cross-entropy the first by name is taken;
letters beyond the basic plane share one symbol; texts of any length are scored
whole, in portions of ``BLOCK_CHARS`` characters that carry the n-gram context
on; input columns named like the two results are replaced, others are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, crc_mod, stage_table, text_keys

ORDER = 4
TRAIN_CHARS = 2_000_000
TOTAL_CHARS = 8_000_000
ASIDE_TEXTS = 16
REJECT = 0.05
UNKNOWN = "und"
BLOCK_CHARS = 500_000
_BITS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Code point to lower-cased letter; space for anything but letters."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.uint16)
    for point in range(0x10000):
        if (char := chr(point)).isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    for point in range(0x10000, sys.maxunicode + 1):
        if chr(point).isalpha():
            table[point] = 0xFFFF
    return table


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts - words, each followed by one space - and the number of symbols of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _letters()[points]
    keep = symbols != _SPACE
    keep[1:] |= keep[:-1] & ~keep[1:]  # of a run of spaces the first, if a letter stands before it
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[keep]
    return symbols[keep].astype(np.uint64), np.bincount(owner, minlength=len(texts))


def grams(symbols: np.ndarray, counts: np.ndarray, leads: np.ndarray | None = None, order: int = ORDER) -> np.ndarray:
    """Packed n-grams that end at each symbol.

    ``counts`` are the symbols of each text.  Before a text's first symbol stand
    spaces, or its row of ``leads``: no n-gram reaches into another text.
    """
    gap = order - 1
    place = np.arange(len(symbols)) + gap * (1 + np.repeat(np.arange(len(counts)), counts))
    padded = np.full(len(symbols) + gap * len(counts), _SPACE, np.uint64)
    padded[place] = symbols
    if leads is not None:
        starts = np.cumsum(counts) - counts + gap * np.arange(len(counts))
        padded[starts[:, None] + np.arange(gap)] = leads
    packed = np.zeros(len(symbols), np.uint64)
    for back in range(gap, -1, -1):
        packed = (packed << np.uint64(_BITS)) | padded[place - back]
    return packed


def units(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (their positions), symbols, counts and leads, in portions of about ``BLOCK_CHARS`` characters.

    Only a text beyond that is cut, at fixed places of its own, and goes on with
    the symbols before the cut: its n-grams are those of the whole text.
    """
    held: list[int] = []
    chars = 0

    def portion(at: list[int]):
        symbols, counts = normalise([texts[i] for i in at])
        return at, symbols, counts, np.full((len(at), ORDER - 1), _SPACE, np.uint64)

    for i, text in enumerate(texts):
        if len(text) <= BLOCK_CHARS:
            held.append(i)
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield portion(held)
                held, chars = [], 0
            continue
        lead = np.full(ORDER - 1, _SPACE, np.uint64)
        for cut in range(0, len(text), BLOCK_CHARS):
            symbols, counts = normalise([text[cut : cut + BLOCK_CHARS]])
            after = text[cut + BLOCK_CHARS : cut + BLOCK_CHARS + 1]
            if after and after.isalpha() and text[cut + BLOCK_CHARS - 1].isalpha():
                symbols, counts = symbols[:-1], counts - 1  # the word goes on
            yield [i], symbols, counts, lead[None]
            lead = np.concatenate([lead, symbols])[-(ORDER - 1) :]
    if held:
        yield portion(held)


@dataclass
class _Level:
    """One order's sorted hash array; a value of -inf in ``logp`` cannot occur."""

    keys: np.ndarray  # sorted hashes of packed n-grams
    logp: np.ndarray  # n-grams by languages
    context_keys: np.ndarray  # sorted hashes of packed contexts
    back_off: np.ndarray  # contexts by languages: log weight of the lower order

    @staticmethod
    def find(keys: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashed = packed * _MIX
        at = np.minimum(np.searchsorted(keys, hashed), max(len(keys) - 1, 0))
        return at, keys[at] == hashed if len(keys) else np.zeros(len(packed), bool)


class KneserNey:
    """Interpolated Kneser-Ney models of several languages over shared n-gram tables."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        """``counts`` has columns lang, gram (packed, as int64) and n."""
        self.languages = sorted(counts["lang"].unique())
        self.order = order
        code = {lang: i for i, lang in enumerate(self.languages)}
        lang = counts["lang"].map(code).to_numpy(np.int64)
        gram = counts["gram"].to_numpy(np.int64).view(np.uint64)
        n = counts["n"].to_numpy(np.float64)
        self.levels: list[_Level] = []
        symbols = len(np.unique(gram & np.uint64(0xFFFF)))
        self.floor = -np.log(symbols + 1.0)
        tables = [(lang, gram, n)]
        for size in range(order - 1, 0, -1):
            lang, gram, n = tables[-1]
            shorter = gram & np.uint64((1 << (_BITS * size)) - 1)
            # A distinct longer n-gram is one continuation of its suffix.
            pairs = pd.DataFrame({"l": lang, "g": shorter}).value_counts(sort=False).reset_index()
            tables.append((pairs["l"].to_numpy(np.int64), pairs["g"].to_numpy(np.uint64), pairs["count"].to_numpy(float)))
        for size, (lang, gram, n) in enumerate(reversed(tables), 1):
            self.levels.append(self._level(size, lang, gram, n))

    def _level(self, size: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> _Level:
        langs = len(self.languages)
        once = np.bincount(lang[n == 1], minlength=langs).astype(float)
        twice = np.bincount(lang[n == 2], minlength=langs).astype(float)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        unique, row = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(unique), langs))
        counts[row, lang] = n
        contexts, of = np.unique(unique >> np.uint64(_BITS), return_inverse=True)
        total = np.zeros((len(contexts), langs))
        kinds = np.zeros((len(contexts), langs))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        lower = np.exp(self._backed_off(unique, size - 1)) if size > 1 else np.exp(self.floor)
        seen = np.where(total[of] > 0, np.maximum(counts - discount, 0) / np.maximum(total[of], 1), 0)
        logp = np.log(seen + weight[of] * lower)
        keys, context_keys = unique * _MIX, contexts * _MIX
        order, context_order = np.argsort(keys), np.argsort(context_keys)
        return _Level(
            keys[order],
            logp[order].astype(np.float32),
            context_keys[context_order],
            np.log(weight)[context_order].astype(np.float32),
        )

    def _backed_off(self, packed: np.ndarray, size: int) -> np.ndarray:
        """Log probabilities of each n-gram's last symbol by its last ``size`` symbols."""
        if size == 0:
            return np.full((len(packed), len(self.languages)), self.floor)
        level = self.levels[size - 1]
        packed = packed & np.uint64((1 << (_BITS * size)) - 1) if size < 4 else packed
        at, found = level.find(level.keys, packed)
        out = np.empty((len(packed), len(self.languages)))
        out[found] = level.logp[at[found]]
        if not found.all():
            left = packed[~found]
            context, known = level.find(level.context_keys, left >> np.uint64(_BITS))
            weight = np.zeros((len(left), len(self.languages)))
            weight[known] = level.back_off[context[known]]
            out[~found] = weight + self._backed_off(left, size - 1)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text under each language, and the number of symbols.

        A text's sums are made of its own symbols in order: they do not depend on
        what else is in ``texts``.
        """
        sums = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts), np.int64)
        for at, symbols, counts, leads in units(texts):
            code, unique = pd.factorize(grams(symbols, counts, leads))
            logp = self._backed_off(np.asarray(unique, np.uint64), self.order)
            owner = np.repeat(np.arange(len(at)), counts)
            for lang in range(len(self.languages)):
                sums[at, lang] += np.bincount(owner, logp[:, lang][code], len(at))
            n[at] += counts
        return -sums / np.maximum(n, 1)[:, None], n


@dataclass
class Identifier:
    """Models and calibration."""

    model: KneserNey | None
    margin: tuple[float, float] = (0.5, 0.0)  # slope and intercept on the margin in nats
    centre: np.ndarray | None = None  # usual cross-entropy by language
    spread: np.ndarray | None = None  # of (cross-entropy - centre) * sqrt(length)

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Best language, margin to the next, cross-entropy of the best, symbols (0: no letter)."""
        entropy, n = self.model.cross_entropy(texts)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(texts)), best]
        if entropy.shape[1] > 1:
            second = np.partition(entropy, 1, axis=1)[:, 1]
        else:
            second = np.full(len(texts), -self.model.floor)
        return best, (second - low) * n, low, n

    def calibrate(self, langs: np.ndarray, best: np.ndarray, margin: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        """Fit the logistic margin and the usual cross-entropies on held-back rows."""
        k = len(self.model.languages)
        use = n > 0
        truth, best, margin, low, n = (x[use] for x in (langs, best, margin, low, n))
        right = truth == best
        # One right and one wrong pseudo-row at margin 0 keep the fit finite.
        x = np.concatenate([np.minimum(margin, 30), [0.0, 0.0]])
        y = np.concatenate([right.astype(float), [1.0, 0.0]])
        a, b = 0.5, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((y - p) * x).sum() - 1e-3 * (a - 0.5), (y - p).sum() - 1e-3 * b])
            hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        self.margin = (max(float(a), 0.05), float(b))
        self.centre, self.spread = np.zeros(k), np.full(k, 1e9)
        for lang in range(k):
            mine = right & (best == lang)
            if mine.sum() >= 20:
                self.centre[lang] = np.median(low[mine])
                z = (low[mine] - self.centre[lang]) * np.sqrt(n[mine])
                self.spread[lang] = max(1.4826 * np.median(np.abs(z)), 0.5)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if self.model is None or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, margin, low, n = self.evidence(texts)
        with np.errstate(over="ignore"):
            score = 1 / (1 + np.exp(-(self.margin[0] * np.minimum(margin, 1e4) + self.margin[1])))
            if self.centre is not None:
                # Long texts are held to a relative excess too: whole documents vary more than sqrt(n) says.
                z = (low - self.centre[best]) / np.maximum(self.spread[best] / np.sqrt(np.maximum(n, 1)), 0.05)
                score = score / (1 + np.exp(np.minimum(z - 12, 50)))
        score = np.where(n > 0, score, 0.0)
        return [self.model.languages[b] if k else UNKNOWN for b, k in zip(best, n)], score


def _blocks(column: pa.Array) -> Iterator[list[str]]:
    texts, chars = [], 0
    for text in column:
        text = text.as_py() or ""
        texts.append(text)
        chars += len(text)
        if chars >= BLOCK_CHARS:
            yield texts
            texts, chars = [], 0
    if texts:
        yield texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n of the batch rows (lang, text)."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        done = 0
        for block in _blocks(batch.column(1)):
            own = langs[done : done + len(block)]
            done += len(block)
            for at, symbols, counts, leads in units(block):
                code, names = pd.factorize(own[at])
                packed, of = grams(symbols, counts, leads), np.repeat(code, counts)
                for i, name in enumerate(names):
                    unique, n = np.unique(packed[of == i], return_counts=True)
                    columns = [pa.array([name] * len(unique), pa.string()), pa.array(unique.view(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Learn from distinct texts of ``docs`` that have a language, a bounded sample (`bounded_sample`)."""
    labelled = docs.select(F.col(lang_col).alias("group"), F.col(text_col).alias("text")).filter("text is not null and group is not null")
    keys = labelled.select("group", F.lit("").alias("mark"), *text_keys(F.col("text")))
    # Written once: two passes read it, and what they see is the same.
    sample = stage_table(bounded_sample(keys, labelled, "langid", TRAIN_CHARS, TOTAL_CHARS).withColumnRenamed("group", "lang"), "langid-sample")
    # An eighth calibrates; a language of a few texts needs them all to be known.
    many = [r["lang"] for r in sample.groupBy("lang").count().collect() if r["count"] >= ASIDE_TEXTS]
    aside = (F.pmod(F.xxhash64(F.lit("aside"), "text"), F.lit(8)) == 0) & F.col("lang").isin(many)
    counts = sample.filter(~aside).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if not len(rows):
        return Identifier(None)
    identifier = Identifier(KneserNey(rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {lang: i for i, lang in enumerate(identifier.model.languages)}
        for batch in batches:
            truth = np.array([code.get(x, -1) for x in batch.column(0).to_pylist()])
            done = 0
            for texts in _blocks(batch.column(1)):
                columns = [truth[done : done + len(texts)], *identifier.evidence(texts)]
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(c, np.float64)) for c in columns], ["truth", "best", "margin", "low", "n"]
                )

    held = sample.filter(aside).select("lang", "text")
    judged = held.mapInArrow(judge, "truth double, best double, margin double, low double, n double")
    # In one order, so that the fit does not depend on which task ends first.
    judged = judged.toArrow().to_pandas().sort_values(["truth", "best", "margin", "low", "n"])
    if len(judged):
        identifier.calibrate(*(judged[c].to_numpy() for c in ("truth", "best", "margin", "low", "n")))
    return identifier


def identify(
    docs: DataFrame, identifier: Identifier, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the columns ``out`` added; columns of these names that it has already are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    # Numbered names inside: names with dots or back-quotes cannot be passed through as they are.
    given = [n for n in docs.columns if n not in out]
    names = [f"c{i}" for i in range(len(given))]
    text_at = given.index(text_col)
    docs = docs.select([F.col(f"`{n.replace('`', '``')}`").alias(c) for n, c in zip(given, names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", found string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = 0
            for texts in _blocks(batch.column(text_at)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                langs, scores = own.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*names, "found", "score"],
                )

    return docs.mapInArrow(run, schema).toDF(*given, *out)


def languages_of(docs: DataFrame, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows not held out."""
    modulus, fold = held_out
    outside = crc_mod(F.col("doc_id"), modulus) == fold
    identifier = train(docs.filter(~outside))
    marked = docs.select("doc_id", outside.alias("held_out"), "text")
    return identify(marked, identifier).select("doc_id", "held_out", "lang_pred", "score")
