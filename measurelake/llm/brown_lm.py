"""Language-model scores by Brown's class-based n-grams.

Tokens are white-space words with A-Z lower-cased, then one end per text.  Every
word of the training texts is assigned a class by exchange: by the gain in the
likelihood of the class bigrams that its neighbours' classes give.

1. The ``ITEMS`` most frequent words, the endings of all others (a hash of their
   last characters) and the end are clustered into ``CLASSES`` classes by moving
   one after the other, on the driver: their bigrams are a table of fixed size.
2. The other words of the ``PLACED`` most frequent ones choose their classes in
   parallel, by counts of their neighbours' classes over all texts, against the
   classes of step 1 (a batch of the exchange, as in distributed clustering).
3. All further words, an unbounded table keyed by word, do the same against the
   classes of step 2.  None of them is frequent, so no key is hot.

A text's probability is

    product of P(class | class before) * P(word | class)

with transitions smoothed towards the class frequencies and emissions
(c + 0.1) / (N_class + 0.1 * (V_class + 1)); the end is a class of its own and
also stands before the first word.  As the condition ("class before") a word
beyond the placed ones counts with the class of its ending, in training as in
scoring, so that no pass over the texts waits for a join.  A word that the training
texts do not have is of its ending's class.  The base score is the unigram
model of the same counts.

All training texts are counted, and every text is scored whole.  The
``RESIDENT`` most frequent words go to the workers with the model, the others
are joined with their table by word; words of more than
``MAX_WORD_BYTES`` bytes are represented by a 128-bit digest.

Defined cases: null text is empty text (one token, the end); with no training
text every count is zero and scores are those of the smoothed empty model;
rows with equal or null ids are scored row by row; classes with equal gain: the
first; equally frequent words are resident by the order of the words; long texts
are scored whole; input columns named like a result are replaced, others kept;
empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, slices, stage_table

END = "\n"
ALPHA = 0.1
ITEMS = 1000
ENDINGS = 128
CLASSES = 48
SWEEPS = 6
PRIOR = 5.0
RESIDENT = 150_000
#: Words that are conditions by their own class: all that the workers hold.
PLACED = RESIDENT
MAX_WORD_BYTES = 64
BLOCK_CHARS = 2_000_000
#: No word holds a line feed: names of digests and of transition counts begin with one.
_DIGEST, _MOVE = "\n#", "\n@"


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches in slices of bounded size, with the texts lower-cased and nulls empty."""
    for batch in batches:
        for part in slices(batch, column, BLOCK_CHARS):
            yield part, pc.ascii_lower(pc.fill_null(part.column(column), ""))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text and the distinct word of every token, and the distinct words (long ones by digest)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist
    for i in np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy() > MAX_WORD_BYTES):
        words[i] = _DIGEST + xxhash.xxh3_128_hexdigest(words[i].encode())
    return owner[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), words


def ending(word: str) -> int:
    """The ending item of a word outside the frequent ones."""
    return zlib.crc32(word.rstrip(".,;:!?")[-2:].encode()) % ENDINGS


def endings(words: list[str]) -> np.ndarray:
    """``ending`` of many words: computed once for each distinct end."""
    ends = pc.utf8_slice_codeunits(pc.utf8_rtrim(pa.array(words, pa.string()), ".,;:!?"), -2, None).dictionary_encode()
    of = np.array([zlib.crc32(e.encode()) % ENDINGS for e in ends.dictionary.to_pylist()], np.int64)
    return of[ends.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)


@dataclass
class Items:
    """Words to items: frequent words first, then endings, then the end."""

    words: list[str]

    def __post_init__(self):
        self.of = {w: i for i, w in enumerate(self.words)}
        self.end = len(self.words) + ENDINGS
        self.count = self.end + 1

    def code(self, words: list[str]) -> np.ndarray:
        place = np.fromiter((self.of.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(place < 0)
        place[rest] = len(self.words) + endings([words[i] for i in rest])
        return place

    def sequence(self, owner: np.ndarray, items: np.ndarray, texts: int) -> np.ndarray:
        """Items of all texts one after the other, an end before the first and after each."""
        out = np.full(len(items) + texts + 1, self.end, np.int64)
        out[np.arange(len(items)) + owner + 1] = items
        return out


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word and n over all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 0):
            _, at, words = _tokens(texts)
            counts = np.bincount(at, minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words, END], pa.string()), pa.array(np.append(counts, part.num_rows))], ["word", "n"]
            )

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_bigrams(docs: DataFrame, text_col: str, items: Items) -> np.ndarray:
    """Counts of adjacent items over all texts, as a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(items.count**2, np.int64)
        for part, texts in _texts(batches, 0):
            owner, at, words = _tokens(texts)
            line = items.sequence(owner, items.code(words)[at], part.num_rows)
            total += np.bincount(line[:-1] * items.count + line[1:], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    pairs = docs.select(text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = pairs.toArrow()
    matrix = np.zeros(items.count**2)
    matrix[table["pair"].to_numpy()] = table["n"].to_numpy()
    return matrix.reshape(items.count, items.count)


def exchange_clusters(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item; the last item keeps the last class for itself."""

    def f(x):
        return x * np.log(np.maximum(x, 1))

    items = len(bigrams)
    free = classes - 1
    frequency = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-frequency[:-1], kind="stable")
    of = np.empty(items, np.int64)
    of[order] = np.arange(items - 1) % free
    of[-1] = free
    hot = np.eye(classes)[of]
    table = hot.T @ bigrams @ hot
    for _ in range(sweeps):
        moved = 0
        for w in order:
            own = of[w]
            hot[w] = 0
            out, into, loop = bigrams[w] @ hot, bigrams[:, w] @ hot, bigrams[w, w]
            table[own] -= out
            table[:, own] -= into
            table[own, own] -= loop
            rows, columns = table.sum(1)[:free], table.sum(0)[:free]
            part = table[:free]
            gain = (f(part + out) - f(part)).sum(1) + (f(table[:, :free].T + into) - f(table[:, :free].T)).sum(1)
            diagonal = np.diagonal(table)[:free]
            o, i = out[:free], into[:free]
            gain += f(diagonal + o + i + loop) - f(diagonal + o) - f(diagonal + i) + f(diagonal)
            gain -= f(rows + out.sum() + loop) - f(rows) + f(columns + into.sum() + loop) - f(columns)
            new = int(gain.argmax())
            if gain[new] <= gain[own] + 1e-9:
                new = own
            moved += new != own
            of[w] = new
            hot[w, new] = 1
            table[new] += out
            table[:, new] += into
            table[new, new] += loop
        if not moved:
            break
    return of


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, words: int, table: np.ndarray) -> np.ndarray:
    """The class of greatest gain for each of ``words`` words.

    Entries (word, code, n), sorted by word: n neighbours of class code before it
    (code < classes) or code - classes after it.  ``table`` holds the counts of
    class bigrams; its last class, the end, takes no word.
    """

    def f(x):
        return x * np.log(np.maximum(x, 1))

    classes = len(table)
    free = classes - 1
    sides = np.concatenate([table[:, :free], table.T[:, :free]])  # by code: counts with each class
    old = f(sides)
    one = f(sides + 1) - old
    gain = np.zeros((words, free))
    for a in range(0, len(word), 100_000):
        w, c, k = word[a : a + 100_000], code[a : a + 100_000], n[a : a + 100_000]
        part = one[c]
        many = np.flatnonzero(k > 1)
        part[many] = f(sides[c[many]] + k[many, None]) - old[c[many]]
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(part, starts, axis=0)
    before, after = (np.bincount(word[side], n[side], words)[:, None] for side in (code < classes, code >= classes))
    for total, own in ((table.sum(0)[:free], before), (table.sum(1)[:free], after)):
        gain -= f(total + own) - f(total)
    return gain.argmax(1)


@dataclass
class BrownModel:
    """Everything a worker needs to score texts, but for what is known of words beyond the resident ones."""

    items: Items
    item_classes: np.ndarray  # of each item
    of: dict[str, int]  # resident words to their places
    counts: np.ndarray  # of the resident words
    classes: np.ndarray  # of the resident words
    ends: int
    placed: int  # so many resident words are conditions by their own class
    transition: np.ndarray | None = None  # log10 P(class | class before)
    denominator: np.ndarray | None = None  # log10 of each class's emission denominator
    base_denominator: float = 0.0
    train_tokens: int = 0

    @property
    def end_class(self) -> int:
        return int(self.item_classes[self.items.end])

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (-1: not resident), class as a condition and class of the ending of each word."""
        place = np.fromiter((self.of.get(w, -1) for w in words), np.int64, len(words))
        by_end = self.item_classes[len(self.items.words) + endings(words)]
        known = np.append(self.classes, 0)[place]
        return place, np.where((place >= 0) & (place < self.placed), known, by_end), by_end

    def line(self, owner: np.ndarray, classes: np.ndarray, texts: int) -> np.ndarray:
        """Classes of all texts one after the other, an end before the first and after each."""
        out = np.full(len(classes) + texts + 1, self.end_class, np.int64)
        out[np.arange(len(classes)) + owner + 1] = classes
        return out


def _chunks(columns: dict[str, np.ndarray], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for a in range(0, size, most):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + most]) for c in columns.values()], list(columns))


def place_frequent(docs: DataFrame, text_col: str, model: BrownModel, table: np.ndarray) -> np.ndarray:
    """The classes of the resident words: those of the items as they are, of further placed words by their neighbours."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    classes, first = len(table), len(model.items.words)
    width = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(own.placed * width, np.int32)
        for part, texts in _texts(batches, 0):
            owner, at, words = _tokens(texts)
            place, condition, _ = own.look_up(words)
            line = own.line(owner, condition[at], part.num_rows)
            spot = np.arange(len(at)) + owner + 1
            asked = np.flatnonzero((place[at] >= first) & (place[at] < own.placed))
            base = place[at[asked]] * width
            codes = np.concatenate([base + line[spot[asked] - 1], base + classes + line[spot[asked] + 1]])
            unique, n = np.unique(codes, return_counts=True)
            total[unique] += n
        step = 1 << 20  # piece by piece: the places of all counts would be larger than the counts
        for a in range(0, len(total), step):
            used = np.flatnonzero(total[a : a + step])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used + a), pa.array(total[used + a].astype(np.int64))], ["pair", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, code, n = _entries(batch.column(1))
            best = best_classes(word, code, n, batch.num_rows, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best)], ["place", "class"])

    pairs = docs.select(text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    entry = F.struct((F.col("pair") % width).cast("int").alias("code"), "n")
    words = pairs.groupBy(F.floor(F.col("pair") / width).alias("place")).agg(F.collect_list(entry).alias("near"))
    found = words.mapInArrow(choose, "place long, class long").toArrow()
    out = model.classes.copy()
    out[found["place"].to_numpy()] = found["class"].to_numpy()
    return out


def _entries(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and n of a column of arrays of (code, n)."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)


def place_others(docs: DataFrame, text_col: str, model: BrownModel, table: np.ndarray) -> DataFrame:
    """word, n and class of all words that are not placed, written out.

    Rows whose word begins with ``_MOVE`` are transition counts: n moves from the
    condition named there to class ``class``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    classes = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        moves = np.zeros(classes * classes, np.int64)
        for part, texts in _texts(batches, 0):
            owner, at, words = _tokens(texts)
            place, condition, _ = own.look_up(words)
            line = own.line(owner, condition[at], part.num_rows)
            spot = np.arange(len(at)) + owner + 1
            rare = (place[at] < 0) | (place[at] >= own.placed)
            told = np.ones(len(line), bool)  # tokens of known class: placed words and ends
            told[spot[rare]] = False
            to = np.flatnonzero(told[1:]) + 1
            moves += np.bincount(line[to - 1] * classes + line[to], minlength=len(moves))
            spot, at = spot[rare], at[rare]
            codes = np.concatenate([at * (2 * classes) + line[spot - 1], at * (2 * classes) + classes + line[spot + 1]])
            unique, n = np.unique(codes, return_counts=True)
            word, code = np.divmod(unique, 2 * classes)
            names = pa.array(words, pa.string())
            for a in range(0, len(word), 500_000):
                cut = slice(a, a + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(word[cut])), pa.array(code[cut].astype(np.int32)), pa.array(n[cut])], ["word", "code", "n"]
                )
        used = np.flatnonzero(moves)
        columns = [pa.array([f"{_MOVE}{u}" for u in used], pa.string()), pa.array(used.astype(np.int32)), pa.array(moves[used])]
        yield pa.RecordBatch.from_arrays(columns, ["word", "code", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros((classes, classes), np.int64)
        for batch in batches:
            word, code, n = _entries(batch.column(1))
            known = pc.starts_with(batch.column(0), _MOVE).to_numpy(zero_copy_only=False)
            mine = ~known[word]
            np.add.at(moves, np.divmod(code[~mine], classes), n[~mine])
            number = np.cumsum(~known) - 1
            rows, code, n = number[word[mine]], code[mine], n[mine]
            count = int((~known).sum())
            best = best_classes(rows, code, n, count, table)
            before = code < classes
            np.add.at(moves, (code[before], best[rows[before]]), n[before])
            total = np.bincount(rows[before], n[before], count).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(~known)), pa.array(total), pa.array(best.astype(np.int32))], ["word", "n", "class"]
            )
        at, to = np.nonzero(moves)
        columns = [pa.array([f"{_MOVE}{a}" for a in at], pa.string()), pa.array(moves[at, to]), pa.array(to.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "class"])

    counted = docs.select(text_col).mapInArrow(run, "word string, code int, n long")
    # One shuffle, by word; both aggregations follow its partitioning.
    summed = counted.repartition("word").groupBy("word", "code").agg(F.sum("n").alias("n"))
    words = summed.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("near"))
    return stage_table(words.mapInArrow(choose, "word string, n long, class int"), "brown-others")


def _frequent(words: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` of the most frequent words.

    A histogram of the counts (eight bins an octave) gives a threshold that no
    more than ``most`` words reach, so no task sorts what all tasks send.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    bins = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()
    total, floor = 0, None
    for row in sorted(bins, key=lambda r: -r["level"]):
        total += row["k"]
        if total > most:
            break
        floor = row["level"]
    if floor is None:  # no words, or the highest bin alone has too many
        chosen = words.orderBy(F.desc("n"), "word").limit(most)
    else:
        chosen = words.filter(level >= floor)
    table = chosen.select("word", "n").toArrow()
    return list(zip(table["word"].to_pylist(), table["n"].to_pylist()))


def train(docs: DataFrame, text_col: str = "text") -> tuple[BrownModel, DataFrame]:
    """The model, and the table (word, n, class) of all training words that are not placed."""
    vocabulary = stage_table(count_words(docs, text_col), "brown-words")
    totals = vocabulary.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    tokens, distinct, ends = (int(x or 0) for x in totals)
    ranked = sorted(_frequent(vocabulary.filter(F.col("word") != END), RESIDENT), key=lambda r: (-r[1], r[0]))
    words, counts = [w for w, _ in ranked], np.array([n for _, n in ranked], np.int64)
    items = Items(words[:ITEMS])
    bigrams = count_bigrams(docs, text_col, items)
    of_items = exchange_clusters(bigrams, CLASSES)
    hot = np.eye(CLASSES)[of_items]
    table = hot.T @ bigrams @ hot
    model = BrownModel(items, of_items, {w: i for i, w in enumerate(words)}, counts, of_items[items.code(words)], ends, min(max(PLACED, ITEMS), len(words)))
    model.classes = place_frequent(docs, text_col, model, table)
    others = place_others(docs, text_col, model, table)
    told = others.filter(F.col("word").startswith(_MOVE)).select(F.substring("word", 3, 9).cast("int").alias("a"), "class", "n")
    moves = np.zeros((CLASSES, CLASSES))
    for row in told.groupBy("a", "class").agg(F.sum("n").alias("n")).collect():
        moves[row["a"], row["class"]] = row["n"]
    others = others.filter(~F.col("word").startswith(_MOVE))
    # The resident words among them: no more rows than there are of those.
    resident = docs.sparkSession.createDataFrame([(w,) for w in words[model.placed :]], "word string")
    for row in others.join(F.broadcast(resident), "word").select("word", "class").collect():
        model.classes[model.of[row["word"]]] = row["class"]
    mass = np.bincount(model.classes[: model.placed], counts[: model.placed], CLASSES)
    kinds = np.bincount(model.classes[: model.placed], minlength=CLASSES).astype(float)
    for row in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[row["class"]] += row["n"]
        kinds[row["class"]] += row["v"]
    prior = (moves.sum(0) + 1) / (moves.sum() + CLASSES)
    model.transition = np.log10((moves + PRIOR * prior) / (moves.sum(1, keepdims=True) + PRIOR))
    model.denominator = np.log10(mass + ALPHA * (kinds + 1))
    model.base_denominator = float(np.log10(tokens + ALPHA * (distinct + 1)))
    model.train_tokens = tokens
    return model, others


def score(docs: DataFrame, model: BrownModel, others: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_tokens, n_known, train_tokens, base_score and score (log10).

    Columns of ``docs`` that have one of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    given = [n for n in docs.columns if n not in (text_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    # Numbered names inside, so that no column of the input clashes with a working one.
    keep = [f"kept_{i}" for i in range(len(given))]
    docs = docs.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(given, keep)], F.col(text_col).alias("text"))
    numbered = docs.select(*keep, F.monotonically_increasing_id().alias("row"), "text")
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    schema += ", row long, word string, n_tokens long, n_known long, counts double, moves double, before int, ending int"
    names = [*keep, "row", "word", "n_tokens", "n_known", "counts", "moves", "before", "ending"]
    classes = len(model.denominator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        end_count = np.log10(model.ends + ALPHA)
        logs = np.log10(np.append(model.counts, 0) + ALPHA)
        for part, texts in _texts(batches, len(keep) + 1):
            n = part.num_rows
            owner, at, words = _tokens(texts)
            place, condition, by_end = model.look_up(words)
            line = model.line(owner, condition[at], n)
            spot = np.arange(len(at)) + owner + 1
            here = place[at] >= 0
            ends = np.cumsum(np.bincount(owner, minlength=n) + 1)  # the places of the ends
            tokens = np.bincount(owner, minlength=n) + 1
            moves = model.transition[line[ends - 1], line[ends]]
            known, mine = spot[here], owner[here]
            to = model.classes[place[at[here]]]
            moves += np.bincount(mine, model.transition[line[known - 1], to] - model.denominator[to], n)
            counts = np.bincount(mine, logs[place[at[here]]], n) + end_count
            found = np.bincount(mine, minlength=n) + (model.ends > 0)
            none = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.nulls(n, pa.string()), *map(pa.array, (tokens, found, counts, moves)), none, none], names
            )
            # Other words: a row for each text, word and class before it; n_tokens is how often.
            rest = ~here
            code = (owner[rest] * max(len(words), 1) + at[rest]) * classes + line[spot[rest] - 1]
            code, often = np.unique(code, return_counts=True)
            pair, before = np.divmod(code, classes)
            row, word = np.divmod(pair, max(len(words), 1))
            distinct = pa.array(words, pa.string())
            for a in range(0, len(code), 500_000):
                cut = slice(a, a + 500_000)
                k = len(code[cut])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.nulls(k, c.type) for c in part.columns[: len(keep)]],
                        part.column(len(keep)).take(pa.array(row[cut])),
                        distinct.take(pa.array(word[cut])),
                        pa.array(often[cut]),
                        *(pa.nulls(k, t) for t in (pa.int64(), pa.float64(), pa.float64())),
                        pa.array(before[cut].astype(np.int32)),
                        pa.array(by_end[word[cut]].astype(np.int32)),
                    ],
                    names,
                )

    told = stage_table(numbered.mapInArrow(run, schema), "brown-scores")
    texts = told.filter("word is null").drop("word", "before", "ending")
    rare = told.filter("word is not null").select("row", "word", F.col("n_tokens").alias("often"), "before", "ending")
    # Class bigrams and emission denominators: a table of fixed size.
    steps = [(a, b, float(model.transition[a, b] - model.denominator[b])) for a in range(classes) for b in range(classes)]
    steps = spark.createDataFrame(steps, "before int, class int, step double")
    found = rare.join(others, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("class", F.coalesce("class", "ending"))
    found = found.join(F.broadcast(steps), ["before", "class"])
    added = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("often")).otherwise(0)).alias("k"),
        F.sum(F.col("often") * F.log10(F.col("n") + ALPHA)).alias("c"),
        F.sum(F.col("often") * F.col("step")).alias("m"),
    )
    both = texts.join(added, "row", "left")
    counts = F.col("counts") + F.coalesce("c", F.lit(0.0))
    return both.select(
        *[F.col(k).alias(n) for n, k in zip(given, keep)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (counts - F.col("n_tokens") * model.base_denominator).alias("base_score"),
        # The end's own count is no emission: its class holds nothing else.
        (counts - F.lit(float(np.log10(model.ends + ALPHA))) + F.col("moves") + F.coalesce("m", F.lit(0.0))).alias("score"),
    )


def scores_of(docs: DataFrame, held_out: tuple[int, int] = (10, 0)) -> DataFrame:
    """doc_id, held_out and the scores of every row, learned from the rows not held out."""
    modulus, fold = held_out
    outside = crc_mod(F.col("doc_id"), modulus) == fold
    model, others = train(docs.filter(~outside))
    return score(docs.select("doc_id", outside.alias("held_out"), "text"), model, others)
