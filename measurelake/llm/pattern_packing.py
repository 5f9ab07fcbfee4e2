"""Pattern packing: few-document length patterns fitted to the length histogram.

1. Workers tokenise whole documents and cut those over the capacity into full
   pieces, the first one shorter; a piece knows its place among its worker's
   pieces of its length.
2. The histogram of lengths, at most ``capacity`` numbers however many
   documents there are, is all that the driver sees.  `plan` enumerates the
   patterns of two and three pieces that fill a sequence to the token, fits how
   often each is used by non-negative least squares, rounds, and packs what is
   left best-fit by groups of equal lengths.
3. Counts per worker and length, added up over the workers, number all pieces
   of a length; a number falls into one slot of the plan, which says sequence
   and offset.

The plan's size depends on the capacity alone: at most the enumerated patterns
and some four groups per length.

Defined cases: a null text is empty (its end id is one piece); repeated rows
and null ids are packed once each; texts of any length are tokenised in blocks
cut at white space; equal lengths are interchangeable, so ties do not matter;
an empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage_table
from .packing import _IdStore, _spread

#: Steps of the non-negative least squares.
FIT_STEPS = 250
#: Characters that a worker codes together; longer texts are cut.
BLOCK_CHARS = 2_000_000
#: Chunks that a worker keeps; beyond them it starts anew.
CACHE_CHUNKS = 1_200_000

# --- tokens

#: A space parts tokens unless white space stands on both sides of it (or it ends the text);
#: texts with such a space, with rarer white space or a special token are coded whole.
_UNSAFE = "[\\s] ([\\s]|$)|^ ([\\s]|$)|[\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|<\\|"


class _Chunks(_IdStore):
    """The store of a worker's chunks: most are known, so one look-up each has to do."""

    def runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self._row) > CACHE_CHUNKS:
            self._reset()
        at = np.fromiter(map(self._row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self._row) + np.arange(len(missing))
            self._learn([words[i] for i in missing])
        return self._ids, self._starts[at], self._lengths[at]


_LETTER, _MARK, _BLANK = 1, 2, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KINDS[[ord(c) for c in ".,;:!?"]] = _MARK
_KINDS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _BLANK


def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts and spaces, at a mark after a letter, at a line feed after other than
    white space, and behind such a line feed if something other than white space follows.  The last entry is the end."""
    kind = _KINDS[data]
    cut = data == 0x20
    cut[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
    feed = np.zeros(len(data) + 1, bool)
    feed[1:-1] = (data[1:] == 0x0A) & (kind[:-1] != _BLANK)
    cut |= feed[:-1]
    cut[1:] |= feed[:-2] & (kind[1:] != _BLANK)
    whole = np.append(cut, True)
    whole[: at[0]] = False
    whole[at] = True
    return np.flatnonzero(whole)


class ByteTokenizer:
    """Ids of whole texts under a byte-level vocabulary whose words take the space before them.

    Texts are cut where a token always begins (`_cuts`), and each distinct chunk is coded once and kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        size = self._whole.get_vocab_size()
        #: The stand-in of every byte is one character.
        self._bytes = np.array([len(self._whole.id_to_token(i) or "") for i in range(size)])
        self._chunks = _Chunks(self._code)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self._whole.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(texts))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths

    def _code(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of a space and something else may stand side by side in one text; others are coded alone."""
        given = pa.array(chunks, pa.string())
        joined = pc.match_substring_regex(given, "^ [^\\s]").to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(chunks), np.int64)
        parts = [np.zeros(0, np.uint32)] * 2
        for n, chosen in enumerate((joined, ~joined)):
            own = [c for c, is_own in zip(chunks, chosen) if is_own]
            if n == 0 and own:
                ids = self._encoded(["".join(own)])[0]
                ends = np.cumsum(pc.binary_length(given).to_numpy()[joined].astype(np.int64))
                cut = np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1
                parts[0], lengths[chosen] = ids, np.diff(cut, prepend=0)
            elif own:
                parts[1], lengths[chosen] = self._encoded(own)
        # The ids of both kinds, in the order of the chunks.
        starts = np.zeros(len(chunks), np.int64)
        starts[joined] = np.cumsum(lengths[joined]) - lengths[joined]
        starts[~joined] = len(parts[0]) + np.cumsum(lengths[~joined]) - lengths[~joined]
        return np.concatenate(parts)[_spread(starts, lengths)], lengths

    def encode_texts(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        given = pc.fill_null(pa.array(texts, pa.large_string()), "")
        unsafe = pc.match_substring_regex(given, _UNSAFE).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(given)
        plain = np.flatnonzero(~unsafe)
        if len(plain):
            part = given.take(pa.array(plain))
            at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            cuts = _cuts(np.frombuffer(part.buffers()[2] or b"", np.uint8)[: at[-1]], at)
            flat = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), part.buffers()[2]).dictionary_encode()
            ids, starts, lengths = self._chunks.runs(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
            of = flat.indices.to_numpy()
            ids = ids[_spread(starts[of], lengths[of])]
            ends = np.concatenate([[0], np.cumsum(lengths[of])])[np.searchsorted(cuts, at)]
            for row, a, b in zip(plain, ends[:-1], ends[1:]):
                out[row] = ids[a:b]
        odd = np.flatnonzero(unsafe)
        if len(odd):
            ids, lengths = self._encoded(given.take(pa.array(odd)).to_pylist())
            for row, own in zip(odd, np.split(ids, np.cumsum(lengths)[:-1])):
                out[row] = own
        return out

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text too long for a block, cut before spaces between other characters."""
        parts, at = [], 0
        while at < len(text):
            to = at + BLOCK_CHARS
            while 0 <= (to := text.find(" ", to)) < len(text) - 1 and (text[to - 1].isspace() or text[to + 1].isspace()):
                to += 1
            to = len(text) if to < 0 or to >= len(text) - 1 else to
            parts += self.encode_texts([text[at:to]])
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# --- the plan


def patterns(histogram: np.ndarray) -> np.ndarray:
    """All ascending pairs (0 first) and triples of present lengths that sum to the capacity; ``histogram[n]`` counts length n."""
    capacity = len(histogram) - 1
    present = histogram > 0
    found = []
    lengths = np.flatnonzero(present[: capacity // 2 + 1])
    lengths = lengths[lengths > 0]
    pairs = lengths[present[capacity - lengths]]
    found.append(np.stack([np.zeros_like(pairs), pairs, capacity - pairs], axis=1))
    for first in lengths[lengths <= capacity // 3]:
        second = lengths[(lengths >= first) & (lengths <= (capacity - first) // 2)]
        second = second[present[capacity - first - second]]
        found.append(np.stack([np.full_like(second, first), second, capacity - first - second], axis=1))
    return np.concatenate(found)


def fit(chosen: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """How often to use each pattern: non-negative least squares by accelerated projected gradients.

    A length's error counts with the length, for what is left of short ones is easily packed.
    """
    size = len(histogram)
    weight = np.arange(size) / size
    target = histogram.astype(float)

    def used(x):
        return sum(np.bincount(chosen[:, c], weights=x, minlength=size) for c in range(3)) * (weight > 0)

    def gradient(error):
        error = weight * error
        return error[chosen[:, 0]] + error[chosen[:, 1]] + error[chosen[:, 2]]

    v = np.ones(len(chosen))
    for _ in range(30):  # the largest curvature, by power iteration
        v = gradient(used(v))
        curvature = np.linalg.norm(v)
        v /= curvature or 1
    step = 1 / (1.05 * curvature) if curvature else 0
    x = y = np.zeros(len(chosen))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * gradient(used(y) - target))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def rounded(chosen: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats, fractions carried on from pattern to pattern, and the lengths left; no length is used more often than it is there."""
    total = np.floor(np.cumsum(x) + 0.5)
    repeats = np.diff(total, prepend=0).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for p in np.flatnonzero(repeats):
        lengths, need = np.unique(chosen[p][chosen[p] > 0], return_counts=True)
        n = min(int(repeats[p]), int((left[lengths] // need).min()))
        repeats[p] = n
        left[lengths] -= n * need
    return repeats, left


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: bins with the same content are one group (content, number)."""
    capacity = len(left) - 1
    rooms: list[int] = []  # ascending
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], number: int, room: int) -> None:
        if number:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((content, number))

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            place = bisect_left(rooms, length)
            if place < len(rooms):
                room = rooms[place]
                content, number = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[place]
            else:
                room, content = capacity, ()
                number = -(-count // (capacity // length))
            each = min(room // length, count)
            full = min(number, count // each)
            put(content + (length,) * each, full, room - each * length)
            count -= full * each
            number -= full
            if number and 0 < count < each:
                put(content + (length,) * count, 1, room - count * length)
                number, count = number - 1, 0
            if content:
                put(content, number, room)
    return [g for found in groups.values() for g in found]


@dataclass(frozen=True)
class Plan:
    """Slots by (length, number of the first piece): sequence of the first copy, pieces of the length a copy, offset."""

    starts: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, by its length and its number among pieces of that length."""
        key = (length << 44) | number
        slot = np.searchsorted(self.starts, key, "right") - 1
        within = key - self.starts[slot]
        return self.sequence[slot] + within // self.each[slot], self.offset[slot] + within % self.each[slot] * length


def plan(histogram: np.ndarray) -> Plan:
    """A plan for all pieces of a histogram."""
    capacity = len(histogram) - 1
    short = histogram.copy()
    short[capacity] = 0
    chosen = patterns(short)
    groups: list[tuple[tuple[int, ...], int]] = []
    left = short
    if len(chosen):
        repeats, left = rounded(chosen, fit(chosen, short), short)
        groups += [(tuple(int(n) for n in chosen[p][::-1] if n), int(repeats[p])) for p in np.flatnonzero(repeats)]
    groups += best_fit(left)
    if histogram[capacity]:
        groups.append(((capacity,), int(histogram[capacity])))
    used = np.zeros(capacity + 1, np.int64)
    slots, sequence = [], 0
    for content, number in groups:
        offset = 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            slots.append(((length << 44) | int(used[length]), sequence, each, offset))
            used[length] += number * each
            offset += each * length
        sequence += number
    columns = np.array(sorted(slots), np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences=sequence)


# --- the operator


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in groups of bounded size; a text over it comes last in its group."""
    docs, texts, chars = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                docs.append(doc)
                texts.append(text or "")
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS:
                    yield docs, texts
                    docs, texts, chars = [], [], 0
    if docs:
        yield docs, texts


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, worker int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_IDS = ", ids array<int>"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces, each with its worker and its number among the worker's pieces of its length."""
    schema = _PIECE + _IDS * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(tokenizer_path)
        context = TaskContext.get()
        worker = context.partitionId() if context else 0
        seen = [0] * (capacity + 1)
        end = np.array([end_id], np.uint32)
        for ids_of, texts in _blocks(batches):
            long = len(texts[-1]) > BLOCK_CHARS
            coded = tokenizer.encode_texts(texts[:-1] if long else texts)
            if long:
                coded.append(tokenizer.encode_long(texts[-1]))
            rows = []
            for doc, ids in zip(ids_of, coded):
                ids = np.concatenate([ids, end]).astype("<u4")
                start, to = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    own = ids[start:to]
                    n = len(own)
                    row = (doc, piece, start, n, zlib.crc32(own.tobytes()), worker, seen[n])
                    rows.append((*row, own) if with_ids else row)
                    seen[n] += 1
                    start, to = to, to + capacity
            for a in range(0, len(rows), 4096):
                columns = zip(*rows[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(cut, schema)


def pack_patterns(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack every document of ``docs``; one row per piece, with its token ids if wanted (see the module docstring).

    ``tokenizer_path`` must be readable on every executor, e.g. installed with
    the tokenizers package.
    """
    pieces = stage_table(pieces_of(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "pattern-pieces")
    counts = pieces.groupBy("worker", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    plan_ = plan(histogram)

    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("worker", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(base, ["worker", "length"])
    schema = _PLACED + _IDS * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth, base = (batch.column(c).to_numpy() for c in ("length", "nth", "before"))
            sequence, offset = plan_.place(length, nth + base)
            given = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([given.get(n, batch.column(n) if n not in given else None) for n in names], names)

    return numbered.mapInArrow(place, schema)
