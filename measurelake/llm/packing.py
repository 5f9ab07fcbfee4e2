"""Harmonic packing of token streams into fixed-length training sequences.

Every document becomes its token ids plus an end id.  Lengths fall into
reciprocal-capacity classes: class ``k`` holds pieces that fit ``k`` times into
a sequence, and each class fills its own bins with exactly ``k`` pieces.  A
length that would leave more than ``slack`` of a bin empty is cut down to the
largest harmonic length ``capacity // k`` below it and the rest is classed
again, so a full bin pads at most ``slack``.  Workers fill bins independently:
there is no shuffle.  What is left in open bins when a worker's input ends is
laid end to end and cut into full sequences and, at the very end, sequences
whose length is a power of two, which need no padding.

Defined cases: null text is empty text (its single end id is one piece); empty
tables give no rows; repeated rows are packed once each; texts of any length
are tokenised in blocks cut at white space.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

BLOCK_CHARS = 2_000_000
CACHE_WORDS = 500_000
#: Local sequence numbers take the low bits of a sequence id, the worker the high ones.
WORKER_SHIFT = 40


#: Texts with other characters than these go the slower way: beyond them lower-casing,
#: composition or white space may differ between libraries, or a special token may stand.
_UNSAFE = "[^\\x00-\\x{24f}\\x{2010}-\\x{2027}]|[\\x1c-\\x1f\\x{85}\\x{a0}\\x{130}]|<\\|"
#: White space of plain texts besides the space; the tokenizer's normaliser makes it spaces.
_SPACES = "\n\t\x0b\x0c\r"
#: The vocabulary's own split pattern, a fixed value.
_SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stay, the rest follow
    U+0100.  The space, which only parts words here, stays a space."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in keep]
    return {b: chr(0x100 + n) for n, b in enumerate(rest) if b != 0x20}


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _IdStore:
    """Ids of words seen so far; bounded: it starts anew when full."""

    def __init__(self, encode):
        self._encode = encode
        self._reset()

    def _reset(self) -> None:
        self._row: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 14, np.int64)
        self._lengths = np.zeros(1 << 14, np.int64)
        self._used = 0

    def _learn(self, words: list[str]) -> None:
        ids, lengths = self._encode(words)
        first, count = len(self._row), len(words)
        while len(self._starts) < first + count:
            self._starts, self._lengths = (np.resize(a, 2 * len(a)) for a in (self._starts, self._lengths))
        while len(self._ids) < self._used + len(ids):
            self._ids = np.resize(self._ids, 2 * len(self._ids))
        self._ids[self._used : self._used + len(ids)] = ids
        self._lengths[first : first + count] = lengths
        self._starts[first : first + count] = self._used + np.cumsum(lengths) - lengths
        self._used += len(ids)
        self._row.update(zip(words, range(first, first + count)))

    def runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: the id store, and each word's start and length in it."""
        if len(self._row) > CACHE_WORDS:
            self._reset()
        known = self._row
        if new := [w for w in words if w not in known]:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return self._ids, self._starts[at], self._lengths[at]


class WordTokenizer:
    """Token ids of whole texts, each distinct word coded once and cached.

    For vocabularies whose pre-tokeniser always splits at white space.  Texts
    of plain characters are lower-cased and split with Arrow kernels and only
    their distinct words reach the byte-pair model; all others are coded by
    the complete tokenizer, white-space chunk by chunk.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._model = Tokenizer(self._whole.model)
        self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._letters = _byte_letters()
        size = self._whole.get_vocab_size()
        self._word_end = np.array([(self._whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._words = _IdStore(self._code_words)
        self._chunks = _IdStore(self._code_chunks)

    def _code_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = " ".join(
            w if w.isascii() and w.isprintable() else w.encode().decode("latin1").translate(self._letters)
            for w in words
        )
        coded = self._model.encode_batch_fast([plain], add_special_tokens=False)[0].ids
        ids = np.array(coded, np.uint32)
        ends = np.flatnonzero(self._word_end[ids]) + 1
        filled = np.fromiter(map(bool, words), bool, len(words))
        lengths = np.zeros(len(words), np.int64)
        lengths[filled] = np.diff(ends, prepend=0)
        return ids, lengths

    def _code_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self._whole.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(chunks))
        return np.fromiter((i for ids in coded for i in ids), np.uint32, int(lengths.sum())), lengths

    def _assemble(self, texts: pa.Array, store: _IdStore, split_words: bool) -> list[np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        chunks = flat.dictionary
        if split_words:
            mixed = pc.invert(pc.utf8_is_alpha(chunks))
            apart = pc.replace_substring_regex(chunks.filter(mixed), _SPLIT, r"\1 ")
            parts = pc.split_pattern(pc.replace_with_mask(chunks, mixed, apart), " ")
            words = parts.flatten().dictionary_encode()
            ids, starts, lengths = store.runs(words.dictionary.to_pylist())
            at = words.indices.to_numpy()
            ids = ids[_spread(starts[at], lengths[at])]
            ends = np.concatenate([[0], np.cumsum(lengths[at])])[parts.offsets.to_numpy()]
            starts, lengths = ends[:-1], np.diff(ends)
        else:
            ids, starts, lengths = store.runs(chunks.to_pylist())
        at = flat.indices.to_numpy()
        ids = ids[_spread(starts[at], lengths[at])]
        ends = np.concatenate([[0], np.cumsum(lengths[at])])[lists.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode_texts(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        given = pc.fill_null(pa.array(texts, pa.string()), "")
        unsafe = pc.match_substring_regex(given, _UNSAFE).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(given)
        for rows, split_words in ((np.flatnonzero(~unsafe), True), (np.flatnonzero(unsafe), False)):
            if len(rows):
                part = given.take(pa.array(rows))
                for space in _SPACES if split_words else "\n":
                    part = pc.replace_substring(part, space, " ")
                part = pc.utf8_lower(part) if split_words else part
                store = self._words if split_words else self._chunks
                for row, ids in zip(rows, self._assemble(part, store, split_words)):
                    out[row] = ids
        return out

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text too long for a block, cut at spaces."""
        parts, at = [], 0
        while at < len(text):
            to = text.find(" ", at + BLOCK_CHARS)
            to = len(text) if to < 0 else to
            parts += self.encode_texts([text[at:to]])
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def harmonic_cuts(length: int, capacity: int, slack: int) -> list[int]:
    """Cut ``length`` into pieces that fill harmonic bins with at most ``slack`` left over."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        fit = capacity // rest
        if capacity - fit * rest <= slack:
            pieces.append(rest)
            break
        piece = capacity // (fit + 1)
        pieces.append(piece)
        rest -= piece
    return pieces


class _Packer:
    def __init__(self, capacity: int, worker: int):
        self.capacity = capacity
        self.next_sequence = worker << WORKER_SHIFT
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc, start, len(ids), crc, doc_tokens, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def add(self, doc, ids: np.ndarray, slack: int) -> None:
        start = 0
        for length in harmonic_cuts(len(ids), self.capacity, slack):
            per_bin = self.capacity // length
            waiting = self.open.setdefault(per_bin, [])
            waiting.append((doc, start, ids[start : start + length].copy(), len(ids)))
            if len(waiting) == per_bin:
                self._close(self.open.pop(per_bin))
            start += length

    def finish(self) -> None:
        """Lay what is left end to end; only power-of-two sequences are shorter than the capacity."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            taken, room = [], size
            while room:
                doc, start, ids, doc_tokens = left.pop()
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:], doc_tokens))
                    ids = ids[:room]
                taken.append((doc, start, ids, doc_tokens))
                room -= len(ids)
            self._close(taken)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Documents in groups of bounded size."""
    docs, texts, chars = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = text or ""
                docs.append(doc)
                texts.append(text)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield docs, texts
                    docs, texts, chars = [], [], 0
    if docs:
        yield docs, texts


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    slack: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document of ``docs``; one row per piece (see the module docstring).

    ``tokenizer_path`` must be readable on every executor, e.g. installed with
    the tokenizers package.  ``slack`` is the padding allowed per full bin.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        context = TaskContext.get()
        packer = _Packer(capacity, context.partitionId() if context else 0)
        end = np.array([end_id], np.uint32)
        for ids_of, texts in _blocks(batches):
            long = len(texts[-1]) > BLOCK_CHARS
            coded = tokenizer.encode_texts(texts[:-1] if long else texts)
            if long:
                coded.append(tokenizer.encode_long(texts[-1]))
            for doc, ids in zip(ids_of, coded):
                packer.add(doc, np.concatenate([ids, end]), slack)
            if packer.rows:
                yield packer.batch()
        packer.finish()
        if packer.rows:
            yield packer.batch()

    return docs.select(id_col, text_col).withColumnsRenamed({id_col: "doc_id"}).mapInArrow(pack, SCHEMA)
