"""Document quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by
``CHUNK - HOP`` and cover all of it.  Byte embeddings pass through learned
filters of ``WIDTH`` bytes, a rectifier and a max-pool per chunk; the pooled
activations are averaged over the chunks and combined into one probability.

Training is mini-batch Adam on the driver over a bounded sample of labelled
rows: ``TRAIN_BYTES`` bytes at most, distinct texts of at most ``TEXT_BYTES``, in order
of a hash of the text (`bounded_sample`).  Ids and labels choose and mark rows; they are never inputs of a score.

Defined cases: null and empty texts are one chunk of zeros and get a score;
rows with null labels are not learned from, several labels of one id all are;
without both labels to learn from every score is the share of good ones (1
without any label); repeated rows repeat; ties in a score are rows of equal
features; no text is cut short, very long ones are scored in blocks of chunks;
columns named score or predicted are replaced, others kept, dots included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, crc_mod, slices, text_keys

CHUNK = 512
HOP = 448
WIDTH = 8
STRIDE = 4
EMBED = 8
FILTERS = 32
EPOCHS = 10
BATCH = 32
RATE = 0.01
TRAIN_BYTES = 3_000_000
TEXT_BYTES = 300_000
THRESHOLD = 0.3
_BLOCK_CHUNKS = 512
_BLOCK_BYTES = 1_000_000


def chunks_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (rows of bytes) of all texts and the number of chunks of each."""
    rows, counts = [], []
    for text in texts:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        n = max(1, -(-(len(data) - CHUNK) // HOP) + 1)
        padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
        padded[: len(data)] = data
        rows.append(sliding_window_view(padded, CHUNK)[::HOP])
        counts.append(n)
    return np.concatenate(rows), np.array(counts)


class ByteCNN:
    """The network; ``fit`` learns it, ``score`` applies it."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.filters = (rng.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = np.zeros(FILTERS, np.float32)
        self.offset = np.zeros(1, np.float32)

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        """Byte windows of every filter position: chunks by positions by width."""
        return sliding_window_view(chunks, WIDTH, axis=1)[:, ::STRIDE]

    def _pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled activations, and the bytes of the window that won each filter (chunks by filters by width)."""
        tops, won = [], []
        for a in range(0, len(chunks), _BLOCK_CHUNKS):
            windows = self._windows(chunks[a : a + _BLOCK_CHUNKS])
            inputs = self.embed[windows].reshape(-1, WIDTH * EMBED)
            active = (inputs @ self.filters).reshape(len(windows), windows.shape[1], FILTERS)
            place = active.argmax(1)
            top = np.take_along_axis(active, place[:, None], 1)[:, 0] + self.bias
            tops.append(np.maximum(top, 0))
            won.append(windows[np.arange(len(windows))[:, None], place])
        return np.concatenate(tops), np.concatenate(won)

    def features(self, chunks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean over each text's chunks of the pooled activations."""
        parts = []
        for a in range(0, len(chunks), _BLOCK_CHUNKS):
            windows = self._windows(chunks[a : a + _BLOCK_CHUNKS])
            inputs = self.embed[windows].reshape(-1, WIDTH * EMBED)
            active = (inputs @ self.filters).reshape(len(windows), windows.shape[1], FILTERS)
            parts.append(np.maximum(active.max(1) + self.bias, 0))
        pooled = np.concatenate(parts)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(pooled, starts, axis=0) / counts[:, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        chunks, counts = chunks_of(texts)
        logit = self.features(chunks, counts) @ self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))

    def fit(self, texts: list[str], labels: np.ndarray, threshold: float = THRESHOLD, seed: int = 7) -> None:
        """Train, then shift the logit so that ``threshold`` separates the sample best, class by class."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "weight", "offset")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.offset[:] = np.log(share / (1 - share))
        step = 0
        steps = EPOCHS * -(-len(texts) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                grads = self._gradients([texts[r] for r in rows], labels[rows])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                    m, v = first[n] / (1 - 0.9**step), second[n] / (1 - 0.999**step)
                    getattr(self, n)[...] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

        score = np.concatenate([self.score(texts[a : a + 128]) for a in range(0, len(texts), 128)])
        edges = np.unique(score)
        good = np.searchsorted(np.sort(score[labels == 1]), edges, "left") / (labels == 1).sum()
        bad = np.searchsorted(np.sort(score[labels == 0]), edges, "left") / (labels == 0).sum()
        # Below an edge lie the share "good" of the good and "bad" of the bad; take the middle of the best gap.
        at = int((bad - good).argmax())
        logit = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
        best = (logit(edges[at]) + logit(edges[max(at - 1, 0)])) / 2
        self.offset += np.float32(logit(threshold) - best)

    def _gradients(self, texts: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
        chunks, counts = chunks_of(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        pooled, won = self._pooled(chunks)
        feature = np.zeros((len(texts), FILTERS), np.float32)
        np.add.at(feature, owner, pooled / counts[owner][:, None])
        logit = feature @ self.weight + self.offset
        error = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) / len(texts)).astype(np.float32)
        back = (error[owner] / counts[owner])[:, None] * self.weight * (pooled > 0)
        # Only the window that won the max-pool gets a gradient.
        filters, embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for a in range(0, len(chunks), _BLOCK_CHUNKS):
            block, part = won[a : a + _BLOCK_CHUNKS], back[a : a + _BLOCK_CHUNKS]
            inputs = self.embed[block].reshape(len(block), FILTERS, WIDTH * EMBED)
            filters += np.einsum("cf,cfi->if", part, inputs)
            np.add.at(embed, block.reshape(-1), (part[:, :, None] * self.filters.T[None]).reshape(-1, EMBED))
        return {
            "embed": embed + 1e-5 * self.embed,
            "filters": filters + 1e-5 * self.filters,
            "bias": back.sum(0),
            "weight": feature.T @ error + 1e-4 * self.weight,
            "offset": error.sum(keepdims=True),
        }


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> ByteCNN:
    """Learn from a bounded sample of the rows of ``docs`` that ``labels`` marks 0 or 1."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark")).filter("mark in (0, 1)")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.filter(F.octet_length("text") <= TEXT_BYTES)
    for usable in (whole, rows):  # longer texts only where there is nothing else
        keys = usable.select("id", *text_keys(F.col("text"))).join(marks, "id").select(F.lit(0).alias("group"), "mark", "t", "n")
        # A character has four bytes at most, and most have one: what is drawn by characters is cut by bytes.
        sample = bounded_sample(keys, usable, "quality", TRAIN_BYTES).toArrow().to_pandas()
        if len(sample):
            break
    sample = sample.sort_values(["text", "mark"], kind="stable").sample(frac=1, random_state=7)
    held = sample["text"].map(lambda t: len(t.encode("utf-8", "surrogatepass"))).cumsum()
    sample = sample[(held <= TRAIN_BYTES) | (np.arange(len(sample)) == 0)]
    network = ByteCNN()
    truth = sample["mark"].to_numpy(np.float32)
    if len(np.unique(truth)) < 2:
        network.offset[:] = 40.0 if not len(truth) or truth.mean() > 0.5 else -40.0
        return network
    network.fit(sample["text"].tolist(), truth)
    return network


def quality_scores(
    docs: DataFrame, network: ByteCNN, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """``docs`` with column ``text_col`` replaced by score and predicted (columns of these names go)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    names = [n for n in docs.columns if n not in (text_col, "score", "predicted")]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    schema += ", score double, predicted int"
    frame = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names), _BLOCK_BYTES):
                scores = shared.value.score(part.column(len(names)).to_pylist())
                marks = pa.array((scores >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(scores), marks], [*names, "score", "predicted"]
                )

    return frame.mapInArrow(run, schema)


def quality_of(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, learned from the rows not held out."""
    modulus, fold = held_out
    outside = crc_mod(F.col("doc_id"), modulus) == fold
    network = train(docs.filter(~outside), labels)
    return quality_scores(docs.select("doc_id", outside.alias("held_out"), "text"), network)
