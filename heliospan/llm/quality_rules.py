"""Quality rules: counted limits, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliospan.llm import linear
from heliospan.llm.common import over_batches, prepared
from heliospan.llm.samples import labelled
from heliospan.llm.words import Block, blocks, runs, span_hashes

# Fixed thresholds.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
MIN_PROBABILITY = 0.5
SYMBOLS = b"#*$%&|<>"
BITS = 15
FAMILIES = 4  # words, word pairs, character triples, character quadruples
WIDTH = FAMILIES << BITS

SCORED = ("doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, "
          "n_repeat_words BIGINT, base_failed BOOLEAN, kept BOOLEAN, quality DOUBLE")

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(block.data)
    stops = np.union1d(np.flatnonzero(block.data == 10), block.offsets[1:])
    starts = np.concatenate([[0], stops[:-1] + (block.data[np.minimum(stops[:-1], n - 1)] == 10)]) if n else stops[:0]
    starts, stops = starts[:len(stops)], stops[:len(starts)]
    # A text that ends without a line feed ends its last line; the next line starts at the next text.
    keep = np.searchsorted(block.starts, stops) > np.searchsorted(block.starts, starts)
    starts, stops = starts[keep], stops[keep]
    if not len(starts):
        return np.zeros(block.count, np.int64)
    text = np.searchsorted(block.offsets, starts, "right") - 1
    marks = span_hashes(block.data, starts, stops, lower=False)
    order = np.lexsort((marks, text))
    marks, text = marks[order], text[order]
    again = (marks[1:] == marks[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text[1:][again], minlength=block.count)


def repeated_words(block: Block) -> np.ndarray:
    """Words inside windows of eight words that occur twice or more in the text, the first included."""
    out = np.zeros(block.count, np.int64)
    window = runs(block.hashes, REPEAT_WINDOW)
    bounds = block.bounds
    for i in np.flatnonzero(np.diff(bounds) > REPEAT_WINDOW):
        own = window[bounds[i]:bounds[i + 1] - REPEAT_WINDOW + 1]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(own, twice))
            edge = np.zeros(bounds[i + 1] - bounds[i] + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + REPEAT_WINDOW, -1)
            out[i] = (np.cumsum(edge[:-1]) > 0).sum()
    return out


def ngrams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every family, feature indices in text order and the bounds of each text."""
    words = block.hashes
    yield (words & np.uint64((1 << BITS) - 1)).astype(np.int64), block.bounds
    pairs = (runs(words, 2) & np.uint64((1 << BITS) - 1)).astype(np.int64) + (1 << BITS)
    whole = block.text[:len(pairs)] == block.text[len(words) - len(pairs):]
    yield pairs[whole], np.searchsorted(block.text[:len(pairs)][whole], np.arange(block.count + 1))
    data = block.data.astype(np.uint32)
    for family, size in ((2, 3), (3, 4)):
        n = max(len(data) - size + 1, 0)
        total = np.zeros(n, np.uint32)
        for i in range(size):
            total |= data[i:i + n] << np.uint32(8 * i)
        total *= np.uint32(2654435761)
        total >>= np.uint32(32 - BITS)
        # An n-gram that runs into the next text counts for neither: clip the bounds of each text.
        stops = np.maximum(block.offsets[1:] - size + 1, block.offsets[:-1])
        yield total.astype(np.int64) + (family << BITS), np.stack([np.minimum(block.offsets[:-1], n), np.minimum(stops, n)])


def _spans(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (bounds[0], bounds[1]) if bounds.ndim == 2 else (bounds[:-1], bounds[1:])


def score_block(block: Block, weights: np.ndarray, bias: float) -> np.ndarray:
    """Linear score of every text: the mean weight of its n-grams, summed over the families."""
    z = np.full(block.count, bias)
    for index, bounds in ngrams(block):
        total = np.zeros(len(index) + 1)
        np.cumsum(weights[index], out=total[1:])
        starts, stops = _spans(bounds)
        z += (total[stops] - total[starts]) / np.maximum(stops - starts, 1)
    return z


def features(texts: list[str]) -> linear.Sparse:
    """The same n-grams as mean counts, for training."""
    rows, index, value = [], [], []
    for block in blocks(pa.array(texts, pa.string())):
        for ids, bounds in ngrams(block):
            starts, stops = _spans(bounds)
            sizes = stops - starts
            owner = np.repeat(np.arange(block.count), sizes)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
            found = linear.sparse(owner, ids[at], (1 / np.maximum(sizes, 1))[owner], block.count, WIDTH)
            rows.append((found.rows + block.first).astype(np.int32))
            index.append(found.index.astype(np.int32))
            value.append(found.value.astype(np.float32))
    if not rows:
        return linear.Sparse(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64))
    # Every text and family is summed already, so ordering by text is all that is left to do.
    owner = np.concatenate(rows)
    order = np.argsort(owner, kind="stable").astype(np.int32)
    bounds = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return linear.Sparse(np.concatenate(index)[order], np.concatenate(value)[order], bounds)


def train(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, and the calibration fitted on every fourth row, which the weights have not seen."""
    if len(set(y.tolist())) < 2:
        return np.zeros(WIDTH), 0.0, 1.0, 2.0 if not len(y) or y[0] else -2.0
    x = features(texts)
    own = linear.half(y)
    # Rows that are left out have no weight, so the features need no second copy.
    w, bias = linear.fit(x, y, np.where(own, linear.balanced(y), 0.0), WIDTH)
    held = np.flatnonzero(~own)
    a, b = linear.platt((x.dot(w) + bias)[held], y[held])
    return w, bias, a, b


def _score(batch: pa.RecordBatch, model: tuple) -> Iterator[dict]:
    w, bias, a, b = model
    for block in blocks(batch.column("text"), lower=False):
        n_words = np.diff(block.bounds)
        inside = np.zeros(len(block.data) + 1, np.int64)
        np.add.at(inside, block.starts, 1)
        np.add.at(inside, block.ends, -1)
        letters = (np.cumsum(inside[:-1]) > 0) & ((block.data & 0xC0) != 0x80)
        repeated = repeated_words(block)
        failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
        p = linear.sigmoid(a * score_block(block, w, bias) + b)
        yield {
            "doc_id": batch.column("doc_id").slice(block.first, block.count), "n_words": n_words,
            "word_chars": _per_text(letters, block.offsets), "n_symbols": _per_text(_IS_SYMBOL[block.data], block.offsets),
            "n_dup_lines": duplicate_lines(block), "n_repeat_words": repeated, "base_failed": failed,
            "kept": ~failed & (p >= MIN_PROBABILITY), "quality": p,
        }


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict and calibrated quality of every row of ``docs``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality. The regression is fitted on at most
    ``samples.ROWS_PER_CLASS`` labelled rows of each class; all texts are scored in
    Arrow batches, whole. A null or empty text has no words and fails. Repeated
    rows and null ids come back as they are. Without labels of both classes the
    one class decides (none: all pass).
    """
    spark = prepared(docs.sparkSession)
    sample = labelled(docs, labels, "quality")
    model = train(sample["text"].tolist(), sample["label"].to_numpy())
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    rows = rows.withColumn("doc_id", rows["doc_id"].cast("long"))
    return over_batches(rows, _score, SCORED, lambda: shared.value)
