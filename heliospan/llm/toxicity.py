"""Toxicity scores of whole texts from a bidirectional gated recurrent network over overlapping windows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan.llm import linear, recurrent, samples
from heliospan.llm.common import over_batches, prepared
from heliospan.llm.words import LOWER, Block, blocks, buffers, span_hashes, split_words

WINDOW = 32
STRIDE = 16
VOCABULARY = 20_000
MIN_TEXTS = 5
EPOCHS = 4
MIN_STEPS = 160
BATCH = 128
THRESHOLD = 0.5
SCORES = "doc_id BIGINT, score DOUBLE"


@dataclass
class Model:
    params: recurrent.Params
    hashes: np.ndarray  # sorted word hashes of the vocabulary; row i + 1 of the word vectors
    slope: float
    offset: float


def word_table(block: Block, hashes: np.ndarray) -> tuple[recurrent.Words, np.ndarray]:
    """The distinct words of a block and the number of every word."""
    distinct, first, number = np.unique(block.hashes, return_index=True, return_inverse=True)
    at = np.searchsorted(hashes, distinct)
    known = at < len(hashes)
    known[known] = hashes[at[known]] == distinct[known]
    starts, sizes = block.starts[first], (block.ends - block.starts)[first]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at_byte = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(starts, sizes)
    here = LOWER[block.data[at_byte]].astype(np.uint32) if len(at_byte) else np.zeros(0, np.uint32)
    left, right = np.zeros_like(here), np.zeros_like(here)
    left[1:], right[:-1] = here[:-1], here[1:]
    left[bounds[:-1][sizes > 0]] = 0
    right[bounds[1:][sizes > 0] - 1] = 0
    triples = ((here | left << np.uint32(8) | right << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(
        32 - recurrent.CHAR_BITS)
    return recurrent.Words(np.where(known, at + 1, 0), triples.astype(np.int64), bounds), number


def windows(block: Block, number: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of every text: word numbers, sizes, text. A text without words has one empty window."""
    bounds = block.bounds
    n = np.diff(bounds)
    each = np.maximum(-(-(n - WINDOW) // STRIDE) + 1, 1)
    text = np.repeat(np.arange(block.count), each)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    sizes = np.minimum(n[text] - turn * STRIDE, WINDOW)
    at = (bounds[text] + turn * STRIDE)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < sizes[:, None]
    padded = np.append(number, distinct).astype(np.int32)
    return padded[np.where(inside, at, len(number))], sizes, text


def _log_odds(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary of the words in ``MIN_TEXTS`` or more texts, by how much their counts tell, and their shrunken log odds."""
    seen = []
    for block in blocks(pa.array(texts, pa.string())):
        bounds = block.bounds
        for i in range(block.count):
            own = np.unique(block.hashes[bounds[i]:bounds[i + 1]])
            seen.append((own, np.full(len(own), y[block.first + i], np.int8)))
    words = np.concatenate([w for w, _ in seen]) if seen else np.zeros(0, np.uint64)
    marks = np.concatenate([m for _, m in seen]) if seen else np.zeros(0, np.int8)
    distinct, number = np.unique(words, return_inverse=True)
    ones = np.bincount(number, marks, len(distinct))
    zeros = np.bincount(number, 1 - marks, len(distinct))
    total = ones + zeros
    odds = np.log((ones + 1) / (y.sum() + 2)) - np.log((zeros + 1) / ((1 - y).sum() + 2))
    odds *= total / (total + 10)
    often = np.flatnonzero(total >= MIN_TEXTS)
    often = often[np.lexsort((distinct[often], -np.abs(odds[often])))][:VOCABULARY]
    often = np.sort(often)
    return distinct[often], np.clip(odds[often], -3, 3).astype(np.float32)


def train(texts: list[str], y: np.ndarray, seed: int = 9) -> Model:
    """Fit the network on documents: a document's label is that of its highest window.

    Every epoch scores all windows, takes the highest one of each document and one
    more at random of each clean document, and steps over them in small batches.
    Every fourth document is left out of the fit and calibrates the scores.
    """
    own = linear.half(y)
    fit_rows = np.flatnonzero(own)
    hashes, odds = _log_odds([texts[i] for i in fit_rows], y[fit_rows])
    params = recurrent.initial(np.append(np.float32(0), odds), seed)
    model = Model(params, hashes, 1.0, 0.0)
    if len(set(y[fit_rows].tolist())) < 2:
        model.slope, model.offset = 0.0, (2.0 if len(y) and y[0] else -2.0)
        return model
    # All windows of the sample over one table of words.
    whole = _joined(texts)
    words, number = word_table(whole, hashes)
    rows, sizes, text = windows(whole, number, len(words.vocabulary))
    random = np.random.default_rng(seed)
    adam = recurrent.Adam(params)
    firsts = np.searchsorted(text, np.arange(len(texts)))
    counts = np.diff(np.append(firsts, len(text)))
    lift = float(np.sqrt(max((1 - y[fit_rows]).sum(), 1) / max(y[fit_rows].sum(), 1)))
    in_fit = own[text]
    per_epoch = -(-(len(fit_rows) + int((y[fit_rows] == 0).sum())) // BATCH)
    epochs = max(EPOCHS, -(-MIN_STEPS // per_epoch))
    for epoch in range(epochs):
        logits = np.full(len(text), -np.inf, np.float32)
        logits[in_fit] = recurrent.scores(params, words, rows[in_fit], sizes[in_fit])
        order = np.lexsort((-logits, text))
        top = order[firsts][fit_rows]
        clean = fit_rows[y[fit_rows] == 0]
        other = firsts[clean] + (random.random(len(clean)) * counts[clean]).astype(np.int64)
        chosen = np.concatenate([top, other])
        random.shuffle(chosen)
        adam.rate = 0.01 if epoch < epochs // 2 else 0.004
        for i in range(0, len(chosen), BATCH):
            part = chosen[i:i + BATCH]
            goal = y[text[part]].astype(np.float32)
            weight = np.where(goal > 0, lift, 1).astype(np.float32)
            adam.step(recurrent.gradients(params, words, rows[part], sizes[part], goal, weight))
    held = ~own[text]
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, text[held], recurrent.scores(params, words, rows[held], sizes[held]))
    model.slope, model.offset = linear.platt(top[~own].astype(float), y[~own])
    return model


def _joined(texts: list[str]) -> Block:
    """All texts of a bounded sample as one block, hashed in pieces."""
    data, offsets = buffers(pa.array(texts, pa.string()))
    starts, ends, text = split_words(data, offsets)
    return Block(0, data, offsets, starts, ends, text, span_hashes(data, starts, ends, True))


def text_scores(column: pa.Array, model: Model) -> np.ndarray:
    """Calibrated probability of every text: that of its highest window."""
    out = []
    for block in blocks(column):
        words, number = word_table(block, model.hashes)
        rows, sizes, text = windows(block, number, len(words.vocabulary))
        top = np.full(block.count, -np.inf, np.float32)
        np.maximum.at(top, text, recurrent.scores(model.params, words, rows, sizes))
        out.append(linear.sigmoid(model.slope * top.astype(float) + model.offset))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """True where CRC32 of the id as text is divisible by 5; these rows are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample, fitted in one task; the driver gets the model alone."""
    rows = samples.labelled_rows(docs, labels, "toxic", where=~held_out(F.col("doc_id"))).select("_order", "doc_id", "text", "label")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        if found:
            sample = samples.in_order(pd.concat(found))
            model = train(sample["text"].tolist(), sample["label"].to_numpy())
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = rows.repartition(1).mapInPandas(fit, "model BINARY").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, np.int64))


def _score(batch: pa.RecordBatch, model: Model) -> Iterator[dict]:
    yield {"doc_id": batch.column("doc_id"), "score": text_scores(batch.column("text"), model)}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from at most ``samples.ROWS_PER_CLASS`` labelled rows of each class that
    are not held out; only texts are inputs. All overlapping windows of a whole text
    are scored. A null or empty text is one empty window. Repeated rows and null
    ids come back as they are (a null id is not held out). Without labels of both
    classes the one class decides (none: nothing is toxic).
    """
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fitted(docs, labels))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    scored = over_batches(rows, _score, SCORES, lambda: shared.value)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic; all columns stay."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fitted(docs, labels))

    def keep(batch: pa.RecordBatch, model: Model) -> Iterator[dict]:
        clean = pa.array(text_scores(batch.column("text"), model) < THRESHOLD)
        kept = batch.filter(clean)
        yield {name: kept.column(i) for i, name in enumerate(kept.schema.names)}

    return over_batches(docs, keep, docs.schema, lambda: shared.value)
