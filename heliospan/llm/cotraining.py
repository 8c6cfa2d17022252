"""Quality by co-training: a text classifier and a page-metadata classifier teach each other."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospan.llm import linear
from heliospan.llm.common import list_array, materialize, over_batches, prepared
from heliospan.llm.samples import labelled
from heliospan.llm.words import mix

ROUNDS = 3
# Rows of each class that a view labels per round: the most confident of every source of the corpus, in turn.
PER_ROUND = 100
CONFIDENT = 0.95
MIN_PROBABILITY = 0.5
TEXT_BITS = 15
META_WIDTH = 1 << 13
META = ("lang", "source", "n_chars", "url", "html_bytes")

PART = "doc_id BIGINT, lang STRING, source STRING, n_chars BIGINT, text_z DOUBLE"
VIEWED = "doc_id BIGINT, mark BIGINT, source STRING, z DOUBLE"
FEATURES = "doc_id BIGINT, mark BIGINT, index ARRAY<BIGINT>, value ARRAY<DOUBLE>"
SCORED = "doc_id BIGINT, text_score DOUBLE, meta_score DOUBLE, score DOUBLE, kept BOOLEAN"


@dataclass
class View:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: linear.Sparse) -> np.ndarray:
        return np.clip(self.slope * (x.dot(self.weights) + self.bias) + self.offset, -8, 8)


@dataclass
class Model:
    text: View
    meta: View
    prior: float  # log odds of a good document, counted in both views


@dataclass
class Unlabelled:
    """All documents with an id and a text; ``labelled`` ids are left out of what is chosen.

    Of repeated ids with different texts that with the smallest mark counts.
    """

    texts: DataFrame  # doc_id, mark, source, text
    metadata: DataFrame  # doc_id, mark and META
    labelled: DataFrame  # doc_id

    def confident(self, i: int, view: View, taken: list[int]) -> dict[int, int]:
        """Ids that view ``i`` labels, with their labels: the most confident ones of every source, in turn."""
        shared = self.texts.sparkSession.sparkContext.broadcast(view)
        scores = over_batches((self.texts, self.metadata)[i], (_text_view, _meta_view)[i], VIEWED, lambda: shared.value)
        sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        scores = scores.join(self.labelled, "doc_id", "left_anti").groupBy("doc_id").agg(
            F.min(F.struct("mark", "source", "z")).alias("row")).select("doc_id", "row.source", "row.z")
        scores = scores.filter((F.abs("z") >= sure) & ~F.col("doc_id").isin(taken)).select(
            "doc_id", "source", (F.col("z") > 0).cast("int").alias("label"), F.abs("z").alias("sure"))
        order = (F.desc("sure"), F.xxhash64(F.lit("pool"), "doc_id"), "doc_id")
        scores = scores.withColumn("turn", F.row_number().over(Window.partitionBy("label", "source").orderBy(*order)))
        scores = scores.filter(F.col("turn") <= PER_ROUND)
        scores = scores.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("turn", *order)))
        rows = scores.filter(F.col("place") <= PER_ROUND).select("doc_id", "label").collect()
        return {r.doc_id: r.label for r in sorted(rows)}

    def features(self, i: int, chosen: dict[int, int]) -> tuple[linear.Sparse, list[int]]:
        """Features of view ``i`` of the chosen rows, and their ids."""
        rows = (self.texts, self.metadata)[i].filter(F.col("doc_id").isin(list(chosen)))
        found = (over_batches(rows, _text_rows, FEATURES) if i == 0 else rows).toPandas()
        found = found.sort_values(["doc_id", "mark"]).drop_duplicates("doc_id")
        ids = found["doc_id"].tolist()
        if i == 1:
            return meta_features(found), ids
        sizes = [len(x) for x in found["index"]]
        return linear.Sparse(np.concatenate(found["index"].tolist()).astype(np.int64),
                             np.concatenate(found["value"].tolist()), np.cumsum([0, *sizes])), ids


def _text_view(batch: pa.RecordBatch, view: View) -> Iterator[dict]:
    yield {c: batch.column(c) for c in ("doc_id", "mark", "source")} | {"z": view.logit(text_features(batch.column("text")))}


def _meta_view(batch: pa.RecordBatch, view: View) -> Iterator[dict]:
    z = view.logit(meta_features(batch.to_pandas()))
    yield {c: batch.column(c) for c in ("doc_id", "mark", "source")} | {"z": z}


def _text_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    x = text_features(batch.column("text"))
    yield {c: batch.column(c) for c in ("doc_id", "mark")} | {
        "index": list_array(x.index, x.bounds), "value": list_array(x.value, x.bounds)}


def text_features(texts: pa.Array) -> linear.Sparse:
    """Mean counts of hashed words and of neighbouring bytes, of whole texts; numbers of a fixed width."""
    from heliospan.llm.words import blocks

    rows, index, value, width, count = [], [], [], 2 << TEXT_BITS, 0
    for block in blocks(texts):
        bounds = block.bounds
        data = block.data.astype(np.int64)
        pairs = (data[:-1] << 8 | data[1:]) & ((1 << TEXT_BITS) - 1)
        inner = block.offsets
        owner = np.searchsorted(inner, np.arange(len(pairs)), "right") - 1
        whole = np.arange(len(pairs)) + 1 < inner[owner + 1] if len(pairs) else np.zeros(0, bool)
        for ids, own in (
            ((block.hashes & np.uint64((1 << TEXT_BITS) - 1)).astype(np.int64), block.text),
            (pairs[whole] + (1 << TEXT_BITS), owner[whole]),
        ):
            sizes = np.bincount(own, minlength=block.count)
            found = linear.sparse(own, ids, 1 / np.maximum(sizes, 1)[own], block.count, width)
            rows.append(found.rows + count)
            index.append(found.index)
            value.append(found.value)
        count += len(bounds) - 1
    if not rows:
        return linear.Sparse(np.zeros(0, np.int64), np.zeros(0), np.zeros(count + 1, np.int64))
    return linear.sparse(np.concatenate(rows), np.concatenate(index), np.concatenate(value), count, width)


def _slot(name: str) -> int:
    total = np.uint64(1469598103934665603)
    for b in name.encode():
        total = mix(np.array([total ^ np.uint64(b)], np.uint64))[0]
    return int(total % np.uint64(META_WIDTH))


def meta_features(rows: pd.DataFrame) -> linear.Sparse:
    """Indicators of language, source, size classes, and of the parts of the page's address."""
    index, bounds, cache = [], [0], {}
    for lang, source, n_chars, url, html in zip(*(rows[c] for c in META)):
        names = [f"lang={lang}", f"source={source}", f"chars={_size(n_chars)}", f"html={_size(html)}"]
        address = re.match(r"(\w+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", url) if isinstance(url, str) else None
        if address:
            scheme, host, path, query, anchor = address.groups()
            names += [f"scheme={scheme}", f"host={host}", f"top={host.rpartition('.')[2]}", f"depth={path.count('/')}",
                      f"query={bool(query)}", f"anchor={bool(anchor)}"]
        else:
            names.append("no page")
        for name in names:
            if name not in cache:
                cache[name] = _slot(name)
            index.append(cache[name])
        bounds.append(len(index))
    return linear.Sparse(np.array(index, np.int64), np.full(len(index), 0.25), np.array(bounds))


def _size(value: object) -> int:
    return int(np.log2(value)) if value is not None and value == value and value >= 1 else -1


def _joined(parts: list[linear.Sparse]) -> linear.Sparse:
    sizes = np.concatenate([np.diff(x.bounds) for x in parts])
    return linear.Sparse(np.concatenate([x.index for x in parts]), np.concatenate([x.value for x in parts]),
                         np.concatenate([[0], np.cumsum(sizes)]))


def train(sample: pd.DataFrame, unlabelled: Unlabelled) -> Model:
    """Rounds of co-training on the labelled sample and all unlabelled documents.

    Every fourth labelled row is left out of all rounds and calibrates both views.
    In a round each view is fitted on the labelled rows and on the rows that the
    other view has labelled so far. Between rounds each view scores all unlabelled
    documents and labels up to ``PER_ROUND`` of each class of which it is most
    confident; only the features of these rows are collected.
    """
    y = sample["label"].to_numpy(float)
    own = linear.half(y)
    fit, held = np.flatnonzero(own), np.flatnonzero(~own)
    text_width = 2 << TEXT_BITS
    if len(set(y[fit].tolist())) < 2:
        odds = 2.0 if not len(y) or y[0] else -2.0
        return Model(View(np.zeros(text_width), odds), View(np.zeros(META_WIDTH), odds), odds)
    views = [text_features(pa.array(sample["text"], pa.string())), meta_features(sample)]
    widths = (text_width, META_WIDTH)
    given: list[list[linear.Sparse]] = [[], []]  # features of the rows that view i learns from the other view
    goals: list[list[np.ndarray]] = [[], []]
    taken: list[list[int]] = [[], []]  # ids that view i has labelled
    fitted: list[View] = []
    for turn in range(ROUNDS):
        fitted = []
        for i in range(2):
            x = _joined([views[i].take(fit), *given[i]])
            goal = np.concatenate([y[fit], *goals[i]])
            w, b = linear.fit(x, goal, linear.balanced(1 - goal), widths[i], steps=100)
            view = View(w, b)
            view.slope, view.offset = linear.platt(views[i].take(held).dot(w) + b, y[held])
            fitted.append(view)
        for i in range(2) if turn < ROUNDS - 1 else ():
            chosen = unlabelled.confident(i, fitted[i], taken[i])
            if len(chosen):
                found, ids = unlabelled.features(1 - i, chosen)
                given[1 - i].append(found)
                goals[1 - i].append(np.array([chosen[d] for d in ids], float))
                taken[i] += list(chosen)
    share = (y[held].sum() + 1) / (len(held) + 2)
    return Model(fitted[0], fitted[1], float(np.log(share / (1 - share))))


def page_metadata(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``docs`` with url and html_bytes of the page of the same number; pages repeated under one number count once."""
    page = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.struct(
        "url", F.octet_length("html").cast("long").alias("html_bytes")).alias("page"))
    page = page.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("page").alias("page"))
    return docs.join(page, "doc_id", "left").select("*", "page.url", "page.html_bytes").drop("page")


def _text_part(batch: pa.RecordBatch, model: Model) -> Iterator[dict]:
    z = model.text.logit(text_features(batch.column("text")))
    yield {c: batch.column(c) for c in ("doc_id", "lang", "source", "n_chars")} | {"text_z": z}


def _combine(batch: pa.RecordBatch, model: Model) -> Iterator[dict]:
    rows = batch.to_pandas()
    text_z, meta_z = rows["text_z"].to_numpy(), model.meta.logit(meta_features(rows))
    score = linear.sigmoid(text_z + meta_z - model.prior)
    yield {
        "doc_id": batch.column("doc_id"), "text_score": linear.sigmoid(text_z), "meta_score": linear.sigmoid(meta_z),
        "score": score, "kept": score >= MIN_PROBABILITY,
    }


def quality(docs: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept for every row of ``docs``.

    The views are independent given the class, so their calibrated log odds add up,
    less the log odds that both contain. Fitted on at most
    ``samples.ROWS_PER_CLASS`` labelled rows of each class; pseudo-labels are sought
    in all unlabelled documents. All documents are scored on whole texts. A document without a
    page is scored on its other metadata; null metadata are values of their own. A
    null text has no words, so its text view is the bias. Repeated rows and null
    ids come back as they are. Without labels of both classes the one class
    decides (none: all pass).
    """
    spark = prepared(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
    metadata = known.select("doc_id", "mark", "lang", "source", "n_chars").join(seen, "doc_id", "left_anti")
    unlabelled = Unlabelled(known.select("doc_id", "mark", "source", "text"),
                            materialize(page_metadata(metadata, pages), "metadata"), seen)
    sample = labelled(rows, labels, "quality", extra=("lang", "source", "n_chars"))
    ids = spark.createDataFrame(sample[["doc_id"]].astype("int64"), "doc_id BIGINT")
    address = page_metadata(ids, pages).toPandas()
    sample = sample.merge(address, on="doc_id", how="left")
    shared = spark.sparkContext.broadcast(train(sample, unlabelled))
    part = over_batches(rows, _text_part, PART, lambda: shared.value)
    return over_batches(page_metadata(part, pages), _combine, SCORED, lambda: shared.value)
