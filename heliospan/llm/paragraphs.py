"""Passages that repeat across documents: paragraph MinHash banding, verification, removal by components.

A paragraph is a line; it is compared as a set of five-word shingles. Its sentences
are paragraphs too, compared as wholes. Passages inside longer lines are found by
their runs of words, wherever lines and sentences begin: spans of ``SPAN`` words at
local minima of their hashes, then every span around those that stand twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospan.llm import superminhash
from heliospan.llm.common import (
    FILTER_BITS, discard_written, id_filter, list_array, materialize, maybe_in, over_batches, prepared, shuffles_cleared,
)
from heliospan.llm.components import components
from heliospan.llm.linking import bit_columns, link_classes, parity_columns, similar
from heliospan.llm.words import Block, blocks, mix, runs, shingle_sets

# 14 bands of 3 of 64 slots miss a pair at a similarity of 0.75 with a chance of (1 - 0.75^3)^14 = 5e-4. Such a pair
# has 56 of 64 equal bits on average, with a deviation of 2.6.
BANDING = superminhash.Banding(slots=64, bands=14, rows=3, agree=45, parity=512)
MIN_SENTENCE = 5  # words
MIN_BANDED = 12  # words; a shorter line is compared as a whole only
# Repeated paragraphs of a document with at most so many other words between them are one passage.
MAX_GAP = 6
MIN_PASSAGE = 16  # words
# Of every SPACING spans in a row the one with the smallest hash is an anchor, so equal runs of SPAN + SPACING - 1
# words have an anchor in common, whatever stands around them.
SPAN = 6  # words
SPACING = 7
# All spans so many words around a repeated anchor are compared: two edits with a short run between them are passed.
REACH = 24

UNITS = "doc_id BIGINT, start INT, n_words INT, mark BIGINT, banded BOOLEAN, line BOOLEAN"
MARKS = bit_columns(BANDING) + parity_columns(BANDING)
SKETCH = "mark BIGINT, doc_id BIGINT, n BIGINT, bands ARRAY<BIGINT>, " + ", ".join(f"{c} BIGINT" for c in MARKS)
SETS = "mark BIGINT, n BIGINT, items ARRAY<BIGINT>"
ANCHORS = "doc_id BIGINT, mark BIGINT"
SPANS = "doc_id BIGINT, start INT, mark BIGINT"
PLACES_AT_ONCE = 1 << 18
PLACES = ["doc_id", "removed", "start", "n_words", "component", "first_doc_id"]
PASSAGES = "doc_id BIGINT, start INT, n_words INT, removed BOOLEAN, cluster BIGINT, first_doc_id BIGINT"
ARROW_PASSAGES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("removed", pa.bool_()), ("cluster", pa.int64()),
    ("first_doc_id", pa.int64())])

_ENDS_SENTENCE = np.isin(np.arange(256), list(b".!?"))


def _cuts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the words that start a line, and of those that start a sentence."""
    n = len(block.starts)
    line = np.ones(n, bool)
    feeds = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(block.data == 10, out=feeds[1:])
    line[1:] = (feeds[block.starts[1:]] > feeds[block.starts[:-1]]) | (block.text[1:] != block.text[:-1])
    sentence = line.copy()
    sentence[1:] |= _ENDS_SENTENCE[block.data[block.ends[:-1] - 1]]
    return line, sentence


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(flags)
    return first, np.diff(np.append(first, len(flags)))


def _marks(block: Block, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit content hash of word spans: each word weighed by its place in the span."""
    if not len(first):
        return np.zeros(0, np.int64)
    place = np.arange(first[0], len(block.hashes)) - np.repeat(first, size)
    weighed = block.hashes[first[0]:] * (mix(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1))
    return mix(np.add.reduceat(weighed, first - first[0]) + size.astype(np.uint64)).view(np.int64)


def _units(batch: pa.RecordBatch) -> Iterator[dict]:
    for block in blocks(batch.column("text")):
        if not len(block.starts):
            continue
        line, sentence = _cuts(block)
        parts = []
        for flags, lines in ((line, True), (sentence, False)):
            first, size = _spans(flags)
            banded = np.full(len(first), lines) & (size >= MIN_BANDED)
            # A sentence that is a whole line stands there once, as a line.
            keep = (size >= MIN_SENTENCE) if lines else (size >= MIN_SENTENCE) & ~(
                line[first] & np.append(line, True)[first + size])
            parts.append([x[keep] for x in (first, size, _marks(block, first, size), banded, np.full(len(first), lines))])
        first, size, mark, banded, line = (np.concatenate(x) for x in zip(*parts))
        text = block.text[first]
        yield {
            "doc_id": batch.column("doc_id").slice(block.first, block.count).take(pa.array(text)),
            "start": first - block.bounds[text], "n_words": size, "mark": mark, "banded": banded, "line": line,
        }


def _line_sets(block: Block, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content hash of the banded lines, their texts, and their shingle sets. Equal lines of a block count once."""
    line, _ = _cuts(block)
    first, size = _spans(line)
    at = np.flatnonzero(size >= MIN_BANDED)
    mark = _marks(block, first, size)[at]
    if keep is not None:
        found = maybe_in(keep, _slots(mark))
        at, mark = at[found], mark[found]
    _, once = np.unique(mark, return_index=True)
    once.sort()
    at, mark = at[once], mark[once]
    number = np.full(len(first), -1)
    number[at] = np.arange(len(at))
    owner = np.repeat(number, size)
    inside = owner >= 0
    values, bounds = shingle_sets(block.hashes[inside], owner[inside], len(at))
    return mark, block.text[first[at]], values, bounds


def _slots(mark: np.ndarray) -> np.ndarray:
    return mark & np.int64(FILTER_BITS - 1)


def _slot(column: str) -> Column:
    return F.col(column).bitwiseAND(FILTER_BITS - 1)


def _sketches(batch: pa.RecordBatch) -> Iterator[dict]:
    """Sketch of every banded line of a batch, once per content."""
    for block in blocks(batch.column("text")):
        if not len(block.starts):
            continue
        mark, text, values, bounds = _line_sets(block)
        signature = superminhash.signatures(values, bounds, BANDING.slots)
        bits = np.hstack([BANDING.bits(signature), BANDING.parities(values, bounds)])
        keys = BANDING.keys(signature)
        yield {
            "mark": mark, "doc_id": batch.column("doc_id").slice(block.first, block.count).take(pa.array(text)),
            "n": np.diff(bounds), "bands": list_array(keys.reshape(-1), np.arange(len(mark) + 1) * BANDING.bands),
        } | {c: bits[:, i] for i, c in enumerate(MARKS)}


def _full_sets(batch: pa.RecordBatch, wanted: tuple[np.ndarray, np.ndarray]) -> Iterator[dict]:
    """Full sets of the lines that pass the bitmap of contents, from the texts that pass the bitmap of ids."""
    marks, ids = wanted
    inside = maybe_in(ids, _slots(batch.column("doc_id").to_numpy(zero_copy_only=False)))
    for block in blocks(batch.column("text").filter(pa.array(inside))) if inside.any() else ():
        if len(block.starts):
            mark, _, values, bounds = _line_sets(block, marks)
            if len(mark):
                yield {"mark": mark, "n": np.diff(bounds), "items": list_array(values.view(np.int64), bounds)}


def _anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the span at every word, and the words where an anchor starts. A text's spans alone decide on its anchors."""
    marks = runs(block.hashes, SPAN)
    n = len(marks) - SPACING + 1
    if n <= 0:
        return marks.view(np.int64), np.zeros(0, np.int64)
    best, at = marks[SPACING - 1:].copy(), np.arange(n) + SPACING - 1
    for i in range(SPACING - 2, -1, -1):  # of equal ones the last
        less = marks[i:i + n] < best
        best[less] = marks[i:i + n][less]
        at[less] = np.flatnonzero(less) + i
    whole = block.text[:n] == block.text[SPAN + SPACING - 2:]
    return marks.view(np.int64), np.unique(at[whole])


def _anchor_marks(batch: pa.RecordBatch) -> Iterator[dict]:
    for block in blocks(batch.column("text")):
        marks, at = _anchors(block)
        if len(at):
            ids = batch.column("doc_id").slice(block.first, block.count)
            yield {"doc_id": ids.take(pa.array(block.text[at])), "mark": marks[at]}


def _spans_near(batch: pa.RecordBatch) -> Iterator[dict]:
    """All spans within ``REACH`` words of the ``wanted`` anchors that do not reach into lines that are ``gone``."""
    for block in blocks(batch.column("text")):
        wanted, gone_at = (batch.column(c).slice(block.first, block.count) for c in ("wanted", "gone"))
        marks, at = _anchors(block)
        # An anchor that stands twice does so for every text of the batch.
        at = at[np.isin(marks[at], wanted.flatten().to_numpy(zero_copy_only=False))]
        if not len(at):
            continue
        bounds, text = block.bounds, block.text[at]
        edge = np.zeros(len(block.hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(at - REACH, bounds[text]), 1)
        np.add.at(edge, np.minimum(at + REACH + 1, bounds[text + 1] - SPAN + 1), -1)
        first = np.flatnonzero(np.cumsum(edge) > 0)
        # Texts of one id may differ: a line of another one may start beyond the end, or inside a line.
        owner = np.repeat(np.arange(block.count), gone_at.value_lengths().to_numpy(zero_copy_only=False))
        place = bounds[owner] + gone_at.flatten().to_numpy(zero_copy_only=False)
        gone = np.zeros(len(block.hashes), bool)
        gone[place[place < bounds[owner + 1]]] = True
        line, _ = _cuts(block)
        in_gone = gone[np.maximum.accumulate(np.where(line, np.arange(len(line)), 0))]
        first = first[~in_gone[first] & ~in_gone[first + SPAN - 1]]
        text = block.text[first]
        yield {
            "doc_id": batch.column("doc_id").slice(block.first, block.count).take(pa.array(text)),
            "start": first - bounds[text], "mark": marks[first],
        }


def _repeated_spans(texts: DataFrame, removed: DataFrame) -> DataFrame:
    """Places of spans that stand twice, in two texts or ``MIN_PASSAGE`` words apart.

    Columns: doc_id, start, mark, and the first place as low. Only
    anchors that do stand twice are brought back to their texts, whatever the size of
    the corpus. Spans that reach into a removed line (doc_id, start) go with it: they
    neither count as copies nor are the one that stays.
    """
    anchors = over_batches(texts, _anchor_marks, ANCHORS)
    copies = F.count("*").over(Window.partitionBy("mark"))
    wanted = anchors.withColumn("copies", copies).filter("copies > 1").groupBy("doc_id").agg(F.collect_set("mark").alias("wanted"))
    wanted = materialize(wanted, "wanted")
    gone = removed.groupBy("doc_id").agg(F.collect_set("start").alias("gone"))
    near = texts.join(wanted, "doc_id").join(gone, "doc_id", "left").select(
        "doc_id", "text", "wanted", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    spans = materialize(over_batches(near, _spans_near, SPANS), "spans")
    discard_written(wanted)
    place, copies = F.struct("doc_id", "start"), Window.partitionBy("mark")
    spans = spans.repartition("mark").select(
        "doc_id", "start", "mark", F.min(place).over(copies).alias("low"), F.max(place).over(copies).alias("high"))
    return spans.filter((F.col("low.doc_id") < F.col("high.doc_id")) | (
        F.col("high.start") - F.col("low.start") >= MIN_PASSAGE)).drop("high")


def _merged(places: list[np.ndarray]) -> pa.RecordBatch:
    """Neighbouring paragraphs of whole documents, in any order, as passages."""
    doc, removed, start, size, component, first = places
    order = np.lexsort((component, start, removed, doc))
    doc, removed, start, size, component, first = (x[order] for x in (doc, removed, start, size, component, first))
    group = np.ones(len(doc), bool)
    group[1:] = (doc[1:] != doc[:-1]) | (removed[1:] != removed[:-1])
    # The largest end so far in each group: ends of later groups are lifted above those of earlier ones.
    lift = (np.cumsum(group) - 1) * (int((start + size).max()) + 1)
    stop = np.maximum.accumulate(start + size + lift) - lift
    opens = group.copy()
    opens[1:] |= start[1:] - stop[:-1] > MAX_GAP
    at = np.flatnonzero(opens)
    n_words = stop[np.append(at[1:], len(opens)) - 1] - start[at]
    keep = n_words >= MIN_PASSAGE
    found = (doc[at], start[at], n_words, removed[at].astype(bool), component[at], np.minimum.reduceat(first, at))
    return pa.RecordBatch.from_arrays(
        [pa.array(x[keep]).cast(f.type) for x, f in zip(found, ARROW_PASSAGES)], schema=ARROW_PASSAGES)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of a task's places, which come by document; at most ``PLACES_AT_ONCE`` and one document are held."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in PLACES])
        count += batch.num_rows
        if count < PLACES_AT_ONCE or held[0][0][0] == held[-1][0][-1]:
            continue
        places = [np.concatenate(x) for x in zip(*held)]
        last = places[0] == places[0][-1]
        yield _merged([x[~last] for x in places])
        held = [[x[last] for x in places]]
        count = len(held[0][0])
    if held:
        yield _merged([np.concatenate(x) for x in zip(*held)])


def _verified(texts: DataFrame, places: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of line contents that are similar on full shingle sets.

    ``places`` has a doc_id for every content (mark): only those texts are scanned again.
    """
    wanted = pairs.select(F.col("u").alias("mark")).unionByName(pairs.select(F.col("v").alias("mark")))
    wanted = materialize(places.join(wanted.distinct(), "mark").groupBy("mark").agg(F.min("doc_id").alias("doc_id")), "wanted-sets")
    shared = texts.sparkSession.sparkContext.broadcast((id_filter(wanted, _slot("mark")), id_filter(wanted, _slot("doc_id"))))
    sets = over_batches(texts, _full_sets, SETS, lambda: shared.value)
    sets = materialize(sets.join(wanted, "mark", "left_semi").dropDuplicates(["mark"]), "sets")
    left = sets.select(F.col("mark").alias("u"), F.col("n").alias("nu"), F.col("items").alias("su"))
    right = sets.select(F.col("mark").alias("v"), F.col("n").alias("nv"), F.col("items").alias("sv"))
    return pairs.join(left, "u").join(right, "v").filter(similar("su", "sv", "nu", "nv")).select("u", "v")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of ``docs`` that stand more than once, one row per place.

    Columns: doc_id, start and n_words (in words of the text), removed, cluster
    (content hash that stands for the component of the first paragraph),
    first_doc_id (smallest doc_id that holds a paragraph of the passage's
    components). A component's first paragraph by doc_id and place stays; all
    others are to be removed. Lines are similar at 0.75 or more on five-word
    shingles, or equal as wholes; sentences are equal as wholes, whatever the
    blanks between words and the case of A-Z. Inside longer lines, a run of
    ``SPAN + SPACING - 1`` equal words is found wherever it stands; from there equal
    spans of ``SPAN`` words extend it word by word, over edits up to ``MAX_GAP`` words
    long, and each is a paragraph of its own. Neighbouring repeated paragraphs are
    one passage; passages under ``MIN_PASSAGE`` words are no repetition. Spans in a
    removed line go with it, so the copy of a passage that stays is never one of those.

    Null or empty texts and null ids give no rows. A repeated row repeats its
    passages under the same doc_id. Extra columns are not read.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with shuffles_cleared(spark):
        places, lines_gone = _line_places(texts)
        spans = _repeated_spans(texts, lines_gone)
    places = places.select(*PLACES).unionByName(spans.select(
        "doc_id", ((F.col("doc_id") != F.col("low.doc_id")) | (F.col("start") != F.col("low.start"))).alias("removed"),
        "start", F.lit(SPAN).alias("n_words"), F.col("mark").alias("component"), F.col("low.doc_id").alias("first_doc_id")))
    # Join neighbouring paragraphs of a document into passages.
    return places.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_passages, PASSAGES)


def _line_places(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of repeated lines and sentences, and the lines (doc_id, start) to be removed."""
    units = materialize(over_batches(texts, _units, UNITS), "units")
    classes = materialize(over_batches(texts, _sketches, SKETCH).withColumnRenamed("mark", "rep"), "sketches")
    held = classes.select(F.col("rep").alias("mark"), "doc_id")
    links = link_classes(classes, BANDING, lambda pairs: _verified(texts, held, pairs))
    similar_marks = materialize(components(links).withColumnsRenamed({"node": "mark"}), "similar")
    discard_written(classes)

    counts = units.groupBy("mark").agg(
        F.count("*").alias("copies"), F.min(F.col("doc_id")).alias("low_id"))
    grouped = counts.join(similar_marks, "mark", "left").filter("copies > 1 OR component IS NOT NULL")
    grouped = materialize(grouped.select("mark", F.coalesce("component", "mark").alias("component"), "low_id"), "repeated")
    lowest = grouped.groupBy("component").agg(F.min("low_id").alias("first_doc_id"))
    grouped = materialize(grouped.select("mark", "component").join(lowest, "component"), "grouped")
    places = materialize(units.join(grouped, "mark").select("doc_id", "start", "n_words", "component", "first_doc_id"), "places")
    head = places.filter("doc_id = first_doc_id").groupBy("component").agg(F.min("start").alias("first_start"))
    places = places.join(head, "component")
    removed = (F.col("doc_id") != F.col("first_doc_id")) | (F.col("start") != F.col("first_start"))
    places = materialize(places.withColumn("removed", removed).drop("first_start"), "decided")
    # Sentences are decided with the lines; only whole lines take the spans in them along.
    lines_gone = places.filter("removed").join(
        units.filter("line").select("doc_id", "start", "n_words"), ["doc_id", "start", "n_words"], "left_semi")
    lines_gone = materialize(lines_gone.select("doc_id", "start").distinct(), "lines-gone")
    discard_written(units)
    return places, lines_gone
