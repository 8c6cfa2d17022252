"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospan.llm import superminhash
from heliospan.llm.common import (
    filter_slot, fresh_name, id_filter, list_array, materialize, maybe_in, over_batches, prepared,
)
from heliospan.llm.components import components
from heliospan.llm.linking import bit_columns, link_classes, parity_columns, similar
from heliospan.llm.words import blocks, mix, shingle_sets

# 64 bands of 7 slots miss a pair at a similarity of 0.75 with a chance of about (1 - 0.75^7)^64 = 1e-4, and one at
# 0.8 with 3e-7. Two signatures of that similarity have 224 of 256 equal bits on average, with a deviation of 5.3.
BANDING = superminhash.Banding(slots=256, bands=64, rows=7, agree=200, parity=1024)

MARKS = bit_columns(BANDING) + parity_columns(BANDING)
SKETCH = "doc_id BIGINT, n_shingles BIGINT, h1 BIGINT, h2 BIGINT, bands ARRAY<BIGINT>, " + ", ".join(
    f"{c} BIGINT" for c in MARKS)
SETS = "doc_id BIGINT, n_shingles BIGINT, h1 BIGINT, h2 BIGINT, items ARRAY<BIGINT>"
SAME = ["n_shingles", "h1", "h2"]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block in blocks(batch.column("text")):
        values, bounds = shingle_sets(block.hashes, block.text, block.count)
        yield block.first, values, bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes of every set: with its size, equal for equal sets."""
    sums = []
    for seed in (1, 2):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values + np.uint64(seed)), out=total[1:])
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums


def _sketches(batch: pa.RecordBatch) -> Iterator[dict]:
    for first, values, bounds in _sets(batch):
        count = len(bounds) - 1
        signature = superminhash.signatures(values, bounds, BANDING.slots)
        bits = np.hstack([BANDING.bits(signature), BANDING.parities(values, bounds)])
        sums = _sums(values, bounds)
        yield {
            "doc_id": batch.column("doc_id").slice(first, count), "n_shingles": np.diff(bounds),
            "h1": sums[0], "h2": sums[1],
            "bands": list_array(BANDING.keys(signature).reshape(-1), np.arange(count + 1) * BANDING.bands),
        } | {c: bits[:, i] for i, c in enumerate(MARKS)}


def _full_sets(batch: pa.RecordBatch, wanted: np.ndarray) -> Iterator[dict]:
    batch = batch.filter(pa.array(maybe_in(wanted, batch.column("slot").to_numpy(zero_copy_only=False))))
    for first, values, bounds in _sets(batch) if batch.num_rows else ():
        h1, h2 = _sums(values, bounds)
        yield {
            "doc_id": batch.column("doc_id").slice(first, len(bounds) - 1), "n_shingles": np.diff(bounds), "h1": h1, "h2": h2,
            "items": list_array(values.view(np.int64), bounds),
        }


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (u, v) pairs of classes whose full shingle sets are similar; sets are made for their documents only."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    wanted = classes.join(nodes, "node", "left_semi").select("doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, filter_slot("doc_id")))
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", filter_slot("doc_id").alias("slot"))
    sets = over_batches(texts, _full_sets, SETS, lambda: shared.value).withColumnRenamed("n_shingles", "n")
    sets = sets.join(classes.withColumnRenamed("n_shingles", "n"), ["doc_id", "n", "h1", "h2"]).dropDuplicates(["node"])
    sets = materialize(sets.select("node", "n", "items"), "sets")
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("items").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("items").alias("sv"))
    return pairs.join(left, "u").join(right, "v").filter(similar("su", "sv", "nu", "nv")).select("u", "v")


def _classes(filled: DataFrame) -> DataFrame:
    """Classes of equal sets: ``doc_id`` (the smallest) and ``node``, a number of its own.

    That is the doc_id, or a hash where a repeated doc_id is the smallest of several classes.
    """
    found = filled.groupBy(*SAME).agg(F.min("doc_id").alias("doc_id"))
    shared = found.groupBy("doc_id").agg(F.count("*").alias("_classes")).filter("_classes > 1")
    node = F.when(F.col("_classes").isNull(), F.col("doc_id")).otherwise(F.xxhash64(*SAME))
    return found.join(shared, "doc_id", "left").select("doc_id", *SAME, node.alias("node"))


def _smallest_ids(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """Smallest doc_id, as ``low``, for the documents whose component holds a node that is no doc_id; mostly none."""
    hashed = classes.filter("node <> doc_id").select("node")
    odd = whole.join(hashed, "node", "left_semi").select("component").distinct()
    members = whole.join(odd, "component", "left_semi").join(hashed, "node", "left_anti")
    low = members.groupBy("component").agg(F.min("node").alias("low"))
    return members.join(low, "component").select(F.col("node").alias("doc_id"), "low")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    doc_id reachable over links), kept (it is that document). Documents with the
    same set are one class from the start, so copies never meet in pairs; classes
    are linked by ``link_classes`` and grouped by union-find.

    An empty or null text has no shingles and links with nothing. A row without
    doc_id is returned with a null component_id and is kept. Rows that repeat a
    doc_id share one component; repeated with different texts, each text links on its
    own and all of them join the id's component. Extra columns are not read.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(over_batches(rows, _sketches, SKETCH), "sketches")
    filled = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(_classes(filled), "classes")
    members = filled.select("doc_id", *SAME).join(classes.drop("doc_id"), SAME).select("doc_id", "node")
    sketched = filled.join(classes, ["doc_id", *SAME]).drop("doc_id")
    sketched = sketched.withColumnsRenamed({"node": "rep", "n_shingles": "n"})
    links = link_classes(sketched, BANDING, lambda pairs: _verified(rows, classes, pairs))
    same_set = members.filter("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    whole = materialize(components(links.unionByName(same_set)), "whole")
    low = _smallest_ids(whole, classes)
    placed = sketch.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("low", "component", "doc_id")
    return placed.join(low, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """Documents, one row of each group of near duplicates; all columns stay, rows without an id too.

    Of rows that repeat the id that stays, the one whose columns hash lowest is kept.
    Only those rows are compared; the others pass without a shuffle of their texts by id.
    """
    dropped = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_dropped_id")).distinct()
    rest = docs.join(dropped, docs["doc_id"] == dropped["_dropped_id"], "left_anti")
    ids = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_repeated_id")).agg(F.count("*").alias("_n"))
    repeated = materialize(ids.filter("_n > 1").select("_repeated_id"), "repeated")
    same = rest["doc_id"] == F.col("_repeated_id")
    place = fresh_name(docs, "_place")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), *[F.col(c) for c in docs.columns])
    once = rest.join(repeated, same, "left_semi").withColumn(place, F.row_number().over(order))
    return rest.join(repeated, same, "left_anti").unionByName(once.filter(F.col(place) == 1).drop(place))
