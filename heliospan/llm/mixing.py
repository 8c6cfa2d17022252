"""Mixing sources to target weights by repeating documents. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospan.llm.common import WORD_PATTERN, fresh_name, materialize, prepared

SEED = 7
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 digest of seed and doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sized`` (source, size): source_size, target, rate.

    Sources in code point order, null last, take the weights in turn. A target is
    the share of all sizes by weight, at most ``repeats`` times the source's own
    size; what is above is shared again by weight among the rest. Filling all
    sources to one level, the source with the smallest ratio of cap to weight is
    full first, so a running sum in that order finds the level at once. The two
    windows run over one row per source, not over documents.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    # The level is the one at the first source that it does not fill; before it every source is full.
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    each = each.withColumn("level", level).withColumn(
        "level", F.first(open_level, ignorenulls=True).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(zero)
    return each.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def with_copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies of every row, as struct column ``mix``.

    copies is floor(rate) plus one more when the document's own draw is below the
    fraction of the rate; the draw depends on seed and doc_id only, so reruns
    agree and rows that repeat a doc_id are taken alike. A null text has size 0.
    A source without words has rate 0. The source table is joined null-safe; a hot
    source is split by the skew join.
    """
    prepared(docs.sparkSession)
    size, key = fresh_name(docs, "_size"), fresh_name(docs, "_key")
    sized = docs.withColumn(size, word_count(F.col("text"))).withColumn(key, F.coalesce(
        F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    targets = materialize(source_targets(sized.select("source", F.col(size).alias("size"))), "targets")
    targets = targets.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias(key),
        F.struct("source_size", "target", "rate").alias("mix"))
    joined = sized.drop("mix").join(targets, key)
    rate = F.col("mix.rate")
    extra = (draw(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("int")
    mix = F.struct(
        F.col(size).alias("size"), F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"),
        (F.floor(rate).cast("int") + extra).alias("copies"))
    return joined.withColumn("mix", mix).drop(size, key)


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row: doc_id, size, source_size, target (of its source), taken.

    taken is size times copies, so at most three times the size. An empty table
    gives no rows. Extra columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    mix = with_copies(rows, seed)
    return mix.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents as the mix emits them: every row ``copies`` times, columns as in ``docs``."""
    rows = docs.withColumnRenamed("mix", fresh_name(docs, "_own_mix")) if "mix" in docs.columns else docs
    mix = with_copies(rows, seed)
    out = mix.withColumn("mix", F.explode(F.array_repeat(F.lit(1), F.col("mix.copies"))))
    return out.select(*rows.columns).toDF(*docs.columns)
