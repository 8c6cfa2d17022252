"""Links between classes of equal sets: bucket stars first, then what is left across components."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospan.llm.common import materialize
from heliospan.llm.components import components
from heliospan.llm.superminhash import Banding

MIN_PERCENT = 75
DRAWN_HUBS = 3


def similar(a: str, b: str, na: str, nb: str) -> Column:
    """Intersection is at least MIN_PERCENT of the union, on the full sets."""
    common = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * common >= MIN_PERCENT * (F.col(na) + F.col(nb) - common)


def bit_columns(banding: Banding) -> list[str]:
    return [f"bits{i}" for i in range(banding.words)]


def parity_columns(banding: Banding) -> list[str]:
    return [f"parity{i}" for i in range(banding.parity // 64)]


def _differing(columns: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [
        F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in columns])


def _plausible(banding: Banding, a: str, b: str) -> Column:
    """Sizes, signature bits and parities of prefixes ``a`` and ``b`` allow a similarity of MIN_PERCENT.

    Sets of that similarity differ in at most (100 - MIN_PERCENT) / (100 + MIN_PERCENT) of
    the sum of their sizes, and parities differ in no more places: that test loses nothing.
    """
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    sizes = 100 * F.least(na, nb) >= MIN_PERCENT * F.greatest(na, nb)
    signature = _differing(bit_columns(banding), a, b) <= banding.slots - banding.agree
    odd = _differing(parity_columns(banding), a, b)
    return sizes & signature & ((100 + MIN_PERCENT) * odd <= (100 - MIN_PERCENT) * (na + nb))


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])


def link_classes(classes: DataFrame, banding: Banding, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links (u, v) that join all similar classes into their components.

    ``classes`` has rep, n (set size), bands, the bit and the parity columns; a class may
    stand in several rows, and counts once in a bucket. Every class is compared with the
    smallest class it shares a bucket with, then with the smallest and ``DRAWN_HUBS`` drawn
    ones of each bucket that are in another component. Last, in buckets that still hold
    several components, the members outside the largest one are compared with
    members of other components. A pair in one component is never compared again,
    so a group of near copies costs a few comparisons each. Sizes, signature bits
    and parities are tested inside the join, so pairs that merely share a passage are
    not made into rows. ``verified`` keeps the pairs that are similar on full sets.
    """
    marks = bit_columns(banding) + parity_columns(banding)
    entries = classes.select("rep", F.explode("bands").alias("key"))
    bucket = Window.partitionBy("key")
    entries = entries.select("key", "rep", F.min("rep").over(bucket).alias("hub"), F.max("rep").over(bucket).alias("top"))
    crowded = materialize(entries.filter("hub < top").select("key", "rep", "hub").distinct(), "crowded")
    facts = classes.select("rep", "n", *marks).join(crowded.select("rep").distinct(), "rep", "left_semi")
    facts = materialize(facts.dropDuplicates(["rep"]), "facts")

    def plausible(pairs: DataFrame) -> DataFrame:
        both = pairs.join(_prefixed(facts, "a_"), F.col("u") == F.col("a_rep")).join(
            _prefixed(facts, "b_"), F.col("v") == F.col("b_rep"))
        return materialize(both.filter(_plausible(banding, "a_", "b_")).select("u", "v"), "pairs")

    def placed(links: DataFrame) -> DataFrame:
        found = materialize(components(links), "components")
        return crowded.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", "hub", F.coalesce("component", "rep").alias("part"))

    # One comparison per class, with the smallest class of all its buckets.
    first = crowded.filter("rep <> hub").groupBy("rep").agg(F.min("hub").alias("hub"))
    links = materialize(verified(plausible(first.select(F.col("hub").alias("u"), F.col("rep").alias("v")))), "links")
    # Then with the smallest class and the drawn ones of each bucket, where these are in another component.
    now = placed(links)
    tops = now.filter("rep = hub").select("key", F.col("part").alias("top_part")).distinct()
    stars = now.filter("rep <> hub").join(tops, "key").filter("part <> top_part")
    stars = stars.select(F.col("hub").alias("u"), F.col("rep").alias("v"))
    # The smallest class of a group is the hub of most of its buckets, so others are drawn, in each bucket anew.
    draws = now.select("key", "rep", "part", F.explode(F.array(*map(F.lit, range(DRAWN_HUBS)))).alias("draw"))
    drawn = draws.groupBy("key", "draw").agg(F.min(F.struct(
        F.xxhash64("key", "draw", "rep").alias("order"), "rep", "part")).alias("top"))
    drawn = now.join(drawn.select("key", "top.rep", "top.part").toDF("key", "top", "top_part"), "key").filter("part <> top_part")
    stars = stars.unionByName(drawn.select(F.least("top", "rep").alias("u"), F.greatest("top", "rep").alias("v"))).distinct()
    links = materialize(links.unionByName(verified(plausible(stars))), "links")
    # Then, in buckets that still hold several components, across these.
    now = placed(links)
    parts = now.groupBy("key", "part").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(
        F.count("*").alias("parts"), F.max(F.struct("size", "part"))["part"].alias("main")).filter("parts > 1")
    mixed = materialize(now.join(mixed.select("key", "main"), "key").filter("rep <> hub").join(facts, "rep"), "mixed")
    outside = _prefixed(mixed.filter("part <> main"), "a_")
    across = outside.join(_prefixed(mixed, "b_"), (F.col("a_key") == F.col("b_key")) & (
        F.col("a_part") != F.col("b_part")) & _plausible(banding, "a_", "b_"))
    across = across.select(F.least("a_rep", "b_rep").alias("u"), F.greatest("a_rep", "b_rep").alias("v")).distinct()
    return links.unionByName(verified(materialize(across, "pairs")))
