"""Connected components of a link table, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospan.session import materialize

PAIR = "u BIGINT, v BIGINT"
FLUSH_LINKS = 1 << 20


def union_find(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Smallest member of the set of every node in ``links``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a task as stars, at most ``FLUSH_LINKS`` links held at a time."""

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        found = union_find((u, v) for p in held for u, v in zip(p.u.tolist(), p.v.tolist()))
        out = [(x, r) for x, r in found.items() if x != r]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= FLUSH_LINKS:
            yield stars(held)
            held, size = [], 0
    if held:
        yield stars(held)


def _lowest(links: DataFrame) -> DataFrame:
    """Every (u, v) with the smallest v of its u as ``m``.

    The minima are written first: both sides of the join are then plain exchanges,
    which the skew join can split at a hot u. Over an aggregate it could not.
    """
    return links.join(materialize(links.groupBy("u").agg(F.min("v").alias("m")), "lowest"), "u")


def _print_of(links: DataFrame) -> tuple:
    """Count and order-free sum of hashes, to see that a step changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of ``links`` (u, v).

    Tasks first reduce their links to stars by union-find. Then large-star and
    small-star steps alternate until nothing changes, each written to the shared
    folder. Every step is a grouped minimum joined back, so no neighbour list is
    gathered anywhere.
    """
    stars = materialize(links.select("u", "v").mapInPandas(_forest, PAIR), "links")
    before = _print_of(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large")
        low = _lowest(large)
        small = low.select("u", F.col("m").alias("v")).unionByName(
            low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = materialize(small.distinct().mapInPandas(_forest, PAIR).distinct(), "links")
        now = _print_of(stars)
        if now == before:
            break
        before = now
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots)
