"""Importance resampling: draw the documents whose words look most like a target collection.

Runs of one and two words are hashed into a fixed number of buckets. A bucket's gain
is the log ratio of its smoothed share in the target to that in the corpus, a
document's weight the mean gain of its features, and Gumbel noise on the weights
turns taking the highest scores into drawing without replacement. The cutoff is
found by bracketing: a quantile sketch proposes two scores, exact counts outside
them prove that the cutoff lies between or widen the bracket, and only rows inside
it are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospan.llm.common import fresh_name, materialize, numbered, over_batches, prepared
from heliospan.llm.words import BLOCK_BYTES, LOWER, parts, span_hashes, split_words

BUCKETS = 10_000
SHARE = (25, 100)
MIN_WORDS = 20
SEED = 7
# Width of the first bracket on either side of the wanted quantile.
BRACKET = 0.005

BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

SCORES = T.StructType([T.StructField(name, T.LongType()) for name in ("n_features", "weight", "score")])


def _crc_steps() -> list[np.ndarray]:
    """Tables that append 1, 2, 4, ... zero bytes to a CRC32, by the byte of the register."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    step = np.stack([one, byte, byte << np.uint32(8), byte << np.uint32(16)])
    tables = [step]
    for _ in range(31):
        step = np.stack([_zeros(row, step) for row in step])
        tables.append(step)
    return tables


def _zeros(crc: np.ndarray, step: np.ndarray) -> np.ndarray:
    out = step[0][crc & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ step[i][crc >> np.uint32(8 * i) & np.uint32(255)]
    return out


CRC_STEPS = _crc_steps()


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC32 of two strings put together, from the CRC32 of each and the length of the second."""
    out = first.copy()
    for i in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> i & 1)
        out[on] = _zeros(out[on], CRC_STEPS[i])
    return out ^ second


def feature_buckets(
    column: pa.Array, buckets: int = BUCKETS, limit: int = BLOCK_BYTES,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text index and bucket of every run of one or two words, and the text index of every word."""
    last: tuple[int, bytes] = (-1, b"")
    for part in parts(column, BREAKS, limit):
        data = LOWER[part.data]
        starts, ends, owner = split_words(data, part.offsets, BREAKS)
        if not len(starts):
            continue
        text = part.text[owner]
        raw = data.tobytes()
        _, where, number = np.unique(span_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
        spans = list(zip(starts[where].tolist(), ends[where].tolist()))
        own = np.array([zlib.crc32(raw[a:b]) for a, b in spans], np.uint32)
        spaced = np.array([zlib.crc32(b" ", c) for c in own.tolist()], np.uint32)
        crc, head, size = own[number], spaced[number], ends - starts
        pair = np.flatnonzero(text[1:] == text[:-1])
        joined = crc_joined(head[pair], crc[pair + 1], size[pair + 1])
        owners, crcs = [text, text[pair]], [crc, joined]
        if text[0] == last[0]:  # the text goes on from the part before
            over = zlib.crc32(last[1] + b" " + raw[starts[0]:ends[0]])
            owners.append(text[:1])
            crcs.append(np.array([over], np.uint32))
        last = int(text[-1]), raw[starts[-1]:ends[-1]]
        yield np.concatenate(owners), (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int64), text


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; every task adds its own up first."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in feature_buckets(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(add_up, "bucket BIGINT, n BIGINT")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share of a bucket over the corpus')."""
    size = len(corpus)
    s_all, t_all = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([
        math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, fixed by seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``docs`` and n_features, weight, score (columns of those names are replaced)."""
    prepared(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)).astype(float)
    rows = docs.drop(*SCORES.names)
    schema = T.StructType([*rows.schema.fields, *SCORES.fields])

    def score(batch: pa.RecordBatch) -> Iterator[dict]:
        n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for owner, bucket, _ in feature_buckets(batch.column("text"), buckets):
            n += np.bincount(owner, minlength=batch.num_rows)
            total += np.bincount(owner, gain[bucket], batch.num_rows)
        weight = total.astype(np.int64) // np.maximum(n, 1)
        ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
        luck = np.array([noise(i, seed) for i in ids], np.int64)
        kept = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        yield kept | {"n_features": n, "weight": weight, "score": weight + luck}

    return over_batches(rows, score, schema)


def cutoff(rows: DataFrame, k: int, total: int, bracket: float = BRACKET) -> Row:
    """score and doc_id of the ``k``-th of ``total`` rows by score descending, doc_id ascending (nulls last).

    A sketch proposes scores around the quantile. The rows above and inside are counted
    exactly; until the k-th row is inside, the bracket is made four times as wide.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    at = 1 - (k - 0.5) / total
    while True:
        low, high = rows.approxQuantile("score", [max(at - bracket, 0.0), min(at + bracket, 1.0)], bracket / 4)
        if bracket >= 1:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        within = F.col("score").between(low, high)
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(within)).first()
        if above < k <= above + inside:
            break
        bracket *= 4
    return numbered(rows.filter(within).select("score", "doc_id"), order, "n").filter(F.col("n") == k - above).first()


def is_drawn(cut: Row) -> Column:
    """At or above the cutoff; rows equal in score and doc_id are not told apart."""
    tie = F.lit(True) if cut["doc_id"] is None else F.coalesce(F.col("doc_id") <= cut["doc_id"], F.lit(False))
    return (F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & tie)


def _eligible(rows: DataFrame, share: tuple[int, int], min_words: int) -> tuple[DataFrame, int, int]:
    # n words make 2n - 1 features.
    enough = rows.filter(F.col("n_features") >= 2 * min_words - 1)
    total = enough.count()
    return enough, total, share[0] * total // share[1]


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``.

    Of the N documents with ``min_words`` words, the floor(share * N) highest scores are
    drawn; ties go to the smaller doc_id, a null doc_id last (its noise is that of an
    empty id). Repeated rows are rows of their own; which of two rows with equal score
    and doc_id has the better rank is open. Null and empty texts have no features,
    weight 0, and are never drawn. Empty tables give no rows, or no draw from a target
    without features but for the noise. Extra columns are not read.
    """
    thin = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), target, seed).drop("text")
    rows = materialize(thin, "importance")
    enough, total, k = _eligible(rows, share, min_words)
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select("*", unranked)
    cut = cutoff(enough, k, total)
    drawn = (F.col("n_features") >= 2 * min_words - 1) & is_drawn(cut)
    ranked = numbered(rows.filter(drawn), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.filter(~drawn).select("*", unranked).unionByName(ranked)


def drawn_documents(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """The documents drawn by ``resample``, with all their columns, and ``n_features``, ``weight``, ``score``.

    Rows equal to the last one in score and doc_id are all returned.
    """
    name = fresh_name(docs, "doc_id_")
    rows = scored(docs.withColumn(name, F.col("doc_id")), target, seed).drop(name)
    fixed = materialize(rows, "importance")
    enough, total, k = _eligible(fixed, share, min_words)
    if not k:
        return fixed.limit(0)
    return enough.filter(is_drawn(cutoff(enough, k, total)))
