"""Blocks of text ask tables that are dealt by key, and get the answers back.

Counting every run of words or bytes of a corpus row by row moves many times its
size. Here a task first turns about ``BLOCK_BYTES`` of text into one row, a block,
kept in a table bucketed by block. A block asks for each of its distinct keys once:
``asked`` sends sorted keys and counts to the bucket of the key, ``answered`` merges
what all blocks sent to a bucket, and ``met`` brings the answers to the blocks. Only
distinct keys of blocks are shuffled, the block tables stay where they are, and a
frequent key is one entry of every block, whatever its count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heliospan.llm.common import discard, scratch_dir

BLOCK_BYTES = 1 << 22
# A bucket merges about this many keys at a time.
BUCKET_KEYS = 1 << 20
BLOCK_KEYS = 1 << 19
ASKED = "bucket INT, block BIGINT, keys BINARY, counts BINARY"


@dataclass
class Blocks:
    rows: DataFrame
    path: str
    count: int
    keys: int = BLOCK_KEYS

    def drop(self) -> None:
        discard(self.rows.sparkSession, self.path)

    @property
    def buckets(self) -> int:
        """More with the blocks, so that what one bucket merges stays bounded."""
        least = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(least, -(-self.count * self.keys // BUCKET_KEYS))


def written(rows: DataFrame, label: str, keys: int = BLOCK_KEYS) -> Blocks:
    """``rows`` (a row for each ``block``) as a table bucketed by block in the shared folder.

    Every block goes to one bucket, so the tasks write them without a shuffle, and
    later meetings of blocks and answers shuffle the answers alone. ``keys`` is about
    how many a block will ask for.
    """
    spark = rows.sparkSession
    path, name = scratch_dir(spark, label), f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(parts, "block").option("path", path).option("parquet.block.size", 1 << 24).format("parquet").saveAsTable(name)
    found = spark.table(name)
    count = found.count()
    spark.sql(f"DROP TABLE {name}")  # the files stay; only the name goes
    return Blocks(found, path, count, keys)


def new_block() -> Callable[[], int]:
    """Numbers for the blocks of a task, unlike those of any other task."""
    from pyspark import TaskContext

    state = [TaskContext.get().partitionId() << 32]

    def take() -> int:
        state[0] += 1
        return state[0]

    return take


def values(raw: object, kind: type) -> np.ndarray:
    return np.frombuffer(raw.as_py() if isinstance(raw, pa.Scalar) else raw, kind)


def packed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """64-bit integers (differences of ``rising`` ones) by byte plane, compressed."""
    numbers = numbers.astype(np.uint64)
    if rising and len(numbers):
        numbers = np.append(numbers[:1], np.diff(numbers))
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: object, rising: bool = False) -> np.ndarray:
    raw = raw.as_py() if isinstance(raw, pa.Scalar) else raw
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    numbers = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(numbers, dtype=np.uint64) if rising else numbers


def edges(buckets: int, bits: int = 64) -> np.ndarray:
    """First key of every bucket; keys that agree in their first ``bits`` share a bucket."""
    return np.array([-(-i * (1 << bits) // buckets) << (64 - bits) for i in range(buckets)], np.uint64)


def asked(blocks: DataFrame, ask: Callable[[dict], tuple[np.ndarray, np.ndarray]], buckets: int, bits: int = 64) -> DataFrame:
    """Sorted distinct keys (uint64) and counts (int64) of every block, by bucket. ``ask`` gets a block as a dict."""
    low = edges(buckets, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                keys, counts = ask(block)
                cut = np.append(np.searchsorted(keys, low), len(keys))
                some = np.flatnonzero(np.diff(cut))
                if len(some):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block["block"].as_py())),
                        pa.array([packed(keys[cut[b]:cut[b + 1]], True) for b in some], pa.binary()),
                        pa.array([packed(counts[cut[b]:cut[b + 1]]) for b in some], pa.binary()),
                    ], names=["bucket", "block", "keys", "counts"])

    return blocks.mapInArrow(run, ASKED)


def kept(questions: DataFrame, label: str) -> Blocks:
    """Questions that are answered more than once, written by bucket: one shuffle for all passes over them."""
    spark = questions.sparkSession
    path, name = scratch_dir(spark, label), f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = questions.repartition(parts, "bucket")
    dealt.write.bucketBy(parts, "bucket").option("path", path).option("parquet.block.size", 1 << 24).format(
        "parquet").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return Blocks(found, path, 0)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their total counts, the order that sorts all keys, and each sorted key's number."""
    every, each = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")  # merges the sorted runs
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    starts = np.flatnonzero(new)
    return every[starts], np.add.reduceat(each[order], starts), order, np.cumsum(new) - 1


def answered(
    questions: DataFrame, answer: Callable[[int, np.ndarray, list[np.ndarray], list[np.ndarray]], Iterator[dict]], schema: str,
) -> DataFrame:
    """``answer`` gets a bucket, its blocks in order, and their keys and counts; it yields dicts of columns."""

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys = [unpacked(x, True) for x in table["keys"]]
        counts = [unpacked(x).view(np.int64) for x in table["counts"]]
        bucket, numbers = table["bucket"][0].as_py(), table["block"].to_numpy()
        del table
        pa.default_memory_pool().release_unused()
        found = answer(bucket, numbers, keys, counts)
        return pa.Table.from_batches(
            [pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) for f in target], schema=target) for x in found], target)

    return questions.groupBy("bucket").applyInArrow(run, schema)


def met(blocks: DataFrame, answers: DataFrame, work: Callable[[dict, pa.Table], dict | None], schema: str) -> DataFrame:
    """One row for each block from ``work``, which gets the block as a dict and its answers by bucket."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for i in range(left.num_rows):
            block = {n: left[n][i] for n in left.column_names}
            row = work(block, right.sort_by("bucket"))
            pa.default_memory_pool().release_unused()
            if row is not None:
                rows.append(pa.RecordBatch.from_arrays(
                    [x if isinstance(x := row[f.name], pa.Array) else pa.array([x], f.type) for f in target], schema=target))
        return pa.Table.from_batches(rows, target)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
