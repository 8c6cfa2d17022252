"""Helpers shared by the corpus operators: Arrow batches, samples and written intermediates."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospan.session import apply_settings, materialize, scratch_dir  # noqa: F401

# Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 23
CLEAR_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_added: set[str] = set()


@lru_cache(maxsize=4)
def _shipped(application: str) -> str:
    """A zip of this package for the Python workers, which may not find it on their own path."""
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="heliospan-")) / "heliospan.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for part in sorted((root / "heliospan").rglob("*.py")):
            out.write(part, part.relative_to(root))
    return str(archive)


def prepared(spark: SparkSession) -> SparkSession:
    """Settings of the library, its code for the workers, and Arrow batches small enough for long texts."""
    apply_settings(spark)
    archive = _shipped(spark.sparkContext.applicationId)
    if archive not in _added:
        spark.sparkContext.addPyFile(archive)
        _added.add(archive)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def over_batches(
    rows: DataFrame, work: Callable[..., Iterator[dict]], schema: str | T.StructType,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Apply ``work`` to every Arrow batch; it yields dicts of equally long columns.

    ``setup`` runs once per task and its value is passed as a second argument.
    """
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(target)
        extra = () if setup is None else (setup(),)
        for batch in batches:
            if not batch.num_rows:
                continue
            for out in work(batch, *extra):
                arrays = [
                    v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type)
                    for f, v in ((f, out[f.name]) for f in fields)
                ]
                arrays = [
                    (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(f.type)
                    for a, f in zip(arrays, fields)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return rows.mapInArrow(run, target)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Batches of a task put together until their texts have ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written intermediates that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard_written(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for rows in tables:
        discard(rows.sparkSession, *{path.rsplit("/", 1)[0] for path in rows.inputFiles()})


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go with their job, not when the driver next collects its garbage.

    For chains of written intermediates. What is still to be run later is to be built outside.
    """
    before = spark.conf.get(CLEAR_SHUFFLES)
    spark.conf.set(CLEAR_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAR_SHUFFLES, before)


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices ``values[bounds[i]:bounds[i + 1]]`` as an Arrow list array."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def fresh_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``rows`` has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) drawn from a hash of the seed and the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def numbered(rows: DataFrame, order: list[Column], number: str) -> DataFrame:
    """``rows`` with ``number``, their place (from 1) in ``order`` over the whole table.

    Ranges of the order are sorted and counted by their tasks and written; one row for
    each range then gives the offsets. No task sees more than a range.
    """
    part, slot = fresh_name(rows, "_part"), fresh_name(rows, "_slot")
    target = T.StructType([*rows.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(slot, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, own, np.int32)), pa.array(np.arange(done + 1, done + n + 1))],
                names=[*batch.schema.names, part, slot])
            done += n

    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = materialize(ranges.mapInArrow(count, target), "ordered")
    sizes = sorted((r[0], r[1]) for r in fixed.groupBy(part).agg(F.max(slot)).collect())
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    starts = rows.sparkSession.createDataFrame(
        [(p, b) for (p, _), b in zip(sizes, before)], f"`{part}` INT, `_before` BIGINT")
    placed = fixed.join(F.broadcast(starts), part)
    return placed.withColumn(number, F.col("_before") + F.col(slot)).select(*rows.columns, number)


FILTER_BITS = 1 << 25


def id_filter(ids: DataFrame, slot: Column) -> np.ndarray:
    """A bitmap of fixed size (4 MB) with a bit set for the ``slot`` of every id, for ``maybe_in``.

    It only spares work: an id that is not there may pass, so an exact join follows.
    """
    words = ids.select(F.shiftright(slot, 6).cast("int").alias("at"), (slot % 64).cast("int").alias("bit"))
    bits = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return bitmap


def filter_slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def maybe_in(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6].view(np.uint64) >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
