"""Helpers the corpus operators share: staged tables, batches of texts, word hashes, sketches, components.

Hashing is vectorised: the bytes of many texts are one numpy array, every word gets a 64-bit
polynomial hash from prefix sums, and no Python loop runs over words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on; a longer text is worked on alone.
STEP_BYTES = 1 << 20
#: Rows in an Arrow batch, so that batches of long texts stay small.
BATCH_ROWS = 500
#: Stands in for an unknown document id inside joins.
NO_ID = 2**63 - 1


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage safely."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def document_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def known_id(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the plain function is used where it cannot touch other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(
        text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())
    ).otherwise(F.lower(text))


# -- what a worker process keeps ----------------------------------------------

_kept_here: dict[Hashable, Any] = {}


def worker_keeps(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave in this worker process, which outlives a task; only the last key's, so operators do not add up."""
    if key not in _kept_here:
        worker_gives_back()
        _powers[:] = [np.zeros(0, np.uint64)] * 2  # as long as the longest text that was hashed here
        _kept_here[key] = make()
    return _kept_here[key]


def worker_gives_back() -> None:
    """Let go of what another operator's tasks left in this worker process."""
    if _kept_here:
        _kept_here.clear()
        pa.default_memory_pool().release_unused()


# -- batches of texts ---------------------------------------------------------


def text_steps(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about STEP_BYTES; a null text is empty."""
    worker_gives_back()  # operators that hash texts keep nothing
    texts = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, everything[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15  # 5 modulo 8: odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of data[start:end] for each span."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWERED_BYTE if lower else _BYTE)[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space), and the words of each text as bounds."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = solid[borders]  # a text begins: no word runs over the border
    last[borders - 1] = solid[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its k-word shingle hashes; a text of fewer words gives one for all its words."""
    factor = mixed(np.arange(1, k + 1, dtype=np.uint64))
    n = max(len(words) - k + 1, 0)
    sums = np.zeros(n, np.uint64)
    for i in range(k):
        sums += words[i : i + n] * (factor[i] | np.uint64(1))
    sums = mixed(sums)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= k:
            yield sums[begin : end - k + 1]
        elif end > begin:
            few = words[begin:end] * (factor[: end - begin] | np.uint64(1))
            yield mixed(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(end - begin))
        else:
            yield sums[:0]


# -- sketches of fixed size ---------------------------------------------------

SKETCH_BITS, BLOCK_BITS = 24, 18
_BLOCK = 1 << BLOCK_BITS


def sketch_blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The non-empty blocks of one task's counters, each saturated at 255 and compressed."""
    press = zstandard.ZstdCompressor(level=1)
    for block in range(len(counts) >> BLOCK_BITS):
        part = counts[block * _BLOCK : (block + 1) * _BLOCK]
        if part.any():
            packed = press.compress(np.minimum(part, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([packed], pa.binary())})


def merged_sketch(blocks: DataFrame) -> np.ndarray:
    """One log-scale byte (about 4 log2) per counter: 16 MB at any input size.

    Each task's blocks meet by block number; what a task holds is the counters of its blocks,
    however many tasks sent some.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(unpress.decompress(packed), np.uint8)
                if block in sums:
                    sums[block] += part
                else:
                    sums[block] = part.astype(np.int64)
        for block, counts in sums.items():
            level = np.minimum(np.ceil(4 * np.log2(1.0 + counts)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([level.tobytes()], pa.binary())})

    parts = 1 << (SKETCH_BITS - BLOCK_BITS)
    summed = blocks.repartition(min(parts, 16), "block").mapInArrow(add, "block int, counts binary")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in summed.toLocalIterator():  # a fixed number of blocks
        levels[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["counts"], np.uint8)
    return levels


def only_listed(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id may be in ``listed`` (one id column): a fixed-size filter before a join.

    It passes every listed id and few others, so the join behind it stays exact and moves less.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint8)
        for batch in batches:
            counts[mixed(batch.column(0).to_numpy().astype(np.uint64)) >> np.uint64(64 - SKETCH_BITS)] = 1
        yield from sketch_blocks(counts)

    spark = df.sparkSession
    levels = spark.sparkContext.broadcast(merged_sketch(listed.mapInArrow(count, "block int, counts binary")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).astype(np.uint64)
            yield batch.filter(pa.array(levels.value[mixed(ids) >> np.uint64(64 - SKETCH_BITS)] > 0))

    return df.mapInArrow(keep, df.schema)


# -- connected components -----------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for ids that have an edge.

    Alternates two star steps until the links are stars: each step keeps connectivity, and every
    step is a grouped minimum (summed up before the shuffle) joined back, so a hub is never
    gathered in one place.  Each step is staged.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        near = both(links)
        least = near.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = near.join(least, near["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        below = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(below, large["a"] == below["u"])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(below.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = staged(small.where("a <> b").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(links.select("b", "b").distinct().toDF("id", "component"))
