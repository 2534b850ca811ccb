"""Token counts through a digest cache.

The cache is a Parquet table (content, version, n_bytes, n_tokens): the SHA-256 of a text's bytes,
the digest of the tokenizer file with its library's version, and the stored counts.  A run joins
its texts to the cache by both digests, encodes each distinct text that is missing once, appends
those counts, and reads all counts from the cache.  Texts meet by digest after a reduction per
task, so a group of copies travels as one row per task.

Normalising must not change a count, so it is: a null text is the empty text, and the bytes are
UTF-8.  A new tokenizer or library version never reads old counts.  Two runs that append the same
text at once leave two equal rows, which are read as one.  Repeated rows repeat in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, worker_keeps

CACHE = "content binary, version string, n_bytes bigint, n_tokens bigint"
#: Texts encoded in one call.
CALL_BYTES = 2 << 20


def _content(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def tokenizer_version(path: str) -> str:
    """Digest of what decides the counts: the vocabulary file and the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {version(library)}".encode()).hexdigest()


def _counter(raw: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(raw)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _worker_counter(raw: bytes, kind: str, mark: str) -> Callable[[list[str]], list[int]]:
    """The counter of this worker process, which outlives a task: it is read once, and the library keeps the words it met."""
    return worker_keeps((kind, mark), lambda: _counter(raw, kind))


def _calls(texts: list[str]) -> Iterator[list[str]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CALL_BYTES:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def _encoded(misses: DataFrame, path: str, mark: str) -> DataFrame:
    vocabulary = misses.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a file of fixed size
    kind = path.rpartition(".")[2]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        for batch in batches:
            count = _worker_counter(vocabulary.value, kind, mark)
            texts = batch.column("text").to_pylist()
            tokens = [n for call in _calls(texts) for n in count(call)]
            yield pa.RecordBatch.from_pydict(
                {
                    "content": batch.column("content"),
                    "version": pa.array([mark] * len(texts)),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                }
            )

    return misses.mapInArrow(encode, CACHE)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    ``path`` is a .json or .model vocabulary on the driver, ``cache`` a folder that all executors
    see; it is created by the first run.
    """
    spark = docs.sparkSession
    small_batches(spark)
    mark = tokenizer_version(path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", _content(F.col("text")))
    # an append of nothing makes the folder a table that can be read
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == mark)
    misses = rows.select("content", "text").dropDuplicates(["content"]).join(stored.select("content").distinct(), "content", "left_anti")
    _encoded(misses, path, mark).write.mode("append").parquet(cache)
    spark.catalog.refreshByPath(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == mark).dropDuplicates(["content"])
    out = rows.select("doc_id", "content").join(stored, "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
