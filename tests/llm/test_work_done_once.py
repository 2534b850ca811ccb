"""What is learned or read once stays known, and samples stay out of the driver."""

import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from sitebooks.llm import byte_bpe, ngram_join, quality, queries, shared, token_counts


def test_met_pieces_are_not_learned_again():
    bpe = byte_bpe.RecursiveBpe(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN)
    loaded = []
    load = bpe._load
    bpe._load = lambda name, rows: (loaded.append(name), load(name, rows))
    one, two = ({f"{side}{i}" for i in range(70_000)} for side in "ab")
    for pieces in (one, two):
        bpe.learn(pieces)
    assert loaded
    loaded.clear()
    bpe.learn(one)
    assert loaded == []
    assert (bpe.ids["a6"], bpe.raw["a6"]) == (" ".join(map(str, bpe.encode_pieces([b"a6"])[0])), b"a6")


def test_small_batches_are_learned_together():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one", None]})
    assert [b.num_rows for b in byte_bpe._grouped(iter([batch] * 5))] == [10]
    assert list(byte_bpe._grouped(iter([]))) == []
    large = pa.RecordBatch.from_pydict({"doc_id": [3], "text": ["x" * byte_bpe.STEP_CHARACTERS]})
    assert [b.num_rows for b in byte_bpe._grouped(iter([batch, large, batch]))] == [3, 2]


def test_a_worker_reads_the_vocabulary_once():
    raw = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()
    count = token_counts._worker_counter(raw, "json", "mark")
    assert token_counts._worker_counter(raw, "json", "mark") is count
    assert token_counts._worker_counter(raw, "json", "another") is not count
    assert count(["", "one two"])[0] == 0


def test_quality_sample_stays_out_of_the_driver(spark, monkeypatch):
    queries.workers_find_package(spark)
    rows = [(i, "good words here" if i % 2 else "!!!! #### 0000", "en", "web", 15) for i in range(60)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    collected, collect = [], type(documents).collect

    def counted(df):
        found = collect(df)
        collected.append(len(found))
        return found

    monkeypatch.setattr(type(documents), "collect", counted)
    model = quality.trained(documents, labels)
    assert [len(w) for w in model.weights] == [quality.TEXT_SIZE + 1, 14 + 2 * quality.NAME_SIZE + 1]
    assert max(collected) == 1
    assert quality.trained(documents, labels.where("quality = 1")) is None


def test_a_worker_keeps_what_one_operator_left_and_gives_it_back():
    raw = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    bpe = byte_bpe.worker_bpe(raw, public_tokenizers.PATTERN)
    assert byte_bpe.worker_bpe(raw, public_tokenizers.PATTERN) is bpe
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()
    token_counts._worker_counter(vocabulary, "json", "mark")
    assert len(shared._kept_here) == 1
    assert byte_bpe.worker_bpe(raw, public_tokenizers.PATTERN) is not bpe
    list(ngram_join._sets(pa.RecordBatch.from_pydict({"text": ["some words of a text", None]}), 3))
    assert shared._kept_here == {}


def test_levels_of_a_block_are_made_for_used_counters_only():
    grouped = []

    class Counted:
        def groupBy(self, key):
            return self

        def applyInArrow(self, add, schema):
            grouped.append(add)

    ngram_join._levels(Counted())
    lists = [(np.array([3, 7, 9]), [1, 255, 2]), (np.array([7, 8, 9]), [255, 1, 40])]
    fields = {
        "block": pa.array([5, 5], pa.int32()),
        "chunk": pa.array([0, 1], pa.int64()),
        "places": pa.array([ngram_join._packed(p) for p, _ in lists], pa.binary()),
        "counts": pa.array([bytes(c) for _, c in lists], pa.binary()),
    }
    tracemalloc.start()
    found = grouped[0]((pa.scalar(5),), pa.table(fields))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20  # the sums of a block are 16 MB
    level = {7: int(np.ceil(4 * np.log2(511))), 9: int(np.ceil(4 * np.log2(43)))}
    for places, levels in zip(found.column("places").to_pylist(), found.column("levels").to_pylist(), strict=True):
        assert ngram_join._unpacked(places).tolist() == [7, 9]
        assert list(levels) == [level[7], level[9]]
