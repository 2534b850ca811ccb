"""What a worker of byte-level BPE holds at once is bounded in bytes, not only in pieces."""

from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from sitebooks.llm import byte_bpe, shared


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.RecursiveBpe(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN)


def test_a_query_takes_a_bounded_number_of_bytes(bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_ONCE_BYTES", 2_000, raising=False)
    sizes = {"pieces": [], "long_pieces": []}
    load = bpe._load
    monkeypatch.setattr(bpe, "_load", lambda name, rows: (sizes.get(name, []).append(rows.num_rows), load(name, rows)))
    usual = {f"é{i:03d}" * 8 for i in range(100)}  # 40 bytes each, so 50 at once
    between, long = {f"ab{i}" * 20 for i in range(100, 140)}, {"x" * 900 + str(i) for i in range(5)} | {"y" * 5_000}
    pieces = usual | between | long
    bpe.learn(pieces)
    assert max(sizes["pieces"]) <= 2_000
    assert sorted(sizes["long_pieces"])[-1] == 5_000 and sorted(sizes["long_pieces"])[-2] <= 2_000
    alone = byte_bpe.RecursiveBpe.encode_pieces
    for piece in pieces:
        assert bpe.raw[piece] == piece.encode()
    some = ["é007" * 8, "ab123" * 20, "x" * 900 + "3"]
    assert [bpe.ids[p] for p in some] == [" ".join(map(str, alone(bpe, [p.encode()])[0])) for p in some]


def test_runs_of_pieces_are_all_pieces():
    pieces = [f"{i}" for i in range(50_001)] + ["é" * byte_bpe.AT_ONCE_BYTES, "z"]
    runs = list(byte_bpe._at_once(pieces))
    assert [p for run in runs for p in run] == pieces
    assert max(map(len, runs)) == byte_bpe.AT_ONCE
    assert [len(run) for run in runs[-2:]] == [1, 1]
    assert list(byte_bpe._at_once([])) == []


def test_long_pieces_leave_the_memory_limit_as_it_was(bpe):
    limit = "select value from duckdb_settings() where name = 'memory_limit'"
    before = bpe.base.sql(limit).fetchall()
    bpe.encode_pieces([b"q" * 1_000, b"usual"])
    assert bpe.base.sql(limit).fetchall() == before
    assert int(float(before[0][0].split()[0])) < 100  # MiB


def test_texts_are_cut_a_megabyte_at_a_time():
    text = "x" * (1 << 18)
    assert [len(step) for step in byte_bpe._steps([text] * 9)] == [4, 4, 1]


def test_keeping_gives_back_the_tables_of_hashed_texts():
    shared.worker_gives_back()
    data = np.frombuffer(b"some words", np.uint8)
    shared.span_hashes(data, np.array([0, 5]), np.array([4, 10]))
    assert len(shared._powers[0])
    shared.worker_keeps("mark", object)
    assert not len(shared._powers[0])
    shared.worker_gives_back()
