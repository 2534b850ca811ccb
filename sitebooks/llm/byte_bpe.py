"""Byte-level BPE encoding and decoding with recursive queries.

Each task splits its texts by the pattern and gives the distinct pieces it has not met yet to
DuckDB.  There a piece is rows (piece, position, token), at first one per byte.  One step of the
recursive query joins every row and its right neighbour to the merge table, finds each piece's
leftmost pair of the lowest rank, and contracts it; a piece without a pair left is at its fixpoint
and leaves the recursion.  Ordered aggregation gives the token ids of a piece and, joined to the
vocabulary, its decoded bytes.  A text is the concatenation of its pieces.

A worker keeps the pieces it has encoded, up to ``KEPT`` of them, since pieces repeat far more than
texts do; that bounds its memory and changes no result.  They are kept in two halves: when the newer
one is full the older one goes, and pieces met again move to the newer one.

Rules: as the library that reads the rank file, without special tokens.  A null text is the empty
text: no ids, no bytes.  Text that cannot be UTF-8 cannot occur in a table.  Repeated rows repeat.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import small_batches, worker_keeps

#: Pieces kept by a worker; pieces and bytes of them given to one recursive query (a longer piece goes alone).
KEPT, AT_ONCE, AT_ONCE_BYTES = 400_000, 20_000, 1 << 18
#: Bytes from which a piece is contracted step by step on its own, without the rows of earlier steps.
LONG_PIECE = 200
#: Memory for a query of usual pieces, which DuckDB does not give back, and for one of long pieces.
MEMORY, LONG_MEMORY = "64MB", "200MB"

#: A row also knows its right neighbour, so a step only meets the merge table, finds the best place of
#: each piece, and changes the rows around that place.  What is found per piece (the place, the row that goes, its
#: neighbour) has one row a piece, so only these small tables are hashed, and the rows pass them.
_STEP = """
with recursive step(piece, pos, token, right_pos, right_token, done) as (
    select piece, pos, token, right_pos, right_token, false from pieces
    union all
    select * from (
        with pairs as materialized (
            select s.*, m.merged::bigint * 65536 + s.pos as place
            from step s left join merges m on m.first = s.token and m.second = s.right_token
            where not s.done
        ), best as materialized (
            select piece, min(place) as place from pairs group by piece
        ), chosen as materialized (
            select b.piece, (b.place % 65536)::int as pos, (b.place // 65536)::int as merged, p.right_pos as gone
            from best b left join pairs p on p.piece = b.piece and p.pos = b.place % 65536
        ), around as materialized (
            select c.*, r.right_pos, r.right_token
            from chosen c left join pairs r on r.piece = c.piece and r.pos = c.gone
        )
        select p.piece, p.pos,
               case when p.pos = c.pos then c.merged else p.token end,
               case when p.pos = c.pos then c.right_pos else p.right_pos end,
               case when p.pos = c.pos then c.right_token when p.right_pos = c.pos then c.merged else p.right_token end,
               c.pos is null
        from pairs p join around c on p.piece = c.piece
        where c.pos is null or p.pos <> c.gone
    )
)
"""
_ENCODE = _STEP + """
select piece, list(token order by pos) as ids from step where done group by piece
"""
#: Encoding and decoding at once: one ordered aggregation of the ids, as texts with a space behind, and of their bytes.
_BOTH = _STEP + """
select piece, list({written: written, bytes: bytes} order by pos) as parts
from step join vocabulary using (token) where done group by piece
"""
#: One step for long pieces: all places of the lowest rank at once, from the left where they overlap.
#: (No such merge makes a pair of a lower rank: its bytes would have been one token before.)
_LONG_STEP = """
create or replace table longer as
with near as (
    select piece, pos, token, lead(token) over w as neighbour, row_number() over w as number
    from long_pieces window w as (partition by piece order by pos)
), ranked as (
    select n.*, m.merged, coalesce(m.merged = min(m.merged) over (partition by n.piece), false) as hit
    from near n left join merges m on m.first = n.token and m.second = n.neighbour
), runs as (
    select *, number - sum(hit::int) over (partition by piece order by number) as run from ranked
), chosen as (
    select *, hit and row_number() over (partition by piece, run, hit order by number) % 2 = 1 as contract from runs
)
select piece, pos, case when contract then merged else token end as token
from (select *, coalesce(lag(contract) over (partition by piece order by number), false) as absorbed from chosen)
where not absorbed
"""
_DECODE = """
select piece, list(bytes order by pos) as parts
from coded join vocabulary using (token) group by piece
"""


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(first, second, merged): every two tokens whose bytes together are a token.

    Merging two neighbours is allowed whenever their joint bytes have a rank, and that rank is the
    order, so each token contributes all its cuts into two tokens.
    """
    rows = (
        (ranks[token[:cut]], ranks[token[cut:]], rank)
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    )
    columns = np.fromiter(rows, np.dtype((np.int32, 3)))  # row by row: no list of them is held
    return pa.table({name: columns[:, i] for i, name in enumerate(("first", "second", "merged"))})


def _at_once(pieces: list[str]) -> Iterator[list[str]]:
    """Runs of pieces that one query takes; together they are all pieces."""
    first, size = 0, 0
    for i, piece in enumerate(pieces):
        more = len(piece.encode())
        if i > first and (i - first >= AT_ONCE or size + more > AT_ONCE_BYTES):
            yield pieces[first:i]
            first, size = i, 0
        size += more
    if first < len(pieces):
        yield pieces[first:]


def _side_by_side(parts: pa.ListArray, field: str) -> tuple[bytes, list[int]]:
    """One field of lists of structs: its values as they lie side by side, and where each list begins and ends."""
    values = parts.values.field(field)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset :]
    return data.to_pybytes(), ends[parts.offsets.to_numpy()].tolist()


class RecursiveBpe:
    """One DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = read_ranks(raw)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = {}, {}
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.base.execute("set preserve_insertion_order = false")
        self._load("merges", merge_table(ranks))
        fields = [pa.array(self.tokens, pa.int32()), pa.array([f"{t} " for t in self.tokens]), pa.array(self.tokens.values(), pa.binary())]
        self._load("vocabulary", pa.table(fields, ["token", "written", "bytes"]))

    def _load(self, name: str, rows: pa.Table) -> None:
        self.base.register("incoming", rows)
        self.base.execute(f"create or replace table {name} as select * from incoming")
        self.base.unregister("incoming")

    def _positions(self, pieces: list[bytes]) -> pa.Table:
        sizes = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = (np.arange(int(sizes.sum())) - np.repeat(starts, sizes)).astype(np.int32)
        token = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.zeros(len(pos), bool)
        last[np.cumsum(sizes) - 1] = True  # a piece's last byte has no right neighbour
        right = {"right_pos": pa.array(pos + 1, mask=last), "right_token": pa.array(np.roll(token, -1), mask=last)}
        return pa.table({"piece": piece, "pos": pos, "token": token} | right)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece; no piece is empty."""
        out: list[list[int]] = [[]] * len(pieces)
        usual = [i for i, p in enumerate(pieces) if len(p) < LONG_PIECE]
        for numbers, long in ((usual, False), ([i for i, p in enumerate(pieces) if len(p) >= LONG_PIECE], True)):
            if not numbers:
                continue
            rows = self._positions([pieces[i] for i in numbers])
            if long:
                self.base.execute(f"set memory_limit = '{LONG_MEMORY}'")
                self._load("long_pieces", rows)
                left = rows.num_rows + 1
                while (now := self.base.execute("select count(*) from long_pieces").fetchall()[0][0]) < left:
                    left = now
                    self.base.execute(_LONG_STEP)
                    self.base.execute("create or replace table long_pieces as select * from longer")
                query = "select piece, list(token order by pos) as ids from long_pieces group by piece"
            else:
                self._load("pieces", rows)
                query = _ENCODE
            found = self.base.sql(query).to_arrow_table()
            if long:
                self.base.execute(f"drop table long_pieces; drop table if exists longer; set memory_limit = '{MEMORY}'")
            for piece, ids in zip(found.column("piece").to_pylist(), found.column("ids").to_pylist(), strict=True):
                out[numbers[piece]] = ids
        return out

    def decode_pieces(self, coded: list[list[int]]) -> list[bytes]:
        """The bytes of each list of token ids."""
        sizes = np.array([len(c) for c in coded], np.int64)
        starts = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(coded), dtype=np.int32), sizes)
        token = np.fromiter((t for c in coded for t in c), np.int32, int(sizes.sum()))
        pos = (np.arange(len(token)) - np.repeat(starts, sizes)).astype(np.int32)
        self._load("coded", pa.table({"piece": piece, "pos": pos, "token": token}))
        out = [b""] * len(coded)
        found = self.base.sql(_DECODE).to_arrow_table()
        for number, parts in zip(found.column("piece").to_pylist(), found.column("parts").to_pylist(), strict=True):
            out[number] = b"".join(parts)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode and decode the pieces that are not kept yet."""
        new = pieces.difference(self.ids)
        if len(self.ids) + len(new) > KEPT // 2:
            self.older, self.ids, self.raw = (self.ids, self.raw), {}, {}
            new = pieces
        ids, raw = self.older
        again = [piece for piece in new if piece in ids]
        for piece in again:
            self.ids[piece], self.raw[piece] = ids[piece], raw[piece]
        new = new.difference(again)
        short, long = [], []
        for piece in new:
            (short if len(piece) < LONG_PIECE // 4 else long).append(piece)
        for part in _at_once(short):
            self._load("pieces", self._positions([p.encode() for p in part]))
            found = self.base.sql(_BOTH).to_arrow_table().combine_chunks()
            own = [part[number] for number in found.column("piece").to_pylist()]
            parts = found.column("parts").combine_chunks()
            written, bounds = _side_by_side(parts, "written")
            written = written.decode()
            self.ids.update((p, written[x : y - 1]) for p, x, y in zip(own, bounds[:-1], bounds[1:], strict=True))
            data, bounds = _side_by_side(parts, "bytes")
            self.raw.update((p, data[x:y]) for p, x, y in zip(own, bounds[:-1], bounds[1:], strict=True))
        for part in _at_once(long):
            coded = self.encode_pieces([p.encode() for p in part])
            for piece, ids, raw in zip(part, coded, self.decode_pieces(coded), strict=True):
                self.ids[piece], self.raw[piece] = " ".join(map(str, ids)), raw

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """(number of tokens, ids joined by a space, decoded bytes) of each text."""
        cut = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*cut))
        ids, raw = self.ids.__getitem__, self.raw.__getitem__
        for pieces in cut:
            joined = " ".join(map(ids, pieces))
            yield joined.count(" ") + bool(joined), joined, b"".join(map(raw, pieces))


def worker_bpe(raw: bytes, pattern: str) -> RecursiveBpe:
    """The encoder of this worker process, which outlives a task."""
    return worker_keeps(hashlib.sha256(raw + pattern.encode()).digest(), lambda: RecursiveBpe(raw, pattern))


#: Characters of text handled at once: all their pieces are held, and each recursive query costs the same again, however
#: few its pieces.
STEP_CHARACTERS = 1 << 20


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, until their texts are as large as a step."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STEP_CHARACTERS:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _steps(texts: list[str]) -> Iterator[list[str]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STEP_CHARACTERS:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def round_trip(docs: DataFrame, path: str, pattern: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    With ``texts`` also ``ids`` (array) and ``decoded`` (text).  ``path`` is a rank file on the
    driver, ``pattern`` cuts a text into pieces that are encoded separately.
    """
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a file of fixed size
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            bpe = worker_bpe(ranks.value, pattern)
            count, coded, decoded, ids, plain = [], [], [], [], []
            for step in _steps(batch.column(1).fill_null("").to_pylist()):
                for n, joined, raw in bpe.texts(step):
                    count.append(n)
                    coded.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
                    if texts:
                        ids.append([int(i) for i in joined.split()])
                        plain.append(raw.decode())
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(count, pa.int64()),
                "ids_sha256": pa.array(coded, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            if texts:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(plain, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
