"""Line dedup that can be undone: reference counts per line, in front of them cuckoo filters.

The state of all documents inserted so far is three tables in a shared folder:

* ``holders``  (doc_id, key): which document holds which line, as written, never gathered by key;
* ``counts``   (shard, key, refs, first_id): exact number of holders and the smallest of them;
* ``filters``  (shard, filter): one cuckoo filter of the keys of each shard.

An insertion asks the shard's filter first.  Keys that it does not know are new and are appended;
only the others meet the exact table; those that it lacks after all are put into the filter too, so
each counted key has a fingerprint of its own.  A deletion subtracts the document's holders, finds the next
smallest holder for keys that lost theirs, and takes keys without holders out of the filter, which
a cuckoo filter can do.  Inserting and deleting the same documents restores the earlier counts.
Each step writes a new version of the state, so a failed step leaves the old one.

Keys: the line without ASCII white space at both ends, A-Z lowered, kept as its MD5.  A key of at
least ``MIN_LENGTH`` code points that two documents hold loses its lines everywhere but in the
smallest doc_id.  Rows that share a doc_id are one document; a null id is a document after all
others.  A null or empty text is one empty line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ascii_lower, document_id, fresh, mixed, shared_folder, small_batches

MIN_LENGTH = 10
#: Lines that one shard should hold about; the first insertion fixes the number of shards by it.
SHARD_LINES = 500_000
_WHITE = " \t\n\x0b\x0c\r"


class CuckooFilter:
    """Set of 64-bit hashes with 16-bit fingerprints, four to a bucket, all steps vectorised.

    It never forgets a member; it takes about one in 8,000 strangers for one.  Only members may be
    removed.  When a table is full a new one of twice the size is put beside it.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024):
        self.tables = [self._empty(capacity)]
        self.held = 0

    def _empty(self, capacity: int) -> np.ndarray:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(capacity, 1) / (0.85 * self.SLOTS)))))
        return np.zeros((buckets, self.SLOTS), np.uint16)

    @staticmethod
    def _mark(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)

    @staticmethod
    def _other(bucket: np.ndarray, mark: np.ndarray, table: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(len(table) - 1)).astype(np.int64)

    def _first(self, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(16)) & np.uint64(len(table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, found = self._mark(hashes), np.zeros(len(hashes), bool)
        for table in self.tables:
            one = self._first(hashes, table)
            for bucket in (one, self._other(one, mark, table)):
                found |= (table[bucket] == mark[:, None]).any(axis=1)
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Insert distinct hashes that are not members."""
        self.held += len(hashes)
        while len(hashes):
            table = self.tables[-1]
            room = int(table.size * 0.9) - int(np.count_nonzero(table))
            left = self._fill(table, hashes[: max(room, 0)])
            hashes = np.concatenate([left, hashes[max(room, 0) :]])
            if len(hashes):
                self.tables.append(self._empty(max(2 * table.size, len(hashes))))

    def _fill(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Place what fits; a hash is undone as a whole if its chain of moves finds no room."""
        mark = self._mark(hashes)
        bucket = self._first(hashes, table)
        todo = np.arange(len(hashes))
        for turn in range(2):  # first either of the two buckets, without moving anything
            target = bucket if turn == 0 else self._other(bucket, mark, table)
            while len(todo):
                places, at = np.unique(target[todo], return_index=True)
                own = todo[at]
                free = table[places] == 0
                fits = free.any(axis=1)
                if not fits.any():
                    break
                table[places[fits], free[fits].argmax(axis=1)] = mark[own[fits]]
                todo = np.setdiff1d(todo, own[fits], assume_unique=True)
        left = []
        for i in todo.tolist():  # the few that need moves
            moved, place, now = [], int(bucket[i]), mark[i]
            for kick in range(self.KICKS):
                free = np.flatnonzero(table[place] == 0)
                if len(free):
                    table[place, free[0]] = now
                    break
                slot = (kick + i) % self.SLOTS
                moved.append((place, slot, table[place, slot]))
                table[place, slot], now = now, table[place, slot]
                place = int(self._other(np.array([place]), np.array([now]), table)[0])
            else:
                for place, slot, before in reversed(moved):
                    table[place, slot] = before
                left.append(hashes[i])
        return np.array(left, np.uint64)

    def remove(self, hashes: np.ndarray) -> None:
        """Take members out, one fingerprint each."""
        for h in hashes.tolist():
            one = np.array([h], np.uint64)
            mark = self._mark(one)
            for table in reversed(self.tables):
                first = self._first(one, table)
                hit = [(int(b[0]), s) for b in (first, self._other(first, mark, table)) for s in np.flatnonzero(table[int(b[0])] == mark[0])]
                if hit:
                    table[hit[0]] = 0
                    self.held -= 1
                    break

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.tables), self.held, *map(len, self.tables)], np.int64)
        return sizes.tobytes() + b"".join(t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        count, held = np.frombuffer(raw, np.int64, 2)
        sizes = np.frombuffer(raw, np.int64, count, 16)
        own, at = cls.__new__(cls), 16 + 8 * int(count)
        own.held, own.tables = int(held), []
        for buckets in sizes.tolist():
            table = np.frombuffer(raw, np.uint16, buckets * cls.SLOTS, at).reshape(buckets, cls.SLOTS)
            own.tables.append(table.copy())
            at += table.nbytes
        return own


def line_key(line: Column) -> Column:
    """MD5 of the stripped, lowered line; null where it is too short to be deduplicated."""
    key = ascii_lower(F.btrim(line, F.lit(_WHITE)))
    return F.when(F.char_length(key) >= MIN_LENGTH, F.unhex(F.md5(key)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


_SHARD_SCHEMA = "shard int, key binary, refs bigint, first_id bigint, known boolean"


def _hashes(keys: pa.Array) -> np.ndarray:
    """The first eight bytes of each key."""
    raw = b"".join(k[:8] for k in keys.to_pylist())
    return mixed(np.frombuffer(raw, np.uint64))


class LineDedup:
    """The state in ``folder``, and the steps on it."""

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None):
        self.spark, self.folder, self.shards = spark, folder or shared_folder(spark), shards
        self.version = 0
        small_batches(spark)

    _TABLES = {
        "holders": "doc_id bigint, key binary",
        "counts": "shard int, key binary, refs bigint, first_id bigint",
        "filters": "shard int, filter binary",
    }

    def _table(self, name: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self._TABLES[name])
        return self.spark.read.schema(self._TABLES[name]).parquet(f"{self.folder}/{self.version}/{name}")

    def _save(self, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{self.version + 1}/{name}")
        self.version += 1

    def _holders(self, docs: DataFrame) -> DataFrame:
        keys = F.array_distinct(F.array_compact(F.transform(_lines(F.col("text")), line_key)))
        return docs.select(document_id().alias("doc_id"), F.explode(keys).alias("key"))

    def insert(self, docs: DataFrame) -> None:
        """Add documents that are not in the state yet."""
        holders_path = f"{self.folder}/{self.version + 1}/new_holders"
        self._holders(docs).write.parquet(holders_path)
        new = self.spark.read.schema(self._TABLES["holders"]).parquet(holders_path)
        if self.shards is None:
            self.shards = max(16, -(-new.count() // SHARD_LINES))
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        batch = new.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_id"))
        batch = batch.select(shard.alias("shard"), "key", "refs", "first_id")
        self._merge(new, batch)

    def _merge(self, new: DataFrame, batch: DataFrame) -> None:
        target = f"{self.folder}/{self.version + 1}"

        def pass_filter(key, left: pa.Table, right: pa.Table) -> pa.Table:
            (number,) = key
            known = right.column("filter").to_pylist()
            own = CuckooFilter.from_bytes(known[0]) if known else CuckooFilter(max(len(left), 1024))
            hashes = _hashes(left.column("key")) if len(left) else np.zeros(0, np.uint64)
            seen = own.contains(hashes)
            own.add(hashes[~seen])
            kept = left.select(["shard", "key", "refs", "first_id"]).append_column("known", pa.array(seen))
            state = pa.table(
                {"shard": [number.as_py()], "key": pa.array([None], pa.binary()), "refs": pa.array([None], pa.int64()), "first_id": pa.array([None], pa.int64()), "known": pa.array([None], pa.bool_()), "filter": pa.array([own.to_bytes()], pa.binary())}
            ).cast(pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("refs", pa.int64()), ("first_id", pa.int64()), ("known", pa.bool_()), ("filter", pa.binary())]))
            kept = kept.append_column("filter", pa.nulls(len(kept), pa.binary())).cast(state.schema)
            return pa.concat_tables([kept, state])

        passed = batch.groupBy("shard").cogroup(self._table("filters").groupBy("shard")).applyInArrow(pass_filter, f"{_SHARD_SCHEMA}, filter binary")
        passed.write.parquet(f"{target}/passed")
        passed = self.spark.read.schema(f"{_SHARD_SCHEMA}, filter binary").parquet(f"{target}/passed")
        rows = passed.where("filter is null")
        fields = ["shard", "key", "refs", "first_id"]
        counts = self._table("counts")
        if self.version:
            asked = rows.where("known").select("key", F.col("refs").alias("more"), F.col("first_id").alias("other"))
            met = counts.join(asked, "key", "left").select(
                "shard", "key", (F.col("refs") + F.coalesce("more", F.lit(0))).alias("refs"), F.least("first_id", "other").alias("first_id")
            )
            # the filter may take a new key for a known one: those are new all the same
            wrong = rows.where("known").join(counts.select("key"), "key", "left_anti").select(*fields)
            wrong.write.parquet(f"{target}/wrong")
            wrong = self.spark.read.schema(self._TABLES["counts"]).parquet(f"{target}/wrong")
            merged = met.unionByName(wrong).unionByName(rows.where("not known").select(*fields))
            filters = self._remembering(wrong, passed)
        else:
            merged = rows.select(*fields)
            filters = passed.where("filter is not null").select("shard", "filter")
        self._save(
            holders=self._table("holders").unionByName(new),
            counts=merged,
            filters=filters,
        )

    def _remembering(self, wrong: DataFrame, passed: DataFrame) -> DataFrame:
        """The filters with a fingerprint for each new key that they took for a known one."""

        def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
            own = CuckooFilter.from_bytes(right.column("filter")[0].as_py())
            if len(left):
                own.add(_hashes(left.column("key")))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([own.to_bytes()], pa.binary())})

        filters = passed.where("filter is not null").select("shard", "filter")
        return wrong.select("shard", "key").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(add, self._TABLES["filters"])

    def delete(self, ids: DataFrame) -> None:
        """Take documents out again; ``ids`` has one column of ids, null for the one without."""
        gone = ids.select(F.coalesce(F.col(ids.columns[0]).cast("bigint"), F.lit(2**63 - 1)).alias("doc_id")).distinct()
        holders = self._table("holders")
        lost = holders.join(gone, "doc_id", "left_semi").distinct()
        rest = holders.join(gone, "doc_id", "left_anti")
        less = lost.groupBy("key").agg(F.count(F.lit(1)).alias("less"))
        counts = self._table("counts").join(less, "key", "left")
        counts = counts.withColumn("refs", F.col("refs") - F.coalesce("less", F.lit(0)))
        orphaned = counts.where("less is not null and refs > 0").select("key")
        heirs = rest.join(orphaned, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
        kept = counts.where("refs > 0").join(heirs, "key", "left").select("shard", "key", "refs", F.coalesce("heir", "first_id").alias("first_id"))
        dead = counts.where("refs = 0").select("shard", "key")

        def forget(key, left: pa.Table, right: pa.Table) -> pa.Table:
            own = CuckooFilter.from_bytes(right.column("filter")[0].as_py())
            if len(left):
                own.remove(_hashes(left.column("key")))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([own.to_bytes()], pa.binary())})

        filters = dead.groupBy("shard").cogroup(self._table("filters").groupBy("shard")).applyInArrow(forget, self._TABLES["filters"])
        self._save(holders=rest, counts=kept, filters=filters)

    def maybe_held(self, lines: DataFrame) -> DataFrame:
        """Of ``lines`` (line) those that the filters may know, without touching the exact table."""
        keyed = lines.select("line", line_key(F.col("line")).alias("key")).where("key is not null")
        keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return left.select(["line"]).slice(0, 0)
            own = CuckooFilter.from_bytes(right.column("filter")[0].as_py())
            return left.select(["line"]).filter(pa.array(own.contains(_hashes(left.column("key")))))

        return keyed.groupBy("shard").cogroup(self._table("filters").groupBy("shard")).applyInArrow(ask, "line string")

    def decisions(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses, for documents that lose some."""
        often = self._table("counts").where("refs > 1").select("key", "first_id")
        lost = self._table("holders").join(often, "key").where("doc_id <> first_id")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the remaining text, and n_lines and n_dropped (names of its own if taken) behind it.

        The text of a document with more than one line is joined again by line breaks; a document
        that loses all its lines stays, with an empty text.
        """
        own, lost = fresh(docs, "own_id"), fresh(docs, "lost")
        count = [fresh(docs, "n_lines"), fresh(docs, "n_dropped")]
        decided = self.decisions().toDF(own, lost)
        rows = docs.withColumn(own, document_id()).withColumn("text", F.coalesce("text", F.lit("")))
        rows = rows.join(decided, own, "left").drop(own).select(*docs.columns, lost)
        schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in count]])
        at = docs.columns.index("text")

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, dropped, kept = [], [], []
                columns = batch.columns
                for text, lost in zip(columns[at].to_pylist(), columns[-1].to_pylist(), strict=True):
                    lines = text.split("\n")
                    stay = lines
                    if lost:
                        gone = set(lost)
                        stay = [x for x in lines if hashlib.md5(x.encode().strip(_WHITE.encode()).lower()).digest() not in gone]
                    total.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                columns[at] = pa.array(kept, pa.string())
                columns[-1:] = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rows.mapInArrow(strip, schema)


def deduplicated_lines(docs: DataFrame, increments: int = 1) -> DataFrame:
    """Insert ``docs`` in so many increments into a new state and apply the decisions to them."""
    state = LineDedup(docs.sparkSession)
    for i in range(increments):
        state.insert(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == i))
    return state.apply(docs)
