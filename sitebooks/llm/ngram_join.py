"""N-gram Jaccard join: which documents share most of their word shingles.

Two sets of sizes n <= m with Jaccard similarity of at least s overlap in at least s * n tokens.
Under one order of all tokens (rare first) they therefore meet within their first
``n - ceil(s * n) + 1`` tokens, and meet twice within one token more.  So

1. counters, at least one for each byte of text, count all shingles of all texts and give the rare-first order.
   Texts are dealt to chunks of some MB; a chunk sends its counters once to the tasks that add them up,
   block by block, and gets back those that are above one, so no task and no broadcast holds them all;
2. every distinct set posts its prefix tokens; only tokens posted twice matter;
3. centres: in each bucket (token, size class) the set with the fewest rarer tokens is compared with
   the rest, so copies meet a representative and not each other;
4. the remainder is exact: sets of one bucket that have no common centre are paired.
   A token whose bucket holds few components is an index key by itself; for a frequent one the key
   is the token combined with each later token of the one-token-longer prefix;
5. candidates pass length, position and parity-bitmap bounds, then the sets are compared.

Rules: white-space words with A-Z lowered; a text of fewer words than a shingle is one shingle;
no words, no links.  Documents are told apart by their id; rows without an id, and rows of one id with
different texts, by id and text (a 64-bit hash).  A null id is larger than all others and never names
a component that has another id.  Repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import (
    components,
    fresh,
    mixed,
    only_listed,
    shingle_hashes,
    small_batches,
    span_hashes,
    staged,
    text_steps,
    word_spans,
)

#: Components in a bucket above which its token counts as frequent and is combined.
FREQUENT = 32
#: Members of a bucket above which they are spread over several tasks.
HOT = 10_000
#: Bytes of text in a chunk (a longer text is a chunk of its own), and counters in a block as a power of two.
CHUNK_BYTES, BLOCK_BITS = 8 << 20, 22
_WORDS = 16  # 64-bit words of a parity bitmap


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_steps(batch, "text"):
        starts, ends, bounds = word_spans(data, offsets)
        yield from shingle_hashes(span_hashes(data, starts, ends), bounds, k)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a column that is the same for rows of the same id and text only.

    It is the id where that has one text, else a hash of both, so all texts of an id are documents.
    """
    own, content = F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(own.alias("id"), content.alias("content")).where("id is not null")
    several = texts.groupBy("id").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi")
    marked, several_id = fresh(docs, "marked"), fresh(docs, "several_id")
    several = staged(several.select(F.col("id").alias(several_id), F.lit(True).alias(marked)))
    both = docs.join(several, own == F.col(several_id), "left")
    hashed = own.isNull() | F.col(marked).isNotNull()
    mixed_key = F.xxhash64(F.coalesce(own, F.lit(-1)), own.isNull(), F.coalesce("text", F.lit("")))
    return both.select(*docs.columns, F.when(hashed, mixed_key).otherwise(own).alias(key))


def _chunked(docs: DataFrame) -> DataFrame:
    """``docs`` (id, doc_id, text) with the number of a chunk and the bytes of the text, written once.

    A chunk is a run of rows of one task, whatever their ids, so repeated rows do not gather.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64())
            chunks = []
            for more in size.to_pylist():
                if filled and filled + more > CHUNK_BYTES:
                    chunk, filled = chunk + 1, 0
                filled += more
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(chunks, pa.int64())], [*batch.schema.names, "bytes", "chunk"])

    rows = docs.select("id", "doc_id", "text").mapInArrow(number, "id bigint, doc_id bigint, text string, bytes bigint, chunk bigint")
    return staged(rows)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as steps, bytes of one weight together, which shuffles compress."""
    return np.diff(numbers.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _counted(chunked: DataFrame, k: int, bits: int) -> DataFrame:
    """Per chunk and block the counters that the chunk uses: their places in the block and its own counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            places, counts = np.unique(np.concatenate(held), return_counts=True)
            blocks = (places >> np.uint64(BLOCK_BITS)).astype(np.int32)
            names, first = np.unique(blocks, return_index=True)
            own = (places & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            for name, begin, end in zip(names.tolist(), first, [*first[1:], len(places)], strict=True):
                fields = [[name], [current], [_packed(own[begin:end])], [np.minimum(counts[begin:end], 255).astype(np.uint8).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, types, strict=True)], ["block", "chunk", "places", "counts"])

        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        held, current = [], None
        for batch in batches:
            for chunk, hashes in zip(batch.column(1).to_pylist(), _sets(batch, k), strict=True):
                if chunk != current:
                    if held:
                        yield from sent()
                    held, current = [], chunk
                if len(hashes):
                    held.append(hashes >> np.uint64(64 - bits))
        if held:
            yield from sent()

    return chunked.select("text", "chunk").mapInArrow(count, "block int, chunk bigint, places binary, counts binary")


def _levels(counted: DataFrame) -> DataFrame:
    """Per chunk and block the counters above one with their level, about 4 log2 of the count."""

    def add(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        sums = np.zeros(1 << BLOCK_BITS, np.uint32)
        lists = list(zip(sent.column("places").to_pylist(), sent.column("counts").to_pylist(), strict=True))
        for places, counts in lists:
            sums[_unpacked(places)] += np.frombuffer(counts, np.uint8)
        back, levels = [], []
        for places, _ in lists:
            own = _unpacked(places)
            own = own[sums[own] > 1]
            back.append(_packed(own))
            # of the used counters only: a list is small, all counters of a block as doubles are not
            levels.append(np.minimum(np.ceil(4 * np.log2(1.0 + sums[own])), 255).astype(np.uint8).tobytes())
        fields = [sent.column("chunk"), sent.column("block"), pa.array(back, pa.binary()), pa.array(levels, pa.binary())]
        return pa.table(fields, ["chunk", "block", "places", "levels"])

    return counted.groupBy("block").applyInArrow(add, "chunk bigint, block int, places binary, levels binary")


#: The level of a token that is counted once.
_ONCE = 4


def _profiles(chunked: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: set size, set digest, parity bitmap and the rare-first prefix, one token longer than needed."""
    total = chunked.agg(F.sum("bytes")).first()[0] or 0
    bits = BLOCK_BITS + max(-(-total >> BLOCK_BITS), 1).bit_length()
    levels = _levels(_counted(chunked, k, bits))

    def profile(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = {}
        for block, places, own in zip(*(right.column(c).to_pylist() for c in ("block", "places", "levels")), strict=True):
            lists.setdefault(block, []).append((_unpacked(places), np.frombuffer(own, np.uint8)))
        known, level_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for block in sorted(lists):
            # a chunk read by two tasks sends two lists for a block
            places, first = np.unique(np.concatenate([p for p, _ in lists[block]]), return_index=True)
            known.append(places.astype(np.uint64) | np.uint64(block << BLOCK_BITS))
            level_of.append(np.concatenate([v for _, v in lists[block]])[first].astype(np.uint64))
        known, level_of = np.concatenate(known), np.concatenate(level_of)
        size, one, two, parities, prefix = [], [], [], [], []
        for batch in left.to_batches():
            for hashes in _sets(batch, k):
                own = np.unique(hashes)
                n = len(own)
                size.append(n)
                one.append(own.sum(dtype=np.uint64).astype(np.int64))
                two.append(mixed(own).sum(dtype=np.uint64).astype(np.int64))
                parity = np.bincount((own & np.uint64(64 * _WORDS - 1)).astype(np.int64), minlength=64 * _WORDS) & 1
                parities.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                level = np.full(n, _ONCE, np.uint64)
                if len(known):
                    places = own >> np.uint64(64 - bits)
                    at = np.minimum(np.searchsorted(known, places), len(known) - 1)
                    level = np.where(known[at] == places, level_of[at], level)
                order = (level << np.uint64(56)) | (own & np.uint64((1 << 56) - 1))
                need = min(n, n - -(-percent * n // 100) + 2)
                order = np.partition(order, need - 1)[:need] if need < n else order
                prefix.append(np.sort(order).view(np.int64))
        return pa.table(
            {
                "id": left.column("id"),
                "doc_id": left.column("doc_id"),
                "n": pa.array(size, pa.int64()),
                "one": pa.array(one, pa.int64()),
                "two": pa.array(two, pa.int64()),
                "bits": pa.array(parities, pa.list_(pa.int64())),
                "prefix": pa.array(prefix, pa.list_(pa.int64())),
            }
        )

    schema = "id bigint, doc_id bigint, n bigint, one bigint, two bigint, bits array<bigint>, prefix array<bigint>"
    texts = chunked.select("id", "doc_id", "text", "chunk").groupBy("chunk")
    return texts.cogroup(levels.groupBy("chunk")).applyInArrow(profile, schema)


def _may_link(n: Column, m: Column, shared: Column, percent: int) -> Column:
    """Can two sets of these sizes with at most ``shared`` common tokens reach the similarity?"""
    return F.lit(100) * shared >= F.lit(percent) * (n + m - shared)


def _near(a: Column, b: Column) -> Column:
    """Lower bound of the symmetric difference: differing parity bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        """``docs``: id (the key), doc_id, text."""
        self.docs = _chunked(docs)
        self.rows = staged(_profiles(self.docs, k, percent))
        sets = self.rows.where("n > 0").groupBy("n", "one", "two").agg(F.min("id").alias("rep"))
        self.member = staged(self.rows.select("id", "n", "one", "two").join(sets, ["n", "one", "two"]).select("id", "rep"))
        reps = self.member.where("id = rep").select("id").distinct()
        self.reps = self.rows.join(reps, "id", "left_semi").dropDuplicates(["id"])
        # the first tokens are index keys by themselves, the last one only extends them
        posted = self.reps.where("n > 1").select("id", "n", F.posexplode("prefix").alias("pos", "token"))
        posted = posted.where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
        twice = posted.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("token")
        self.shared = staged(posted.join(twice, "token").select("token", "id", "n", "pos"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) those whose sets are similar enough."""
        k, percent = self.k, self.percent
        bits = self.reps.select("id", "n", "bits")
        left = bits.toDF("a", "n_a", "bits_a")
        right = bits.toDF("b", "n_b", "bits_b")
        both = F.col("n_a") + F.col("n_b")
        near = pairs.join(left, "a").join(right, "b").where(
            _may_link(F.col("n_a"), F.col("n_b"), (both - _near(F.col("bits_a"), F.col("bits_b"))) / 2, percent)
        )
        near = staged(near.select("a", "b"))
        named = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
        texts = only_listed(self.docs.select("id", "text"), "id", named).join(named, "id", "left_semi").dropDuplicates(["id"])
        texts = staged(texts)
        with_texts = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets: dict[str, dict[int, np.ndarray]] = {}
                for side in ("a", "b"):
                    ids, texts = batch.column(side), batch.column(f"text_{side}")
                    places = {}
                    for place, value in enumerate(ids.to_pylist()):
                        places.setdefault(value, place)
                    own = pa.RecordBatch.from_pydict({"text": texts.take(pa.array(list(places.values()), pa.int64()))})
                    sets[side] = {i: np.unique(h) for i, h in zip(places, _sets(own, k), strict=True)}
                keep = []
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                    x, y = sets["a"][a], sets["b"][b]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Length and position bounds over rows (a, n_a, pos_a, b, n_b, pos_b); distinct pairs."""
        rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        fitting = pairs.where(_may_link(F.col("n_a"), F.col("n_b"), rest, self.percent))
        return fitting.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def centre_pairs(self, placed: DataFrame) -> DataFrame:
        """Every set of a bucket with the bucket's centre, the one with the fewest rarer tokens."""
        step = float(np.log(100 / self.percent)) if self.percent < 100 else 1.0
        sized = placed.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
        pick = F.struct(F.col("pos").alias("pos_b"), F.col("id").alias("b"), F.col("n").alias("n_b"))
        centres = sized.groupBy("token", "size").agg(F.min(pick).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("members"))
        centres = staged(centres.where("lo < hi").withColumn("salts", F.floor(F.col("members") / HOT) + 1))
        # members of a hot bucket are dealt by id, and its centre goes wherever they are
        hot = centres.where("salts > 1").select("token", "size", "salts")
        sized = sized.join(hot, ["token", "size"], "left")
        sized = sized.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))).drop("salts")
        centres = centres.select("token", "size", "c.*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        met = sized.join(centres, ["token", "size", "salt"]).where("id <> b")
        return self.bounded(met.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), "b", "n_b", "pos_b"))

    def remaining_pairs(self, placed: DataFrame) -> DataFrame:
        """All pairs of different components that share a key, whatever their number."""
        held = placed.select("token", "component").distinct()
        counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        met = placed.join(counts, "token")
        rare = met.where(F.col("held") <= FREQUENT).withColumn("next", F.lit(0).cast("bigint"))
        longer = self.reps.select("id", "prefix")
        often = met.where(F.col("held") > FREQUENT).join(longer, "id")
        often = often.withColumn("next", F.explode(F.slice("prefix", F.col("pos") + 2, F.size("prefix")))).drop("prefix")
        keyed = staged(rare.unionByName(often).drop("held"))
        # what the members of a component can reach at best decides whether they are paired at all
        best = [F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("n").alias("least")]
        groups = keyed.groupBy("token", "next", "component").agg(*best)
        one, other = (groups.withColumnsRenamed({c: f"{c}_{s}" for c in ("component", "rest", "least")}) for s in "ab")
        reach = F.least("rest_a", "rest_b")
        two = one.join(other, ["token", "next"]).where((F.col("component_a") < F.col("component_b")) & _may_link(F.col("least_a"), F.col("least_b"), reach, self.percent))
        two = two.select("token", "next", F.col("component_a").alias("of_a"), F.col("component_b").alias("of_b"))
        side = lambda s: keyed.select("token", "next", F.col("component").alias(f"of_{s}"), F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("pos").alias(f"pos_{s}"))
        pairs = two.join(side("a"), ["token", "next", "of_a"]).join(side("b"), ["token", "next", "of_b"])
        return self.bounded(pairs)

    def labels(self) -> DataFrame:
        """(id, component) of every distinct set that links with another."""
        linked = staged(self.linked(self.centre_pairs(self.shared.withColumn("component", F.col("id")))))
        named = self.shared.join(_hubs(linked).toDF("id", "component"), "id", "left")
        placed = named.withColumn("component", F.coalesce("component", "id"))
        return components(linked.union(self.linked(self.remaining_pairs(placed))))


def _hubs(links: DataFrame) -> DataFrame:
    """(id, hub): for each set that links, the linked one (or itself) with the most links.

    Sets with the same hub are connected, which is all that the next step needs to know.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy(F.col("b").alias("hub")).agg(F.count(F.lit(1)).alias("links"))
    reach = both.union(degree.select("hub", "hub"))
    ranked = reach.join(degree, reach["b"] == degree["hub"]).groupBy("a")
    return ranked.agg(F.max(F.struct("links", (-F.col("hub")).alias("less")))["less"].alias("less")).select("a", (-F.col("less")).alias("hub"))


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links).

    ``docs`` needs doc_id and text.  ``percent`` is the least Jaccard similarity of linked sets.
    """
    keyed = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "id")
    return _labelled(keyed, k, percent).select("doc_id", "n_shingles", "component_id")


def _labelled(keyed: DataFrame, k: int, percent: int) -> DataFrame:
    """id (the key), doc_id, n_shingles, component_id of each row of ``keyed`` (id, doc_id, text)."""
    small_batches(keyed.sparkSession)
    join = _Join(keyed, k, percent)
    label = join.member.join(join.labels().toDF("rep", "component"), "rep", "left")
    label = label.select("id", F.coalesce("component", "rep").alias("component")).distinct()
    out = join.rows.select("id", "doc_id", "n").join(label, "id", "left")
    out = staged(out.withColumn("component", F.coalesce("component", "id")))
    # a component is known by its smallest key, which is no id where the key is a hash
    names = out.groupBy("component").agg(F.min("doc_id").alias("name")).where("not (name <=> component)")
    out = out.join(names.withColumn("renamed", F.lit(True)), "component", "left")
    name = F.when(F.col("renamed").isNotNull(), F.col("name")).otherwise(F.col("component"))
    return out.select("id", "doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))


def keep_representatives(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id.

    Rows that repeat an id stay together; rows without an id stay unless they link to one with.
    """
    key, dropped_key = fresh(docs, "own_key"), fresh(docs, "dropped_key")
    keyed = _keyed(docs, key)
    groups = _labelled(keyed.select(F.col(key).alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), k, percent)
    dropped = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(dropped_key)).distinct()
    return keyed.join(dropped, F.col(key) == F.col(dropped_key), "left_anti").select(*docs.columns)
