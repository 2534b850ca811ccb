"""Language identification with bit-sliced Bloom filters of n-grams.

A Bloom filter per language holds the n-grams that are typical of it.  The filters are bit-sliced:
position p of all of them is one bitmask with a bit per language, so that and-ing the few masks an
n-gram hashes to returns at once every language that may contain it.  A text's score for a
language is the popcount of its bit over the text's n-grams, corrected for false positives: a
filter that is filled to a share f answers f**HASHES of all strangers, so h hits out of n stand for
(h - n f**HASHES) / (1 - f**HASHES) true ones.  The language with the most true hits wins.

Training counts, over all texts to learn from, every distinct n-gram per language: per task first,
then summed by a shuffle.  A language takes an n-gram whose share of that language's n-grams is at
least ``TYPICAL`` times its share in the language that uses it most.  Shares are smoothed as if each
language had ``PRIOR`` n-grams more, dealt as in all languages together, so the rule is the same for
tables and languages of any size.  All counts cover all rows; the filters are sized by the largest
number of n-grams that a language takes, and languages beyond 64 get further masks.

N-grams are ``GRAM`` bytes of the text with A-Z lowered and runs of other ASCII characters than
letters as one space.  Rules: null texts and texts without a letter are ``und`` with score 0; a text
without a known n-gram gets the language with the most training n-grams, with score 0; with nothing
to learn from all are ``und``.  Ties go to the alphabetically first language.  Repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mixed, small_batches, text_steps

GRAM, TYPICAL, PRIOR = 4, 0.5, 1000
#: Least positions of a filter (a power of two), positions for each n-gram at least, and hashes per n-gram.
POSITIONS, ROOM, HASHES = 1 << 20, 5, 3
#: Languages in one mask.
BITS = 64

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of some texts, and where each text's n-grams begin and end."""
    plain = _LETTER[data]
    stay = np.ones(len(plain), bool)
    if len(plain):
        stay[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
        borders = offsets[1:-1]
        stay[borders[borders < len(plain)]] = True  # a text keeps its own first space
    kept = np.concatenate([[0], np.cumsum(stay)])
    bounds = kept[offsets]
    plain = plain[stay].astype(np.uint64)
    n = max(len(plain) - GRAM + 1, 0)
    value = np.zeros(n, np.uint64)
    for i in range(GRAM):
        value |= plain[i : i + n] << np.uint64(8 * i)
    # n-grams that run over a border belong to no text
    begins = np.minimum(bounds[:-1], n)
    return value, np.stack([begins, np.maximum(bounds[1:] - GRAM + 1, begins)], axis=1)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text) with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams)), "gram": pa.array(grams.view(np.int64)), "n": pa.array(sums)})
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, end, data, offsets in text_steps(batch, "text"):
                values, spans = _grams(data, offsets)
                own = langs[first:end]
                for lang in sorted(set(own)):
                    mine = [values[a:b] for a, b in spans[own == lang].tolist()]
                    grams, n = _counted(np.concatenate(mine))
                    held.setdefault(lang, []).append((grams, n))
                    size += len(grams)
            if size > 2_000_000:
                yield from out()
                size = 0
        yield from out()

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counted = rows.mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _places(values: np.ndarray, positions: int = POSITIONS) -> list[np.ndarray]:
    """The positions that each n-gram hashes to."""
    h = mixed(values + np.uint64(0x51))
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(i) * two) & np.uint64(positions - 1)).astype(np.int64) for i in range(HASHES)]


class SlicedFilters:
    """Masks by position (one row of them for each 64 languages), the languages of the bits, and how far each filter is filled."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, np.atleast_2d(masks)
        fill = [np.count_nonzero(self.masks[i // BITS] >> np.uint64(i % BITS) & np.uint64(1)) for i in range(len(languages))]
        self.wrong = (np.array(fill, float) / self.masks.shape[1]) ** HASHES

    def holders(self, values: np.ndarray, row: int = 0) -> np.ndarray:
        """A mask per n-gram with the bits of all languages of a row that may contain it."""
        first, *rest = (self.masks[row][p] for p in _places(values, self.masks.shape[1]))
        for more in rest:
            first = first & more
        return first

    def hits(self, values: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Corrected popcounts, one row per text and one column per language."""
        count = (spans[:, 1] - spans[:, 0])[:, None]
        out = np.zeros((len(spans), len(self.languages)))
        for i in range(len(self.languages)):
            if i % BITS == 0:
                held = self.holders(values, i // BITS)
            upto = np.concatenate([[0], np.cumsum(held >> np.uint64(i % BITS) & np.uint64(1), dtype=np.int64)])
            out[:, i] = upto[spans[:, 1]] - upto[spans[:, 0]]
        return np.maximum((out - count * self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0)


def learned_filters(docs: DataFrame) -> SlicedFilters:
    """Filters from all rows of ``docs`` (lang, text); languages come first by training size."""
    counts = gram_counts(docs)
    counts = counts.persist()
    try:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        ranked = totals.orderBy(F.desc("total"), "lang").collect()  # as many rows as languages
        languages, everything = [r["lang"] for r in ranked], sum(r["total"] for r in ranked)
        rows = max(-(-len(languages) // BITS), 1)
        bit = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1 if languages else F.lit(0)
        known = counts.join(F.broadcast(totals), "lang").select("gram", bit.cast("int").alias("bit"), "n", "total")
        grams = known.groupBy("gram").agg(F.sum("n").alias("sum"), F.collect_list(F.struct("bit", "n", "total")).alias("all"))
        share = lambda x: (x["n"] + PRIOR * F.col("sum") / max(everything, 1)) / (x["total"] + PRIOR)
        shared = F.transform("all", lambda x: F.struct(x["bit"].alias("bit"), share(x).alias("share")))
        grams = grams.select("gram", shared.alias("all")).withColumn("most", F.array_max(F.transform("all", lambda x: x["share"])))
        chosen = grams.select("gram", F.filter("all", lambda x: x["share"] >= TYPICAL * F.col("most"))["bit"].alias("bits")).persist()
        most = chosen.select(F.explode("bits").alias("bit")).groupBy("bit").count().agg(F.max("count")).first()[0] or 0
        positions = max(POSITIONS, 1 << (ROOM * most - 1).bit_length()) if most else POSITIONS

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            masks = np.zeros((rows, positions), np.uint64)
            for batch in batches:
                values = batch.column(0).to_numpy().view(np.uint64)
                held = batch.column(1)
                owner, bits = np.repeat(values, np.diff(held.offsets.to_numpy())), held.flatten().to_numpy()
                for row in range(rows):
                    own = bits // BITS == row
                    for places in _places(owner[own], positions):
                        np.bitwise_or.at(masks[row], places, np.uint64(1) << (bits[own] % BITS).astype(np.uint64))
            for row in range(rows):
                at = np.flatnonzero(masks[row])
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(at), row, np.int32)), "at": pa.array(at), "mask": pa.array(masks[row][at].view(np.int64))})

        merged = chosen.mapInArrow(slices, "row int, at bigint, mask bigint").groupBy("row", "at").agg(F.expr("bit_or(mask)").alias("mask"))
        masks = np.zeros((rows, positions), np.uint64)
        found = merged.toArrow()  # at most one row for each position of each mask
        masks[found.column("row").to_numpy(), found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        chosen.unpersist()
    finally:
        counts.unpersist()
    return SlicedFilters(languages, masks)


def predicted(docs: DataFrame, filters: SlicedFilters) -> DataFrame:
    """``docs`` (any columns, text among them) with lang_pred and score behind them."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))
    names = docs.columns
    text = names.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or SlicedFilters(*shared.value)
            texts = batch.column(text).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if own.languages:
                order = np.argsort(own.languages)
                names_in_order = [own.languages[i] for i in order]
                only = pa.RecordBatch.from_arrays([batch.column(text)], names=["text"])
                for first, end, data, offsets in text_steps(only, "text"):
                    hits = own.hits(*_grams(data, offsets))[:, order]
                    best, total = hits.argmax(axis=1), hits.sum(axis=1)
                    best[total == 0] = int(np.flatnonzero(order == 0)[0])
                    scores[first:end] = np.where(total > 0, hits.max(axis=1) / np.maximum(total, 1e-9), 0)
                    langs[first:end] = [names_in_order[i] for i in best]
            for i, value in enumerate(texts):
                if value is None or not any(map(str.isalpha, value)):
                    langs[i], scores[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores)], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Is the CRC of the id, as text, in this fold?  An unknown id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def languages(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    held_out = in_fold(F.col("doc_id"), folds, fold)
    filters = learned_filters(docs.where(~held_out).select("lang", "text"))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predicted(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
