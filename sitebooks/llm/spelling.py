"""Spelling variants: words one insertion, deletion or replacement apart, and the form each follows.

Reduced-alphabet generation.  A letter's code point modulo the number of symbols is its symbol, so a
word becomes a reduced word over few symbols.  Two words one edit apart have reduced words that are
equal or one edit apart.  Every word generates the one-edit neighbourhood of its reduced word, and
the neighbours meet the reduced vocabulary in an equi join; what meets is verified on the original
words.  Each unordered pair of reduced words is generated from one side only: deletions reach the
shorter word, replacements the smaller symbol, so insertions and larger symbols are the other
word's; a letter inside a run of equal symbols is deleted once.  The whole neighbourhood is covered.

The number of symbols follows the counted vocabulary (its eighth root): a reduced word then has
about as many words behind it at any size, while a neighbourhood grows by that root only.

Neighbours are 64-bit hashes with the number of a word, so a word of any length travels once and
its neighbours have 16 bytes each.  The hashes only propose pairs.

Rules: words are distinct texts with their counts; null words and counts are left out, repeated words
are added up.  Empty and one-letter words are words like others.  Ties between forms go to the smallest word in code-point
order.  A vocabulary without near words gives null forms, an empty one an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, mixed, staged

#: Letters of a word (after lower-casing A-Z), least length and count of a word.
LETTERS, LEAST_LENGTH, LEAST_COUNT = r"[a-zÀ-ÿ]", 7, 2
#: One run in so many loses a letter; a form is so many times as frequent.
NOISE, FACTOR = 31, 10
#: The number of symbols is this root of the vocabulary, and not below the least.
ROOT, LEAST_SYMBOLS = 8, 4
#: Letters that one numpy step works on; a longer word is worked on alone.
STEP_LETTERS = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def corpus_words(documents: DataFrame, least: int = LEAST_LENGTH, noise: int | None = NOISE) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z lower-cased, at least ``least`` code points long.

    With ``noise`` a run whose crc32 of ``<doc_id>:<run>`` it divides loses one letter; runs of documents with a
    null id lose none.  Null texts have no words.
    """
    # maximal: a match starts where a run starts, since shorter rests of one are never left over
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(runs).alias("run"))
    if noise is None:
        words = rows.select(F.col("run").alias("word"))
    else:
        crc = F.crc32(F.concat("doc_id", F.lit(":"), F.col("run")).cast("binary"))
        rows = rows.select("run", crc.alias("crc"))
        place = (F.col("crc") % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
        word = F.when(F.col("crc") % noise == 0, shorter).otherwise(F.col("run"))
        words = rows.select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def symbols_for(n_words: int) -> int:
    """The smallest number of symbols whose ``ROOT``-th power reaches the vocabulary."""
    symbols = LEAST_SYMBOLS
    while symbols**ROOT < n_words:
        symbols += 1
    return symbols


def _reduced(words: list[str], symbols: int) -> tuple[np.ndarray, ...]:
    """Symbols (from 1) of all words in a row, word of each, place in its word, first place of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(words)), sizes)
    return (points % np.uint32(symbols)).astype(np.uint64) + np.uint64(1), owner, np.arange(len(points)) - first[owner], first


def _powers(n: int) -> tuple[np.ndarray, np.uint64]:
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    return np.cumprod(power, dtype=np.uint64), np.uint64(pow(_BASE, -1, 2**64))


def reduced_keys(words: list[str], symbols: int) -> np.ndarray:
    """64-bit hash of each reduced word."""
    symbol, _, place, first = _reduced(words, symbols)
    power, _ = _powers(int(place.max(initial=0)) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbol * power[place], dtype=np.uint64)))
    return mixed(sums[first[1:]] - sums[first[:-1]])


def neighbour_keys(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, key) arrays: each word's own reduced word, its deletions, and replacements by smaller symbols."""
    symbol, owner, place, first = _reduced(words, symbols)
    power, back = _powers(int(place.max(initial=0)) + 1)
    part = symbol * power[place]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
    whole = sums[first[1:]] - sums[first[:-1]]
    yield np.arange(len(words)), mixed(whole)
    head = np.ones(len(symbol), bool)
    head[1:] = (symbol[1:] != symbol[:-1]) | (place[1:] == 0)
    at = np.flatnonzero(head)
    before = sums[at] - sums[first[owner[at]]]
    behind = sums[first[owner[at] + 1]] - sums[at + 1]
    yield owner[at], mixed(before + behind * back)
    for less in range(1, symbols):
        at = np.flatnonzero(symbol > less)
        yield owner[at], mixed(whole[owner[at]] - np.uint64(less) * power[place[at]])


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    begin, held = 0, 0
    for i, word in enumerate(words):
        if held and held + len(word) > STEP_LETTERS:
            yield ids[begin:i], words[begin:i]
            begin, held = i, 0
        held += len(word)
    if words:
        yield ids[begin:], words[begin:]


def _keyed(vocabulary: DataFrame, symbols: int, neighbours: bool) -> DataFrame:
    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words in _steps(batch):
                parts = neighbour_keys(words, symbols) if neighbours else [(np.arange(len(words)), reduced_keys(words, symbols))]
                for owner, keys in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[owner])], ["key", "id"])

    return vocabulary.select("id", "word").mapInArrow(generate, "key bigint, id bigint")


def near_pairs(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(a, b): ids of words exactly one edit apart, each pair once.  ``vocabulary`` has unique ids and words."""
    cells = _keyed(vocabulary, symbols, False).select("key", F.col("id").alias("b"))
    made = _keyed(vocabulary, symbols, True).select("key", F.col("id").alias("a"))
    met = made.join(cells, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = vocabulary.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    right = vocabulary.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    near = met.join(left, "a").join(right, "b").where(F.levenshtein("word_a", "word_b", 1) == 1)
    # two words of one reduced word meet from both sides, all others from one
    return near.dropDuplicates(["a", "b"])


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of ``words`` (word, n).

    The form is the near word of largest n, if that is ``factor`` times the word's n or more; the
    root is reached by following forms.  A form is ``factor`` times as frequent, so the chain is
    short, and following it doubles the steps made with each join.
    """
    if factor < 2:
        raise ValueError("forms of equal count could follow each other in a circle")
    summed = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = staged(summed.withColumn("id", F.monotonically_increasing_id()))
    n_words, least, most = vocabulary.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()
    pairs = near_pairs(vocabulary, symbols_for(n_words))
    sides = F.array(
        F.struct(F.col("a").alias("id"), F.struct((-F.col("n_b")).alias("less"), F.col("word_b").alias("word"), F.col("b").alias("id")).alias("near")),
        F.struct(F.col("b").alias("id"), F.struct((-F.col("n_a")).alias("less"), F.col("word_a").alias("word"), F.col("a").alias("id")).alias("near")),
    )
    best = pairs.select(F.inline(sides)).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    follows = -F.col("near.less") >= F.col("n") * factor
    found = staged(
        vocabulary.join(best, "id", "left").select(
            "id", "word", "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(follows, F.col("near.word")).alias("form"),
            F.when(follows, -F.col("near.less")).alias("form_n"),
            F.when(follows, F.col("near.id")).alias("form_id"),
        )
    )
    roots = found.where("form_id is not null").select("id", F.col("form_id").alias("root_id"), F.col("form").alias("root"))
    for _ in range(doublings(least or 1, most or 1, factor)):
        further = roots.toDF("root_id", "next_id", "next")
        roots = staged(
            roots.join(further, "root_id", "left").select(
                "id", F.coalesce("next_id", "root_id").alias("root_id"), F.coalesce("next", "root").alias("root")
            )
        )
    out = found.join(roots.select("id", "root"), "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def doublings(least: int, most: int, factor: int) -> int:
    """How often the steps must double until they cover the longest chain of forms."""
    steps, n = 0, max(least, 1) * factor
    while n <= most:
        steps, n = steps + 1, n * factor
    return max(steps - 1, 0).bit_length()
